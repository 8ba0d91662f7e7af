import random

import pytest
from helpers import plain_nearest_space
from pyspark.sql import functions as F

from timedtext.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, n",
    [
        ("", 0),
        ("Rain. Sun. Wind? Snow!", 4),
        ("See fig. 3 on p. 12. It is blue.", 3),
        ("Ms. Ito met J. R. Ames? Yes.", 2),
        ("It costs 3.50. Fine", 2),
        ("open at 9 a.m. sharp", 1),
        ("wait...what? no", 2),
    ],
)
def test_split_sentences(spark, text, n):
    assert len(value(spark, t.split_sentences(F.lit(text)))) == n


def test_split_sentences_with_the_mark_itself_in_the_text(spark):
    text = "One\x01two. Three. "
    assert value(spark, t.split_sentences(F.lit(text))) == ["One\x01two.", "Three."]


def test_legacy_profile_keeps_blank_parts_and_exclamations(spark):
    assert value(spark, t.split_sentences(F.lit("Hi! you. "), "v0")) == ["Hi! you.", ""]
    assert value(spark, t.split_sentences(F.lit("A. b"), "v0")) == ["A.", "b"]


@pytest.mark.parametrize(
    "text, cut, expected", [("q", 1, 1), ("no_gap", 2, 2), ("ab cdefg h", 4, 3), ("ab cdefg h", 7, 9), ("  x", 0, 1)]
)
def test_snap_to_space(spark, text, cut, expected):
    cuts = F.array(F.lit(cut))
    assert value(spark, t.snap_to_space(F.lit(text), cuts)) == [expected]


def test_snap_to_space_everywhere(spark):
    text = "a bc  def ghij éé"
    cuts = F.sequence(F.lit(0), F.lit(len(text)))
    expected = [plain_nearest_space(text, c) for c in range(len(text) + 1)]
    assert value(spark, t.snap_to_space(F.lit(text), cuts)) == expected


def test_snap_to_space_legacy(spark):
    def snap(text, cut):
        return value(spark, t.snap_to_space(F.lit(text), F.array(F.lit(cut)), "v0"))[0]

    assert snap("ab cd", 5) == 5  # no space on the right: unchanged
    assert snap("abc defghijk lm", 2) == 4
    assert snap("abcdefghijk lm", 2) == 0  # far right space, none on the left


def test_snap_to_word(spark):
    words = F.array(*map(F.lit, ["我们", "喜欢", "，", "音乐"]))
    cuts = F.array(*map(F.lit, [0, 1, 2, 3, 4, 5, 7, 9]))
    assert value(spark, t.snap_to_word(words, cuts)) == [2, 2, 2, 5, 5, 5, 7, 7]


def test_line_breaks_and_blanks(spark):
    assert value(spark, t.flatten_lines(F.lit("a\nb"))) == "a b"
    assert value(spark, t.glue_lines(F.lit("a\nb"))) == "ab"
    assert value(spark, t.normalize_newlines(F.lit("a\r\nb\rc\n"))) == "a\nb\nc\n"
    assert value(spark, t.is_blank(F.lit("  　\n\x1c")))
    assert value(spark, t.rstrip(F.lit("a b  \n"))) == "a b"


def test_language_flags(spark):
    for lang in ["fr", "en", "de", "es", "it", "pt", "ru"]:
        assert value(spark, t.uses_spaces(F.lit(lang)))
    assert not value(spark, t.uses_spaces(F.lit("ja")))
    assert value(spark, t.uses_spaces(F.lit("ja"), forced=True))
    assert value(spark, t.is_chinese(F.lit("zh-TW")))
    assert not value(spark, t.is_chinese(F.lit("zh-TW"), ["zh-CN"]))


def test_names(spark):
    def name(path, target="cp874"):
        return value(spark, t.encoded_name(F.lit(path), F.lit(target)))

    assert name("/a/sample.srt", "utf-8-sig") == "sample-utf-8-sig.srt"
    assert name("/a/sample-UTF-8.srt") == "sample-cp874.srt"
    assert name("/a/x-cp874-utf-8.srt") == "x-cp874.srt"  # both, in catalog order
    assert name("/a/x-utf-8-cp874.srt") == "x-utf-8-cp874.srt"  # one pass only
    assert name("noext") == "noext-cp874"
    out = t.output_name(F.lit("d/my.film.srt"), F.lit("en"), F.lit("fr"), False)
    assert value(spark, out) == "my.film_en_fr_only.srt"


def test_format_time(spark):
    assert value(spark, t.format_time(F.lit(0))) == "00:00:00,000"
    assert value(spark, t.format_time(F.lit(362_345_006))) == "100:39:05,006"


def test_legal_content(spark):
    assert value(spark, t.legal_content(F.lit("\n\na\n\n\nb\n"))) == "a\nb"


def test_few_cuts_by_halving_agree_with_the_merge(spark):
    rng = random.Random(5)
    rows = []
    for row in range(300):
        bag = ["a", "", "，", "ab，", "日本", "xyz", "𝒳"] + [None] * (row % 7 == 0) + ["\x01"] * (row % 5 == 0)
        words = [rng.choice(bag) for _ in range(rng.choice([0, 1, 3, 12, 70]))]
        size = sum(len(w or "") for w in words)
        rows.append((words, sorted(rng.randint(0, size + 1) for _ in range(rng.choice([0, 1, 2, 5, 33])))))
    table = spark.createDataFrame(rows, "words array<string>, cuts array<int>")
    both = table.select(
        "words",
        "cuts",
        t.snap_to_word(F.col("words"), F.col("cuts")).alias("got"),
        t.merged_words(F.col("words"), F.col("cuts")).alias("wanted"),
    ).collect()
    assert any(0 < len(r.cuts) <= t.MANY_CUTS for r in both)
    for r in both:
        assert r.got == r.wanted, (r.words, r.cuts)
