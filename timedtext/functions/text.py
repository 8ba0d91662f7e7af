"""String functions of cues and sentences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from timedtext.functions import fixed


def as_col(value: Column | str) -> Column:
    """A Column as it is, a string as the name of a column."""
    return F.col(value) if isinstance(value, str) else value


def flatten_lines(content: Column | str) -> Column:
    """Line breaks become spaces."""
    return F.replace(as_col(content), F.lit("\n"), F.lit(" "))


def glue_lines(content: Column | str) -> Column:
    """Line breaks vanish."""
    return F.replace(as_col(content), F.lit("\n"), F.lit(""))


def normalize_newlines(text: Column | str) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(as_col(text), r"\r\n?", "\n")


def is_blank(text: Column | str) -> Column:
    """True where there is nothing but white space.

    Nearly every text begins with a printable ASCII character, which needs no pattern."""
    first = F.ascii(as_col(text))
    return ~(((first > 32) & (first < 127)) | F.rlike(as_col(text), F.lit(fixed.NON_SPACE)))


def rstrip(text: Column | str) -> Column:
    """The text without its trailing white space (of any Unicode kind)."""
    return F.regexp_replace(as_col(text), fixed.SPACE + r"+\z", "")


def split_at_boundaries(text: Column, profile: str = "v1") -> Column:
    """Array of what lies between sentence boundaries.

    ``split`` compiles its pattern anew for every row, which is slow for many short texts;
    ``regexp_replace`` keeps it, and splitting at one plain character needs none. So the
    boundaries become a character that no text should have; a text that has it is split
    by the pattern.
    """
    marked = F.regexp_replace(text, fixed.BOUNDARY[profile], "\x01")
    return F.when(
        F.contains(text, F.lit("\x01")), F.split(text, fixed.BOUNDARY[profile], -1)
    ).otherwise(F.split(marked, "\x01", -1))


def split_sentences(text: Column | str, profile: str = "v1") -> Column:
    """Array of the sentences of one text; profile v0 keeps blank parts."""
    parts = let(as_col(text), lambda whole: split_at_boundaries(whole, profile))
    if profile == "v0":
        return parts
    return F.filter(parts, lambda s: ~is_blank(s))


def uses_spaces(lang: Column | str, forced: bool = False) -> Column:
    """True for target languages that separate words by spaces."""
    return F.lit(forced) | as_col(lang).isin(fixed.SPACED_LANGUAGES)


def is_chinese(
    lang: Column | str, languages: Sequence[str] = tuple(fixed.CHINESE_LANGUAGES)
) -> Column:
    return as_col(lang).isin(list(languages))


def compose_content(translated: Column, content: Column, both: bool = True) -> Column:
    """The translation, followed by the flattened original where both are wanted."""
    if not both:
        return translated
    return F.concat(translated, F.lit("\n"), flatten_lines(content))


# --- file names -------------------------------------------------------------


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]*)\z", 1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")


def suffix(path: Column | str) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]+)\z", 1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(as_col(path), r"/?[^/]*\z", "")


def output_name(
    path: Column | str, src_lang: Column, tgt_lang: Column, both: bool = True
) -> Column:
    """Name of a translated file."""
    tail = "_both.srt" if both else "_only.srt"
    return F.concat(stem(path), F.lit("_"), src_lang, F.lit("_"), tgt_lang, F.lit(tail))


def encoded_name(path: Column | str, target: Column) -> Column:
    """Name of a converted file: encoding suffixes of the catalog are taken off
    the stem in one pass over the catalog, then the target is put on."""
    catalog = F.array(*[F.lit("-" + name) for name in fixed.ENCODINGS])
    bare = F.aggregate(
        catalog,
        stem(path),
        lambda s, tail: F.when(
            F.endswith(F.lower(s), tail), F.substr(s, F.lit(1), F.length(s) - F.length(tail))
        ).otherwise(s),
    )
    return F.concat(bare, F.lit("-"), target, suffix(path))


# --- cutting a translated sentence ------------------------------------------

# Above this many cuts the work per cut must not depend on the length of the text.
MANY_CUTS = 32
WORD_MARK = "\x01"
FOLD_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All states of an associative fold, one per value.

    Values are folded in blocks, so that an array of n is copied some n * block times at
    most and not n * n times.
    """
    kind = F.slice(F.array(start), F.lit(1), F.lit(0))

    def fold(items: Column, first: Column) -> Column:
        zero = F.struct(first.alias("last"), kind.alias("done"))

        def add(acc: Column, item: Column) -> Column:
            return let(
                step(acc["last"], item),
                lambda now: F.struct(now.alias("last"), F.concat(acc["done"], F.array(now)).alias("done")),
            )

        return F.aggregate(items, zero, add, lambda acc: acc["done"])

    def by_blocks(items: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), whole_div(F.size(items) - 1, FOLD_BLOCK).cast("int")),
            lambda b: F.slice(items, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)),
        )
        totals = F.transform(blocks, lambda block: F.aggregate(block, start, step))
        return let(
            F.struct(blocks.alias("blocks"), fold(totals, start).alias("upto")),
            lambda s: F.flatten(
                F.transform(
                    s["blocks"],
                    lambda block, b: fold(
                        block, F.when(b == 0, start).otherwise(F.get(s["upto"], F.greatest(b - 1, F.lit(0))))
                    ),
                )
            ),
        )

    return let(values, lambda items: F.when(F.size(items) == 0, kind).otherwise(by_blocks(items)))


def characters(text: Column) -> Column:
    return F.split(text, "", -1)


def cut_text(chars: Column, begin: Column, end: Column) -> Column:
    """The characters from ``begin`` to ``end`` of a text given as an array."""
    return F.array_join(F.slice(chars, begin + 1, F.greatest(end - begin, F.lit(0))), "")


def spaces_around(text: Column, cuts: Column) -> Column:
    """For every cut of an ascending array: the last space up to it (0: none) and the first
    after it (0: none), as positions from 1. Each stretch between cuts is looked at once."""

    def of_chars(chars: Column) -> Column:
        def stretch(i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.get(cuts, F.greatest(i - 1, F.lit(0))))
            end = F.coalesce(F.get(cuts, i), F.size(chars))
            part = F.slice(chars, begin + 1, F.greatest(end - begin, F.lit(0)))

            def seek(piece: Column) -> Column:
                first = F.array_position(piece, " ").cast("int")
                back = F.array_position(F.reverse(piece), " ").cast("int")
                return F.struct(
                    F.when(first > 0, begin + first).otherwise(0).alias("first"),
                    F.when(back > 0, begin + F.size(piece) - back + 1).otherwise(0).alias("last"),
                )

            return let(part, seek)

        return let(F.transform(F.sequence(F.lit(0), F.size(cuts)), stretch), join)

    def join(parts: Column) -> Column:
        lasts = running(F.transform(parts, lambda p: p["last"]), F.lit(0), lambda a, b: F.greatest(a, b))
        nearest = F.transform(F.reverse(parts), lambda p: p["first"])
        firsts = F.reverse(
            running(nearest, F.lit(0), lambda a, b: F.when(b == 0, a).otherwise(b))
        )
        return let(
            F.struct(lasts.alias("lasts"), firsts.alias("firsts")),
            lambda s: F.transform(
                cuts,
                lambda _, i: F.struct(
                    F.get(s["lasts"], i).alias("last"), F.get(s["firsts"], i + 1).alias("first")
                ),
            ),
        )

    return let(characters(text), of_chars)


def snap_to_space(text: Column, cuts: Column, profile: str = "v1") -> Column:
    """Every cut of an array becomes the position after the nearest space; the left one
    wins a tie."""
    few = F.transform(
        cuts,
        lambda cut: F.struct(
            cut.alias("cut"),
            # distance back to the space on the left, and ahead to behind the right one
            F.instr(F.reverse(F.substr(text, F.lit(1), cut)), F.lit(" ")).alias("back"),
            F.instr(F.substr(text, cut + 1), F.lit(" ")).alias("ahead"),
        ),
    )
    many = F.zip_with(
        cuts,
        spaces_around(text, cuts),
        lambda cut, at: F.struct(
            cut.alias("cut"),
            F.when(at["last"] > 0, cut - at["last"] + 1).otherwise(0).alias("back"),
            F.when(at["first"] > 0, at["first"] - cut).otherwise(0).alias("ahead"),
        ),
    )
    near = F.when(F.size(cuts) > MANY_CUTS, many).otherwise(few)

    def choose(at: Column) -> Column:
        cut, back, ahead = at["cut"], at["back"], at["ahead"]
        if profile == "v0":
            to_left = F.when(back > 0, back).otherwise(cut + 1)
            left = F.when(back > 0, cut - back + 1).otherwise(F.lit(0))
            return F.when(to_left > ahead - 1, cut + ahead).otherwise(left)
        return (
            F.when((back == 0) & (ahead == 0), cut)
            .when((back == 0) | ((ahead > 0) & (back > ahead - 1)), cut + ahead)
            .otherwise(cut - back + 1)
        )

    return F.transform(near, choose)


def word_behind(words: Column, marked: Column, cut: Column) -> Column:
    """The end of the first word that reaches a cut, found by halving; ``marked`` is the words
    with ``WORD_MARK`` between them, so the first words of any number are a prefix of it."""

    def upto(n: Column) -> Column:
        return F.length(F.call_function("substring_index", marked, F.lit(WORD_MARK), n)) - n + 1

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        reached = upto(middle + 1) >= cut
        half = F.when(
            reached, F.struct(acc["low"].alias("low"), middle.alias("high"))
        ).otherwise(F.struct((middle + 1).alias("low"), acc["high"].alias("high")))
        return F.when(acc["low"] < acc["high"], half).otherwise(acc)

    def end(acc: Column) -> Column:
        comma = F.coalesce(F.get(words, acc["low"] + 1) == F.lit(fixed.CHINESE_COMMA), F.lit(False))
        return upto(F.least(acc["low"] + 1, F.size(words))) + F.when(comma, 1).otherwise(0)

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(words).cast("bigint"))))
    start = F.struct(F.lit(0).alias("low"), F.size(words).alias("high"))
    return F.aggregate(halvings, start, halve, end)


def snap_to_word(words: Column, cuts: Column) -> Column:
    """Every cut of an ascending array becomes the end of the first given word that
    reaches it, and of a full-width comma right after that word; cuts that no word
    reaches become the end of all words.

    Up to ``MANY_CUTS`` cuts are looked up one by one. For more, and for words that are null
    or have the mark, word ends and cuts are merged. ``words`` and ``cuts`` should be plain columns.
    """
    whole = F.array_join(words, "")
    plain = (whole == F.array_join(words, "", WORD_MARK)) & ~F.contains(whole, F.lit(WORD_MARK))
    few = let(
        F.array_join(words, WORD_MARK),
        lambda marked: F.transform(cuts, lambda cut: word_behind(words, marked, cut)),
    )
    simple = (F.size(cuts) <= MANY_CUTS) & (F.size(words) > 0) & plain
    return (
        F.when(F.size(cuts) == 0, cuts).when(simple, few).otherwise(merged_words(words, cuts))
    )


def merged_words(words: Column, cuts: Column) -> Column:
    """``snap_to_word`` for any number of cuts, by one sort of all word ends and cuts."""
    sizes = F.transform(words, lambda w: F.length(w))
    ends = running(sizes, F.lit(0), lambda a, b: a + b)

    def merge(ends: Column) -> Column:
        values = F.transform(
            ends,
            lambda end, i: end
            + F.when(F.coalesce(F.get(words, i + 1) == F.lit(fixed.CHINESE_COMMA), F.lit(False)), 1).otherwise(0),
        )
        # a cut comes before the end at the same place: that word reaches it
        marks = F.concat(
            F.transform(cuts, lambda c, i: F.struct(c.alias("at"), F.lit(0).alias("kind"), i.alias("value"))),
            F.zip_with(
                ends, values, lambda e, v: F.struct(e.alias("at"), F.lit(1).alias("kind"), v.alias("value"))
            ),
        )

        def look_ahead(marks: Column) -> Column:
            """From the end: the value of the nearest word end behind each mark."""
            back = F.reverse(marks)
            upto = running(
                F.transform(back, lambda m: F.when(m["kind"] == 1, m["value"]).otherwise(-1)),
                F.lit(-1),
                lambda a, b: F.when(b < 0, a).otherwise(b),
            )
            found = F.filter(
                F.zip_with(
                    back, upto, lambda m, v: F.when(m["kind"] == 0, F.struct(m["value"].alias("i"), v.alias("v")))
                ),
                lambda x: x.isNotNull(),
            )
            total = F.coalesce(F.array_max(ends), F.lit(0))
            return F.transform(
                F.sort_array(found), lambda x: F.when(x["v"] < 0, total).otherwise(x["v"])
            )

        return let(F.sort_array(marks), look_ahead)

    return let(ends, merge)


# --- subtitle time codes ----------------------------------------------------


def whole_div(value: Column, by: Column | int) -> Column:
    """Integer division of BIGINT columns."""
    return F.call_function("div", value, F.lit(by))


def format_time(ms: Column | str) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    t = as_col(ms).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        whole_div(t, 3600000),
        whole_div(t, 60000) % 60,
        whole_div(t, 1000) % 60,
        t % 1000,
    )


def legal_content(content: Column | str) -> Column:
    """Content without blank lines, which would end the cue."""
    outer = F.regexp_replace(as_col(content), r"\A\n+|\n+\z", "")
    return F.regexp_replace(outer, r"\n\n+", "\n")
