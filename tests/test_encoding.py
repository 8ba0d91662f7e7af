import random

import pytest
from pyspark.sql import functions as F

from timedtext.functions import codecs, fixed
from timedtext.operators import encoding

MIXED = "1\n00:00:01,000 --> 00:00:04,000\nสวัสดี Café 你好\n\n2\n00:00:05,000 --> 00:00:08,000\nこんにちは 안녕 naïve señor\n" * 2


def files(spark, contents):
    rows = [(name, bytearray(data)) for name, data in contents.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def plain_detect(data, names, least):
    for name in names:
        try:
            text = data.decode(name).replace("\r\n", "\n")
        except UnicodeDecodeError:
            continue
        if len(text) > least:
            return name
    return None


def test_detect(spark):
    thai = "ภาษาไทย" * 30
    data = {
        "mixed": MIXED.encode(),
        "bom": b"\xef\xbb\xbf" + MIXED.encode(),
        "thai": thai.encode("tis-620"),
        "german": ("für Öl und Ähren " * 10).encode("latin-1"),
        "japanese": ("こんにちは世界" * 30).encode("shift_jis"),
        "russian": ("привет мир " * 20).encode("cp1251"),
        "short": b"abc",
        "short wide": "é".encode() * 60,
        "crlf": ("ab\r\n" * 34).encode(),
        "crlf few": ("ab\r\n" * 33).encode(),
        "empty": b"",
    }
    rows = encoding.detect_encoding(files(spark, data), **encoding.COMPAT).collect()
    expected = {k: plain_detect(v, fixed.ENCODINGS, 100) for k, v in data.items()}
    assert {r.path: r.encoding for r in rows} == expected
    assert expected["mixed"] == expected["bom"] == "utf-8" and expected["short"] is None
    marked = encoding.detect_encoding(files(spark, data), bom_first=True, min_chars=0).collect()
    marked = {r.path: r.encoding for r in marked}
    assert marked["bom"] == "utf-8-sig" and marked["short wide"] == "utf-8" and marked["empty"] is None
    lossless = {r.path: r.encoding for r in encoding.detect_encoding(files(spark, data)).collect()}
    assert lossless["bom"] == "utf-8-sig" and lossless["short"] == lossless["empty"] == "utf-8"
    assert all(lossless.values())


def test_detect_with_given_candidates(spark):
    data = files(spark, {"x": ("привет мир " * 20).encode("cp1251")})
    assert encoding.detect_encoding(data, ["euc-jp", "cp1251"]).first().encoding == "cp1251"
    with pytest.raises(ValueError):
        encoding.detect_encoding(data, ["no-such-codec"])


@pytest.mark.parametrize("target", [*fixed.ENCODINGS, "ascii", "utf-16"])
def test_transcode_to_every_encoding(spark, target):
    """Bytes equal the codec's with replacement; line ends are LF."""
    text = MIXED + "\r\nend\rÄß€"
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    row = encoding.transcode(files(spark, {"x": text.encode()}), target, "UTF-8").first()
    assert row.success and bytes(row.content) == plain.encode(target, errors="replace")


def test_round_trip_of_what_a_codec_can_say(spark):
    samples = {"cp1251": "привет", "euc-kr": "안녕", "gb2312": "你好", "tis-620": "สวัสดี", "cp1252": "Café €"}
    for codec, text in samples.items():
        row = encoding.transcode(files(spark, {"x": text.encode(codec)}), "utf-8", codec).first()
        assert bytes(row.content).decode() == text


def test_failures_are_rows(spark):
    table = files(spark, {"bad": b"\xff\xfe\x00\x00", "good": MIXED.encode()})
    rows = {r.path: r for r in encoding.transcode(table, "utf-8", "utf-8").collect()}
    assert not rows["bad"].success and rows["bad"].content is None and rows["good"].success
    assert not encoding.transcode(table, "no-such-codec", "utf-8").where("success").collect()
    short = files(spark, {"s": b"abc"})
    assert not encoding.transcode(short, "utf-8", **encoding.COMPAT).first().success
    assert bytes(encoding.transcode(short, "utf-16-le").first().content) == "abc".encode("utf-16-le")


def test_bom_is_put_also_before_a_bom(spark):
    table = files(spark, {"x": b"\xef\xbb\xbf" + MIXED.encode()})
    row = encoding.transcode(table, "utf-8-sig", **encoding.COMPAT).first()
    assert row.source == "utf-8" and bytes(row.content).startswith(b"\xef\xbb\xbf" * 2)


def test_source_per_row(spark):
    table = files(spark, {"cp1251": "мир".encode("cp1251"), "utf-8": "мир".encode()})
    rows = encoding.transcode(table, F.lit("utf-8"), F.col("path")).collect()
    assert all(bytes(r.content).decode() == "мир" for r in rows)


def test_fanout(spark):
    table = files(spark, {"/in/sample.srt": MIXED.encode()})
    rows = encoding.transcode_fanout(table, ["utf-8", "utf-8-sig", "cp1252", "nope"], "/out").collect()
    rows = {r.target: r for r in rows}
    assert rows["utf-8-sig"].output_path == "/out/sample-utf-8-sig.srt" and rows["utf-8-sig"].success
    assert rows["utf-8"].skipped and rows["utf-8"].success and rows["utf-8"].content is None
    assert bytes(rows["cp1252"].content) == MIXED.encode("cp1252", errors="replace")
    assert not rows["nope"].success
    default = encoding.transcode_fanout(table)
    assert [r.target for r in default.collect()] == fixed.FANOUT_TARGETS
    assert default.first().output_path == "/in/sample-utf-8.srt"
    written = encoding.transcode_fanout(table, ["utf-8"], skip_same=False).first()
    assert not written.skipped and bytes(written.content) == MIXED.encode()


def test_recommended(spark):
    langs = spark.createDataFrame([("th",), ("zh-CN",), ("ja-JP",), ("xx",), ("zh",)], "lang string")
    rows = encoding.recommended_encodings(langs).orderBy("lang", "rank").collect()
    found = {}
    for r in rows:
        found.setdefault(r.lang, []).append(r.encoding)
    assert found["th"][1:3] == ["tis-620", "cp874"] and "gb2312" in found["zh-CN"]
    assert found["ja-JP"] == fixed.RECOMMENDED["ja"]
    assert found["xx"] == found["zh"] == fixed.RECOMMENDED_DEFAULT
    for lang, names in found.items():
        assert encoding.target_encodings(["cp874"], lang) == names


def test_precedence_of_targets():
    assert encoding.target_encodings() == ["utf-8", "utf-8-sig", "tis-620", "cp874"]
    assert encoding.target_encodings([" cp874 ", "big5"]) == ["cp874", "big5"]
    assert encoding.target_encodings(["big5"], "th", True) == fixed.ENCODINGS


def whole_length(data, name):
    try:
        text = data.decode(name)
    except UnicodeError:
        return None
    return len(text) - text.count("\r\n")


@pytest.mark.parametrize("name", [*fixed.ENCODINGS, "cp037", "hz", "utf-7", "utf-32", "big5hkscs"])
def test_decoded_length(monkeypatch, name):
    """Chunks and byte tables against decoding the whole."""
    rng = random.Random(name)
    texts = ["", "a", "\r\n", "\r", "x\r\ny\r\r\n\n", "Å äöü ß\r\n", "สวัสดี\r\n", "日本語\r\nテキスト", "Привет\r\n", "한국어\r\n", "\ufeffx"]
    cases = [t.encode(name, "replace") for t in texts]
    cases += [b"".join(rng.choices(cases, k=6)) for _ in range(30)]
    cases += [rng.randbytes(rng.randrange(1, 30)) for _ in range(60)]
    cases += [c[:-1] for c in cases]
    for size in (1, 3, 1 << 16):
        monkeypatch.setattr(codecs, "CHUNK_BYTES", size)
        for data in cases:
            assert codecs.decoded_length(data, name) == whole_length(data, name), data


def test_tables_are_known():
    assert codecs.table_bytes("cp1252") is not None and codecs.table_bytes("tis-620") is not None
    assert codecs.table_bytes("shift_jis") is None and codecs.table_bytes("utf-8") is None
