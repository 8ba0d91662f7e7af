"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import duckdb
import pytest
from brute import lower

from timedtext.llm import collocations
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, least, longest=5, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    phrase = tuple(words[i : i + size])
                    counts[lang, phrase] = counts.get((lang, phrase), 0) + 1
    out = []
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    covered = {}
    for (lang, phrase), f in frequent.items():
        for s in range(len(phrase)):
            for e in range(s + 2, len(phrase) + 1):
                if e - s < len(phrase):
                    key = lang, phrase[s:e]
                    covered[key] = max(covered.get(key, 0), f)
    for (lang, phrase), a in frequent.items():
        if 100 * covered.get((lang, phrase), 0) >= 100 * a:
            continue
        n = totals[lang]
        cuts = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, " ".join(phrase), a, left, right, n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def invented(seed, n=150):
    """Texts of few words, so that phrases of all lengths repeat."""
    rng = random.Random(seed)
    words = ["Aa", "b", "c", "É", "é", "dd", "\x00e", "日本", "f-g"]
    fixed = ["one two three four five six", "aa b c", "日本 é"]
    seps = [" ", " ", " ", " ", "\t ", ". ", ",", "\n", ";", "!"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words + fixed) + rng.choice(seps) for _ in range(rng.randrange(40)))
        out.append((rng.choice(["en", "de", None, "und"]), text))
    return [*out, ("en", None), (None, ""), ("en", " ,. \n"), ("fr", "alone"), ("en", "aa " * 3000)]


@pytest.mark.parametrize("held", [collocations.HELD, 0])
def test_invented(spark, held, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    rows = invented(7)
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, text string, row bigint, key string")
    found = sorted(tuple(r) for r in collocations.collocations(frame, least=5, top=40, held=held).collect())
    assert found == brute(rows, 5, top=40)


def test_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=20).collect()) == brute(rows, 20)


def test_empty(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    nothing = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert collocations.collocations(nothing).collect() == []


def test_large_numbers(spark):
    big = 10**13
    frame = spark.createDataFrame([(big // 10, big, 7 * 10**11, 10**12 + 1)], "a bigint, n bigint, l bigint, r bigint")
    from pyspark.sql import functions as F

    row = frame.select(collocations.exact_score(*map(F.col, "anlr"))).first()
    assert row[0] == 1000 * (big // 10) * big // (7 * 10**11 * (10**12 + 1))


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    sql = collocations.ORACLE.replace("HAVING count(*) >= 100", "HAVING count(*) >= 10")
    expected = sorted(con.execute(sql).fetchall())
    found = collocations.collocations(table(spark, SF_DIR, "documents"), least=10)
    assert found.columns == [d[0] for d in con.execute(sql).description]
    assert sorted(tuple(r) for r in found.collect()) == expected
