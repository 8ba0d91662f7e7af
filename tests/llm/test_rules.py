"""Quality rules, line dedup, license scans and url rules against plain versions."""

import itertools
import math
import random
import re

from brute import dedup_lines, lower, marks_words, quality
from pyspark.sql import functions as F

from timedtext.llm import licenses, line_dedup, url_rules
from timedtext.llm import quality as rules
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
LONG = "\n".join(f"Line {i % 700} is a longer line of text, number {i % 900}." for i in range(9000))
TEXTS = [
    None, "", " ", "\n\n", "one", "A short line\nHome | About | Blog | Contact\n" + "Word of the text. " * 60,
    "Read more\nWe use cookies.\n" + " ".join(f"w{i}" for i in range(80)) + ".", "a b c a b c " * 30,
    "Same line.\nSame line.\n \nSame line.\r", "ü" * 60 + " |||| ## %", LONG, "tab\tand\x0bvt\x0cff\rcr " * 20,
    "a b c d a b c\x1f e", "x" * 100_000, " ".join(str(i) for i in range(60)) + "\n不是很短的一行文字。",
]


def test_quality(spark):
    rows = [(i, t, True, 0) for i, t in enumerate(TEXTS)] + [(None, "null id", False, 1), (3, "\n\n", True, 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality boolean, n_chars bigint")
    found = rules.judged(frame)
    assert found.columns == [*frame.columns, "quality_"]
    assert found.count() == len(rows)
    for row in found.collect():
        assert row["quality_"].asDict() == quality(row.text), row.doc_id
    clean = rules.clean_documents(frame)
    assert clean.columns == frame.columns
    want = [(i, quality(t)["clean"]) for i, t, *_ in rows if quality(t)["kept"]]
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert rules.judged(frame.limit(0)).collect() == []


def check_lines(frame, rows, long_words=None):
    want = dedup_lines(rows, long_words=long_words)
    found = line_dedup.dedup_lines(frame, long_words)
    got = found.collect()
    assert len(got) == len(rows)
    for row in got:
        n, gone, left = want[row.doc_id]
        info = row[found.columns[-1]]
        runs = sum(i - 1 not in gone for i in gone)
        assert (info.n_lines, info.n_removed, info.n_runs, row.text) == (n, len(gone), runs, left), row.doc_id


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(12)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(TEXTS)] + [(None, "line 1\nline 2\nline 3\n"), (500, LONG)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, gone int, line_dedup string")
    check_lines(frame.repartition(4), rows)
    again = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb\nc")] * 2, "doc_id bigint, text string"))
    assert [r.text for r in again.collect()] == ["a\nb\nc"] * 2
    assert line_dedup.dedup_lines(frame.limit(0)).collect() == []


def test_line_dedup_long_runs(spark):
    """Long runs of one or two lines go, short ones stay."""
    long, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25))
    texts = [f"{long}\nend", f"start\n{long}", long, f"{half}\n{half} b", f"x\n{half}\n\n{half} b\ny", f"{half}\nz", "end\nz"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, long_words=50).collect()}
    assert got == dict(enumerate([texts[0], "start", "", texts[3], "x\n\ny", texts[5], texts[6]]))
    assert [r.text for r in line_dedup.dedup_lines(frame).orderBy("doc_id").collect()] == texts


def test_line_dedup_documents(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    check_lines(docs, [tuple(r) for r in docs.collect()])
    check_lines(docs, [tuple(r) for r in docs.collect()], 50)


def test_line_dedup_random_long_runs(spark):
    rng = random.Random(8)
    lines = [" ".join(f"w{k}" for k in range(n)) for n in (1, 2, 24, 25, 26, 49, 50, 51)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(7)))) for i in range(120)]
    check_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows, 50)


def scan(text):
    """Base places and surviving labels by definition."""
    words = marks_words(text)
    joined = " " + " ".join(words) + " " if words else " "
    base = [
        (i, label)
        for phrase, label in licenses.BASE
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    hits = []
    for label, _, regex, priority in licenses.signatures():
        for m in re.finditer(regex, joined):
            start = joined[: m.start()].count(" ")
            hits.append((start, start + m[1].count(" "), priority, label))
    labels = {
        h[3]
        for i, h in enumerate(hits)
        if not any(
            g[2] <= h[2] and g[0] <= h[0] and h[1] <= g[1] and (g[:3] != h[:3] and (g[:2] != h[:2] or g[2] < h[2]))
            or (g[:3] == h[:3] and g[3] < h[3])
            for j, g in enumerate(hits)
            if i != j
        )
    }
    return words, base, labels


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "the GNU Lesser General Public License version 2.1 and mit license MIT LICENSE mit-license", "bsd is a license",
    "SPDX-License-Identifier: GPL-2.0 or later; see the Mozilla Public Licence", "The mit license. " * 3000,
    "distributed under the terms of the 3-clause BSD license; creative commons attribution share alike 4.0 license",
    "mit\u0000license", "apache éapache license", "general public license general public license", "licensee",
    "GPLv2 license, gpl version 3 licence, freebsd license, subject to the terms of the Eclipse Public License",
]


def test_licenses(spark):
    rows = list(enumerate(TEXTS + LICENSED)) + [(None, "mit license"), (1, "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, words int")
    frame.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/lic/documents.parquet")
    got = licenses.op5_license_scan(spark, path.rsplit("/", 1)[0]).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        words, base, labels = scan(text)
        at = [i for i, _ in base]
        own = {label for _, label in base}
        want.append(
            (doc_id, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)))
        )
    assert sorted((tuple(r[:-1]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_license_keywords_lose_nothing():
    for label, keyword, regex, _ in licenses.signatures():
        assert keyword == "" or keyword in re.sub(r"\(\?:gnu \)\?", "", regex), label


NOTICES = {
    "SPDX-License-Identifier: LGPL-2.1": "lgpl-2.1", "SPDX-License-Identifier: AGPL-3.0-only": "agpl-3.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
    "SPDX-License-Identifier: EPL-2.0": "epl-2.0", "SPDX-License-Identifier: OFL-1.1": "ofl", "under no license": "",
    "SPDX-License-Identifier: CDDL-1.0": "cddl-1.0", "licensed under the LGPL v2.1": "lgpl-2.1", "under the LGPL license": "lgpl",
    "licensed under the LGPL": "lgpl", "licensed under AGPLv3": "agpl-3.0", "SPDX-License-Identifier: 0BSD": "bsd-0-clause",
    "SPDX-License-Identifier: LGPL-2.0-only": "lgpl-2.0", "licensed under the LGPL version 3": "lgpl-3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Permission is hereby granted, free of charge": "mit", "Permission is hereby granted by the king.": "",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software": "boost",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived"
    " from this software": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided": "isc",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "it is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
    " published by the Free Software Foundation, either version 2.1 of the License": "lgpl-2.1",
}


def test_license_bodies_and_short_names(spark):
    rows = list(enumerate(NOTICES))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/notices/documents.parquet")
    got = {r.doc_id: r for r in licenses.op5_license_scan(spark, path.rsplit("/", 1)[0]).collect()}
    for i, text in rows:
        own = set(got[i].base_labels.split(","))
        assert set(got[i].labels.split(",")) - own == set(NOTICES[text].split(",")) - own, text
        assert scan(text)[2] | own - {""} == set(got[i].labels.split(",")) - {""}, text
    for label, keyword, regex, _ in licenses.signatures()[-len(licenses.BODIES) :]:
        assert any(g in keyword for g in licenses.GATES + licenses.BODY_GATES), label


def test_license_documents(spark):
    got = {r.doc_id: r for r in licenses.op5_license_scan(spark, SF_DIR).collect()}
    for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect():
        words, base, labels = scan(r.text)
        row = got[r.doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(base))
        assert row.labels == ",".join(sorted({x for _, x in base} | labels))


def fixed(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme/en/", "http://", "HTTP://Www.Example.ORG/en/1?x=http://b/", "a://example.org/en/2",
    "x://example.org", "x://example.org?/es/", "x://org/", "x://notorg/", "x://a.com/fr/1", "x://a.com/de/", "x://com/de/b",
    "x://COM/fr", "x://a.com/FR/", "x://example.org/es/q", "x://sub.example.org/es/", "x://a://b.org/",
]


def test_fixed_rules(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[4], "h", "r"), (0, None, "h", "r")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = url_rules.filter_urls(frame).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], *fixed(r[1])[:3]) for r in rows), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == want
    for r in got:
        verdict = next(v for h, p, v in url_rules.RULES if h + p == r.rule) if r.rule else r.verdict
        assert r.verdict == verdict and r.verdict in ("allow", "block")
    assert url_rules.filter_urls(frame.limit(0)).collect() == []
    bare = frame.filter("url IS NULL")
    assert {r.verdict for r in url_rules.filter_urls(bare).collect()} == {"allow"}


def test_learned_rules(spark):
    rng = random.Random(8)
    urls = []
    for i in range(120):
        word, section = rng.choice(["pills", "news", "bets"]), rng.choice(["a", "b"])
        bad = word != "news" and (word == "bets" or section == "b")
        urls.append(f"x://{word}.com/{'de' if bad else 'fr'}/{section}/{i}")
        urls.append(f"x://{word}.net/en/{section}/{i}")
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(frame, 0.05, 0.9).collect()}
    host, path = F.col("host"), F.col("path")
    parts = {
        r.page_id: (frozenset(r.t), r.v)
        for r in url_rules.parsed(frame)
        .select("page_id", url_rules.tokens(host, path).alias("t"), url_rules.fixed(host, path, "verdict").alias("v"))
        .collect()
    }
    labelled = [(t, v) for t, v in parts.values() if v]
    least = math.ceil(0.05 * len(labelled))
    counts = {}
    for t, v in labelled:
        for n in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), n):
                counts.setdefault(c, []).append(v)
    learned = []
    for c, vs in counts.items():
        for v in ("allow", "block"):
            if vs.count(v) >= least and vs.count(v) / len(vs) >= 0.9:
                learned.append((vs.count(v) / len(vs), vs.count(v), len(c), v, set(c)))
    for page, (t, v) in parts.items():
        if not v:
            fitting = [x[:4] for x in learned if x[4] <= t]
            assert got[page] == (max(fitting)[3] if fitting else "allow"), (page, urls[page])
    assert {"allow", "block"} <= {got[p] for p, (_, v) in parts.items() if not v}
