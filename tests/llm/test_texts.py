"""Decontamination, packing, language identification, chat formatting and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from timedtext.llm import chat, decontaminate, language, packing
from timedtext.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def check_leaks(found, rows, items):
    got = found.collect()
    assert len(got) == len(rows)
    text_of = dict(rows)
    for row in got:
        n, hit, named = brute.leaks(text_of[row.doc_id], items)
        leak = row[found.columns[-1]]
        digest = hashlib.sha256(",".join(named).encode()).hexdigest()
        assert tuple(leak)[:5] == (n, len(hit), len(named), digest, bool(hit)), row.doc_id
        cut = [brute.marks_words((text_of[row.doc_id] or "")[s.start : s.end]) for s in leak.hits]
        assert sum(map(len, cut)) == len(hit)


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    words = [f"w{i}" for i in range(30)]
    items = [
        (1, " ".join(words[:14])), (1, " ".join(words[:14])), (2, "What is-it? É"), (3, None), (4, "..."), (5, "Yes"),
        (None, "none of these"), (10, " ".join(words[4:18])), (9, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"),
    ]
    rng = random.Random(2)
    texts = [None, "", "...", "what is it É!", "WHAT is it é", "yesterday, YES", "None of\nthese", "w1 " * 40_000]
    texts += [" ".join(words[a : a + rng.randrange(6, 20)]).upper() for a in range(12)]
    texts += [", ".join(rng.choices(words[:3], k=60)) for _ in range(5)]
    rows = list(enumerate(texts)) + [(None, texts[8])]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, leaks string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    check_leaks(decontaminate.find_leaks(docs, bench), rows, items)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not brute.leaks(t, items)[1] for _, t in rows)
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontaminate_documents(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    bench = table(spark, SF_DIR, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    check_leaks(decontaminate.find_leaks(docs, bench), [tuple(r) for r in docs.collect()], items)


def check_pack(pieces, rows):
    """Every id in one piece, sequences gapless and full or a power of two."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for doc_id, all_ids in want.items():
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, all_ids))
        if len(all_ids) > 1:
            continue
        ids, at = all_ids[0], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0


def test_pack_small(spark):
    texts = [
        None, "", " \n", "Hello, World!", "HELLO world's don't %%' x<|endoftext|>y <|ENDOFTEXT|>", "a|b <| c", "naïve İ J̌ Σς",
        "word " * 20_000, "x" * 5000, "12 3,4... (5)", "tab\tand\r\nline\x1c\x1d\u00a0\u2003end", "é" * 9000, "'s 'S it''s %'s",
        "www.example.com/a?b=c;d, e.", "한국어 中文 текст, ελληνικά.",
    ]
    rows = list(enumerate(texts)) + [(3, "repeated id"), (None, "no id"), (2**60, "large id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, shard int")
    check_pack(packing.pack(docs).collect(), rows)
    assert packing.pack(docs.limit(0)).collect() == []


def test_pack_documents(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, shard_tokens=60_000).collect()
    assert len({p.shard for p in pieces}) > 1
    check_pack(pieces, [tuple(r) for r in docs.collect()])


def test_neighbours_share_tokens():
    tails = [np.array(t, "<u4") for t in ([1, 2, 3], [7, 8, 9], [1, 2, 9], [7, 8, 8], [5])]
    frequency = np.array([0, 2, 2, 1, 0, 1, 0, 2, 2, 2])
    shard = packing.Shard(tails, frequency, 5, 2.6)
    unused = np.ones(5, bool)
    unused[0] = False
    assert list(shard.neighbours(0, unused)) == [2]
    unused[1] = False
    assert list(shard.neighbours(1, unused)) == [3, 2]


def test_neighbours_meet_in_one_shard(spark):
    """Near copies are packed together when the table has many shards."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = Tokenizer.from_file(packing.vocabulary_path()).get_vocab()
    names = sorted(w for w in (v.removesuffix("</w>") for v in vocabulary) if w.isascii() and w.isalpha() and len(w) > 4)
    rows = []
    for topic in range(60):
        words = rng.choices(names, k=200)
        rows += [(10 * topic + i, " ".join([*words[: 150 + 10 * i], *rng.choices(names, k=4)])) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pieces = packing.pack(docs, shard_tokens=2_000).collect()
    check_pack(pieces, rows)
    assert len({p.shard for p in pieces}) >= 8
    of = defaultdict(set)
    for p in pieces:
        of[p.doc_id // 10].add((p.doc_id, p.shard))
    met = sum(len({s for _, s in found}) == 1 for found in of.values())
    assert met >= 40, met


def test_large_groups_are_parted():
    """Tails with one key fill several shards of equal size."""
    sample = [(b"k" * 32 + bytes([i]), 10) for i in range(100)] + [(b"a" * 40, 10)]
    cuts = packing.cuts_of(sample, 4)
    held = np.bincount([packing.bisect.bisect_right(cuts, k) for k, _ in sample], minlength=4)
    assert len(cuts) == 3 and held.min() >= 20
    assert packing.cuts_of([], 4) == []


def test_language_held_out(spark):
    found = language.op9_language_id(spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.accepted for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = [(i, f"the words of text {i} and more", "en") for i in range(60)]
    rows += [(100 + i, f"die wörter im text {i} und mehr", "de") for i in range(60)]
    texts = [None, "", "123 %%", "É", "und die wörter", "the and of " * 40_000]
    rows += [(300 + i, t, None) for i, t in enumerate(texts)] + [(None, "and the words", "en"), (1, "the words", "en")]
    docs = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id bigint, text string, lang string, held_out boolean, known int")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, F.lit(None).cast("boolean"), model).collect()}
    assert [got[300 + i].lang_pred for i in (0, 1, 2, 4, 5)] == ["und", "und", "und", "de", "en"]
    assert got[303].lang_pred in ("de", "en") and got[300].score == 0 and not got[300].accepted
    assert not got[300].held_out
    nothing = language.identify(docs, F.lit(True), language.fit(docs.limit(0))).collect()
    assert len(nothing) == len(rows) and {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True), model).collect() == []


def test_prediction_is_alone():
    """A text's buckets do not depend on the texts beside it."""
    texts = ["one two", "", "drei", "x" * 50]
    alone = [[g[s[0] : e[0]].tolist() for g in grams] for grams, s, e in (language.buckets_of([t]) for t in texts)]
    grams, start, end = language.buckets_of(texts)
    assert [[g[a:b].tolist() for g in grams] for a, b in zip(start, end, strict=True)] == alone


def best_path(nodes):
    """The path with the largest sum of scores by listing all leaves."""
    parent = {n: p for n, p, _ in nodes}
    score = {n: s for n, _, s in nodes}
    leaves = set(parent) - set(parent.values())
    best = None
    for leaf in leaves:
        path, at = [], leaf
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at in path:
            continue
        rank = (sum(score[n] for n in path), -leaf)
        best = max(best or (rank, path), (rank, path))
    return best[1][::-1] if best else []


def test_best_paths(spark):
    rng = random.Random(4)
    trees, rows = {}, []
    for tree in range(25):
        nodes = [(n, rng.choice([*range(n), None]) if n and tree % 3 else n - 1, rng.randrange(9)) for n in range(rng.randrange(1, 30))]
        trees[tree] = nodes
        rows += [(tree, *n) for n in nodes]
    trees[None] = [(5, 99, 1), (6, 5, 1), (7, 5, 1)]
    trees[77] = [(1, 2, 5), (2, 1, 5), (3, None, 0)]
    rows += [(t, *n) for t in (None, 77) for n in trees[t]]
    frame = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, score bigint")
    got = defaultdict(dict)
    for r in chat.best_paths(frame).collect():
        got[r.tree][r.depth] = r.node
    for tree, nodes in trees.items():
        assert [got[tree][d] for d in sorted(got[tree])] == best_path(nodes), tree
        assert sorted(got[tree]) == list(range(len(got[tree])))


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["###", "#", "</turn>", "</turn>\n", "<", "\\", "\\s", "\\h", "\\e", "\\c", "user: ", ":", " ", "\n", "é", "a", "### assistant: "]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", "odd: role ###", None, ""])
            rows.append((conv, turn, role, "".join(rng.choices(bits, k=rng.randrange(8))) or None))
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, None, "user", "first"), (None, 0, "assistant", "no id")]
    rows += [(51, i, "assistant", str(i)) for i in range(300)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, parts int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert list(got[conv].masked) == [t for r, t in turns if r == "assistant"]
    assert chat.format_conversations(frame.limit(0)).collect() == []


def test_pipeline(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    want = [(i, brute.quality(t)) for i, t in rows]
    want = [(i, q["clean"]) for i, q in want if q["kept"]]
    steps = [want]
    lines = brute.dedup_lines(want, long_words=50)
    steps.append([(i, lines[i][2]) for i, _ in want])
    kept = {i for i, _, _, k in brute.near(steps[-1]) if k}
    steps.append([r for r in steps[-1] if r[0] in kept])
    steps.append([r for r in steps[-1] if not brute.leaks(r[1], items)[1]])
    for (_name, stage), rows in zip(corpus_pipeline.STAGES, steps, strict=False):
        docs = corpus_pipeline.stage_table(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    check_pack(corpus_pipeline.run(spark, SF_DIR).collect(), steps[-1])
