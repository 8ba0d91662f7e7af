"""Lexical retrieval packing: documents that share rare tokens fill a window together.

1. Texts become token ids, once, staged as Parquet. A document's full windows are cut off at once
   and travel on without their ids; what is left, under one window, is its *tail*.
2. Document frequencies of tokens, the number of documents and their mean length come from all
   documents. The frequencies are one number per vocabulary entry (49,408 here), which bounds
   what is collected and broadcast.
3. Tails are ordered by their document's rarest tokens that another document has too, rarest
   first, and this order is cut into shards of some ``SHARD_TOKENS`` tokens. Documents that share
   them meet in one shard at any size of the table; a group that is larger than a shard is parted
   by its next rarest tokens, and equal ones by a hash of the row. The cuts come from a sample of
   some ``CUT_SAMPLE`` tails a shard, which bounds what is collected and broadcast. The README has
   figures of the neighbours that still fall into other shards.
   A shard is an inverted index with BM25 weights, in one task. A seed document's heaviest tokens
   are the query; its unused neighbours follow by score until the window is full, and the last one
   is cut where the window ends; the cut-off rest seeds the next window.
4. What a shard has left at its end is cut into powers of two, so no sequence is padded.

A document of any length costs a shard one short row per window; the shard's memory is bounded
by its tokens.

Defined results: a null text is empty and has the end token alone. Rows may repeat a ``doc_id``
or have none; each row is packed on its own. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import codecs
import heapq
import math
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import table
from timedtext.session import stage_table

WINDOW = 4096
END = 2
END_BYTES = struct.pack("<I", END)
SHARD_TOKENS = 2_000_000
KEY_TOKENS = 8
CUT_SAMPLE = 100
QUERY_TOKENS = 16
K1, BETA = 1.2, 0.75
KNOWN_WORDS = 300_000
SLICE_CHARS = 8_000_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100: none of these is changed by normal forms, and the
    lower case of each is one character, so that a whole text is put in lower case at once."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Words(dict):
    """Token ids of chunks between spaces, as bytes; white space parts tokens in this vocabulary.

    Trailing ASCII marks are looked up apart from the word and ASCII letters in lower case, since
    the vocabulary parts marks from letters and has no upper case: fewer distinct chunks. A text
    with the start of a special token takes the plain way. A chunk of Latin letters alone is one
    word for the vocabulary's rules, and its normal form is its lower case, so the library's
    merges are called on it without its Unicode and splitting steps, which take most of its time.
    Of several texts each distinct chunk is looked up once, and its new words are learnt together.
    """

    MARKS = ".,;:!?*%&$#|"
    # Precomposed letters up to U+017F, without the one whose lower case is two characters.
    LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
    LETTERS = re.compile(f"[{LATIN}]+")
    TAIL = re.compile(rf"(?<=[0-9{LATIN}])[{MARKS}]+\Z")
    ENDS_WORD = f"[0-9{LATIN}]$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = filter(self.LETTERS.fullmatch, map(chr, range(0x80, 0x180)))
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in letters}
        byte_of = {b: c for letter, two in self.spelling.items() for b, c in zip(chr(letter).encode(), two, strict=True)}
        self.byte_spelling = "".join(byte_of.get(b, chr(b)) for b in range(256))
        self.older: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def word(self, letters: str) -> bytes:
        """Ids of lower-case letters, non-ASCII ones as the vocabulary spells them."""
        return array("I", [t.id for t in self.merges(letters)]).tobytes()

    def found(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            return self.word(chunk) if low == chunk else self[low]
        if self.LETTERS.fullmatch(chunk):
            return self.word(chunk.lower().translate(self.spelling))
        marks = None if chunk[-1:].isalnum() else self.TAIL.search(chunk)
        if marks:
            return self[chunk[: marks.start()]] + self[marks[0]]
        if chunk.isascii() and (low := chunk.lower()) != chunk:
            return self[low]
        return self.plain(chunk)

    def __missing__(self, chunk: str) -> bytes:
        """Words that are met again stay known: the older half is dropped when the newer is full,
        and what is used of it moves over."""
        ids = self.older.pop(chunk, None)
        if ids is None:
            ids = self.found(chunk)
        if len(chunk) < 64:
            self.keep(chunk, ids)
        return ids

    def keep(self, chunk: str, ids: bytes) -> None:
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids

    def learn(self, chunks: list[str]) -> None:
        """Keeps the ids of those of the chunks that are lower-case words of Latin letters."""
        latin = self.LETTERS.fullmatch
        new = [
            c for c in chunks if c not in self and c not in self.older and c.islower() and latin(c) and len(c) < 64
        ]
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            spelled = codecs.charmap_decode("\n".join(part).encode(), "strict", self.byte_spelling)[0]
            tokens = list(map(self.merges, spelled.split("\n")))
            ids = array("I", [t.id for word in tokens for t in word]).tobytes()
            ends = [4 * n for n in accumulate(map(len, tokens), initial=0)]
            for chunk, a, b in zip(part, ends, ends[1:], strict=False):
                self.keep(chunk, ids[a:b])

    def all_ids(self, chunks: pa.Array) -> pa.LargeListArray:
        """Ids of distinct chunks, looked up as words and the marks behind them."""
        bare = pc.utf8_rtrim(chunks, self.MARKS)
        bare = pc.if_else(pc.match_substring_regex(bare, self.ENDS_WORD), bare, chunks)
        marked = pc.not_equal(bare, chunks)
        cuts = pc.utf8_length(bare.filter(marked)).to_pylist()
        marks = pa.array([c[n:] for c, n in zip(strings(chunks.filter(marked)), cuts, strict=True)], pa.string())
        words, marks = bare.dictionary_encode(), marks.dictionary_encode()
        n, listed = len(words.dictionary), strings(words.dictionary)
        self.learn(listed)
        known = [*map(self.__getitem__, listed), *map(self.__getitem__, strings(marks.dictionary)), b""]
        ends = np.cumsum([0, *map(len, known)]) // 4
        table = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(known), "<u4"))
        at = np.full((len(chunks), 2), len(table) - 1)
        at[:, 0] = words.indices
        at[marked.to_numpy(zero_copy_only=False), 1] = marks.indices.to_numpy() + n
        pieces = table.take(pa.array(at.ravel()))
        return pa.LargeListArray.from_arrays(pieces.offsets.to_numpy()[::2], pieces.values)

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids and end token of each text."""
        marked = {i: t for i, t in enumerate(texts) if "<|" in t}
        spaced = [
            "" if i in marked else (t.lower() if is_latin(t) else t).replace("\n", " ") for i, t in enumerate(texts)
        ]
        chunks = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        found = chunks.flatten().dictionary_encode()
        lists = self.all_ids(found.dictionary).take(found.indices)
        ends = lists.offsets.to_numpy()[chunks.offsets.to_numpy()[1:]]
        ids = np.insert(lists.values.to_numpy(), ends, END)
        out = np.split(ids, (ends + np.arange(1, len(texts) + 1))[:-1])
        for i, t in marked.items():
            out[i] = np.frombuffer(self.plain(t) + END_BYTES, "<u4")
        return out

    def forget(self) -> None:
        self.clear()
        self.older = {}


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with counts, without its overhead, which is most of its time for one document."""
    ids = np.sort(ids)
    first = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=first[1:-1])
    at = np.flatnonzero(first)
    return ids[at[:-1]], np.diff(at)


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """The vocabulary is read once for all tasks of a Python worker."""
    return Words(path)


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, terms binary"
)
PIECE_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("ids", pa.binary()),
    ("terms", pa.binary()),
]


def tokenized(path: str) -> Callable:
    """Full windows without ids; the last row of every document has its tail (maybe empty) as
    ids and its distinct tokens as terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        try:
            for doc_ids, texts in slices(batches):
                rows: list[tuple] = []
                size = 0
                for doc_id, ids in zip(doc_ids, words.ids_of(texts), strict=True):
                    n = len(ids)
                    for start in range(0, n - WINDOW + 1, WINDOW):
                        crc = zlib.crc32(ids[start : start + WINDOW].tobytes())
                        rows.append((doc_id, start, WINDOW, crc, n, None, None))
                    tail = ids[n - n % WINDOW :]
                    terms = counted(ids)[0].tobytes()
                    rows.append((doc_id, n - n % WINDOW, len(tail), 0, n, tail.tobytes(), terms))
                    size += len(tail) * 4 + len(terms)
                    if size > 8 << 20:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)
        finally:
            # the worker lives on, beside tasks of other steps
            words.forget()
            pa.default_memory_pool().release_unused()

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Document ids and texts, some ``SLICE_CHARS`` characters at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        part = np.cumsum(lengths, dtype=np.int64) // SLICE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                doc_ids, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                yield doc_ids, [t or "" for t in texts]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, PIECE_FIELDS, strict=True)],
        names=[name for name, _ in PIECE_FIELDS],
    )


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of this task have each token."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
        counts = np.bincount(terms, minlength=len(total))
        counts[: len(total)] += total
        total = counts
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "n"])


def place_key(terms: np.ndarray, frequency: np.ndarray) -> bytes:
    """Order of a document's place: its rarest tokens that another document has too."""
    shared = terms[frequency[terms] > 1]
    first = np.lexsort((shared, frequency[shared]))[:KEY_TOKENS]
    return shared[first].astype(">u4").tobytes().ljust(4 * KEY_TOKENS, b"\xff")


def place_keys(statistics) -> Callable:
    """Keys and sizes of the given tails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = statistics.value[0]
        for batch in batches:
            terms, tie, length = batch.columns
            keys = [
                place_key(np.frombuffer(t, "<u4"), frequency) + struct.pack(">q", h)
                for t, h in zip(terms.to_pylist(), tie.to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), length], names=["key", "length"])

    return run


def cuts_of(sample: list[tuple[bytes, int]], shards: int) -> list[bytes]:
    """First keys of all shards but the first, for shards of equal numbers of tokens."""
    sample = sorted(sample)
    sums = np.cumsum([n for _, n in sample])
    if not len(sums):
        return []
    at = np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards)
    return [sample[i][0] for i in at]


def dealt(statistics, cuts) -> Callable:
    """The shard of each row: tails by their key, full windows by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, first = statistics.value[0], cuts.value
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            pairs = zip(rows["terms"].to_pylist(), rows["tie"].to_pylist(), strict=True)
            shard = [
                h % (len(first) + 1)
                if t is None
                else bisect.bisect_right(first, place_key(np.frombuffer(t, "<u4"), frequency) + struct.pack(">q", h))
                for t, h in pairs
            ]
            out = rows.drop_columns(["terms", "tie"]).append_column("shard", pa.array(shard, pa.int64()))
            yield from out.to_batches()

    return run


class Shard:
    """The tails of one shard and their inverted index."""

    def __init__(self, tails: list[np.ndarray], frequency: np.ndarray, n_docs: int, mean: float):
        self.tails = tails
        found = [counted(t) for t in tails]
        sizes = np.array([len(t) for t, _ in found])
        doc = np.repeat(np.arange(len(tails)), sizes)
        term = np.concatenate([t for t, _ in found]).astype(np.int64)
        count = np.concatenate([c for _, c in found])
        df = frequency[term]
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        length = np.array([len(t) for t in tails], float)[doc]
        weight = idf * count * (K1 + 1) / (count + K1 * (1 - BETA + BETA * length / mean))
        self.queries = [
            term[b - s : b][np.argsort(-weight[b - s : b], kind="stable")[:QUERY_TOKENS]]
            for b, s in zip(np.cumsum(sizes), sizes, strict=True)
        ]
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(frequency) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a query token, best first, ties by number."""
        spans = [(self.first[t], self.first[t + 1]) for t in self.queries[seed]]
        docs = np.concatenate([self.docs[a:b] for a, b in spans])
        weights = np.concatenate([self.weights[a:b] for a, b in spans])
        free = unused[docs]
        found, at = np.unique(docs[free], return_inverse=True)
        if not len(found):
            return
        score = np.bincount(at, weights[free])
        heap = [(-s, int(d)) for s, d in zip(score, found, strict=True)]
        heapq.heapify(heap)
        while heap:
            yield heapq.heappop(heap)[1]


def fill(shard: Shard) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start in it, length), all full but the last."""
    unused = np.ones(len(shard.tails), bool)
    done: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, next_seed = WINDOW, 0
    rest: tuple[int, int] | None = None

    def place(doc: int, start: int) -> tuple[int, int] | None:
        """Puts what fits into the window; gives what does not."""
        nonlocal now, room
        size = len(shard.tails[doc]) - start
        took = min(size, room)
        now.append((doc, start, took))
        room -= took
        if not room:
            done.append(now)
            now, room = [], WINDOW
        return (doc, start + took) if took < size else None

    while True:
        if rest:
            seed, rest = rest[0], place(*rest)
        else:
            while next_seed < len(unused) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(unused):
                break
            seed = next_seed
            unused[seed] = False
            rest = place(seed, 0)
        if rest or room == WINDOW:
            continue
        for doc in shard.neighbours(seed, unused):
            unused[doc] = False
            rest = place(doc, 0)
            if rest or room == WINDOW:
                break
    if now:
        done.append(now)
    return done


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A last sequence cut into sequences of falling powers of two."""
    left = sum(n for _, _, n in pieces)
    queue = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, n = queue.pop()
            took = min(n, room)
            out.append((doc, start, took))
            room -= took
            if took < n:
                queue.append((doc, start + took, n - took))
        yield out


PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, shard bigint"
PACKED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, shard bigint"
)


def pack_shard(statistics) -> Callable:
    """Numbers the full windows of a shard and packs its tails. A sequence's number has the
    shard in its upper half."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frequency, n_docs, mean = statistics.value
        base = int(key[0]) << 32
        whole = rows[rows.ids.isna()].sort_values(["doc_id", "start", "ids_crc32"]).reset_index(drop=True)
        whole["sequence_id"] = base + np.arange(len(whole))
        whole["offset"] = 0
        tails = rows[rows.length.gt(0) & rows.ids.notna()]
        tails = tails.sort_values(["doc_id", "start", "ids"]).reset_index(drop=True)
        out = []
        if len(tails):
            ids = [np.frombuffer(x, "<u4") for x in tails.ids]
            sequences = fill(Shard(ids, frequency, n_docs, mean))
            sequences[-1:] = powers_of_two(sequences[-1])
            for number, pieces in enumerate(sequences, base + len(whole)):
                offset = 0
                for doc, start, n in pieces:
                    crc = zlib.crc32(ids[doc][start : start + n].tobytes())
                    out.append((doc, start, n, crc, number, offset))
                    offset += n
        made = pd.DataFrame(out, columns=["tail", "at", "n", "crc", "sequence_id", "offset"])
        of = tails.iloc[made["tail"].astype(int)].reset_index(drop=True)
        parts = pd.DataFrame(
            {
                "doc_id": of.doc_id,
                "named": of.named,
                "start": of.start + made["at"].astype("int64"),
                "length": made["n"].astype("int64"),
                "ids_crc32": made["crc"].astype("int64"),
                "doc_tokens": of.doc_tokens,
                "sequence_id": made["sequence_id"].astype("int64"),
                "offset": made["offset"].astype("int64"),
            }
        )
        result = pd.concat([whole[parts.columns], parts], ignore_index=True)
        result["doc_id"] = result["doc_id"].astype("Int64").where(result["named"].astype(bool))
        result["shard"] = int(key[0])
        return result.drop(columns="named")

    return run


def pack(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = stage_table(docs.mapInArrow(tokenized(path), PIECES), "pieces")
    documents = pieces.filter("terms IS NOT NULL")
    n_docs, tokens, tail_tokens = documents.agg(
        F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))
    ).first()
    counts = (
        documents.select("terms").mapInArrow(term_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    )
    rows = counts.collect()  # at most one row per vocabulary entry
    frequency = np.zeros(max((r.term for r in rows), default=0) + 1, np.int64)
    for r in rows:
        frequency[r.term] = r.n
    statistics = spark.sparkContext.broadcast((frequency, n_docs, tokens / max(1, n_docs)))
    shards = max(1, math.ceil(tail_tokens / shard_tokens))
    places = pieces.filter("length > 0").withColumn("tie", F.xxhash64("doc_id", "start", "ids_crc32", "ids"))
    cuts = []
    if shards > 1:
        tails = places.filter("terms IS NOT NULL").select("terms", "tie", "length")
        every = max(1, n_docs // (shards * CUT_SAMPLE))
        sample = tails.filter(F.pmod(F.xxhash64("tie"), F.lit(every)) == 0)
        cuts = cuts_of(list(map(tuple, sample.mapInArrow(place_keys(statistics), "key binary, length bigint").collect())), shards)
    spread = dealt(statistics, spark.sparkContext.broadcast(cuts))
    return (
        places.mapInArrow(spread, PLACED)
        .withColumn("named", F.col("doc_id").isNotNull())
        .withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
        .groupBy("shard")
        .applyInPandas(pack_shard(statistics), PACKED)
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
