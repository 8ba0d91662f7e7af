"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles. Register i keeps the least of an
exponential hash over the set, on the scale ``floor(1 - log_b h)`` cut to 16 bits, so registers
of a union are the maxima of registers, and equal registers are as likely as the sets are alike.
Five registers are a band. Documents that share a band are candidates; a likelihood over all
registers and the two set sizes estimates their similarity; pairs near or above the threshold
are confirmed on the full sets.

No bucket is expanded to all pairs:

1. Exact copies of a set are one class, represented by its smallest ``doc_id``.
2. In each bucket every class is paired with two members, those whose ids have the smallest and
   the largest hash. They are the same few documents in most buckets of a cluster, so a class
   has a handful of partners. Confirmed links give components.
3. Each class gets one *hub*: of the members it was compared with, and of their hubs, the one
   that is like most others. What the class has and the hub lacks, and the other way round, is
   kept: two classes of one hub are compared by these differences, without their texts.
4. Only buckets of four or more that still hold two components are searched for the rest:
   members of all but the largest component are compared with the other components' members,
   in blocks of at most ``BLOCK`` rows, on registers first. Pairs whose estimate is near the
   threshold or above it, from the first band that they share, are confirmed at once by
   their differences if they have one hub, and one link to each other component is kept. Of
   the others, first only the ``BEST`` partners of each member by estimate are confirmed
   on the texts, which joins most of what belongs together; then, in the buckets that still hold
   two components, all of them. Rows that are made grow with the members outside the main
   component, not with the square of a cluster.

With 40 bands of five registers a pair at similarity 0.75 is missed with probability 2e-5, one
at 0.8 with 1e-7; a pair also has to escape through every path of its component.

Defined results: a null text, or one without words, has an empty set and is linked with nothing.
Rows with one ``doc_id`` are one document that has all their texts. A null ``doc_id`` names
nothing: it takes no part, its component is null and it is kept. Only ``doc_id`` and ``text`` are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import similar_sets_sql, table
from timedtext.llm.hashing import Prefix, mix
from timedtext.session import stage_table

SHINGLE = 5
NUMERATOR = 75  # percent
BANDS = 40
ROWS = 5
REGISTERS = BANDS * ROWS
B = 1.001
A = 20.0
LOW = 0.62  # estimates below are not confirmed: four deviations under the threshold
RELATED = 0.5  # least similarity to a hub
BLOCK = 2048
BEST = 2
CHUNK_BYTES = 256 * 1024

SEEDS = np.random.default_rng(75).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.random.default_rng(76).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; short texts give one, empty ones none."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    space = IS_SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    words = Prefix(data).ranges(start, end)
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.concatenate([first[1:], [len(words)]])
    n = max(0, len(words) - SHINGLE + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        grams += words[k : k + n] * PLACES[k]
    grams = mix(grams)
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((words[a:b] * PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set, none of them empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    items = np.concatenate(sets)
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    work = np.empty_like(items)
    for k, seed in enumerate(SEEDS):
        np.multiply(items, seed, out=work)
        work ^= work >> np.uint64(32)
        np.minimum.reduceat(work, starts, out=least[k])
    h = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, 65535).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, with the band's number in it."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    keys = (parts * PLACES).sum(2) + np.arange(BANDS, dtype=np.uint64) * SEEDS[:BANDS]
    return mix(keys).astype(np.int64)


def likely_similarity(more, less, same, size_a, size_b) -> np.ndarray:
    """Maximum-likelihood similarity of two sets of known sizes, from the numbers of registers
    in which the first is larger, smaller and the same."""
    grid = np.linspace(0.0, 1.0, 101)[None, :]
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.minimum(grid, np.minimum(u / v, v / u) * 0.999999)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = (
        more[:, None] * np.log(up + tiny)
        + less[:, None] * np.log(down + tiny)
        + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    )
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of some 256 KB together, as bytes, with the first one's index."""
    part: list[bytes] = []
    size = first = 0
    for i in range(len(texts)):
        part.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary"


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, texts in chunks(batch.column(1)):
            sets = shingle_sets(texts)
            full = [s for s in sets if len(s)]
            regs = registers(full) if full else np.zeros((0, REGISTERS), "<u2")
            at, a, b, sketches = 0, [], [], []
            for s in sets:
                a.append(int(s.sum().view(np.int64)) if len(s) else 0)
                b.append(int(mix(s ^ SEEDS[0]).sum().view(np.int64)) if len(s) else 0)
                sketches.append(regs[at].tobytes() if len(s) else None)
                at += bool(len(s))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
            )


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each band of each sketch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u2")
            keys = band_keys(regs.reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part.column("doc_id").to_numpy(), BANDS)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
                    pa.array(keys.ravel()),
                ],
                names=["doc_id", "band", "key"],
            )


def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate is not far under the least similarity to a hub."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS)
            for c in ("sketch_a", "sketch_b")
        )
        more, less = (x > y).sum(1), (x < y).sum(1)
        sizes = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        j = likely_similarity(more, less, REGISTERS - more - less, *sizes)
        yield batch.select(["a", "b"]).filter(pa.array(j >= RELATED - (0.75 - LOW)))


RELATION = "a bigint, b bigint, linked boolean, size bigint, own binary, lacks binary"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members ``a`` and others ``b`` that are related: whether they are linked, the size of
    ``b``, what ``a`` has and ``b`` lacks, and what ``b`` has and ``a`` lacks."""
    unpack = zstandard.ZstdDecompressor().decompress
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
    step = 64

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[f.split()[0] for f in RELATION.split(", ")],
        )

    for batch in batches:
        rows, held = [], 0
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            sets = shingle_sets([unpack(t) for c in ("z_a", "z_b") for t in part.column(c).to_pylist()])
            ids = zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)
            for (a, b), x, y in zip(ids, sets[: part.num_rows], sets[part.num_rows :], strict=True):
                own, lacks = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                union = len(y) + len(own)
                both = len(y) - len(lacks)
                if both and both >= RELATED * union:
                    linked = 100 * both >= NUMERATOR * union
                    rows.append((a, b, linked, len(y), own.tobytes(), lacks.tobytes()))
                    held += own.nbytes + lacks.nbytes
            if held > CHUNK_BYTES * 16:
                yield made(rows)
                rows, held = [], 0
        yield made(rows)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of packed texts whose full sets are similar enough."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        step = 64
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            texts = [unpack(t) for c in ("z_a", "z_b") for t in part.column(c).to_pylist()]
            sets = shingle_sets(texts)
            n = part.num_rows
            for i in range(n):
                both = len(np.intersect1d(sets[i], sets[n + i], assume_unique=True))
                union = len(sets[i]) + len(sets[n + i]) - both
                keep[at + i] = 0 < union and 100 * both >= NUMERATOR * union
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [
            pack((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "z"]
        )


def rest_of_buckets(best: int | None):
    """Candidate pairs between components, from rows sorted by bucket and block: the best ones
    of each member, or all from the first band that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return candidate_pairs(batches, best)

    return run


class Differences:
    """What some classes have and lack against their hubs, for overlaps with one of them."""

    def __init__(self, size: np.ndarray, own: np.ndarray, lacks: np.ndarray):
        self.size = size
        self.own, self.lacks = (self.joined(v) for v in (own, lacks))

    @staticmethod
    def joined(blobs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(v or b"", np.uint64) for v in blobs]
        return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum([0, *(len(p) for p in parts)])

    @staticmethod
    def shared(side: tuple[np.ndarray, np.ndarray], one: int, others: np.ndarray) -> np.ndarray:
        """How many elements one class and each of the others have in common."""
        values, first = side
        mine = values[first[one] : first[one + 1]]
        sizes = first[others + 1] - first[others]
        if not len(mine) or not sizes.sum():
            return np.zeros(len(others), np.int64)
        at = np.arange(sizes.sum()) + np.repeat(first[others] - (np.cumsum(sizes) - sizes), sizes)
        found = values[at]
        hit = mine[np.minimum(np.searchsorted(mine, found), len(mine) - 1)] == found
        return np.bincount(np.repeat(np.arange(len(others)), sizes), hit, len(others)).astype(np.int64)

    def overlaps(self, one: int, others: np.ndarray) -> np.ndarray:
        """Shingles that one class and each of the others, all of one hub, have in common:
        |hub| - |lacks or lacks| + |own and own|."""
        lacks = np.diff(self.lacks[1])
        either = lacks[one] + lacks[others] - self.shared(self.lacks, one, others)
        return self.size[one] - either + self.shared(self.own, one, others)


MEMBERS = (
    "doc_id", "label", "part", "band", "n_shingles", "block_a", "block_b", "sketch", "key",
    "hub", "size", "own", "lacks",
)


def candidate_pairs(batches: Iterator[pa.RecordBatch], best: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked (``sure``) or may be, see the module's text."""

    def search(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        labels, band = rows["label"], int(rows["band"][0])
        names, sizes = np.unique(labels, return_counts=True)
        main = names[sizes.argmax()]
        order = np.argsort(labels == main, kind="stable")
        ids, labels, part, n, hub = (rows[c][order] for c in ("doc_id", "label", "part", "n_shingles", "hub"))
        regs = np.frombuffer(b"".join(rows["sketch"][order]), "<u2").reshape(-1, REGISTERS)
        known = Differences(*(rows[c][order] for c in ("size", "own", "lacks")))
        across = rows["block_a"][0] != rows["block_b"][0]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(i: int, at: np.ndarray, sure: bool) -> None:
            out.append((np.minimum(ids[i], ids[at]), np.maximum(ids[i], ids[at]), np.full(len(at), sure)))

        for i in range(int((labels != main).sum())):
            other = labels[i + 1 :] != labels[i]
            if across:
                other &= part[i + 1 :] != part[i]
            at = np.flatnonzero(other) + i + 1
            same = regs[at] == regs[i]
            n_same = same.sum(1)
            at, same, n_same = (v[n_same >= REGISTERS // 2] for v in (at, same, n_same))
            if not len(at):
                continue
            if best is None:
                shared = same.reshape(len(at), BANDS, ROWS).all(2).argmax(1) == band
                at, n_same = at[shared], n_same[shared]
            less = (regs[at] > regs[i]).sum(1)
            size = np.full(len(at), n[i], float)
            j = likely_similarity(REGISTERS - n_same - less, less, n_same, size, n[at].astype(float))
            at, j = at[j >= LOW], j[j >= LOW]
            near = hub[at] == hub[i]  # a class without a hub is its own
            if near.any():
                both = known.overlaps(i, at[near])
                linked = at[near][100 * both >= NUMERATOR * (n[i] + n[at[near]] - both)]
                add(i, linked[np.unique(labels[linked], return_index=True)[1]], True)
            at, j = at[~near], j[~near]
            if best is not None:
                at = at[np.argsort(-j, kind="stable")[:best]]
            add(i, at, False)
        columns = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 2 + [[np.zeros(0, bool)]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["a", "b", "sure"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in MEMBERS}
        held = {c: np.concatenate([held[c], new[c]]) for c in MEMBERS} if held else new
        group = np.stack([held["key"], held["block_a"], held["block_b"]])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield search({c: held[c][a:b] for c in MEMBERS})
        held = {c: held[c][cuts[-1] :] for c in MEMBERS}
    if held and len(held["key"]):
        yield search(held)


def components(edges: DataFrame) -> DataFrame:
    """Every node of the edges (a, b) with the smallest node that it reaches: (node, root).

    Edges are turned round their smallest neighbour until they stand still: a bounded number of
    joins a round, some log of the diameter many rounds, and no row per pair of a component.
    """
    now = stage_table(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .filter("hi <> lo")
        .distinct(),
        "edges",
    )

    def state(rows: DataFrame):
        return rows.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("bigint"))).first()

    before, at = None, state(now)
    while at != before:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        turned = large.join(least, "hi")
        small = (
            turned.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        now = stage_table(small, "edges")
        before, at = at, state(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar enough."""
    a, b = texts.toDF("a", "z_a"), texts.toDF("b", "z_b")
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "z_a", "z_b")
    return stage_table(found.mapInArrow(confirmed, "a bigint, b bigint"), "links")


def relations(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Members against the others of their pairs (a, b): rows of ``RELATION``."""
    a, b = texts.toDF("a", "z_a"), texts.toDF("b", "z_b")
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "z_a", "z_b")
    return stage_table(found.mapInArrow(compared, RELATION), "related")


def best_hub(related: DataFrame) -> DataFrame:
    """For each class the other one, or itself, that is related with most: (doc_id, hub)."""
    degree = related.groupBy("b").agg(F.count("*").alias("degree"))
    pairs = related.select("a", "b").union(related.select(F.col("b").alias("a"), "b").distinct())
    best = F.max(F.struct("degree", F.xxhash64("b").alias("turn"), "b")).getField("b").alias("hub")
    return pairs.join(degree, "b").groupBy(F.col("a").alias("doc_id")).agg(best)


def differences(related: DataFrame, hubs: DataFrame) -> DataFrame:
    """How each class differs from its hub: (doc_id, hub, size, own, lacks)."""
    wanted = hubs.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    found = related.join(wanted, ["a", "b"]).dropDuplicates(["a", "b"])
    found = found.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), "size", "own", "lacks")
    sizes = found.groupBy(F.col("hub").alias("doc_id")).agg(F.first("size").alias("size"))
    nothing = F.lit(b"")
    # a hub that has another hub itself is compared by that one
    alone = sizes.join(found.select("doc_id"), "doc_id", "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("hub"), "size", nothing.alias("own"), nothing.alias("lacks"))
    return found.unionByName(alone)


def mixed_members(shared: DataFrame, roots: DataFrame, side: DataFrame) -> DataFrame:
    """Members of the buckets of four or more with two components, by bucket and block."""
    labelled = shared.filter("n > 3").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select(
        "doc_id", "band", "key", "n", F.coalesce("root", "doc_id").alias("label")
    )
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    blocks = F.ceil(F.col("n") / BLOCK)
    return (
        labelled.join(mixed.filter("x < y").select("key"), "key")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("block_a", F.least("part", "other"))
        .withColumn("block_b", F.greatest("part", "other"))
        .join(side, "doc_id")
        .select(*MEMBERS)
        .repartition("key", "block_a", "block_b")
        .sortWithinPartitions("key", "block_a", "block_b")
    )


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stage_table(docs.mapInArrow(sketch_batches, SKETCH), "sketches")
    sets = ["set_a", "set_b", "n_shingles"]
    named = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy(*sets).agg(F.min("doc_id").alias("doc_id"))
    classes = named.join(classes, [*sets, "doc_id"]).dropDuplicates([*sets, "doc_id"])
    classes = stage_table(classes.select("doc_id", *sets, "sketch"), "classes")
    named_docs = docs.filter("doc_id IS NOT NULL")

    bands = classes.select("doc_id", "sketch").mapInArrow(band_rows, "doc_id bigint, band int, key bigint")
    turn = F.xxhash64("doc_id")
    buckets = (
        bands.groupBy("key")
        .agg(
            F.min_by("doc_id", turn).alias("first"),
            F.max_by("doc_id", turn).alias("second"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
    )
    shared = stage_table(bands.join(buckets, "key"), "buckets")
    pairs = (
        shared.select(F.col("doc_id").alias("a"), F.explode(F.array("first", "second")).alias("b"))
        .filter("a <> b")
        .distinct()
    )
    side = classes.select("doc_id", "n_shingles", "sketch")
    likely = (
        pairs.join(side.toDF("a", "n_a", "sketch_a"), "a")
        .join(side.toDF("b", "n_b", "sketch_b"), "b")
        .mapInArrow(estimated, "a bigint, b bigint")
    )
    # Texts of all candidates are fetched once. The join is always a merge of two sorted sides,
    # so that its cost follows the input and no side is broadcast.
    ids = shared.select("doc_id").distinct().hint("merge")
    texts = named_docs.mapInArrow(packed, "doc_id bigint, z binary").join(ids, "doc_id", "left_semi")
    texts = stage_table(texts, "texts")
    related = relations(stage_table(likely, "pairs"), texts)
    hubs = best_hub(related)
    of_hub = hubs.select(F.col("doc_id").alias("hub"), F.col("hub").alias("b"))
    farther = hubs.join(of_hub, "hub").select(F.col("doc_id").alias("a"), "b").filter("a <> b")
    farther = farther.join(related, ["a", "b"], "left_anti")
    related = related.union(relations(stage_table(farther, "pairs"), texts))
    side = side.join(stage_table(differences(related, best_hub(related)), "differences"), "doc_id", "left")
    side = side.withColumn("hub", F.coalesce("hub", "doc_id")).withColumn("size", F.coalesce("size", "n_shingles"))
    links = related.filter("linked").select("a", "b")
    roots = components(links)
    for best in (BEST, None):
        members = mixed_members(shared, roots, side)
        more = stage_table(members.mapInArrow(rest_of_buckets(best), "a bigint, b bigint, sure boolean").distinct(), "pairs")
        links = links.union(more.filter("sure").select("a", "b"))
        links = links.union(confirm(more.filter("NOT sure").select("a", "b"), texts))
        roots = components(links)

    of_class = classes.select(*sets, F.col("doc_id").alias("node")).join(roots, "node", "left")
    of_class = of_class.groupBy(*sets).agg(F.min(F.coalesce("root", "node")).alias("component"))
    counted = rows.select("doc_id", *sets).join(of_class, sets, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return counted.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: its smallest ``doc_id``, with one of its rows. Rows without a
    ``doc_id`` stay. Columns stay as they are."""
    kept = near_components(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


ORACLE = similar_sets_sql(SHINGLE, NUMERATOR) + "SELECT *, doc_id = component_id AS kept FROM found"
