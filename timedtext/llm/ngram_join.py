"""Exact Jaccard join of word n-gram sets with skipping by set relations.

A document's set is its distinct three-word shingles; sets with a similarity of at least
``PERCENT`` are linked. The join is exact: nothing is sampled, no list is cut.

1. Equal sets are one *class*. Shingles get one order everywhere, rarer ones first; the counts
   come from all texts, in ``BUCKETS`` buckets of hashes (4 MB whatever the table's size). A set's
   *prefix* is its first n - ceil(0.9 n) + 1 shingles: linked sets share one of theirs.
2. The inverted index lists, for a shingle, the classes that have it in their prefix, with size
   and position. Two sets whose first common shingle is at positions i and j can be linked only
   if i <= n - need and j <= m - need, with need = ceil(0.9 / 1.9 (n + m)) the least overlap. So
   every entry has a *reach*, the largest partner that its position allows. Lists are read in
   blocks of entries sorted by size, and a block whose farthest reach is under the probing set's
   size is skipped as a whole.
3. Lists of more than ``HOT`` classes are first compared with a *leader* only: the class that has
   the list's shingle in the earliest position, the one with the fewest rare shingles of its own;
   then once more, with a second leader, those that are not linked with the first. This gives
   components, and for each class the leader that it is most like, with the *difference*: its
   shingles that the leader lacks and the leader's that it lacks.
4. All lists are then searched for pairs of different components. A pair is dropped where the
   prefixes alone show too many shingles that the other set cannot have. If both classes have
   the same leader L, the answer is derived from what is known of L: the overlap is
   |L| - |lacks(x) + lacks(y)| + |own(x) & own(y)|, without the sets themselves. Other pairs are
   compared on their full sets.

The work of a list grows with its classes outside its largest component times its classes,
less all blocks skipped, not with the square of a group of copies. A list that is longer than
``BLOCK`` is dealt to several tasks: its largest component is split, the others are copied. (A list
full of unlinked sets with early common shingles would still cost their number squared.)

Defined results: a null text, or one without words, has an empty set and is linked with nothing.
Rows with one ``doc_id`` are one document that has all their texts (its rows without words have
its own number as their component). A null ``doc_id`` names
nothing: it takes no part and its component is null. Only ``doc_id`` and ``text`` are read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import similar_sets_sql, table
from timedtext.llm.hashing import Prefix, mix
from timedtext.llm.near_dup import chunks, components
from timedtext.session import stage_table

SHINGLE = 3
PERCENT = 90
RELATED = 80
BUCKETS = 1 << 20
SLICES = 64
HOT = 32
BLOCK = 4096
ENTRIES = 64  # of a block of a list that is skipped as a whole
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
PLACES = np.random.default_rng(31).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; short texts give one, empty ones none."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    edge = np.diff(IS_SPACE[data].astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    words = Prefix(data).ranges(start, end)
    bounds = np.searchsorted(start, np.concatenate([[0], ends]))
    n = max(0, len(words) - SHINGLE + 1)
    grams = mix(sum((words[k : k + n] * PLACES[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((words[a:b] * PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(shingles: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(mix(shingles ^ np.uint64(0x5DEECE66D1CE4E5B)).sum().view(np.int64))


def need(n, m):
    """The least overlap of linked sets of these sizes."""
    return -((-PERCENT * (n + m)) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    return n + (-PERCENT * n) // 100 + 1


SETS = "doc_id bigint, n_shingles bigint, class bigint, part int, counts binary"


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and class of every text; after them, how many shingles of the task are in each
    bucket, in ``SLICES`` rows."""
    counts = np.zeros(BUCKETS, np.uint32)
    for batch in batches:
        ids = batch.column(0)
        for first, texts in chunks(batch.column(1)):
            sets = shingle_sets(texts)
            all_of = np.concatenate(sets)
            np.add.at(counts, (all_of % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.nulls(len(sets), pa.int32()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                names=[f.split()[0] for f in SETS.split(", ")],
            )
    if counts.any():
        pack = zstandard.ZstdCompressor(level=1).compress
        none = pa.nulls(SLICES, pa.int64())
        blobs = [pack(c.tobytes()) for c in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(blobs, pa.binary())],
            names=[f.split()[0] for f in SETS.split(", ")],
        )


def add_counts(key, rows):
    unpack = zstandard.ZstdDecompressor().decompress
    total = sum(np.frombuffer(unpack(c), np.uint32).astype(np.int64) for c in rows["counts"])
    return rows.iloc[:1][["part"]].assign(counts=[total.tobytes()])


def rarity(rows: DataFrame) -> np.ndarray:
    """A rank of 10 bits for each bucket, by the logarithm of its count."""
    found = rows.filter("part IS NOT NULL").select("part", "counts").groupBy("part")
    found = found.applyInPandas(add_counts, "part int, counts binary").collect()
    counts = np.zeros(BUCKETS, np.int64)
    width = BUCKETS // SLICES
    for r in found:
        counts[r.part * width : (r.part + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return (16 * np.log2(counts + 1.0)).astype(np.uint16)


def ordered(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles as numbers whose order is the order of the join: rank, then hash."""
    rank = ranks[(shingles % np.uint64(BUCKETS)).astype(np.int64)].astype(np.int64)
    return np.sort((rank << 48) | (shingles >> np.uint64(16)).astype(np.int64))


def prefix_rows(ranks) -> Callable:
    """Prefixes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in chunks(batch.column(1)):
                sets = shingle_sets(texts)
                at = [i for i, s in enumerate(sets) if len(s)]
                sets = [sets[i] for i in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)).take(pa.array(at, pa.int64())),
                        pa.array([class_key(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([ordered(s, ranks.value)[: prefix_size(len(s))] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "class", "n", "prefix"],
                )

    return run


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and packed text of every row that has one."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for _, texts in chunks(batch.column(0)):
            both = [(class_key(s), pack(t)) for s, t in zip(shingle_sets(texts), texts, strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in both], pa.int64()), pa.array([z for _, z in both], pa.binary())],
                names=["class", "z"],
            )


def unpacked_pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The full sets of pairs of packed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    step = 64
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        sets = shingle_sets([unpack(t) for c in ("z_a", "z_b") for t in part.column(c).to_pylist()])
        for i in range(part.num_rows):
            yield at + i, sets[i], sets[part.num_rows + i]


COMPARED = "a bigint, b bigint, linked boolean, alike double, size bigint, own binary, lacks binary"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes ``a`` against their leaders ``b``: whether they are linked, and how they differ."""
    for batch in batches:
        rows = []
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for i, x, y in unpacked_pairs(batch):
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked = both >= need(len(x), len(y))
            if 100 * both >= RELATED * (len(x) + len(y) - both):
                own = np.setdiff1d(x, y, assume_unique=True).tobytes()
                lacks = np.setdiff1d(y, x, assume_unique=True).tobytes()
                rows.append((a[i], b[i], linked, both / (len(x) + len(y) - both), len(y), own, lacks))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[f.split()[0] for f in COMPARED.split(", ")],
        )


def linked_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of packed texts whose full sets are linked."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, x, y in unpacked_pairs(batch):
            keep[i] = len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x), len(y))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their prefixes do not exclude: shingles of one prefix that come before the
    other's end and are not in it are not in the other set at all."""
    for batch in batches:
        sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
        keep = []
        for i, (n, m) in enumerate(sizes):
            x, y = (batch.column(c)[i].values.to_numpy() for c in ("prefix_a", "prefix_b"))
            end = min(x[-1], y[-1])
            x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
            alone_x = len(x) - int(np.isin(x, y).sum())
            alone_y = len(y) - int(np.isin(y, x).sum())
            keep.append(min(n - alone_x, m - alone_y) >= need(n, m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one leader that are linked, from how both differ from it."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            own_a, own_b, lacks_a, lacks_b = (
                np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("own_a", "own_b", "lacks_a", "lacks_b")
            )
            size = batch.column("size")[i].as_py()
            both = size - len(np.union1d(lacks_a, lacks_b)) + len(np.intersect1d(own_a, own_b, assume_unique=True))
            n = size - len(lacks_a) + len(own_a)
            m = size - len(lacks_b) + len(own_b)
            keep.append(both >= need(n, m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def reach(n: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The largest size of a partner whose first common shingle is at this position."""
    return (100 + PERCENT) * (n - position) // PERCENT - n


class Entries:
    """Entries of lists, as arrays; sorted by list and size."""

    def __init__(self, group: np.ndarray, n: np.ndarray, position: np.ndarray, root: np.ndarray, name: np.ndarray):
        order = np.lexsort((n, group))
        self.group, self.n, self.root, self.name = (v[order] for v in (group, n, root, name))
        self.reach = reach(self.n, position[order])

    def joined(self, probes: Entries, skipped: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an entry and a probe of the same list with at least its size, of different
        components, whose positions allow a link. Whole blocks are skipped."""
        use = self.reach >= self.n
        group, n, far, root, name = (v[use] for v in (self.group, self.n, self.reach, self.root, self.name))
        if not len(n) or not len(probes.n):
            return
        wide = np.int64(1) << 32
        key = group * wide + n
        least = -((-PERCENT * probes.n) // 100)
        first = np.searchsorted(key, probes.group * wide + least)
        last = np.searchsorted(key, probes.group * wide + np.minimum(probes.n, np.maximum(probes.reach, 0)), "right")
        farthest = np.maximum.reduceat(far, np.arange(0, len(far), ENTRIES))
        blocks = np.where(last > first, (last - 1) // ENTRIES - first // ENTRIES + 1, 0)
        step = np.cumsum(blocks)
        at = 0
        while at < len(blocks):  # some thousand blocks at a time
            to = max(at + 1, int(np.searchsorted(step, step[at] + 4096)))
            count = blocks[at:to]
            probe = np.repeat(np.arange(at, to), count)
            inside = np.arange(len(probe)) - np.repeat(np.cumsum(count) - count, count)
            block = first[probe] // ENTRIES + inside
            near = farthest[block] >= probes.n[probe]
            if skipped is not None:
                skipped.append(int((~near).sum()))
            probe, block = probe[near], block[near]
            entry = (block[:, None] * ENTRIES + np.arange(ENTRIES)).ravel()
            probe = np.repeat(probe, ENTRIES)
            good = (entry >= first[probe]) & (entry < last[probe])
            entry, probe = entry[good], probe[good]
            good = (far[entry] >= probes.n[probe]) & (root[entry] != probes.root[probe])
            yield name[entry[good]], probes.name[probe[good]]
            at = to


LISTED = "token bigint, class bigint, n bigint, position int, root bigint, part int, other boolean"


def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of all lists, or parts of lists, from rows sorted by list and part. In a
    part of a list, copies of the other components meet the part's own rows."""

    def search(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        change = (rows["token"][1:] != rows["token"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
        group = np.concatenate([[0], np.cumsum(change)])
        columns = [group, rows["n"], rows["position"].astype(np.int64), rows["root"], rows["class"]]
        other = rows["other"]
        own = Entries(*(v[~other] for v in columns))
        pairs = []
        if other.any():
            copies = Entries(*(v[other] for v in columns))
            pairs += [*copies.joined(own), *own.joined(copies)]
        whole = np.isin(group, group[rows["part"] < 0])
        alone = Entries(*(v[whole] for v in columns))
        pairs += [*alone.joined(alone)]
        a = np.concatenate([np.zeros(0, np.int64), *(np.minimum(x, y) for x, y in pairs)])
        b = np.concatenate([np.zeros(0, np.int64), *(np.maximum(x, y) for x, y in pairs)])
        found = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    names = [f.split()[0] for f in LISTED.split(", ")]
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        held = {c: np.concatenate([held[c], new[c]]) for c in names} if held else new
        if not len(held["token"]):
            continue
        last = (held["token"] != held["token"][-1]) | (held["part"] != held["part"][-1])
        cut = len(last) if not last.any() else int(np.flatnonzero(last)[-1]) + 1
        if last.any():
            yield search({c: v[:cut] for c, v in held.items()})
            held = {c: v[cut:] for c, v in held.items()}
    if held and len(held["token"]):
        yield search(held)


def full_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Class and packed text of the wanted classes (class, doc_id), once each."""
    rows = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    texts = rows.select("text").mapInArrow(packed_texts, "class bigint, z binary")
    return texts.join(wanted.select("class").hint("merge"), "class", "left_semi").dropDuplicates(["class"])


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = texts.toDF("a", "z_a"), texts.toDF("b", "z_b")
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "z_a", "z_b")


def related(lists: DataFrame, docs: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """Classes of long lists against their list's leaders: rows of ``COMPARED``."""
    out = None
    rest = lists.filter(F.col("entries") > hot).drop("entries", "leader")
    for _ in range(2):
        lead = rest.groupBy("token").agg(F.min(F.struct("position", "class", "n")).alias("lead"), F.count("*").alias("left"))
        lead = lead.filter(F.col("left") > hot).select("token", F.col("lead.class").alias("b"), F.col("lead.n").alias("m"))
        rest = stage_table(rest.join(lead, "token"), "leading")
        fits = (F.col("class") != F.col("b")) & (100 * F.least("n", "m") >= RELATED * F.greatest("n", "m"))
        pairs = stage_table(rest.filter(fits).select(F.col("class").alias("a"), "b").distinct(), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        texts = stage_table(full_texts(docs, classes.join(ends, "class").select("class", "doc_id")), "texts")
        found = stage_table(with_texts(pairs, texts).mapInArrow(compared, COMPARED), "related")
        out = found if out is None else out.union(found)
        linked = found.filter("linked").select(F.col("a").alias("class"), "b")
        rest = rest.filter("class <> b").join(linked, ["class", "b"], "left_anti").drop("b", "m")
    return out


def searched(lists: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Candidate pairs of different components that share a list."""
    rows = lists.drop("leader").join(roots.toDF("class", "root"), "class", "left")
    rows = rows.withColumn("root", F.coalesce("root", "class"))
    long = F.col("entries") > block
    sizes = rows.filter(long).groupBy("token", "root").count().groupBy("token")
    main = sizes.agg(F.max(F.struct("count", "root")).getField("root").alias("main"))
    mixed = rows.filter(~long).groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    mixed = mixed.filter("x < y").select("token")
    short = rows.filter(~long).join(mixed, "token", "left_semi")
    short = short.select("token", "class", "n", "position", "root", F.lit(-1).alias("part"), F.lit(False).alias("other"))
    parts = F.ceil(F.col("entries") / block).cast("int")
    split = rows.filter(long).join(main, "token")
    own = split.withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int")).withColumn("other", F.lit(False))
    others = split.filter("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    split = own.unionByName(others.withColumn("other", F.lit(True))).select(*short.columns)
    listed = short.unionByName(split).repartition("token", "part").sortWithinPartitions("token", "part")
    return listed.mapInArrow(list_pairs, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stage_table(docs.mapInArrow(set_rows, SETS), "sets")
    ranks = spark.sparkContext.broadcast(rarity(rows))
    rows = rows.filter("part IS NULL").select("doc_id", "n_shingles", "class")
    named = rows.filter("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = stage_table(named.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "classes")

    prefixes = docs.filter("doc_id IS NOT NULL").mapInArrow(
        prefix_rows(ranks), "doc_id bigint, class bigint, n bigint, prefix array<bigint>"
    )
    prefixes = prefixes.join(classes.hint("merge"), ["class", "doc_id"], "left_semi").dropDuplicates(["class"])
    prefixes = stage_table(prefixes.drop("doc_id"), "prefixes")
    entries = prefixes.select("class", "n", F.posexplode("prefix").alias("position", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("entries"), F.min("class").alias("leader"))
    lists = stage_table(entries.join(shared.filter("entries > 1"), "token"), "lists")

    known = related(lists, docs, classes, hot)
    links = known.filter("linked").select("a", "b")
    candidates = stage_table(searched(lists, components(links), block), "candidates")
    side = prefixes.hint("merge")
    candidates = (
        candidates.join(side.toDF("a", "n_a", "prefix_a"), "a")
        .join(side.toDF("b", "n_b", "prefix_b"), "b")
        .mapInArrow(possible, "a bigint, b bigint")
    )
    candidates = stage_table(candidates, "candidates")

    best = F.max(F.struct("alike", F.col("b").alias("leader"), "size", "own", "lacks")).alias("best")
    nothing = F.lit(b"")
    of = known.groupBy(F.col("a").alias("class")).agg(best).select("class", "best.leader", "best.size", "best.own", "best.lacks")
    leaders = known.select(F.col("b").alias("class"), F.col("b").alias("leader"), "size").distinct()
    leaders = leaders.join(of, "class", "left_anti").withColumn("own", nothing).withColumn("lacks", nothing)
    of = stage_table(of.unionByName(leaders), "differences")
    of_a = of.toDF("a", "leader", "size", "own_a", "lacks_a")
    of_b = of.drop("size").toDF("b", "leader", "own_b", "lacks_b")
    same = candidates.join(of_a, "a").join(of_b, ["b", "leader"])
    found = same.select("a", "b", "size", "own_a", "lacks_a", "own_b", "lacks_b")
    links = links.union(stage_table(found.mapInArrow(derived, "a bigint, b bigint"), "links"))
    rest = stage_table(candidates.join(same.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
    ends = rest.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    texts = stage_table(full_texts(docs, classes.join(ends, "class").select("class", "doc_id")), "texts")
    links = links.union(stage_table(with_texts(rest, texts).mapInArrow(linked_sets, "a bigint, b bigint"), "links"))

    # Links between classes become links between their first documents; so do rows of one doc_id.
    one, other = classes.toDF("a", "x"), classes.toDF("b", "y")
    edges = links.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = named.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x < y")
    several = named.join(several.select("doc_id"), "doc_id").select("doc_id", "class").distinct()
    several = several.join(classes.withColumnRenamed("doc_id", "a"), "class").select("a", F.col("doc_id").alias("b"))
    roots = components(edges.union(several))
    of_class = classes.join(roots, F.col("doc_id") == F.col("node"), "left")
    of_class = of_class.select("class", F.coalesce("root", "doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(of_class, "class", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = similar_sets_sql(SHINGLE, PERCENT) + "SELECT * FROM found"
