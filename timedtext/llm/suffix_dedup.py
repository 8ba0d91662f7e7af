"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier goes. "Earlier" is a
smaller ``doc_id``, or an earlier start in the same document; strings are judged on the input.

A full suffix array takes eight bytes for each byte of text. Here only some suffixes are kept:
each string of ``LENGTH`` bytes selects the least-hashed of its ``GRAM``-byte grams, and only
suffixes at selected places, the *anchors* (about one in forty), are in the array. Equal strings
select the same anchor, so no match is lost. Suffixes are ordered by the hash of their first
gram and then by the hash of their *region*, which is all bytes of the strings that selected the
anchor. Neighbours of one gram and region are copies, and all but the first go as a whole.
Neighbours of one gram and different regions match in part; only their regions are fetched from
the texts and compared string by string.

``SuffixLevels`` holds the arrays of earlier batches. A new batch is sorted together with the
levels (one exchange, a streaming scan), its own first regions become a level, and levels of
equal rank merge to one of the next rank, so there are log(n) levels of distinct regions.

Copies inside one task are marked before the exchange and dealt apart from their group, so a
string in a third of all documents brings a group one row from each task. A gram with more than
``GROUP`` different regions is compared by strings that are grouped with partial aggregation.

Defined results: a null text is empty: no bytes, nothing removed. Rows that agree in ``doc_id``
and text are one document and get a result each; different texts of one ``doc_id`` are numbered
in the order of a 128-bit hash, and come in this order. A null ``doc_id`` comes before all others,
and its different texts are documents of their own, in that order too; ids under -2^63 + 2^40
count as none. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import table
from timedtext.llm.hashing import Prefix, mix
from timedtext.session import stage_table

LENGTH = 100
GRAM = 20
SPAN = LENGTH - GRAM + 1  # grams in a string
BATCHES = 4  # each one sorts the levels again, so a number that grew with the table would cost its square
GROUP = 5000
PIECE = 1 << 19
CHUNK_BYTES = 1 << 18
FLUSH_ROWS = 1 << 20
LOW = (1 << 20) - 1
TIE_SHIFT = 40
NO_ID = -(2**63)
NO_IDS = 1 << 40  # so many of the least ids are kept for texts without one
LEFT = np.uint64(0xD6E8FEB86659FD93)


def string_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each string of ``LENGTH`` bytes."""
    at = np.arange(max(0, len(data) - LENGTH + 1))
    return Prefix(data).ranges(at, at + LENGTH)


def anchors(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of byte strings with under 2^20 bytes together, the runs of strings that select one
    anchor: part, hash of the gram, hash of the region, start in the part and number of strings.
    """
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    prefix = Prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix((prefix.sums[GRAM:] - prefix.sums[:-GRAM]) * prefix.down[: len(at)])
    least = (grams & ~np.uint64(LOW)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[: -(SPAN - size)], least[SPAN - size :])
    chosen = np.full(len(least) + 1, -1, np.int64)
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        if b - a >= LENGTH:
            chosen[a : b - LENGTH + 1] = (least[a : b - LENGTH + 1] & np.uint64(LOW)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    width = np.diff(cuts, append=len(chosen))
    keep = chosen[cuts] >= 0
    start, width = cuts[keep], width[keep]
    anchor = chosen[start]
    region = prefix.ranges(start, start + width + LENGTH - 1)
    region = mix(region ^ ((anchor - start).astype(np.uint64) * LEFT))
    part = np.searchsorted(ends, start, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    return part, grams[anchor], region, start - begin[part], width


SUFFIXES = "deal bigint, seen boolean, old boolean, h bigint, u bigint, id bigint, place bigint, width int"


def suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of (id, tie, text), with later copies inside this task marked."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        h, u, ids, place, width = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, ids, u, h))
        h, u, ids, place, width = (c[order] for c in (h, u, ids, place, width))
        new = np.ones(len(h), bool)  # a repeated row is no copy of itself
        new[1:] = (h[1:] != h[:-1]) | (u[1:] != u[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
        h, u, ids, place, width = (c[new] for c in (h, u, ids, place, width))
        seen = np.zeros(len(h), bool)
        seen[1:] = (h[1:] == h[:-1]) & (u[1:] == u[:-1])
        deal = np.where(seen, mix(u + place.view(np.uint64)), h)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(deal.view(np.int64)),
                pa.array(seen),
                pa.array(np.zeros(len(h), bool)),
                pa.array(h.view(np.int64)),
                pa.array(u.view(np.int64)),
                pa.array(ids),
                pa.array(place),
                pa.array(width.astype(np.int32)),
            ],
            names=["deal", "seen", "old", "h", "u", "id", "place", "width"],
        )

    def add(parts: list[bytes], ids: list[int], places: list[int]) -> int:
        part, h, u, start, width = anchors(parts)
        held.append((h, u, np.array(ids, np.int64)[part], np.array(places, np.int64)[part] + start, width))
        return len(h)

    for batch in batches:
        parts, ids, places, size = [], [], [], 0
        for i in range(batch.num_rows):
            text = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
            row_id, tie = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() << TIE_SHIFT
            for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                part = text[at : at + PIECE + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                parts.append(part)
                ids.append(row_id)
                places.append(tie + at)
                size += len(part)
                if size >= CHUNK_BYTES:
                    count += add(parts, ids, places)
                    parts, ids, places, size = [], [], [], 0
        if parts:
            count += add(parts, ids, places)
        if count >= FLUSH_ROWS:
            yield flush()
            count = 0
    if held:
        yield flush()


FOUND = "h bigint, u bigint, id bigint, place bigint, width int, copy boolean, partial boolean, old boolean"


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes: copies of an earlier region, and regions that share their gram with
    other regions. A region waits until the next one is known; nothing else is held."""
    columns = ("h", "u", "id", "place", "width", "old", "seen")
    waiting: dict[str, np.ndarray] | None = None
    shared = False  # the waiting region has one of its gram before it

    def out(rows: dict[str, np.ndarray], copy: np.ndarray, partial: np.ndarray) -> pa.RecordBatch:
        values = [rows[c] for c in ("h", "u", "id", "place", "width")] + [copy, partial, rows["old"]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v) for v in values],
            names=["h", "u", "id", "place", "width", "copy", "partial", "old"],
        )

    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if rows["seen"].any():
            seen = {c: v[rows["seen"]] for c, v in rows.items()}
            yield out(seen, np.ones(len(seen["h"]), bool), np.zeros(len(seen["h"]), bool))
            rows = {c: v[~rows["seen"]] for c, v in rows.items()}
        if waiting:
            rows = {c: np.concatenate([waiting[c], rows[c]]) for c in columns}
        if not len(rows["h"]):
            continue
        again = np.zeros(len(rows["h"]), bool)
        again[1:] = np.logical_and.reduce([rows[c][1:] == rows[c][:-1] for c in ("h", "u", "id", "place")])
        rows = {c: v[~again] for c, v in rows.items()}
        copy = np.zeros(len(rows["h"]), bool)
        copy[1:] = (rows["h"][1:] == rows["h"][:-1]) & (rows["u"][1:] == rows["u"][:-1])
        if copy.any():
            copies = {c: v[copy] for c, v in rows.items()}
            yield out(copies, np.ones(len(copies["h"]), bool), np.zeros(len(copies["h"]), bool))
        firsts = {c: v[~copy] for c, v in rows.items()}
        h = firsts["h"]
        same = h[1:] == h[:-1]
        before, after = np.append(shared, same), np.append(same, False)
        done = {c: v[:-1] for c, v in firsts.items()}
        if len(done["h"]):
            yield out(done, np.zeros(len(h) - 1, bool), (before | after)[:-1])
        waiting = {c: v[-1:] for c, v in firsts.items()}
        shared = bool(before[-1])
    if waiting:
        yield out(waiting, np.zeros(1, bool), np.array([shared]))


class SuffixLevels:
    """Suffix arrays of the batches so far, as tables of distinct regions by rank."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """The copies and partial matches of new documents (id, tie, text) among themselves and
        with the levels; partial matches bring the level's own region along. A last batch is
        not kept as a level."""
        batch = docs.select("id", "tie", "text").mapInArrow(suffix_rows, SUFFIXES)
        for level in self.levels.values():
            old = level.select(
                F.col("h").alias("deal"), F.lit(False).alias("seen"), F.lit(True).alias("old"),
                "h", "u", "id", "place", "width",
            )
            batch = batch.unionByName(old)
        in_order = batch.repartition("deal").sortWithinPartitions(
            F.desc("seen"), "h", "u", F.desc("old"), "id", "place"
        )
        found = in_order.mapInArrow(scanned, FOUND)
        found = found.filter("copy OR partial" if last else "copy OR partial OR NOT old")
        found = stage_table(found, "suffixes")
        if not last:
            self._insert(found.filter("NOT copy AND NOT old").select("h", "u", "id", "place", "width"))
        return found.filter("copy OR partial")

    def _insert(self, level: DataFrame) -> None:
        rank = 0
        while rank in self.levels:
            both = self.levels.pop(rank).unionByName(level)
            level = stage_table(both.repartition("h").sortWithinPartitions("h", "u"), "level")
            rank += 1
        self.levels[rank] = level


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [pack((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "tie", "z"]
        )


REGIONS = "h bigint, id bigint, place bigint, region binary"


def cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the regions (h, start, width) of a document."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["h", "id", "place", "region"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            text = unpack(batch.column("z")[i].as_py())
            row_id, tie = batch.column("id")[i].as_py(), batch.column("tie")[i].as_py() << TIE_SHIFT
            for r in batch.column("regions")[i].as_py():
                start = r["start"]
                rows.append((r["h"], row_id, tie + start, text[start : start + r["width"] + LENGTH - 1]))
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )


RUNS = "id bigint, place bigint, width int"


def later_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of regions sorted by gram and place, runs of strings that stand in an earlier region of
    the same gram."""

    def runs(h: np.ndarray, ids: np.ndarray, place: np.ndarray, regions: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(r) - LENGTH + 1 for r in regions])
        ends = np.cumsum([len(r) for r in regions])
        hashes = string_hashes(np.frombuffer(b"".join(regions), np.uint8))
        of = np.repeat(np.arange(len(regions)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.arange(len(of)) - first[of]
        hashes = hashes[(ends - [len(r) for r in regions])[of] + inside]
        key = mix(h.view(np.uint64))[of] + hashes
        # stable: the first of equal strings is the one of the earliest region
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(of), bool)
        later[order[1:]] = key[order[1:]] == key[order[:-1]]
        begin = later.copy()
        begin[1:] &= ~(later[:-1] & (of[1:] == of[:-1]))
        start = np.flatnonzero(begin)
        stop = later.copy()
        stop[:-1] &= ~(later[1:] & (of[1:] == of[:-1]))
        end = np.flatnonzero(stop) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[of[start]]),
                pa.array(place[of[start]] + inside[start]),
                pa.array((end - start).astype(np.int32)),
            ],
            names=["id", "place", "width"],
        )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy() for c in ("h", "id", "place")] + [batch.column("region").to_pylist()]
        if held:
            new = [np.concatenate([a, b]) for a, b in zip(held[:3], new[:3], strict=True)] + [held[3] + new[3]]
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut:
            yield runs(*(v[:cut] for v in new))
        held = [v[cut:] for v in new]
    if held and len(held[0]):
        yield runs(*held)


STRINGS = "h bigint, s bigint, id bigint, place bigint"


def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            h, row_id, place, region = (batch.column(c)[i].as_py() for c in ("h", "id", "place", "region"))
            hashes = string_hashes(np.frombuffer(region, np.uint8))
            n = len(hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, h)),
                    pa.array(hashes.view(np.int64)),
                    pa.array(np.full(n, row_id)),
                    pa.array(place + np.arange(n)),
                ],
                names=["h", "s", "id", "place"],
            )


def partial_runs(partial: DataFrame, texts: DataFrame) -> DataFrame:
    """Runs of strings of partly matching regions (h, id, place, width) that start earlier."""
    partial = partial.select("h", "id", "place", "width").distinct()
    by_doc = partial.groupBy("id", tie_of(F.col("place")).alias("tie")).agg(
        F.collect_list(F.struct("h", start_of(F.col("place")).alias("start"), "width")).alias("regions")
    )
    regions = by_doc.join(texts, ["id", "tie"]).mapInArrow(cut_regions, REGIONS)
    regions = stage_table(regions, "regions")
    large = regions.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("h")
    few = (
        regions.join(large, "h", "left_anti")
        .repartition("h")
        .sortWithinPartitions("h", "id", "place")
        .mapInArrow(later_strings, RUNS)
    )
    strings = regions.join(large, "h").mapInArrow(strings_of, STRINGS)
    first = strings.groupBy("h", "s").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"))
    many = strings.join(first.filter("n > 1"), ["h", "s"]).filter(F.struct("id", "place") > F.col("first"))
    return few.unionByName(many.select("id", "place", F.lit(1).alias("width")))


def tie_of(place: Column) -> Column:
    return F.shiftright(place, TIE_SHIFT)


def start_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << TIE_SHIFT) - 1))


REMOVED = (
    "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
)


def without_runs(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = unpack(batch.column("z")[i].as_py())
                starts = batch.column("starts")[i].values
                widths = batch.column("widths")[i].values
                gone = n_spans = 0
                kept = text
                if starts is not None and len(starts):
                    start = starts.to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], start[order] + widths.to_numpy()[order] + LENGTH - 1
                    reach = np.maximum.accumulate(end)
                    new = np.append(True, start[1:] > reach[:-1])
                    begin, stop = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    gone, n_spans = int((stop - begin).sum()), len(begin)
                    edges = [0, *np.stack([begin, stop], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((batch.column("id")[i].as_py(), len(text), gone, n_spans, digest, kept if keep_bytes else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def with_ties(docs: DataFrame) -> DataFrame:
    """(id, tie, text) of rows with an id or none: the number of a text among the different texts
    of its id, 0 where it has one only. Texts without an id get ids of their own, the least ones.

    Ids with several texts are found, and these texts numbered, from hashes alone; texts are
    shuffled only where there are such ids. One count for each partition comes to the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    hashes = ["h1", "h2"]
    rows = docs.select("id", "text", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("tie"), text).alias("h2"))
    known = rows.select("id", *hashes).distinct()
    several = known.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    several = known.join(several, "id", "left_semi").repartitionByRange("id", *hashes).sortWithinPartitions("id", *hashes)
    several = stage_table(several.withColumn("at", F.monotonically_increasing_id()), "ties")
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in several.groupBy(part).count().collect())
    if not counts:
        return docs.select("id", F.lit(0).cast("bigint").alias("tie"), "text")
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(starts, "part bigint, start bigint"))
    number = (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number")
    several = several.join(starts, part == F.col("part")).select("id", *hashes, number)
    least = several.groupBy("id").agg(F.min("number").alias("least"))
    several = several.join(least, "id").select("id", *hashes, (F.col("number") - F.col("least")).alias("tie"))
    rows = rows.join(several, ["id", *hashes], "left")
    tie, none = F.coalesce("tie", F.lit(0)), F.col("id") == NO_ID
    return rows.select(
        F.when(none, F.lit(NO_ID) + tie).otherwise(F.col("id")).alias("id"),
        F.when(none, 0).otherwise(tie).cast("bigint").alias("tie"),
        "text",
    )


def remove_repeats(docs: DataFrame, batches: int = BATCHES, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes of every
    row. Documents are added in ``batches`` of about as many ids, smallest ids first."""
    spark = docs.sparkSession
    docs = with_ties(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "text"))
    quantiles = [i / batches for i in range(1, batches)]
    cuts = docs.approxQuantile("id", quantiles, 0.01) if batches > 1 else []
    index = SuffixLevels(spark)
    found = []
    lower = None
    for number, upper in enumerate([*map(int, cuts), None], 1):
        part = docs
        if lower is not None:
            part = part.filter(F.col("id") > lower)
        if upper is not None:
            part = part.filter(F.col("id") <= upper)
        found.append(index.add(part, last=number > len(cuts)))
        lower = upper
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    texts = docs.mapInArrow(packed, "id bigint, tie bigint, z binary")
    runs = stage_table(partial_runs(all_found.filter("partial"), texts.dropDuplicates(["id", "tie"])), "runs")
    spans = all_found.filter("copy").select("id", "place", "width").unionByName(runs)
    spans = spans.groupBy("id", tie_of(F.col("place")).alias("tie")).agg(
        F.collect_list(F.struct(start_of(F.col("place")).alias("start"), "width")).alias("spans")
    )
    joined = texts.join(spans, ["id", "tie"], "left").select(
        "id", "z", F.col("spans.start").alias("starts"), F.col("spans.width").alias("widths")
    )
    done = joined.mapInArrow(without_runs(keep_bytes), REMOVED)
    doc_id = F.when(F.col("id") >= NO_ID + NO_IDS, F.col("id")).alias("doc_id")
    return done.select(doc_id, *done.columns[1 if keep_bytes else 1 : None if keep_bytes else -1])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
