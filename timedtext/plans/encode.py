"""Encoding conversion of directories of subtitle files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.operators.claims import claim_outputs
from timedtext.operators.encoding import read_text, target_encodings, transcode_fanout
from timedtext.session import stage_table
from timedtext.sources.files import check_mounted, relative_folder, scan_files, write_named_files


def encode_corpus(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    targets: Sequence[str] | None = None,
    recommended_for: str | None = None,
    everything: bool = False,
    source: Column | str | None = None,
    pattern: str = "*.srt",
    skip_same: bool = True,
    recursive: bool = False,
    **detection,
) -> DataFrame:
    """Converts every file to every target; gives one row per file and target.

    Files are read and decoded once, into a staged table of texts; the files and the result both
    come from it. What becomes of a conversion is decided on rows without its content. The staged
    texts are then converted again to be written, without the rows that were refused; Spark
    broadcasts these while they are few, so that no content is shuffled.

    Files keep their folder below the input directory. Where two inputs would
    give one output, none is written and both fail; an output that an input of an earlier run
    has claimed is that input's, and any other one fails. ``detection`` has the options of
    ``detect_encoding``.
    """
    check_mounted(output_dir)
    wanted = target_encodings(targets, recommended_for, everything)
    files = scan_files(spark, input_dir, pattern, recursive).select("path", "content")
    texts = stage_table(read_text(files, source, **detection), "texts", "zstd")
    name = F.regexp_extract("output_path", r"([^/]*)\z", 1)
    converted = transcode_fanout(texts, wanted, skip_same=skip_same).withColumn(
        "output_path", F.concat(relative_folder(F.col("path"), [input_dir]), name)
    )
    made = F.col("content").isNotNull().alias("made")
    done = stage_table(
        converted.select("path", "source", "target", "output_path", "success", "skipped", made), "conversions"
    )
    shared = done.where("made").groupBy("output_path").agg(F.count("*").alias("n"))
    shared = shared.where("n > 1").select("output_path", F.lit(True).alias("shared"))
    done = done.join(shared, "output_path", "left").withColumn(
        "success", F.col("success") & (F.col("shared").isNull() | F.col("skipped"))
    )
    claimed = done.where("made AND shared IS NULL")
    claimed = claimed.select(F.col("output_path").alias("output"), F.col("path").alias("input"))
    claims = claim_outputs(claimed, output_dir, uuid.uuid4().hex)
    done = done.join(claims.withColumnRenamed("output", "output_path"), "output_path", "left")
    lost = F.col("made") & F.col("shared").isNull() & (F.col("owner") != F.col("path"))
    done = done.withColumn("lost", F.coalesce(lost, F.lit(False)))
    done = done.withColumn("success", F.col("success") & ~F.col("lost"))
    done = stage_table(done, "outcomes")
    # of a target that is no codec nothing is made, and no row of it needs to be refused by name
    codecs = [row.target for row in done.where("made").select("target").distinct().collect()]
    tried = ~F.col("skipped") & F.col("target").isin(codecs)
    refused = done.where(tried).where("NOT made OR shared OR lost").select("path", "target").distinct()
    refused = stage_table(refused, "refused")
    written = converted.where(tried).join(refused, ["path", "target"], "left_anti")
    write_named_files(written.select(F.col("output_path").alias("path"), "content"), output_dir)
    return done.select("path", "source", "target", "output_path", "success", "skipped")
