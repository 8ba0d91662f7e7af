"""Schemas of the tables that operators exchange.

``cue`` is the 1-based position in its file, without gaps. Positions are BIGINT, for
one file may hold very many cues. Times are milliseconds.
"""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

CUES = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("cue", T.LongType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("proprietary", T.StringType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("proprietary", T.StringType()),
        T.StructField("translated_content", T.StringType()),
    ]
)

MEMORY = T.StructType(
    [
        T.StructField("src_lang", T.StringType()),
        T.StructField("tgt_lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("translated", T.StringType()),
    ]
)

# A memory row that a run has learned from the user's translator.
LEARNED = T.StructType(
    [
        *MEMORY.fields,
        T.StructField("learned_at", T.TimestampType()),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("output", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("claimed_at", T.TimestampType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("layout", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("src_lang", T.StringType()),
        T.StructField("tgt_lang", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("progress", T.DoubleType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
