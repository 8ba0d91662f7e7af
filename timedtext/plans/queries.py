"""One query per operator and job over the supplied tables; see ``oracles``.

Cues come from ``conversations`` (a turn is a cue) and from ``documents`` (eight words
are a cue, so that sentences span cues); the language of a document is its source
language. All rows and whole texts are used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timedtext import schemas
from timedtext.functions import fixed
from timedtext.functions.text import (
    encoded_name,
    flatten_lines,
    glue_lines,
    is_blank,
    is_chinese,
    output_name,
    rstrip,
    uses_spaces,
)
from timedtext.operators import align, batching, compose, encoding, ledger, memory, project
from timedtext.operators import sentences as sen
from timedtext.plans.encode import encode_corpus
from timedtext.plans.translate import (
    Translation,
    read_ledger,
    translate_corpus,
    translate_naive,
    translate_split,
)
from timedtext.session import shared_dir, stage_table
from timedtext.sources.files import (
    decode_files,
    parse_cues,
    parse_status,
    scan_files,
    write_named_files,
)
from timedtext.sources.lines import parse_large_files
from timedtext.sources.tables import cues_from_texts, cues_from_turns, spread
from timedtext.streaming.files import translate_stream

LANGUAGES = ("src_lang", "tgt_lang")
FORMS = ["utf-8", "iso8859-1", "utf-16"]


# --- inputs -----------------------------------------------------------------


def turn_cues(spark: SparkSession, sf: str) -> DataFrame:
    return cues_from_turns(spark.read.parquet(f"{sf}/conversations.parquet"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a target language for each source language."""
    target = (
        F.when(F.col("lang") == "en", "zh-CN")
        .when(F.col("lang") == "fr", "en")
        .when(F.col("lang") == "de", "ja")
        .otherwise("fr")
    )
    return spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select(
        "doc_id", "text", F.col("lang").alias("src_lang"), target.alias("tgt_lang"), "source"
    )


def word_cues(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return cues_from_texts(documents(spark, sf), keep=keep)


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of the documents as numbered lines."""
    flat = documents(spark, sf).withColumn("text", rstrip(flatten_lines("text")))
    return sen.text_sentences(flat, "doc_id").select(
        F.col("doc_id").alias("file_id"),
        F.col("sen").alias("line_no"),
        F.col("sentence").alias("line"),
    )


def language_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the languages of the document."""
    parts = sen.split_sentences(rstrip(flatten_lines("text")))
    return (
        documents(spark, sf)
        .select("doc_id", *LANGUAGES, F.posexplode(parts).alias("pos", "line"))
        .select(
            F.col("doc_id").alias("file_id"),
            (F.col("pos") + 1).cast("bigint").alias("line_no"),
            "line",
            *LANGUAGES,
        )
    )


def stand_in(text: Column) -> Column:
    """What the queries take for a translation: longer than the text, with other commas."""
    return F.replace(
        F.replace(text, F.lit("e"), F.lit("ee")), F.lit(";"), F.lit(fixed.CHINESE_COMMA)
    )


def sentence_memory(spark: SparkSession, sf: str) -> DataFrame:
    """A memory of all document sentences without a comma; the others are misses."""
    return memory.build_memory(
        language_lines(spark, sf)
        .where(~F.contains("line", F.lit(",")))
        .select(*LANGUAGES, F.col("line").alias("text"), stand_in(F.col("line")).alias("translated"))
    )


def cue_memory(spark: SparkSession, sf: str) -> DataFrame:
    """A memory of all glued document cues without a comma."""
    return memory.build_memory(
        word_cues(spark, sf, LANGUAGES)
        .select(*LANGUAGES, glue_lines("content").alias("text"))
        .where(~F.contains("text", F.lit(",")))
        .withColumn("translated", stand_in(F.col("text")))
    )


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the bytes of a file in each of three encodings."""
    text, form = F.col("text"), F.col("form")
    low = F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    wide = F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(text, "UTF-16LE"))
    return (
        documents(spark, sf)
        .select("doc_id", "text", F.explode(F.array(*map(F.lit, FORMS))).alias("form"))
        .select(
            F.concat(F.lit("in/"), F.col("doc_id"), F.lit("-"), form, F.lit(".srt")).alias("path"),
            F.when(form == FORMS[0], text.cast("binary"))
            .when(form == FORMS[1], low)
            .otherwise(wide)
            .alias("content"),
        )
    )


def plain_files(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.concat(F.lit("in/"), F.col("doc_id"), F.lit("-UTF-8.srt")).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )


def ledgers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A ledger from the labelled documents, and later or earlier updates to it."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = documents(spark, sf)

    def path(doc: str) -> Column:
        return F.concat(F.lit("in/"), F.col(doc), F.lit(".srt")).alias("path")

    def row(status: Column, at: Column, doc: str = "doc_id") -> list[Column]:
        good = status == "success"
        return [
            path(doc),
            F.lit("en").alias("src_lang"),
            F.lit("fr").alias("tgt_lang"),
            status.alias("status"),
            F.when(~good, F.concat(F.lit("bad "), status)).alias("message"),
            F.when(good, F.concat(F.lit("out/"), F.col(doc))).alias("output"),
            F.when(good, 100.0).otherwise(0.0).alias("progress"),
            F.timestamp_seconds(at).alias("updated_at"),
        ]

    status = (
        F.when(F.col("quality") == 1, "success")
        .when(F.col("toxic") == 1, "rate_limited")
        .otherwise("error")
    )
    update = F.when(F.col("src_lang") == "en", "success").otherwise("error")
    at = F.when(F.col("src_lang") == "fr", 500).otherwise(2000)
    return labels.select(*row(status, F.lit(1000))), docs.select(*row(update, at))


# --- queries ----------------------------------------------------------------


def flatten_glue(spark: SparkSession, sf: str) -> DataFrame:
    return turn_cues(spark, sf).select(
        "file_id",
        "cue",
        flatten_lines("content").alias("flat"),
        glue_lines("content").alias("glued"),
        is_blank("content").alias("blank"),
    )


def cue_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return sen.cue_offsets(word_cues(spark, sf)).select("file_id", "cue", "cue_end")


def document_text(spark: SparkSession, sf: str) -> DataFrame:
    return sen.document_text(word_cues(spark, sf))


def turn_text(spark: SparkSession, sf: str) -> DataFrame:
    return sen.document_text(turn_cues(spark, sf))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sen.sentences(word_cues(spark, sf), dense=True)


def turn_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sen.sentences(turn_cues(spark, sf), dense=True)


def sentences_v0(spark: SparkSession, sf: str) -> DataFrame:
    return sen.sentences(word_cues(spark, sf), "v0", dense=True)


def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sen.sentence_offsets(
        text_lines(spark, sf).select("file_id", F.col("line_no").alias("sen"), F.col("line").alias("sentence"))
    ).select("file_id", "sen", "sentence", "sen_start", "sen_end")


def align_cues(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_cues(word_cues(spark, sf), dense=True)


def turn_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_cues(turn_cues(spark, sf), dense=True)


def gapped_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Cues with gaps in their numbers, every seventh without content, and for each document
    one cue without a number."""
    cues = word_cues(spark, sf).withColumn("content", F.when(F.col("cue") % 7 != 0, F.col("content")))
    lost = cues.where("cue = 1").withColumn("cue", F.lit(None).cast("bigint"))
    return cues.withColumn("cue", F.col("cue") * 3 + F.col("cue") % 2).unionByName(lost)


def align_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_cues(gapped_cues(spark, sf), block_rows=64)


def align_offsets(spark: SparkSession, sf: str) -> DataFrame:
    ends = sen.cue_offsets(word_cues(spark, sf)).select("file_id", "cue", "cue_end")
    return align.align_offsets(ends, split_sentences(spark, sf))


def alignment_audit(spark: SparkSession, sf: str) -> DataFrame:
    return align.alignment_audit(word_cues(spark, sf), dense=True)


def projected(spark: SparkSession, sf: str, mode: str, **options) -> DataFrame:
    """Every sentence is taken as translated, so that only the cutting is seen."""
    rows = sen.sentence_cues(word_cues(spark, sf), dense=True).withColumn(
        "translated", stand_in(F.col("sentence"))
    )
    return project.project_translation(rows, mode, **options)


def project_compat(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf, "compat")


def project_space(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf, "compat", space=True)


def project_space_v0(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf, "compat", space=True, profile="v0")


def project_words(spark: SparkSession, sf: str) -> DataFrame:
    """Chinese cuts where every character is a word."""
    return projected(
        spark, sf, "compat", chinese=True, words=F.split(F.col("translated"), "", -1)
    )


def project_lossless(spark: SparkSession, sf: str) -> DataFrame:
    return project.join_pieces(projected(spark, sf, "lossless", space=True))


def translate_split_compat(spark: SparkSession, sf: str) -> DataFrame:
    done = translate_split(
        word_cues(spark, sf, LANGUAGES), sentence_memory(spark, sf), mode="compat", dense=True
    )
    return done.select("file_id", "cue", "start_ms", "end_ms", "content", "status")


def translate_split_lossless(spark: SparkSession, sf: str) -> DataFrame:
    done = translate_split(
        word_cues(spark, sf, LANGUAGES), sentence_memory(spark, sf), both=False, dense=True
    )
    return done.select("file_id", "cue", "start_ms", "end_ms", "content", "status")


def naive(spark: SparkSession, sf: str) -> DataFrame:
    done = translate_naive(
        word_cues(spark, sf, LANGUAGES), cue_memory(spark, sf), on_miss="source"
    )
    return done.select("file_id", "cue", "start_ms", "end_ms", "content", "status")


def lookup_translations(spark: SparkSession, sf: str) -> DataFrame:
    found = memory.lookup_translations(
        language_lines(spark, sf), sentence_memory(spark, sf), "line", "null"
    )
    return found.select("file_id", "line_no", "translated")


def memory_misses(spark: SparkSession, sf: str) -> DataFrame:
    return memory.memory_misses(language_lines(spark, sf), sentence_memory(spark, sf), "line")


def translated_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Turns as lines, and per conversation a text whose number of lines may differ."""
    turns = turn_cues(spark, sf)
    texts = sen.document_text(
        turns.withColumn("content", F.regexp_replace("content", r"\n", "|"))
    ).select("file_id", F.replace("plain_text", F.lit("|"), F.lit("\n")).alias("text"))
    lines = turns.select("file_id", F.col("cue").alias("line_no"), F.col("content").alias("line"))
    return lines, texts


def attach_lines(spark: SparkSession, sf: str) -> DataFrame:
    return project.attach_lines(*translated_texts(spark, sf)).select(
        "file_id", "line_no", "translated"
    )


def attach_lines_skip(spark: SparkSession, sf: str) -> DataFrame:
    return project.attach_lines(*translated_texts(spark, sf), on_mismatch="skip").select(
        "file_id", "line_no", "translated"
    )


def count_guard(spark: SparkSession, sf: str) -> DataFrame:
    lines, texts = translated_texts(spark, sf)
    return project.count_guard(lines, project.split_lines(texts))


def compose_content(spark: SparkSession, sf: str) -> DataFrame:
    cues = turn_cues(spark, sf).withColumn("translated", stand_in(glue_lines("content")))
    return project.compose_cues(cues).select("file_id", "cue", "content")


def batch_lines(spark: SparkSession, sf: str) -> DataFrame:
    return batching.batch_lines(text_lines(spark, sf)).select("file_id", "line_no", "batch_no")


def batch_lines_strict(spark: SparkSession, sf: str) -> DataFrame:
    return batching.batch_lines(text_lines(spark, sf), strict=True).select(
        "file_id", "line_no", "batch_no"
    )


def batch_text(spark: SparkSession, sf: str) -> DataFrame:
    return batching.batch_text(text_lines(spark, sf))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return batching.progress(batching.batch_text(text_lines(spark, sf)))


def replace_hook(text: str, src_lang: str, tgt_lang: str) -> str:
    return text.replace("e", "ee").replace(";", "，")


def translate_hook(spark: SparkSession, sf: str) -> DataFrame:
    batches = batching.batch_text(text_lines(spark, sf))
    tagged = batches.withColumn("src_lang", F.lit("en")).withColumn("tgt_lang", F.lit("fr"))
    return batching.translate_with(tagged, replace_hook)


def translate_misses(spark: SparkSession, sf: str) -> DataFrame:
    return batching.translate_misses(memory_misses(spark, sf), replace_hook, buckets=8)


def extract_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses in every layout, and one that is no JSON, around the lines of a turn."""
    lines = F.split("text", "\n", -1)
    pairs = F.transform(lines, lambda s: F.to_json(F.array(s, F.lit("source"))))
    listed = F.concat(
        F.lit("[["), F.array_join(pairs, ","), F.lit(',["tail","source"]],"metadata"]')
    )
    named = F.to_json(F.struct(F.transform(lines, lambda s: F.struct(s.alias("trans"))).alias("sentences")))
    cloud = F.to_json(
        F.struct(
            F.struct(F.array(F.struct(F.col("text").alias("translatedText"))).alias("translations")).alias("data")
        )
    )
    layouts = {"array": listed, "array_all": listed, "sentences": named, "cloud": cloud}
    rows = [F.struct(F.lit(k).alias("layout"), v.alias("raw")) for k, v in layouts.items()]
    rows += [
        F.struct(F.lit("array").alias("layout"), F.concat(F.lit("no json "), "text").alias("raw")),
        F.struct(F.lit("cloud").alias("layout"), F.lit("{}").alias("raw")),
    ]
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    responses = turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
        F.explode(F.array(*rows)).alias("r"),
    ).select("request_id", "r.layout", "r.raw")
    return memory.extract_translations(responses)


def compose_srt(spark: SparkSession, sf: str) -> DataFrame:
    return compose.compose_srt(word_cues(spark, sf))


def parse_srt(spark: SparkSession, sf: str) -> DataFrame:
    """What is composed is parsed again."""
    texts = compose.compose_srt(turn_cues(spark, sf)).withColumn("status", F.lit("success"))
    return parse_cues(texts, "file_id").select(
        "file_id", "cue", "start_ms", "end_ms", "content", "proprietary", "index"
    )


def parse_large_file(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each hundred conversations in one file, read by splits."""
    order = Window.partitionBy("slice").orderBy("file_id", "cue")
    turn = F.to_json(F.struct("file_id", "content"))
    parts = [F.col("cue").cast("string"), F.lit("0:0:1,0 --> 0:0:2,0"), turn, F.lit("")]
    blocks = turn_cues(spark, sf).withColumn("slice", F.expr("file_id div 100")).select(
        "slice", F.struct(F.row_number().over(order).alias("at"), F.concat_ws("\n", *parts).alias("text")).alias("block")
    )
    files = blocks.groupBy("slice").agg(sen.ordered_text(F.col("block"), "\n").alias("content"))
    directory = fresh_dir(spark, "large")
    write_named_files(files.select(F.concat("slice", F.lit(".srt")).alias("path"), "content"), directory)
    rows = parse_large_files(spark, directory)
    told = F.from_json("content", "file_id bigint, content string").alias("told")
    return rows.select(F.col("cue").alias("place"), "index", told).select("place", "index", "told.file_id", "told.content")


def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    cues = turn_cues(spark, sf)
    translated = F.when(F.contains("content", F.lit("\n")), glue_lines("content"))
    return compose.restore_cues(compose.snapshot_cues(cues, translated))


def language_flags(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id",
        "tgt_lang",
        uses_spaces("tgt_lang").alias("space"),
        is_chinese("tgt_lang").alias("chinese"),
    )


def output_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("in/"), "source", F.lit("/show.s"), "doc_id", F.lit(".srt"))
    return documents(spark, sf).select(
        "doc_id",
        output_name(path, F.col("src_lang"), F.col("tgt_lang")).alias("both_name"),
        output_name(path, F.col("src_lang"), F.col("tgt_lang"), False).alias("only_name"),
    )


def encoded_names(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.explode(F.array(*[F.lit("-" + n.upper()) for n in fixed.ENCODINGS]))
    return (
        documents(spark, sf)
        .select("doc_id", tail.alias("tail"))
        .select(
            "doc_id",
            "tail",
            encoded_name(
                F.concat(F.lit("in/file"), "doc_id", "tail", F.lit(".srt")), F.lit("cp874")
            ).alias("name"),
        )
    )


def recommended_encodings(spark: SparkSession, sf: str) -> DataFrame:
    langs = documents(spark, sf).select("doc_id", F.explode(F.array("src_lang", "tgt_lang")).alias("lang"))
    return encoding.recommended_encodings(langs.select("lang").distinct())


def detect_encoding(spark: SparkSession, sf: str) -> DataFrame:
    files = document_files(spark, sf)
    return encoding.detect_encoding(files, **encoding.COMPAT).select("path", "encoding")


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(
        *columns, F.length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("digest")
    )


def transcode_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return digest(encoding.transcode(plain_files(spark, sf), "ascii", "utf-8"), "path", "success")


def transcode_latin1(spark: SparkSession, sf: str) -> DataFrame:
    done = encoding.transcode(plain_files(spark, sf), "iso8859-1", "utf-8")
    return digest(done, "path", "success")


def transcode_fanout(spark: SparkSession, sf: str) -> DataFrame:
    done = encoding.transcode_fanout(plain_files(spark, sf), output_dir="out", source="utf-8")
    return digest(done, "path", "source", "target", "output_path", "success", "skipped")


def conversion_summary(spark: SparkSession, sf: str) -> DataFrame:
    targets = ["utf-8", "cp1252", "no-such-codec"]
    done = encoding.transcode_fanout(plain_files(spark, sf), targets, source="utf-8")
    return ledger.conversion_summary(done)


def pending_files(spark: SparkSession, sf: str) -> DataFrame:
    files = documents(spark, sf).select(
        F.concat(F.lit("in/"), F.col("doc_id"), F.lit(".srt")).alias("path")
    )
    return ledger.pending_files(files, ledgers(spark, sf)[0], "en", "fr")


def ledger_merge(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ledger_merge(*ledgers(spark, sf)).withColumn(
        "updated_at", F.unix_seconds("updated_at")
    )


def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.status_summary(ledgers(spark, sf)[0])


# --- jobs over files ---------------------------------------------------------


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def corpus_files(spark: SparkSession, sf: str) -> str:
    """The conversations as SRT files of a shared directory, and a file that is none."""
    directory = fresh_dir(spark, "corpus")
    texts = compose.compose_srt(turn_cues(spark, sf)).select(
        F.concat(F.lit("talk"), F.col("file_id"), F.lit(".srt")).alias("path"),
        F.col("text").alias("content"),
    )
    bad = turn_cues(spark, sf).groupBy().agg(F.max("content").alias("content"))
    write_named_files(
        texts.unionByName(bad.select(F.lit("bad.srt").alias("path"), "content")), directory
    )
    return directory


def turn_memory(spark: SparkSession, sf: str) -> DataFrame:
    pairs = sen.sentences(turn_cues(spark, sf), dense=True).select(
        F.lit("en").alias("src_lang"),
        F.lit("fr").alias("tgt_lang"),
        F.col("sentence").alias("text"),
        stand_in(F.col("sentence")).alias("translated"),
    )
    return stage_table(memory.build_memory(pairs), "memory")


def file_no(name: Column) -> Column:
    return F.regexp_extract(name, r"talk(\d+)[^/]*\z", 1).try_cast("bigint")


def written_cues(spark: SparkSession, directory: str) -> DataFrame:
    files = decode_files(scan_files(spark, directory, "talk*_en_fr_both.srt"))
    return parse_cues(parse_status(files)).select(
        file_no(F.col("file_id")).alias("file_id"), "cue", "start_ms", "end_ms", "content"
    )


def corpus_job(spark: SparkSession, sf: str) -> Translation:
    return Translation("en", "fr", fresh_dir(spark, "translated"), cut="lossless", sink="files")


def translate_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Files are scanned, decoded, parsed, translated, written, and read back."""
    job = corpus_job(spark, sf)
    translate_corpus(
        spark, corpus_files(spark, sf), turn_memory(spark, sf), job, fresh_dir(spark, "ledger")
    )
    return written_cues(spark, job.output_dir)


def translate_ledger(spark: SparkSession, sf: str) -> DataFrame:
    job = corpus_job(spark, sf)
    done = translate_corpus(
        spark, corpus_files(spark, sf), turn_memory(spark, sf), job, fresh_dir(spark, "ledger")
    )
    return done.select(file_no(F.col("path")).alias("file_id"), "status", "progress")


def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an incremental run."""
    job = corpus_job(spark, sf)
    translate_stream(
        spark,
        corpus_files(spark, sf),
        turn_memory(spark, sf),
        job,
        fresh_dir(spark, "ledger"),
        fresh_dir(spark, "stream"),
    ).awaitTermination()
    return written_cues(spark, job.output_dir)


def encode_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Document files in UTF-8 converted on disk, and read back."""
    source, output = fresh_dir(spark, "plain"), fresh_dir(spark, "encoded")
    files = documents(spark, sf).select(
        F.concat(F.lit("text"), F.col("doc_id"), F.lit(".srt")).alias("path"),
        F.col("text").alias("content"),
    )
    write_named_files(files, source)
    encode_corpus(spark, source, output, ["utf-8-sig", "cp1252"], source="utf-8")
    name = F.regexp_extract("path", r"([^/]*)\z", 1).alias("name")
    return digest(scan_files(spark, output).select(name, "content"), "name")


def detect_lossless(spark: SparkSession, sf: str) -> DataFrame:
    """Detection by default: texts of any length, and a byte-order mark before all else."""
    plain = document_files(spark, sf).select("path", "content")
    marked = plain_files(spark, sf).select(
        F.regexp_replace("path", "UTF-8", "bom").alias("path"),
        F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), "content").alias("content"),
    )
    return encoding.detect_encoding(plain.unionByName(marked)).select("path", "encoding")


def encode_detected(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a byte-order mark, of any length, converted from what is detected."""
    source, output = fresh_dir(spark, "marked"), fresh_dir(spark, "encoded")
    files = documents(spark, sf).select(
        F.concat(F.lit("text"), F.col("doc_id"), F.lit(".srt")).alias("path"),
        F.concat(F.lit("\ufeff"), "text").alias("content"),
    )
    write_named_files(files, source)
    encode_corpus(spark, source, output, ["utf-8"])
    name = F.regexp_extract("path", r"([^/]*)\z", 1).alias("name")
    return digest(scan_files(spark, output).select(name, "content"), "name")


def ledger_rows(done: DataFrame) -> DataFrame:
    return done.select(file_no(F.col("path")).alias("file_id"), "tgt_lang", "status", "progress")


def german(known: DataFrame) -> DataFrame:
    return known.withColumn("tgt_lang", F.lit("de"))


def ledger_two_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams for two language pairs write one ledger; no row is lost."""
    source, path, known = corpus_files(spark, sf), fresh_dir(spark, "ledger"), turn_memory(spark, sf)
    for target, pairs in (("fr", known), ("de", german(known))):
        job = Translation("en", target, fresh_dir(spark, "translated"))
        translate_stream(spark, source, pairs, job, path, fresh_dir(spark, "stream")).awaitTermination()
    return ledger_rows(read_ledger(spark, path))


def ledger_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Batch, stream and batch on one ledger: what is done is not done again, so every file
    with a success has one row in it."""
    source, path, known = corpus_files(spark, sf), fresh_dir(spark, "ledger"), turn_memory(spark, sf)
    job = corpus_job(spark, sf)
    translate_corpus(spark, source, known, job, path, pattern="*[0-4].srt")
    translate_stream(spark, source, known, job, path, fresh_dir(spark, "stream")).awaitTermination()
    translate_corpus(spark, source, known, job, path)
    rows = spark.read.parquet(path).where("status = 'success'")
    return rows.groupBy(file_no(F.col("path")).alias("file_id")).agg(F.count("*").alias("n_rows"))


def translate_all_missed(spark: SparkSession, sf: str) -> DataFrame:
    """A memory of another language pair: nothing is translated, and nothing is a success."""
    job = Translation("en", "fr", fresh_dir(spark, "translated"), both=False)
    known = german(turn_memory(spark, sf))
    done = translate_corpus(spark, corpus_files(spark, sf), known, job, fresh_dir(spark, "ledger"))
    return ledger_rows(done).withColumn("no_output", F.lit(done.where("output IS NOT NULL").isEmpty()))


def same_name_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one name in two folders give two outputs, in folders of the same names."""
    source = fresh_dir(spark, "corpus")
    texts = compose.compose_srt(turn_cues(spark, sf)).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("folder"), "file_id", "text"
    )
    path = F.concat("folder", F.lit("/talk"), F.col("file_id"), F.lit(".srt"))
    write_named_files(texts.select(path.alias("path"), F.col("text").alias("content")), source)
    job = corpus_job(spark, sf)
    translate_corpus(
        spark, source, turn_memory(spark, sf), job, fresh_dir(spark, "ledger"), recursive=True
    )
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*\z", 1).alias("folder")
    written = scan_files(spark, job.output_dir, recursive=True)
    return written.select(folder, file_no(F.col("path")).alias("file_id"))


def translate_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Written by Spark's text sink, a folder per file, and read back."""
    job = Translation("en", "fr", fresh_dir(spark, "translated"))
    translate_corpus(
        spark, corpus_files(spark, sf), turn_memory(spark, sf), job, fresh_dir(spark, "ledger")
    )
    parts = decode_files(scan_files(spark, job.output_dir, "part-*", recursive=True))
    name = F.regexp_extract("path", r"output=([^/]*)", 1)
    files = parts.groupBy(file_no(name).alias("file_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda p: p["text"]), "").alias("text"),
        F.max("status").alias("status"),
    )
    return parse_cues(files, "file_id").select("file_id", "cue", "start_ms", "end_ms", "content")


def translate_directory_hook(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a directory with an empty memory: all sentences go to the user's translator."""
    job = corpus_job(spark, sf)
    empty = turn_memory(spark, sf).where("false")
    translate_corpus(
        spark, corpus_files(spark, sf), empty, job, fresh_dir(spark, "ledger"), hook=replace_hook
    )
    return written_cues(spark, job.output_dir)


def translate_directory_naive(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a directory, translated cue by cue, and read back."""
    lines = turn_cues(spark, sf).select(
        F.lit("en").alias("src_lang"), F.lit("fr").alias("tgt_lang"), glue_lines("content").alias("text")
    )
    known = stage_table(memory.build_memory(lines.withColumn("translated", stand_in(F.col("text")))), "memory")
    job = Translation("en", "fr", fresh_dir(spark, "translated"), mode="naive", sink="files")
    translate_corpus(spark, corpus_files(spark, sf), known, job, fresh_dir(spark, "ledger"))
    return written_cues(spark, job.output_dir)


def same_output_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs with files of the same names from two folders and one output folder: the
    output stays with the input that wrote it first, and the other one is an error."""
    first, second = corpus_files(spark, sf), corpus_files(spark, sf)
    job, path, known = corpus_job(spark, sf), fresh_dir(spark, "ledger"), turn_memory(spark, sf)
    translate_corpus(spark, first, known, job, path)
    translate_corpus(spark, second, known, job, path)
    done = translate_corpus(spark, first, known, job, path, resume=False)
    return done.select(
        F.contains("path", F.lit(first.rsplit("/", 1)[1])).alias("first"),
        file_no(F.col("path")).alias("file_id"),
        "status",
        F.col("output").isNotNull().alias("written"),
    )


def hook_called_once(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files by a batch run, all by a stream, all once more without the ledger: how
    often the user's translator has been asked for each sentence."""
    source, job = corpus_files(spark, sf), corpus_job(spark, sf)
    learned, path = fresh_dir(spark, "learned"), fresh_dir(spark, "ledger")
    empty = spark.createDataFrame([], schemas.MEMORY)
    options = {"hook": replace_hook, "learned_path": learned}
    translate_corpus(spark, source, empty, job, path, pattern="*[0-4].srt", **options)
    translate_stream(spark, source, empty, job, path, fresh_dir(spark, "stream"), **options).awaitTermination()
    translate_corpus(spark, source, empty, job, path, resume=False, **options)
    asked = spark.read.parquet(learned).groupBy("text").agg(F.count("*").alias("n_calls"))
    known = memory.read_learned(spark, learned).select("text", "translated")
    return asked.join(known, "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        flatten_glue,
        cue_offsets,
        document_text,
        turn_text,
        sentences,
        turn_sentences,
        sentences_v0,
        split_sentences,
        align_cues,
        turn_alignment,
        align_gaps,
        align_offsets,
        alignment_audit,
        project_compat,
        project_space,
        project_space_v0,
        project_words,
        project_lossless,
        translate_split_compat,
        translate_split_lossless,
        lookup_translations,
        memory_misses,
        attach_lines,
        attach_lines_skip,
        count_guard,
        compose_content,
        batch_lines,
        batch_lines_strict,
        batch_text,
        progress,
        translate_hook,
        translate_misses,
        extract_responses,
        compose_srt,
        parse_srt,
        parse_large_file,
        snapshot_roundtrip,
        language_flags,
        output_names,
        encoded_names,
        recommended_encodings,
        detect_encoding,
        transcode_ascii,
        transcode_latin1,
        transcode_fanout,
        conversion_summary,
        pending_files,
        ledger_merge,
        status_summary,
        translate_directory,
        translate_ledger,
        stream_files,
        encode_directory,
        detect_lossless,
        encode_detected,
        ledger_two_pairs,
        ledger_mixed,
        translate_all_missed,
        same_name_inputs,
        translate_parts,
        translate_directory_hook,
        translate_directory_naive,
        same_output_two_runs,
        hook_called_once,
    )
} | {"translate_naive": naive}
