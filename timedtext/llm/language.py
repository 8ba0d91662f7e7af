"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams of two to four bytes, spaces marking
word edges; a linear softmax on it gives the language. Both are trained by stochastic gradient
descent in numpy on a sample of at most ``SAMPLE`` labelled documents, those with the smallest
hashes of their ids. A fifth of the sample calibrates: a temperature for the scores, and a
threshold below which a prediction is marked as rejected.

Prediction reads whole texts and nothing else. The product of embeddings and weights is one row
of numbers for each of the ``BUCKETS`` buckets; it is what is broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text
if there is nothing to learn from. A row without ``doc_id`` is not learned from and not held out.
Repeated rows get a result each. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import table

SAMPLE = 3000
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
STEPS = 12_000  # a small sample is gone through more often, up to so many steps
RATE = 0.5
ACCEPTED = 0.995  # share of right calibration rows that the threshold accepts
NONE = "und"
CHUNK_BYTES = 256 * 1024
PAD = 3
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def buckets_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the grams of 2, 3 and 4 bytes from each byte on; each text's first and last
    byte, end excluded. No gram reaches from one text into the next."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b"    " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    shift = np.uint64(8)
    gram = (data[:-1] << shift) | data[1:]
    out = []
    for n in (2, 3, 4):
        if n > 2:
            gram = (gram[:-1] << shift) | data[n - 1 :]
        key = (gram + (np.uint64(n) << np.uint64(40))) * SPREAD
        out.append((key >> np.uint64(64 - 15)).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    return out, starts, ends - PAD


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    part, size, first = [], 0, 0
    for i in range(batch.num_rows):
        part.append(batch.column(column)[i].as_py() or "")
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, distinct buckets and their shares of a text."""
    for batch in batches:
        for first, texts in chunks(batch, 1):
            grams, start, end = buckets_of(texts)
            at, share = [], []
            for a, b in zip(start, end, strict=True):
                found, n = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
                at.append(found.astype(np.int32))
                share.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(texts)),
                    pa.array(at, pa.list_(pa.int32())),
                    pa.array(share, pa.list_(pa.float32())),
                ],
                names=["lang", "at", "share"],
            )


class Model:
    """Languages, one row of logits per bucket, temperature and threshold."""

    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray):
        self.languages, self.logits, self.bias = languages, logits, bias
        self.temperature, self.threshold = 1.0, 0.0

    def scores(self, raw: np.ndarray) -> np.ndarray:
        x = (raw + self.bias) / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """Gradient descent, one text at a time; every fifth row calibrates if there are enough."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(9)
    inner = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    outer = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    apart = len(rows) >= 50
    fit = [r for i, r in enumerate(rows) if not apart or i % 5]
    check = [r for i, r in enumerate(rows) if apart and not i % 5] or rows
    epochs = max(EPOCHS, min(200, STEPS // len(fit)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            lang, at, share = fit[i]
            mean = share @ inner[at]
            x = mean @ outer + bias
            x = np.exp(x - x.max())
            x /= x.sum()
            x[number[lang]] -= 1
            back = outer @ x
            outer -= rate * np.outer(mean, x)
            bias -= rate * 0.1 * x
            # shares are small, so a gram's own step is taken per text, not per gram
            inner[at] -= rate * np.outer(share / share.max(), back)
    model = Model(languages, (inner @ outer).astype(np.float32), bias)
    raw = np.stack([share @ model.logits[at] for _, at, share in check])
    truth = np.array([number[r[0]] for r in check])
    rows_at = np.arange(len(check))

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -np.log(model.scores(raw)[rows_at, truth] + 1e-12).mean()

    model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    scores = model.scores(raw)
    right = scores.argmax(1) == truth
    if right.any():
        model.threshold = float(np.quantile(scores[right].max(1), 1 - ACCEPTED))
    return model


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"


def predicting(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for first, texts in chunks(batch, 2):
                part = batch.slice(first, len(texts))
                known = np.array(part.column(3).to_pylist(), bool)
                names, score = np.full(len(texts), NONE, object), np.zeros(len(texts))
                if m and known.any():
                    grams, start, end = buckets_of(texts)
                    bounds = np.stack([start, end], 1).ravel()
                    raw = np.zeros((len(texts), len(m.languages)))
                    for lang in range(len(m.languages)):
                        weight = np.ascontiguousarray(m.logits[:, lang])
                        for g in grams:
                            values = np.append(weight[g], np.float32([0, 0, 0]))
                            raw[:, lang] += np.add.reduceat(values, bounds, dtype=np.float64)[::2]
                    found = m.scores(raw / (3 * (end - start))[:, None])
                    best = found.argmax(1)
                    names = np.where(known, np.array(m.languages, object)[best], NONE)
                    score = np.where(known, found.max(1), 0.0)
                accepted = known & (score >= (m.threshold if m else 2))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(names, pa.string()),
                        pa.array(score),
                        pa.array(accepted),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    return run


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the columns (doc_id, lang, text), from a bounded sample of their rows."""
    rows = (
        docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
        .select("lang", "text", F.xxhash64("doc_id").alias("turn"), F.xxhash64("text").alias("tie"))
        .orderBy("turn", "tie", "lang")
        .limit(sample)
        .select("lang", "text")
        .mapInArrow(counted, "lang string, at array<int>, share array<float>")
    )
    return train(
        [
            (lang.as_py(), at.values.to_numpy(), share.values.to_numpy())
            for batch in rows.toArrow().to_batches()
            for lang, at, share in zip(*batch.columns, strict=True)
        ]
    )


def identify(docs: DataFrame, held_out: Column, model: Model | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "text",
        has_letter(F.col("text")).alias("known"),
    ).mapInArrow(predicting(shared), PREDICTED)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs.filter(~held_out))
    return identify(docs, held_out, model)
