"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are trained with follow-the-regularised-leader under an elastic-net penalty, so most of them are exactly zero,
and a temperature fitted on rows left out of training makes the probabilities honest. Document frequencies are counted
over all rows that may be learned from; the weights come from a bounded number of rows a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Buckets of hashed n-grams, their lengths, the most rows a language that weights are trained on, the most in all, the
#: most languages, and the most bytes of features in all.
BUCKETS, LENGTHS, ROWS, TOTAL, LANGUAGES, VOLUME = 1 << 14, (1, 2, 3), 600, 12_000, 500, 100 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams, in order, and their counts. The whole text counts, in lower case."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for n in LENGTHS:
        if len(c) >= n:
            h = c[: len(c) - n + 1] * _MULTIPLIERS[0] + np.uint32(n)
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[k] + c[k : len(c) - n + 1 + k]
            parts.append((h * _MULTIPLIERS[2]) >> np.uint32(32 - 14))
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS) if parts else np.zeros(BUCKETS, np.int64)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values."""
    x = np.log1p(counts) * idf[found]
    return x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; UNKNOWN and 0 for a text without letters, or where nothing was learned."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        found, counts = grams(text)
        p = softmax(self.logits(found, weigh(found, counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal; rows: buckets, values, class."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found, values, y = rows[i]
            at = np.append(found, BUCKETS)
            x = np.append(values, 1.0)
            w = weights(z[at], n[at], l1, l2)
            w[-1] = weights(z[BUCKETS], n[BUCKETS], 0.0, 0.0)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weights(z, n, l1, l2)
    return w[:BUCKETS], weights(z[BUCKETS], n[BUCKETS], 0.0, 0.0)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on rows left out, from a fixed grid."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 5.0, 81)
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def learnable(df: DataFrame, doc_id: str, text: str, lang: str, fold: int, held_out: int) -> DataFrame:
    rest = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(fold))
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("order"), rest.alias("rest"))
    return rows.where((F.col("rest") != held_out) & F.col("text").isNotNull() & F.col("lang").isNotNull()).drop("rest")


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of each bucket and the number of documents, over all rows.

    Each task counts into one array; a few tasks add up the arrays, and the driver adds up those.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in common.slices(batches):
            for t in b.column(0).to_pylist():
                df[grams(t)[0]] += 1
                df[BUCKETS] += 1
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["task", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in common.slices(batches):
            for raw in b.column(0).to_pylist():
                df += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], ["df"])

    by_task = rows.select("text").mapInArrow(count, "task long, df binary").repartition(8, "task")
    total = np.zeros(BUCKETS + 1, np.int64)
    for r in by_task.select("df").mapInArrow(add, "df binary").collect():  # 8 arrays
        total += np.frombuffer(r.df, np.int64)
    return total[:BUCKETS], int(total[BUCKETS])


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 4, held_out: int = 2, rows: int = ROWS, most: int = LANGUAGES, total: int = TOTAL, volume: int = VOLUME) -> Model:
    """A model of df's languages, from the rows with a text and a language outside the held-out fold.

    `rows` bounds how many of a language weights are trained on, `total` how many in all, and `volume` the bytes of their
    features, of which each language has an equal share (its first row counts whatever its size). They are chosen by a
    hash of id and text in the tasks, so what the driver gets is bounded however often an id stands there. A fifth of
    them is left for the temperature. The `most` languages with the most rows are learned; ties by name. Repeated rows
    count as often as they stand there, whole texts are counted, and an empty table has no such rows. Without such rows
    the model knows no language.
    """
    given = learnable(df, doc_id, text, lang, fold, held_out)
    by_lang = given.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most)
    counts = {r.lang: r.n for r in by_lang.collect()}
    languages = sorted(counts)
    rows = min(rows, max(1, total // max(1, len(languages))))
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    df_counts, n = frequencies(given)
    idf = np.log((1 + n) / (1 + df_counts)) + 1
    # at most `most` rows: about half as many again as wanted pass by their hash, then the first by hash are taken
    shares = df.sparkSession.createDataFrame([(x, min(1.0, 1.5 * rows / counts[x] + 1e-6)) for x in languages], "lang string, share double")
    some = given.join(F.broadcast(shares), "lang").where(F.pmod("order", F.lit(1 << 20)) / float(1 << 20) < F.col("share"))
    some = common.least_of(some.select("lang", "text", "order"), ["order"], rows, ["lang"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            got = [grams(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([f.astype("<i4").tobytes() for f, _ in got], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary())], ["lang", "order", "found", "counts"])

    made = common.written(some.select("text", "lang", "order").mapInArrow(featured, "lang string, order long, found binary, counts binary"), "grams")
    so_far = Window.partitionBy("lang").orderBy("order", "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = made.withColumn("bytes", F.sum(F.length("found") + F.length("counts")).over(so_far)).withColumn("k", F.row_number().over(so_far))
    sample = bounded.where((F.col("bytes") <= volume // len(languages)) | (F.col("k") == 1)).drop("bytes", "k").collect()  # `total` rows, `volume` bytes
    data, rest = [], []
    for i, x in enumerate(languages):
        for k, r in enumerate(sorted((r for r in sample if r.lang == x), key=lambda r: (r.order, r.found))):
            found = np.frombuffer(r.found, "<i4")
            row = (found, weigh(found, np.frombuffer(r.counts, "<i4"), idf), i)
            (rest if k % 5 == 4 else data).append(row)
    weights, bias = train(data, len(languages))
    model = Model(languages, idf, weights.astype(np.float32), bias)
    model.temperature = temperature(np.array([model.logits(f, v) for f, v, _ in rest]), np.array([y for _, _, y in rest], int))
    return model


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", fold: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of df; null texts and texts without letters: und, 0.

    Each row is predicted by itself from its whole text, so repeated rows agree; an empty table has an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            got = [model.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], schema=schema)

    rest = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(fold))
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), (rest == held_out).alias("held_out"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
