"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages; only the bag has a label. Each passage is encoded from its character trigrams and a few
densities, gated attention learns from the documents' labels which passages matter, and the score is a logistic function
of the attention-weighted passage representation.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points a passage, buckets of trigrams, width of a passage's code, and the most labelled rows, and passages of them,
#: learned from.
PASSAGE, BUCKETS, WIDTH, ROWS, PASSAGES = 512, 1 << 13, 16, 3000, 60_000
DENSE = 7


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of a whole text in order, where each passage begins among them, and passages x DENSE densities.

    A text of fewer than three characters is filled with spaces, so every document has a passage.
    """
    text = (text or "").ljust(3)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    h = (h >> np.uint32(32 - 13)).astype(np.intp)
    starts = np.arange(0, len(h), PASSAGE)
    if len(starts) > 1 and len(h) - starts[-1] < PASSAGE // 4:  # a short rest belongs to the passage before it
        starts = starts[:-1]
    sizes = np.diff(np.append(starts, len(h)))
    passage = np.repeat(np.arange(len(starts)), sizes)
    c = c[: len(h)]
    low = c < 128
    kinds = [(c == 32) | (c == 10), low & (c >= 65) & (c <= 90), low & (c >= 97) & (c <= 122), low & (c >= 48) & (c <= 57), ~low]
    dense = np.empty((len(starts), DENSE), np.float32)
    for k, kind in enumerate(kinds):
        dense[:, k] = np.add.reduceat(kind, starts, dtype=np.int64) / sizes
    dense[:, 5] = 1 - dense[:, :5].sum(axis=1)  # punctuation
    seen = np.bincount(passage * 1024 + (h & 1023), minlength=1024 * len(starts)).reshape(-1, 1024)
    dense[:, 6] = (seen > 0).sum(axis=1) / np.minimum(sizes, 1024)  # how little repeats
    return h, starts, dense


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x WIDTH
    dense: np.ndarray  # DENSE x WIDTH
    shift: np.ndarray  # of the densities
    v: np.ndarray  # gate: tanh
    u: np.ndarray  # gate: sigmoid
    w: np.ndarray
    out: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        h, starts, dense = bag(text)
        sizes = np.diff(np.append(starts, len(h)))
        code = np.tanh(np.add.reduceat(self.table[h], starts, axis=0) / sizes[:, None] + (dense - self.shift) @ self.dense)
        gate = (np.tanh(code @ self.v) / (1 + np.exp(-(code @ self.u)))) @ self.w
        a = np.exp(gate - gate.max())
        z = (a / a.sum()) @ code
        return float(1 / (1 + np.exp(-np.clip(z @ self.out + self.bias, -30, 30))))


@dataclass
class Counts:
    """A bag as it is learned from: the distinct buckets of each passage and how often each occurs there."""

    entries: np.ndarray  # distinct buckets by passage
    sizes: np.ndarray  # trigrams by passage
    buckets: np.ndarray
    times: np.ndarray
    dense: np.ndarray

    @staticmethod
    def of(text: str | None) -> Counts:
        h, starts, dense = bag(text)
        sizes = np.diff(np.append(starts, len(h)))
        key, n = np.unique(np.repeat(np.arange(len(starts)), sizes) * BUCKETS + h, return_counts=True)
        entries = np.bincount(key // BUCKETS, minlength=len(starts))
        return Counts(entries.astype("<i4"), sizes.astype("<i4"), (key % BUCKETS).astype("<u2"), n.astype("<u2"), dense.astype("<f4"))

    def packed(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (self.entries, self.sizes, self.buckets, self.times, self.dense))

    @staticmethod
    def unpacked(raw: tuple[bytes, ...]) -> Counts:
        parts = [np.frombuffer(x, t) for x, t in zip(raw, ("<i4", "<i4", "<u2", "<u2", "<f4"))]
        return Counts(*parts[:4], parts[4].reshape(-1, DENSE))


def loss_and_gradients(p: dict[str, np.ndarray], shift: np.ndarray, bags: list[Counts], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean weighted log-loss of the bags, and its gradient by each parameter."""
    counts = np.array([len(b.sizes) for b in bags])
    base = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(base[-1]), np.concatenate([b.entries for b in bags]))
    cols = np.concatenate([b.buckets for b in bags]).astype(np.intp)
    vals = np.concatenate([b.times for b in bags]).astype(np.float32) / np.concatenate([b.sizes for b in bags])[rows].astype(np.float32)
    dense = np.concatenate([b.dense for b in bags]) - shift
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    code = np.tanh(np.add.reduceat(p["table"][cols] * vals[:, None], first, axis=0) + dense @ p["dense"])
    t, s = np.tanh(code @ p["v"]), 1 / (1 + np.exp(-(code @ p["u"])))
    gate = (t * s) @ p["w"]
    doc, begin = np.repeat(np.arange(len(bags)), counts), base[:-1]
    e = np.exp(gate - np.maximum.reduceat(gate, begin)[doc])
    a = e / np.add.reduceat(e, begin)[doc]
    z = np.add.reduceat(a[:, None] * code, begin, axis=0)
    logit = z @ p["out"] + p["bias"]
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / len(bags))
    err = (1 / (1 + np.exp(-logit)) - y) * weight / len(bags)
    g = {"out": z.T @ err, "bias": np.array([err.sum()])}
    dz = err[:, None] * p["out"]
    da = (dz[doc] * code).sum(axis=1)
    dgate = a * (da - np.add.reduceat(a * da, begin)[doc])
    dcode = a[:, None] * dz[doc]
    g["w"] = (t * s).T @ dgate
    dt, ds = dgate[:, None] * p["w"] * s * (1 - t * t), dgate[:, None] * p["w"] * t * s * (1 - s)
    g["v"], g["u"] = code.T @ dt, code.T @ ds
    dcode += dt @ p["v"].T + ds @ p["u"].T
    dcode *= 1 - code * code
    g["dense"] = dense.T @ dcode
    g["table"] = np.stack([np.bincount(cols, weights=vals * dcode[rows, k], minlength=BUCKETS) for k in range(WIDTH)], axis=1)
    return loss, g


#: Passages whose gradients are computed together: what a step holds at once.
PIECE = 512


def batch_gradients(p: dict[str, np.ndarray], shift: np.ndarray, bags: list[Counts], own: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient over the bags `own`, summed up over pieces of some passages."""
    ends = np.cumsum([len(bags[i].sizes) for i in own]) // PIECE
    total: dict[str, np.ndarray] = {}
    for piece in np.unique(ends):
        some = own[ends == piece]
        for k, x in loss_and_gradients(p, shift, [bags[i] for i in some], y[some], weight[some])[1].items():
            x *= len(some) / len(own)
            total[k] = total[k] + x if k in total else x
    return total


def train(bags: list[Counts], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-5, seed: int = 11) -> Model:
    """Fits a model by Adam on the documents' log-likelihood, classes weighted alike."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([b.dense for b in bags])
    shift = everything.mean(axis=0)
    p = {"table": np.zeros((BUCKETS, WIDTH)), "dense": rng.normal(0, 0.5, (DENSE, WIDTH)), "v": rng.normal(0, 0.3, (WIDTH, WIDTH)), "u": rng.normal(0, 0.3, (WIDTH, WIDTH)), "w": rng.normal(0, 0.3, WIDTH), "out": rng.normal(0, 0.3, WIDTH), "bias": np.zeros(1)}
    p["table"] += rng.normal(0, 0.3, p["table"].shape)
    m1, m2, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    y = np.asarray(labels, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            g = batch_gradients(p, shift, bags, order[at : at + batch], y, weight)
            step += 1
            for k, x in g.items():
                x = x + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * x
                m2[k] = 0.999 * m2[k] + 0.001 * x * x
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    f = np.float32
    return Model(p["table"].astype(f), p["dense"].astype(f), shift.astype(f), p["v"].astype(f), p["u"].astype(f), p["w"].astype(f), p["out"].astype(f), float(p["bias"][0]))


def constant(counts: dict[int, int]) -> Model:
    """A model that scores all documents alike: the share of class 1, 1 where nothing is known."""
    zero = np.zeros((WIDTH, WIDTH), np.float32)
    bias = float(np.log(counts[1] / counts[0])) if len(counts) == 2 else -30.0 if 0 in counts else 30.0
    return Model(np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((DENSE, WIDTH), np.float32), np.zeros(DENSE, np.float32), zero, zero, zero[0], zero[0], bias)


def _rest(doc_id: str, fold: int):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(fold))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 3, held_out: int = 1, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality", passages: int = PASSAGES) -> Model:
    """A model from the labelled rows outside the held-out fold.

    `rows` and `passages` bound how many of them, and how many passages of theirs, are learned from, half of each class,
    chosen by a hash of the id, then of the text; an id counts by its smallest label, whatever its repeats. Tasks make the
    bags, and one of them trains on those that are chosen. The bias is moved by the classes' shares among all labelled ids,
    so a score is a probability there. Null labels and labels other than 0
    and 1 don't count; null ids are no labels of a document. Where one class has no labelled document, the model scores all
    alike, by the share of class 1, or 1 where nothing is labelled.
    """
    known = labels.select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("y"), _rest(doc_id, fold).alias("rest")).where((F.col("rest") != held_out) & F.col("y").isin(0, 1)).drop("rest")
    # an id counts once, by its smallest label; so what is broadcast is bounded, and documents are only filtered by it
    known = known.where("l_id IS NOT NULL").groupBy("l_id").agg(F.min("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return constant(counts)
    spread, each = float(1 << 20), rows // 2
    share = F.pmod(F.xxhash64("l_id"), F.lit(1 << 20))
    some = known.where(F.coalesce(*[F.when(F.col("y") == k, share < min(spread, 1.2 * each / n * spread + 1)) for k, n in counts.items()]))
    some = common.least_of(some.withColumn("order", F.xxhash64("l_id")), ["order", "l_id"], each, ["y"])
    near = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
    # documents that repeat an id: the first by a hash of the text
    near = common.least_of(near.withColumn("tie", F.xxhash64("text")), ["order", "l_id", "tie"], each, ["y"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            made = [Counts.of(t) for t in b.column(3).to_pylist()]
            raw = [pa.array(x, pa.binary()) for x in zip(*[m.packed() for m in made])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(m.sizes) for m in made], pa.int64()), *raw], ["row", "l_id", "y", "n", *PARTS])

    near = near.select("l_id", "y", "text")
    made = near.select(F.monotonically_increasing_id().alias("row"), "l_id", "y", "text").mapInArrow(bags, f"row long, l_id long, y int, n long, {', '.join(f'{p} binary' for p in PARTS)}")
    made = common.written(made, "bags")
    sizes, picked = made.select("row", "l_id", "y", "n", F.crc32("buckets").alias("tie")).collect(), []
    for k in (0, 1):  # the first of a class counts whatever its size
        room = passages // 2
        for r in sorted((r for r in sizes if r.y == k), key=lambda r: (hash_of(r.l_id), r.tie, r.row))[:each]:
            room -= r.n
            if room < 0 and picked and picked[-1].y == k:
                break
            picked.append(r)
    if len({r.y for r in picked}) < 2:
        return constant(counts)
    wanted = docs.sparkSession.createDataFrame([(r.row, i) for i, r in enumerate(picked)], "row long, place int")
    model = trained(made.join(F.broadcast(wanted), "row"))
    model.bias += float(np.log(counts[1] / counts[0]))
    return model


def trained(bags: DataFrame) -> Model:
    """A model from the bags (place, y, PARTS), a bounded number of them, in the order of place.

    A task trains it: what that takes goes with the task's process, and the driver gets the model alone.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in common.slices(batches):
            raw = zip(*[b.column(i).to_pylist() for i in range(2, 2 + len(PARTS))])
            rows += [(*r[:2], Counts.unpacked(r[2])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw)]
        if rows:
            rows.sort(key=lambda r: r[0])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2] for r in rows], np.array([r[1] for r in rows])))], pa.binary())], ["model"])

    return pickle.loads(bags.select("place", "y", *PARTS).repartition(1).mapInArrow(learn, "model binary").first().model)


PARTS = ["entries", "sizes", "buckets", "times", "dense"]


def hash_of(x: int | None) -> int:
    return (int(x or 0) * 0x9E3779B97F4A7C15) % (1 << 64)


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", fold: int = 3, held_out: int = 1) -> DataFrame:
    """df with held_out, score (0 to 1) and predicted (1 from 0.5 on). Columns of df with these names are replaced.

    Null texts score as empty ones. Every row is scored by itself, so repeated rows and ties agree.
    """
    df = df.drop("held_out", "score", "predicted").withColumn("held_out", _rest(doc_id, fold) == held_out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            scores = [model.score(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            extra = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, "score", "predicted"])

    schema = common.nullable(df.schema).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return df.mapInArrow(run, schema)
