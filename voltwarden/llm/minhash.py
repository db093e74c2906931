"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A set's sketch has COORDINATES bins. In each round every shingle is hashed to one bin and offers its hash there; a bin keeps
the least hash of the earliest round that reached it. Small sets need many rounds, large ones one or two. After as many
rounds as there are bins, a bin that is still empty takes the least hash of the whole set under a hash function of its own,
so every coordinate is filled whatever the size. Two sets agree in a coordinate with the probability of their Jaccard
similarity, and the number of coordinates they agree in keeps as near to its mean as with independent ones.

Bands of ROWS coordinates are joined. At 0.85 a band agrees with probability 0.61, so none of 64 does in 4e-27 of all
links. A band that few texts share gives all their pairs; one that many share gives each text a link to one of them. Pairs
whose sketches agree too rarely are dropped (5e-22 of all links are), the others are confirmed on their full sets, and
links make components. A common band then matters only if texts of different components share it. A text with at least
UNCOMMON other bands has each of its links in one of those, but for 1e-15; the few with less are compared by their rarest
shingles, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard
from .components import connected, merged
from .shingles import class_id, mix, shingle_set

#: Coordinates a sketch, coordinates a band, coordinates that linked sets agree in at least, and bands that a text must have
#: besides those that many texts of different components share, so that none of its links is missed.
COORDINATES, ROWS, AGREE, UNCOMMON = 192, 3, 105, 37
BANDS = COORDINATES // ROWS
_U = np.uint64
_SEEDS = np.random.default_rng(31).integers(1, 1 << 63, 2 * COORDINATES, dtype=np.uint64) | _U(1)
_LOW = _U((1 << 48) - 1)
#: Rounds are computed together until so many hashes are there. An offer is a number of a bin, a round and 48 bits of the hash.
CHUNK = 3 << 9


def sketch(s: np.ndarray) -> np.ndarray:
    """The set's COORDINATES as 32-bit fingerprints; s: distinct hashes, at least one."""
    filled = np.zeros(COORDINATES, bool)
    out = np.zeros(COORDINATES, np.uint64)
    at = 0
    while at < COORDINATES and not filled.all():
        rounds = min(COORDINATES - at, max(1, CHUNK // len(s)))
        h = mix(s[None, :] ^ _SEEDS[at : at + rounds, None])
        bins = ((h >> _U(32)) * _U(COORDINATES)) >> _U(32)
        offers = (bins << _U(56)) | (np.arange(rounds, dtype=np.uint64)[:, None] << _U(48)) | (h & _LOW)
        offers = np.sort(offers, axis=None)
        place = (offers >> _U(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        first = first[~filled[place[first]]]
        out[place[first]] = offers[first] + _U(at)
        filled[place[first]] = True
        at += rounds
    for j in np.flatnonzero(~filled):  # a hash function of its own
        out[j] = mix(s ^ _SEEDS[COORDINATES + j]).min()
    return mix(out).astype(np.uint32)


def bands(coordinates: np.ndarray) -> np.ndarray:
    """The keys of the bands of sketches (rows), one column a band."""
    c = coordinates.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), c.shape[:2])
    for k in range(ROWS):
        key = mix(key * _SEEDS[0] + c[:, :, k] + _U(1))
    return key


def band_blocks(classes: DataFrame, parts: int) -> DataFrame:
    """part, cids, keys, bands: the bands of all classes in blocks by part of the join."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for b in common.slices(batches):
            keys = bands(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES))
            for cid, own in zip(b.column(0).to_pylist(), keys):
                yield cid, 0, own

    return classes.select("cid", "sketch").mapInArrow(lambda batches: jaccard.blocked(keyed(batches), parts), jaccard.BLOCKS)


def describe(df: DataFrame, size: int) -> DataFrame:
    """doc_id, n, cid, sketch: size and class of each text's set; the sketch stands in one row a task and class."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for texts, docs in common.texts_of(batches, "text", "doc_id"):
            rows = []
            for doc, t in zip(docs, texts):
                s = shingle_set(t, size)
                cid = class_id(s) if len(s) else None
                new = cid is not None and cid not in seen
                if new:
                    seen.add(cid)
                rows.append((doc, len(s), cid, sketch(s).tobytes() if new else None))
            yield common.arrow_rows(schema, rows)

    return df.mapInArrow(run, "doc_id long, n long, cid long, sketch binary")


def near(pairs: DataFrame, classes: DataFrame, rule: jaccard.Rule) -> DataFrame:
    """a, b, far: the pairs whose sizes and sketches allow a link; far: coordinates in which they differ."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in common.slices(batches):
            s, t = (np.frombuffer(b"".join(r.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            far = (s != t).sum(axis=1, dtype=np.int64)
            ok = pa.array(np.flatnonzero(far <= COORDINATES - AGREE))
            yield pa.RecordBatch.from_arrays([r.column(0).take(ok), r.column(1).take(ok), pa.array(far).take(ok)], ["a", "b", "far"])

    sized = pairs.join(left, "a").join(right, "b").where(F.expr(f"100 * least(n_a, n_b) >= {rule.percent} * greatest(n_a, n_b)"))
    return sized.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, far long")


def left_over(hot: DataFrame, labels: DataFrame) -> DataFrame:
    """cid, label of the classes with fewer than UNCOMMON bands besides those that classes of different components share."""
    known = hot.select(F.col("a").alias("word"), F.col("b").alias("cid")).distinct().join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = known.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("word")
    shared = jaccard.salted(known, mixed, "word").groupBy("cid", "label").agg(F.count("*").alias("common"))
    return shared.where(BANDS - F.col("common") < UNCOMMON).select("cid", "label")


def with_parity(short: DataFrame, given: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """classes (cid, rep, n, sketch) of the short ones, with parity sketches of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            made = [jaccard.bit_sketch(np.frombuffer(x, np.uint64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["cid", "sketch"])

    sets = jaccard.sets_of(short.select("cid"), given, classes, size).mapInArrow(run, "cid long, sketch binary")
    return common.written(classes.select("cid", "rep", "n").join(sets, "cid"), "parity")


def nearest_first(pairs: DataFrame, labels: DataFrame | None, given: DataFrame, classes: DataFrame, size: int, rule: jaccard.Rule) -> tuple[DataFrame, DataFrame]:
    """(node, label once the most alike other class of each class is verified; the other pairs a, b, far whose classes are still apart).

    A pair within one component changes nothing, so of a large group most pairs are never verified.
    """
    ends = pairs.select(F.col("b").alias("x"), "a", "b", "far").unionByName(pairs.select(F.col("a").alias("x"), "a", "b", "far"))
    first = common.written(ends.groupBy("x").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "first")
    links = jaccard.verified(first, given, classes, size, rule)
    labels = connected(links) if labels is None else merged(labels, links)
    return labels, common.written(jaccard.apart(pairs.join(first, ["a", "b"], "left_anti"), labels), "left")


def component_labels(given: DataFrame, classes: DataFrame, size: int, rule: jaccard.Rule) -> DataFrame:
    """node, label of the classes that are linked with another."""
    parts = max(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count() * BANDS // jaccard.PART, 1)
    blocks = band_blocks(classes, parts)
    found = jaccard.shared(blocks, parts)
    pairs = common.written(near(found.where("NOT hot").select("a", "b").distinct(), classes, rule), "near")
    labels, left = nearest_first(pairs, None, given, classes, size, rule)
    labels = merged(labels, jaccard.verified(left, given, classes, size, rule))
    short = common.written(left_over(found.where("hot").select("a", "b"), labels), "short")
    if short.limit(1).count():
        own = with_parity(short, given, classes, size)
        rest = common.written(jaccard.near(jaccard.shingle_pairs(short, given, own, size, rule), own, rule), "near")
        labels, left = nearest_first(rest, labels, given, classes, size, rule)
        labels = merged(labels, jaccard.verified(left, given, classes, size, rule))
    return labels


def near_duplicates(df: DataFrame, size: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df; kept: the row's id is its component's smallest.

    Rows without words (null, empty, white space) have no shingle and are linked with nothing: their component is their
    own id. Rows that repeat an id, or a text, are in one component, and all rows with its smallest id are kept; a
    component without any id has none, and all of its rows are kept. Other columns play no part. An empty table has an
    empty result. `percent` is 80 or more; the probabilities above are those of 85, and better beyond.
    """
    if percent < 85:
        raise ValueError("bands are dealt for a threshold of 0.85 or more")
    spark, rule = df.sparkSession, jaccard.Rule(percent)
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = common.written(describe(given, size), "sets")
    classes = docs.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = common.written(classes, "classes")
    with common.scope(spark):  # what the rounds leave is not needed after them
        labels = common.written(component_labels(given, classes, size, rule), "labels", keep=True)
    named = classes.select("cid", "rep").join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = named.select("cid", "label").join(lowest, "label").select(F.col("cid").alias("c"), "component_id")
    out = docs.select("doc_id", "n", "cid").join(by_class, F.col("cid") == F.col("c"), "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


#: The same rows in SQL, over a table `documents` whose ids are distinct: all pairs of documents that share a shingle.
SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS s
  FROM worded, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id
  FROM documents d LEFT JOIN sizes USING (doc_id))
SELECT *, doc_id = component_id AS kept FROM named
"""
