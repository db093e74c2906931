"""N-gram Jaccard join by parity sketches.

A text is the set of its shingles' hashes. Texts with the same set are one class. Sets are XOR-hashed into sketches: a
shingle flips one bit of a bit sketch, so the Hamming distance of two sketches is at most the sets' symmetric difference;
and it is XORed into one of m words of a wide sketch, so at most as many words differ. Two sets are linked when their
Jaccard similarity is at least the threshold, which bounds their symmetric difference by (|A| + |B|) / 9 for 0.8. By the
pigeonhole principle, m words of which at most d differ leave m - d that agree: a join on words finds every link.

m must be the same for both sets, so it belongs to a band of sizes. Linked sets lie in one band or in neighbouring ones:
each set has the words of its own band and those of the next. A word into which no shingle fell says nothing, and is left
out where m - d words are more than the empty ones; else it is kept.

Words that few classes share give all their pairs. Words that many share (large groups of near copies, common passages)
give each class a link to one of them only; once those links and all others are verified and joined into components,
such a word matters only if classes of different components share it. For these, the same counting argument is made
again: a class whose agreeing words can't all be among its common ones needs none of them. Classes for which it fails are
joined once more, at the finest grain: each shingle is a word by itself, common ones last, and a set of n has those of its
first n - 0.8 n + 1, of which linked sets share one. Only sets of which at least 0.8 is common still have a common shingle
among these; they are compared in blocks. So no link between classes is lost, and no group's pairs are listed.

Candidates are dropped when their bit sketches differ in too many bits, and verified on their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected
from .shingles import WORDS, class_id, mix, shingle_set

#: Classes that may share a word and still give all their pairs; words held by a task before it hands them on; words a
#: part of the join, about; bits of the filter of ids that verification reads texts by; words beyond those that may
#: differ, in percent of these, so that a class can do without some that are empty or common; classes of a common shingle
#: that are compared as a block; common shingles of a class that its block knows; parts that the rows of a common shingle
#: are joined in; bytes of a word within its part.
PAIRS, HELD, PART, FILTER_BITS, SPARE, BLOCK, OWNERS, SALTS, KEY = 12, 1 << 20, 1 << 19, 1 << 23, 15, 1024, 8, 16, 5
_U = np.uint64


def _bands() -> np.ndarray:
    """The largest size of each band: a set's size by 1.25 lies in its own band or the next."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


BANDS = _bands()


class Rule:
    """The threshold as a fraction percent / 100, and what follows from it; 0.8 or more, since a band grows by 1.25."""

    def __init__(self, percent: int = 80):
        if not 80 <= percent <= 100:
            raise ValueError("the threshold must lie between 0.8 and 1")
        self.percent = percent

    def apart(self, both: int) -> int:
        """The largest symmetric difference of linked sets whose sizes sum to `both`."""
        return (100 - self.percent) * both // (100 + self.percent)

    def words(self, band: int) -> int:
        most = self.apart(2 * int(BANDS[band])) + 1
        return most + 4 + most * SPARE // 100

    def differing(self, n: int, band: int) -> int:
        """How many words of the band's sketch may differ between a set of size n and one linked to it."""
        return self.apart(n + min(int(BANDS[band]), n * 100 // self.percent))

    def keys(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(band, keys of the wide sketch's words, words left out) for the two bands of a sorted set."""
        own = int(np.searchsorted(BANDS, len(s)))
        for band in (own, own + 1):
            m = self.words(band)
            at = (((s >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)  # ascending, since s is
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words, place = np.bitwise_xor.reduceat(mix(s ^ _R1), first), at[first]
            empty = m - len(first)
            if m - self.differing(len(s), band) <= empty:  # too small to leave any out
                every = np.zeros(m, np.uint64)
                every[place] = words
                words, place, empty = every, np.arange(m), 0
            yield band, mix(words ^ mix(place.astype(np.uint64) * _R2 + _U(band + 1))), empty


    def empties(self, s: np.ndarray) -> list[int]:
        """How many words are empty, by band: the own and the next; also where keys() keeps these, since a linked set may not."""
        own, out = int(np.searchsorted(BANDS, len(s))), []
        for band in (own, own + 1):
            m = self.words(band)
            out.append(m - 1 - int(np.count_nonzero(np.diff(((s >> _U(32)) * _U(m)) >> _U(32)))))
        return out


_R1, _R2 = _U(0x2545F4914F6CDD1D), _U(0x9E6C63D0876A9A47)


def bit_sketch(s: np.ndarray) -> bytes:
    """The parity of the shingles at each of 2^k bits, from two to four bits a shingle."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    counts = np.bincount((mix(s ^ _R2) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two bit sketches; the longer is folded to the shorter's length, which keeps parities."""
    x, y, n, k = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while n > k:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while k > n:
        k //= 2
        y = (y >> k) ^ (y & ((1 << k) - 1))
    return (x ^ y).bit_count()


def describe(df: DataFrame, size: int, rule: Rule) -> DataFrame:
    """doc_id, n, cid, sketch, empty: the size and class of each text's set; what belongs to the class stands in one row a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("sketch", pa.binary()), ("empty", pa.list_(pa.int64()))])

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
                rows.append((doc, len(s), cid, bit_sketch(s) if new else None, rule.empties(s) if new else None))
            yield common.arrow_rows(schema, rows)

    return df.mapInArrow(run, "doc_id long, n long, cid long, sketch binary, empty array<long>")


BLOCKS = "part int, cids binary, keys binary, bands binary"


def blocked(keyed: Iterator[tuple[int, int, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS from a task's (class, band, words): the words in blocks by part of the join.

    A word is taken as its part and KEY bytes, so what it costs is the same however many parts there are.
    A word that more than PAIRS of the task's classes share is combined there: one class and a mark (class 0) stand for
    the others in the block, and a block of part -1 - task lists words, whole, and classes of all.
    """
    schema = pa.schema([("part", pa.int32()), ("cids", pa.binary()), ("keys", pa.binary()), ("bands", pa.binary())])
    cids: list[int] = []
    bands: list[int] = []
    keys: list[np.ndarray] = []
    held = 0

    def blocks() -> pa.RecordBatch:
        k = np.concatenate(keys) % _U(parts << 8 * KEY)
        lengths = np.array([len(x) for x in keys])
        c, b = np.repeat(np.array(cids, np.int64), lengths), np.repeat(np.array(bands, np.uint8), lengths)
        order = np.argsort(k, kind="stable")
        new = np.flatnonzero(np.diff(k[order], prepend=~k[order[0]]))
        sizes = np.diff(np.append(new, len(k)))
        rows = []
        common_words = sizes > PAIRS
        if common_words.any():
            inside = np.repeat(common_words, sizes)
            firsts = np.zeros(len(k), bool)
            firsts[new] = True
            hot = order[inside]
            rows.append((-1 - TaskContext.get().partitionId(), c[hot].tobytes(), k[hot].tobytes(), b[hot].tobytes()))
            marks = order[new[common_words]]
            keep = np.zeros(len(k), bool)
            keep[order[~inside | firsts]] = True
            k, c, b = np.concatenate([k[keep], k[marks]]), np.concatenate([c[keep], np.zeros(len(marks), np.int64)]), np.concatenate([b[keep], b[marks]])
        part = (k % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, k, c, b = part[order], k[order], c[order], b[order]
        short = np.ascontiguousarray((k // _U(parts)).view(np.uint8).reshape(-1, 8)[:, :KEY])
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            rows.append((int(part[lo]), c[lo:hi].tobytes(), short[lo:hi].tobytes(), b[lo:hi].tobytes()))
        return common.arrow_rows(schema, rows)

    for cid, band, words in keyed:
        cids.append(cid)
        bands.append(band)
        keys.append(words)
        held += len(words)
        if held >= HELD:
            yield blocks()
            cids, bands, keys, held = [], [], [], 0
    if held:
        yield blocks()


def word_blocks(df: DataFrame, size: int, rule: Rule, parts: int) -> DataFrame:
    """part, cids, keys, bands: the wide sketches' words of df's texts, a class's once a task."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        seen: set[int] = set()
        for (texts,) in common.texts_of(batches, "text"):
            for t in texts:
                s = shingle_set(t, size)
                if not len(s) or (cid := class_id(s)) in seen:
                    continue
                seen.add(cid)
                for band, words, _ in rule.keys(s):
                    yield cid, band, words

    return df.select("text").mapInArrow(lambda batches: blocked(keyed(batches), parts), BLOCKS)


FOUND = "hot boolean, a long, b long, band int"


def found_rows(pairs: np.ndarray, words: np.ndarray, classes: np.ndarray, bands: np.ndarray) -> pd.DataFrame:
    hot = np.repeat([False, True], [len(pairs), len(words)])
    return pd.DataFrame({"hot": hot, "a": np.concatenate([pairs[:, 0], words.view(np.int64)]), "b": np.concatenate([pairs[:, 1], classes]), "band": np.concatenate([np.zeros(len(pairs), np.int32), bands.astype(np.int32)])})


def pair_rows(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs, the smaller class first."""
    if not a:
        return np.zeros((0, 2), np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    both = np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y]
    return np.unique(both, axis=0)


def shared(blocks: DataFrame, parts: int) -> DataFrame:
    """FOUND, written: what the parts of the join say of the blocks."""
    return common.written(blocks.groupBy("part").applyInPandas(lambda key, rows: shared_words(key, rows, parts), FOUND), "shared")


def shared_words(key: tuple, blocks: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Of a part: pairs of classes (a < b) that share a word, and (word, class) of words that many share."""
    raw, c, b = (np.frombuffer(b"".join(blocks[x]), kind) for x, kind in (("keys", np.uint8), ("cids", np.int64), ("bands", np.uint8)))
    k = raw.view(np.uint64) if key[0] < 0 else np.pad(raw.reshape(-1, KEY), ((0, 0), (0, 8 - KEY))).view(np.uint64).ravel() * _U(parts) + _U(key[0])
    if key[0] < 0:  # one task's common words, each with the classes in the task's order: the first stands for the others
        first = np.flatnonzero(np.diff(k, prepend=~k[0]))
        hub = np.repeat(c[first], np.diff(np.append(first, len(k))))
        return found_rows(pair_rows([hub], [c]), k, c, b)
    order = np.argsort(k, kind="stable")
    k = k[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    same[:-1] |= same[1:]
    k, c, b = k[same], c[order][same], b[order][same]
    order = np.lexsort((c, k))
    k, c, b = k[order], c[order], b[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])  # copies in other tasks
    k, c, b = k[new], c[new], b[new]
    if not len(k):
        return found_rows(np.zeros((0, 2), np.int64), k, c, b)
    start = np.flatnonzero(np.diff(k, prepend=~k[0]))
    sizes = np.diff(np.append(start, len(k)))
    marked = c[start] == 0
    hot = (sizes > PAIRS) | marked
    out_a, out_b = [], []
    for n in range(2, PAIRS + 1):
        at = start[(sizes == n) & ~hot]
        i, j = np.triu_indices(n, 1)
        out_a.append(c[at[:, None] + i].ravel())
        out_b.append(c[at[:, None] + j].ravel())
    real = np.repeat(hot, sizes) & (c != 0)
    out_a.append(np.repeat(c[np.minimum(start + marked, len(c) - 1)], sizes)[real])
    out_b.append(c[real])
    return found_rows(pair_rows(out_a, out_b), k[real], c[real], b[real])


def near(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """a, b, far: the pairs whose sizes and bit sketches allow a link; far: the sketches' Hamming distance."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in common.slices(batches):
            a, b, na, nb, sa, sb = (r.column(i).to_pylist() for i in range(6))
            far = [hamming(x, y) for x, y in zip(sa, sb)]
            ok = [i for i, d in enumerate(far) if d <= rule.apart(na[i] + nb[i])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in ok], pa.int64()) for x in (a, b, far)], ["a", "b", "far"])

    sized = pairs.join(left, "a").join(right, "b").where(F.expr(f"100 * least(n_a, n_b) >= {rule.percent} * greatest(n_a, n_b)"))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long, far long")


def _slots(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) ^ _R1)
    return np.concatenate([h % _U(FILTER_BITS), (h >> _U(32)) % _U(FILTER_BITS)]).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that has all ids, and by chance some others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in common.slices(batches):
            bits[_slots(b.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():  # 8 filters of a megabyte
        out |= np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def sets_of(wanted: DataFrame, df: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """cid, own: the shingles of the classes wanted (cid, distinct), one row a class; only their texts are taken apart again."""
    chosen = common.written(wanted.join(classes.select("cid", "rep"), "cid"), "chosen")
    there = np.packbits(id_filter(chosen.where("rep IS NOT NULL").select("rep")))
    schema = pa.schema([("cid", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = np.unpackbits(there).astype(bool)
        for texts, docs in common.texts_of(batches, "text", "doc_id"):
            ids = np.array([0 if d is None else d for d in docs], np.int64)
            slots = _slots(ids).reshape(2, -1)
            ok = bits[slots[0]] & bits[slots[1]] | np.array([d is None for d in docs])
            rows = []
            for i in np.flatnonzero(ok):
                s = shingle_set(texts[i], size)
                if len(s) and (cid := class_id(s)) not in seen:
                    seen.add(cid)
                    rows.append((cid, s.tobytes()))
            yield common.arrow_rows(schema, rows)

    # one row a class: its copies in other tasks have the same set
    return df.mapInArrow(run, "cid long, own binary").join(chosen.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def verified(pairs: DataFrame, df: DataFrame, classes: DataFrame, size: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) of a written table that are linked, by their sets."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    found = sets_of(wanted, df, classes, size)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in common.slices(batches):
            ok = []
            for i, (x, y) in enumerate(zip(r.column(2).to_pylist(), r.column(3).to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= rule.percent * (len(p) + len(q) - shared):
                    ok.append(i)
            take = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([r.column(0).take(take), r.column(1).take(take)], ["a", "b"])

    first = pairs.select("a", "b").join(found.withColumnsRenamed({"cid": "a", "own": "own_a"}), "a")
    both = first.join(found.withColumnsRenamed({"cid": "b", "own": "own_b"}), "b")
    return common.written(both.select("a", "b", "own_a", "own_b").mapInArrow(check, "a long, b long"), "links")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are not yet in one component."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("l_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("l_b"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select(*pairs.columns)


def components(df: DataFrame, size: int = WORDS, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of df.

    Rows without words (null, empty, white space) have no shingle and are linked with nothing: their component is their
    own id. Rows that repeat an id, or a text, are in one component; a component without any id has none. Other columns
    play no part. An empty table has an empty result.
    """
    spark, rule = df.sparkSession, Rule(percent)
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = common.written(describe(given, size, rule), "sets")
    classes = docs.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("sketch").alias("sketch"), F.max("empty").alias("empty"))
    classes = common.written(classes, "classes")
    with common.scope(spark):  # what the rounds leave is not needed after them
        labels = common.written(component_labels(given, classes, size, rule), "labels", keep=True)
    named = classes.select("cid", "rep").join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = named.select("cid", "label").join(lowest, "label").select(F.col("cid").alias("c"), "component_id")
    out = docs.select("doc_id", "n", "cid").join(by_class, F.col("cid") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def component_labels(given: DataFrame, classes: DataFrame, size: int, rule: Rule) -> DataFrame:
    """node, label of the classes that are linked with another."""
    spark = given.sparkSession
    expected = (classes.agg(F.sum("n")).first()[0] or 0) * 3 * (100 - rule.percent) // 100
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // PART, 1)
    blocks = word_blocks(given, size, rule, parts)
    found = shared(blocks, parts)
    pairs = common.written(near(found.where("NOT hot").select("a", "b").distinct(), classes, rule), "near")
    # the nearest other class of each class first: most components are whole after that
    ends = pairs.select(F.col("b").alias("x"), "a", "b", "far").unionByName(pairs.select(F.col("a").alias("x"), "a", "b", "far"))
    first = common.written(ends.groupBy("x").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "first")
    links = verified(first, given, classes, size, rule)
    labels = connected(links)
    left = common.written(apart(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), labels), "left")
    more = verified(left, given, classes, size, rule)
    links = links.unionByName(more)
    labels = connected(links)
    short = common.written(left_over(found.where("hot").select("a", "b", "band"), classes, labels, rule), "short")
    if short.limit(1).count():
        rest = common.written(shingle_pairs(short, given, classes, size, rule), "rest")
        rest = common.written(near(rest, classes, rule), "near")
        links = links.unionByName(verified(rest, given, classes, size, rule))
        labels = connected(links)
    return labels


def left_over(hot: DataFrame, classes: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """cid, label of the classes that only common words could show links of, to classes of other components.

    hot: (word a, class b, band). A word within one component is done. Of the others, a class needs none in a band where
    the words that must agree outnumber its empty ones and these. Two linked classes that are not yet in one component
    are both left over.
    """
    spark = hot.sparkSession
    known = hot.select(F.col("a").alias("word"), F.col("b").alias("cid"), "band").distinct().join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = known.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("word")
    few = salted(known, mixed, "word").groupBy("cid", "band", "label").agg(F.count("*").alias("common")).join(classes.select("cid", "n", "empty"), "cid")
    # a fixed table: some hundred bands
    bands = spark.createDataFrame([(b, rule.words(b), int(BANDS[b]), int(BANDS[b - 1]) if b else 0) for b in range(len(BANDS))], "band int, words long, most long, below long")
    own = F.element_at("empty", F.when(F.col("n") > F.col("below"), 1).otherwise(2))
    differing = F.expr(f"({100 - rule.percent} * (n + least(most, n * 100 div {rule.percent}))) div {100 + rule.percent}")
    return few.join(F.broadcast(bands), "band").where(F.col("words") - differing <= F.col("common") + own).select("cid", "label").distinct()


def salted(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows (with cid) joined to the table of common keys, the rows of a key in SALTS parts."""
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(each, [key, "salt"], how).drop("salt")


def shingle_pairs(short: DataFrame, given: DataFrame, classes: DataFrame, size: int, rule: Rule) -> DataFrame:
    """a, b: candidates among the classes left over (cid, label), of different components, by the shingles themselves.

    A set's shingles are ordered, common ones last. Linked sets of n and m share 0.8 n and 0.8 m at least, so they share
    one of the first n - 0.8 n + 1 and m - 0.8 m + 1 (rounded for the worse).
    """
    sets = sets_of(short.select("cid"), given, classes, size)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            own = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            cid = np.repeat(b.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.concatenate(own))], ["cid", "word"])

    words = common.written(sets.mapInArrow(each, "cid long, word long"), "shingles")
    hot = words.groupBy("word").agg(F.count("*").alias("k")).where(F.col("k") > PAIRS).select("word", F.lit(1).alias("hot"))
    hot = common.written(hot, "hot")
    ordered = salted(words, hot, "word", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    first = F.size("all") - F.expr(f"({rule.percent} * size(all) + 99) div 100") + 1
    prefix = ordered.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("hot", "word"))).alias("all")).withColumn("first", F.slice("all", F.lit(1), first.cast("int")))
    prefix = common.written(prefix.select("cid", "first").join(short, "cid").join(classes.select("cid", "n", "sketch"), "cid"), "prefix")
    # shingles of few classes: all their pairs
    rare = prefix.select("cid", "label", F.explode(F.filter("first", lambda x: x["hot"] == 0)).alias("x")).groupBy("x.word").agg(F.array_sort(F.collect_list(F.struct("cid", "label"))).alias("g")).where(F.size("g") > 1)
    pairs = rare.select(F.explode(F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y["cid"] > x["cid"]) & (y["label"] != x["label"])), lambda y: F.struct(x["cid"].alias("a"), y["cid"].alias("b")))))).alias("p")).select("p.a", "p.b")
    # common ones: in blocks, each of a shingle's with each; counts come from partial sums, so nothing is gathered
    common_ones = F.transform(F.filter("first", lambda x: x["hot"] == 1), lambda x: x["word"])
    needed = prefix.withColumn("words_of", F.slice(common_ones, 1, OWNERS)).select("cid", "label", "n", "sketch", "words_of", F.explode(common_ones).alias("word"))
    needed = common.written(needed, "needed")
    counts = needed.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("word", "blocks")
    needed = salted(needed, counts, "word").withColumn("i", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int"))
    # each block of a shingle's classes meets each: a row goes to as many groups as its shingle has blocks
    needed = needed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    needed = needed.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    parts = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = needed.select("word", "lo", "hi", "cid", "label", "n", "sketch", "words_of", F.pmod(F.xxhash64("word", "lo", "hi"), F.lit(16 * parts)).alias("part"))
    return pairs.unionByName(blocks.groupBy("part").applyInPandas(lambda rows: block_pairs(rows, rule), "a long, b long")).distinct()


def block_pairs(rows: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """The pairs of classes of different components in each of the groups (word, lo, hi) that their bit sketches allow.

    Near copies share many words: a pair belongs to the first of those it shares, where that is among the first OWNERS
    of both its classes.
    """
    out = [np.zeros((0, 2), np.int64)]
    for (word, _, _), g in rows.groupby(["word", "lo", "hi"], sort=False):
        if len(g) < 2 or g.label.nunique() < 2:
            continue
        cid, label, n = g.cid.to_numpy(), g.label.to_numpy(), g.n.to_numpy()
        own, there = np.zeros((len(g), OWNERS), np.int64), np.zeros((len(g), OWNERS), bool)
        for r, w in enumerate(g.words_of):
            own[r, : len(w)], there[r, : len(w)] = w, True
        width = min(map(len, g.sketch)) // 8
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0) for x in g.sketch])
        chunk = max(1, (1 << 22) // (len(g) * width))
        for at in range(0, len(g), chunk):
            some = slice(at, at + chunk)
            far = np.bitwise_count(folded[some, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
            both = n[some, None] + n[None, :]
            alike = 100 * np.minimum(n[some, None], n[None, :]) >= rule.percent * np.maximum(n[some, None], n[None, :])
            ok = alike & (far <= (100 - rule.percent) * both // (100 + rule.percent)) & (label[some, None] != label[None, :]) & (cid[some, None] < cid[None, :])
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 1 << 16):
                x, y = at + i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                same = ((own[x][:, :, None] == own[y][:, None, :]) & there[x][:, :, None] & there[y][:, None, :]).any(axis=2)
                first = own[x, same.argmax(axis=1)]
                mine = ~same.any(axis=1) | (first == word)
                out.append(np.stack([cid[x[mine]], cid[y[mine]]], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


#: The same components in SQL, over a table `documents` whose ids are distinct: all pairs of documents that share a shingle.
SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM worded, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""
