"""Prefix trie of conversations in preorder-interval encoding.

A node is a distinct sequence of first turns. It is known by a hash of its path that turns add to one by one, so paths are
never written out: a running XOR of hashes of (turn, depth), taken in blocks, however long a conversation is. Distinct
conversations are ranked lexicographically; a node's conversations are neighbours there, so a node has a first and a last
one. Nodes in order of (first, depth) are in preorder: a subtree is an interval that ends with the last conversation's own
node, and leaves and savings of a subtree are differences of prefix sums at both ends of it. Prefix sums are taken in
blocks of ranks, each by itself, and the blocks' totals added up.

Lexicographic order needs, of each path, only what branching nodes on it go on to. A conversation with b of these on its path
means as many others at least as deep as its 1st, 2nd, ... b-th, so b is at most the root of twice the number of turns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns a block of a running XOR; ranks a block of a prefix sum, at least; bytes about of ids that a task hands on at once.
TURNS, RANKS, IDS = 1024, 4096, 1 << 16


def ranked(df: DataFrame, order: list[Column], name: str, place: str, *drop: str) -> DataFrame:
    """A written df with `place`, each row's position (from 0) by `order`; the columns `drop` are left out.

    Rows are dealt by ranges of the order and numbered within them; what is counted up is one number a range.
    """
    at, part, n, base = common.fresh(df, "at", "part", "n", "base")
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop).withColumn(at, F.monotonically_increasing_id())
    rows = common.written(spread, name).withColumn(part, F.shiftright(at, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    # a row a shuffle partition
    return rows.join(F.broadcast(starts), part).withColumn(place, F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, base)


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, said, words), places from 0 by turn, and (conv_id, start, n) of each conversation.

    Null turns come first; turns of one number are ordered by the digest of role and text. Null role or text is empty.
    Rows with a null conv_id belong to no conversation.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.md5(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said).cast("binary")))
    given = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), digest.alias("said"), common.word_count(said[1]).alias("words")).where("conv_id IS NOT NULL")
    rows = ranked(given, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("said")], "turns", "at", "turn")
    lengths = common.written(rows.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")), "lengths")
    return rows.join(lengths, "conv_id").select("conv_id", (F.col("at") - F.col("start")).alias("place"), "said", "words"), lengths.select("conv_id", "n")


def regrown(rows: DataFrame, lengths: DataFrame, heads: int = 4, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, said, words, length), depths from 1, and (conv_id, length): conversations that share beginnings.

    Conversation c begins with the first h turns of c - c % group (% with the sign of c), h = crc32(c in decimal) % heads, and
    goes on with its own after its first h. `rows` and `lengths` are those of turns().
    """
    first = rows.where((F.col("place") < heads - 1) & (F.col("conv_id") % group == 0)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "said", "words"))).alias("first"))
    own = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    own = own.join(first.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), F.lit(1), F.col("h")))
    own = own.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = common.written(own.select("conv_id", "h", "head", "length"), "regrown")
    ahead = own.select("conv_id", F.explode("head").alias("x"), "length").select("conv_id", (F.col("x.place") + 1).alias("depth"), "x.said", "x.words", "length")
    after = rows.join(own.select("conv_id", "h", F.size("head").alias("b"), "length"), "conv_id").where("place >= h")
    after = after.select("conv_id", F.expr("place - h + b + 1").alias("depth"), "said", "words", "length")
    return ahead.unionByName(after), own.select("conv_id", "length")


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, length, words, x1, x2, p1, p2 written: each turn's node and its parent, by hashes of their paths."""
    hashed = rows.select("conv_id", "depth", "length", "words", F.xxhash64("said", "depth").alias("e1"), F.xxhash64(F.lit(1), "said", "depth").alias("e2"))
    hashed = hashed.withColumn("block", F.expr(f"(depth - 1) div {TURNS}"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = common.written(hashed.withColumns({x: F.bit_xor(e).over(so_far) for x, e in (("x1", "e1"), ("x2", "e2"))}), "turns")
    # only conversations of several blocks have anything before one
    totals = inside.where(F.col("length") > TURNS).groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", *[F.bit_xor(b).over(before).alias(b) for b in ("b1", "b2")])
    both = inside.join(totals, ["conv_id", "block"], "left")
    both = both.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(b, F.lit(0))) for x, b in (("x1", "b1"), ("x2", "b2"))})
    both = both.withColumns({p: F.col(x).bitwiseXOR(F.col(e)) for p, x, e in (("p1", "x1", "e1"), ("p2", "x2", "e2"))})
    return common.written(both.select("conv_id", "depth", "length", "words", "x1", "x2", "p1", "p2"), "paths")


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """x1, x2, ends_sha256: of the conversations (conv_id) that end at each node, their ids in order, comma-joined.

    Ids are dealt by ranges and joined to pieces of a node's list in tasks; a node's pieces are then hashed one after
    another, so no list is held.
    """
    order = [F.asc(c) for c in ("x1", "x2", "conv_id")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, first, ids, held = ["x1", "x2", "first", "ids"], None, None, [], 0
        for b in common.slices(batches):
            rows = []
            for x1, x2, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if node != (x1, x2) or held > IDS:
                    if node:
                        rows.append((*node, first, ",".join(ids)))
                    node, first, ids, held = (x1, x2), c, [], 0
                ids.append(str(c))
                held += len(ids[-1]) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, first, ",".join(ids)), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, names = None, None, ["x1", "x2", "ends_sha256"]
        schema = pa.schema(zip(names, (pa.int64(), pa.int64(), pa.string())))
        for b in common.slices(batches):
            rows = []
            for x1, x2, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                if node == (x1, x2):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    rows.append((*node, state.hexdigest()))
                node, state = (x1, x2), hashlib.sha256(ids.encode())
            yield common.arrow_rows(schema, rows)
        if node:
            yield common.arrow_rows(schema, [(*node, state.hexdigest())])

    cut = ends.select("x1", "x2", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "x1 long, x2 long, first long, ids string")
    return cut.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").select("x1", "x2", "ids").mapInArrow(digests, "x1 long, x2 long, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row a node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, rank (in preorder, from 0) and subtree_end (the rank after the subtree's last).

    rows: (conv_id, depth, said, words, length); lengths: (conv_id, length) of all conversations, also those without a turn,
    which end at the root. Without any conversation there is no node. Conversations that are alike end at one node.
    """
    nodes_of = paths(rows)
    lengths = common.written(lengths, "ends")
    root = lengths.groupBy(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2")).agg(F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = nodes_of.groupBy("x1", "x2").agg(F.max("depth").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = common.written(nodes.unionByName(root), "nodes")
    children = common.written(nodes.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count("*").alias("n_children")), "children")
    # one conversation of those that end at a node stands for them
    ends = nodes_of.where("depth = length").select("x1", "x2", "conv_id", "length")
    ends = ends.unionByName(lengths.where("length = 0").select(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv_id", F.col("length").cast(ends.schema["length"].dataType)))
    distinct = common.written(ends.groupBy("x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("length")), "distinct")
    steps = nodes_of.join(distinct.select("conv_id"), "conv_id", "left_semi")
    turned = steps.join(children.where("n_children > 1"), ["p1", "p2"], "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "x1", "x2"))).alias("all"))
    turned = turned.select("conv_id", F.transform("all", lambda s: F.struct(s["x1"], s["x2"])).alias("way"))
    sequences = distinct.join(turned, "conv_id", "left").withColumn("way", F.coalesce("way", F.array().cast(turned.schema["way"].dataType)))
    sequences = ranked(common.written(sequences, "ways"), [F.asc("way"), F.asc("length")], "sequences", "sequence", "way", "length")
    spans = steps.join(sequences.select("conv_id", "sequence"), "conv_id").groupBy("x1", "x2").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    whole = sequences.agg(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    spans = common.written(spans.unionByName(whole.where("first IS NOT NULL")), "spans")
    known = nodes.join(spans, ["x1", "x2"]).join(children.withColumnsRenamed({"p1": "x1", "p2": "x2"}), ["x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    known = ranked(common.written(known, "known"), [F.asc("first"), F.asc("depth")], "preorder", "rank")
    summed = common.written(prefix_sums(known, "rank", ["leaf", "saved"]), "summed")
    # a sequence's own node is the last in preorder of those that begin with it
    closing = summed.groupBy(F.col("first").alias("last")).agg(F.max(F.struct("rank", "to_leaf", "to_saved")).alias("end"))
    out = summed.join(closing, "last").select("x1", "x2", "p1", "p2", "conv_id", "depth", "n_convs", "n_children", (F.col("end.to_leaf") - F.col("to_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end.to_saved") - F.col("to_saved") + F.col("saved")).alias("saved_tokens"), "rank", (F.col("end.rank") + 1).alias("subtree_end"))
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, ["p1", "p2"], "left").join(common.written(hashes_of_ends(ends), "hashes"), ["x1", "x2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "rank", "subtree_end")


def prefix_sums(df: DataFrame, rank: str, columns: list[str]) -> DataFrame:
    """df with to_<column>: the sum of each column up to and with the row, by a rank that counts from 0 without gaps.

    Blocks of ranks are summed each by itself; then come the totals of all blocks, as many as a block has rows.
    """
    (block,) = common.fresh(df, "block")
    size = max(RANKS, math.isqrt(df.count()))
    df = df.withColumn(block, F.expr(f"`{rank}` div {size}"))
    inside = Window.partitionBy(block).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(block).agg(*[F.sum(c).alias(f"own_{c}") for c in columns]).select(block, *[F.coalesce(F.sum(f"own_{c}").over(before), F.lit(0)).alias(f"to_{c}") for c in columns])
    sums = df.withColumns({f"in_{c}": F.sum(c).over(inside) for c in columns}).join(totals, block)
    return sums.withColumns({f"to_{c}": F.col(f"to_{c}") + F.col(f"in_{c}") for c in columns}).drop(block, *[f"in_{c}" for c in columns])


#: The same rows in SQL, over a table `conversations`: paths written out as hashes of lists, and every node joined to all
#: above it. CRC-32 is taken bit by bit over the digits of the id.
SQL = """
WITH RECURSIVE bits AS (
  SELECT v AS byte, v::BIGINT AS c, 0 AS k FROM range(256) t(v)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
codes AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(COALESCE(role, '')), ':', COALESCE(role, ''), COALESCE(text, '')))) AS place,
    md5(concat(length(COALESCE(role, '')), ':', COALESCE(role, ''), COALESCE(text, ''))) AS said,
    len(regexp_extract_all(COALESCE(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(struct_pack(s := said, w := words) ORDER BY place) AS own FROM said GROUP BY conv_id),
signed AS (
  SELECT c.*, b.own AS first, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, x: xor(crc // 256, t[xor(crc % 256, x) + 1])), 4294967295) % 4 AS h
  FROM convs c CROSS JOIN codes LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
rebuilt AS (SELECT conv_id, list_concat(COALESCE(first, [])[1:h], own[h + 1:]) AS path FROM signed),
steps AS (
  SELECT conv_id, d, len(path) AS length, md5(array_to_string(list_transform(path[1:d], lambda x: x.s), ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(path[1:d - 1], lambda x: x.s), ',')) END AS parent,
    CASE WHEN d > 0 THEN path[d].w ELSE 0 END AS words
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)),
nodes AS (
  SELECT node, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = length), '')) AS ends_sha256
  FROM steps GROUP BY node, d),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT u.node, s.node AS below FROM steps s JOIN steps u ON s.conv_id = u.conv_id AND u.d <= s.d),
under AS (
  SELECT a.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM above a JOIN nodes b ON a.below = b.node LEFT JOIN kids k ON k.parent = b.node GROUP BY a.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, COALESCE(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under USING (node) LEFT JOIN kids k ON k.parent = n.node LEFT JOIN nodes p ON p.node = n.parent
"""
