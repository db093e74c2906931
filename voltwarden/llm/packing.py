"""Best-fit packing of token sequences by minimum bin slack.

What decides a packing is how many pieces there are of each length, a table of at most `capacity` rows however large the
corpus is. The driver plans on that table alone: it seeds a bin with the longest length left and fills the rest by a
subset-sum dynamic program over the lengths left, a bit for each reachable sum, longest lengths first; the fullest
feasible combination is taken as often as the counts allow and removed. The plan says, for each length, which ranks go to
which bins. Pieces learn their rank among the pieces of their length from a count by (task, length), so no length is ever
gathered or sorted in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

#: Rows of (task, length) that may be broadcast, at about 128 bytes.
BASES = 1 << 18
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())])


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of the lengths counted that fills `room` best without exceeding it, long lengths first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left:  # so many copies as one, two, four... at once
            batch = min(batch, left)
            steps.append((length, batch, reach))
            reach |= (reach << (length * batch)) & mask
            left -= batch
            batch *= 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, batch, before in reversed(steps):
        if not before >> best & 1:
            best -= length * batch
            taken[length] = taken.get(length, 0) + batch
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces a bin, offset): where the pieces of a length go."""
    left, used, bins, out = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0), 0, []
    for seed in sorted(left, reverse=True):
        while left[seed]:
            left[seed] -= 1
            taken = fullest(capacity - seed, left)
            left[seed] += 1
            taken[seed] = taken.get(seed, 0) + 1
            times, offset = min(left[x] // n for x, n in taken.items()), 0
            for length, n in sorted(taken.items(), reverse=True):
                out.append((length, used[length], used[length] + times * n, bins, n, offset))
                used[length] += times * n
                left[length] -= times * n
                offset += n * length
            bins += times
    return out


def cut(df: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows of PIECES: each text's ids with the end id, cut where they are longer than capacity; a shorter piece comes first.

    Null and empty texts have the end id alone. The ids of a piece are kept (little-endian, 32 bits each) if asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = encoder(tokenizer, end_id), TaskContext.get().partitionId(), {}
        for texts, docs in common.texts_of(batches, "text", "doc_id"):
            rows, ids = [], own.batch(texts)
            places = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] // own.width
            flat = memoryview(np.frombuffer(ids.buffers()[2], f"<u{own.width}")[: places[-1]].astype("<u4")).cast("B")
            for doc, at, end in zip(docs, places[:-1].tolist(), places[1:].tolist()):
                start, piece = at, 0
                while start < end:
                    length = (end - start - 1) % capacity + 1 if piece == 0 else capacity
                    part = flat[4 * start : 4 * (start + length)]
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc, piece, start - at, length, zlib.crc32(part), part.tobytes() if keep_ids else None, task, nth))
                    start, piece = start + length, piece + 1
            yield common.arrow_rows(PIECES, rows)

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, nth long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of PIECES.

    An empty table has an empty result; pieces of the same length are alike, so ties and repeated rows are placed by
    task and place in it. Lengths must lie in 1..capacity.
    """
    spark = pieces.sparkSession
    counts = common.written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect()  # capacity rows at most
    totals = {r.length: r.n for r in by_length}
    if any(not 1 <= x <= capacity for x in totals):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    places = spark.createDataFrame(plan(totals, capacity), "p_length long, lo long, hi long, first long, per long, at long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("b_length"), F.col("task").alias("b_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # lengths by tasks: few rows are broadcast, more are joined by sorting, where a group is no more than a task's pieces
    base = base.hint("broadcast" if sum(r.tasks for r in by_length) <= BASES else "merge")
    ranked = pieces.join(base, (F.col("length") == F.col("b_length")) & (F.col("task") == F.col("b_task"))).withColumn("rank", F.col("base") + F.col("nth"))
    # the plan has a bounded number of rows: its size depends on the capacity, not on the corpus
    put = ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    put = put.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("per")).cast("long")).withColumn("offset", F.col("at") + F.pmod(nth, F.col("per")) * F.col("length"))
    return put.drop("b_length", "b_task", "base", "rank", "p_length", "lo", "hi", "first", "per", "at", "task", "nth")


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all texts of df into sequences of at most `capacity` tokens.

    A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for. Repeated rows and
    rows without doc_id are packed like others; other columns of df play no part, so their names can't clash.
    """
    pieces = common.written(cut(df, tokenizer, end_id, capacity, doc_id, text, keep_ids), "pieces")
    out = pack(pieces, capacity)
    return out if keep_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens and ids (little-endian, 32 bits each) of what pack_documents(keep_ids=True) gave; capacity bounds a group."""
    joined = F.expr("array_join(transform(array_sort(collect_list(struct(offset, hex(ids) AS h))), x -> x.h), '')")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.unhex(joined).alias("ids"))
