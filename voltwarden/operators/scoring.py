"""Scoring detectors against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import earlier


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def confusion(df: DataFrame, by: list[str], truth: Column, flagged: Column) -> DataFrame:
    """by, tp, fp, tn, fn, precision, recall, f1, fpr; a ratio without a denominator is 0."""
    t, f = truth, flagged
    counts = df.groupBy(*by).agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"), F.count_if(t & ~f).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn)).withColumn("fpr", _ratio(fp, fp + tn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def aligned(truth: DataFrame, detector: DataFrame) -> DataFrame:
    """Both sides by idx; raises where either has an idx that the other has not."""
    both = truth.withColumn("__t", F.lit(1)).join(detector.withColumn("__d", F.lit(1)), "idx", "full_outer")
    missing = both.where("__t IS NULL OR __d IS NULL").limit(1).count()
    if missing:
        raise ValueError("truth and detector do not cover the same frames")
    return both.drop("__t", "__d")


def layer_names(truth: DataFrame, detector: DataFrame) -> DataFrame:
    """layer: those of either side."""
    return truth.select("layer").unionByName(detector.select("layer")).distinct()


def by_layer(truth: DataFrame, detector: DataFrame) -> DataFrame:
    """idx, layer, truth, score over the union of both sides' layers.

    truth: idx, layer, truth; detector: idx, layer, score. A layer that one side lacks takes that side's Global row, and
    Global the largest of the side's layers; where there is nothing it is 0.
    """
    names = layer_names(layer_names(truth, detector), truth.sparkSession.range(1).select(F.lit("Global").alias("layer")))
    frames = truth.select("idx").unionByName(detector.select("idx")).distinct()
    spine = frames.crossJoin(F.broadcast(names.agg(F.collect_set("layer").alias("layers")))).select("idx", F.explode("layers").alias("layer"))  # one row

    def whole(side: DataFrame, value: str) -> DataFrame:
        own = F.max(F.when(F.col("layer") == "Global", F.col(value)))
        return side.groupBy("idx").agg(F.coalesce(own, F.max(value)).alias(f"__{value}"))

    out = spine.join(truth, ["idx", "layer"], "left").join(detector, ["idx", "layer"], "left").join(whole(truth, "truth"), "idx", "left").join(whole(detector, "score"), "idx", "left")
    return out.select("idx", "layer", F.coalesce("truth", "__truth", F.lit(0)).alias("truth"), F.coalesce("score", "__score", F.lit(0.0)).alias("score"))


def windows(df: DataFrame, keys: list[str], on: Column, order: str = "idx") -> DataFrame:
    """keys, start, end, frames: the maximal runs of rows where `on` holds, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__on", on.cast("int")).withColumn("__start", F.when((F.col("__on") == 1) & (F.coalesce(F.lag("__on").over(w), F.lit(0)) == 0), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__on = 1")
    return marked.groupBy(*keys, "__island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("frames")).drop("__island")


def time_to_detection(df: DataFrame, keys: list[str], truth: Column, flagged: Column, span: int | None = None) -> DataFrame:
    """keys, start, end, ttd: frames from a window's start to its first flagged frame, null where there is none.

    A series is scanned in one task, or, with `span`, in parts of so many idx.
    """
    marked = df.withColumn("__t", truth.cast("int")).withColumn("__f", flagged)
    if span is None:
        w = Window.partitionBy(*keys).orderBy("idx")
        marked = marked.withColumn("__s", F.when((F.col("__t") == 1) & (F.coalesce(F.lag("__t").over(w), F.lit(0)) == 0), 1).otherwise(0))
        marked = marked.withColumn("__island", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__t = 1")
    else:  # a window is known by the last frame before it
        marked = earlier(marked, keys, "idx", span, most={"__island": F.when(F.coalesce("__t", F.lit(0)) == 0, F.col("idx"))}).where("__t = 1")
    out = marked.groupBy(*keys, "__island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.min(F.when(F.col("__f"), F.col("idx"))).alias("__hit"))
    return out.withColumn("ttd", F.col("__hit") - F.col("start")).drop("__island", "__hit")


#: Seconds of the finest stretch of time in the cover of an attack.
TICK_S = 1.0


def dyadic_cover(first: Column, last: Column) -> Column:
    """The dyadic nodes that make up the ticks first..last: structs of level and node, at most two a level.

    Node n of level l holds the ticks n * 2^l to (n + 1) * 2^l - 1. From the ends inwards, an end that is no left (right)
    child of its level stands alone; the rest goes up a level. So an interval of any length is as many nodes as its
    length has binary digits, twice.
    """
    at = lambda x, l: F.shiftright(x, l)

    def level(l: int) -> Column:
        lo, hi = at(first + ((1 << l) - 1), l), at(last + 1, l) - 1  # the whole nodes of this level inside
        left = F.when((lo <= hi) & (F.pmod(lo, F.lit(2)) == 1), F.struct(F.lit(l).alias("level"), lo.alias("node")))
        right = F.when((lo <= hi) & (F.pmod(hi, F.lit(2)) == 0), F.struct(F.lit(l).alias("level"), hi.alias("node")))
        return F.array(left, right)

    return F.array_distinct(F.filter(F.flatten(F.array(*[level(l) for l in range(DEPTH)])), lambda x: x.isNotNull()))


#: Levels of the cover: attacks of up to 2^DEPTH ticks, some 140 years at a second each.
DEPTH = 32


def hits(results: DataFrame, attacks: DataFrame, tick_s: float = TICK_S) -> DataFrame:
    """component_id, ts, attack_id, start_ts: each failed time of a component inside an attack on it, once for each such attack.

    An attack is a row for each node of its dyadic cover, a time one for each level that any attack uses, so long attacks
    cost as little as short ones and no key holds more than what lies in one stretch of one component. results:
    component_id, ts; attacks: attack_id, component_id, start_ts, end_ts.
    """
    at = lambda t: F.floor(t / tick_s).cast("long")
    cover = F.explode(dyadic_cover(at(F.col("start_ts")), at(F.col("end_ts"))))
    each = attacks.where("end_ts >= start_ts").withColumn("cover", cover).select("attack_id", "component_id", "start_ts", "end_ts", F.col("cover.level").alias("level"), F.col("cover.node").alias("node"))
    levels = sorted(r.level for r in each.select("level").distinct().collect())  # DEPTH numbers at most
    failed = results.select("component_id", "ts", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    failed = failed.withColumn("node", F.call_function("shiftright", at(F.col("ts")), F.col("level")))
    both = failed.join(each, ["component_id", "level", "node"]).where(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    return both.select("component_id", "ts", "attack_id", "start_ts")


def failures(results: DataFrame) -> DataFrame:
    """component_id, ts, n: the times of failed results, and how many there are at each."""
    return results.where("failed").groupBy("component_id", "ts").agg(F.count("*").alias("n"))


def events(results: DataFrame, attacks: DataFrame, tick_s: float = TICK_S) -> DataFrame:
    """tp, fp, fn: failed results inside an attack on their component, those outside all, and attacks never hit.

    results: component_id, ts, failed; attacks: attack_id, component_id, start_ts, end_ts. One join serves all three.
    """
    given = failures(results)
    # times and attacks by what they are, marked where they are part of a hit
    of_time, of_attack = F.struct(F.lit(0).alias("attack"), F.col("component_id").cast("string").alias("a"), F.col("ts").cast("string").alias("b")), F.struct(F.lit(1).alias("attack"), F.col("attack_id").cast("string").alias("a"), F.lit("").alias("b"))
    seen = hits(given, attacks, tick_s).select(F.explode(F.array(of_time, of_attack)).alias("x"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("hit"))
    there = given.select(of_time.alias("x"), "n", F.lit(0).alias("hit")).unionByName(attacks.select(of_attack.alias("x"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("hit")))
    each = there.unionByName(seen).groupBy("x").agg(F.max("hit").alias("hit"), F.sum("n").alias("n"))
    total = lambda attack, hit: F.coalesce(F.sum(F.when((F.col("x.attack") == attack) & (F.col("hit") == hit), F.col("n"))), F.lit(0))
    return each.agg(total(0, 1).alias("tp"), total(0, 0).alias("fp"), total(1, 0).alias("fn"))


def detection_times(results: DataFrame, attacks: DataFrame, tick_s: float = TICK_S) -> DataFrame:
    """attack_id, ttd: from the start to the first failed result of the component, null where there is none."""
    found = hits(failures(results), attacks, tick_s).select("attack_id", (F.col("ts") - F.col("start_ts")).alias("ttd"))
    every = attacks.select("attack_id", F.lit(None).cast(found.schema["ttd"].dataType).alias("ttd"))
    return every.unionByName(found).groupBy("attack_id").agg(F.min("ttd").alias("ttd"))


def without_labels(df: DataFrame) -> DataFrame:
    """df as a detector may see it; raises where a label column is among its columns."""
    bad = [c for c in df.columns if c == "attack" or c.endswith("_attack")]
    if bad:
        raise ValueError(f"label columns reach the detector: {bad}")
    return df
