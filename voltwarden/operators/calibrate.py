"""Calibrating thresholds from clean data, and looking into a stretch of frequency readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


#: Buckets that a range of values is cut into.
BUCKETS = 4096


def selected(df: DataFrame, values: dict[str, tuple[Column, list[float]]], by: list[str] | None = None) -> DataFrame:
    """by, and under each name an array of exact percentiles (linear interpolation) of its column; nulls and what is not finite don't count.

    The values of the wanted ranks are selected: rows are counted by bucket of the range that a rank may lie in, and the
    bucket that holds it becomes the range, from its least to its largest value, until these are one. A round sees counts,
    no task holds values, and all names, keys and ranks go together. A key without values has nulls.
    """
    by = by or []
    keys = [*by, "__name"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.cast("double").alias("v")) for n, (c, _) in values.items()]))
    rows = df.select(*by, each.alias("__x")).select(*by, F.col("__x.n").alias("__name"), F.col("__x.v").alias("__v"))
    sound = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != float("inf")))
    ends = sound.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    shares = F.create_map(*[F.lit(x) for n, (_, ps) in values.items() for x in (n, F.array(*map(F.lit, map(float, ps))))])
    place = (F.col("__n") - 1) * F.col("__p")
    wanted = ends.select("*", F.posexplode(shares[F.col("__name")]).alias("__i", "__p"))
    wanted = wanted.withColumn("__k", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    state = kept(wanted.select(*keys, "__k", "__lo", "__hi", F.lit(0).cast("long").alias("__below")).dropDuplicates([*keys, "__k"]))
    done = None
    while True:
        settled = state.where("__lo = __hi").select(*keys, "__k", F.col("__lo").alias("__value"))
        done = settled if done is None else done.unionByName(settled)
        left = state.where("__lo < __hi")
        if not left.limit(1).count():
            break
        same = [sound[k].eqNullSafe(left[k]) for k in keys]
        joined = sound.join(left, [*same, sound["__v"].between(left["__lo"], left["__hi"])]).select(*[left[k] for k in keys], "__k", "__lo", "__hi", "__below", "__v")
        # halves, since the width of a range may be more than a double holds
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * BUCKETS))
        counts = joined.groupBy(*keys, "__k", "__below", bucket.alias("__b")).agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        before = Window.partitionBy(*keys, "__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        under = F.col("__below") + F.coalesce(F.sum("__c").over(before), F.lit(0))
        inside = counts.withColumn("__under", under).where("__k >= __under AND __k < __under + __c")
        state = kept(inside.select(*keys, "__k", "__lo", "__hi", F.col("__under").alias("__below")))
    done = kept(done)
    lower, upper = (done.select(*[F.col(k).alias(f"{p}_{k}") for k in keys], F.col("__k").alias(f"{p}k"), F.col("__value").alias(f"{p}v")) for p in ("__l", "__u"))
    at = wanted.select(*keys, "__i", place.alias("__at")).dropDuplicates([*keys, "__i"])
    at = at.join(lower, [at[k].eqNullSafe(lower[f"__l_{k}"]) for k in keys] + [F.floor("__at") == F.col("__lk")]).join(upper, [at[k].eqNullSafe(upper[f"__u_{k}"]) for k in keys] + [F.ceil("__at") == F.col("__uk")])
    found = at.select(*keys, "__i", (F.col("__lv") + (F.col("__uv") - F.col("__lv")) * (F.col("__at") - F.floor("__at"))).alias("__value"))
    lists = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__value"))), lambda x: x["__value"]).alias("__all"))
    out = lists.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, F.col("__all"))).alias(n) for n in values])
    if not by:
        return out
    have = df.select(*by).distinct()
    named = out.withColumnsRenamed({k: f"__{k}" for k in by})
    return have.join(named, [have[k].eqNullSafe(named[f"__{k}"]) for k in by], "left").select(*by, *values)


def kept(df: DataFrame) -> DataFrame:
    """A small table of ranks, written where the cluster's executors share a folder."""
    path = scratch.folder(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def percentiles(df: DataFrame, value: Column, shares: list[float], by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """by, p0, p1...: exact percentiles with linear interpolation, or Spark's bounded sketch for large data."""
    if not exact:
        return df.groupBy(*(by or [])).agg(*[F.percentile_approx(value, p, 10000).alias(f"p{i}") for i, p in enumerate(shares)])
    found = selected(df, {"__p": (value, shares)}, by)
    return found.select(*(by or []), *[F.get("__p", F.lit(i)).alias(f"p{i}") for i in range(len(shares))])


def steps(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """df with step, the absolute change from the row before of the same key."""
    return df.withColumn("step", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("idx"))))


def thresholds(enf: DataFrame, fpr: float = 0.01, nominal: float = 60.0, exact: bool = True) -> DataFrame:
    """tolerance, suspect, trusted, baseline from rows of frq and confidence (the first of a run has none).

    Exact percentiles are selected by counting; with exact=False a sketch of bounded size gives them to 1 in 10,000.
    """
    off, c = F.abs(F.col("frq") - nominal), F.col("confidence")
    if exact:
        found = selected(enf, {"off": (off, [1 - fpr]), "low": (c, [fpr, 0.5])})
        off, low, middle = F.get("off", F.lit(0)), F.get("low", F.lit(0)), F.get("low", F.lit(1))
    else:
        at = lambda v, p: F.percentile_approx(v, p, 10000)
        found = enf.agg(at(off, 1 - fpr).alias("off"), at(c, fpr).alias("low"), at(c, 0.5).alias("middle"))
        off, low, middle = F.col("off"), F.col("low"), F.col("middle")
    mean = enf.agg((1 - F.avg("confidence")).alias("baseline"))  # one row each
    return found.crossJoin(mean).select((off * 1.1).alias("tolerance"), low.alias("suspect"), middle.alias("trusted"), "baseline")


def false_positives(df: DataFrame, value: Column, cuts: list[float], below: bool = False) -> DataFrame:
    """cut, hits, total: how many rows lie beyond each cut; one pass over df."""
    hits = [F.count_if(value < c if below else value > c).alias(f"h{i}") for i, c in enumerate(cuts)]
    row = df.agg(F.count(value).alias("total"), *hits)
    pairs = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"h{i}").alias("hits")) for i, c in enumerate(cuts)])
    return row.select(F.explode(pairs).alias("x"), "total").select("x.cut", "x.hits", "total")


def diagnosis(parts: DataFrame) -> DataFrame:
    """run_id?, repeated, jumps, ratio, stuck, shifted, noisy: what stretch() says about the window.

    stuck: one value makes up over a tenth of it; shifted: one to three steps over 1 Hz inside it; noisy: its standard
    deviation is over three times the baseline's (endless where that is 0).
    """
    keys = [c for c in ["run_id"] if c in parts.columns]
    of = lambda c, part: F.max(F.when(F.col("part") == part, F.col(c)))
    both = parts.groupBy(*keys).agg(of("modal_share", "window").alias("repeated"), of("inner_jumps", "window").alias("jumps"), of("std", "window").alias("__w"), of("std", "baseline").alias("__b"))
    ratio = F.when(F.col("__b") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("__w"), F.col("__b")))
    out = both.where("repeated IS NOT NULL AND __b IS NOT NULL").withColumn("ratio", ratio)
    return out.select(*keys, "repeated", "jumps", "ratio", (F.col("repeated") > 0.10).alias("stuck"), F.col("jumps").between(1, 3).alias("shifted"), (F.col("ratio") > 3).alias("noisy"))


def stretch(enf: DataFrame, start: int, end: int) -> DataFrame:
    """part (baseline, window), n, mean, std, low, high, largest_step, jumps (steps over 1 Hz), modal value and its share; with run_id, of each run.

    jumps counts the step into a part as well, inner_jumps only those within it.
    """
    keys = [c for c in ["run_id"] if c in enf.columns]
    rows = steps(enf.withColumn("value", F.col("frq")).withColumn("one", F.lit(1)), [*keys, "one"])
    rows = rows.withColumn("part", F.when(F.col("idx").between(start, end), "window").otherwise("baseline"))
    base = rows.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.avg("frq").alias("mean"), F.stddev_samp("frq").alias("std"), F.min("frq").alias("low"), F.max("frq").alias("high"), F.max("step").alias("largest_step"), F.count_if(F.col("step") > 1).alias("jumps"), F.count_if((F.col("step") > 1) & (F.col("idx") != start) & (F.col("idx") != end + 1)).alias("inner_jumps"))
    modal = rows.groupBy(*keys, "part", F.round("frq", 4).alias("v")).agg(F.count("*").alias("c")).groupBy(*keys, "part").agg(F.max(F.struct("c", F.negative("v"))).alias("m"))
    both = base.join(modal, [*keys, "part"])
    return both.select(*base.columns, F.negative("m.col2").alias("modal"), (F.col("m.c") / F.col("n")).alias("modal_share"))
