"""Mixing sources to target weights by hash-threshold histograms.

A source's target is a share of all words by its weight, at most `cap` times the source's own words. Every document is
taken as often as the target holds the whole source; the rest of the target is a budget, met by those documents of the
source whose hash lies below a threshold. The threshold comes from sums of words by source and hash bucket: the bucket in
which the budget ends is refined into finer buckets, level by level, and all others are decided. Nothing is sorted or
numbered; a hash of the id decides for each document by itself, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of the hash a level, and levels: 4096 buckets a source and level, 36 bits in all.
DIGITS, LEVELS = 3, 3
#: Sources whose rows of the plan, some hundred bytes each, may be broadcast; parts that a source's documents are joined in
#: where there are more.
FEW, SALTS = 1 << 16, 16
#: Thresholds a source. The document at which a budget ends may be long: what it leaves is a budget for shorter ones.
ROUNDS = 3


def bucket_hash(doc_id: Column, seed: str = "") -> Column:
    """DIGITS * LEVELS hexadecimal digits; null ids hash like an empty string."""
    return F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, DIGITS * LEVELS)


def targets(sizes: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """source, source_size, target: from rows of source and size.

    Sources in code point order, null last, take the weights in turn, over and over. With the sources in order of the
    share at which their cap binds, those before a place are at their cap and the others share the rest by weight; the
    place is the first at which that share is below the cap. One row a source is all that this sees.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("place").asc())
    so_far, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().orderBy(F.lit(1)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(so_far), F.lit(0))) / F.sum("weight").over(on))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)["level"])
    return by.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")).alias("target"))


def by_source(docs: DataFrame, one: DataFrame, own: str, source: str, few: bool) -> DataFrame:
    """docs joined to a table of a row a source (its source in `own`): broadcast where these are few, else in parts of each source."""
    if few:
        return docs.join(F.broadcast(one), docs[source].eqNullSafe(one[own]))
    salt, other = common.fresh(docs.join(one.limit(0), F.lit(True)), "salt", "part")
    each = one.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c != source]), F.lit(SALTS)).cast("int"))
    return rows.join(each, rows[source].eqNullSafe(each[own]) & (F.col(salt) == F.col(other))).drop(salt, other)


def thresholds(slim: DataFrame, state: DataFrame, last: bool, few: bool = True) -> DataFrame:
    """source, bound, left: a round of the search for thresholds.

    state: source, budget, from_hash, most. The documents of a source with a hash from `from_hash` on and at most `most`
    words are open to it; those of them below `bound` fit its budget, and `left` of that remains. The document at which
    the budget ends is taken in the last round if that comes nearer to it.
    """
    at = state.select("source", "budget", "from_hash", "most", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = None
    for level in range(1, LEVELS + 1):
        d, a = slim.alias("d"), (F.broadcast(at) if few else at).alias("a")
        inside = d.join(a, F.col("d.source").eqNullSafe(F.col("a.source")) & F.col("d.hash").startswith(F.col("a.prefix")) & (F.col("d.hash") >= F.col("a.from_hash")) & (F.col("d.size") <= F.col("a.most")))
        sums = inside.groupBy("d.source", F.substring("d.hash", 1, DIGITS * level).alias("bucket"), "a.budget", "a.from_hash", "a.most", "a.below").agg(F.sum("d.size").alias("size"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("under", F.col("below") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        # the bucket in which the budget ends: 4096 rows a source at most stand here
        end = F.min(F.when(F.col("under") + F.col("size") > F.col("budget"), F.struct("bucket", "under", "size")))
        ends = sums.groupBy("source", "budget", "from_hash", "most").agg(end.alias("x"), F.sum("size").alias("total"))
        ends = common.written(ends.select("source", "budget", "from_hash", "most", F.col("x.bucket").alias("prefix"), F.col("x.under").alias("below"), "x.size", "total"), f"bounds-{level}")
        if level == 1:
            done = ends.where("prefix IS NULL").select("source", F.lit("~").alias("bound"), (F.col("budget") - F.col("total")).alias("left"))
        at = ends.where("prefix IS NOT NULL")
    # the last bucket holds a document, or some of one hash
    nearer = F.lit(last) & (F.abs(F.col("below") + F.col("size") - F.col("budget")) < F.abs(F.col("below") - F.col("budget")))
    return done.unionByName(at.select("source", F.when(nearer, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("bound"), (F.col("budget") - F.col("below")).alias("left")))


def mix(df: DataFrame, weights: list[int] | None = None, cap: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "") -> DataFrame:
    """df with size, source_size, target, copies and taken (words: copies times size).

    A column of df that has one of these names is replaced. Null texts and texts of white space have size 0 and are taken
    as others of their source are, which adds nothing; a null source is a source of its own. Rows that repeat an id share
    a hash and go together. An empty table has an empty result; where there is no word at all, targets are 0.
    """
    weights = weights or [1, 2, 3]
    df = df.drop("size", "source_size", "target", "copies", "taken")
    own, hashed, *bounds = common.fresh(df, "source", "hash", *[f"{x}{r}" for r in range(ROUNDS) for x in ("from", "most", "bound")])
    slim = common.written(df.select(F.col(source).alias("source"), common.word_count(F.col(text)).alias("size"), bucket_hash(F.col(doc_id), seed).alias("hash")), "sizes")
    goals = common.written(targets(slim, weights, cap), "targets")
    few = goals.count() <= FEW
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit("").alias("from_hash"), F.lit(float("inf")).alias("most"))
    plan = goals.select("source", "source_size", "target", whole.alias("copies"))
    more = F.lit(False)
    for r in range(ROUNDS):
        found = common.written(thresholds(slim, state, r == ROUNDS - 1, few), f"round-{r}")
        begin, most, bound = bounds[3 * r : 3 * r + 3]
        both = state.join(found.withColumnRenamed("source", own), F.col("source").eqNullSafe(F.col(own))).drop(own)
        plan = plan.join(both.select(F.col("source").alias(own), F.col("from_hash").alias(begin), F.col("most").alias(most), F.col("bound").alias(bound)), F.col("source").eqNullSafe(F.col(own)), "left").drop(own)
        more = more | (F.col(bound).isNotNull() & (F.col(hashed) >= F.col(begin)) & (F.col(hashed) < F.col(bound)) & (F.col("size") <= F.col(most)))
        state = both.select("source", F.col("left").alias("budget"), F.col("bound").alias("from_hash"), F.col("left").alias("most"))
    plan = common.written(plan.withColumnRenamed("source", own), "plan")
    out = df.withColumn("size", common.word_count(F.col(text))).withColumn(hashed, bucket_hash(F.col(doc_id), seed))
    out = by_source(out, plan, own, source, few)
    out = out.withColumn("copies", F.col("copies") + F.when(more, 1).otherwise(0))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(own, hashed, *bounds)


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of mix() as often as it takes them, without its columns."""
    (nth,) = common.fresh(mixed, "nth")
    some = mixed.where("copies > 0")
    return some.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).drop(nth, "size", "source_size", "target", "copies", "taken")


#: The same mix in SQL, over a table `documents`: the thresholds found by sums in hash order.
_ROUND = """
hashes{r} AS (
  SELECT s.source, s.hash, SUM(s.size)::BIGINT AS size, any_value(t.budget) AS budget
  FROM sized s JOIN state{r} t ON s.source IS NOT DISTINCT FROM t.source AND s.hash >= t.from_hash AND s.size <= t.most
  GROUP BY s.source, s.hash),
run{r} AS (SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM hashes{r}),
ends{r} AS (
  SELECT source, any_value(budget) AS budget, SUM(size) AS total, min(hash) FILTER (upto > budget) AS hash,
         arg_min(upto, hash) FILTER (upto > budget) AS upto, arg_min(size, hash) FILTER (upto > budget) AS size
  FROM run{r} GROUP BY source),
found{r} AS (
  SELECT source, CASE WHEN hash IS NULL THEN '~'
                      WHEN {last} AND abs(upto - budget) < abs(upto - size - budget) THEN hash || '~' ELSE hash END AS bound,
         CASE WHEN hash IS NULL THEN budget - total ELSE budget - (upto - size) END AS remains
  FROM ends{r}),
both{r} AS (SELECT t.*, f.bound, f.remains FROM state{r} t JOIN found{r} f ON t.source IS NOT DISTINCT FROM f.source),
state{n} AS (SELECT source, remains AS budget, bound AS from_hash, remains AS most FROM both{r}),"""
SQL = (
    """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size,
         substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 9) AS hash
  FROM documents),
by_source AS (
  SELECT source, SUM(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + place % 3 AS weight, 3 * source_size AS most FROM by_source),
levels AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / SUM(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed),
level AS (SELECT arg_min(own_level, (most / weight, place)) AS level FROM levels WHERE own_level * weight <= most),
goals AS (SELECT source, source_size, least(level * weight, most::DOUBLE) AS target FROM levels, level),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals),
state0 AS (SELECT source, target - copies * source_size AS budget, '' AS from_hash, 'inf'::DOUBLE AS most FROM whole),"""
    + "".join(_ROUND.format(r=r, n=r + 1, last=str(r == ROUNDS - 1).upper()) for r in range(ROUNDS))
    + """
thresholds AS ("""
    + " UNION ALL ".join(f"SELECT source, from_hash, most, bound FROM both{r}" for r in range(ROUNDS))
    + """)
SELECT s.doc_id, s.size, w.source_size, w.target,
       (w.copies + CASE WHEN EXISTS (SELECT 1 FROM thresholds t WHERE t.source IS NOT DISTINCT FROM s.source
          AND s.hash >= t.from_hash AND s.hash < t.bound AND s.size <= t.most) THEN 1 ELSE 0 END) * s.size AS taken
FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source
"""
)
