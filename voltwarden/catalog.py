"""The engine's queries over the driver's tables, with SQL that gives the same rows.

`events` stands in for telemetry: user_id % 4 gives nodes, event_type channels, event_id the order. Thresholds are scaled
to its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Enf
from .functions import channels, status
from .operators import align, attacks, calibrate, enf, nlr, scoring, verdict, views
from .sources import bus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "scoreboard"
CFG = Enf()
#: Readings of a series, events apart, that are scanned in one task.
SPAN = 1 << 14

#: Projections that queries share.
SQL_TEL = "tel AS (SELECT event_id AS idx, 'x1000c0s' || (user_id % 4)::VARCHAR || 'b0n0' AS node_id, event_type AS channel, value FROM events)"
SQL_ENF = "enf AS (SELECT floor(event_id / 1800)::BIGINT AS run_id, event_id % 1800 AS idx, 60 + (value - 50) / 1000 AS frq, 60 + (value - 50) / 1000 + ((event_id * 7919) % 101 - 50) / 1e6 AS alt FROM events)"
SQL_FRAMES = SQL_TEL + ", frames AS (SELECT floor(idx / 20)::BIGINT AS idx, node_id, channel, avg(value) AS value FROM tel GROUP BY ALL)"


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("idx"), F.concat(F.lit("x1000c0s"), (F.col("user_id") % 4).cast("string"), F.lit("b0n0")).alias("node_id"), F.col("event_type").alias("channel"), "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tel(spark, sf_dir).withColumn("idx", F.floor(F.col("idx") / 20).cast("long"))
    return rows.groupBy("idx", "node_id", "channel").agg(F.avg("value").alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    frq = 60 + (F.col("value") - 50) / 1000
    return e.select(F.floor(F.col("event_id") / 1800).cast("long").alias("run_id"), (F.col("event_id") % 1800).alias("idx"), frq.alias("frq"), (frq + (F.col("event_id") * 7919 % 101 - 50) / 1e6).alias("alt"))


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


SERIES = "PARTITION BY node_id, channel ORDER BY idx"
KEYS = ["idx", "node_id", "channel"]


def _check(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "status_rank", "code")


# Checks of nodes


@query(f"WITH {SQL_TEL} SELECT idx, node_id, channel, CASE WHEN value < 0 OR value > 200 THEN 2 ELSE 0 END AS status_rank, CASE WHEN value < 0 OR value > 200 THEN 'OUT OF RANGE' ELSE 'ok' END AS code FROM tel")
def nlr_range(spark, sf_dir):
    return _check(nlr.value_range(tel(spark, sf_dir), 0, 200))


@query(f"WITH {SQL_TEL} SELECT idx, node_id, channel, CASE WHEN value <= 1 OR value > 95 THEN 2 ELSE 0 END AS status_rank, CASE WHEN value <= 1 OR value > 95 THEN 'OUT OF RANGE' ELSE 'ok' END AS code FROM tel")
def temp_range(spark, sf_dir):
    return _check(nlr.value_range(tel(spark, sf_dir), 1, 95, low_fails=True))


@query(f"WITH {SQL_TEL}, s AS (SELECT *, abs(value - lag(value) OVER ({SERIES})) > 40 AS bad FROM tel) SELECT idx, node_id, channel, CASE WHEN bad THEN 2 ELSE 0 END AS status_rank, CASE WHEN bad THEN 'DISCONTINUITY' ELSE 'ok' END AS code FROM s")
def nlr_continuity(spark, sf_dir):
    return _check(nlr.continuity(tel(spark, sf_dir), 40, SPAN))


_SQL_UJ = SQL_TEL + ", uj AS (SELECT idx, node_id, 'uj' AS channel, round((sum(value) OVER (PARTITION BY node_id ORDER BY idx)) % 5000, 2) AS value FROM tel)"


def _counter(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return tel(spark, sf_dir).withColumn("value", F.round(F.sum("value").over(w) % 5000, 2)).withColumn("channel", F.lit("uj"))


@query(f"WITH {_SQL_UJ}, f AS (SELECT *, CASE WHEN value < lag(value) OVER ({SERIES}) - 2000 THEN 1 ELSE 0 END AS fell FROM uj) SELECT idx, node_id, round(value + 5000.0 * sum(fell) OVER ({SERIES}), 2) AS unwrapped FROM f")
def counter_unwrap(spark, sf_dir):
    return nlr.unwrapped(_counter(spark, sf_dir), 5000.0, 2000.0, SPAN).select("idx", "node_id", F.round("unwrapped", 2).alias("unwrapped"))


_SQL_MONO = f"""WITH {_SQL_UJ}, dropped AS (SELECT idx, node_id, channel, CASE WHEN idx % 97 = 0 THEN value - 900 ELSE value END AS value FROM uj),
b AS (SELECT *, lag(value) OVER ({SERIES}) AS before FROM dropped),
e AS (SELECT *, CASE WHEN abs(before - value - 5000) <= 1000 THEN 1 ELSE 0 END AS wrap FROM b),
p AS (SELECT *, sum(wrap) OVER ({SERIES}) AS epoch FROM e),
m AS (SELECT *, max(value) OVER (PARTITION BY node_id, channel, epoch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM p)
SELECT idx, node_id, CASE WHEN coalesce(value < most, FALSE) OR (wrap = 0 AND coalesce(value - before > 200, FALSE)) THEN 2 ELSE 0 END AS status_rank,
CASE WHEN coalesce(value < most, FALSE) THEN 'MONOTONICITY VIOLATION' WHEN wrap = 0 AND coalesce(value - before > 200, FALSE) THEN 'ENERGY SPIKE' ELSE 'ok' END AS code FROM m"""


@query(_SQL_MONO)
def energy_monotonicity(spark, sf_dir):
    rows = _counter(spark, sf_dir).withColumn("value", F.when(F.col("idx") % 97 == 0, F.col("value") - 900).otherwise(F.col("value")))
    return nlr.monotonicity(rows, 5000.0, 1000.0, 200.0, SPAN).select("idx", "node_id", "status_rank", "code")


@query(f"""WITH {SQL_FRAMES}, r AS (SELECT a.idx, a.node_id, a.channel, a.value / median(b.value) AS ratio, median(b.value) AS m FROM frames a
JOIN frames b ON a.idx = b.idx AND a.node_id = b.node_id AND a.channel <> b.channel GROUP BY a.idx, a.node_id, a.channel, a.value)
SELECT idx, node_id, channel, round(ratio, 6) AS ratio FROM r WHERE m > 1 AND (ratio < 0.5 OR ratio > 2)""")
def sibling_ratio(spark, sf_dir):
    return nlr.sibling_ratio(frames(spark, sf_dir), 0.5, 2.0).select(*KEYS, F.round("observed", 6).alias("ratio"))


_SQL_POS = SQL_TEL + f", p AS (SELECT *, row_number() OVER ({SERIES}) - 1 AS frame FROM tel)"


def _framed(spark, sf_dir):
    return tel(spark, sf_dir).withColumn("frame", F.row_number().over(nlr.series(tel(spark, sf_dir))) - 1)


@query(f"""WITH {_SQL_POS}, o AS (SELECT *, CASE WHEN value BETWEEN 10 AND 90 THEN 0 ELSE 1 END AS out FROM p),
i AS (SELECT *, sum(out) OVER ({SERIES}) AS island FROM o),
l AS (SELECT *, CASE WHEN sum(1 - out) OVER (PARTITION BY node_id, channel, island ORDER BY idx) >= 6 THEN 1 ELSE 0 END AS long FROM i),
s AS (SELECT *, max(long) OVER ({SERIES}) AS steady FROM l)
SELECT idx, node_id, channel, CASE WHEN frame >= 5 AND steady = 0 THEN 2 ELSE 0 END AS status_rank, CASE WHEN frame >= 5 AND steady = 0 THEN 'STARTUP RAMP' ELSE 'ok' END AS code FROM s""")
def startup_ramp(spark, sf_dir):
    return _check(nlr.startup_ramp(_framed(spark, sf_dir), 10, 90, 5, 6, span=SPAN))


@query(f"""WITH {SQL_TEL}, c AS (SELECT idx, node_id, channel, floor(value / 25) * 25 + 10.0 AS value FROM tel),
g AS (SELECT *, row_number() OVER ({SERIES}) AS pos, [lag(value, 3) OVER ({SERIES}), lag(value, 2) OVER ({SERIES}), lag(value, 1) OVER ({SERIES}), value] AS gram FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY node_id, channel, gram ORDER BY pos RANGE BETWEEN 96 PRECEDING AND 4 PRECEDING) AS seen FROM g),
m AS (SELECT *, max(CASE WHEN pos >= 4 AND len(list_distinct(gram)) >= 2 AND seen > 0 THEN pos END) OVER ({SERIES}) AS hit FROM n)
SELECT idx, node_id, channel, CASE WHEN pos - hit < 5 THEN 2 ELSE 0 END AS status_rank, CASE WHEN pos - hit < 5 THEN 'REPLAY' ELSE 'ok' END AS code FROM m WHERE pos - hit <= 5""")
def replay_ngram(spark, sf_dir):
    coarse = tel(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 25) * 25 + 10.0)
    return _check(nlr.replay(coarse, 4, 100, 5.0, span=SPAN))


@query(f"""WITH RECURSIVE {_SQL_POS}, f AS (
SELECT idx, node_id, channel, value, frame, FALSE AS stuck, 0.0::DOUBLE AS start, 0 AS calm, FALSE AS said, FALSE AS failed FROM p WHERE frame = 0
UNION ALL
SELECT p.idx, p.node_id, p.channel, p.value, p.frame,
 CASE WHEN p.frame < 10 THEN f.stuck WHEN f.stuck THEN NOT (abs(p.value - f.start) <= 10 OR (CASE WHEN abs(p.value - f.value) <= 60 THEN f.calm + 1 ELSE 0 END) >= 5) ELSE abs(p.value - f.value) > 60 END,
 CASE WHEN p.frame >= 10 AND NOT f.stuck AND abs(p.value - f.value) > 60 THEN f.value ELSE f.start END,
 CASE WHEN p.frame >= 10 AND f.stuck AND abs(p.value - f.value) <= 60 THEN f.calm + 1 ELSE 0 END,
 p.frame >= 10 AND (f.stuck OR abs(p.value - f.value) > 60), FALSE
FROM f JOIN p ON p.node_id = f.node_id AND p.channel = f.channel AND p.frame = f.frame + 1)
SELECT idx, node_id, channel, CASE WHEN stuck THEN 2 ELSE 0 END AS status_rank, CASE WHEN stuck THEN 'SUSTAINED DEVIATION' ELSE 'ok' END AS code FROM f WHERE said""")
def sustained_deviation(spark, sf_dir):
    return _check(nlr.sustained(_framed(spark, sf_dir), 60, 10, 10, 5))


# Verdicts


def node_checks(rows: DataFrame) -> DataFrame:
    """Range and step checks as the verifier orders them."""
    return nlr.value_range(rows, 0, 150).withColumn("check_ord", F.lit(0)).unionByName(nlr.continuity(rows, 40).withColumn("check_ord", F.lit(1)))


_SQL_CHECKS = SQL_FRAMES + f""", steps AS (SELECT *, abs(value - lag(value) OVER ({SERIES})) AS step FROM frames),
verdicts AS (SELECT idx, node_id, channel, value > 150 AS over, coalesce(step > 40, FALSE) AS jump, step FROM steps),
merged AS (SELECT *, CASE WHEN over OR jump THEN 2 ELSE 0 END AS status_rank, CASE WHEN over AND jump THEN 'OUT OF RANGE | DISCONTINUITY' WHEN over THEN 'OUT OF RANGE' WHEN jump THEN 'DISCONTINUITY' ELSE 'ok' END AS reason FROM verdicts)"""
_SQL_CORR = (
    _SQL_CHECKS
    + """, pure AS (SELECT *, (jump AND NOT over AND round(step, 2) <= 40 * 2.0) AS pure FROM merged),
same AS (SELECT *, sum(pure::INT) OVER (PARTITION BY idx, channel) AS same, count(*) OVER (PARTITION BY idx, channel) AS nodes FROM pure),
corr AS (SELECT *, (pure AND same >= greatest(2, least(4, nodes)) AND same >= 0.5 * nodes) AS soft FROM same),
final AS (SELECT idx, node_id, channel, reason, soft, CASE WHEN soft THEN 1 ELSE status_rank END AS status_rank FROM corr)"""
)


def verdicts(spark, sf_dir):
    return verdict.merged(node_checks(frames(spark, sf_dir)), KEYS)


@query(f"WITH {_SQL_CHECKS} SELECT idx, node_id, channel, status_rank, reason FROM merged")
def merge_worst(spark, sf_dir):
    return verdicts(spark, sf_dir).select(*KEYS, "status_rank", "reason")


@query(f"WITH {_SQL_CORR} SELECT idx, node_id, channel, status_rank, soft AS corroborated FROM final")
def corroboration(spark, sf_dir):
    return verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0).select(*KEYS, "status_rank", "corroborated")


@query(f"WITH {_SQL_CORR} SELECT idx, node_id, channel, CASE status_rank WHEN 2 THEN 'failed' WHEN 1 THEN 'suspect' ELSE 'trusted' END AS status, CASE status_rank WHEN 2 THEN 0.05::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS score FROM final")
def verdict_scores(spark, sf_dir):
    return verdict.scored(verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0)).select(*KEYS, "status", "score")


@query(f"WITH {_SQL_CORR} SELECT idx, node_id AS layer, max(status_rank) / 2.0::DOUBLE AS score FROM final GROUP BY idx, node_id")
def layer_status(spark, sf_dir):
    v = verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0).withColumnRenamed("node_id", "layer")
    return verdict.layers(v.select("idx", "layer").distinct(), v, ["idx", "layer"])


@query(f"WITH {_SQL_CORR}, l AS (SELECT idx, node_id, max(status_rank) / 2.0::DOUBLE AS score FROM final GROUP BY ALL) SELECT idx, " + ", ".join(f"max(score) FILTER (node_id = 'x1000c0s{i}b0n0') AS x1000c0s{i}b0n0_status" for i in range(4)) + " FROM l GROUP BY idx")
def scoreboard(spark, sf_dir):
    return verdict.scoreboard(layer_status(spark, sf_dir), [f"x1000c0s{i}b0n0" for i in range(4)])


@query(f"WITH {_SQL_CORR} SELECT node_id, channel, count(*) FILTER (status_rank = 0) AS trusted, count(*) FILTER (status_rank = 1) AS suspect, count(*) FILTER (status_rank = 2) AS failed, count(*) AS total FROM final GROUP BY ALL")
def component_counts(spark, sf_dir):
    return verdict.component_counts(verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0), ["node_id", "channel"])


@query(f"WITH {_SQL_CORR} SELECT idx, node_id, max(status_rank) AS status_rank, min(CASE status_rank WHEN 2 THEN 0.05::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END) AS score, coalesce(string_agg(channel || ': ' || reason, '; ' ORDER BY channel) FILTER (status_rank > 0), '') AS reasons FROM final GROUP BY ALL")
def rack_verdicts(spark, sf_dir):
    v = verdict.scored(verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0))
    out = verdict.rack_summary(v, ["idx", "node_id"])
    return out.withColumn("reasons", F.array_join(F.transform("reasons", lambda x: F.concat(x["channel"], F.lit(": "), x["reason"])), "; "))


_SQL_VECTOR = " ".join(f"WHEN contains(reason, '{w}') THEN '{n}'" for w, n in status.VECTORS)


@query(f"WITH {_SQL_CHECKS} SELECT CASE {_SQL_VECTOR} ELSE 'Unclassified' END AS vector, count(*) AS n FROM merged GROUP BY ALL")
def vector_classify(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy(status.vector(F.col("reason")).alias("vector")).agg(F.count("*").alias("n"))


# Grid frequency


@query(f"WITH {SQL_ENF} SELECT run_id, idx, CASE WHEN abs(frq - 60) > 0.1 THEN 2 ELSE 0 END AS status_rank FROM enf")
def enf_nominal(spark, sf_dir):
    return enf.nominal_range(grid(spark, sf_dir), 0.1).select("run_id", "idx", "status_rank")


_SQL_PADDED = SQL_ENF + """, r AS (SELECT run_id, idx, frq, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM enf),
pad AS (SELECT run_id, idx, frq, pos, TRUE AS is_real FROM r
 UNION ALL SELECT run_id, idx, frq, u.k AS pos, FALSE FROM r, (SELECT unnest(range(-9, 1)) AS k) u WHERE pos = 1
 UNION ALL SELECT run_id, idx, frq, pos + u.k, FALSE FROM r, (SELECT unnest(range(1, 11)) AS k) u WHERE pos = n),
lagged AS (SELECT *, frq - 60 AS x, lag(frq - 60) OVER (PARTITION BY run_id ORDER BY pos) AS y FROM pad),
conf AS (SELECT *, max(frq) OVER w = min(frq) OVER w AS flat, var_pop(x) OVER w AS vx, var_pop(y) OVER w AS vy, covar_pop(x, y) OVER w AS c FROM lagged WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)),
anchored AS (SELECT run_id, idx, frq, flat, CASE WHEN pos = 1 THEN 1.0 WHEN vx * vy <= 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, c / sqrt(vx * vy))) END AS confidence FROM conf WHERE is_real)"""


@query(f"WITH {_SQL_PADDED} SELECT run_id, idx, flat, round(confidence, 4) AS confidence FROM anchored")
def anchor_confidence(spark, sf_dir):
    return enf.anchors(grid(spark, sf_dir).select("run_id", "idx", "frq"), CFG.anchor_radius).select("run_id", "idx", "flat", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SQL_PADDED} SELECT run_id, idx, CASE WHEN abs(frq - 60) > 2 OR flat OR round(confidence, 4) < 0.1 THEN 2 WHEN round(confidence, 4) < 0.3 THEN 1 ELSE 0 END AS status_rank FROM anchored")
def enf_verdict(spark, sf_dir):
    a = enf.anchors(grid(spark, sf_dir).select("run_id", "idx", "frq"), CFG.anchor_radius)
    return a.select("run_id", "idx", enf.verdict(F.round("confidence", 4), F.col("frq"), F.col("flat"), 60.0, 2.0, 0.3, 0.1).alias("status_rank"))


@query(f"""WITH {SQL_ENF}, d AS (SELECT run_id, idx, count(*) OVER (w ROWS 29 PRECEDING) AS n, avg(frq) OVER (w ROWS 14 PRECEDING) - avg(frq) OVER (w ROWS BETWEEN 29 PRECEDING AND 15 PRECEDING) AS d FROM enf WINDOW w AS (PARTITION BY run_id ORDER BY idx))
SELECT run_id, idx, CASE WHEN n = 30 THEN round(abs(d), 6) END AS drift, n = 30 AND coalesce(abs(d) > 0.02, FALSE) AS drifting FROM d""")
def raw_drift(spark, sf_dir):
    return enf.raw_drift(grid(spark, sf_dir), 30, 0.02).select("run_id", "idx", F.round("drift", 6).alias("drift"), "drifting")


@query(f"""WITH {SQL_ENF}, p AS (SELECT * FROM enf WHERE (idx + run_id) % 29 <> 7),
c AS (SELECT run_id, idx, count(*) OVER w AS n, var_samp(frq - 60) OVER w AS vx, var_samp(alt - 60) OVER w AS vy, covar_samp(frq - 60, alt - 60) OVER w AS c FROM p WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS 39 PRECEDING))
SELECT e.run_id, e.idx, CASE WHEN n = 40 AND vx >= 5e-6 AND vy >= 5e-6 THEN round(c / sqrt(vx * vy), 4) END AS r FROM enf e LEFT JOIN c USING (run_id, idx)""")
def alt_correlation(spark, sf_dir):
    """Observed frames joined to another stream that lacks some of them."""
    both = grid(spark, sf_dir)
    other = both.where((F.col("idx") + F.col("run_id")) % 29 != 7).select("run_id", "idx", "alt")
    return enf.alternative(enf.paired(both.drop("alt"), other), 40, 0.999, 5e-6).select("run_id", "idx", F.round("r", 4).alias("r"))


_SQL_CONF = SQL_ENF + ", conf AS (SELECT run_id, idx, 1 - ((idx * 37 + run_id * 11) % 50) / 400.0 * (CASE WHEN idx % 300 < 40 THEN 0.2 ELSE 1 END)::DOUBLE AS confidence FROM enf)"


def _confidence(spark, sf_dir):
    e = grid(spark, sf_dir)
    return e.select("run_id", "idx", (1 - (F.col("idx") * 37 + F.col("run_id") * 11) % 50 / 400.0 * F.when(F.col("idx") % 300 < 40, 0.2).otherwise(1.0)).alias("confidence"))


@query(f"""WITH RECURSIVE {_SQL_CONF}, f AS (
SELECT run_id, idx, 0.0::DOUBLE AS s, 0 AS streak, confidence FROM conf WHERE idx = -1
UNION ALL SELECT run_id, -1::BIGINT, 0.0::DOUBLE, 0, 0.0::DOUBLE FROM (SELECT DISTINCT run_id FROM conf)), g AS (
SELECT run_id, idx, s, streak FROM f
UNION ALL
SELECT c.run_id, c.idx,
 CASE WHEN (CASE WHEN c.confidence >= 0.93 THEN g.streak + 1 ELSE 0 END) >= 20 THEN 0.0
 ELSE greatest(0.0, g.s + (1 - c.confidence) - 0.03 - CASE WHEN c.idx >= 9 AND 1 - c.confidence < 0.03 THEN 0.03 ELSE 0.0 END) END,
 CASE WHEN c.confidence >= 0.93 THEN g.streak + 1 ELSE 0 END
FROM g JOIN conf c ON c.run_id = g.run_id AND c.idx = g.idx + 1)
SELECT run_id, idx, round(s, 6) AS cusum FROM g WHERE idx >= 0""")
def local_cusum(spark, sf_dir):
    return enf.local_cusum(_confidence(spark, sf_dir), 0.03, 2.0, 10, 0.93, 20).select("run_id", "idx", F.round("cusum", 6).alias("cusum"))


@query(f"""WITH RECURSIVE {_SQL_CONF}, b AS (SELECT run_id, avg(1 - confidence) AS base FROM conf WHERE idx < 10 GROUP BY run_id), g AS (
SELECT DISTINCT run_id, -1::BIGINT AS idx, 0.0::DOUBLE AS total, 0.0::DOUBLE AS s FROM conf
UNION ALL
SELECT run_id, idx, total, CASE WHEN total > 0.5 THEN 0.0 ELSE total END FROM (
 SELECT c.run_id, c.idx, CASE WHEN c.idx = 9 THEN 0.0 ELSE greatest(0.0, g.s + (1 - c.confidence) - CASE WHEN c.idx < 9 THEN 0.03 ELSE b.base END) END AS total
 FROM g JOIN conf c ON c.run_id = g.run_id AND c.idx = g.idx + 1 JOIN b ON b.run_id = c.run_id))
SELECT run_id, idx, round(total, 6) AS drift_sum, total > 0.5 AS drifted FROM g WHERE idx >= 0""")
def drift_cusum(spark, sf_dir):
    return enf.drift_cusum(_confidence(spark, sf_dir), 0.03, 0.5, 10, 60).select("run_id", "idx", F.round("drift_sum", 6).alias("drift_sum"), "drifted")


@query("""WITH t AS (SELECT floor(event_id / 1800)::BIGINT AS run_id, event_id AS seq, event_id - (event_id * 31 % 7) * (event_id % 3) AS ts FROM events),
m AS (SELECT *, max(ts) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM t),
r AS (SELECT *, coalesce(ts > most, TRUE) AS record FROM m),
s AS (SELECT *, max(record::INT) OVER (PARTITION BY run_id, ts ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
SELECT run_id, seq, CASE WHEN record THEN 'ok' WHEN seen = 1 THEN 'REPLAY' ELSE 'OUT OF ORDER' END AS code FROM s""")
def sequence_guard(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.floor(F.col("event_id") / 1800).cast("long").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") - F.col("event_id") * 31 % 7 * (F.col("event_id") % 3)).alias("ts"))
    return enf.sequence_guard(rows).select("run_id", "seq", "code")


def sql_cleaned(name: str, low: float, high: float) -> str:
    """CTEs and a query that clean the table `name` (run_id, idx, frq), for WITH RECURSIVE."""
    return f"""xs AS (SELECT run_id, list(frq ORDER BY idx) AS x, count(*) AS n FROM {name} GROUP BY run_id), h AS (
SELECT run_id, 0::BIGINT AS i, []::BOOLEAN[] AS flags FROM xs
UNION ALL
SELECT run_id, i + 1, list_append(flags, v NOT BETWEEN {low} AND {high} OR coalesce(mad > 0 AND abs(v - m) > 2.0 * 1.4826 * mad, FALSE)) FROM (
 SELECT run_id, i, flags, v, m, list_aggregate(list_transform(near, lambda y: abs(y - m)), 'median') AS mad FROM (
  SELECT run_id, i, flags, v, near, list_aggregate(near, 'median') AS m FROM (
   SELECT h.run_id, h.i, h.flags, xs.x[h.i + 1] AS v, list_filter(list_transform(list_filter(range(greatest(0, h.i - 11), least(xs.n, h.i + 12)), lambda k: k >= h.i OR NOT h.flags[k + 1]), lambda k: xs.x[k + 1]), lambda y: y BETWEEN {low} AND {high}) AS near
   FROM h JOIN xs ON xs.run_id = h.run_id WHERE h.i < xs.n)))),
f AS (SELECT e.run_id, e.idx, e.frq, l.flags[e.idx + 1] AS flagged FROM {name} e JOIN (SELECT h.run_id, h.flags FROM h JOIN xs ON xs.run_id = h.run_id WHERE h.i = xs.n) l ON l.run_id = e.run_id),
s AS (SELECT *, max(CASE WHEN NOT flagged THEN idx END) OVER (PARTITION BY run_id ORDER BY idx) AS li, min(CASE WHEN NOT flagged THEN idx END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM f)
SELECT s.run_id, s.idx, s.flagged, round(CASE WHEN NOT s.flagged THEN s.frq WHEN l.frq IS NOT NULL AND r.frq IS NOT NULL THEN l.frq + (r.frq - l.frq) * (s.idx - li) / (ri - li) ELSE coalesce(l.frq, r.frq, s.frq) END, 6) AS clean
FROM s LEFT JOIN f l ON l.run_id = s.run_id AND l.idx = s.li LEFT JOIN f r ON r.run_id = s.run_id AND r.idx = s.ri"""


@query(f"WITH RECURSIVE {SQL_ENF}, {sql_cleaned('enf', 59, 61)}")
def hampel(spark, sf_dir):
    flagged = enf.hampel(grid(spark, sf_dir).select("run_id", "idx", "frq"), 11, 2.0, physical=(59.0, 61.0))
    return enf.interpolated(flagged).select("run_id", "idx", "flagged", F.round("clean", 6).alias("clean"))


@query(f"""WITH {SQL_ENF}, f AS (SELECT run_id, idx, frq, idx % 7 < 2 AS flagged FROM enf),
s AS (SELECT *, max(CASE WHEN NOT flagged THEN idx END) OVER (PARTITION BY run_id ORDER BY idx) AS li, min(CASE WHEN NOT flagged THEN idx END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM f)
SELECT s.run_id, s.idx, round(CASE WHEN NOT s.flagged THEN s.frq WHEN l.frq IS NOT NULL AND r.frq IS NOT NULL THEN l.frq + (r.frq - l.frq) * (s.idx - li) / (ri - li) ELSE coalesce(l.frq, r.frq, s.frq) END, 6) AS clean
FROM s LEFT JOIN f l ON l.run_id = s.run_id AND l.idx = s.li LEFT JOIN f r ON r.run_id = s.run_id AND r.idx = s.ri""")
def interpolate(spark, sf_dir):
    flagged = grid(spark, sf_dir).select("run_id", "idx", "frq", (F.col("idx") % 7 < 2).alias("flagged"))
    return enf.interpolated(flagged).select("run_id", "idx", F.round("clean", 6).alias("clean"))


@query()
def combined_smooth(spark, sf_dir):
    return enf.smoothed(grid(spark, sf_dir).select("run_id", "idx", "frq")).select("run_id", "idx", F.round("smooth", 4).alias("smooth"))


# Alignment


@query(f"WITH {SQL_TEL}, p AS (SELECT *, floor((row_number() OVER ({SERIES}) - 1) / 10)::BIGINT AS frame FROM tel) SELECT node_id, channel, frame, round(avg(value), 4) AS value FROM p GROUP BY ALL")
def tumbling_mean(spark, sf_dir):
    return align.tumbling(tel(spark, sf_dir), 10, ["node_id", "channel"], ["value"], span=SPAN).withColumn("value", F.round("value", 4))


@query(f"WITH {SQL_FRAMES}, spine AS (SELECT node_id, channel, unnest(range(0, (SELECT max(idx) + 1 FROM frames))) AS frame FROM (SELECT DISTINCT node_id, channel FROM frames)), j AS (SELECT s.*, f.value FROM spine s LEFT JOIN frames f ON f.idx = s.frame AND f.node_id = s.node_id AND f.channel = s.channel), l AS (SELECT node_id, channel, frame, last_value(value IGNORE NULLS) OVER (PARTITION BY node_id, channel ORDER BY frame) AS v FROM j) SELECT node_id, channel, frame, round(v, 4) AS value FROM l WHERE v IS NOT NULL")
def pad_locf(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumnRenamed("idx", "frame")
    return align.filled(rows, ["node_id", "channel"], None).select("node_id", "channel", "frame", F.round("value", 4).alias("value"))


# Attacks: targets are the channels "click" and "view" of all nodes, frames a tenth to a fifth of 500


def _targets(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.withColumn("target", F.col("channel").isin("click", "view"))


_SQL_TARGETS = SQL_FRAMES + ", t AS (SELECT *, channel IN ('click', 'view') AS target FROM frames)"


def _attack_sql(new: str, hit: str) -> str:
    return f"WITH {_SQL_TARGETS}, h AS (SELECT *, (target AND idx >= 50 AND idx < 100 AND {hit}) AS hit FROM t) SELECT idx, node_id, channel, round(CASE WHEN hit THEN {new} ELSE value END, 4) AS attacked, hit::INT AS label FROM h"


def _attacked(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.round("attacked", 4).alias("attacked"), "label")


@query(_attack_sql("value + 20", "value < 60"))
def attack_bias(spark, sf_dir):
    return _attacked(attacks.inject(_targets(spark, sf_dir), 50, 100, "bias", 20, only=("below", 60)))


@query(_attack_sql("value * 1.5", "TRUE"))
def attack_scale(spark, sf_dir):
    return _attacked(attacks.inject(_targets(spark, sf_dir), 50, 100, "scale", 1.5))


@query(_attack_sql("77.0", "value > 30"))
def attack_absolute(spark, sf_dir):
    return _attacked(attacks.inject(_targets(spark, sf_dir), 50, 100, "absolute", 77, only=("over", 30)))


@query(f"WITH {_SQL_TARGETS} SELECT idx, node_id, channel, (target AND idx >= 50 AND idx < 100)::INT AS label, TRUE AS within FROM t")
def attack_jitter(spark, sf_dir):
    """Draws about an absolute value: within half a unit of it where the attack is, and untouched elsewhere."""
    out = attacks.inject(_targets(spark, sf_dir), 50, 100, "absolute_jitter", 77.0, seed=3)
    within = F.when(F.col("label") == 1, F.abs(F.col("attacked") - 77) <= 0.5).otherwise(F.col("attacked") == F.col("value"))
    return out.select(*KEYS, "label", within.alias("within"))


@query(_attack_sql("value + 40 * (idx - 50) / 50.0", "TRUE"))
def attack_drift(spark, sf_dir):
    return _attacked(attacks.drift(_targets(spark, sf_dir), 50, 100, "additive", 40))


@query(_attack_sql("value * (1 + 0.5 * (idx - 50) / 50.0)", "TRUE"))
def attack_drift_scale(spark, sf_dir):
    return _attacked(attacks.drift(_targets(spark, sf_dir), 50, 100, "multiplicative", 0.5))


_SQL_REPLAY = f"WITH {_SQL_TARGETS}, r AS (SELECT a.*, b.value AS old FROM t a LEFT JOIN t b ON a.node_id = b.node_id AND a.channel = b.channel AND a.idx >= 50 AND a.idx < 100 AND b.idx = 10 + (a.idx - 50) % 25)"


@query(_SQL_REPLAY + " SELECT idx, node_id, channel, round(CASE WHEN target AND old IS NOT NULL THEN old ELSE value END, 4) AS attacked, (target AND old IS NOT NULL)::INT AS label FROM r")
def attack_replay(spark, sf_dir):
    return _attacked(attacks.replay(_targets(spark, sf_dir), ["node_id", "channel"], 50, 100, 10, 25))


@query(f"WITH {_SQL_TARGETS}, l AS (SELECT idx, node_id, (target AND idx >= 50 AND idx < 100)::INT AS label FROM t) SELECT idx, node_id AS layer, max(label) AS truth FROM l GROUP BY ALL UNION ALL SELECT idx, 'Global', max(label) FROM l GROUP BY idx")
def attack_labels(spark, sf_dir):
    return attacks.layer_labels(attacks.inject(_targets(spark, sf_dir), 50, 100, "bias", 20))


@query(f"""WITH {SQL_ENF}, e AS (SELECT run_id, idx, frq FROM enf WHERE idx < 500), d AS (SELECT *, frq - lag(frq) OVER (PARTITION BY run_id ORDER BY idx) AS d, frq - avg(frq) OVER (PARTITION BY run_id) AS x FROM e), p AS (SELECT *, lag(x) OVER (PARTITION BY run_id ORDER BY idx) AS p FROM d)
SELECT run_id, round(CASE WHEN count(*) >= 5 THEN avg(frq) ELSE 60.0 END, 6) AS mean, round(CASE WHEN count(*) >= 5 THEN sqrt(avg(d * d)) ELSE 0.005 END, 6) AS noise, round(CASE WHEN count(*) >= 5 THEN greatest(-0.99, least(0.99, sum(x * p) / sum(p * p))) ELSE 0.95 END, 6) AS phi FROM p GROUP BY run_id""")
def attack_profile(spark, sf_dir):
    each = attacks.profile(grid(spark, sf_dir).select("run_id", "idx", "frq"), 500)
    return each.select("run_id", *[F.round(c, 6).alias(c) for c in ("mean", "noise", "phi")])


@query(f"""WITH RECURSIVE {SQL_ENF}, e AS (SELECT run_id, idx, frq, (idx * 31 % 11 - 5) / 1000.0 AS noise FROM enf WHERE idx >= 199 AND idx < 400), f AS (
SELECT run_id, idx, NULL::DOUBLE AS last FROM e WHERE idx = 199
UNION ALL SELECT e.run_id, e.idx, e.frq + least(0.01, greatest(-0.01, 0.95 * (coalesce(f.last, e.frq) - e.frq) + e.noise)) + 0.002 FROM f JOIN e ON e.run_id = f.run_id AND e.idx = f.idx + 1)
SELECT n.run_id, n.idx, round(coalesce(f.last, n.frq), 6) AS attacked, (f.last IS NOT NULL)::INT AS label FROM enf n LEFT JOIN f ON f.run_id = n.run_id AND f.idx = n.idx AND f.last IS NOT NULL""")
def attack_tracked(spark, sf_dir):
    rows = grid(spark, sf_dir).select("run_id", "idx", "frq", ((F.col("idx") * 31 % 11 - 5) / 1000.0).alias("noise"))
    return attacks.tracked(rows, 200, 400, 0.95, "bias", 0.002).select("run_id", "idx", F.round("attacked", 6).alias("attacked"), "label")


# Scoring: truth marks frames 5..19 of each 50, a detector says 1.0 or 0.5 by value

_SQL_SCORED = SQL_FRAMES + ", s AS (SELECT idx, node_id, max((idx % 50 BETWEEN 5 AND 19)::INT) AS truth, max(CASE WHEN value > 120 THEN 1.0 WHEN value > 80 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM frames GROUP BY ALL)"


def _scored(spark, sf_dir):
    v = F.col("value")
    return frames(spark, sf_dir).groupBy("idx", "node_id").agg(F.max((F.col("idx") % 50).between(5, 19).cast("int")).alias("truth"), F.max(F.when(v > 120, 1.0).when(v > 80, 0.5).otherwise(0.0)).alias("score"))


def _confusion_sql(by: str, source: str, flagged: str) -> str:
    return f"c AS (SELECT {by}, count(*) FILTER (truth = 1 AND {flagged}) AS tp, count(*) FILTER (truth <> 1 AND {flagged}) AS fp, count(*) FILTER (truth <> 1 AND NOT {flagged}) AS tn, count(*) FILTER (truth = 1 AND NOT {flagged}) AS fn FROM {source} GROUP BY ALL), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS rc, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS f FROM c) SELECT {by}, tp, fp, tn, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1, round(f, 6) AS fpr FROM r"


def _rounded(df: DataFrame, by: str) -> DataFrame:
    return df.select(by, "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query(f"WITH {_SQL_SCORED}, " + _confusion_sql("node_id", "s", "score = 1"))
def confusion_strict(spark, sf_dir):
    return _rounded(scoring.confusion(_scored(spark, sf_dir), ["node_id"], F.col("truth") == 1, F.col("score") == 1), "node_id")


@query(f"WITH {_SQL_SCORED}, " + _confusion_sql("node_id", "s", "score >= 0.5"))
def confusion_lenient(spark, sf_dir):
    return _rounded(scoring.confusion(_scored(spark, sf_dir), ["node_id"], F.col("truth") == 1, F.col("score") >= 0.5), "node_id")


_SQL_LAYERS = _SQL_SCORED + """, names AS (SELECT DISTINCT node_id AS layer FROM s UNION SELECT 'Global'), ids AS (SELECT DISTINCT idx FROM s),
g AS (SELECT idx, max(truth) AS t, max(score) AS d FROM s GROUP BY idx),
layered AS (SELECT i.idx, n.layer, coalesce(s.truth, g.t, 0) AS truth, coalesce(s.score, g.d, 0) AS score FROM ids i CROSS JOIN names n LEFT JOIN s ON s.idx = i.idx AND s.node_id = n.layer LEFT JOIN g ON g.idx = i.idx)"""


@query(f"WITH {_SQL_LAYERS}, " + _confusion_sql("layer", "layered", "score = 1"))
def layer_scoring(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumnRenamed("node_id", "layer")
    rows = scoring.by_layer(s.select("idx", "layer", "truth"), s.select("idx", "layer", "score"))
    return _rounded(scoring.confusion(rows, ["layer"], F.col("truth") == 1, F.col("score") == 1), "layer")


_SQL_WINDOWS = _SQL_SCORED + """, st AS (SELECT *, CASE WHEN truth = 1 AND coalesce(lag(truth) OVER (PARTITION BY node_id ORDER BY idx), 0) = 0 THEN 1 ELSE 0 END AS b FROM s), isl AS (SELECT *, sum(b) OVER (PARTITION BY node_id ORDER BY idx) AS island FROM st)"""


@query(f"WITH {_SQL_WINDOWS} SELECT node_id, min(idx) AS start, max(idx) AS \"end\", count(*) AS frames FROM isl WHERE truth = 1 GROUP BY node_id, island")
def attack_windows(spark, sf_dir):
    return scoring.windows(_scored(spark, sf_dir), ["node_id"], F.col("truth") == 1)


@query(f"WITH {_SQL_WINDOWS} SELECT node_id, min(idx) AS start, max(idx) AS \"end\", min(idx) FILTER (score = 1) - min(idx) AS ttd FROM isl WHERE truth = 1 GROUP BY node_id, island")
def time_to_detection(spark, sf_dir):
    return scoring.time_to_detection(_scored(spark, sf_dir), ["node_id"], F.col("truth") == 1, F.col("score") == 1, SPAN)


@query(f"WITH {_SQL_WINDOWS}, t AS (SELECT node_id, min(idx) FILTER (score = 1) - min(idx) AS ttd FROM isl WHERE truth = 1 GROUP BY node_id, island) SELECT node_id, count(*) AS windows, count(ttd) AS detected, round(avg(ttd), 3) AS mean_ttd FROM t GROUP BY node_id")
def mean_ttd(spark, sf_dir):
    t = scoring.time_to_detection(_scored(spark, sf_dir), ["node_id"], F.col("truth") == 1, F.col("score") == 1, SPAN)
    return t.groupBy("node_id").agg(F.count("*").alias("windows"), F.count("ttd").alias("detected"), F.round(F.avg("ttd"), 3).alias("mean_ttd"))


_SQL_EVENTS = SQL_TEL + ", res AS (SELECT node_id AS component_id, idx AS ts FROM tel WHERE value > 150), att AS (SELECT idx AS attack_id, node_id AS component_id, idx AS start_ts, idx + 40 AS end_ts FROM tel WHERE idx % 200 = 3)"


def _results(spark, sf_dir):
    t = tel(spark, sf_dir)
    results = t.select(F.col("node_id").alias("component_id"), F.col("idx").alias("ts"), (F.col("value") > 150).alias("failed"))
    return results, t.where("idx % 200 = 3").select(F.col("idx").alias("attack_id"), F.col("node_id").alias("component_id"), F.col("idx").alias("start_ts"), (F.col("idx") + 40).alias("end_ts"))


@query(f"WITH {_SQL_EVENTS} SELECT (SELECT count(*) FROM res r WHERE EXISTS (SELECT 1 FROM att a WHERE a.component_id = r.component_id AND r.ts BETWEEN a.start_ts AND a.end_ts)) AS tp, (SELECT count(*) FROM res r WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.component_id = r.component_id AND r.ts BETWEEN a.start_ts AND a.end_ts)) AS fp, (SELECT count(*) FROM att a WHERE NOT EXISTS (SELECT 1 FROM res r WHERE a.component_id = r.component_id AND r.ts BETWEEN a.start_ts AND a.end_ts)) AS fn")
def event_scoring(spark, sf_dir):
    return scoring.events(*_results(spark, sf_dir))


@query(f"WITH {_SQL_EVENTS} SELECT attack_id, min(ts) - any_value(start_ts) AS ttd FROM att a LEFT JOIN res r ON a.component_id = r.component_id AND r.ts BETWEEN a.start_ts AND a.end_ts GROUP BY attack_id")
def detection_times(spark, sf_dir):
    return scoring.detection_times(*_results(spark, sf_dir))


# Calibration


@query(f"WITH {_SQL_CONF}, e AS (SELECT c.confidence, enf.frq FROM conf c JOIN enf USING (run_id, idx)) SELECT round(quantile_cont(abs(frq - 60), 0.99) * 1.1, 6) AS tolerance, round(quantile_cont(confidence, 0.01), 6) AS suspect, round(quantile_cont(confidence, 0.5), 6) AS trusted, round(1 - avg(confidence), 6) AS baseline FROM e")
def calibrate_thresholds(spark, sf_dir):
    e = grid(spark, sf_dir).select("run_id", "idx", "frq").join(_confidence(spark, sf_dir), ["run_id", "idx"])
    return calibrate.thresholds(e).select(*[F.round(c, 6).alias(c) for c in ("tolerance", "suspect", "trusted", "baseline")])


@query(f"WITH {SQL_TEL}, s AS (SELECT channel, abs(value - lag(value) OVER ({SERIES})) AS step FROM tel) SELECT channel, round(quantile_cont(step, 0.5), 4) AS p0, round(quantile_cont(step, 0.9), 4) AS p1, round(quantile_cont(step, 0.99), 4) AS p2 FROM s GROUP BY channel")
def calibrate_steps(spark, sf_dir):
    s = calibrate.steps(tel(spark, sf_dir), ["node_id", "channel"])
    return calibrate.percentiles(s, F.col("step"), [0.5, 0.9, 0.99], ["channel"]).select("channel", *[F.round(f"p{i}", 4).alias(f"p{i}") for i in range(3)])


_CUTS = [10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 150.0, 200.0, 300.0]


@query(f"WITH {SQL_TEL} SELECT cut, count(*) FILTER (value > cut) AS hits, count(*) AS total FROM tel, (SELECT unnest({_CUTS})::DOUBLE AS cut) GROUP BY cut")
def false_positive_table(spark, sf_dir):
    return calibrate.false_positives(tel(spark, sf_dir), F.col("value"), _CUTS)


@query(f"""WITH {SQL_ENF}, e AS (SELECT run_id, idx, frq, CASE WHEN idx BETWEEN 800 AND 899 THEN 'window' ELSE 'baseline' END AS part, abs(frq - lag(frq) OVER (PARTITION BY run_id ORDER BY idx)) AS step FROM enf),
v AS (SELECT run_id, part, round(frq, 4) AS v, count(*) AS c FROM e GROUP BY ALL), m AS (SELECT run_id, part, arg_max(v, (c, -v)) AS modal, max(c) AS c FROM v GROUP BY run_id, part)
SELECT run_id, part, count(*) AS n, round(avg(frq), 6) AS mean, round(stddev_samp(frq), 6) AS std, round(min(frq), 6) AS low, round(max(frq), 6) AS high, round(max(step), 6) AS largest_step, count(*) FILTER (step > 1) AS jumps, any_value(modal) AS modal, round(any_value(m.c) / count(*)::DOUBLE, 6) AS modal_share FROM e JOIN m USING (run_id, part) GROUP BY run_id, part""")
def glitch_diagnosis(spark, sf_dir):
    s = calibrate.stretch(grid(spark, sf_dir).select("run_id", "idx", "frq"), 800, 899)
    return s.select("run_id", "part", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high", "largest_step")], "jumps", "modal", F.round("modal_share", 6).alias("modal_share"))


# Views

_SQL_LONG = SQL_FRAMES + """, long AS (SELECT idx, node_id, CASE WHEN channel IN ('click', 'view') THEN 'gpu_power' WHEN channel = 'error' THEN 'gpu_temp' ELSE 'cpu_power' END AS kind, channel = 'signup' AS is_core, CASE WHEN channel = 'view' THEN 1 ELSE 0 END AS ordinal, value FROM frames),
totals AS (SELECT idx, node_id, coalesce(sum(value) FILTER (kind = 'gpu_power'), 0) AS gpu_w, coalesce(sum(value) FILTER (kind = 'cpu_power' AND NOT is_core), 0) AS cpu_w, avg(value) FILTER (kind = 'gpu_temp') AS gpu_c FROM long GROUP BY ALL)"""


def _long(spark, sf_dir):
    c = F.col("channel")
    kind = F.when(c.isin("click", "view"), "gpu_power").when(c == "error", "gpu_temp").otherwise("cpu_power")
    return frames(spark, sf_dir).select("idx", "node_id", kind.alias("kind"), (c == "signup").alias("is_core"), F.when(c == "view", 1).otherwise(0).alias("ordinal"), "value")


@query(f"WITH {_SQL_LONG} SELECT idx, node_id, round(gpu_w, 4) AS gpu_w, round(cpu_w, 4) AS cpu_w, round(gpu_w + cpu_w, 4) AS total_w, round(gpu_c, 4) AS gpu_c FROM totals")
def node_totals(spark, sf_dir):
    return views.node_totals(_long(spark, sf_dir)).select("idx", "node_id", *[F.round(c, 4).alias(c) for c in ("gpu_w", "cpu_w", "total_w", "gpu_c")])


@query(f"WITH {_SQL_LONG}, w AS (SELECT idx, node_id, ordinal, max(value) FILTER (kind = 'gpu_power') AS a, max(value) FILTER (kind = 'gpu_temp') AS b FROM long GROUP BY ALL) SELECT idx, node_id, ordinal, round(a, 4) AS watts, round(b, 4) AS degrees FROM w WHERE a IS NOT NULL OR b IS NOT NULL")
def node_inspector(spark, sf_dir):
    d = views.devices(views.samples(_long(spark, sf_dir)), "gpu_w", "gpu_c")
    return d.select("idx", "node_id", "ordinal", F.round("a", 4).alias("watts"), F.round("b", 4).alias("degrees"))


@query(f"""WITH {_SQL_LONG}, w AS (SELECT idx, node_id, count(*) FILTER (kind = 'gpu_power') AS gpus, round(coalesce(sum(value) FILTER (kind = 'gpu_power'), 0), 4) AS gpu_w FROM long GROUP BY ALL)
SELECT idx, node_id, gpus, gpu_w, CASE WHEN idx % 7 <> 3 THEN idx % 3 / 2.0 END AS status, CASE WHEN idx % 4 <> 1 THEN idx % 2 / 2.0 END AS enf_status FROM w""")
def sample_statuses(spark, sf_dir):
    """Samples with the node's own status and that of the frequency, where a frame has them."""
    long, i = _long(spark, sf_dir), F.col("idx")
    each = long.select("idx", "node_id").distinct()
    scores = each.where(i % 7 != 3).withColumn("score", i % 3 / 2.0).unionByName(each.select("idx", F.lit("ENF").alias("node_id")).distinct().where(i % 4 != 1).withColumn("score", i % 2 / 2.0))
    s = views.samples(long, scores)
    total = F.aggregate(F.map_values("gpu_w"), F.lit(0.0), lambda a, v: a + v)
    return s.select("idx", "node_id", F.size("gpu_w").cast("long").alias("gpus"), F.round(total, 4).alias("gpu_w"), "status", "enf_status")


@query(f"WITH {SQL_TEL}, n AS (SELECT DISTINCT node_id FROM tel) SELECT node_id, 'node' || lpad((row_number() OVER (ORDER BY node_id) - 1)::VARCHAR, 2, '0') AS short_id FROM n")
def normalize_ids(spark, sf_dir):
    return views.normal_ids(tel(spark, sf_dir))


_SQL_RACK = "rack AS (SELECT node_id, 'Rack ' || (floor((row_number() OVER (ORDER BY node_id) - 1) / 2)::INT + 1)::VARCHAR AS rack FROM (SELECT DISTINCT node_id FROM totals))"


@query(f"WITH {_SQL_LONG}, {_SQL_RACK} SELECT idx, rack, round(sum(gpu_w + cpu_w), 4) AS total_w, max(CASE WHEN gpu_w > 150 THEN 2 WHEN gpu_w > 80 THEN 1 ELSE 0 END) AS worst FROM totals JOIN rack USING (node_id) GROUP BY ALL")
def rack_rollup(spark, sf_dir):
    state = views.node_totals(_long(spark, sf_dir)).withColumn("status_rank", F.when(F.col("gpu_w") > 150, 2).when(F.col("gpu_w") > 80, 1).otherwise(0))
    return views.rack_totals(state, views.racks(state, 2)).select("idx", "rack", F.round("total_w", 4).alias("total_w"), "worst")


@query(f"WITH {_SQL_LONG} SELECT idx, count(*) AS total, count(*) FILTER (gpu_w <= 80) AS normal, count(*) FILTER (gpu_w > 80 AND gpu_w <= 150) AS warning, count(*) FILTER (gpu_w > 150) AS alert FROM totals GROUP BY idx")
def summary_cards(spark, sf_dir):
    state = views.node_totals(_long(spark, sf_dir)).withColumn("status_rank", F.when(F.col("gpu_w") > 150, 2).when(F.col("gpu_w") > 80, 1).otherwise(0))
    return views.summary(state, ["idx"])


_SQL_POLLS = SQL_FRAMES + """, polls AS (SELECT node_id, idx * 2.0::DOUBLE AS ts, max(CASE WHEN value > 120 THEN 2 WHEN value > 80 THEN 1 ELSE 0 END) AS severity, max(CASE WHEN value > 150 THEN 'Replay' ELSE 'Unclassified' END) AS vector, round(max(value), 4) AS value FROM frames GROUP BY node_id, idx),
ch AS (SELECT *, CASE WHEN severity IS DISTINCT FROM lag(severity) OVER (PARTITION BY node_id ORDER BY ts) THEN 1 ELSE 0 END AS n FROM polls), runs AS (SELECT *, sum(n) OVER (PARTITION BY node_id ORDER BY ts) AS run FROM ch),
episodes AS (SELECT node_id, severity, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS samples, coalesce(arg_min(vector, ts) FILTER (vector <> 'Unclassified'), 'Unclassified') AS vector, max(value) AS peak, arg_max(value, ts) AS last_value, max(ts) = (SELECT max(ts) FROM polls) AS ongoing FROM runs WHERE severity > 0 GROUP BY node_id, run, severity)"""


def _polls(spark, sf_dir):
    v = F.col("value")
    return frames(spark, sf_dir).groupBy("node_id", (F.col("idx") * 2.0).alias("ts")).agg(F.max(F.when(v > 120, 2).when(v > 80, 1).otherwise(0)).alias("severity"), F.max(F.when(v > 150, "Replay").otherwise("Unclassified")).alias("vector"), F.round(F.max("value"), 4).alias("value"))


def _episodes(spark, sf_dir):
    polls = _polls(spark, sf_dir)
    last = polls.agg(F.max("ts").alias("last"))
    out = views.episodes(polls, F.lit(None).cast("double")).crossJoin(F.broadcast(last))  # one row
    return out.withColumn("ongoing", F.col("end_ts") == F.col("last")).drop("last")


@query(f"WITH {_SQL_POLLS} SELECT * FROM episodes")
def episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)


@query(f"""WITH {_SQL_POLLS}, m AS (SELECT *, max(end_ts) OVER (PARTITION BY severity ORDER BY start_ts, end_ts, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM episodes),
g AS (SELECT *, sum(CASE WHEN start_ts - latest <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY severity ORDER BY start_ts, end_ts, node_id ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT severity, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(DISTINCT node_id) AS nodes, sum(samples)::BIGINT AS samples, max(peak) AS peak, bool_or(ongoing) AS ongoing, count(*) AS children FROM g GROUP BY severity, grp""")
def incidents(spark, sf_dir):
    out = views.incidents(_episodes(spark, sf_dir), 5.0, ["severity"])
    return out.select("severity", "start_ts", "end_ts", "nodes", "samples", "peak", "ongoing", F.size("children").cast("long").alias("children"))


@query(f"WITH {_SQL_POLLS} SELECT node_id, count(*) FILTER (severity > 0) AS alerts, max(ts) FILTER (severity > 0) AS last_ts, arg_max(severity, ts) FILTER (severity > 0) AS last_severity FROM polls GROUP BY node_id")
def alert_stats(spark, sf_dir):
    return views.alert_stats(_polls(spark, sf_dir))


@query(f"WITH {_SQL_POLLS} SELECT * FROM episodes WHERE severity = 2 ORDER BY end_ts DESC, node_id, start_ts LIMIT 100")
def timeline_topk(spark, sf_dir):
    return views.timeline(_episodes(spark, sf_dir), 100, severity=2)


@query(f"WITH {_SQL_POLLS}, r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC) AS k FROM polls) SELECT node_id, ts, severity, vector, value FROM r WHERE k <= 25")
def recent_history(spark, sf_dir):
    return views.newest(_polls(spark, sf_dir), ["node_id"], 25, "ts")


@query(f"WITH {_SQL_POLLS}, s AS (SELECT node_id, ts, CASE WHEN severity = 0 THEN NULL ELSE severity END AS severity FROM polls) SELECT node_id, ts, severity, last_value(severity IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY ts) AS sticky FROM s")
def sticky_status(spark, sf_dir):
    s = _polls(spark, sf_dir).select("node_id", "ts", F.when(F.col("severity") > 0, F.col("severity")).alias("severity"))
    return views.sticky(s, ["node_id"], "severity", "ts")


# Records, names and sets


@query("SELECT event_type AS object, event_id % 5 AS property, arg_max(value, event_id) AS value, max(event_id) AS ts FROM events GROUP BY ALL")
def twin_state(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return views.latest_state(e.select(F.col("event_type").alias("object"), (F.col("event_id") % 5).alias("property"), "value", F.col("event_id").alias("ts")))


@query("SELECT event_id::DOUBLE AS timestamp, event_type AS component_id, CASE WHEN value > 100 THEN 'failed' ELSE 'trusted' END AS status, value AS score FROM events")
def json_bus(spark, sf_dir):
    lines = _bus_results(spark, sf_dir).unionByName(_bus_samples(spark, sf_dir))
    return bus.parse(lines, "VerificationResult").select("timestamp", "component_id", "status", "score")


def _bus_results(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_id").cast("double").alias("timestamp"), F.col("event_type").alias("component_id"), F.when(F.col("value") > 100, "failed").otherwise("trusted").alias("status"), F.col("value").alias("score"), F.lit(None).cast("double").alias("anchor_ref"), F.lit("ok").alias("reason"), "event_id")
    return bus.envelope(rows, "VerificationResult")


def _bus_samples(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = e.select(F.col("event_id").cast("double").alias("timestamp"), F.col("event_type").alias("node_id"), F.col("value").alias("power_w"), F.lit("training").alias("workload_class"))
    return bus.envelope(samples, "PowerSample")


@query(f"WITH {SQL_FRAMES} SELECT idx, node_id, CASE channel WHEN 'click' THEN 'gpu-0[W]' WHEN 'view' THEN 'gpu-1[W]' WHEN 'error' THEN 'gpu-0[C]' WHEN 'signup' THEN 'cpu-0-core[W]' ELSE 'cpu-0[uJ]' END AS channel, CASE channel WHEN 'click' THEN 'gpu_power' WHEN 'view' THEN 'gpu_power' WHEN 'error' THEN 'gpu_temp' WHEN 'signup' THEN 'cpu_power' ELSE 'cpu_uj' END AS kind, CASE channel WHEN 'view' THEN 1 ELSE 0 END AS ordinal, channel = 'signup' AS is_core, round(value, 4) AS value FROM frames")
def unpivot_wide(spark, sf_dir):
    names = {"click": "gpu-0[W]", "view": "gpu-1[W]", "error": "gpu-0[C]", "signup": "cpu-0-core[W]", "purchase": "cpu-0[uJ]"}
    rows = frames(spark, sf_dir)
    renamed = rows.withColumn("channel", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("channel")])
    wide = channels.to_wide(renamed, [f"x1000c0s{i}b0n0_{c}" for i in range(4) for c in names.values()])
    return channels.to_long(wide).select("idx", "node_id", "channel", "kind", "ordinal", "is_core", F.round("value", 4).alias("value"))


@query(f"WITH {SQL_TEL} SELECT channel FROM tel UNION SELECT node_id FROM tel")
def layer_union(spark, sf_dir):
    t = tel(spark, sf_dir)
    return scoring.layer_names(t.select(F.col("channel").alias("layer")), t.select(F.col("node_id").alias("layer"))).withColumnRenamed("layer", "channel")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE WHEN event_id % 3 = 1 THEN (event_id % 24) * 3600.0 + 5 * 60 + 7 END AS seconds FROM events")
def resolve_times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    number = F.when(i % 3 == 0, i.cast("string")).otherwise("n/a")
    clock = F.when(i % 3 == 1, F.format_string("%02d:05:07", i % 24)).otherwise("later")
    return e.select("event_id", status.seconds(number, clock).alias("seconds"))


@query(f"WITH {_SQL_POLLS}, totals AS (SELECT DISTINCT node_id FROM polls), {_SQL_RACK} SELECT e.node_id, e.severity, e.start_ts, coalesce(r.rack, '--') AS rack FROM episodes e LEFT JOIN rack r ON r.node_id = e.node_id AND r.rack <> 'Rack 2'")
def episode_racks(spark, sf_dir):
    rack = views.racks(_polls(spark, sf_dir), 2).where("rack <> 'Rack 2'")
    return views.with_rack(_episodes(spark, sf_dir), rack).select("node_id", "severity", "start_ts", "rack")


@query(f"WITH {_SQL_CORR}, n AS (SELECT node_id, 'node' || lpad((row_number() OVER (ORDER BY node_id) - 1)::VARCHAR, 2, '0') AS s FROM (SELECT DISTINCT node_id FROM frames WHERE node_id <> 'x1000c0s3b0n0')) SELECT idx, coalesce(s, f.node_id) || '/' || channel AS component_id, status_rank FROM final f LEFT JOIN n USING (node_id)")
def rename_components(spark, sf_dir):
    v = verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0)
    ids = views.normal_ids(frames(spark, sf_dir).where("node_id <> 'x1000c0s3b0n0'"))
    return views.renamed_components(v.select("idx", F.concat_ws("/", "node_id", "channel").alias("component_id"), "status_rank"), ids)


@query(f"WITH {_SQL_LONG}, h AS (SELECT idx, node_id, CASE WHEN gpu_w > 0 THEN round(gpu_w, 4) END AS frq, CASE WHEN gpu_w > 150 THEN 'warning' WHEN gpu_w > 80 THEN 'suspect' END AS label FROM totals) SELECT idx, arg_min(frq, node_id) FILTER (frq IS NOT NULL) AS frq, coalesce(arg_min(label, node_id) FILTER (label IS NOT NULL), '--') AS label FROM h GROUP BY idx")
def header_values(spark, sf_dir):
    t = views.node_totals(_long(spark, sf_dir))
    g = F.col("gpu_w")
    return views.header(t.select("idx", "node_id", F.when(g > 0, F.round(g, 4)).alias("frq"), F.when(g > 150, "warning").when(g > 80, "suspect").alias("label")))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'good' WHEN event_id % 4 = 1 THEN 'suspect' WHEN event_id % 4 = 2 THEN 'warning' ELSE '--' END AS label, CASE WHEN event_id % 4 = 0 THEN 'green' WHEN event_id % 4 = 1 THEN 'yellow' WHEN event_id % 4 = 2 THEN 'red' ELSE 'grey' END AS colour FROM events")
def status_labels(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    score = F.when(F.col("event_id") % 4 == 3, F.lit(None)).otherwise(F.col("event_id") % 4 / 2.0)
    return e.select("event_id", status.label(score).alias("label"), status.colour(score).alias("colour"))


@query("SELECT event_id * 1.5 - 20 AS ts, s.event_id_at AS idx, s.frq FROM (SELECT *, greatest(0, least((SELECT max(event_id) FROM events), floor((event_id * 1.5 - 20) * 0.5)::BIGINT)) AS at FROM events) t JOIN (SELECT event_id AS event_id_at, value AS frq FROM events) s ON s.event_id_at = t.at")
def anchor_lookup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    series = e.select(F.col("event_id").alias("idx"), F.col("value").alias("frq"))
    return views.anchor_at(series, e.select((F.col("event_id") * 1.5 - 20).cast("double").alias("ts")), 0.5)


@query(f"WITH {SQL_TEL}, have AS (SELECT DISTINCT node_id FROM tel), want AS (SELECT 'x1000c0s' || k::VARCHAR || 'b0n0' AS object FROM (SELECT unnest(range(0, 9)) AS k)) SELECT object FROM want WHERE object NOT IN (SELECT node_id FROM have)")
def missing_twin_objects(spark, sf_dir):
    want = spark.range(9).select(F.concat(F.lit("x1000c0s"), F.col("id").cast("string"), F.lit("b0n0")).alias("object"))
    return views.missing_objects(want, tel(spark, sf_dir).select(F.col("node_id").alias("object")))


@query(f"WITH {SQL_FRAMES}, p AS (SELECT node_id, channel, idx AS frame, value FROM frames), e AS (SELECT min(m) AS m FROM (SELECT max(frame) AS m FROM p GROUP BY node_id, channel)) SELECT node_id, channel, frame, round(value, 4) AS value FROM p, e WHERE frame <= m")
def trim_short(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumnRenamed("idx", "frame")
    return align.trimmed(rows, ["node_id", "channel"]).select("node_id", "channel", "frame", F.round("value", 4).alias("value"))


@query(f"WITH {_SQL_POLLS}, m AS (SELECT max(ts) AS t FROM polls), i AS (SELECT p.*, ts >= t - 100 AS near, max((ts >= t - 100)::INT) OVER (PARTITION BY node_id) AS has FROM polls p, m) SELECT node_id, ts, value FROM i WHERE near OR has = 0")
def view_window(spark, sf_dir):
    return views.recent(_polls(spark, sf_dir), ["node_id"], 100.0).select("node_id", "ts", "value")


@query(f"WITH {_SQL_CORR} SELECT idx, CASE max(status_rank) WHEN 2 THEN 'failed' WHEN 1 THEN 'suspect' ELSE 'trusted' END AS status FROM final GROUP BY idx")
def annotated_status(spark, sf_dir):
    v = verdict.corroborated(verdicts(spark, sf_dir), 4, 0.5, 2.0)
    return verdict.annotated(v, ["idx"])




from . import catalog_files, catalog_streams, catalog_verify  # noqa: E402, F401  (they register their queries)
