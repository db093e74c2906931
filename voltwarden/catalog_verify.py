"""The whole verifier over the driver's tables: runs of 400 frames, with limits scaled to the values, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SQL_FRAMES, frames, query
from .config import Enf, Nlr
from .plans.verify import verify
from .sources.scratch import kept

NODES = Nlr(
    ceiling_w=150.0, gpu_step_w=40.0, cpu_step_w=40.0, temp_step_c=40.0, recovery_w=10.0, recovery_c=10.0, quiet_frames=10, recovery_run=5,
    ramp_low_w=10.0, ramp_high_w=90.0, ramp_deadline=5, ramp_run=6, sibling_gpu_w=(0.5, 2.0), sync_step_multiple=2.0,
)
GRID = Enf(tolerance_hz=0.02, trusted=0.1, suspect=-0.2, raw_drift_hz=0.004, alt_threshold=0.965)
#: Decimal places to which a mean is the same in whatever order its values, of up to 100,000, were summed.
PLACES = 10

_SERIES = "PARTITION BY run_id, node_id, channel ORDER BY idx"
_SQL_NODES = f"""{SQL_FRAMES}, vf AS (
 SELECT idx // 400 AS run_id, idx % 400 AS idx, node_id, CASE channel WHEN 'click' THEN 'gpu-0[W]' WHEN 'view' THEN 'gpu-1[W]' WHEN 'error' THEN 'gpu-0[C]' WHEN 'signup' THEN 'cpu-0-core[W]' ELSE 'cpu-0[W]' END AS channel,
  CASE WHEN channel IN ('click', 'view') THEN 'gpu_power' WHEN channel = 'error' THEN 'gpu_temp' ELSE 'cpu_power' END AS kind,
  CASE WHEN channel = 'error' THEN floor(value / 25) * 25 + 10.0 ELSE round(value, 4) END AS value FROM frames),
p AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS frame, row_number() OVER ({_SERIES}) AS pos, lag(value) OVER ({_SERIES}) AS before FROM vf),
su AS (
 SELECT run_id, idx, node_id, channel, value, pos, FALSE AS stuck, 0.0::DOUBLE AS start, 0 AS calm, FALSE AS said FROM p WHERE pos = 1 AND kind IN ('gpu_power', 'gpu_temp')
 UNION ALL
 SELECT p.run_id, p.idx, p.node_id, p.channel, p.value, p.pos,
  CASE WHEN p.frame < 10 THEN s.stuck WHEN s.stuck THEN NOT (abs(p.value - s.start) <= 10 OR (CASE WHEN abs(p.value - s.value) <= 40 THEN s.calm + 1 ELSE 0 END) >= 5) ELSE abs(p.value - s.value) > 40 END,
  CASE WHEN p.frame >= 10 AND NOT s.stuck AND abs(p.value - s.value) > 40 THEN s.value ELSE s.start END,
  CASE WHEN p.frame >= 10 AND s.stuck AND abs(p.value - s.value) <= 40 THEN s.calm + 1 ELSE 0 END,
  p.frame >= 10 AND (s.stuck OR abs(p.value - s.value) > 40)
 FROM su s JOIN p ON p.run_id = s.run_id AND p.node_id = s.node_id AND p.channel = s.channel AND p.pos = s.pos + 1),
o AS (SELECT *, CASE WHEN value BETWEEN 10 AND 90 THEN 0 ELSE 1 END AS out FROM p WHERE kind = 'gpu_power'),
isl AS (SELECT *, sum(out) OVER ({_SERIES}) AS island FROM o),
lng AS (SELECT *, CASE WHEN sum(1 - out) OVER (PARTITION BY run_id, node_id, channel, island ORDER BY idx) >= 6 THEN 1 ELSE 0 END AS long FROM isl),
ramp AS (SELECT *, max(long) OVER ({_SERIES}) AS steady FROM lng),
k AS (SELECT run_id, idx, node_id, channel, round(value, 4) AS value FROM p WHERE abs(value) >= 5),
g AS (SELECT *, row_number() OVER ({_SERIES}) AS pos, [lag(value, 3) OVER ({_SERIES}), lag(value, 2) OVER ({_SERIES}), lag(value, 1) OVER ({_SERIES}), value] AS gram FROM k),
n AS (SELECT *, count(*) OVER (PARTITION BY run_id, node_id, channel, gram ORDER BY pos RANGE BETWEEN 96 PRECEDING AND 4 PRECEDING) AS seen FROM g),
m AS (SELECT *, max(CASE WHEN pos >= 4 AND len(list_distinct(gram)) >= 2 AND seen > 0 THEN pos END) OVER ({_SERIES}) AS hit FROM n),
bad AS (
 SELECT run_id, idx, node_id, channel, 0 AS ord, 'OUT OF RANGE' AS code FROM p WHERE kind <> 'gpu_temp' AND (value < 0 OR value > 150)
 UNION ALL SELECT run_id, idx, node_id, channel, 1, 'DISCONTINUITY' FROM p WHERE kind <> 'gpu_temp' AND abs(value - before) > 40
 UNION ALL SELECT a.run_id, a.idx, a.node_id, a.channel, 3, 'SIBLING MISMATCH' FROM p a JOIN p b ON a.run_id = b.run_id AND a.idx = b.idx AND a.node_id = b.node_id AND a.channel <> b.channel AND b.kind = 'gpu_power' WHERE a.kind = 'gpu_power' AND b.value > 1 AND (a.value / b.value < 0.5 OR a.value / b.value > 2)
 UNION ALL SELECT run_id, idx, node_id, channel, 4, 'SUSTAINED DEVIATION' FROM su WHERE said AND stuck
 UNION ALL SELECT run_id, idx, node_id, channel, 5, 'STARTUP RAMP' FROM ramp WHERE frame >= 5 AND steady = 0
 UNION ALL SELECT run_id, idx, node_id, channel, 6, 'REPLAY' FROM m WHERE pos - hit < 5
 UNION ALL SELECT run_id, idx, node_id, channel, 7, 'OUT OF RANGE' FROM p WHERE kind = 'gpu_temp' AND (value <= 0 OR value > 95)
 UNION ALL SELECT run_id, idx, node_id, channel, 8, 'DISCONTINUITY' FROM p WHERE kind = 'gpu_temp' AND abs(value - before) > 40),
joined AS (SELECT run_id, idx, node_id, channel, string_agg(code, ' | ' ORDER BY ord) AS reason, bool_or(code = 'DISCONTINUITY') AS jump, bool_or(code = 'OUT OF RANGE') AS firm FROM bad GROUP BY ALL),
whole AS (SELECT p.run_id, p.idx, p.node_id, p.channel, coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL THEN 0 ELSE 2 END AS rank, coalesce(jump AND NOT firm AND round(abs(value - before), 2) <= 80, FALSE) AS pure FROM p LEFT JOIN joined j USING (run_id, idx, node_id, channel)),
same AS (SELECT *, sum(pure::INT) OVER f AS same, count(*) OVER f AS nodes FROM whole WINDOW f AS (PARTITION BY run_id, idx, channel)),
soft AS (SELECT *, pure AND same >= greatest(2, least(4, nodes)) AND same >= 0.5 * nodes AS soft FROM same)"""

_SQL_GRID = """e AS (SELECT idx // 400 AS run_id, idx % 400 AS idx, 60 + (round(avg(value), 4) - 50) / 1000 AS frq FROM frames GROUP BY ALL),
t AS (SELECT *, frq + ((idx * 7919) % 101 - 50) / 1e4 AS alt, 2.0 * idx - CASE WHEN idx % 53 = 7 THEN 4 WHEN idx % 59 = 9 THEN 25 ELSE 0 END AS ts FROM e),
q0 AS (SELECT *, max(ts) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM t),
q1 AS (SELECT *, coalesce(ts > most, TRUE) AS record FROM q0),
q AS (SELECT *, CASE WHEN record THEN 'ok' WHEN max(record::INT) OVER (PARTITION BY run_id, ts ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'REPLAY' ELSE 'OUT OF ORDER' END AS seq FROM q1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM t),
pad AS (SELECT run_id, idx, frq, pos, TRUE AS is_real FROM r
 UNION ALL SELECT run_id, idx, frq, u.k AS pos, FALSE FROM r, (SELECT unnest(range(-9, 1)) AS k) u WHERE pos = 1
 UNION ALL SELECT run_id, idx, frq, pos + u.k, FALSE FROM r, (SELECT unnest(range(1, 11)) AS k) u WHERE pos = n),
lagged AS (SELECT *, frq - 60 AS x, lag(frq - 60) OVER (PARTITION BY run_id ORDER BY pos) AS y FROM pad),
cf AS (SELECT *, var_pop(x) OVER w AS vx, var_pop(y) OVER w AS vy, covar_pop(x, y) OVER w AS c FROM lagged WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)),
conf AS (SELECT run_id, idx, pos, CASE WHEN pos = 1 THEN 1.0 WHEN vx * vy <= 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, c / sqrt(vx * vy))) END AS confidence FROM cf WHERE is_real),
dr AS (SELECT run_id, idx, count(*) OVER (w ROWS 29 PRECEDING) AS n, avg(frq) OVER (w ROWS 14 PRECEDING) - avg(frq) OVER (w ROWS BETWEEN 29 PRECEDING AND 15 PRECEDING) AS d FROM t WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
al AS (SELECT run_id, idx, count(*) OVER w AS n, var_samp(frq - 60) OVER w AS vx, var_samp(alt - 60) OVER w AS vy, covar_samp(frq - 60, alt - 60) OVER w AS c FROM t WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS 39 PRECEDING)),
lc AS (
 SELECT DISTINCT run_id, 0::BIGINT AS pos, 0.0::DOUBLE AS s, 0 AS streak FROM conf
 UNION ALL
 SELECT c.run_id, c.pos, CASE WHEN (CASE WHEN c.confidence >= -0.2 THEN l.streak + 1 ELSE 0 END) >= 20 THEN 0.0 ELSE greatest(0.0, l.s + (1 - c.confidence) - 0.03 - CASE WHEN c.pos >= 10 AND 1 - c.confidence < 0.03 THEN 0.03 ELSE 0.0 END) END,
  CASE WHEN c.confidence >= -0.2 THEN l.streak + 1 ELSE 0 END
 FROM lc l JOIN conf c ON c.run_id = l.run_id AND c.pos = l.pos + 1),
ba AS (SELECT run_id, avg(1 - confidence) AS base FROM conf WHERE pos <= 10 GROUP BY run_id),
dc AS (
 SELECT DISTINCT run_id, 0::BIGINT AS pos, 0.0::DOUBLE AS total, 0.0::DOUBLE AS s FROM conf
 UNION ALL
 SELECT run_id, pos, total, CASE WHEN total > 5 THEN 0.0 ELSE total END FROM (
  SELECT c.run_id, c.pos, CASE WHEN c.pos = 10 THEN 0.0 ELSE greatest(0.0, d.s + (1 - c.confidence) - CASE WHEN c.pos < 10 THEN 0.03 ELSE ba.base END) END AS total FROM dc d JOIN conf c ON c.run_id = d.run_id AND c.pos = d.pos + 1 JOIN ba ON ba.run_id = c.run_id)),
said AS (SELECT q.run_id, q.idx, conf.confidence, list_filter([
  CASE WHEN seq <> 'ok' THEN seq END, CASE WHEN abs(q.frq - 60) > 0.02 THEN 'OUT OF NOMINAL RANGE' END, CASE WHEN dr.n = 30 AND abs(dr.d) > 0.004 THEN 'RAW VALUE TREND' END,
  CASE WHEN al.n = 40 AND al.vx >= 5e-6 AND al.vy >= 5e-6 AND al.c / sqrt(al.vx * al.vy) < 0.965 THEN 'CORRELATION MISMATCH' END,
  CASE WHEN conf.confidence < -0.2 THEN 'DISCONTINUITY' END, CASE WHEN dc.total > 5 THEN 'DRIFT DETECTED' END, CASE WHEN lc.s > 2 THEN 'LOCAL ANOMALY' END], lambda x: x IS NOT NULL) AS codes
 FROM q JOIN conf USING (run_id, idx) JOIN dr USING (run_id, idx) JOIN al USING (run_id, idx) JOIN lc ON lc.run_id = conf.run_id AND lc.pos = conf.pos JOIN dc ON dc.run_id = conf.run_id AND dc.pos = conf.pos)"""

SQL = f"""WITH RECURSIVE {_SQL_NODES}, {_SQL_GRID}
SELECT run_id, idx, 'ENF' AS component_id, CASE WHEN len(codes) > 0 THEN 'failed' WHEN confidence < 0.1 THEN 'suspect' ELSE 'trusted' END AS status,
 round(CASE WHEN len(codes) > 0 THEN 0.05 WHEN confidence < 0.1 THEN confidence ELSE 0.95 END, 4) AS score, CASE WHEN len(codes) > 0 THEN array_to_string(codes, ' | ') ELSE 'ok' END AS reason FROM said
UNION ALL
SELECT run_id, idx, node_id || '/' || channel, CASE WHEN soft THEN 'suspect' WHEN rank = 2 THEN 'failed' ELSE 'trusted' END, CASE WHEN soft THEN 0.5 WHEN rank = 2 THEN 0.05 ELSE 0.95 END, CASE WHEN soft THEN reason || ' | corroborated across nodes' ELSE reason END FROM soft"""


def recorded(spark, sf_dir):
    """(frequency, readings) of all runs, the frequency with another stream and arrival times, some repeated or late.

    The frames of both are computed once. Means are taken to PLACES first: a sum's last bits depend on the order of its
    rows, and where the 5th place is a tie, or a mean a multiple of 25, they would decide what it is rounded to.
    """
    c, v, i = F.col("channel"), F.round("value", PLACES), F.col("idx")
    rows = kept(frames(spark, sf_dir), "recorded")
    names = {"click": "gpu-0[W]", "view": "gpu-1[W]", "error": "gpu-0[C]", "signup": "cpu-0-core[W]", "purchase": "cpu-0[W]"}
    kind = F.when(c.isin("click", "view"), "gpu_power").when(c == "error", "gpu_temp").otherwise("cpu_power")
    run, at = F.floor(i / 400).cast("long"), i % 400
    value = F.when(c == "error", F.floor(v / 25) * 25 + 10.0).otherwise(F.round(v, 4))
    long = rows.select(run.alias("run_id"), at.alias("idx"), "node_id", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c].alias("channel"), kind.alias("kind"), (c == "signup").alias("is_core"), value.alias("value"))
    frq = rows.groupBy(run.alias("run_id"), at.alias("idx")).agg((60 + (F.round(F.round(F.avg("value"), PLACES), 4) - 50) / 1000).alias("frq"))
    late = F.when(i % 53 == 7, 4).when(i % 59 == 9, 25).otherwise(0)
    series = frq.select("run_id", "idx", "frq", (F.col("frq") + (i * 7919 % 101 - 50) / 1e4).alias("alt"), (2.0 * i - late).alias("ts"))
    return series, long


@query(SQL)
def verify_runs(spark, sf_dir):
    """All checks of nodes and frequency."""
    return verify(*recorded(spark, sf_dir), GRID, NODES, alternative=True)
