"""The verifier's keyed checks over unbounded streams, with typed state: a series of a node, or the frequency of a run.

State is a row of numbers, short lists of the last values, and the times accepted as bits by block. A block expires after
`keep_s`, and all of a key's state when nothing came for `idle_s`, so state is bounded by what is live. Both need the RocksDB
state store: `spark.sql.streaming.stateStore.providerClass`, which session() sets in a session of its own.

Readings of a key are taken in the order of idx within a micro-batch, and micro-batches in their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Enf, Nlr

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times a block of bits.
BLOCK = 1024


def session(spark: SparkSession, timers: bool = True) -> SparkSession:
    """A session on the same cluster whose streams keep their state in RocksDB; the given one stays as it is.

    With timers, triggers without input let timers fire, as a live stream needs; without, a stream that reads what is
    there ends when it has read it.
    """
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(timers).lower())
    return own


def put(state, rows: list[tuple]) -> None:
    """A list state can't hold an empty list."""
    state.put(rows) if rows else state.clear()


class Accepted:
    """Whether a time is later than all accepted (it is accepted then), was accepted before, or neither."""

    def __init__(self, state, last: int | None):
        self.state, self.last, self.blocks = state, last, {}

    def block(self, k: int) -> bytearray:
        if k not in self.blocks:
            known = self.state.getValue((k,))
            self.blocks[k] = bytearray(known[0]) if known else bytearray(BLOCK // 8)
        return self.blocks[k]

    def check(self, at: int) -> str:
        k, bit = divmod(at, BLOCK)
        if self.last is None or at > self.last:
            self.block(k)[bit // 8] |= 1 << bit % 8
            self.last = at
            return "ok"
        return "REPLAY" if self.block(k)[bit // 8] >> bit % 8 & 1 else "OUT OF ORDER"

    def store(self) -> None:
        for k, bits in self.blocks.items():
            self.state.updateValue((k,), (bytes(bits),))


class _Keyed(StatefulProcessor):
    """Timers of idle keys, and rows told of a key."""

    idle_s: float
    keys: list[str]

    def rows(self, key: tuple, found: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in found], columns=[*self.keys, *columns], dtype=object)

    def wake(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(1000 * self.idle_s))

    def close(self) -> None:
        pass


class NodeChecks(_Keyed):
    """Range, step, counter, sustained deviation, start-up ramp and replay of one series, as operators/nlr.py has them.

    A reading that was accepted before, or is not later than all accepted, is reported as such and changes nothing else.
    """

    COLUMNS = ["idx", "value", "check_ord", "status_rank", "code"]

    def __init__(self, cfg: Nlr, keys: list[str], idle_s: float, keep_s: float):
        self.cfg, self.keys, self.idle_s, self.keep_s = cfg, keys, idle_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "last long, before double, most double, stuck boolean, start double, calm int, inside int, steady boolean, since long, recent array<double>")
        self.blocks = handle.getMapState("accepted", "block long", "bits binary", int(1000 * self.keep_s))

    def clear(self) -> None:
        for state in (self.numbers, self.blocks):
            state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.numbers.get() or (None, None, None, False, 0.0, 0, 0, False, None, [])
        last, self.before, self.most, self.stuck, self.start, self.calm, self.inside, self.steady, self.since, seen = n
        self.seen = list(seen)
        accepted, out = Accepted(self.blocks, last), []
        rows = pd.concat(list(rows)).sort_values("idx", kind="stable")
        for i, v, frame, kind in zip(rows["idx"].tolist(), rows["value"].tolist(), rows["frame"].tolist(), rows["kind"].tolist()):
            order = accepted.check(i)
            found = [(-1, order)] if order != "ok" else list(self.reading(kind, v, frame))
            out += [(i, v, at, 0 if code == "ok" else 2, code) for at, code in found]
            if order == "ok":
                self.before = v
        accepted.store()
        self.numbers.update((accepted.last, self.before, self.most, self.stuck, self.start, self.calm, self.inside, self.steady, self.since, self.seen))
        self.wake(timerValues)
        yield self.rows(key, out, self.COLUMNS)

    def reading(self, kind: str, v: float, frame: int) -> Iterator[tuple[int, str]]:
        """(place of the check, code) of each check that says something about a reading."""
        c = self.cfg
        moved = abs(v - self.before) if self.before is not None else None
        if kind in ("gpu_power", "cpu_power"):
            step = c.gpu_step_w if kind == "gpu_power" else c.cpu_step_w
            yield 0, "OUT OF RANGE" if v < c.floor_w or v > c.ceiling_w else "ok"
            yield 1, "DISCONTINUITY" if moved is not None and moved > step else "ok"
        if kind == "cpu_uj":
            yield 2, self.counter(v)
        if kind in ("gpu_power", "gpu_temp"):
            limits = (c.gpu_step_w, c.recovery_w) if kind == "gpu_power" else (c.temp_step_c, c.recovery_c)
            if code := self.sustained(v, moved, frame, *limits):
                yield 4, code
        if kind == "gpu_power":
            self.inside = self.inside + 1 if c.ramp_low_w <= v <= c.ramp_high_w else 0
            self.steady = self.steady or self.inside >= c.ramp_run
            yield 5, "STARTUP RAMP" if frame >= c.ramp_deadline and not self.steady else "ok"
        if kind != "cpu_uj" and abs(v) >= c.replay_floor_w and (code := self.replay(v)):
            yield 6, code
        if kind == "gpu_temp":
            yield 7, "OUT OF RANGE" if v <= c.temp_floor_c or v > c.temp_ceiling_c else "ok"
            yield 8, "DISCONTINUITY" if moved is not None and moved > c.temp_step_c else "ok"

    def counter(self, v: float) -> str:
        c = self.cfg
        wrap = self.before is not None and abs(self.before - v - c.wrap_ceiling_uj) <= c.wrap_tolerance_uj
        code = "ok"
        if not wrap and self.most is not None and v < self.most:
            code = "MONOTONICITY VIOLATION"
        elif not wrap and self.before is not None and v - self.before > c.energy_step_uj:
            code = "ENERGY SPIKE"
        self.most = v if wrap or self.most is None else max(self.most, v)
        return code

    def sustained(self, v: float, moved: float | None, frame: int, step: float, band: float) -> str | None:
        if frame < self.cfg.quiet_frames or moved is None and not self.stuck:
            return None
        if self.stuck:
            self.calm = self.calm + 1 if (moved or 0.0) <= step else 0
            self.stuck = not (abs(v - self.start) <= band or self.calm >= self.cfg.recovery_run)
            return "SUSTAINED DEVIATION" if self.stuck else "ok"
        if moved > step:
            self.stuck, self.start, self.calm = True, self.before, 0
            return "SUSTAINED DEVIATION"
        return None

    def replay(self, v: float, run: int = 5) -> str | None:
        gram, lookback = self.cfg.replay_gram, self.cfg.replay_lookback
        self.seen = [*self.seen, float(Decimal(repr(v)).quantize(Decimal("1.0000"), ROUND_HALF_UP))][-lookback:]
        own = self.seen[-gram:]
        match = len(own) == gram and len(set(own)) >= 2 and any(self.seen[i : i + gram] == own for i in range(len(self.seen) - 2 * gram + 1))
        self.since = 0 if match else self.since + 1 if self.since is not None else None
        return None if self.since is None or self.since > run else "REPLAY" if self.since < run else "ok"


class GridChecks(_Keyed):
    """Every check of the frequency of a run, as plans.verify.enf_results has them: a row a frame.

    Confidence needs the frames around, so a frame is told of when `anchor_radius` more have come; a row without a
    frequency ends the run and tells of the rest, as does the timer of an idle run.
    """

    COLUMNS = ["idx", "status_rank", "codes", "confidence"]

    def __init__(self, cfg: Enf, keys: list[str], idle_s: float, keep_s: float, in_order: bool = False):
        self.cfg, self.keys, self.idle_s, self.keep_s, self.in_order = cfg, keys, idle_s, keep_s, in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "last long, n long, drift double, base double, local double, streak int, next long")
        self.values = handle.getListState("values", "frq double")
        self.waiting = handle.getListState("waiting", "idx long, frq double, codes array<string>")
        self.pairs = handle.getListState("pairs", "frq double, alt double")
        self.strayed = handle.getListState("strayed", "deviation double")
        self.held = handle.getListState("held", "idx long, ts long, frq double, alt double")
        self.blocks = handle.getMapState("accepted", "block long", "bits binary", int(1000 * self.keep_s))

    def load(self) -> None:
        n = self.numbers.get() if self.numbers.exists() else (None, 0, 0.0, self.cfg.cusum_baseline, 0.0, 0, None)
        last, self.n, self.drift, self.base, self.local, self.streak, self.next = n
        lists = {name: [tuple(r) for r in state.get()] if state.exists() else [] for name, state in (("values", self.values), ("waiting", self.waiting), ("pairs", self.pairs), ("strayed", self.strayed), ("held", self.held))}
        self.x, self.left, self.both = [v for (v,) in lists["values"]], [(i, v, list(c)) for i, v, c in lists["waiting"]], lists["pairs"]
        self.seen, self.ahead = [v for (v,) in lists["strayed"]], lists["held"]
        self.accepted, self.out = Accepted(self.blocks, last), []

    def save(self) -> None:
        self.accepted.store()
        self.numbers.update((self.accepted.last, self.n, self.drift, self.base, self.local, self.streak, self.next))
        for state, rows in ((self.values, [(v,) for v in self.x]), (self.waiting, self.left), (self.pairs, self.both), (self.strayed, [(v,) for v in self.seen]), (self.held, self.ahead)):
            put(state, rows)

    def clear(self) -> None:
        for state in (self.numbers, self.values, self.waiting, self.pairs, self.strayed, self.held, self.blocks):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        rows = pd.concat(list(rows)).sort_values("idx", kind="stable")
        number = lambda v: None if v is None or v != v else v
        given = [(int(i), number(t), number(f), number(a)) for i, t, f, a in zip(rows["idx"], rows["ts"], rows["frq"], rows["alt"])]
        ended = any(f is None for _, _, f, _ in given)
        given = [(i, i if t is None else round(1000 * t), f, a) for i, t, f, a in given if f is not None]
        if self.in_order:  # frames whose alternative came late are waited for
            self.ahead = sorted(self.ahead + given)
            self.next = self.ahead[0][0] if self.next is None and self.ahead and self.ahead[0][0] == 0 else self.next
            k = 0
            while k < len(self.ahead) and self.next is not None and self.ahead[k][0] <= self.next:
                self.next = max(self.next, self.ahead[k][0] + 1)
                k += 1
            given, self.ahead = self.ahead[:k], self.ahead[k:]
        for row in given:
            self.frame(*row)
        if ended:
            self.finish()
            self.clear()
        else:
            self.save()
            self.wake(timerValues)
        yield self.rows(key, self.out, self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.finish()
        self.clear()
        yield self.rows(key, self.out, self.COLUMNS)

    def finish(self) -> None:
        """What waits is told of; the last value stands for those after it."""
        for row in self.ahead:
            self.frame(*row)
        self.ahead = []
        self.x += self.x[-1:] * (self.cfg.anchor_radius - len(self.left))
        while self.left:
            self.x = [*self.x, self.x[-1]][-(2 * self.cfg.anchor_radius + 2) :]
            self.centre()

    def frame(self, idx: int, ts: int, frq: float, alt: float | None) -> None:
        c = self.cfg
        order = self.accepted.check(ts)
        codes = [] if order == "ok" else [order]
        if abs(frq - c.nominal_hz) > c.tolerance_hz:
            codes.append("OUT OF NOMINAL RANGE")
        if not self.x:
            self.x = [frq] * (c.anchor_radius + 1)
        self.x = [*self.x, frq][-max(2 * c.anchor_radius + 2, c.raw_drift_window) :]
        self.n += 1
        half = c.raw_drift_window // 2
        if self.n >= c.raw_drift_window and abs(math.fsum(self.x[-half:]) / half - math.fsum(self.x[-c.raw_drift_window : -half]) / (c.raw_drift_window - half)) > c.raw_drift_hz:
            codes.append("RAW VALUE TREND")
        if alt is not None:
            self.both = [*self.both, (frq, alt)][-c.alt_window :]
            if len(self.both) == c.alt_window:
                x, y = zip(*self.both)
                vx, vy, r = correlated(x, y, c.nominal_hz)
                if min(vx, vy) / (c.alt_window - 1) >= c.alt_min_variance and r < c.alt_threshold:
                    codes.append("CORRELATION MISMATCH")
        self.left.append((idx, frq, codes))
        if len(self.left) > c.anchor_radius:
            self.centre()

    def centre(self) -> None:
        """The first frame that waits stands in the middle of the last values."""
        c = self.cfg
        idx, _, codes = self.left.pop(0)
        wide = 2 * c.anchor_radius + 1
        x, y = self.x[-wide:], self.x[-wide - 1 : -1]
        place = self.n - len(self.left)
        confidence = 1.0 if place == 1 else max(-1.0, min(1.0, correlated(x, y, c.nominal_hz)[2]))
        deviation = 1 - confidence
        self.seen = [*self.seen, deviation][-c.cusum_history :]
        self.drift = max(0.0, self.drift + deviation - self.base)
        if place == c.warmup:
            self.base, self.drift = sum(self.seen) / len(self.seen), 0.0
        drifted = self.drift > c.cusum_threshold
        self.local = max(0.0, self.local + deviation - c.cusum_baseline - (c.cusum_baseline if place >= c.local_window and deviation < c.cusum_baseline else 0.0))
        self.streak = self.streak + 1 if confidence >= c.suspect else 0
        if self.streak >= c.local_recovery:
            self.local = 0.0
        more = [("FLAT SIGNATURE", min(x) == max(x)), ("DISCONTINUITY", confidence < c.suspect), ("DRIFT DETECTED", drifted), ("LOCAL ANOMALY", self.local > c.local_threshold)]
        if drifted:
            self.drift = 0.0
        codes = codes + [name for name, hit in more if hit]
        self.out.append((idx, 2 if codes else 1 if confidence < c.trusted else 0, codes, confidence))


def correlated(x: list[float], y: list[float], nominal: float) -> tuple[float, float, float]:
    """Sums of squares about the means, and the correlation, 0 where a side doesn't vary."""
    x, y = [v - nominal for v in x], [v - nominal for v in y]
    mx, my = math.fsum(x) / len(x), math.fsum(y) / len(y)
    vx, vy = math.fsum((v - mx) ** 2 for v in x), math.fsum((v - my) ** 2 for v in y)
    spread = vx * vy
    return vx, vy, math.fsum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(spread) if spread > 0 else 0.0


def _typed(stream: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([*[f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys], rest])


def node_checks(stream: DataFrame, cfg: Nlr | None = None, idle_s: float = 3600, keep_s: float = 86_400) -> DataFrame:
    """run_id, node_id, channel, idx, value, check_ord, status_rank, code: what each keyed check says of each reading.

    stream: run_id, node_id, channel, kind, idx, frame (how many frames of the run came before) and value. check_ord is
    the place of the check in plans.verify.node_results, -1 for the order of readings. Siblings and corroboration look
    at one frame alone and need no state: siblings().
    """
    keys = ["run_id", "node_id", "channel"]
    given = stream.select(*keys, "kind", F.col("idx").cast("long").alias("idx"), F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    out = _typed(stream, keys, "idx long, value double, check_ord int, status_rank int, code string")
    return given.groupBy(*keys).transformWithStateInPandas(NodeChecks(cfg or Nlr(), keys, idle_s, keep_s), out, "append", "ProcessingTime")


def grid_checks(stream: DataFrame, cfg: Enf | None = None, idle_s: float = 3600, keep_s: float = 86_400, in_order: bool = False) -> DataFrame:
    """run_id, idx, status_rank, codes, confidence: the verdict of each frame of the frequency.

    stream: run_id, idx, frq, and ts and alt where there are any; a row without frq ends its run. With in_order, frames
    are taken by idx from 0 without gaps, whatever order they come in, and what is behind a gap waits for it, until the
    run ends or is idle: so frames whose alternative reading is late are checked in their place.
    """
    have = lambda c: F.col(c) if c in stream.columns else F.lit(None)
    given = stream.select("run_id", F.col("idx").cast("long").alias("idx"), have("ts").cast("double").alias("ts"), F.col("frq").cast("double").alias("frq"), have("alt").cast("double").alias("alt"))
    out = _typed(stream, ["run_id"], "idx long, status_rank int, codes array<string>, confidence double")
    return given.groupBy("run_id").transformWithStateInPandas(GridChecks(cfg or Enf(), ["run_id"], idle_s, keep_s, in_order), out, "append", "ProcessingTime")


def with_alternative(observed: DataFrame, other: DataFrame, apart: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """observed (run_id, idx, at, frq) with alt, that of the other stream (run_id, idx, at, alt) for the same frame, measured at most `apart` from it.

    Both may be streams: a frame and a reading wait for each other until the watermark, `late` behind the latest, has
    passed all that could match; then a frame without a reading goes on with a null, and what was waiting is forgotten.
    """
    if observed.isStreaming:
        observed = observed.withWatermark("at", late)
        other = other.withWatermark("at", late)
    o, a = observed.alias("o"), other.select(F.col("run_id").alias("a_run"), F.col("idx").alias("a_idx"), F.col("at").alias("a_at"), "alt").alias("a")
    near = F.expr(f"a_at BETWEEN at - INTERVAL {apart} AND at + INTERVAL {apart}")
    return o.join(a, (F.col("run_id") == F.col("a_run")) & (F.col("idx") == F.col("a_idx")) & near, "left").drop("a_run", "a_idx", "a_at")


def siblings(frames: DataFrame, low: float, high: float, values: str = "values") -> DataFrame:
    """frames with `mismatched`: the channels out of proportion to the median of the others in the same row.

    frames: a row a node and frame (and kind), with a map of channel to value. No state and no shuffle, so it serves streams and tables.
    """
    some = F.map_filter(values, lambda _, v: v.isNotNull())

    def off(name: Column, v: Column) -> Column:
        rest = F.array_sort(F.map_values(F.map_filter(some, lambda k, _: k != name)))
        n = F.size(rest)
        middle = (F.get(rest, F.floor((n - 1) / 2).cast("int")) + F.get(rest, F.floor(n / 2).cast("int"))) / 2
        return F.coalesce((n > 0) & (middle > 1) & ((v / middle < low) | (v / middle > high)), F.lit(False))

    return frames.withColumn("mismatched", F.array_sort(F.map_keys(F.map_filter(some, off))))
