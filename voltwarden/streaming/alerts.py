"""Alert episodes and incidents as they happen.

An episode is a node's run of one severity; an incident is what episodes of alike keys that follow each other closely make
up. Both are told of whenever they change, with a version that grows: latest() keeps the newest of each, and once a stream
has ended that is what operators/views.py gives of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import _Keyed, put

EPISODE = "node_id string, severity int, start_ts double, end_ts double, samples long, vector string, peak double, last_value double, ongoing boolean, version long"
NONE = "Unclassified"


class Episodes(_Keyed):
    """Of one node. State: the open episode. A key without polls for `idle_s` has its episode closed by a timer."""

    COLUMNS = ["severity", "start_ts", "end_ts", "samples", "vector", "peak", "last_value", "ongoing", "version"]

    def __init__(self, idle_s: float):
        self.keys, self.idle_s = ["node_id"], idle_s

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "severity int, start_ts double, end_ts double, samples long, vector string, peak double, last_value double, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, out = list(self.open.get()) if self.open.exists() else None, []
        polls = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for ts, severity, vector, value in zip(polls["ts"].tolist(), polls["severity"].tolist(), polls["vector"].tolist(), polls["value"].tolist()):
            if own and own[0] != severity:
                own[7] += 1
                out.append((*own[:7], False, own[7]))
                own = None
            if severity > 0 and own:
                own[2:7] = [ts, own[3] + 1, vector if own[4] == NONE else own[4], max(own[5], value), value]
            elif severity > 0:
                own = [int(severity), ts, ts, 1, vector, value, value, 0]
        if own:
            own[7] += 1
            out.append((*own[:7], True, own[7]))
            self.open.update(tuple(own))
            self.wake(timerValues)
        else:
            self.open.clear()
        yield self.rows(key, out, self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self.open.get() if self.open.exists() else None
        self.open.clear()
        yield self.rows(key, [(*own[:7], False, own[7] + 1)] if own else [], self.COLUMNS)


class Incidents(_Keyed):
    """Of alike keys. State: the episodes that may still change or be joined, each in its newest version."""

    def __init__(self, gap: float, late: float, keys: list[str], idle_s: float):
        self.gap, self.late, self.keys, self.idle_s = gap, late, keys, idle_s

    def init(self, handle) -> None:
        self.handle = handle
        self.episodes = handle.getListState("episodes", "start_ts double, end_ts double, node_id string, severity int, samples long, peak double, ongoing boolean, version long")
        self.said = handle.getListState("said", "start_ts double, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {(r[2], r[0], r[3]): tuple(r) for r in (self.episodes.get() if self.episodes.exists() else [])}
        said = dict(self.said.get()) if self.said.exists() else {}
        for r in pd.concat(list(rows)).itertuples():
            place = (r.node_id, r.start_ts, int(r.severity))
            if place not in known or known[place][7] < r.version:
                known[place] = (r.start_ts, r.end_ts, r.node_id, int(r.severity), int(r.samples), r.peak, bool(r.ongoing), int(r.version))
        groups: list[list[tuple]] = []
        for e in sorted(known.values(), key=lambda e: (e[0], e[1], e[2])):
            if groups and e[0] - max(x[1] for x in groups[-1]) <= self.gap:
                groups[-1].append(e)
            else:
                groups.append([e])
        out, left, now = [], [], max(e[1] for e in known.values())
        starts = {g[0][0] for g in groups}
        for start in [s for s in said if s not in starts]:  # joined to an earlier one
            out.append((start, start, 0, 0, 0, 0.0, False, 0, said.pop(start) + 1))
        for g in groups:
            start, end, ongoing = g[0][0], max(e[1] for e in g), any(e[6] for e in g)
            said[start] = said.get(start, 0) + 1
            out.append((start, end, len({e[2] for e in g}), max(e[3] for e in g), sum(e[4] for e in g), max(e[5] for e in g), ongoing, len(g), said[start]))
            if ongoing or end + self.gap + self.late >= now:
                left += g
            else:  # nothing can join it any more
                said.pop(start)
        put(self.episodes, left)
        put(self.said, list(said.items()))
        self.wake(timerValues)
        yield self.rows(key, out, ["start_ts", "end_ts", "nodes", "worst", "samples", "peak", "ongoing", "children", "version"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.episodes.clear()
        self.said.clear()
        return iter(())


def episodes(polls: DataFrame, idle_s: float = 3600) -> DataFrame:
    """node_id, severity, start_ts, end_ts, samples, vector, peak, last_value, ongoing, version from a stream of polls (node_id, ts, severity, vector, value; severity 0 is good)."""
    given = polls.select("node_id", F.col("ts").cast("double").alias("ts"), F.col("severity").cast("int").alias("severity"), F.coalesce("vector", F.lit(NONE)).alias("vector"), F.col("value").cast("double").alias("value"))
    return given.groupBy("node_id").transformWithStateInPandas(Episodes(idle_s), EPISODE, "append", "ProcessingTime")


def incidents(episode: DataFrame, gap: float, keys: list[str], late: float = 60.0, idle_s: float = 3600) -> DataFrame:
    """keys, start_ts, end_ts, nodes, worst (severity), samples, peak, ongoing, children, version from a stream of episodes.

    An incident without children is one that was joined to an earlier one. `late` is how far behind the latest an
    episode may begin and still be seen.
    """
    own = ", ".join(f"`{k}` {episode.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{own}, start_ts double, end_ts double, nodes long, worst int, samples long, peak double, ongoing boolean, children long, version long"
    return episode.groupBy(*keys).transformWithStateInPandas(Incidents(gap, late, keys, idle_s), out, "append", "ProcessingTime")


def latest(told: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each episode or incident, by keys and start_ts; those joined to others are left out."""
    w = Window.partitionBy(*keys, "start_ts").orderBy(F.col("version").desc())
    out = told.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "version")
    return out.where("children > 0") if "children" in told.columns else out
