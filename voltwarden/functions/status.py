"""Statuses, their ranks, scores and labels, and times as the views show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ["trusted", "suspect", "failed"]
#: Words of reasons and the vector that they speak for, in order of priority.
VECTORS = [
    ("REPLAY", "Replay"),
    ("OUT OF ORDER", "Replay"),
    ("MONOTONICITY VIOLATION", "Rollback"),
    ("DRIFT DETECTED", "Drift"),
    ("RAW VALUE TREND", "Drift"),
    ("FLAT SIGNATURE", "Fabrication"),
    ("EMPTY SIGNATURE", "Fabrication"),
    ("INVALID SIGNATURE", "Fabrication"),
    ("ENERGY SPIKE", "Injection"),
    ("OUT OF NOMINAL RANGE", "Injection"),
    ("OUT OF RANGE", "Injection"),
    ("DISCONTINUITY", "Injection"),
    ("LOCAL ANOMALY", "Localized anomaly"),
]


def name_of(rank: Column) -> Column:
    """0, 1, 2 as trusted, suspect, failed."""
    return F.element_at(F.array(*map(F.lit, STATUSES)), rank.cast("int") + 1)


def rank_of(status: Column) -> Column:
    return F.when(status == "failed", 2).when(status == "suspect", 1).when(status == "trusted", 0)


def layer_score(rank: Column) -> Column:
    """0.0, 0.5, 1.0, as scoreboards hold it."""
    return rank / 2.0


def label(score: Column) -> Column:
    return F.when(score == 0.0, "good").when(score == 0.5, "suspect").when(score == 1.0, "warning").otherwise("--")


def colour(score: Column) -> Column:
    return F.when(score == 0.0, "green").when(score == 0.5, "yellow").when(score == 1.0, "red").otherwise("grey")


#: What a node's tile shows for a label.
TILES = {"good": ("Normal", "NOM", "#16a34a"), "suspect": ("Warning", "WRN", "#ca8a04"), "warning": ("Alert", "ALR", "#dc2626")}


def tile(shown: Column) -> Column:
    """title, badge and border colour of a label; null for others."""
    out = None
    for name, (title, badge, border) in TILES.items():
        own = F.struct(F.lit(title).alias("title"), F.lit(badge).alias("badge"), F.lit(border).alias("border"))
        out = F.when(shown == name, own) if out is None else out.when(shown == name, own)
    return out


def seconds(number: Column, clock: Column, other: Column | None = None) -> Column:
    """Seconds from a number, else from HH:MM:SS, else from another column; null where nothing can be read."""
    parts = F.split(clock, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    by_clock = F.when(clock.rlike(r"^\d{1,2}:\d{2}:\d{2}(?:\.\d+)?$"), part(1) * 3600 + part(2) * 60 + part(3))
    return F.coalesce(number.try_cast("double"), by_clock, *([other.try_cast("double")] if other is not None else []))


def vector(reason: Column) -> Column:
    """The attack vector that a reason's words speak for; others: Unclassified."""
    out = None
    for word, name in VECTORS:
        hit = F.contains(reason, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out, F.lit("Unclassified"))


def first_vector(reasons: Column) -> Column:
    """The vector of the first of an array of reasons that has one."""
    known = F.filter(F.transform(reasons, vector), lambda v: v != "Unclassified")
    return F.coalesce(F.get(known, F.lit(0)), F.lit("Unclassified"))


def scenario_of(file_name: Column) -> Column:
    """The scenario's id from the name of an output file."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.jsonl?$", ""), "_check$", "")


def difficulty_of(scenario: Column) -> Column:
    return F.when(F.contains(F.lower(scenario), F.lit("easy")), "easy").otherwise("unknown")


def workload_of(dataset: Column) -> Column:
    return F.when(F.contains(F.lower(dataset), F.lit("training")), "training").otherwise("inference")


def folder_number(name: Column) -> Column:
    """The digits of a folder's name as a number, for sorting; 0 without any."""
    return F.coalesce(F.regexp_replace(name, r"\D", "").try_cast("int"), F.lit(0))
