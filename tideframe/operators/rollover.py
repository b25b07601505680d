"""Roll schedules: which listed contract is active when, and what a trading date's windows hold of each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import exprs as E
from ..functions.encoding import content_hash
from .calendar import by_day

# Fixed format names.
SCHEDULE_FORMAT = "qrt-roll-schedule/1"
SERIES_FORMAT = "qrt-continuous-series/1"
BOUNDARIES = ("first-window-start", "first-trading-window-start")


class RolloverError(ValueError):
    """Something wrong with a roll schedule."""


class CalendarMismatch(RolloverError):
    """A schedule that was made against another calendar."""


class LifecycleMismatch(RolloverError):
    """A last trade date that the calendar doesn't trade on."""


class InsufficientCoverage(RolloverError):
    """Too few trading dates before a last trade date."""


class NoTradingWindow(RolloverError):
    """A date without the window that a boundary asks for."""


class RollOutsideRange(RolloverError):
    """A roll at or beyond the supported range's bounds."""


class UnsupportedRollInstant(RolloverError):
    """An instant outside the schedule's range."""


@dataclass(frozen=True)
class Schedule:
    """An initial contract and the rolls out of it: (from, to, effective_us, rule_key, evidence)."""

    product: str
    calendar: tuple[str, str, str]  # id, version, content hash
    supported: tuple[int, int]
    dates: tuple[str, str]
    initial: str
    rolls: list[tuple[str, str, int, str, list[str]]] = field(default_factory=list)
    kind: str = "explicit"

    def __post_init__(self) -> None:
        start, end = self.supported
        if end <= start or self.dates[1] < self.dates[0]:
            raise RolloverError("the supported range")
        at, held, seen = start, self.initial, {self.initial}
        for c in (self.initial, *(r[1] for r in self.rolls)):
            if not _listed(c) or not c.startswith(f"{self.product}:"):
                raise RolloverError(f"not a listed contract of {self.product}: {c}")
        for old, new, effective, _, evidence in self.rolls:
            if not start < effective < end:
                raise RollOutsideRange(f"{old} to {new}")
            if old != held or new in seen or effective <= at or not evidence:
                raise RolloverError(f"the chain breaks at {old} to {new}")
            at, held = effective, new
            seen.add(new)

    def contracts(self) -> list[str]:
        return [self.initial, *(r[1] for r in self.rolls)]

    def hash(self) -> str:
        payload = {
            "format": SCHEDULE_FORMAT,
            "product": self.product,
            "calendar": list(self.calendar),
            "supported_range": list(self.supported),
            "trading_date_range": list(self.dates),
            "initial_contract": self.initial,
            "events": [[a, b, t, t, k] for a, b, t, k, _ in self.rolls],
            "provenance": {k: [self.kind, e] for _, _, _, k, e in self.rolls},
        }
        return content_hash(payload)

    def frame(self, spark: SparkSession) -> DataFrame:
        """valid_from, valid_to, contract, rule_key: half-open intervals over the supported range."""
        points = [(self.supported[0], self.initial, None), *((t, b, k) for _, b, t, k, _ in self.rolls)]
        df = spark.createDataFrame(points, "valid_from bigint, contract string, rule_key string")
        return df.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(Window.orderBy("valid_from")), F.lit(self.supported[1])))


def _listed(text: str) -> bool:
    return re.match(E.CONTRACT, text) is not None


def require_listed(text: str) -> str:
    """The text if it names a listed contract; products, series and vendors' aliases can't be traded."""
    if not _listed(text):
        raise ValueError(f"not a listed contract: {text!r}")
    return text


def trading_dates(windows: DataFrame) -> DataFrame:
    """trading_date, rank, and the starts of its first window and its first trading window."""
    own = windows.groupBy("trading_date").agg(F.min("start_us").alias("first_us"), F.min(F.when(F.col("state") == "trading", F.col("start_us"))).alias("trading_us"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy("trading_date")))


def roll_targets(windows: DataFrame, lifecycles: DataFrame, offset: int, boundary: str) -> DataFrame:
    """lifecycles (contract, last_trade_date) with target_date, `offset` trading dates earlier, and effective_us, its boundary's instant."""
    dates = trading_dates(windows)
    start = F.col("first_us") if boundary == BOUNDARIES[0] else F.col("trading_us")
    last = lifecycles.join(dates.select(F.col("trading_date").alias("last_trade_date"), "rank"), "last_trade_date", "left")
    goal = dates.select(F.col("trading_date").alias("target_date"), start.alias("effective_us"), (F.col("rank") + offset).alias("rank"))
    return last.join(goal, "rank", "left").select("contract", "last_trade_date", F.col("rank").isNotNull().alias("trades"), "target_date", "effective_us")


def fixed_calendar(spark: SparkSession, windows: DataFrame, product: str, calendar: tuple[str, str, str], supported: tuple[int, int], dates: tuple[str, str], lifecycles: list[tuple[str, str, list[str]]], offset: int, boundary: str) -> Schedule:
    """Each contract but the last rolls into the next at the boundary `offset` trading dates before its last trade date."""
    if boundary not in BOUNDARIES or offset < 0:
        raise RolloverError("offset or boundary")
    given = spark.createDataFrame([(c, d) for c, d, _ in lifecycles], "contract string, last_trade_date string").withColumn("last_trade_date", F.col("last_trade_date").cast("date"))
    found = {r.contract: r for r in roll_targets(windows, given, offset, boundary).collect()}
    rolls = []
    for (c, day, evidence), (nxt, _, _) in zip(lifecycles, lifecycles[1:]):
        r = found[c]
        if not r.trades:
            raise LifecycleMismatch(f"{day} of {c} is no trading date")
        if r.target_date is None:
            raise InsufficientCoverage(f"{c}: fewer than {offset} trading dates before {day}")
        if r.effective_us is None:
            raise NoTradingWindow(f"{r.target_date}")
        rolls.append((c, nxt, r.effective_us, f"fixed-calendar.offset-{offset}.{boundary}.{c}", evidence))
    return Schedule(product, calendar, supported, dates, lifecycles[0][0], rolls, "fixed-calendar")


def explicit(product: str, calendar: tuple[str, str, str], supported: tuple[int, int], dates: tuple[str, str], initial: str, events: list[tuple[str, str, int, list[str]]]) -> Schedule:
    return Schedule(product, calendar, supported, dates, initial, [(a, b, t, f"explicit.{i}", e) for i, (a, b, t, e) in enumerate(events)], "explicit")


def active_contract(events: DataFrame, schedule: DataFrame, at: str = "at_us") -> DataFrame:
    """events with contract; null outside the range. Schedules have a few rolls a year."""
    own = F.broadcast(schedule.select("valid_from", "valid_to", "contract"))
    return events.join(own, (F.col(at) >= F.col("valid_from")) & (F.col(at) < F.col("valid_to")), "left").drop("valid_from", "valid_to")


def require_active(mapped: DataFrame, at: str = "at_us") -> DataFrame:
    return mapped.withColumn("contract", F.coalesce("contract", F.raise_error(F.concat(F.lit("outside the roll schedule: "), F.col(at).cast("string"))).cast("string")))


def require_pin(schedule: Schedule, calendar: tuple[str, str, str]) -> None:
    if schedule.calendar != calendar:
        raise CalendarMismatch(f"{schedule.calendar} and {calendar}")


def segments(windows: DataFrame, schedule: DataFrame) -> DataFrame:
    """trading_date, state, start_us, end_us, contract: windows cut at the rolls; a roll between windows cuts none."""
    one = by_day(windows).select("day", "trading_date", "state", F.col("start_us").alias("ws"), F.col("end_us").alias("we"))
    both = F.broadcast(schedule.select("valid_from", "valid_to", "contract"))
    met = one.join(both, (F.greatest("ws", "valid_from") < F.least("we", "valid_to")))
    return met.select("trading_date", "state", F.greatest("ws", "valid_from").alias("start_us"), F.least("we", "valid_to").alias("end_us"), "contract").distinct()


@dataclass(frozen=True)
class Series:
    """A continuous series: a schedule under a name that can't be traded, over a range that may be narrower."""

    id: str
    schedule: Schedule
    supported: tuple[int, int]

    def __post_init__(self) -> None:
        if not re.match(E.CONTINUOUS, self.id) or not self.id.startswith(f"{self.schedule.product}:"):
            raise ValueError(f"not a series of {self.schedule.product}: {self.id!r}")
        if not self.schedule.supported[0] <= self.supported[0] < self.supported[1] <= self.schedule.supported[1]:
            raise RolloverError("a series' range lies within its schedule's")

    def hash(self) -> str:
        return content_hash({"format": SERIES_FORMAT, "series_id": self.id, "product": self.schedule.product, "roll_schedule": self.schedule.hash(), "supported_range": list(self.supported)})

    def active(self, events: DataFrame, at: str = "at_us") -> DataFrame:
        """events of the series' range with contract; others have none."""
        inside = E.in_range(F.col(at), *self.supported)
        return active_contract(events, self.schedule.frame(events.sparkSession), at).withColumn("contract", F.when(inside, F.col("contract")))


