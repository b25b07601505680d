"""Exchange calendars: authored rules become UTC windows, and instants are looked up in these.

A definition is TOML of a few hundred lines, read and checked on the driver. Windows are made by Spark: trading dates are exploded,
take their weekday's rules or their exception's windows, and local times become instants, which gaps and folds refuse.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from datetime import date, datetime
from importlib import resources
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import exprs as E
from ..functions.encoding import content_hash
from .cut import materialized

CALENDAR_FORMAT = "qrt-materialized-calendar/1"  # fixed
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
STATES = ("trading", "halt", "maintenance")
STATUSES = ("verified-primary", "corroborated", "unverified")
#: Days that a replaced date's windows may begin before it.
LOOKBACK = 3


class CalendarError(ValueError):
    """Something wrong with a calendar."""


class BadDefinition(CalendarError):
    """A definition that breaks its own rules."""


class NonexistentLocalTime(CalendarError):
    """A boundary in the gap of a clock change."""


class AmbiguousLocalTime(CalendarError):
    """A boundary that a clock change makes occur twice."""


class UnsupportedInstant(CalendarError):
    """An instant outside the coverage."""


class DateOutOfRange(CalendarError):
    """A trading date outside the definition's range."""


@dataclass(frozen=True)
class Definition:
    id: str
    version: int
    timezone: str
    first: date
    last: date
    probes: list[tuple[str, int]]
    weekly: list[dict[str, Any]]  # weekday (0 to 6), rule_key, state, start_day, start_time, end_day, end_time
    exceptions: list[dict[str, Any]]  # trading_date, rule_key, kind
    windows: list[dict[str, Any]]  # trading_date, rule_key, state, start, end (local, ISO)
    provenance: dict[str, tuple[str, list[str]]] = field(default_factory=dict)


def _take(table: dict[str, Any], keys: set[str], what: str, optional: set[str] = frozenset()) -> None:
    if missing := keys - set(table):
        raise BadDefinition(f"{what} lacks {sorted(missing)}")
    if more := set(table) - keys - optional:
        raise BadDefinition(f"{what} has unknown keys {sorted(more)}")


def parse(text: str) -> Definition:
    """The definition that a TOML text holds; unknown and missing keys are refused."""
    doc = tomllib.loads(text)
    _take(doc, {"calendar", "weekly"}, "the document", {"exception"})
    head = doc["calendar"]
    _take(head, {"id", "version", "timezone", "first_trading_date", "last_trading_date", "probes"}, "[calendar]")
    if not re.fullmatch(E.CALENDAR_ID, head["id"]) or head["version"] < 1:
        raise BadDefinition("id or version")
    first, last = head["first_trading_date"], head["last_trading_date"]
    if type(first) is not date or type(last) is not date or last < first:
        raise BadDefinition("the range of trading dates")
    weekly, exceptions, windows, provenance = [], [], [], {}
    for day, rules in doc["weekly"].items():
        if day not in DAYS:
            raise BadDefinition(f"no weekday: {day}")
        before = None
        for i, rule in enumerate(rules):
            _take(rule, {"window", "verification", "evidence"}, f"{day} {i}")
            state, d0, t0, d1, t1 = rule["window"]
            if state not in STATES or not (d0, t0) < (d1, t1) or before is not None and (d0, t0) < before or not -LOOKBACK <= d0 <= 0 or not -LOOKBACK <= d1 <= 0:
                raise BadDefinition(f"{day} {i}: {rule['window']}")
            before, key = (d1, t1), f"weekly.{day}.{i}"
            weekly.append({"weekday": DAYS.index(day), "rule_key": key, "state": state, "start_day": d0, "start_time": t0, "end_day": d1, "end_time": t1})
            provenance[key] = (_status(rule), list(rule["evidence"]))
    for x in doc.get("exception", []):
        _take(x, {"trading_date", "kind", "verification", "evidence"}, "an exception", {"windows"})
        day, key = x["trading_date"], f"exception.{x['trading_date']}"
        if key in provenance or not first <= day <= last or x["kind"] not in ("removed", "replaced") or (x["kind"] == "removed") == bool(x.get("windows")):
            raise BadDefinition(f"exception {day}")
        exceptions.append({"trading_date": day, "rule_key": key, "kind": x["kind"]})
        provenance[key] = (_status(x), list(x["evidence"]))
        before = None
        for state, start, end in x.get("windows", []):
            a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
            if state not in STATES or not a < b or before is not None and a < before or (day - a.date()).days > LOOKBACK or b.date() > day:
                raise BadDefinition(f"exception {day}: {start}")
            before = b
            windows.append({"trading_date": day, "rule_key": key, "state": state, "start": start, "end": end})
    return Definition(head["id"], head["version"], head["timezone"], first, last, [tuple(p) for p in head["probes"]], weekly, exceptions, windows, provenance)


def _status(entry: dict[str, Any]) -> str:
    if entry["verification"] not in STATUSES or not entry["evidence"] or len(set(entry["evidence"])) < len(entry["evidence"]):
        raise BadDefinition("verification or evidence")
    return entry["verification"]


def packaged(name: str = "index_futures_2023") -> Definition:
    return parse(resources.files("tideframe.sources.calendars").joinpath(f"{name}.toml").read_text())


def check_probes(spark: SparkSession, definition: Definition) -> None:
    """The JVM's time zone data must give the offsets that the definition was authored against."""
    probes = spark.createDataFrame([(t, m) for t, m in definition.probes], "at string, minutes int")
    at = F.col("at").cast("timestamp")
    offset = (F.unix_seconds(F.from_utc_timestamp(at, definition.timezone)) - F.unix_seconds(at)) / 60
    wrong = probes.withColumn("found", offset.cast("int")).where("found <> minutes").collect()
    if wrong:
        raise CalendarError(f"{definition.timezone} is {wrong[0].found} minutes from UTC at {wrong[0].at}, not {wrong[0].minutes}")


def _local_windows(spark: SparkSession, d: Definition) -> DataFrame:
    """trading_date, rule_key, state, start, end as local timestamps: an exception's windows, where a date has one, else the week's."""
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(d.first), F.lit(d.last))).alias("trading_date")).withColumn("weekday", F.weekday("trading_date"))
    rules = spark.createDataFrame([tuple(r.values()) for r in d.weekly], "weekday int, rule_key string, state string, start_day int, start_time string, end_day int, end_time string")
    except_ = spark.createDataFrame([(x["trading_date"],) for x in d.exceptions], "trading_date date")
    local = lambda day, time: F.concat(F.date_add("trading_date", F.col(day)).cast("string"), F.lit("T"), F.col(time)).cast("timestamp_ntz")
    week = dates.join(F.broadcast(except_), "trading_date", "left_anti").join(F.broadcast(rules), "weekday")
    week = week.select("trading_date", "rule_key", "state", local("start_day", "start_time").alias("start"), local("end_day", "end_time").alias("end"))
    own = spark.createDataFrame([tuple(w.values()) for w in d.windows], "trading_date date, rule_key string, state string, start string, end string")
    return week.unionByName(own.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))


def materialize(spark: SparkSession, definition: Definition) -> DataFrame:
    """start_us, end_us, state, trading_date, rule_key of all windows in order. Checks come first: probes, gaps, folds, overlaps."""
    check_probes(spark, definition)
    local = _local_windows(spark, definition)
    (s, why_s), (e, why_e) = E.local_to_utc(F.col("start"), definition.timezone), E.local_to_utc(F.col("end"), definition.timezone)
    out = local.select(F.unix_micros(s).alias("start_us"), F.unix_micros(e).alias("end_us"), "state", "trading_date", "rule_key", F.coalesce(why_s, why_e).alias("why"), "start")
    out = materialized(out)  # a few windows for each date, read by the checks and then by whoever asks
    for why, error in (("nonexistent", NonexistentLocalTime), ("ambiguous", AmbiguousLocalTime)):
        if bad := out.where(F.col("why") == why).take(1):
            raise error(f"{bad[0].rule_key} on {bad[0].trading_date}")
    out = out.select("start_us", "end_us", "state", "trading_date", "rule_key")
    met = out.withColumn("before", F.lag("end_us").over(Window.orderBy("start_us"))).where("before > start_us").take(1)
    if met:
        raise CalendarError(f"windows overlap on {met[0].trading_date}")
    if out.isEmpty():
        raise CalendarError("no windows in the definition's range")
    return out.orderBy("start_us")


def calendar_hash(definition: Definition, windows: DataFrame) -> str:
    """SHA-256 of the materialized calendar's canonical JSON; the provenance of rules that give no window on any date isn't part of it."""
    rows = windows.orderBy("start_us").collect()
    used = {r.rule_key for r in rows} | {x["rule_key"] for x in definition.exceptions}
    payload = {
        "format": CALENDAR_FORMAT,
        "calendar_id": definition.id,
        "version": f"v{definition.version}",
        "timezone": definition.timezone,
        "trading_date_range": [definition.first.isoformat(), definition.last.isoformat()],
        "coverage": [rows[0].start_us, rows[-1].end_us],
        "windows": [[r.start_us, r.end_us, r.state, r.trading_date.isoformat(), r.rule_key] for r in rows],
        "provenance": {k: [s, e] for k, (s, e) in definition.provenance.items() if k in used},
    }
    return content_hash(payload)


def intervals(windows: DataFrame) -> DataFrame:
    """The windows and, as state closed without a trading date, the gaps between them; next_us is where the next one begins, null for the last."""
    w = Window.orderBy("start_us")
    ahead = windows.withColumn("next_start", F.lead("start_us").over(w))
    none = lambda kind: F.lit(None).cast(kind)
    gaps = ahead.where("next_start > end_us").select(F.col("end_us").alias("start_us"), F.col("next_start").alias("end_us"), F.lit("closed").alias("state"), none("date").alias("trading_date"), none("string").alias("rule_key"))
    every = windows.select("start_us", "end_us", "state", "trading_date", "rule_key").unionByName(gaps)
    last = F.max("end_us").over(Window.partitionBy(F.lit(1)))
    return every.withColumn("next_us", F.when(F.col("end_us") < last, F.col("end_us")))


DAY_US = 86_400_000_000


def by_day(spans: DataFrame, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """spans with `day`, once for each UTC day that they touch, for an equi-join on it."""
    return spans.withColumn("day", F.explode(F.sequence(F.floor(F.col(start) / DAY_US), F.floor((F.col(end) - 1) / DAY_US))))


def resolve(events: DataFrame, windows: DataFrame, at: str = "at_us") -> DataFrame:
    """events with state, trading_date, rule_key, window_start, window_end, next_us; instants outside the coverage have state null.

    A hash join on the day, of which each has a few intervals, and then the bounds: events aren't held against all windows.
    """
    spans = by_day(intervals(windows)).select("day", F.col("start_us").alias("window_start"), F.col("end_us").alias("window_end"), "state", "trading_date", "rule_key", "next_us")
    own = events.withColumn("__day", F.floor(F.col(at) / DAY_US))
    inside = (F.col("__day") == F.col("day")) & (F.col(at) >= F.col("window_start")) & (F.col(at) < F.col("window_end"))
    return own.join(spans, inside, "left").drop("__day", "day")


def require_covered(resolved: DataFrame, at: str = "at_us") -> DataFrame:
    """The same, failing on the first instant outside the coverage."""
    return resolved.withColumn("state", F.coalesce("state", F.raise_error(F.concat(F.lit("outside the calendar's coverage: "), F.col(at).cast("string"))).cast("string")))


def supports(windows: DataFrame) -> DataFrame:
    """One row: the coverage's start and end."""
    return windows.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def windows_for(windows: DataFrame, dates: DataFrame, definition: Definition | None = None) -> DataFrame:
    """trading_date and its windows, in order; dates without trading give none, dates out of range are refused."""
    if definition is not None and (bad := dates.where(~F.col("trading_date").between(F.lit(definition.first), F.lit(definition.last))).take(1)):
        raise DateOutOfRange(str(bad[0].trading_date))
    return dates.join(windows, "trading_date").orderBy("trading_date", "start_us")


def provenance(spark: SparkSession, definition: Definition) -> DataFrame:
    return spark.createDataFrame([(k, s, e) for k, (s, e) in definition.provenance.items()], "rule_key string, status string, evidence array<string>")
