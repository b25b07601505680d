"""Validation of raw records: rules give issues, issues decide which rows go.

A raw record is a row of texts (null: the field is absent) with source_index, plus `extra`, an array of the names of unknown
fields, where the source has any. Each rule gives rows of `validator`, row_index, severity, code, field_name. Rules don't stop one another,
but the value rule reports a record's first defect only and passes over records that lack fields.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..schemas import BAR_VALUES, EARLIEST, FIELDS, IDENTITY, PRICES, QUANTITIES, VERSION
from .cut import materialized
from .ordering import precedence, with_previous

ISSUE = ["validator", "row_index", "severity", "code", "field_name"]
SCHEMA, TIMESTAMP, SYMBOL, VALUE, DUPLICATE, ORDERING = range(6)


def parsed(raw: DataFrame, kind: str) -> DataFrame:
    """raw with every text read once: of each number n, d_n (decimal or null) and v_n (why it isn't valid, or null); at_us and
    at_status; blank (whether there is no usable symbol); trade_side; interval_us; start_ok."""
    numbers = [*PRICES[kind], *QUANTITIES[kind]]
    texts = [*numbers, *(["interval"] if kind == "bar" else [])]
    out = E.once(raw, at_text=E.stripped(F.col("timestamp")), blank=E.symbol_violation(F.col("instrument_symbol")).isNotNull(), **{f"t_{n}": E.stripped(F.col(n)) for n in texts})
    out = E.once(out, **E.time_shape(F.col("at_text")), **{f"n_{n}": E.is_number(F.col(f"t_{n}")) for n in texts})
    out = E.once(out, at_status=E.time_status(F.col("at_text"), F.col("at_shaped"), F.col("at_offset"), F.col("at_local")), **{f"d_{n}": F.when(F.col(f"n_{n}"), F.col(f"t_{n}").try_cast("decimal(38,18)")) for n in texts})
    more = {f"v_{n}": E.violation(F.col(n), F.col(f"t_{n}"), F.col(f"n_{n}"), F.col(f"d_{n}"), n in QUANTITIES[kind]) for n in numbers}
    more["at_us"] = F.when(F.col("at_status") == "valid", F.unix_micros(F.col("at_local").cast("timestamp")))
    if kind == "trade":
        more["trade_side"] = E.side(F.col("side"))
    if kind == "bar":
        us = F.col("d_interval") * F.lit(1_000_000)
        more["interval_us"] = F.when(us == F.floor(us), us.try_cast("bigint"))
    out = E.once(out, **more)
    return out.drop("at_text", "at_shaped", "at_offset", "at_local", *[f"{x}_{n}" for n in texts for x in "tn"])


def _issue(validator: int, severity: str, code: Column, field: Column) -> Column:
    """A struct where there is a code, else null."""
    return F.when(code.isNotNull(), F.struct(F.lit(validator).alias("validator"), F.lit(severity).alias("severity"), code.alias("code"), field.cast("string").alias("field_name")))


def _listed(df: DataFrame, *issues: Column) -> DataFrame:
    """A row for each issue; the rows are read once, whatever rules there are."""
    out = df.select(F.col("source_index").alias("row_index"), F.explode_outer(F.array(*issues)).alias("i")).where("i is not null")
    return out.select(F.col("i.validator").alias("validator"), "row_index", F.col("i.severity").alias("severity"), F.col("i.code").alias("code"), F.col("i.field_name").alias("field_name"))


def _schema(raw: DataFrame, kind: str, strict: bool) -> list[Column]:
    missing = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS[kind]])
    out = [_issue(SCHEMA, "ERROR", F.when(missing.isNotNull(), "missing_required_field"), missing)]
    if strict and "extra" in raw.columns:
        out.append(_issue(SCHEMA, "ERROR", F.when(F.size("extra") > 0, "unknown_field"), F.get(F.array_sort("extra"), F.lit(0))))
    return out


def schema_issues(raw: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """Missing fields, one issue for a record, that names the first; unknown ones likewise, sorted."""
    return _listed(raw, *_schema(raw, kind, strict))


def _timestamp() -> Column:
    status = F.col("at_status")
    code = F.when(F.col("timestamp").isNotNull(), F.when(status == "not_datetime", "non_datetime_timestamp").when(status == "naive", "naive_datetime").when(status == "non_utc", "non_utc_timestamp"))
    return _issue(TIMESTAMP, "ERROR", code, F.lit("timestamp"))


def timestamp_issues(raw: DataFrame) -> DataFrame:
    out = E.once(raw, at_text=E.stripped(F.col("timestamp")))
    out = E.once(out, **E.time_shape(F.col("at_text")))
    out = E.once(out, at_status=E.time_status(F.col("at_text"), F.col("at_shaped"), F.col("at_offset"), F.col("at_local")))
    return _listed(out, _timestamp())


def _symbol(blank: Column) -> Column:
    return _issue(SYMBOL, "ERROR", F.when(F.col("instrument_symbol").isNotNull() & blank, "invalid_instrument_symbol"), F.lit("instrument_symbol"))


def symbol_issues(raw: DataFrame) -> DataFrame:
    return _listed(raw, _symbol(E.symbol_violation(F.col("instrument_symbol")).isNotNull()))


def _value(kind: str) -> Column:
    found = [(F.col(f"v_{f}").isNotNull(), E.coded(F.col(f"v_{f}"), E.PRICE_CODES), f) for f in PRICES[kind]]
    found += [(F.col(f"v_{f}").isNotNull(), E.coded(F.col(f"v_{f}"), E.QUANTITY_CODES), f) for f in QUANTITIES[kind]]
    d = lambda f: F.col(f"d_{f}")
    if kind == "trade":
        found.append((F.col("trade_side").isNull(), F.lit("invalid_trade_side"), "side"))
    elif kind == "quote":
        found.append((d("bid") > d("ask"), F.lit("bid_ask_inversion"), "bid"))
    else:
        us = F.col("interval_us")
        found.append((us.isNull() | (us <= 0), F.lit("invalid_bar_interval"), "interval"))
        found.append((F.coalesce(F.col("at_us") - us < F.lit(EARLIEST), F.lit(False)), F.lit("interval_out_of_range"), "interval"))
        found.append((~E.ohlc_consistent(*[d(f) for f in ("open", "high", "low", "close")]), F.lit("invalid_ohlc"), "high"))
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in FIELDS[kind]])
    one = F.coalesce(*[F.when(when, F.struct(F.lit(VALUE).alias("validator"), F.lit("ERROR").alias("severity"), code.alias("code"), F.lit(f).alias("field_name"))) for when, code, f in found])
    return F.when(whole, one)


def value_issues(raw: DataFrame, kind: str) -> DataFrame:
    """A record's first defect: prices in order, quantities in order, then the record's own rule. Records that lack fields are passed over."""
    return _listed(parsed(raw, kind), _value(kind))


def interval_micros(text: Column) -> Column:
    """Decimal seconds as whole microseconds; null for what isn't a number of them."""
    us = E.as_decimal(text) * F.lit(1_000_000)
    return F.when(us == F.floor(us), us.try_cast("bigint"))


def _identity(kind: str) -> Column:
    """Of parsed records: a value that equal ones share, or null where a record has no identity. Numbers compare as numbers."""
    names = IDENTITY[kind]
    if names is None:
        return F.lit(None).cast("string")
    parts = []
    for f in names:
        typed = F.col("at_us") if f == "timestamp" else F.col(f"d_{f}") if f != "instrument_symbol" else F.lit(None)
        own = F.coalesce(typed.cast("string"), F.col(f))
        parts += [F.length(own).cast("string"), F.lit(":"), own]
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in names]) & ~F.col("blank")
    return F.when(whole, F.concat(*parts))


def identified(read: DataFrame, kind: str) -> DataFrame:
    """Of parsed records with an identity: source_index, identity, and what bars may disagree in, as numbers or, for texts that aren't
    any, as hashes. One reading, kept, as groups and their members come from it."""
    own = E.once(read, identity=_identity(kind)).where("identity is not null")
    values = BAR_VALUES if kind == "bar" else ()
    more = [x for f in values for x in (F.col(f"d_{f}"), F.when(F.col(f"d_{f}").isNull(), F.coalesce(F.xxhash64(f), F.lit(0))).alias(f"x_{f}"))]
    return materialized(own.select("source_index", "identity", *more))


def identity_groups(own: DataFrame, kind: str) -> DataFrame:
    """identity, n, first_index, conflicting, differing (names in field order) of each identity that more than one record has.

    An aggregate of numbers, not a window: a group of copies is counted before it moves.
    """
    values = BAR_VALUES if kind == "bar" else ()
    span = [x for f in values for x in (F.min(f"d_{f}").alias(f"l_{f}"), F.max(f"d_{f}").alias(f"h_{f}"), F.min(f"x_{f}").alias(f"lx_{f}"), F.max(f"x_{f}").alias(f"hx_{f}"))]
    out = own.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("source_index").alias("first_index"), *span).where("n > 1")
    # Values agree where all are one number, or all one text.
    alike = lambda f: F.col(f"l_{f}").eqNullSafe(F.col(f"h_{f}")) & F.col(f"lx_{f}").eqNullSafe(F.col(f"hx_{f}")) & (F.col(f"l_{f}").isNull() | F.col(f"lx_{f}").isNull())
    differing = F.array_compact(F.array(*[F.when(~alike(f), F.lit(f)) for f in values])) if values else F.array().cast("array<string>")
    return out.select("identity", "n", "first_index", differing.alias("differing")).withColumn("conflicting", F.size("differing") > 0)


def _group_issues(own: DataFrame, kind: str) -> DataFrame:
    met = own.select("source_index", "identity").join(identity_groups(own, kind), "identity")
    conflict = _issue(DUPLICATE, "ERROR", F.when(F.col("conflicting"), "conflicting_bar"), F.get("differing", F.lit(0)))
    later = ~F.col("conflicting") & (F.col("source_index") > F.col("first_index"))
    return _listed(met, conflict, _issue(DUPLICATE, "WARNING", F.when(later, "duplicate_row"), F.lit(None)))


def duplicate_issues(raw: DataFrame, kind: str) -> DataFrame:
    """Later copies of a record are warnings; members of a bar group that disagree are errors, the first included, and no warnings then."""
    return _group_issues(identified(parsed(raw, kind), kind), kind)


def conflict_details(raw: DataFrame, kind: str = "bar") -> DataFrame:
    """row_index, first_index, n, differing of each member of a group that disagrees: all names, comma-joined in field order. Rows that share
    first_index are one another's others; they aren't listed on each row, as a group may be any size."""
    own = identified(parsed(raw, kind), kind)
    met = own.select("source_index", "identity").join(identity_groups(own, kind).where("conflicting"), "identity")
    return met.select(F.col("source_index").alias("row_index"), "first_index", "n", F.concat_ws(",", "differing").alias("differing"))


def ordering_issues(raw: DataFrame) -> DataFrame:
    """Against the record before among those with a valid timestamp: earlier is an error, equal an observation.

    Records that share a source_index come earliest first."""
    read = E.once(raw.select("source_index", "timestamp"), at_text=E.stripped(F.col("timestamp")))
    read = E.once(read, **E.time_shape(F.col("at_text")))
    status = E.time_status(F.col("at_text"), F.col("at_shaped"), F.col("at_offset"), F.col("at_local"))
    valid = E.once(read, at=F.when(status == "valid", F.unix_micros(F.col("at_local").cast("timestamp")))).select("source_index", "at").where("at is not null")
    met = with_previous(valid, "at", "source_index")
    back = _issue(ORDERING, "ERROR", F.when(F.col("at") < F.col("previous"), "descending_timestamp"), F.lit("timestamp"))
    return _listed(met, back, _issue(ORDERING, "INFO", F.when(F.col("at") == F.col("previous"), "ambiguous_timestamp_order"), F.lit("timestamp")))


def _row_issues(read: DataFrame, kind: str, strict: bool) -> DataFrame:
    return _listed(read, *_schema(read, kind, strict), _timestamp(), _symbol(F.col("blank")), _value(kind))


def all_issues(raw: DataFrame, kind: str, strict: bool = True, ordered: bool = False, more: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """The rules of a batch, or with `ordered` those of a stream; `more` are the caller's own rules. Rows: by validator, then row_index."""
    read = parsed(raw, kind)
    parts = [_row_issues(read, kind, strict)]
    parts += [_group_issues(identified(read, kind), kind)] if IDENTITY[kind] else []
    parts += [ordering_issues(raw)] if ordered else []
    return reduce(DataFrame.unionByName, [*parts, *(f(raw) for f in more)])


def report(issues: DataFrame, total: int | Column, accepted: int | Column) -> DataFrame:
    """One row: totals, a count for each severity, and success, which errors and worse deny."""
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("bigint")), F.lit(0)).alias(s.lower())
    out = issues.agg(n("INFO"), n("WARNING"), n("ERROR"), n("FATAL"))
    return out.select(F.lit(total).cast("bigint").alias("total_rows"), F.lit(accepted).cast("bigint").alias("accepted_rows"), "info", "warning", "error", "fatal", ((F.col("error") == 0) & (F.col("fatal") == 0)).alias("success"))


def _survivors(read: DataFrame, issues: DataFrame, kind: str, policy: str) -> DataFrame:
    bad = issues.where("severity in ('ERROR', 'FATAL')").select(F.col("row_index").alias("source_index")).distinct()
    left = read.join(bad, "source_index", "left_anti")
    if IDENTITY[kind] is None:
        return left
    left = E.once(left, identity=_identity(kind))
    pick = F.max("source_index") if policy == "keep_last" else F.min("source_index")
    stays = left.where("identity is not null").groupBy("identity").agg(pick.alias("source_index")).select("source_index")
    return left.where("identity is null").drop("identity").unionByName(left.where("identity is not null").drop("identity").join(stays, "source_index", "left_semi"))


def survivors(raw: DataFrame, issues: DataFrame, kind: str, policy: str = "reject") -> DataFrame:
    """Rows without errors, one of each identity: the earliest, or with policy keep_last the latest."""
    return _survivors(parsed(raw, kind), issues, kind, policy).select(*[F.col(f"`{c}`") for c in raw.columns])


def _normalized(read: DataFrame, kind: str) -> DataFrame:
    out = [F.col("source_index"), F.col("at_us"), F.col("instrument_symbol")]
    out += [F.col(f"d_{f}").cast("decimal(18,6)").alias(f) for f in PRICES[kind]] + [F.col(f"d_{f}").cast("decimal(20,0)").alias(f) for f in QUANTITIES[kind]]
    if kind == "trade":
        out.append(F.col("trade_side").alias("side"))
    if kind == "bar":
        out += [F.col("interval_us"), (F.col("at_us") - F.col("interval_us")).alias("start_us")]
    return read.select(*out)


def normalized(rows: DataFrame, kind: str) -> DataFrame:
    """Typed records of rows that passed: at_us, instrument_symbol, decimal prices and quantities, side, interval in microseconds."""
    return _normalized(parsed(rows, kind), kind)


def import_batch(raw: DataFrame, kind: str, schema_version: int = VERSION, strict: bool = True, policy: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(records in event order, issues). An unsupported version rejects all with one fatal issue; an empty batch is one error.

    The texts are read once, into a checkpoint that issues, groups and records come from.
    """
    spark = raw.sparkSession
    fields = "validator int, row_index bigint, severity string, code string, field_name string"
    if schema_version not in (2, 3):
        return normalized(raw.where("false"), kind), spark.createDataFrame([(-1, None, "FATAL", "unsupported_schema_version", None)], fields)
    if raw.isEmpty():
        return normalized(raw, kind), spark.createDataFrame([(-1, None, "ERROR", "empty_batch", None)], fields)
    read = materialized(parsed(raw, kind))
    issues = _row_issues(read, kind, strict)
    if IDENTITY[kind]:
        issues = issues.unionByName(_group_issues(identified(read, kind), kind))
    rows = _normalized(_survivors(read, issues, kind, policy), kind)
    return rows.orderBy("at_us", precedence(F.lit(kind)), "source_index"), issues


def by_row(issues: DataFrame) -> DataFrame:
    """row_index, codes (in rule order, comma-joined), n. A row has few issues."""
    own = issues.where("row_index is not null").groupBy("row_index").agg(F.array_sort(F.collect_list(F.struct("validator", "code"))).alias("all"))
    return own.select("row_index", F.concat_ws(",", F.transform("all", lambda x: x["code"])).alias("codes"), F.size("all").cast("bigint").alias("n"))


def one_type(types: list[str]) -> str:
    """The single record type of a batch's records."""
    found = set(types)
    if len(found) != 1:
        raise ValueError(f"a batch holds one record type; found {sorted(found) or 'none'}")
    return found.pop()
