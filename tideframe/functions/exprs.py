"""Column expressions on single records: envelopes, instants, sides, contract names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MAX_PRICE, MAX_QUANTITY, SIDES

WHITE = " \t\n\r\x0b\x0c"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NOT_FINITE = r"^[+-]?([nN][aA][nN]|[sS][nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
MONTH_CODES = "FGHJKMNQUVXZ"
CONTRACT = r"^(?=[A-Z0-9:]*$)(?=[0-9]*[A-Z])[A-Z0-9]{1,16}:(?=[0-9]*[A-Z])[A-Z0-9]{1,12}:[FGHJKMNQUVXZ][1-9][0-9]{3}$"
PRODUCT = r"^(?=[0-9]*[A-Z])[A-Z0-9]{1,16}:(?=[0-9]*[A-Z])[A-Z0-9]{1,12}$"
CONTINUOUS = r"^(?=[0-9]*[A-Z])[A-Z0-9]{1,16}:(?=[0-9]*[A-Z])[A-Z0-9]{1,12}:CONTINUOUS:[A-Z][A-Z0-9_]*$"
DIGEST = r"^[0-9a-f]{64}$"
CALENDAR_ID = r"^[A-Z][A-Z0-9_]*$"
TOKEN = r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_number(text: Column) -> Column:
    return F.coalesce(stripped(text).rlike(_NUMBER), F.lit(False))


def as_decimal(text: Column) -> Column:
    """The number as decimal(38,18); null if it isn't one or is too large for that."""
    return F.when(is_number(text), stripped(text).try_cast("decimal(38,18)"))


def violation(text: Column, t: Column, number: Column, value: Column, whole: bool) -> Column:
    """Why a text isn't a price, or with `whole` a quantity (the first reason, most fundamental first), or null. t is the text without
    white space around it, number whether it is one, value what as_decimal() makes of it."""
    mantissa = F.regexp_replace(t, r"[eE].*$", "")
    positive = ~t.startswith("-") & mantissa.rlike("[1-9]")
    limit = F.lit(str(MAX_QUANTITY) if whole else MAX_PRICE).cast("decimal(38,18)")
    # Digits behind the point that carry information; those of plain numbers are read off the text, as a cast would round them.
    digits = F.length(F.regexp_replace(F.regexp_extract(t, r"\.([0-9]*)", 1), "0+$", ""))
    most = 0 if whole else 6
    exact = F.when(t.rlike("[eE]"), value == F.round(value, most)).otherwise(digits <= most)
    out = F.when(text.isNull(), "not_a_number").when(~number, F.when(t.rlike(_NOT_FINITE), "non_finite").otherwise("not_a_number")).when(~positive, "not_positive")
    out = out.when(value.isNull() | (value > limit), "magnitude_too_large")
    return out.when(~exact, "not_whole" if whole else "too_many_fractional_digits")


def price_violation(text: Column) -> Column:
    """Why a text isn't a price (the first reason, most fundamental first), or null."""
    return violation(text, stripped(text), is_number(text), as_decimal(text), False)


def quantity_violation(text: Column) -> Column:
    """Why a text isn't a quantity, or null."""
    return violation(text, stripped(text), is_number(text), as_decimal(text), True)


def price(text: Column) -> Column:
    """A valid price as decimal(18,6); anything else fails, with the text and the reason."""
    return _or_fail(text, price_violation(text), "price").cast("decimal(18,6)")


def quantity(text: Column) -> Column:
    """A valid quantity as decimal(20,0); anything else fails, with the text and the reason."""
    return _or_fail(text, quantity_violation(text), "quantity").cast("decimal(20,0)")


def _or_fail(text: Column, why: Column, what: str) -> Column:
    said = F.concat(F.lit(f"not a {what}: "), F.coalesce(text, F.lit("null")), F.lit(" ("), why, F.lit(")"))
    return F.when(why.isNull(), as_decimal(text)).otherwise(F.raise_error(said).cast("decimal(38,18)"))


#: Issue code of a violation, for prices and for quantities.
PRICE_CODES = {"not_a_number": "non_decimal_price", "not_positive": "non_decimal_price", "non_finite": "non_finite_value", "magnitude_too_large": "magnitude_exceeded", "too_many_fractional_digits": "precision_exceeded", "not_whole": "non_integer_quantity"}
QUANTITY_CODES = PRICE_CODES | {"not_a_number": "negative_value", "not_positive": "negative_value"}


def coded(violation: Column, codes: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in codes.items():
        out = out.when(violation == k, v)
    return out


def fixed_point(price: Column) -> Column:
    """A price as a 64-bit integer of millionths, exactly."""
    return (price.cast("decimal(18,6)") * F.lit(1_000_000)).cast("bigint")


def from_fixed_point(value: Column) -> Column:
    return (value.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")


_OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)$"


def time_shape(t: Column) -> dict[str, Column]:
    """Of an ISO-8601 text without white space around it: at_shaped, at_offset (empty where there is none), at_local (its local time or null)."""
    bare = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    local = F.when(bare, t).otherwise(F.regexp_replace(F.regexp_replace(t, _OFFSET, ""), "[,]", "."))
    return {
        "at_shaped": t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)?)?$"),
        "at_offset": F.when(bare, "").otherwise(F.regexp_extract(t, _OFFSET, 1)),
        "at_local": local.try_cast("timestamp_ntz"),
    }


def time_status(t: Column, shaped: Column, offset: Column, local: Column) -> Column:
    """valid, not_datetime, naive or non_utc; the offset is read off the text."""
    zero = (offset == "Z") | offset.rlike(r"^[+-]00:?00(:00)?$")
    return F.when(t.isNull() | ~shaped | local.isNull(), "not_datetime").when(offset == "", "naive").when(~zero, "non_utc").otherwise("valid")


def timestamp_status(text: Column) -> Column:
    """valid, not_datetime, naive or non_utc, of an ISO-8601 text."""
    t = stripped(text)
    shape = time_shape(t)
    return time_status(t, shape["at_shaped"], shape["at_offset"], shape["at_local"])


def utc_micros(text: Column) -> Column:
    """Microseconds since the epoch of a valid text, else null."""
    return F.when(timestamp_status(text) == "valid", F.unix_micros(time_shape(stripped(text))["at_local"].cast("timestamp")))


def symbol_violation(symbol: Column) -> Column:
    return F.when(symbol.isNull(), "not_a_string").when(stripped(symbol) == "", "blank")


def side(text: Column) -> Column:
    """buy, sell or unknown; null for anything else."""
    s = F.lower(stripped(text))
    return F.when(s.isin(*SIDES), s)


def is_directional(s: Column) -> Column:
    return F.coalesce(s != "unknown", F.lit(False))


def ohlc_consistent(o: Column, h: Column, l: Column, c: Column) -> Column:
    return (l <= h) & o.between(l, h) & c.between(l, h)


def in_range(at: Column, start, end) -> Column:
    """Half-open membership; a bound of None is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (at >= start)
    if end is not None:
        out = out & (at < end)
    return out


def is_listed_contract(text: Column) -> Column:
    return F.coalesce(text.rlike(CONTRACT), F.lit(False))


def contract_parts(text: Column) -> dict[str, Column]:
    """venue, root, month_code, month, year of a listed contract; null for anything else."""
    ok = is_listed_contract(text)
    part = F.split(text, ":")
    code = F.substring(part.getItem(2), 1, 1)
    return {
        "venue": F.when(ok, part.getItem(0)),
        "root": F.when(ok, part.getItem(1)),
        "month_code": F.when(ok, code),
        "month": F.when(ok, month_number(code)),
        "year": F.when(ok, F.substring(part.getItem(2), 2, 4).cast("int")),
    }


def is_product(text: Column) -> Column:
    return F.coalesce(text.rlike(PRODUCT), F.lit(False))


def product_parts(text: Column) -> dict[str, Column]:
    """venue and root of a product; null for anything else, contracts and continuous ids included."""
    ok, part = is_product(text), F.split(text, ":")
    return {"venue": F.when(ok, part.getItem(0)), "root": F.when(ok, part.getItem(1))}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each worked out once for a row: the optimizer doesn't carry expressions through a generator, so neither
    filters nor later columns repeat them."""
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    own = df.select("*", F.explode_outer(F.array(row)).alias("__once"))
    return own.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[F.col(f"__once.{k}").alias(k) for k in columns])


def month_number(code: Column) -> Column:
    """1 to 12, or null for what isn't a month code."""
    at = F.instr(F.lit(MONTH_CODES), code)
    return F.when((F.length(code) == 1) & (at > 0), at)


def month_code(number: Column) -> Column:
    return F.when(number.between(1, 12), F.substring(F.lit(MONTH_CODES), number, F.lit(1)))


def full_year(code: Column, cycle_start: int) -> Column:
    """The year that one or two digits mean in the cycle that begins at cycle_start, a multiple of 10 or 100 for that many digits."""
    fits = ((F.length(code) == 1) & F.lit(cycle_start % 10 == 0)) | ((F.length(code) == 2) & F.lit(cycle_start % 100 == 0))
    return F.when(code.rlike("^[0-9]{1,2}$") & fits, F.lit(cycle_start) + code.try_cast("int"))


def is_continuous(text: Column) -> Column:
    return F.coalesce(text.rlike(CONTINUOUS), F.lit(False))


def local_to_utc(local: Column, zone: str) -> tuple[Column, Column]:
    """A local timestamp_ntz in a zone as (instant or null, null or why there is none: nonexistent or ambiguous).

    Spark resolves gaps and folds silently. A gap shows as the instant's local time being another one; a fold as an instant half an hour to
    two hours away with the same local time.
    """
    at = F.to_utc_timestamp(local.cast("timestamp"), zone)
    back = lambda t: F.from_utc_timestamp(t, zone)
    want = local.cast("timestamp")
    twice = F.lit(False)
    for minutes in (30, 60, 120):
        for sign in (1, -1):
            other = F.timestamp_micros(F.unix_micros(at) + F.lit(sign * minutes * 60_000_000))
            twice = twice | (back(other) == want)
    reason = F.when(back(at) != want, "nonexistent").when(twice, "ambiguous")
    return F.when(reason.isNull(), at), reason
