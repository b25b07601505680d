"""Record schemas, and the values that stored artifacts must carry."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the storage contract.
PRICE_SCALE = 6
PRICE_PRECISION = 18
MAX_PRICE = "999999999999.999999"
MAX_QUANTITY = 2**64 - 1
SCHEMA_NAME = "tideframe.storage"
LEGACY_VERSION, VERSION = 2, 3
ROW_GROUP = 65_536
#: Microseconds of the first and the last instant that can be told, in the years 1 and 9999.
EARLIEST, LATEST = -62_135_596_800_000_000, 253_402_300_799_999_999

PRICE = T.DecimalType(PRICE_PRECISION, PRICE_SCALE)
QUANTITY = T.DecimalType(20, 0)

#: Required fields of raw records, in the order in which issues name them.
FIELDS = {
    "trade": ("timestamp", "instrument_symbol", "price", "size", "side"),
    "quote": ("timestamp", "instrument_symbol", "bid", "ask", "bid_size", "ask_size"),
    "bar": ("timestamp", "instrument_symbol", "interval", "open", "high", "low", "close", "volume"),
}
PRICES = {"trade": ("price",), "quote": ("bid", "ask"), "bar": ("open", "high", "low", "close")}
QUANTITIES = {"trade": ("size",), "quote": ("bid_size", "ask_size"), "bar": ("volume",)}
#: Fields whose values, together, say which record one is; trades have none, as two fills may agree in everything.
IDENTITY = {"trade": None, "quote": FIELDS["quote"], "bar": ("instrument_symbol", "timestamp", "interval")}
BAR_VALUES = ("open", "high", "low", "close", "volume")
SIDES = ("buy", "sell", "unknown")
#: Order of simultaneous records of one source.
PRECEDENCE = {"quote": 0, "trade": 1, "bar": 2}

TRADE = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("instrument_symbol", T.StringType()), T.StructField("price", PRICE), T.StructField("size", QUANTITY), T.StructField("side", T.StringType())])
QUOTE = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("instrument_symbol", T.StringType()), *[T.StructField(c, PRICE) for c in ("bid", "ask")], *[T.StructField(c, QUANTITY) for c in ("bid_size", "ask_size")]])
BAR = T.StructType([T.StructField("instrument_symbol", T.StringType()), T.StructField("interval_start", T.TimestampType()), T.StructField("interval_us", T.LongType()), *[T.StructField(c, PRICE) for c in ("open", "high", "low", "close")], T.StructField("volume", QUANTITY)])
RECORDS = {"trade": TRADE, "quote": QUOTE, "bar": BAR}

#: Columns of stored artifacts by record type: fixed-point prices as 64-bit integers, quantities as unsigned ones.
STORED = {
    "trade": (("price", "int64"), ("size", "uint64"), ("side", "string")),
    "quote": (("bid", "int64"), ("ask", "int64"), ("bid_size", "uint64"), ("ask_size", "uint64")),
    "bar": (("interval_microseconds", "uint64"), ("open", "int64"), ("high", "int64"), ("low", "int64"), ("close", "int64"), ("volume", "uint64")),
}
