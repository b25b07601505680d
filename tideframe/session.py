"""The session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: All instants are UTC; sums and casts that overflow fail; joins and partitions adapt at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS; only the time zone changes results of operators that are given timestamps."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
