"""IO2/IO3: CSV ticket batches in, CSV results out.

Header names are normalised (strip + lower-case); ``subject`` and ``description`` are
required, ``customer``, ``email`` and ``channel`` optional.  Quoted multi-line fields are
supported.  Every column is read as a string (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["subject", "description"]
OPTIONAL = ["customer", "email", "channel"]
HEADER_ERROR = "CSV needs subject and description columns; optional columns are customer, email, channel."


def read_ticket_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .option("inferSchema", False).csv(path))
    names = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(HEADER_ERROR)
    cols = [F.col(f"`{names[c]}`").alias(c) for c in REQUIRED + OPTIONAL if c in names]
    extra = [F.col(f"`{orig}`") for low, orig in names.items() if low not in REQUIRED + OPTIONAL]
    return raw.select(*cols, *extra)


def write_csv(df: DataFrame, path: str) -> None:
    """IO3: header CSV directory (one file per partition), overwrite."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
