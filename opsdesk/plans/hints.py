"""Join-strategy helpers with *checked* size bounds.

Catalyst's static size estimate of a derived frame (after generators and aggregates) can
be far too small — it once chose to broadcast 2.7 M sparse-vector rows.  Operators that join
a small side against a large corpus therefore decide explicitly:

* ``bounded(df, max_rows)`` runs ``df.limit(max_rows + 1).count()`` — an exact check that
  reads at most ``max_rows + 1`` rows — and broadcasts only when the frame is within the bound;
* beyond the bound the caller uses a shuffle join (salted when the join key has few values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def salted(big: DataFrame, small: DataFrame, key: str, salts: int, salt_of: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Spread a low-cardinality join key: ``big`` rows get salt = hash(salt_of) mod salts,
    ``small`` rows are replicated once per salt.  Returns the frames and the join keys."""
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_of]), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b, s, [key, "_salt"]
