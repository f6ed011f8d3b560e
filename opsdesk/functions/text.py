"""Column builders for text (TX1, TX3, hashing helpers, Python-like strip/preview).

All are JVM-side expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsdesk.functions.lexicon import TOKEN_PATTERN, WHITESPACE


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes all leading/trailing Unicode whitespace (Spark ``trim`` removes
    spaces only, ``\\s`` is ASCII)."""
    return F.regexp_replace(F.regexp_replace(col(c), f"^{WHITESPACE}+", ""), f"{WHITESPACE}+$", "")


def is_blank(c) -> Column:
    """Null or whitespace-only."""
    return col(c).isNull() | (F.length(py_strip(c)) == 0)


def normalize_ws(c) -> Column:
    """TX1: collapse whitespace runs to one space and strip.  One pass, which leaves single spaces
    alone; what is left at the ends is at most one space each."""
    other = f"[{WHITESPACE}&&[^ ]]"
    return F.trim(F.regexp_replace(col(c), f"{WHITESPACE}{{2,}}|{other}", " "))


def tokenize(c) -> Column:
    """TX3: lower-case Unicode word tokens (letters, digits, underscore, rupee sign)."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN_PATTERN), 0)


def token_bucket(token: Column, dims: int = 256) -> Column:
    """TX4 bucket: first 8 hex digits of md5(token) as an unsigned int, modulo ``dims``."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def token_sign(token: Column) -> Column:
    """TX4 sign: +1 when hex digits 9-10 of md5(token) form an odd number, else -1."""
    return F.when(F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("int") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))


def contains_any(text: Column, words) -> Column:
    """Substring test for any of ``words`` (``text`` already lower-cased)."""
    expr = F.lit(False)
    for w in words:
        expr = expr | text.contains(w)
    return expr


def preview(c, n: int, always_ellipsis: bool = False) -> Column:
    """First ``n`` characters plus an ellipsis (always, or only when the text is longer)."""
    head = F.substring(col(c), 1, n)
    if always_ellipsis:
        return F.concat(head, F.lit("…"))
    return F.when(F.length(col(c)) > n, F.concat(head, F.lit("…"))).otherwise(col(c))


def round_half_up(c, digits: int = 3) -> Column:
    """Engine-independent rounding: floor(x * 10^d + 0.5) / 10^d."""
    scale = 10 ** digits
    return F.floor(col(c) * scale + F.lit(0.5)) / F.lit(float(scale))
