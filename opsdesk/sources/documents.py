"""IO4: document sources — raw files (``binaryFile``) and HTML pages to plain text.

Files over 10 MB and texts over 2,000,000 characters are flagged with a ``warning`` and keep
their whole text; txt / md / csv are decoded as UTF-8 (invalid bytes replaced), html / htm are
stripped to text.  Inputs of other types have no text and an ``error``, never silently dropped.
PDF / DOCX decoding is not built (no decoder library available).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdesk.functions.text import normalize_ws

MAX_BYTES = 10 * 1024 * 1024
MAX_CHARS = 2_000_000
ERR_SIZE = "Knowledge files must be 10 MB or smaller."
ERR_CHARS = "Extracted knowledge text exceeds the 2 MB character limit."
ERR_TYPE = "Supported formats: PDF, DOCX, TXT, Markdown, and CSV."
ERR_DECODER = "PDF and DOCX decoding is not available in this build."

_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """Drop script/style blocks, comments and tags; decode the common entities; collapse spaces."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for ent, ch in _ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return normalize_ws(t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) → whole text; long ones are flagged."""
    t = pages.select("page_id", "url", html_to_text(F.col("html")).alias("text"))
    n = F.length("text")
    return t.select("page_id", "url", "text", n.alias("n_chars"),
                    F.when(n > MAX_CHARS, F.lit(ERR_CHARS)).alias("warning"))


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True) \
        .load(path)


def extract_documents(binary: DataFrame) -> DataFrame:
    """``binaryFile`` rows (path, length, content) → (path, filename, text, error, warning)."""
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    decoded = F.decode(F.col("content"), "UTF-8")
    text = F.when(suffix.isin(".txt", ".md", ".csv"), decoded) \
        .when(suffix.isin(".html", ".htm"), html_to_text(decoded))
    err = F.when(suffix.isin(".pdf", ".docx"), F.lit(ERR_DECODER)).when(text.isNull(), F.lit(ERR_TYPE))
    warning = F.when(F.col("length") > MAX_BYTES, F.lit(ERR_SIZE)).when(F.length(text) > MAX_CHARS, F.lit(ERR_CHARS))
    return binary.select("path", name.alias("filename"), F.when(err.isNull(), text).alias("text"),
                         err.alias("error"), warning.alias("warning"))
