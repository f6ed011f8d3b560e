"""Document (binaryFile), CSV and HTML sources."""

import os
import tempfile

import pytest

from opsdesk.sources import csv_intake, documents


def test_extract_documents_limits_and_types(spark):
    d = tempfile.mkdtemp(prefix="opsdesk-docs-", dir=os.environ.get("OPSDESK_SCRATCH", "/tmp"))
    with open(os.path.join(d, "guide.txt"), "w", encoding="utf-8") as f:
        f.write("Hold the round button for ten seconds, then pair the device again.")
    with open(os.path.join(d, "page.html"), "w", encoding="utf-8") as f:
        f.write("<html><script>x()</script><p>Hello &amp; welcome</p></html>")
    with open(os.path.join(d, "large.txt"), "wb") as f:
        f.write(b"x" * (10 * 1024 * 1024 + 1))
    with open(os.path.join(d, "scan.pdf"), "wb") as f:
        f.write(b"%PDF-1.4")
    with open(os.path.join(d, "image.png"), "wb") as f:
        f.write(b"\x89PNG")
    out = {r.filename: r for r in documents.extract_documents(documents.read_binary(spark, d)).collect()}
    assert out["guide.txt"].text.startswith("Hold the round button") and out["guide.txt"].error is None
    assert out["page.html"].text == "Hello & welcome"
    assert out["large.txt"].warning == documents.ERR_SIZE and out["large.txt"].error is None
    assert len(out["large.txt"].text) == 10 * 1024 * 1024 + 1
    assert out["scan.pdf"].error == documents.ERR_DECODER
    assert out["image.png"].error == documents.ERR_TYPE


def test_csv_header_normalisation_and_required_columns(spark):
    d = tempfile.mkdtemp(prefix="opsdesk-csv-", dir=os.environ.get("OPSDESK_SCRATCH", "/tmp"))
    good = os.path.join(d, "good.csv")
    with open(good, "w", encoding="utf-8") as f:
        f.write(' Subject ,DESCRIPTION,Customer\n"Charge, twice","line one\nline two",Ann\n')
    rows = csv_intake.read_ticket_csv(spark, good).collect()
    assert rows[0].subject == "Charge, twice" and rows[0].description == "line one\nline two"
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w", encoding="utf-8") as f:
        f.write("title,body\nx,y\n")
    with pytest.raises(ValueError, match="subject and description"):
        csv_intake.read_ticket_csv(spark, bad)


def test_register_all_supports_spark_sql(spark):
    from opsdesk.sources.tables import register_all
    register_all(spark, "/root/testdata/sf0.001")
    n = spark.sql("SELECT count(*) AS n FROM events WHERE event_type = :t", args={"t": "click"}).first().n
    assert n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type = 'click'").count()


def test_registered_views_answer_parameterised_sql(spark, views):
    from pyspark.sql import functions as F
    views.register(prefix="od_")
    got = spark.sql("SELECT count(*) AS n FROM od_tickets WHERE status = :s AND priority = :p",
                    args={"s": "Open", "p": "Urgent"}).first().n
    exp = views.tickets.where((F.col("status") == "Open") & (F.col("priority") == "Urgent")).count()
    assert got == exp
