import re

import pytest

import brute
from brute import SF

import __spark_entry__
import corpus_pipeline
from opsdesk.llm import langid, linealign
from opsdesk.llm.common import table
from opsdesk.llm.oracles import SQL
from opsdesk.llm.queries import QUERIES


def test_all_queries_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) < set(names) and "pipeline" in names and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(map(tuple, want[columns].itertuples(index=False)))


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over sf0.001."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.shared_folder(spark, name)
        stage(spark, docs, SF).write.parquet(got)
        after = spark.read.parquet(got)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def test_stages_keep_the_columns_of_documents(spark, stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns


def test_language_stage_keeps_whole_rows(spark, stages):
    before, after = stages["language_id"]
    assert set(rows(after, "doc_id", "text")) <= set(rows(before, "doc_id", "text"))
    clean = {i for i, t in rows(before, "doc_id", "text") if t and any(c.isalpha() for c in t)}
    assert {i for i, in rows(after, "doc_id")} == clean


def test_line_stage_finds_what_brute_force_finds(spark, stages):
    """Against every text aligned with all earlier ones: nothing else goes, and nearly all of it goes (a
    run may stand moved against its earliest holder)."""
    from test_lines import brute as lines_brute
    before, after = stages["line_dedup"]
    want = {i: (gone, h) for i, n, gone, h in lines_brute(rows(before, "doc_id", "text"))}
    made = {r.doc_id: r for r in linealign.remove_repeated_lines(before).collect()}
    assert all(made[i].n_removed <= gone for i, (gone, _) in want.items())
    assert all(made[i].kept_sha256 == h for i, (gone, h) in want.items() if made[i].n_removed == gone)
    assert sum(r.n_removed for r in made.values()) >= 0.98 * sum(gone for gone, _ in want.values())
    got = {i: brute.sha(t.encode()) for i, t in rows(after, "doc_id", "text")}
    assert got == {i: made[i].kept_sha256 for i in got}
    assert all(n == len(t) for t, n in rows(after, "text", "n_chars"))
    assert all(made[i].n_removed and not made[i].text.strip() for i in set(made) - set(got))


def test_jaccard_stage_equals_brute_force(spark, stages):
    before, after = stages["jaccard_join"]
    pairs = rows(before, "doc_id", "text")
    assert sorted(i for i, in rows(after, "doc_id")) == sorted({c for _, c, _ in brute.jaccard_classes(pairs)})
    assert set(rows(after, "doc_id", "text")) <= set(pairs)


def test_decontamination_stage_equals_brute_force(spark, stages):
    before, after = stages["decontamination"]
    items = rows(table(spark, SF, "benchmark"), "item_id", "text")
    report = {r[0]: r for r in brute.item_hits(rows(before, "doc_id", "text"), items)}
    old, new = dict(rows(before, "doc_id", "text")), dict(rows(after, "doc_id", "text"))
    assert set(new) == {i for i, r in report.items() if 2 * r[2] <= r[1]}
    for i, t in new.items():
        assert (t == old[i]) == (report[i][2] == 0)
        assert len(brute.ITEM.findall(t.lower().encode())) == report[i][1] - report[i][2]


def test_packing_stage_covers_every_document(spark, stages):
    before, after = stages["packing"]
    covered = {}
    for i, start, length, total in sorted(rows(after, "doc_id", "start", "length", "doc_tokens")):
        assert covered.get(i, 0) == start
        covered[i] = start + length
        assert covered[i] <= total
    assert covered == {i: n for i, n in rows(after, "doc_id", "doc_tokens")}
    assert set(covered) == {i for i, in rows(before, "doc_id")}


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["packing"][1].collect()))


def test_empty_documents_pass_all_stages(spark):
    docs = table(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert langid.train(table(spark, SF, "documents").where("doc_id < 0")).langs == []


def test_clashing_columns_pass_all_stages(spark, make_docs, words):
    docs = make_docs([(i, "\n".join(" ".join(words(12, 10 * i + j)) for j in range(3))) for i in range(1, 8)] + [(8, None), (9, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert sorted(r.doc_id for r in after.collect()) == list(range(1, 8))
        assert {r.rank for r in after.collect()} == {"x"}
        docs = after
