"""Properties from the test strategy: SLA monotone in as_of; inverted-index Jaccard = set form."""

import regex
from pyspark.sql import functions as F

from opsdesk.operators import retrieve as R
from opsdesk.operators import sla as SLA

ORDER = {"on_track": 0, "at_risk": 1, "breached": 2}


def test_sla_states_monotone_in_as_of(views):
    times = ["2024-01-05 00:00:00", "2024-01-12 00:00:00", "2024-01-20 00:00:00", "2024-02-15 00:00:00"]
    frames = [SLA.sla_state(views.tickets, views.ticket_sla, views.messages, t)
              .select("ticket_id", F.col("first_response_status").alias(f"f{i}"),
                      F.col("resolution_status").alias(f"r{i}"))
              for i, t in enumerate(times)]
    j = frames[0]
    for f in frames[1:]:
        j = j.join(f, "ticket_id")
    for row in j.collect():
        for clock in ("f", "r"):
            states = [row[f"{clock}{i}"] for i in range(len(times))]
            if states[0] in ORDER:  # met / not_configured do not depend on time
                ranks = [ORDER[s] for s in states]
                assert ranks == sorted(ranks), (row.ticket_id, clock, states)
            else:
                assert len(set(states)) == 1


def test_inverted_index_jaccard_equals_set_form(views):
    chunks = R.chunk_documents(views.knowledge.select("doc_id", "text"))
    q = views.queries
    fast = R.retrieve_jaccard(q, chunks, 3).collect()
    tok = regex.compile(r"[\p{L}\p{N}_₹]+")
    qsets = {r.qid: set(tok.findall(r.text.lower())) for r in q.collect()}
    csets = {(r.doc_id, r.chunk_index): set(tok.findall(r.content.lower())) for r in chunks.collect()}
    for qid, qs in qsets.items():
        scored = []
        for key, cs in csets.items():
            inter = len(qs & cs)
            if inter:
                scored.append((-inter / max(1, len(qs | cs)), key))
        scored.sort()
        exp = [(key, round(-s * 1000 + 1e-9) / 1000) for s, key in scored[:3]]
        got = sorted([(r.rank, (r.doc_id, r.chunk_index), r.score) for r in fast if r.qid == qid])
        assert [g[1] for g in got] == [e[0] for e in exp]
        for g, e in zip(got, exp):
            assert abs(g[2] - e[1]) < 1e-9
