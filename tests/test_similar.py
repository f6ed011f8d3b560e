"""SIM1 against a brute-force evaluation; SIM2 prefix filtering against brute force; SIM3."""

import datetime as dt
import hashlib
import math

import numpy as np
import regex
from pyspark.sql import functions as F

from opsdesk.operators import similar as SIM

TOK = regex.compile(r"[\p{L}\p{N}_₹]+")


def _vec(text):
    v = np.zeros(256, dtype=np.int64)
    for tok in TOK.findall(text.lower()):
        h = hashlib.md5(tok.encode()).hexdigest()
        v[int(h[:8], 16) % 256] += 1 if int(h[8:10], 16) % 2 else -1
    return v


def test_similar_tickets_equals_brute_force(views):
    t = views.tickets.select("id", "subject", "description", "status", "created_at").collect()
    rows = sorted(t, key=lambda r: (-r.created_at.timestamp(), r.id))
    vec = {r.id: _vec(f"{r.subject} {r.description}") for r in rows}
    expected = set()
    for r in rows:
        cands = [c for c in rows if c.id != r.id]
        hits = []
        for c in cands:
            a, b = vec[r.id], vec[c.id]
            n = math.sqrt(float(a @ a) * float(b @ b)) or 1.0
            cos = float(a @ b) / n
            if cos >= 0.22:
                score = math.floor(cos * 1000 + 0.5) / 1000
                kind = "probable_duplicate" if cos >= 0.72 else \
                    "resolved_case" if c.status in ("Resolved", "Closed") else "similar"
                hits.append((score, c.created_at, c.id, kind))
        hits.sort(key=lambda h: (-h[0], -h[1].timestamp(), h[2]))
        for rank, h in enumerate(hits[:8], start=1):
            expected.add((r.id, h[2], h[0], h[3], rank))
    got = {(x.ticket_id, x.matched_ticket_id, x.score, x.match_type, x.rank)
           for x in SIM.similar_tickets(views.tickets)["similar"].collect()}
    assert got == expected and len(got) > 0


def test_many_slabs_and_duplicate_rows_equal_brute_force(views, monkeypatch):
    """Many blocks and slabs give the same matches; the rows count every duplicate pair."""
    whole = {tuple(r) for r in SIM.similar_tickets(views.tickets)["similar"].collect()}
    monkeypatch.setattr(SIM, "TEXT_GROUP", 30)
    out = SIM.similar_tickets(views.tickets, slab_bytes=40 * 8 * 256)
    assert {tuple(r) for r in out["similar"].collect()} == whole
    t = views.tickets.select("id", "subject", "description", "created_at").collect()
    text = {r.id: f"{r.subject} {r.description}" for r in t}
    vec = {x: _vec(x) for x in set(text.values())}

    def cos(x, y):
        return float(vec[x] @ vec[y]) / (math.sqrt(float(vec[x] @ vec[x]) * float(vec[y] @ vec[y])) or 1.0)
    close = {x: [y for y in vec if cos(x, y) >= 0.72] for x in vec}
    held = {x: [i for i, v in text.items() if v == x] for x in vec}
    newest = {x: min((-r.created_at.timestamp(), r.id) for r in t if text[r.id] == x) for x in vec}
    reached = {x: sum(len(held[y]) for y in close[x]) for x in vec}
    assert {r.ticket_id: r.duplicate_count for r in out["duplicate_counts"].collect()} == \
        {i: reached[x] - 1 for i, x in text.items() if reached[x] > 1}
    want = set()
    for x in vec:
        if reached[x] > 1:
            near = sorted((-math.floor(cos(x, y) * 1000 + 0.5), newest[y], min(held[y])) for y in close[x] if y != x)
            want.add((min(held[x]), len(held[x]), len(close[x]) - 1, reached[x] - len(held[x]),
                      near[0][2] if near else None, -near[0][0] / 1000 if near else None))
    assert {tuple(r) for r in out["duplicates"].collect()} == want and want


def test_rows_moved_grow_with_the_texts_not_with_their_pairs(spark):
    """One family of similar texts: every text resembles every other."""
    per_text = []
    for n in (300, 1200, 4800):
        texts = spark.range(n).selectExpr("id AS place", "concat('same words in every text of the family ', id % 7, ' x', id) AS text", "1L AS copies")
        found = SIM.text_matches(texts.coalesce(2), 9, 0.22, 0.72)
        counts = found.where("b IS NULL").agg(F.sum("links").alias("links")).first()
        assert counts.links > n * n // 4                      # pairs grow with the square
        per_text.append(found.count() / n)
    assert max(per_text) <= 2 * min(per_text)


def test_every_duplicate_pair_equals_brute_force(spark, monkeypatch):
    """All pairs of texts, also beyond the best ten of a text, over many blocks and slabs."""
    monkeypatch.setattr(SIM, "TEXT_GROUP", 10)
    words = [f"shared words of one family {i % 30} v{i % 4}" for i in range(90)] + [f"lonely{i}" for i in range(9)] + ["twice alone"] * 2
    rows = [(i, None, w, "Open", dt.datetime(2024, 1, 1, i % 24)) for i, w in enumerate(words)]
    tickets = spark.createDataFrame(rows, "id long, subject string, description string, status string, created_at timestamp_ntz")
    held = {}
    for i, w in enumerate(words):
        held.setdefault(w, []).append(i)
    want = set()
    for x, xs in held.items():
        for y, ys in held.items():
            a, b = _vec(" " + x), _vec(" " + y)
            cos = float(a @ b) / math.sqrt(float(a @ a) * float(b @ b))
            if cos >= 0.72 and (min(xs) < min(ys) or (x == y and len(xs) > 1)):
                want.add((min(xs), min(ys), math.floor(cos * 1000 + 0.5) / 1000, len(xs), len(ys)))
    got = [tuple(r) for r in SIM.duplicate_pairs(tickets, slab_bytes=7 * 8 * 256).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_near_duplicates_equals_brute_force(views):
    docs = views.table("documents")
    fast = {(r.doc_a, r.doc_b, r.inter, r.copies_a, r.copies_b) for r in SIM.near_duplicates(docs).collect()}
    per_doc = {r.doc_id: frozenset(TOK.findall(r.text.lower())) for r in docs.collect()}
    groups = {}
    for d, st in per_doc.items():
        if st:
            groups.setdefault(st, []).append(d)
    reps = sorted((min(ds), st, len(ds)) for st, ds in groups.items())
    brute = set()
    for i, (a, sa, ca) in enumerate(reps):
        for b, sb, cb in reps[i + 1:]:
            inter, union = len(sa & sb), len(sa | sb)
            if inter / union >= 0.72:
                brute.add((a, b, inter, ca, cb))
    assert fast == brute and len(brute) > 0
    # lossless: every document pair above the threshold is a copy pair or a representative pair
    rep_of = {d: min(ds) for ds in groups.values() for d in ds}
    ids = sorted(d for d in per_doc if per_doc[d])
    for i, x in enumerate(ids[:60]):
        for y in ids[i + 1:]:
            sx, sy = per_doc[x], per_doc[y]
            if len(sx & sy) / len(sx | sy) >= 0.72 and rep_of[x] != rep_of[y]:
                assert (min(rep_of[x], rep_of[y]), max(rep_of[x], rep_of[y])) in {(f[0], f[1]) for f in fast}


def test_near_duplicates_with_a_token_in_every_prefix(spark):
    """One token in every set, among the rarest of each: its sets are split and no pair is lost or doubled."""
    rows = [(i, f"common x{i % 25} y{i % 4}") for i in range(400)] + [(1000 + i, f"common z{i} own{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(t.split()), []).append(i)
    reps = sorted((min(ids), s, len(ids)) for s, ids in sets.items())
    want = sorted((a, b, ca, cb) for x, (a, sa, ca) in enumerate(reps) for b, sb, cb in reps[x + 1:] if len(sa & sb) / len(sa | sb) >= 0.5)
    for heavy in (10, 50, 10_000):
        got = SIM.near_duplicates(docs, threshold=0.5, heavy=heavy)
        assert sorted((r.doc_a, r.doc_b, r.copies_a, r.copies_b) for r in got.collect()) == want and want


def test_near_duplicates_keep_their_candidates_in_the_task(spark):
    """Many sets of a small vocabulary share prefix tokens: the pairs meet slab by slab, and neither they nor
    the full sets pass a shuffle.  Any slab, part and number of ordered tokens gives every pair once."""
    rng = np.random.default_rng(7)
    base = [rng.choice(60, int(k), replace=False) for k in rng.integers(1, 30, 80)]
    rows = []
    for i in range(400):
        words = set(base[i % 80].tolist())
        words ^= set(rng.choice(60, int(rng.integers(0, 4)), replace=False).tolist())
        rows.append((i, " ".join(f"w{w}" for w in words)))
    rows += [(400, None), (401, " .,"), (None, "only here x y"), (402, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        if t and t.strip(" .,"):
            sets.setdefault(frozenset(t.split()), []).append(i)
    reps = sorted((min(ids), s, len(ids)) for s, ids in sets.items() if None not in ids)
    want = sorted((a, b, len(sa & sb), len(sa | sb), ca, cb) for x, (a, sa, ca) in enumerate(reps) for b, sb, cb in reps[x + 1:]
                  if len(sa & sb) / len(sa | sb) >= 0.72)
    assert len(want) > 300
    for slab_bytes, ordered, heavy in ((1 << 25, 1 << 20, 1 << 20), (20_000, 20, 50), (3_000_000, 0, 1000)):
        got = SIM.near_duplicates(docs, slab_bytes=slab_bytes, ordered=ordered, heavy=heavy)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted((r.doc_a, r.doc_b, r.inter, r.union_size, r.copies_a, r.copies_b) for r in got.collect()) == want


def test_near_duplicates_send_only_sets_with_a_partner_in_full(spark, monkeypatch):
    """Prefixes and sketches of all sets meet first; the full sets of those without a partner are not sent to the tasks."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{w}" for w in rng.choice(900, 60, replace=False))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + f" own{i}") for i in range(3)]
    sent, inverted = [], SIM._inverted

    def seen(slab, t):
        sent.append((slab.num_rows, "toks" in slab.column_names))
        return inverted(slab, t)
    monkeypatch.setattr(SIM, "_inverted", seen)
    got = SIM.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_a, r.doc_b, r.inter, r.union_size) for r in got) == [(i, 1000 + i, 60, 61) for i in range(3)]
    assert sum(n for n, full in sent if full) == 6 and sum(n for n, full in sent if not full) == 303


def test_near_duplicates_of_sets_with_sketches_of_many_sizes(spark):
    """Sets of 1 to 1,400 words, whose sketches have different numbers of bits, over several slabs: as brute force."""
    rng = np.random.default_rng(5)
    rows = []
    for k in (1, 2, 3, 5, 20, 100, 200, 250, 256, 300, 500, 520, 1000, 1020, 1030):
        words = rng.choice(4000, k, replace=False)
        for more in (0, k // 9, k // 4, k // 3):
            new = rng.choice(4000, more, replace=False)
            rows += [(len(rows), words), (len(rows) + 1, np.concatenate([words, new])), (len(rows) + 2, np.concatenate([words[more:], new]))]
    sets = {}
    for i, w in rows:
        sets.setdefault(frozenset(w.tolist()), []).append(i)
    reps = sorted((min(ids), s) for s, ids in sets.items() if s)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in w)) for i, w in rows], "doc_id long, text string")
    for t, slab_bytes in ((0.72, 60_000), (0.4, 1 << 25)):
        want = sorted((a, b, len(sa & sb), len(sa | sb)) for x, (a, sa) in enumerate(reps) for b, sb in reps[x + 1:] if len(sa & sb) / len(sa | sb) >= t)
        got = SIM.near_duplicates(docs, threshold=t, slab_bytes=slab_bytes)
        assert sorted((r.doc_a, r.doc_b, r.inter, r.union_size) for r in got.collect()) == want and len(want) > 50


def test_near_duplicates_without_words(spark):
    """No documents, or none with words."""
    for rows in ([], [(1, None), (2, "...")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert SIM.near_duplicates(docs).collect() == []


def test_near_duplicates_of_repeated_rows(spark):
    """Rows of one id and text: a pair per row of the representatives, copies count all of them."""
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in SIM.near_duplicates(docs).collect()] == [(1, 2, 5, 6, 5 / 6, 2, 2)] * 2


def test_exact_duplicates_groups(views):
    d = SIM.exact_duplicates(views.table("documents"))
    rows = d.collect()
    assert rows, "fixture has exact copies"
    canon = {r.dup_key: r.canonical_doc_id for r in rows}
    for r in rows:
        assert r.canonical_doc_id == canon[r.dup_key] <= r.doc_id
    assert d.where(~F.col("is_copy")).count() == d.select("dup_key").distinct().count()


def test_replacement_drops_requested_keys_with_an_empty_result(spark):
    from opsdesk.operators.retrieve import replace_by_key
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    asked = spark.createDataFrame([(1,), (3,)], "k int")
    assert [tuple(r) for r in replace_by_key(old, old.limit(0), ["k"], asked).collect()] == [(2, "c")]
    new = spark.createDataFrame([(1, "x"), (2, "not asked")], "k int, v string")
    assert sorted(tuple(r) for r in replace_by_key(old, new, ["k"], asked).collect()) == [(1, "x"), (2, "c")]
