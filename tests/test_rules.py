"""Golden tests for the rule tables (classification, resolution, safety, routing)."""

from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.operators import classify as CL
from opsdesk.operators import resolve as RS

# own sentences, one per branch: (id, subject, message, rule index or None, urgent, negative, missing)
SENTENCES = [
    ("paid-plan", "Upgrade was billed but nothing changed", "You charged 42.50 on Monday and the old limits still apply.", 0, False, True, ""),
    ("sign-in", "New passphrase not accepted", "Every login ends on the first page, so I cannot work.", 1, False, True, ""),
    ("receipts", "Copy of an invoice", "Please send the document for our bookkeeping.", 0, False, False, "Transaction date and amount"),
    ("pdf", "Saving as a file stops", "An error box appears and the program crashes.", 2, False, True, ""),
    ("wish", "An idea for the editor", "I suggest a darker colour theme.", 3, False, False, ""),
    ("twice", "Duplicate charge this week", "Both entries are on the bank statement, and I was charged for each.", 0, True, True, "Transaction date and amount"),
    ("hours", "Opening hours", "When does the help desk answer the phone?", None, False, False, ""),
]


def by_the_table(rule, urgent, negative, missing):
    """What the rule table says for a sentence that meets these conditions."""
    category = LX.CATEGORY_RULES[rule][0] if rule is not None else LX.DEFAULT_CATEGORY[0]
    priority = "Urgent" if urgent else ("High" if category == "Billing" else "Medium") if negative else "Low"
    severity = "Critical" if urgent else "Major" if negative else "Minor"
    return category, priority, severity, "Negative" if negative else "Neutral", missing


def test_rule_classification(spark):
    df = spark.createDataFrame([x[:3] for x in SENTENCES], "id string, subject string, description string")
    out = CL.classify(df).select("id", "category", "priority", "severity", "sentiment",
                                 F.array_join("missing_information", "; ").alias("m")).collect()
    got = {r.id: (r.category, r.priority, r.severity, r.sentiment, r.m) for r in out}
    assert got == {x[0]: by_the_table(*x[3:]) for x in SENTENCES}


def test_confidence_and_payment_reference(spark):
    df = spark.createDataFrame([("a", "Question", "Where is the guide"), ("b", "Payment", "payment failed")],
                               "id string, subject string, description string")
    r = {x.id: x for x in CL.classify(df).collect()}
    assert r["a"].confidence == 0.58 and r["a"].category == "General Support"
    assert r["b"].confidence == 0.86
    assert r["b"].missing_information == ["Transaction date and amount", "Payment or transaction reference"]


def test_response_safety(spark):
    df = spark.createDataFrame([("It is certain: your refund is guaranteed by us today.",), ("short",),
                                ("Card 4111111111111111 is on file and will be charged.",),
                                ("A colleague reads your case today and writes back.",)], "content string")
    rows = RS.check_response(df).collect()
    assert not rows[0].safe and "Draft makes a guarantee or refund promise that requires verification." in rows[0].issues
    assert "Policy-related language has no retrieved supporting evidence." in rows[0].issues
    assert rows[1].issues == ["Draft is too short to address the customer."]
    assert rows[2].issues == ["Draft may expose a payment-card number."]
    assert rows[3].safe


def test_routing_and_escalation(spark):
    df = spark.createDataFrame([("Billing", "Major", 0, None), ("Feedback", "Critical", 1, None),
                                ("Technical", "Minor", 1, "breached"), ("Other", "Minor", 1, "on_track")],
                               "category string, severity string, ev int, sla string")
    has_ev = F.col("ev") > 0
    out = df.select(RS.team_for(F.col("category")).alias("team"),
                    RS.escalation_required(F.col("severity"), F.col("category"), has_ev, F.col("sla")).alias("e")) \
        .collect()
    assert [r.team for r in out] == ["Billing Team", "Product Support", "Technical Support", "General Support"]
    assert [r.e for r in out] == [True, True, True, False]


def test_normalize_predictions_variants(views):
    n = CL.normalize_predictions(views.predictions)
    res = {r.error for r in n.collect()}
    assert None in res
    assert "AI returned an unsupported classification enum." in res
    assert "AI response is not a JSON object." in res
    assert "AI field key_information must be a list of strings." in res
    clamp = n.where(F.col("category") == "Account Access").select("confidence", "priority").distinct().collect()
    assert [(r.confidence, r.priority) for r in clamp] == [(1.0, "Low")]


def test_fixture_phrases_classify_as_documented(spark):
    from opsdesk.sources.views import PHRASES
    expected = {
        0: ("Billing", "High", "Major", "Negative", ""),
        1: ("Billing", "Low", "Minor", "Neutral", "Transaction date and amount; Payment or transaction reference"),
        2: ("Billing", "Low", "Minor", "Neutral", ""),
        3: ("Account Access", "Low", "Minor", "Neutral", ""),
        4: ("Account Access", "Urgent", "Critical", "Negative", ""),
        5: ("Technical", "Medium", "Major", "Negative", ""),
        6: ("Technical", "Medium", "Major", "Negative", ""),
        7: ("Technical", "Low", "Minor", "Neutral", ""),
        8: ("Feedback", "Low", "Minor", "Neutral", ""),
        9: ("Feedback", "Low", "Minor", "Neutral", ""),
        10: ("General Support", "Low", "Minor", "Neutral", ""),
        11: ("Billing", "Urgent", "Critical", "Neutral", "Transaction date and amount"),
    }
    df = spark.createDataFrame([(p, s, m) for p, s, m, _, _ in PHRASES], "id int, subject string, description string")
    out = CL.classify(df).select("id", "category", "priority", "severity", "sentiment",
                                 F.array_join("missing_information", "; ").alias("m")).collect()
    assert {r.id: (r.category, r.priority, r.severity, r.sentiment, r.m) for r in out} == expected
    # the view's stored category / sentiment columns agree with the rules
    assert all(expected[p][0] == c and expected[p][3] == se for p, _, _, c, se in PHRASES)
