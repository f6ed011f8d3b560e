"""Resolution, safety and routing rules as Column builders (CL4-CL11, J8).

All are pure expressions over one enriched row; evidence arrays are bounded by the
retrieval k, so no operator here aggregates an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import contains_any, py_strip


def _non_null(arr_items: list[Column]) -> Column:
    """Non-null items in order, as a codegen-friendly concat of conditional singletons."""
    from opsdesk.operators.classify import compact
    return compact(*arr_items)


def investigation(evidence_contents: Column) -> Column:
    """CL5: joined evidence snippets (first 220 chars each) or the no-evidence sentence."""
    snippets = F.array_join(F.transform(evidence_contents, lambda c: F.substring(c, 1, 220)), "; ")
    return F.when(F.size(evidence_contents) > 0, F.concat(F.lit(LX.EVIDENCE_PREFIX), snippets)) \
        .otherwise(F.lit(LX.NO_EVIDENCE_TEXT))


def recommended_steps(missing: Column, has_evidence: Column) -> Column:
    """CL6: fixed first step, missing-details step, evidence-dependent step."""
    return _non_null([
        F.lit(LX.STEP_CONFIRM),
        F.when(F.size(missing) > 0, F.concat(F.lit(LX.STEP_MISSING_PREFIX), F.array_join(missing, ", "), F.lit("."))),
        F.when(has_evidence, F.lit(LX.STEP_WITH_EVIDENCE)).otherwise(F.lit(LX.STEP_WITHOUT_EVIDENCE)),
    ])


def escalation_required(severity: Column, category: Column, has_evidence: Column, sla_resolution: Column) -> Column:
    """CL7: Critical, or Billing without evidence, or a breached resolution SLA."""
    return (severity == "Critical") | (~has_evidence & (category == "Billing")) | \
        F.coalesce(sla_resolution == "breached", F.lit(False))


def escalation_reason(escalate: Column) -> Column:
    return F.when(escalate, F.lit(LX.ESCALATE_REASON)).otherwise(F.lit(LX.NO_ESCALATE_REASON))


def draft_reply(channel: Column, message: Column, top_evidence: Column) -> Column:
    """CL8: Email/Web template with message (360) and evidence (350) excerpts; SMS sentence."""
    body = F.coalesce(F.substring(top_evidence, 1, 350), F.lit(LX.DRAFT_NO_EVIDENCE))
    email = F.concat(F.lit(LX.DRAFT_GREETING), py_strip(F.substring(F.coalesce(message, F.lit("")), 1, 360)),
                     F.lit("\n\n"), body, F.lit(LX.DRAFT_FOOTER))
    return F.when(channel == "SMS", F.lit(LX.DRAFT_SMS)).otherwise(email)


def rule_draft_safe(message: Column, has_evidence: Column) -> Column:
    """CL9: safe if evidence exists or the message mentions no refund/guarantee wording."""
    return has_evidence | ~contains_any(F.lower(F.coalesce(message, F.lit(""))), LX.UNSAFE_REFUND_KEYWORDS)


def response_issues(draft: Column, has_evidence: Column) -> Column:
    """CL10: safety issues of a reply, in rule order."""
    d = F.coalesce(draft, F.lit(""))
    return _non_null([
        F.when(F.length(py_strip(d)) < LX.MIN_DRAFT_LENGTH, F.lit(LX.ISSUE_TOO_SHORT)),
        F.when(d.rlike(LX.GUARANTEE_PATTERN), F.lit(LX.ISSUE_GUARANTEE)),
        F.when(d.rlike(LX.CARD_PATTERN), F.lit(LX.ISSUE_CARD)),
        F.when(~has_evidence & d.rlike(LX.POLICY_PATTERN), F.lit(LX.ISSUE_POLICY)),
    ])


def check_response(df: DataFrame, draft: str = "content", has_evidence: Column | None = None) -> DataFrame:
    """CL10 over a frame: ``issues`` array and ``safe`` flag."""
    ev = has_evidence if has_evidence is not None else F.lit(False)
    issues = response_issues(F.col(draft), ev)
    return df.withColumn("issues", issues).withColumn("safe", F.size("issues") == 0)


def team_for(category: Column) -> Column:
    """CL11: category → team (literal map), default General Support."""
    m = F.create_map(*[F.lit(x) for kv in LX.TEAM_BY_CATEGORY.items() for x in kv])
    return F.coalesce(F.try_element_at(m, category), F.lit(LX.DEFAULT_TEAM))


def routing(category: Column, confidence: Column) -> Column:
    return F.struct(team_for(category).alias("team"), F.lit(LX.DEFAULT_AGENT).alias("agent"),
                    F.format_string(LX.ROUTING_REASON.replace("{category}", "%s"),
                                    F.coalesce(category, F.lit("None"))).alias("reason"),
                    F.coalesce(confidence, F.lit(LX.DEFAULT_ROUTING_CONFIDENCE)).alias("confidence"))


def tool_gate(enriched: DataFrame, customers: DataFrame, category: str = "category",
              customer_id: str = "customer_id") -> DataFrame:
    """CL4/J8: customer lookup only for Billing / Account Access / Technical; flags
    ``mcp_used`` and ``mcp_succeeded`` (the customer exists)."""
    c = customers.select(F.col("id").alias(customer_id), F.lit(True).alias("_found"))
    j = enriched.join(c, customer_id, "left")
    used = F.col(category).isin(*LX.TOOL_CATEGORIES)
    return j.withColumn("mcp_used", used) \
        .withColumn("mcp_succeeded", used & F.coalesce(F.col("_found"), F.lit(False))).drop("_found")
