"""Ticket classification.

CL1  rule classification (pure Column expressions — no UDF, stays in whole-stage codegen)
CL2  model-output normaliser over stored JSON predictions (VARIANT parsing, typed checks)
CL3  prediction-or-rules choice with a mode tag
CL15 low-confidence flag
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import contains_any, py_strip


@dataclass(frozen=True)
class Lexicon:
    """Rule tables of CL1; defaults are the fixed values in ``functions.lexicon``."""
    category_rules: list = field(default_factory=lambda: list(LX.CATEGORY_RULES))
    default_category: tuple = LX.DEFAULT_CATEGORY
    urgent: list = field(default_factory=lambda: list(LX.URGENT_KEYWORDS))
    negative: list = field(default_factory=lambda: list(LX.NEGATIVE_KEYWORDS))
    amount_pattern: str = LX.AMOUNT_PATTERN


DEFAULT_LEXICON = Lexicon()

ANALYSIS_FIELDS = ["category", "subcategory", "intent", "priority", "severity", "sentiment", "customer_impact",
                   "key_information", "missing_information", "urgency_reason", "confidence", "uncertainty_flags"]


def compact(*items: Column) -> Column:
    """Array of the non-null ``items`` in order — ``concat`` of conditional singletons, which
    stays in whole-stage codegen (a ``filter`` lambda would be interpreted)."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.when(i.isNotNull(), F.array(i)).otherwise(empty) for i in items])


FIELDS = ["category", "subcategory", "intent", "priority", "severity", "sentiment", "customer_impact",
          "key_information", "missing_information", "urgency_reason", "confidence", "uncertainty_flags"]


def with_rule_analysis(df: DataFrame, subject: str, message: str, lex: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """CL1 as columns appended to ``df``.

    Built in three projections so each intermediate is computed once per row: the lower-cased
    text (used by every keyword test), then the category index and urgent / negative flags
    (used by several fields), then the fields.  Catalyst keeps the projections apart because
    each intermediate is referenced more than once."""
    rules = list(lex.category_rules)
    x = F.col("_x")
    s1 = df.withColumn("_x", F.lower(F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit(" "),
                                            F.coalesce(F.col(message), F.lit("")))))
    idx = F.lit(len(rules))
    for i in reversed(range(len(rules))):
        idx = F.when(contains_any(x, rules[i][2]), F.lit(i)).otherwise(idx)
    s2 = s1.withColumn("_ci", idx).withColumn("_urgent", contains_any(x, lex.urgent)) \
        .withColumn("_neg", contains_any(x, lex.negative)) \
        .withColumn("_amount", x.rlike(lex.amount_pattern)) \
        .withColumn("_payment_ref", x.contains("payment") & ~x.contains("reference"))
    cats = F.array(*[F.lit(c) for c, _, _ in rules], F.lit(lex.default_category[0]))
    intents = F.array(*[F.lit(i) for _, i, _ in rules], F.lit(lex.default_category[1]))
    ci = F.col("_ci")
    s3 = s2.withColumn("category", F.element_at(cats, ci + 1)).withColumn("intent", F.element_at(intents, ci + 1))
    urgent, neg = F.col("_urgent"), F.col("_neg")
    billing = F.col("category") == "Billing"
    out = s3.select(
        *[c for c in s3.columns if not c.startswith("_") and c not in FIELDS],
        "category",
        F.col("intent").alias("subcategory"),
        "intent",
        F.when(urgent, "Urgent").when(neg & billing, "High").when(neg, "Medium").otherwise("Low").alias("priority"),
        F.when(urgent, "Critical").when(neg, "Major").otherwise("Minor").alias("severity"),
        F.when(neg, "Negative").otherwise("Neutral").alias("sentiment"),
        F.when(neg, LX.IMPACT_NEGATIVE).otherwise(LX.IMPACT_NEUTRAL).alias("customer_impact"),
        F.array(F.coalesce(F.col(subject), F.lit("")), F.coalesce(F.col(message), F.lit(""))).alias("key_information"),
        compact(F.when(billing & ~F.col("_amount"), F.lit(LX.MISSING_AMOUNT)),
                F.when(F.col("_payment_ref"), F.lit(LX.MISSING_REFERENCE))).alias("missing_information"),
        F.when(urgent, LX.REASON_URGENT).when(neg, LX.REASON_NEGATIVE).otherwise(LX.REASON_NONE)
         .alias("urgency_reason"),
        F.when(F.col("category") != LX.DEFAULT_CATEGORY[0], F.lit(LX.CONFIDENCE_KNOWN))
         .otherwise(F.lit(LX.CONFIDENCE_GENERAL)).alias("confidence"),
        F.array(F.lit(LX.RULE_UNCERTAINTY_FLAG)).alias("uncertainty_flags"),
    )
    return out


def rule_analysis_struct() -> Column:
    """The analysis columns added by ``with_rule_analysis`` as one struct."""
    return F.struct(*[F.col(c) for c in FIELDS])


def classify(tickets: DataFrame, subject: str = "subject", message: str = "description",
             lex: Lexicon = DEFAULT_LEXICON, keep: list[str] | None = None) -> DataFrame:
    """CL1: one analysis per input row, flattened next to the ``keep`` columns."""
    keep = keep if keep is not None else ["id"]
    base = tickets.select(*keep, F.col(subject).alias("_subject"), F.col(message).alias("_message"))
    return with_rule_analysis(base, "_subject", "_message", lex).select(*keep, *FIELDS)


def low_confidence(confidence: Column) -> Column:
    """CL15: confidence below 0.6."""
    return confidence < LX.LOW_CONFIDENCE


# ----------------------------------------------------------------------------- CL2
def _map_lookup(mapping: dict, value: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, F.lower(py_strip(value)))


def normalize_predictions(preds: DataFrame, raw: str = "raw_json", keep: list[str] | None = None) -> DataFrame:
    """CL2: validate and normalise stored model JSON.

    Absent keys take defaults; an explicit null, an unknown enum, a non-list or non-string
    list item, or a blank text field rejects the row (``error`` set, ``valid`` false).
    Parsing uses VARIANT so presence, null and JSON type are told apart exactly."""
    keep = keep if keep is not None else ["ticket_id"]
    # parse once: the VARIANT is referenced by ~30 field checks below, and Catalyst keeps this
    # projection apart because it is referenced more than once
    preds = preds.select(*keep, F.try_parse_json(F.col(raw)).alias("_v"))
    v = F.col("_v")
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def present(k):
        return F.try_variant_get(v, f"$.{k}", "variant").isNotNull()

    def vtype(k):
        return F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))

    def text_value(k):
        return F.try_variant_get(v, f"$.{k}", "string")

    D = LX.PREDICTION_DEFAULTS
    cols, errs = {}, []
    for k, mapping in (("priority", LX.PRIORITY_MAP), ("severity", LX.SEVERITY_MAP),
                       ("sentiment", LX.SENTIMENT_MAP)):
        mapped = _map_lookup(mapping, text_value(k))
        cols[k] = F.when(present(k), mapped).otherwise(F.lit(D[k]))
        errs.append(F.when(present(k) & mapped.isNull(), F.lit("AI returned an unsupported classification enum.")))
    conf = F.try_variant_get(v, "$.confidence", "double")
    cols["confidence"] = F.when(present("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))) \
        .otherwise(F.lit(D["confidence"]))
    errs.append(F.when(present("confidence") & conf.isNull(), F.lit("AI field confidence is not a number.")))
    for k in ("key_information", "missing_information", "uncertainty_flags"):
        arr = F.try_variant_get(v, f"$.{k}", "array<variant>")
        all_str = F.forall(arr, lambda x: F.schema_of_variant(x) == "STRING")
        ok = arr.isNotNull() & all_str
        cols[k] = F.when(present(k), F.when(ok, F.try_variant_get(v, f"$.{k}", "array<string>"))) \
            .otherwise(F.array().cast("array<string>"))
        errs.append(F.when(present(k) & ~F.coalesce(ok, F.lit(False)),
                           F.lit(f"AI field {k} must be a list of strings.")))
    for k in ("category", "subcategory", "intent", "customer_impact", "urgency_reason"):
        ok = (vtype(k) == "STRING") & (F.length(py_strip(text_value(k))) > 0)
        cols[k] = F.when(present(k), text_value(k)).otherwise(F.lit(D[k]))
        errs.append(F.when(present(k) & ~F.coalesce(ok, F.lit(False)), F.lit(f"AI field {k} is missing.")))
    error = F.when(v.isNull() | ~is_obj, F.lit("AI response is not a JSON object.")) \
        .otherwise(F.coalesce(*errs))
    out = preds.select(*keep, error.alias("error"), *[cols[k].alias(k) for k in ANALYSIS_FIELDS])
    return out.select(*keep, (F.col("error").isNull()).alias("valid"), "error",
                      *[F.when(F.col("error").isNull(), F.col(k)).alias(k) for k in ANALYSIS_FIELDS])


def with_fallback(tickets: DataFrame, predictions: DataFrame | None, subject: str = "subject",
                  message: str = "description", id_col: str = "id",
                  lex: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """CL3: use a valid model prediction, else the rules.

    mode = ``model`` (valid prediction), ``rules_fallback`` (prediction present but rejected),
    ``rules`` (no prediction)."""
    rules = classify(tickets, subject, message, lex, keep=[id_col]) \
        .select(F.col(id_col).alias("ticket_id"), rule_analysis_struct().alias("r"))
    if predictions is None:
        return rules.select("ticket_id", F.lit("rules").alias("mode"), F.lit(None).cast("string").alias("note"),
                            "r.*")
    norm = normalize_predictions(predictions)
    p = norm.select("ticket_id", "valid", "error",
                    F.struct(*[F.col(k) for k in ANALYSIS_FIELDS]).alias("m"))
    j = rules.join(p, "ticket_id", "left")
    chosen = F.when(F.col("valid"), F.col("m")).otherwise(F.col("r"))
    mode = F.when(F.col("valid"), "model").when(F.col("valid").isNotNull(), "rules_fallback").otherwise("rules")
    note = F.when(F.col("valid") == F.lit(False), F.concat(F.lit("Model output rejected; rules used ("),
                                                          F.col("error"), F.lit(")")))
    return j.select("ticket_id", mode.alias("mode"), note.alias("note"), chosen.alias("a")).select(
        "ticket_id", "mode", "note", "a.*")
