"""Rule tables and message texts.

FIXED VALUES — these must equal the behaviour being reproduced (keyword lists, enum maps,
thresholds and the exact English texts the operators emit).  They are stated plainly, in
their natural order, and are parameters of the operators (``lexicon=``), not code.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES: enums
STATUSES = ["Open", "In Progress", "Pending", "Escalated", "Resolved", "Closed"]
CLOSED_STATUSES = ["Resolved", "Closed"]
KPI_OPEN_STATUSES = ["Open", "In Progress", "Pending"]
PRIORITIES = ["Urgent", "High", "Medium", "Low"]
SEVERITIES = ["Minor", "Moderate", "Major", "Critical"]
SENTIMENTS = ["Positive", "Neutral", "Frustrated", "Angry", "Negative", "Very negative"]
CHANNELS = ["Email", "SMS", "Web"]
OUTBOUND_CHANNELS = ["Email", "SMS"]

# ---------------------------------------------------------------- FIXED VALUES: classification
# (category, intent, keywords) — first match wins, substring of lower(subject + " " + message)
CATEGORY_RULES = [
    ("Billing", "Subscription or payment issue", ["charge", "payment", "invoice", "billing", "subscription"]),
    ("Account Access", "Password or sign-in issue", ["password", "login", "sign in", "reset"]),
    ("Technical", "Troubleshooting request", ["crash", "error", "export", "bug", "fail"]),
    ("Feedback", "Feature request", ["suggest", "feature", "would be helpful"]),
]
DEFAULT_CATEGORY = ("General Support", "Product assistance")
URGENT_KEYWORDS = ["fraud", "security breach", "duplicate charge", "locked out"]
NEGATIVE_KEYWORDS = ["angry", "frustrated", "still", "charged", "can't", "cannot", "crash", "failed"]
AMOUNT_PATTERN = r"\b\d{1,5}(?:\.\d{2})?\b"
MISSING_AMOUNT = "Transaction date and amount"
MISSING_REFERENCE = "Payment or transaction reference"
CONFIDENCE_KNOWN = 0.86
CONFIDENCE_GENERAL = 0.58
IMPACT_NEGATIVE = "Service or billing issue requires follow-up"
IMPACT_NEUTRAL = "Information request or low-impact issue"
REASON_URGENT = "Potential security or financial risk"
REASON_NEGATIVE = "Customer impact and sentiment indicate follow-up is needed"
REASON_NONE = "No urgent indicators detected"
RULE_UNCERTAINTY_FLAG = "Demo analysis; validate before customer communication"
LOW_CONFIDENCE = 0.6

# ---------------------------------------------------------------- FIXED VALUES: model-output normaliser
PREDICTION_DEFAULTS = {
    "category": "General Support", "subcategory": "Other", "intent": "Support request",
    "priority": "Medium", "severity": "Moderate", "sentiment": "Neutral",
    "customer_impact": "Impact not established", "key_information": [], "missing_information": [],
    "urgency_reason": "No urgency reason returned", "confidence": 0.5, "uncertainty_flags": [],
}
PRIORITY_MAP = {"low": "Low", "medium": "Medium", "high": "High", "urgent": "Urgent", "critical": "Urgent"}
SEVERITY_MAP = {"low": "Minor", "minor": "Minor", "moderate": "Moderate", "medium": "Moderate",
                "high": "Major", "major": "Major", "critical": "Critical"}
SENTIMENT_MAP = {"positive": "Positive", "neutral": "Neutral", "frustrated": "Frustrated", "angry": "Angry",
                 "negative": "Negative", "very negative": "Very negative"}

# ---------------------------------------------------------------- FIXED VALUES: routing
TEAM_BY_CATEGORY = {"Billing": "Billing Team", "Technical": "Technical Support",
                    "Account Access": "Technical Support", "Feedback": "Product Support"}
DEFAULT_TEAM = "General Support"
DEFAULT_AGENT = "Unassigned"
DEFAULT_ROUTING_CONFIDENCE = 0.55
TOOL_CATEGORIES = ["Billing", "Account Access", "Technical"]

# ---------------------------------------------------------------- FIXED VALUES: SLA
FIRST_RESPONSE_AT_RISK_SECONDS = 3600
RESOLUTION_AT_RISK_SECONDS = 21600

# ---------------------------------------------------------------- FIXED VALUES: similarity / retrieval
SIMILAR_MIN_SCORE = 0.22
DUPLICATE_MIN_SCORE = 0.72
SIMILAR_TOP = 8
HASH_DIMS = 256
CHUNK_SIZE = 850
CHUNK_OVERLAP = 120
TOKEN_PATTERN = r"[\p{L}\p{N}_₹]+"
K_WORKFLOW, K_BULK, K_COPILOT, K_SEARCH = 4, 2, 3, 5

# ---------------------------------------------------------------- FIXED VALUES: resolution texts
EVIDENCE_PREFIX = "Knowledge evidence found: "
NO_EVIDENCE_TEXT = ("No relevant approved knowledge evidence was retrieved. Do not assert company policy; "
                    "verify with the appropriate team.")
STEP_CONFIRM = "Confirm the reported issue and review the relevant account or transaction record."
STEP_MISSING_PREFIX = "Request the missing details: "
STEP_WITH_EVIDENCE = "Follow the retrieved support guidance and document the verification result."
STEP_WITHOUT_EVIDENCE = ("Verify the applicable policy or technical procedure with the responsible support team "
                         "before advising the customer.")
LIKELY_CAUSE = "Not confirmed; verify against the account or system record."
REQUIRED_CHECKS = ["Verify customer identity using approved procedures",
                   "Confirm relevant account or transaction status"]
CUSTOMER_ACTION = "Provide missing reference details if available."
INTERNAL_ACTION = "Review the account and record findings."
ESCALATE_REASON = "Critical impact, breached SLA, or billing issue lacks sufficient verified evidence."
NO_ESCALATE_REASON = "No escalation trigger identified from the available information."
DRAFT_GREETING = "Hi, thanks for contacting support. I understand you’re reaching out about: "
DRAFT_NO_EVIDENCE = ("We’re checking the relevant details so we can give you an accurate answer. Could you share "
                     "any relevant date or reference number? Our team will review and follow up.")
DRAFT_FOOTER = ("\n\nPlease do not send full payment-card details. We’ll update you once the review is complete."
                "\n\nRegards,\nSupport Team")
DRAFT_SMS = ("Thanks for contacting Support. We’re reviewing your issue and will follow up. "
             "Please don’t share full card details.")
UNSAFE_REFUND_KEYWORDS = ["refund policy", "guarantee", "refund"]
UNSAFE_REFUND_ISSUE = "No retrieved evidence supports a refund policy claim; verify manually before sending."
ROUTING_REASON = "Routed based on {category} category and ticket context."

# ---------------------------------------------------------------- FIXED VALUES: response safety
GUARANTEE_PATTERN = r"(?i)\b(?:guaranteed|definitely refunded|refund is approved)\b"
CARD_PATTERN = r"\b\d{13,19}\b"
POLICY_PATTERN = r"(?i)\b(policy|refund|eligible|entitled)\b"
ISSUE_TOO_SHORT = "Draft is too short to address the customer."
ISSUE_GUARANTEE = "Draft makes a guarantee or refund promise that requires verification."
ISSUE_CARD = "Draft may expose a payment-card number."
ISSUE_POLICY = "Policy-related language has no retrieved supporting evidence."
MIN_DRAFT_LENGTH = 20

# ---------------------------------------------------------------- FIXED VALUES: white space of Unicode
# (as Python's str.split sees it; the class reads alike in Java and RE2)
WHITESPACE = ("[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
              "\\x{202F}\\x{205F}\\x{3000}]")

# ---------------------------------------------------------------- FIXED VALUES: intake / contacts
EMAIL_PATTERN = r"[^@\s]+@[^@\s]+\.[^@\s]+"
PHONE_PATTERN = r"\+[1-9]\d{7,14}"
SMS_MAX_CHARS = 1600
SUBJECT_MAX_CHARS = 200
ERR_REQUIRED = "Name, subject, and message are required."
ERR_EMAIL = "Enter a valid email address."
ERR_FEEDBACK = "Add a message and choose a rating from 1 to 5, or leave the rating blank."
ERR_FEEDBACK_EMAIL = "Enter a valid email address or leave it blank."
ERR_STATUS = "Unsupported ticket status."
BULK_ERR_TEXT = "Required ticket text is missing or invalid."
BULK_FAILED_SUBJECT = "Row failed"

# ---------------------------------------------------------------- FIXED VALUES: outbox gates (in order)
GATE_NOT_APPROVED = "An agent must explicitly approve the final response before sending."
GATE_BLANK = "Message cannot be empty."
GATE_CHANNEL = "Only Email and SMS communication are supported."
GATE_NO_TICKET = "Ticket could not be found."
GATE_UNSAFE = "Response failed safety validation: "
GATE_REPEAT = "This exact message was already recorded. Edit the draft before approving another send."

# ---------------------------------------------------------------- FIXED VALUES: tools
TOOL_NAMES = ["get_customer", "get_ticket", "get_order_status"]
TOOL_ORDER_UNAVAILABLE = "No external order system is connected. Verify manually."
TOOL_NOT_PERMITTED = "Tool is not permitted."

# ---------------------------------------------------------------- FIXED VALUES: audit event names
EV_ANALYSIS = "ai_analysis_completed"
EV_ESCALATION = "escalation_recommended"
EV_SIMILAR = "similar_cases_found"
EV_TOOL = "mcp_tool_called"
EV_CREATED = "ticket_created"
EV_STATUS = "ticket_status_changed"
EV_ROUTING = "routing_recommendation_accepted"
EV_DELIVERY_FAILED = "message_delivery_failed"
EV_RECORDED = "message_recorded"
EV_APPROVED = "response_approved"
EV_VALIDATED = "response_validation_passed"
