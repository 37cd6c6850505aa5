"""Words that appear in the data or in results and must keep their exact spelling."""

# --- Fixed values: source vocabularies, in their listed order -------------------------------
SEGMENTS = ("Premium", "Standard", "Basic", "Enterprise")
REGIONS = ("Northeast", "Southeast", "Midwest", "West", "Southwest")
POLICY_TYPES = ("Auto", "Home", "Life", "Health", "Umbrella", "Renters", "Travel", "Pet")
POLICY_STATUSES = ("Active", "Cancelled", "Expired", "Pending")
CLAIM_TYPES = (
    "Collision", "Theft", "Water Damage", "Fire", "Medical", "Liability", "Windstorm", "Vandalism",
)
CLAIM_STATUSES = ("Open", "Under Review", "Approved", "Denied", "Settled", "Closed")
UNRESOLVED_CLAIM = ("Open", "Under Review")
PAYMENT_STATUSES = ("Completed", "Failed", "Pending", "Refunded")
PAYMENT_METHODS = ("Credit Card", "Debit Card", "Bank Transfer", "ACH", "Check", "Auto-Pay")
FAILURE_REASONS = (
    "Insufficient funds", "Card declined", "Account closed", "Invalid routing number",
    "Payment limit exceeded",
)
CHANNELS = ("Phone", "Email", "Chat", "Web Portal", "Mobile App")
DIRECTIONS = ("Inbound", "Outbound")
DISPOSITIONS = (
    "Resolved", "Escalated", "Follow-up Required", "Transferred", "Closed", "Pending",
)
TOPICS = (
    "Billing Inquiry", "Claim Status", "Policy Change", "Cancellation Request", "New Quote",
    "Payment Issue", "Coverage Question", "Complaint", "Renewal", "General Inquiry",
)
SURVEY_TYPES = ("NPS", "CSAT", "Post-Claim", "Post-Call", "Annual")
GENDERS = ("Male", "Female", "Other")

# --- Fixed values: derived vocabularies ------------------------------------------------------
RISK_LEVELS = ("CRITICAL", "AT_RISK", "MONITOR", "HEALTHY")
INTENTS = (
    "cancellation_intent", "payment_issue", "product_request", "complaint", "price_sensitivity",
    "competitor_comparison",
)
ENTITY_KINDS = ("competitors", "products", "people")
ACTION_TYPES = (
    "RETENTION_OFFER", "CLAIMS_ESCALATION", "COMPETITOR_RETENTION_CAMPAIGN", "CROSS_SELL",
    "PAYMENT_ASSISTANCE",
)
DECISIONS = ("APPROVED", "REJECTED")
BLOCKING_STATUSES = ("PENDING", "APPROVED")
NO_INTERACTIONS = "No recent interactions recorded."
