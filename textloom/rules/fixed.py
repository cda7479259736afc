"""Word lists, patterns, weights and tiers that results depend on. Every operator takes its own as an argument."""

# --- fixed values: header lines of sections, most specific first; groups are number and title
SECTION_PATTERNS = (
    r"^(\d+)\.\s+([A-Z][^\n]+)",
    r"^(\d+)\s+([A-Z][A-Z\s]{3,})",
    r"^Section\s+(\d+)\s*[:\-]?\s*([^\n]+)",
    r"^SECTION\s+(\d+)\s*[:\-]?\s*([^\n]+)",
    r"^Article\s+([IVX]+)\s*[:\-]?\s*([^\n]+)",
    r"^([IVX]+)\.\s+([A-Z][^\n]+)",
    r"^([A-Z])\.\s+([A-Z][^\n]{5,})",
)
# --- fixed values: first lines of numbered clauses, then of bullets
CLAUSE_PATTERNS = (
    r"^(\d+\.\d+\.\d+)\s+(.+)",
    r"^(\d+\.\d+)\s+(.+)",
    r"^\((\d+)\)\s+(.+)",
    r"^(\d+)\)\s+(.+)",
    r"^\(([a-zA-Z])\)\s+(.+)",
    r"^([a-z])\)\s+(.+)",
    r"^([A-Z])\.\s+(.+)",
    r"^([ivx]+)\.\s+(.+)",
    r"^([IVX]+)\.\s+(.+)",
)
BULLET_PATTERNS = (r"^\-\s+(.+)", r"^\*\s+(.+)", r"^\•\s+(.+)", r"^●\s+(.+)", r"^○\s+(.+)")

# --- fixed values: words counted as wording features
MODAL_VERBS = ("must", "shall", "may", "can", "should", "will", "could", "would", "might", "ought")
NEGATIONS = (
    "not", "no", "never", "neither", "nor", "none", "nobody", "nothing", "nowhere", "can't", "won't", "don't",
    "didn't", "doesn't", "isn't", "aren't", "wasn't", "weren't", "hadn't", "hasn't", "haven't", "shouldn't", "wouldn't", "couldn't",
)
CONDITIONALS = (
    "if", "unless", "except", "provided", "provided that", "in the event", "should", "when", "where", "wherever",
    "whenever", "in case", "as long as", "so long as",
)
LEGAL_JARGON = (
    "thereof", "therein", "thereby", "whereof", "wherein", "whereby", "heretofore", "hereinafter",
    "hereby", "herein", "hereto", "hereof", "aforesaid", "forthwith", "notwithstanding",
    "pursuant to", "in accordance with", "subject to", "with respect to", "in respect of", "in relation to",
    "to the extent", "to the effect that", "insofar as", "inasmuch as", "viz", r"i\.e\.", r"e\.g\.",
    "indemnify", "indemnification", "liability", "liable", "waive", "waiver", "governing law",
    "jurisdiction", "arbitration", "force majeure", "terminate", "termination", "breach",
    "representation", "warranty", "warranties",
)
RISK_KEYWORDS = (
    "terminate", "suspend", "cancel", "delete", "remove", "liability", "liable", "indemnify",
    "waive", "forfeit", "no refund", "non-refundable", "change.*price", "increase.*fee", "auto.*renew",
    "automatically", "share.*data", "sell.*information", "third.*part", "monitor", "track", "collect",
    "discretion", "at any time", "without notice", "without.*cause", "for any reason", "as-is",
    "no warranty", "disclaim", "at.*risk",
)
# --- fixed values: plain-language check and vague wording
UNCLEAR = ("hereby", "whereas", "hereinafter", "aforesaid", "notwithstanding", "pursuant to", "in the event that", "provided that", "to the extent that")
VAGUE = ("may", "might", "could", "reasonable", "appropriate", "at our discretion", "from time to time", "as needed", "as necessary")
# --- fixed values: days since a change, the factor, and how it is called; the last tier has no end
DECAY_TIERS = (
    (0, 30, 3.0, "Recent change, heightened scrutiny"),
    (31, 60, 2.0, "Recent change, elevated scrutiny"),
    (61, 90, 1.5, "Recent change, increased scrutiny"),
    (91, None, 1.0, "Standard scrutiny"),
)
# --- fixed values: reasons of a score's adjustments by industry, prevalence, category and terms
INDUSTRY_REASONS = {
    "industry": "Industry: %s",
    "common": "Common practice in %s (found in %d%% of baseline) - reduced severity",
    "rare": "Unusual for %s (found in only %d%% of baseline) - increased severity",
    "strict": "%s is a high-priority concern for %s",
    "prohibited": "Contains terms alarming for %s: %s",
    "capped": "Score capped at maximum (10.0)",
}
# --- fixed values: reasons of a service's decisions; the category, then the service
SERVICE_REASONS = {
    "alarming": 'Category "%s" is alarming for %s services. This practice is concerning and should be flagged.',
    "expected_disclosed": 'Category "%s" is expected for %s services and has clear disclosure. This is a standard practice.',
    "expected_unclear": 'Category "%s" is expected for %s services but lacks clear disclosure. Should be more transparent.',
    "expected": 'Category "%s" is expected for %s services. This is a standard practice.',
    "neutral": 'Category "%s" is neither expected nor alarming for %s services. Keeping for manual review.',
}
SERVICE_UNKNOWN = 'Unknown service type "%s", keeping anomaly for manual review'
# --- fixed values: advice by the direction of a trend, and where alerts increase; on required terms that are missing
TREND_ADVICE = {
    "DEGRADING": (
        "Performance is degrading. Review recent changes to detection rules.",
        "Consider retraining confidence calibrator with recent feedback.",
        "Check for changes in document types or industries being analyzed.",
    ),
    "IMPROVING": ("Performance is improving. Continue current approach.", "Consider documenting successful practices for future reference."),
    "STABLE": ("Performance is stable. Continue monitoring.",),
}
INCREASE_ADVICE = "Alert volume is increasing. Review alert ranking thresholds."
MISSING_ADVICE = "Consider adding %s clause for %s compliance"
# --- fixed values: severities
SEVERITY_BASE = {"high": 8.0, "medium": 5.0, "low": 3.0}
SEVERITY_WEIGHT = {"low": 1.0, "medium": 2.0, "high": 3.0, "critical": 4.0}
COMPOUND_BASE = {"LOW": 2.0, "MEDIUM": 5.0, "HIGH": 7.0, "CRITICAL": 9.0}
COMPOUND_POINTS = {"CRITICAL": 4.0, "HIGH": 3.0, "MEDIUM": 1.5, "LOW": 0.5}
# --- fixed values: bonuses of an alert's score
BONUSES = {"compound": 5.0, "change": 2.0, "industry": 1.5, "regulatory": 3.0}
# --- fixed values: weights of the three detection methods
METHOD_WEIGHTS = (0.40, 0.35, 0.25)
# --- fixed values: labels of feedback
OUTSIDE_ACTIONS = {"helpful": "helpful", "dismiss": "dismissed", "not_applicable": "false_positive", "acted_on": "acted_on"}
FEEDBACK_ACTIONS = {"helpful": True, "acted_on": True, "dismissed": False, "false_positive": False}
# --- fixed values: tiers of a calibrated confidence, and how each is explained
TIER_LABELS = {"HIGH": "High Confidence", "MODERATE": "Moderate Confidence", "LOW": "Low Confidence"}
TIER_TEXTS = {
    "HIGH": "We are %d%% confident this is a genuine concern based on our analysis of 100+ similar documents.",
    "MODERATE": "This appears concerning (%d%% confidence), but review the specifics for your situation.",
    "LOW": "This might be an issue (%d%% confidence). Check if it applies to your use case.",
}
# --- fixed values: classifications of stored responses that are kept as findings
PROBLEMS = ("ANOMALY", "FLAGGED", "PROBLEMATIC", "UNUSUAL")
