"""Thresholds, weights, limits and word lists that results depend on."""

# Retrieval
KNN_K = 20
FEEDBACK_KNN_K = 10
MIN_COCHANGE_COMMITS = 3
MIN_COCHANGE_CORRELATION = 0.1
MIN_COCHANGE_READ = 0.2
MAX_FILES_PER_COMMIT = 50
WEIGHTS = {"structural": 1.0, "semantic": 0.7, "code_semantic": 0.4, "keyword": 0.3}
DIRECT_IMPORT, REVERSE_IMPORT, SYMBOL_REFERENCE = 1.0, 0.8, 0.6
MAX_KEYWORD_TERMS = 3

# Feedback
FEEDBACK_MIN_SIGNALS = 20
MAX_SIMILAR_DISTANCE = 0.3
DISMISSED_TO_DROP, ACCEPTED_TO_BOOST, ACCEPTED_BOOST = 3, 3, 0.1

# Sizes
CHUNK_LINES, CHUNK_OVERLAP = 50, 10
MAX_FILE_BYTES, MAX_CHANGED_FILE_BYTES, TEXT_SAMPLE_BYTES = 1_000_000, 50_000, 512
BYTES_PER_TOKEN, SUMMARY_BYTES_PER_TOKEN = 3, 4
MAX_TOKENS, RESERVE_TOKENS, MAX_FILES = 128_000, 32_000, 50
SUMMARY_BATCH = 5
SUMMARY_OUTPUT_TOKENS = 1024

# What stands for a text that is not shown; their lengths count against the budget
EXCLUDED_TEXT = "[File content excluded — large or generated file. See diff for changes.]"
DIFF_ONLY_TEXT = "[See diff for changes to this file.]"
SUMMARY_PREFIX = "[Summary — full content omitted.]\n"
DIFF_NOTICE = "\n[Diff truncated after provider pressure to fit a reduced review budget.]\n"

# Smaller prompts after provider pressure
PROMPT_TARGETS, MIN_OUTPUT_TOKENS, DIFF_MARGIN = (64_000, 48_000, 32_000, 16_000, 8_000, 4_000), 1_024, 256

# Findings
MIN_CONFIDENCE = 0.7
MISSING_FILE_PENALTY, MISSING_EVIDENCE_PENALTY = 0.2, 0.3
SARIF_ERROR, SARIF_WARNING = 0.9, 0.7
FINGERPRINT_LENGTH = 16
CATEGORIES = ("logic", "security", "convention", "performance", "style", "other")
FINDING_KEYS = ("findings", "issues", "results")

# Evaluation
MIN_PRECISION, MIN_RECALL, MAX_NOISE = 0.70, 0.50, 0.20
LINE_TOLERANCE = 5
PRECISION_DROP, RECALL_DROP, NOISE_RISE = 0.05, 0.10, 0.05
HISTORY_WINDOW = 5
TREND_DECLINE, TREND_GAIN, TREND_NOISE = -0.10, 0.05, 0.10
PATTERN_MIN_RUNS, PATTERN_RATIO, PATTERN_NAMES = 3, 0.6, 3
CATEGORY_ALIASES = (
    ("security", "logic"),
    ("performance", "logic"),
    ("performance", "security"),
    ("convention", "style"),
    ("other", "logic"),
    ("other", "security"),
    ("other", "performance"),
)

# Provider pressure while summaries are made
PRESSURE_TOTAL, PRESSURE_SECONDS, PRESSURE_RATIO, PRESSURE_CONSECUTIVE = 10, 600, 0.5, 2

NON_REVIEWABLE_NAMES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock", "go.sum", "flake.lock")
NON_REVIEWABLE_SUFFIXES = (".lock", ".min.js", ".min.css", ".bundle.js")

DISMISSAL_PHRASES = (
    "no bug", "no issue", "not a bug", "not an issue", "no real issue", "no real problem", "no real ", "not a real ",
    "not a critical", "acceptable behavior", "acceptable for", "this is fine", "this seems correct", "i will look for",
    "i will remove", "i will lower", "no bug here", "no critical bug", "not a strong", "minor robustness",
    "just a dependency", "just relying on", "impact: none", "impact:none",
)
MINIMAL_SECURITY, MINIMAL, MINIMAL_QUALIFIER = "minimal security impact", "minimal impact", "minimal impact on"

REASONING_PHRASES = (
    "let me think", "let's look", "let me analyze", "i need to", "i should", "i will look for",
    "i will remove this finding", "i will lower the confidence", "the code slices", "the real issue is not",
    "let's look closer", "looking at the code, i", "examining this, i", "the most concrete issue i can",
    "the most significant issue i can", "i will now", "let me check", "first, let me", "step 1:", "step 2:",
)

NO_CLAIM_PHRASES = (
    "no issue", "no issues", "no bug", "no bugs", "no finding", "no findings", "no problem", "no problems",
    "no concern", "no concerns", "no reportable", "without issue", "without issues", "nothing actionable",
    "looks clean", "change looks clean", "clean change",
)
CLAIM_PHRASES = (
    "issue found", "issues found", "found issue", "found an issue", "found a bug", "bug found",
    "security concern found", "security concerns found", "security concern identified",
    "security concerns identified", "security concern detected", "security concerns detected",
    "security concern flagged", "security concerns flagged", "concern found", "concerns found", "found concern",
    "found concerns", "vulnerability found", "vulnerabilities found", "found vulnerability",
    "found vulnerabilities", "regression found", "regressions found", "found regression", "found regressions",
    "risk found", "risks found", "found risk", "found risks", "problem found", "problems found", "found problem",
    "found problems", "concerns identified", "issues identified", "bugs identified",
    "vulnerabilities identified", "regressions identified", "risks identified", "problems identified",
    "identified concerns", "identified issues", "identified bugs", "identified vulnerabilities",
    "identified regressions", "identified risks", "identified problems", "detected concern",
    "detected concerns", "detected issue", "detected issues", "detected bug", "detected bugs",
    "detected vulnerability", "detected vulnerabilities", "flagged concern", "flagged concerns", "flagged issue",
    "flagged issues", "flagged bug", "flagged bugs", "flagged vulnerability", "flagged vulnerabilities",
)

#: Words of an evidence text that are never taken for code.
COMMON_WORDS = (
    "the", "for", "and", "not", "but", "has", "can", "will", "may", "its", "are", "all", "was", "this", "that", "with",
    "from", "when", "then", "than", "also", "into", "does", "only", "The", "This", "That", "These", "Those", "When",
    "Then", "Each", "Every", "Both", "Either", "Neither", "Such",
)
#: Characters besides white space that divide an evidence text into words.
WORD_DIVIDERS = ",.;:()[]{}=<>!&|\"'"

PRESSURE_STATUSES = (408, 502, 503, 504)
PRESSURE_PHRASES = (
    "upstream request timeout", "gateway timeout", "request timeout", "request timed out", "operation timed out",
    "provider capacity", "server overloaded",
)
#: What the message of a failed model download holds if the source limits the rate.
RATE_LIMIT_PHRASES = ("status code 429", "429 too many requests", "too many requests")
