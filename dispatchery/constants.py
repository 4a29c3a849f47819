"""Fixed values. Results depend on these being exactly what they are."""

from __future__ import annotations

# Query parameters that decorate a link without changing the page.
TRACKING_PREFIXES = ("utm_", "ga_", "hsa_", "mc_", "pk_", "vero_", "_hs")
TRACKING_KEYS = (
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "igshid", "mkt_tok",
    "ref", "referrer", "source", "cmpid", "ncid", "at_medium", "at_campaign", "spm", "share_id",
    "guccounter", "guce_referrer", "guce_referrer_sig",
)
# Host labels that serve the same page as the bare host.
MIRROR_LABELS = ("www", "m", "amp", "mobile")
# Hosts that may never be polled.
BLOCKED_HOSTS = ("hnrss.org", "news.ycombinator.com", "reddit.com")

# Section prefixes of a headline.
TITLE_PREFIXES = ("show hn", "ask hn", "tell hn", "launch hn", "video", "watch", "opinion")
# Words that reverse a headline.
NEGATIONS = (
    "no", "not", "never", "without", "deny", "denies", "denied", "reject", "rejects", "rejected",
    "pull", "pulls", "pulled", "halt", "halts", "halted", "cancel", "cancels", "cancelled",
    "canceled", "abandon", "abandons", "abandoned", "delay", "delays", "delayed",
)
MIN_TITLE_TOKENS = 4
MATCH_THRESHOLD = 85
MATCH_CANDIDATES = 5
LOOKBACK_HOURS = 72

MIN_BODY_CHARS = 400
TEASER_CHARS = 800
# Bounds a caller may pass where a model's window is short; nothing is cut without one.
MAX_BODY_CHARS = 6000
PROMPT_BODY_CHARS = 5000
PROMPT_EXTRA_CHARS = 2000
WEB_CONTEXT_MARKER = "--- WEB CONTEXT: NOT THE ARTICLE ---"
NO_BODY = "(no body text available - work from the title alone)"
# How a cut-off text ends.
TEASER_ENDINGS = ("…", "...", "[…]", "[...]", "(...)", "[Read more]")
SEARCH_MIN_WEIGHT = 1.0

KINDS = ("news", "release", "research", "opinion", "roundup", "other")
TIERS = ("lead", "major", "notable", "brief")
TIER_STEPS = {"lead": 5, "major": 4, "notable": 3, "brief": 2}
REASONS = ("wrong_fact", "not_news", "duplicate", "wrong_place")
RANK_PASSES = 3
QUORUM = 2
TOP_N = 15
PREVIOUS_HEADLINES = 8

MAX_AGE_DAYS = 7
MAX_FAILURES = 5
SEARCH_DAILY_CAP = 30
SUGGEST_AFTER_HOURS = 24
COST_CEILING = 1.0
ZONE = "Europe/Istanbul"

# Words each prose field may use.
WORD_BUDGETS = {"summary": 55, "why_it_matters": 20, "title_local": 10}
# Scale words of a figure, in two languages.
SCALES = {
    "bin": 1_000, "thousand": 1_000, "k": 1_000,
    "milyon": 1_000_000, "million": 1_000_000, "m": 1_000_000, "mn": 1_000_000,
    "milyar": 1_000_000_000, "billion": 1_000_000_000, "b": 1_000_000_000, "bn": 1_000_000_000,
    "trilyon": 1_000_000_000_000, "trillion": 1_000_000_000_000,
}
# Words too common to tie a fact to a summary.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "for", "to", "in", "on", "at", "by", "with", "from",
    "is", "are", "was", "were", "be", "been", "new", "model", "models", "ai", "research",
    "company", "release", "version", "ve", "veya", "ile", "bir", "bu", "da", "de", "icin",
    "için", "yeni", "modeli", "yapay", "zeka", "zekâ",
)
# The tags a summary should prefer.
TAG_VOCABULARY = (
    "openai", "anthropic", "google", "meta", "microsoft", "nvidia", "hugging-face", "models",
    "agents", "open-source", "funding", "policy", "research", "safety", "hardware",
    "infrastructure", "tooling", "coding", "robotics", "benchmarks", "enterprise", "apps", "data",
    "multimodal", "security",
)
MAX_CAPITALISED = 80
TOP_TAGS = 10

# USD per million tokens, (in, out), by model-name prefix.
PRICES = {
    "gpt-6-luna": (0.10, 0.50),
    "gpt-5.6-luna": (0.20, 1.20),
    "gpt-5.6-terra": (2.00, 12.00),
    "gpt-5.6-sol": (4.00, 20.00),
    "gpt-6-astra": (10.00, 50.00),
}
DEAREST_PRICE = (10.00, 50.00)
DEFAULT_MODEL = "gpt-6-luna"
# Mean tokens (in, out) per unit of work.
SUMMARY_TOKENS = (1438, 513)
RANK_TOKENS = (172, 105)
TRANSLATION_TOKENS = (900, 900)
EDITORIAL_TOKENS = (1800, 1000)
CHARS_PER_TOKEN = 4
JUDGE_OUTPUT_TOKENS = 80
COMPARE_OUTPUT_TOKENS = 220
UNATTRIBUTED = "body provenance unknown; this pass is not evidence of grounding"

# The multiplicative scatter behind every seeded sample.
HASH_BASE = 2654435761
HASH_SEED_STEP = 104729
HASH_MODULUS = 1000003
