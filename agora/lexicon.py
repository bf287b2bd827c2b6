"""Word lists, label sets and defaults.

Everything here is a parameter of the operators that use it; callers may pass
their own lists. The values under "Fixed values" must equal the behaviour
being reproduced and are kept verbatim, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must match the reproduced behaviour; do not edit)
# ---------------------------------------------------------------------------

# Topic-scope keywords: AI/ML, industry, engineering (in that order).
AI_ML_KEYWORDS = [
    "ai", "artificial intelligence", "machine learning", "deep learning",
    "neural network", "large language model", "llm", "generative ai", "agi",
    "gpt", "transformer", "diffusion model", "fine-tuning", "rag", "embedding",
    "inference", "chatgpt", "gpt-4", "gpt-5", "claude", "gemini", "llama",
    "mistral", "copilot", "dall-e", "stable diffusion", "midjourney", "sora",
    "grok", "openai", "anthropic", "deepmind", "hugging face", "cohere",
    "inflection",
]
INDUSTRY_KEYWORDS = [
    "startup", "vc", "venture capital", "layoff", "acquisition", "ipo",
    "funding", "valuation", "y combinator", "ycombinator", "saas",
    "open source", "big tech", "microsoft", "google", "apple", "amazon",
    "meta", "nvidia", "tesla", "twitter", "x.com", "tiktok", "bytedance",
    "samsung", "intel", "amd", "privacy", "regulation", "antitrust",
    "copyright", "misinformation", "censorship", "surveillance",
    "data breach", "security vulnerability",
]
ENGINEERING_KEYWORDS = [
    "rust", "golang", "python", "javascript", "typescript", "kotlin", "swift",
    "c++", "java", "ruby", "react", "vue", "angular", "next.js", "svelte",
    "htmx", "django", "fastapi", "flask", "postgres", "postgresql", "mysql",
    "mongodb", "redis", "sqlite", "kafka", "kubernetes", "docker",
    "terraform", "aws", "gcp", "azure", "cloudflare", "vercel", "linux",
    "git", "github", "gitlab", "stack overflow", "devops", "microservices",
    "monolith", "serverless", "web assembly", "wasm",
]
DEFAULT_TOPIC_KEYWORDS = AI_ML_KEYWORDS + INDUSTRY_KEYWORDS + ENGINEERING_KEYWORDS

# Title prefixes that are always in scope.
ALWAYS_IN_SCOPE_PREFIXES = ["ask hn:", "show hn:"]

# Known entities for target extraction (compared lower-cased).
KNOWN_ENTITIES = [
    "ChatGPT", "GPT-4", "GPT-5", "Claude", "Gemini", "LLaMA", "Mistral",
    "Copilot", "Grok", "Sora", "OpenAI", "Anthropic", "DeepMind", "Nvidia",
    "HuggingFace", "Google", "Microsoft", "Apple", "Amazon", "Meta", "Tesla",
    "Twitter", "Intel", "AMD", "Rust", "Python", "JavaScript", "TypeScript",
    "Go", "Golang", "Kotlin", "Swift", "Java", "Ruby", "React", "Vue",
    "Angular", "Svelte", "Django", "FastAPI", "Flask", "Rails", "Kubernetes",
    "Docker", "AWS", "GCP", "Azure", "Cloudflare", "Vercel", "Linux",
    "GitHub", "GitLab", "PostgreSQL", "Postgres", "MySQL", "MongoDB", "Redis",
    "SQLite", "Kafka",
]

# Title words never taken as entities (compared lower-cased; "I" is kept as
# written, so it never matches a lower-cased token).
ENTITY_STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "is", "are", "was", "were", "be", "been", "has",
    "have", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "can", "it", "its", "this", "that", "these", "those",
    "my", "your", "our", "their", "how", "why", "what", "when", "where", "who",
    "which", "ask", "show", "tell", "hn", "new", "old", "just", "now", "not",
    "no", "yes", "after", "before", "more", "less", "than", "up", "out", "if",
    "so", "as", "we", "us", "you", "he", "she", "they", "his", "her", "I",
]

# Extra keyword stop-words applied on top of the English stop list.
KEYWORD_EXTRA_STOP = [
    "like", "just", "think", "know", "really", "also", "even", "make", "way",
    "lot", "things", "thing", "people", "would", "could", "something", "much",
    "many", "very", "good", "great", "get", "got", "going",
]

# Stance labels in hypothesis order, and the hypothesis templates.
STANCES = ["SUPPORT", "OPPOSE", "MIXED", "NEUTRAL"]
TARGETED_TEMPLATES = [
    "This comment supports {target}.",
    "This comment opposes {target}.",
    "This comment has a mixed opinion about {target}.",
    "This comment is unrelated to {target}.",
]
GENERIC_TEMPLATES = [
    "This comment supports the main subject.",
    "This comment opposes the main subject.",
    "This comment has a mixed opinion about the main subject.",
    "This comment is off-topic or neutral.",
]

SENTIMENTS = ["POSITIVE", "NEUTRAL", "NEGATIVE"]
# Raw sentiment label -> canonical label; anything else is NEUTRAL.
SENTIMENT_LABEL_MAP = {
    "POSITIVE": "POSITIVE",
    "NEGATIVE": "NEGATIVE",
    "LABEL_0": "NEGATIVE",
    "LABEL_1": "POSITIVE",
}
SENTIMENT_THRESHOLD = 0.85
# Raw toxicity labels whose score is already the toxic probability.
TOXIC_LABELS = ["TOXIC", "LABEL_1"]
# Toxicity tiers: low < 0.3 <= medium < 0.7 <= high.
TOXICITY_TIERS = [(0.7, "high"), (0.3, "medium")]

# Defaults of the tunable knobs.
MIN_COMMENTS_THRESHOLD = 50
MAX_DEPTH = 3
MAX_COMMENTS_PER_TOPIC = 25000
MAX_COMMENTS_PER_POST = 1000
MAX_COMMENTS_PER_FETCH = 2000
CANDIDATES_PER_TYPE = 100
STORY_TYPES = ["top", "ask", "show"]
N_CLUSTERS_PER_STANCE = 10
MIN_CLUSTER_SIZE = 8
MIN_QUOTE_LENGTH = 40
TOP_QUOTES = 3
QUOTE_CANDIDATES = 10
DEDUP_PREFIX_LEN = 100
MIN_CLASSIFIED_COMMENTS = 10
N_KEYWORDS = 8
TFIDF_MAX_FEATURES = 500
EMBEDDING_DIM = 384
TITLE_MAX = 255
TITLE_COLLISION_PREFIX = 240
PERMALINK_BASE = "https://news.ycombinator.com/item?id="
PLATFORM = "hackernews"

# ---------------------------------------------------------------------------
# Stand-in scorer lexicons (ours). They replace pretrained models, which are
# not shipped; they are not claimed to match those models' accuracy.
# ---------------------------------------------------------------------------

TOXIC_WEIGHTS = {
    "idiot": 0.9, "moron": 0.9, "scum": 0.9, "trash": 0.8, "worthless": 0.8,
    "disgusting": 0.8, "pathetic": 0.7, "loser": 0.7, "stupid": 0.7,
    "clown": 0.6,
}
POSITIVE_WORDS = [
    "good", "great", "excellent", "love", "like", "best", "useful", "helpful",
    "agree", "nice", "awesome", "better", "thanks", "fair", "right",
]
NEGATIVE_WORDS = [
    "bad", "worse", "worst", "hate", "wrong", "awful", "terrible", "useless",
    "disagree", "broken", "poor", "fail", "idiot", "moron", "scum", "trash",
    "worthless", "disgusting", "pathetic", "loser", "stupid", "clown",
]

# Seeds of the learned sentiment lexicon (ours).
POSITIVE_SEEDS = ["good", "great", "excellent", "love", "best"]
NEGATIVE_SEEDS = ["bad", "awful", "terrible", "idiot", "scum"]


# Spark ML's English stop words, the default list of the keyword operators (a
# parameter; a scikit-learn user's list differs). Fixed values.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split())


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH_STOP_WORDS
