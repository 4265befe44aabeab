"""Fixed values.

Everything in this module is a value that results depend on: word lists,
patterns, limits, weights and targets.  They are stated as plain text, in
their natural order.  Code elsewhere takes them as defaults, so each can be
replaced by the caller.
"""

# --- curation targets and limits -------------------------------------------
TARGET_ROWS = 317_498
TARGET_ARTICLE_WORDS = 334.21
TARGET_SUMMARY_WORDS = 95.45
TARGET_COMPRESSION = 3.50
TOLERANCE_ARTICLE_WORDS = 10.0
TOLERANCE_SUMMARY_WORDS = 5.0
TOLERANCE_COMPRESSION = 0.2
MIN_SUMMARY_WORDS = 50
MAX_SUMMARY_WORDS = 250
MIN_ARTICLE_WORDS = 100
MIN_HEADLINE_CHARS = 10

RENAMES = {
    "article_text": "article",
    "human_summary": "summary",
    "news_category": "category",
    "published_date": "date",
}
REQUIRED_COLUMNS = ("article", "summary", "headline")

TRAIN_FRACTION = 0.90
VALIDATION_FRACTION = 0.05
SMALL_SPLIT_ROWS = {"train": 1000, "val": 200, "test": 200}
SAMPLE_SEED = 42
TRAIN_SAMPLE_ROWS = 10_000
VALIDATION_SAMPLE_ROWS = 1_000
TEST_ROWS = 200

# --- evaluation ------------------------------------------------------------
MODELS = {
    "BART-Large-CNN": "facebook/bart-large-cnn",
    "BART-Base": "facebook/bart-base",
    "PEGASUS-XSum": "google/pegasus-xsum",
    "PEGASUS-CNN": "google/pegasus-cnn_dailymail",
    "T5-Base": "t5-base",
    "T5-Large": "t5-large",
    "LED-ArXiv": "allenai/led-large-16384-arxiv",
    "LongT5-Base": "google/long-t5-tglobal-base",
    "DistilBART": "sshleifer/distilbart-cnn-12-6",
    "mT5-Base": "google/mt5-base",
}
PROMPT_PREFIX = "summarize: "
PROMPT_FAMILY = "t5"
LONG_CONTEXT_FAMILY = "led"
LONG_CONTEXT_TOKENS = 16_384
SHORT_CONTEXT_TOKENS = 1_024
ATTENTION_WINDOW = 512
MIN_SUMMARY_LENGTH = 40
MAX_SUMMARY_LENGTH = 150
PREVIEW_CHARS = 200
PREVIEW_SUFFIX = "..."
MAX_DOCUMENTS_PER_EVENT = 5
DOCUMENT_SEPARATOR = "\n\n[DOCUMENT]\n\n"

# --- example preparation ---------------------------------------------------
ARTICLE_CHARS = 3000
ARTICLE_TOKENS = 1024
SUMMARY_TOKENS = 128
STAGED_SUMMARY_TOKENS = 256
IGNORED_LABEL = -100

# --- factuality ------------------------------------------------------------
FACTUALITY_WEIGHTS = {"entity": 0.40, "temporal": 0.30, "semantic": 0.30}
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "DATE")
SEMANTIC_THRESHOLD = 0.5
SEMANTIC_SOURCE_CHARS = 2000
SEMANTIC_SUMMARY_CHARS = 1000

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

VOCABULARY = {
    "numbers": ["crore", "lakh", "thousand", "lakhs", "crores"],
    "titles": ["PM", "CM", "IAS", "IPS", "IFS", "Lok Sabha", "Rajya Sabha",
               "Chief Minister", "Prime Minister", "MLA", "MP", "Minister"],
    "political": ["BJP", "Congress", "AAP", "NDA", "UPA", "CPI", "TMC",
                  "DMK", "AIADMK", "Shiv Sena", "JDU", "RJD"],
    "admin": ["Panchayat", "Municipality", "District Collector",
              "Tehsildar", "Gram Sabha", "Zila Parishad"],
    "cultural": ["dharma", "karma", "puja", "darshan", "prasad",
                 "Diwali", "Holi", "Eid", "Ganesh Chaturthi", "Navratri"],
    "institutions": ["ISRO", "DRDO", "AIIMS", "IIT", "IIM", "RBI",
                     "SEBI", "CBI", "ED", "IT Department", "CAG"],
}

# --- staged loss -----------------------------------------------------------
STAGE_WEIGHTS = {
    "warmup": {"ce": 1.0, "entity": 0.0, "temporal": 0.0, "semantic": 0.0},
    "factuality": {"ce": 0.5, "entity": 0.3, "temporal": 0.2, "semantic": 0.0},
    "refinement": {"ce": 0.4, "entity": 0.2, "temporal": 0.2, "semantic": 0.2},
}
LOSS_COMPONENTS = ("ce", "entity", "temporal", "semantic", "total")
LOSS_EVERY = 10
WARMUP_STAGE = "warmup"
