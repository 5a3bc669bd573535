"""Fixed values that results depend on: word lists, patterns, weights and thresholds, stated as they are."""

from __future__ import annotations

# --- fixed values: term extraction for BM25
TERM_PATTERN = r"[a-z0-9]+(?:'[a-z]+)?|[\x{0C00}-\x{0C7F}]+|[\x{0900}-\x{097F}]+"
TERM_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "so", "of", "in", "on", "at", "to", "for", "from", "by", "with", "about", "as", "is",
    "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "will", "would", "shall", "should", "can", "could", "may",
    "might", "must", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "them", "their", "this", "that", "these", "those",
    "there", "here", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "s", "t", "am", "im", "ive", "dont", "please", "tell",
    "know", "want",
)
TERM_SUFFIXES = ("ies", "ing", "ed", "es", "s")

# --- fixed values: extractive answers
ANSWER_STOP_WORDS = (
    "what", "who", "when", "where", "why", "how", "is", "are", "was", "were", "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for",
    "from", "by", "with", "about", "do", "does", "did", "can", "could", "would", "will", "tell", "me", "my", "i", "am", "his", "her", "their", "they",
    "he", "she", "please", "much", "many", "any", "have", "has", "had", "be", "been",
)

# --- fixed values: BM25, fusion and selection
K1, B = 1.5, 0.75
RRF_K = 60
DENSE_WEIGHT, SPARSE_WEIGHT, VARIANT_WEIGHT = 1.0, 0.7, 0.5
BRANCH_TOP_K, TOP_K, CANDIDATE_CAP, CASCADE_KEEP = 30, 5, 16, 4
SIMILARITY_THRESHOLD, RERANK_THRESHOLD, ABANDON_MARGIN = 0.30, -2.0, 6.0
CATEGORY_BOOST, TOPIC_BOOST, PLACE_BOOST = 0.15, 0.10, 0.12
PERSON_MATCH, PERSON_MARGIN, RECORD_PENALTY = 0.6, 0.15, 0.75
CONTEXT_BUDGET = 6000
DEDUPE_PREFIX = 160

# --- fixed values: chunking
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK, PARENT_WINDOW, MAX_RECORD, MIN_LABEL_REPEATS = 700, 120, 80, 1800, 4000, 3

# --- fixed values: caches, sessions, streams
CACHE_THRESHOLD, CACHE_REPLACE, CACHE_SIZE, CACHE_TTL_S, ANSWER_THRESHOLD = 0.97, 0.995, 512, 900, 0.985
SESSION_TTL_S, MEMORY_TURNS, METRIC_WINDOW = 3600, 8, 512
PARTIAL_MIN_CHARS, PARTIAL_MIN_TOKENS, DEBOUNCE_MS, REUSE_THRESHOLD, RING = 12, 3, 180, 0.94, 3

# --- fixed values: names
HONORIFICS = ("dr", "sri", "shri", "smt", "mr", "mrs", "ms", "prof", "kum")

# --- fixed values: text cleaning, in the order applied
REPLACEMENTS = (
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"),
    ("–", "-"), ("—", "-"), ("\u00a0", " "), ("\u200b", ""),
)

# --- fixed values: mouth shapes of viseme numbers 0 to 21, and of letters
VISEME_SHAPES = "XDDECCBFEEEDCFCHHHGCBA"
LETTER_SHAPES = {"pbm": "A", "ijky": "B", "eltdnh": "C", "a": "D", "o": "E", "uwr": "F", "fv": "G", "szc": "H"}
REST_SHAPE = "X"
MIN_CUE_MS = 30
