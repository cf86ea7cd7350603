"""Fixed values of the data model: thresholds, price book, word lists. They must equal the published ones for right results."""

from __future__ import annotations

# Call log reports
REPORT_MONTHS = 12
REPORT_JOBS = 100
PAGE_SIZE = 25

# Budgets in USD
JOB_LIMIT, USER_LIMIT, SITE_LIMIT, ALERT_PERCENT = 5, 20, 200, 80

# Prices in USD per million tokens: model, input miss, input hit, output, the same off-peak
PRICES = (
    ("deepseek", "deepseek-flash", "0.30", "0.006", "1.20", "0.15", "0.003", "0.60"),
    ("deepseek", "deepseek-v4-pro", "1.32", "0.044", "3.96", "0.66", "0.022", "1.98"),
)
# ISO weekday, start hour, end hour (UTC, end not included)
PEAK_WINDOWS = tuple((day, start, end) for day in range(1, 6) for start, end in ((1, 4), (6, 10)))

# Size and cost forecast
CHARS_PER_TOKEN = 3.5
BYTES_PER_TOKEN = 5
KINDS = (
    ("pdf", 70),
    ("wordprocessingml", 90),
    (".docx", 90),
    ("presentationml", 90),
    (".pptx", 90),
    ("spreadsheetml", 3),
    (".xlsx", 3),
)
PROMPT_OVERHEAD = 1500
OUTPUT = {"digest": 3500, "brief": 800, "outline": 2500, "sections": 5000, "activities": 2400, "questions": 8500, "review": 3000}
NODE_INPUT = {"sections": 5000, "activities": 9000, "questions": 20000}
REVIEW_INPUT_FACTOR = 2.2
REPAIR_MARGIN = 1.05
DIGEST_WINDOW = 60000
DEFAULT_MINUTES, MINUTES_PER_SECTION, MIN_SECTIONS, MAX_SECTIONS = 240, 45, 3, 10
OUTPUT_LIMITS = {"digest": 8192, "brief": 4096, "outline": 16384, "sections": 32768, "activities": 16384, "questions": 32768, "review": 16384, "repair": 32768}
OUTPUT_LIMIT_DEFAULT, OUTPUT_LIMIT_MOST = 16384, 393216

# Text structure
MIN_PAGES, EDGE_LINES, RUNNING_SHARE = 3, 3, 0.25
MAX_HEADING, DUPLICATE_KEY = 90, 80
LANGUAGE_HITS, LANGUAGE_MARGIN = 8, 1.25
MIN_TOKENS, MAX_TOKENS, UNIT_LIMIT, OVERLAP = 1500, 3000, 1500, 0.10
TITLE = 255
DIGEST_LIMITS = {"concepts": 40, "definitions": 40, "objectives": 15, "procedures": 15}

# Words and signs of page numbers and headings. Fixed values of the data model
DASHES = ("-", "–", "—")
PAGE_WORDS = ("pagina", "page", "pag.", "pag", "p.")
PAGE_OF = ("din", "of", "/")
CHAPTER_WORDS = ("capitolul", "capitol", "partea", "chapter", "part")
SECTION_WORDS = ("secțiunea", "sectiunea", "section", "anexa", "annex", "appendix")
HEADING_ENDS = (".", "!", "?", ",", ";", ":")

# Frequent words of each language. Fixed values of the data model
STOP_WORDS = {
    "ro": [
        "și", "si", "în", "in", "de", "la", "cu", "pe", "care", "este", "sunt", "pentru", "din", "un", "că", "ca", "nu", "mai", "sau", "se", "au", "fi", "prin", "acest",
        "această", "acestei", "lor", "ale", "al", "cel", "cea", "unei", "unui", "fiecare", "foarte", "dar", "dacă", "când", "între", "către",
    ],
    "en": [
        "the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "be", "or", "from", "at", "an", "which", "have", "has", "not",
        "but", "they", "their", "can", "will", "all", "you", "we", "more", "when", "these", "also", "such", "between",
    ],
    "fr": [
        "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "sur", "au", "aux", "avec", "ce", "il", "elle", "sont", "par",
        "plus", "ou", "mais", "nous", "vous", "ont",
    ],
    "de": [
        "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "für", "auf", "nicht", "ein", "eine", "dem", "des", "sich", "im", "auch", "als", "bei", "oder", "wird",
        "werden", "sind", "an", "nach", "wie",
    ],
    "es": [
        "el", "la", "los", "las", "de", "en", "un", "una", "es", "que", "por", "con", "para", "del", "se", "su", "al", "lo", "como", "más", "pero", "sus", "son", "este", "esta",
        "entre", "también", "sin", "sobre",
    ],
    "it": [
        "il", "lo", "la", "gli", "le", "di", "in", "un", "una", "che", "per", "con", "non", "del", "della", "dei", "delle", "è", "sono", "si", "da", "come", "più", "anche", "nel",
        "alla", "questo", "tra",
    ],
    "hu": [
        "az", "és", "hogy", "nem", "is", "egy", "meg", "de", "van", "volt", "ez", "azt", "még", "már", "csak", "mint", "vagy", "el", "ki", "be", "fel", "le", "át", "köztük",
        "amely", "között", "szerint", "kell", "lehet",
    ],
}
