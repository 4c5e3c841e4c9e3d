"""Word lists and patterns of the text operators."""

# Text that the cleaner replaces, in order.
MISSPELLINGS = (
    ("teh", "the"),
    ("recieve", "receive"),
    ("alot", "a lot"),
    ("dont", "don't"),
    ("didnt", "didn't"),
    ("wasnt", "wasn't"),
    ("isnt", "isn't"),
    ("wont", "won't"),
)

# Characters that the special-character filter keeps.
KEPT_SPECIAL = ".,!?-:;'\""

# Patterns of the cleaners.
HTML_TAG = r"<[^>]*>"
URL = r"https?://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"

# Patterns of the entities that are counted.
ENTITIES = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)",
    "phone": r"\+?[\d\s\-()]{10,}",
    "date": r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    "time": r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp][Mm])?",
    "number": r"-?\d+(?:\.\d+)?",
    "currency": r"[$€£¥]\s*\d+(?:\.\d{2})?",
    "percentage": r"\d+(?:\.\d+)?%",
}

# The sentiment lexicon, negations and intensifiers.
SENTIMENT = {
    "good": 1.0,
    "great": 1.5,
    "excellent": 2.0,
    "amazing": 2.0,
    "bad": -1.0,
    "terrible": -2.0,
    "awful": -2.0,
    "poor": -1.0,
    "happy": 1.0,
    "sad": -1.0,
    "angry": -1.5,
    "love": 2.0,
    "hate": -2.0,
}
NEGATIONS = (
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nowhere",
    "hardly", "scarcely", "barely", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shouldn't", "can't", "cannot", "couldn't",
)
INTENSIFIERS = {"very": 1.5, "extremely": 2.0, "really": 1.5, "quite": 1.2, "somewhat": 0.8, "slightly": 0.5}

# The stop words of the text statistics.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "shall", "should", "can", "could", "may", "might",
    "must", "to", "of", "in", "on", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "from", "up", "down", "out", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "just", "don", "now",
    "的", "了", "和", "是", "在", "我", "有", "这", "个", "们",
    "中", "也", "就", "来", "到", "你", "说", "为", "着", "如",
    "那", "要", "自", "以", "会", "对", "可", "她", "里", "所",
    "他", "而", "么", "去", "之", "于", "把", "等", "被", "一",
    "没", "什", "麼", "这个", "那个", "只是", "因为", "所以", "但是", "如果",
)

# Irregular forms of the lemma dictionary.
LEMMAS = {
    "running": "run",
    "went": "go",
    "going": "go",
    "goes": "go",
    "better": "good",
    "best": "good",
    "worse": "bad",
    "worst": "bad",
    "am": "be",
    "are": "be",
    "is": "be",
    "was": "be",
    "were": "be",
}

# Parts of words that mark a language.
LANGUAGE_PARTS = {
    "en": ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being"),
    "zh": ("的", "了", "在", "是", "我", "有", "和", "他", "她", "你", "们", "这", "那", "个", "不", "也", "就", "说", "到", "去", "来"),
    "ja": ("の", "に", "は", "を", "が", "で", "と", "から", "まで", "より", "です", "ます", "た", "て", "いる", "ある", "する", "なる"),
    "ko": ("의", "에", "가", "을", "를", "은", "는", "이", "그", "저", "하다", "있다", "없다", "되다", "보다"),
    "ar": ("في", "من", "إلى", "على", "أن", "هذا", "التي", "كان", "ليس", "عند", "مع", "أو", "و", "ف", "ثم", "إذا", "حيث", "كيف", "متى", "لماذا"),
    "ru": ("в", "на", "с", "по", "для", "от", "до", "из", "к", "у", "быть", "иметь", "делать", "говорить", "знать"),
}
