"""Fixed word lists and patterns.

FIXED VALUES: these must equal the workflow being reproduced for results to
match; they are kept here, plainly, in their natural order.
"""

# FIXED VALUES -- work-order note header (a line that starts with an ISO date
# in parentheses and a word, or with two words and a d/m/Y H:M:S stamp in
# parentheses), applied per line.
NOTE_HEADER_PATTERN = (
    r"^(?:\(\d{4}-\d{2}-\d{2}\)\s+\w+"
    r"|\w+\s+\w+\s+\(\d{1,2}/\d{1,2}/\d{4}\s+\d{2}:\d{2}:\d{2}\))\s*"
)

# FIXED VALUES -- a note is usable when it carries a d/m/Y date.
NOTE_DATE_PATTERN = r"\d{1,2}/\d{1,2}/\d{4}"

# FIXED VALUES -- stock-number prefixes stripped from brand/model text, first
# case-insensitive match wins, in this order.
BRAND_PREFIXES = ["EBK", "BK", "ES", "EB", "Ebk", "Es", "bk", "es",
                  "EBK-", "BK-", "ES-", "EB-"]

# FIXED VALUES -- descriptors removed from brand/model text as whole words,
# case-insensitive.
BRAND_DESCRIPTORS = [
    "black", "white", "grey", "gray", "green", "red", "blue", "yellow",
    "orange", "purple", "pink", "silver", "gold", "maroon", "brown",
    "teal", "cyan", "cream", "beige", "navy", "bronze", "lime", "magenta",
    "turquoise", "tan", "dark", "light", "with", "and", "edition", "editoin",
    "pro", "plus", "v2", "v3", "v4", "v5", "series", "model", "trim",
    "kit", "upgrade", "copy", "folder", "step", "through", "w/", "without",
    "non-motor", "multi", "unknown", "split", "fold", "flip", "new",
]

# Brand names that are ordinary words: matched in leading position only.
COMMON_WORD_BRANDS = ["time", "look", "solar"]

# FIXED VALUES -- heading line of a brand-dictionary section:
# "Known <section> brands:".
BRAND_SECTION_HEADING = r"^Known (.+) brands:$"

# FIXED VALUES -- English stop words of the NLTK corpus (179 words), the list
# the text preprocessing removes.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]

# FIXED VALUES -- contractions the word tokenizer splits (public Treebank
# rules), restricted to forms that survive the letters-only filter:
# (first part, second part).
TOKEN_CONTRACTIONS = [
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
    ("lem", "me"), ("wan", "na"),
]

# Noun plural rules (suffix, replacement), tried longest suffix first. WordNet's
# lexicon is not available, so every rule applies without a dictionary check
# (declared deviation); words the rules would damage stand in NOUN_LEMMAS.
NOUN_SUFFIX_RULES = [
    ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ies", "y"), ("s", ""),
]
# FIXED VALUES -- WordNet's noun detachment rules (suffix, ending), for lemmas that a lexicon confirms.
MORPHY_NOUN_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
# Words ending in these are left alone by the bare "s" rule.
NOUN_KEEP_ENDINGS = ["ss", "us", "is"]
# Irregular nouns (word: lemma), looked up before the rules; a default that callers can replace.
NOUN_LEMMAS = {
    "axes": "axis", "buses": "bus", "calves": "calf", "children": "child", "elves": "elf", "feet": "foot",
    "gas": "gas", "gases": "gas", "geese": "goose", "halves": "half", "knives": "knife", "leaves": "leaf",
    "lens": "lens", "lenses": "lens", "lives": "life", "loaves": "loaf", "men": "man", "mice": "mouse",
    "movies": "movie", "series": "series", "shelves": "shelf", "species": "species", "statuses": "status",
    "teeth": "tooth", "thieves": "thief", "ties": "tie", "wives": "wife", "wolves": "wolf", "women": "woman",
}

# Token pattern of the TF-IDF vectoriser: two or more word characters.
TFIDF_TOKEN_PATTERN = r"(?U)\b\w\w+\b"
