"""Column-level scalar expressions (all Catalyst built-ins)."""

from shoplane.functions.coerce import (  # noqa: F401
    blank_to_empty_struct, empty_struct, money_to_double, parse_json_struct,
    to_dollars, to_float32, to_number, to_quantity, to_text, to_ts,
)
from shoplane.functions.dates import (  # noqa: F401
    calendar_features, clip_lower, day_of_week, is_weekend, iso_week, month,
    quarter, repair_duration, whole_days_between, year,
)
from shoplane.functions.text import (  # noqa: F401
    collapse_ws, has_note_date, join_tokens, lemmatize_nouns, letters_only,
    normalize_separators, preprocess_text, remove_descriptors,
    remove_stop_words, split_contractions, strip_note_header, strip_prefix,
    strip_ws, tokenize,
)
