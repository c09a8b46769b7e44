"""Rows that operators must bear."""

#: Extra columns have names that operators use for their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, id long, key string, rep long, terms string, a int"
REST = (None, None, None, None, None, None, None)
LONG = "word " * 60_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big house today", "en", "web"), (2, "The  quick brown\tfox jumps over the lazy dog and runs away from the big house today", "en", "web"),
    (3, "the quick brown fox jumps over the lazy dog and runs away from the big house today.", "en", None), (4, None, "de", "books"), (5, "", None, "books"), (6, "   ", "en", None), (7, "x", "fr", "web"), (7, "x", "fr", "web"),
    (8, LONG, "en", "web"), (9, LONG + "end", "en", "zine"), (10, "12 34 !! ..", None, "zine"), (11, "Ünïcödé 日本語 🙂 text", "de", "zine"), (12, "x", "fr", None), (13, "\n", None, "web"),
]
