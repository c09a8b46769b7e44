"""Operations on training data: dedup, language, personal data, tokens, neighbours, pages, mixing."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries; each has QUERIES and ORACLE.
MODULES = ("exact_dedup", "langid", "pii", "near_dedup", "token_files", "ann", "html_text", "warc", "byte_bpe", "mixing", "chat_format", "turn_trie", "word_runs")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__name__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
