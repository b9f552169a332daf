"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, html_text, language_id, language_model, line_dedup, near_dedup, passage_dedup, periodic_runs, quality, sharding, token_counts, token_links

MODULES = (language_id, html_text, token_counts, sharding, quality, decontaminate, line_dedup, near_dedup, passage_dedup, byte_bpe, language_model, token_links, periodic_runs)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
