"""Registry of parsers: functions from files (path, bytes) to raw nodes (document_id, seq, heading, level, content, start_page, end_page)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Parser = Callable[[DataFrame], DataFrame]
RAW_NODES = "document_id bigint, seq int, heading string, level int, content string, start_page int, end_page int"
_REGISTRY: dict[str, Parser] = {}


def register(name: str, parser: Parser) -> None:
    _REGISTRY[name.lower()] = parser


def get(name: str) -> Parser:
    """A registered parser, or one named 'package.module:object'; KeyError otherwise."""
    if name.lower() in _REGISTRY:
        return _REGISTRY[name.lower()]
    if ":" in name:
        module, _, attribute = name.partition(":")
        found = getattr(importlib.import_module(module), attribute)
        return found() if isinstance(found, type) else found
    raise KeyError(name)


def chain(name: str) -> list[str]:
    """Parsers to try in turn. A name that cannot be found leaves the layout parser."""
    known = {"layout": ["layout"], "pymupdf": ["layout"], "chandra": ["layout"], "auto": ["items", "layout"], "docling": ["items", "layout"]}
    if name.lower() in known:
        return known[name.lower()]
    try:
        get(name)
    except Exception:
        return ["layout"]
    return [name, "layout"]


def first_that_finds(files: DataFrame, parsers: list[Parser]) -> DataFrame:
    """For each file the nodes of the first parser that finds any; later parsers see only files that are still without."""
    out, left = None, files.withColumn("document_id", F.xxhash64("path"))
    for parser in parsers:
        nodes = parser(left)
        out = nodes if out is None else out.unionByName(nodes)
        left = left.join(nodes.select("document_id").distinct(), "document_id", "left_anti")
    return out
