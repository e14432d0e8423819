"""Presentation helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 72


def snippet_column(body: Column) -> Column:
    """The first 72 characters on one line, with three dots from a length of 72 on."""
    flat = F.translate(body, "\n\t", "  ")
    return F.when(F.length(flat) >= SNIPPET, F.concat(F.substring(flat, 1, SNIPPET), F.lit("..."))).otherwise(flat)


def snippet(body: str) -> str:
    flat = body.replace("\n", " ").replace("\t", " ").encode()
    return flat[:SNIPPET].decode(errors="ignore") + "..." if len(flat) >= SNIPPET else flat.decode()
