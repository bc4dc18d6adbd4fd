"""Tag-list expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the studied project (exact strings, matched as-is; they use underscores
# while tag data uses spaces, so by default they never match -- see fold_underscores).
# Blocklist: drop a post when any of its general tags is one of these.
DEFAULT_BLOCKLIST = ("guro", "gore", "dismemberment", "decapitation", "corpse", "blood",
                     "extreme_content", "death", "violence", "injury")
# Generic tags optionally removed from every tag list.
DEFAULT_STOP_TAGS = ("1girl", "solo", "looking_at_viewer", "simple_background",
                     "1boy", "monochrome", "no_humans", "totally_nude")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stripped(col) -> Column:
    """Text without the white space around it (tabs and line breaks as well as blanks)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def parse_tag_list(col) -> Column:
    """Null -> "", trim; split on "," when a comma is present, else on " "; trim each; drop "".

    Bag semantics: duplicates inside a list are kept (no array_distinct).
    """
    s = stripped(F.coalesce(_c(col), F.lit("")))
    parts = F.when(s.contains(","), F.split(s, ",")).otherwise(F.split(s, " "))
    return F.filter(F.transform(parts, lambda t: stripped(t)), lambda t: t != "")


def split_comma_tags(col) -> Column:
    """A2: comma-only split of one tag column; null -> empty list; trim; drop empty."""
    s = F.coalesce(_c(col), F.lit(""))
    return F.filter(F.transform(F.split(s, ","), lambda t: stripped(t)), lambda t: t != "")


def has_any_tag(tags, terms: Iterable[str]) -> Column:
    """true when any element equals one of `terms` (false on an empty list)."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return F.exists(_c(tags), lambda t: t.isin(terms))


def remove_tags(tags, terms: Iterable[str]) -> Column:
    """drop every occurrence of `terms`; unlike array_except this keeps duplicates of the rest."""
    terms = list(terms)
    if not terms:
        return _c(tags)
    return F.filter(_c(tags), lambda t: ~t.isin(terms))
