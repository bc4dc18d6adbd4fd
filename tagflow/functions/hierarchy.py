"""Expressions of the tag hierarchy."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the studied project.
# Node kinds and their conflict priority (higher wins; anything else 0).
TAG_AND_TAG_GROUP = "tag_and_tag_group"
TRADITIONAL_TAG_GROUP = "traditional_tag_group"
TAG_GROUP_ONLY = "tag_group_only"
FINAL_TAG_ONLY = "final_tag_only"
PRIORITY = {TAG_AND_TAG_GROUP: 4, TRADITIONAL_TAG_GROUP: 3, TAG_GROUP_ONLY: 2, FINAL_TAG_ONLY: 1}
# Default section exclusions and ignored elements (lower-cased substring tests).
DEFAULT_EXCLUDE_SECTIONS = ("copyrights, artists, projects and media", "see also")
DEFAULT_IGNORE_ELEMENTS = ("see also",)
# Link-follow markers, path separators, site host and wiki->posts rewrite.
FOLLOW_MARKERS = ("tag group", "list of")
PATH_SEP_FLAT = " → "
PATH_SEP_MATCH = " -> "
SITE_HOST = "https://wiki.example.org"  # a parameter: the host that relative links belong to
WIKI_PREFIX = "/wiki_pages/"
POSTS_PREFIX = "/posts?tags="
GROUP_PREFIX = "tag group:"
TAGS_SUFFIX = " tags"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classify(name, has_link, has_nested) -> Column:
    """H7: 4-way node classification."""
    named_group = F.lower(_c(name)).contains("tag group")
    nested, link = _c(has_nested), _c(has_link)
    return (F.when(nested & link & ~named_group, F.lit(TAG_AND_TAG_GROUP))
             .when(nested & ~link & ~named_group, F.lit(TAG_GROUP_ONLY))
             .when(named_group, F.lit(TRADITIONAL_TAG_GROUP))
             .otherwise(F.lit(FINAL_TAG_ONLY)))


def priority(classification) -> Column:
    """Conflict priority of a classification (unknown -> 0)."""
    c = _c(classification)
    expr = F.lit(0)
    for k, v in sorted(PRIORITY.items(), key=lambda kv: kv[1]):
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return expr


def parent_of(path) -> Column:
    """Second-to-last path element, null for paths shorter than 2."""
    p = _c(path)
    return F.when(F.size(p) >= 2, F.element_at(p, -2))


def depth_of(path) -> Column:
    """depth = number of path elements (the leaf included)."""
    return F.size(_c(path))


def should_follow(link_text) -> Column:
    """Follow only links whose text contains "tag group" or "list of"."""
    t = F.lower(stripped(link_text))
    out = F.lit(False)
    for m in FOLLOW_MARKERS:
        out = out | t.contains(m)
    return out


def stripped(text) -> Column:
    """Text without the white space around it (all kinds, not blanks alone)."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def rewrite_url(href, host: str = SITE_HOST) -> Column:
    """Host-prefix a relative href; wiki page urls become the posts search of that tag."""
    h = _c(href)
    full = F.when(h.startswith("/"), F.concat(F.lit(host), h)).otherwise(h)
    return F.when(full.contains(WIKI_PREFIX),
                  F.concat(F.lit(host + POSTS_PREFIX), F.element_at(F.split(full, WIKI_PREFIX), -1))
                  ).otherwise(full)


def contains_any_term(text, terms: Iterable[str]) -> Column:
    """lower(trim(text)) contains any of the (lower-cased) terms."""
    t = F.lower(stripped(text))
    out = F.lit(False)
    for term in terms:
        out = out | t.contains(term.lower())
    return out


def glob_match_any(text, patterns: Iterable[str]) -> Column:
    """the whole of lower(text) matches any lower-cased glob pattern (* ? [seq] [!seq])."""
    t = F.lower(_c(text))
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike("^" + fnmatch.translate(p.lower()).replace(r"\Z", r"\z"))
    return out


def group_base_names(name) -> tuple[Column, Column]:
    """For "tag group:X" the candidate base names X and (X without " tags" when it ends so)."""
    n = _c(name)
    base = stripped(F.replace(n, F.lit(GROUP_PREFIX), F.lit("")))
    alt = F.when(base.endswith(TAGS_SUFFIX), F.replace(base, F.lit(TAGS_SUFFIX), F.lit("")))
    return base, alt


def join_path(path, sep: str = PATH_SEP_FLAT) -> Column:
    """X12."""
    return F.array_join(_c(path), sep)


def lower_path(path) -> Column:
    """X11."""
    return F.transform(_c(path), lambda s: F.lower(s))
