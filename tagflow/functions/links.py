"""Wiki link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the studied project: link syntax, the "see also" marker (capital S allowed,
# lower-case "also" only), the tail length and the tail words.
LINK_RE = r"\[\[([^\]]+)\]\]"
SEE_ALSO_RE = r"[Ss]ee\s+also"
TAIL_CHARS = 2000  # of the parity form; None reads whole bodies
TAIL_WORDS = ("see", "also")

# parity: everything from the start of the body through the line (or up to an "hN.") holding
# the last marker -- what the original multiline/dot-all pattern returns. Anchored once at \A
# so the scan is linear; the lazy group stops before the terminator, so no lookahead
# is needed (the same pattern runs in Java regex and in RE2).
PARITY_SECTION_RE = r"(?s)\A(.*" + SEE_ALSO_RE + r".*?)(?:h[1-6]\.|\n|\z)"
# section: the text after the last marker up to the next line that starts with "hN.".
SECTION_RE = r"(?s)\A.*" + SEE_ALSO_RE + r"(.*?)(?:\nh[1-6]\.|\z)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def page_tag(tag, title) -> Column:
    """First non-empty of tag / title."""
    return F.coalesce(F.nullif(_c(tag), F.lit("")), F.nullif(_c(title), F.lit("")))


def extract_links(text) -> Column:
    """The raw inner text of every [[...]] (no case or alias folding)."""
    return F.regexp_extract_all(_c(text), F.lit(LINK_RE), 1)


def has_see_also(body) -> Column:
    return _c(body).rlike(SEE_ALSO_RE)


def see_also_section(body, mode: str = "section") -> Column:
    """The see-also text of a body ('' when the marker is absent)."""
    pattern = PARITY_SECTION_RE if mode == "parity" else SECTION_RE
    return F.regexp_extract(_c(body), pattern, 1)


def tail_of(body, chars: int | None) -> Column:
    """The last so many characters, or the whole body."""
    return _c(body) if chars is None else F.right(_c(body), F.lit(int(chars)))


def tail_mentions_see_also(body, chars: int | None = None) -> Column:
    """The tail contains "see" or "also" in any case."""
    tail = F.lower(tail_of(body, chars))
    out = F.lit(False)
    for w in TAIL_WORDS:
        out = out | tail.contains(w)
    return out
