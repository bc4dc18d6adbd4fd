"""One HTML page as flat rows: headings, lists and list items with their links to each other.

Only parsing happens here. Elements are numbered in document order and kept in plain lists, so depth
costs no recursion; every relation (next sibling, first list or link inside, text) is one pass over
these lists. What the rows mean -- heading paths, nesting, selection -- is DataFrame work in
``operators.page_walk``.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Elements that are not content, and headings that are never sections.
NOISE_SELECTORS = (
    "header", "nav", "#top", "#nav", "#main-menu", "#subnav-menu", ".search-form", "#notice", "#sidebar", "aside",
    "#blacklist-box", "#page-footer", ".post-preview", "#post-sections", ".paginator",
)
UNWANTED_HEADINGS = (
    "Search", "Options", "Edit", "Related", "Blacklisted", "Recent Changes",
    "Tags", "Comments", "Notes", "Artists", "Pools", "Wiki", "Forum",
)
CONTENT_ID = "wiki-page-body"  # a page that has this div keeps its noise elements

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Fields of a row: tag; pos, parent_pos and parent_tag; text (a heading's, or a list item's outside its lists);
#: has_text (also inside its lists); first link inside; next sibling; next list among siblings; first list inside; and
#: of a list the lists around it, outermost first.
FIELDS = ("tag", "pos", "parent_pos", "parent_tag", "text", "has_text", "link_text", "href", "next_pos", "next_tag",
          "next_ul", "inner_ul", "outer_uls")
DDL = ("tag string, pos int, parent_pos int, parent_tag string, text string, has_text boolean, link_text string, "
       "href string, next_pos int, next_tag string, next_ul int, inner_ul int, outer_uls array<int>")


class _Elements(HTMLParser):
    """Numbered elements: tag, parent, attributes, and the stripped strings inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attributes = ["[document]"], [-1], [{}]
        self.strings: list[tuple[int, str]] = []
        self.open = [0]
        self.open_tags: dict[str, int] = {}  # how many of each are open

    def add(self, tag, attributes):
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.attributes.append(dict(attributes))

    def handle_starttag(self, tag, attributes):
        self.add(tag, attributes)
        if tag not in EMPTY:
            self.open.append(len(self.tags) - 1)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attributes):
        self.add(tag, attributes)

    def handle_endtag(self, tag):
        if self.open_tags.get(tag):
            closed = None
            while closed != tag:
                closed = self.tags[self.open.pop()]
                self.open_tags[closed] -= 1

    def handle_data(self, data):
        if self.tags[self.open[-1]] not in ("script", "style") and (stripped := data.strip()):
            self.strings.append((self.open[-1], stripped))


def _selected(tag: str, attributes: dict, selectors: tuple[str, ...]) -> bool:
    names = (attributes.get("class") or "").split()
    return any(s[1:] == attributes.get("id") if s[0] == "#" else s[1:] in names if s[0] == "." else s == tag for s in selectors)


def _joined(strings, owner) -> dict[int, str]:
    """The strings of each owner, joined."""
    out: dict[int, list[str]] = {}
    for element, s in strings:
        if owner[element] is not None:
            out.setdefault(owner[element], []).append(s)
    return {k: "".join(v) for k, v in out.items()}


def page_rows(html: str | None, noise: tuple[str, ...] | None = None) -> list[tuple]:
    """Rows (FIELDS) of a page. noise: selectors in place of NOISE_SELECTORS; () removes nothing."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    tags, parents, attributes = parser.tags, parser.parents, parser.attributes
    n = len(tags)
    selectors = NOISE_SELECTORS if noise is None else tuple(noise)
    if any(t == "div" and a.get("id") == CONTENT_ID for t, a in zip(tags, attributes)):
        selectors = ()

    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parents[i]] or _selected(tags[i], attributes[i], selectors)

    def nearest(own, stop=()):
        """For each element: the nearest of itself and its ancestors whose tag is in own, unless one in stop is nearer."""
        out: list[int | None] = [None] * n
        for i in range(1, n):
            out[i] = i if tags[i] in own else None if tags[i] in stop else out[parents[i]]
        return out

    strings = [(e, s) for e, s in parser.strings if not gone[e]]
    headings = _joined(strings, nearest(HEADINGS))
    for i in range(1, n):
        gone[i] = gone[i] or gone[parents[i]] or tags[i] in HEADINGS and headings.get(i) in UNWANTED_HEADINGS
    strings = [(e, s) for e, s in strings if not gone[e]]
    items = _joined(strings, nearest(("li",), ("ul",)))
    links = _joined(strings, nearest(("a",)))

    first_a: list[int | None] = [None] * n
    first_ul: list[int | None] = [None] * n
    has_text = [False] * n
    next_pos: list[int | None] = [None] * n
    next_ul: list[int | None] = [None] * n
    for e, _ in strings:
        has_text[e] = True
    child: dict[int, int] = {}  # by parent: the element and the list met last, from the end
    child_ul: dict[int, int] = {}
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        p = parents[i]
        has_text[p] = has_text[p] or has_text[i]
        # from the end, so what comes first in the document is written last
        first_a[p] = i if tags[i] == "a" else first_a[i] if first_a[i] is not None else first_a[p]
        first_ul[p] = i if tags[i] == "ul" else first_ul[i] if first_ul[i] is not None else first_ul[p]
        next_pos[i], next_ul[i] = child.get(p), child_ul.get(p)
        child[p] = i
        if tags[i] == "ul":
            child_ul[p] = i

    around = nearest(("ul",))
    outer: dict[int, list[int]] = {}  # of each list that stays
    rows = []
    for i in range(1, n):
        if tags[i] == "ul" and not gone[i]:
            above = around[parents[i]]
            outer[i] = [] if above is None else [*outer[above], above]
        if gone[i] or not (tags[i] in HEADINGS or tags[i] in ("ul", "li")):
            continue
        a = first_a[i]
        linked = a is not None and "href" in attributes[a]
        text = headings.get(i, "") if tags[i] in HEADINGS else items.get(i, "") if tags[i] == "li" else None
        rows.append((tags[i], i, parents[i], tags[parents[i]], text, has_text[i], links.get(a, "") if linked else None,
                     attributes[a]["href"] if linked else None, next_pos[i],
                     tags[next_pos[i]] if next_pos[i] is not None else None, next_ul[i], first_ul[i],
                     outer.get(i)))
    return rows
