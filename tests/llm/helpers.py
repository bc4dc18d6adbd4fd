"""Small tables with every awkward case, and plain forms of what the operators compute."""

from __future__ import annotations

import random
import re

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, row long, fp string, spans string, "
        "score double, ids string, shard int, n_words long")


def awkward_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["the", "of", "Éç", "ß1", "under", "it's", "a", "re-do", "10.0.0.1", "x@y.de", "日本", "😀", "+49 30 1234567"]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    some = [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n", "  ", " \n"]) for _ in range(rng.randint(1, 60)))
            for _ in range(40)]
    return [None, "", " ", "\n\n \t", "one", "one two", *some, some[0], some[0], some[1], long, "<|endoftext|> a", "\0 b\0", "9" * 5000]


def awkward_docs(spark, texts=None):
    """Nulls in every column, repeated rows, tied and null ids, extra columns named like the operators' own."""
    texts = awkward_texts() if texts is None else texts
    rows = [(n, t, "en" if n % 3 else None, f"src{n % 2}", len(t) if t is not None else None, n, "x", "y", 0.5, "z", 1, 2)
            for n, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text under the same id", *rows[5][2:])] if len(rows) > 5 else []
    rows += [(None, "no id of its own", *[None] * 10), (None, None, *[None] * 10)] if rows else []
    return spark.createDataFrame(rows, DOCS)


def pairs(df, *columns):
    return sorted(((tuple(r)) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
