"""Texts in pieces that tokenise on their own, and what each piece gives, remembered in bounded memory.

The pattern of these tokenizers attaches a blank to what follows it. So a blank before a character
that isn't white space always begins a pre-token, and the text can be cut there: most pieces are
single words that recur all over a corpus, and a task looks them up instead of splitting by regex.
A piece that begins with white space stays with the piece before it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Entries of a memory's younger half, and the longest key.
REMEMBERED, LONGEST = 350_000, 64
#: Marks that end a word; alone after letters each is a pre-token.
ENDS = ".,;:!?"
_ABSENT = object()


class Recent(dict):
    """Values by key, made when missing; when the younger half is full, the older one is forgotten."""

    def __init__(self, make: Callable[[str], Any], remembered: int = REMEMBERED):
        super().__init__()
        self.make, self.remembered = make, remembered
        self.old: dict[str, Any] = {}

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key, _ABSENT)
        if value is _ABSENT:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key: str, value: Any) -> None:
        if len(key) <= LONGEST:
            if len(self) >= self.remembered:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def has(self, key: str) -> bool:
        return key in self or key in self.old


def pretokens_of(word: str, findall: Callable[[str], list[str]]) -> list[str]:
    """The pre-tokens of a blank and word. Letters, alone or with one mark after them, need no regex."""
    if word.isalpha():
        return [" " + word]
    if word[-1:] in ENDS and word[:-1].isalpha():
        return [" " + word[:-1], word[-1]]
    return findall(" " + word)


def begins_piece(word: str) -> bool:
    return bool(word) and not word[0].isspace()


class Pieces:
    """Values of a text's pieces. of_pretokens: a list of pre-tokens' value, which is never None."""

    def __init__(self, findall: Callable[[str], list[str]], of_pretokens: Callable[[list[str]], Any]):
        self.findall, self.of_pretokens = findall, of_pretokens
        self.words = Recent(self.of_word)  # by what follows a blank; None for what begins no piece

    def of_word(self, word: str) -> Any:
        return self.of_pretokens(pretokens_of(word, self.findall)) if begins_piece(word) else None

    def of_text(self, text: str) -> list:
        words = text.split(" ")
        known = self.words
        got = [known[w] for w in words[1:]]
        if None not in got:
            return [self.of_pretokens(self.findall(words[0])), *got] if words[0] else got
        pieces: list[tuple[str, Any]] = [(words[0], None)]
        for word, value in zip(words[1:], got, strict=True):
            if value is None:
                pieces[-1] = (pieces[-1][0] + " " + word, None)
            else:
                pieces.append((" " + word, value))
        return [self.of_pretokens(self.findall(p)) if value is None else value for p, value in pieces if p]


class WordIds:
    """Ids of texts, as bytes of integers, by the ids of their words.

    A slice of texts is cut into words at once; only words not met lately go through ``pretoken``. A
    text that holds one of the special strings, or the mark that parts texts here, goes through ``text``.
    """

    MARK = "\0"  # stands before a text's first word, which has no blank before it

    def __init__(self, findall: Callable[[str], list[str]], remembered: int, special: list[str]):
        self.findall, self.remembered = findall, remembered
        self.special = [self.MARK, *special]
        self.marks = {c: self.pretoken(c) for c in [*ENDS, "\n"]}
        self.known: dict[str, bytes | bool] = {}  # ids of a blank and the word; False: begins no piece
        self.old: dict[str, bytes | bool] = {}

    def pretoken(self, text: str) -> bytes:
        raise NotImplementedError

    def text(self, text: str) -> bytes:
        return b"".join(map(self.pretoken, self.findall(text)))

    def word(self, w: str) -> bytes | bool:
        """Ids of a blank and a word; after the mark, of the word alone; after a line break, of both."""
        if w.isalpha():
            return self.pretoken(" " + w)
        first = w[:1]
        if first == self.MARK:
            return self.pretoken(w[1:]) if w[1:].isalpha() else b"".join(map(self.pretoken, self.findall(w[1:])))
        if first == "\n" and len(w) > 1 and not w[1].isspace():
            return self.marks["\n"] + self.word(self.MARK + w[1:])
        if not begins_piece(w):
            return False
        if w[-1] in self.marks and w[:-1].isalpha():
            core = self.known.get(w[:-1])
            return (core or self.pretoken(" " + w[:-1])) + self.marks[w[-1]]
        return b"".join(map(self.pretoken, self.findall(" " + w)))

    def batch(self, texts: list[str]) -> list[bytes]:
        plain = [not any(x in t for x in self.special) for t in texts]
        # a line break begins a word as well; one that follows a blank or another shows by a word that begins no piece
        cut = [(self.MARK + t.replace("\n", " \n")) for t, p in zip(texts, plain, strict=True) if p]
        words = " ".join(cut).split(" ")
        if len(self.known) > self.remembered:
            self.old, self.known = self.known, {}
        known, old, value = self.known, self.old.get, self.word
        got = list(map(known.get, words))
        at = -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            w = words[at]
            found = known.get(w)
            if found is None:
                found = old(w)
                if found is None:
                    found = value(w)
                if len(w) <= LONGEST:
                    known[w] = found
            got[at] = found
        out, at, n = [], 0, 0
        for text, p in zip(texts, plain, strict=True):
            if not p:
                out.append(self.text(text))
                continue
            end = at + cut[n].count(" ") + 1
            mine = got[at:end]
            out.append(self.glued(words[at:end], mine) if False in mine else b"".join(mine))
            at, n = end, n + 1
        return out

    def glued(self, words: list[str], ids: list[bytes | bool]) -> bytes:
        """Where a word begins no piece it belongs to the piece before it."""
        pieces: list[tuple[str, bytes | bool]] = [(words[0][1:], ids[0])]
        for word, data in zip(words[1:], ids[1:], strict=True):
            shown = word if word[:1] == "\n" else " " + word
            pieces.append((shown, data) if data is not False else (pieces.pop()[0] + shown, False))
        return b"".join([b"".join(map(self.pretoken, self.findall(p))) if data is False else data for p, data in pieces])
