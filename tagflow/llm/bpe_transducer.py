"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Two facts make the merges a transducer. Dropping the last token of the encoding of a prefix leaves
the encoding of a shorter prefix; and a sequence of tokens is an encoding exactly if each two
neighbours in it are. So after some bytes it is enough to know from which places a token may still
run on, and the last token before each such place.

The places come from an automaton over the vocabulary's trie: the trie read from every place at once
is nondeterministic, and its subsets are made into states, with the tokens that can end there, when
first met. The deepest node of a subset decides the others, so there are at most as many states as
trie nodes. Beside the state the transducer keeps the last token of each place in the window that
the longest token spans: of the tokens that end at a byte exactly one fits the last token before it.
A token is settled when all places that are alive lie behind it, and long inputs are emitted as
tokens settle.
"""

from __future__ import annotations

import codecs

#: Bytes after which settled tokens are emitted.
WINDOW = 1024
#: Pairs of tokens whose neighbourhood is remembered.
NEIGHBOURS = 500_000
NONE = -1


class Ranks:
    """A rank file's tokens, and their merges by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {n: b for b, n in ranks.items()}

    def parts(self, data: bytes, below: int) -> list[bytes]:
        """What merging leaves: the neighbours whose join has the lowest rank first, the leftmost of equals."""
        get = self.ranks.get
        part = [data[i:i + 1] for i in range(len(data))]
        rank = [get(data[i:i + 2], below) for i in range(len(data) - 1)]
        while rank and (lowest := min(rank)) < below:
            i = rank.index(lowest)
            joined = part[i] + part[i + 1]
            part[i:i + 2] = [joined]
            del rank[i]
            if i < len(rank):
                rank[i] = get(joined + part[i + 1], below)
            if i:
                rank[i - 1] = get(part[i - 1] + joined, below)
        return part


class Transducer:
    def __init__(self, table: Ranks):
        self.table = table
        # the trie of tokens that encode as themselves: by node and byte the next node
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [NONE]  # the token that a node is
        self.depth: list[int] = [0]
        self.halves: dict[int, tuple[int, int]] = {}  # of each token: the two that its last merge joins
        for data, n in table.ranks.items():
            if len(data) > 1:
                halves = table.parts(data, n)
                if len(halves) != 2:
                    continue
                self.halves[n] = (table.ranks[halves[0]], table.ranks[halves[1]])
            node = 0
            for b in data:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(NONE)
                    self.depth.append(self.depth[node] + 1)
                node = self.trie[node][b]
            self.ends[node] = n
        self.neighbours: dict[int, bool] = {}
        self.number: dict[tuple[int, ...], int] = {(0,): 0}
        self.state: list[tuple[int, ...]] = [(0,)]  # nodes of the places that are alive, the earliest place first
        # by byte: the next state, tokens that can end there with their lengths, and the one left if none of these fits
        self.step: list[dict[int, tuple[int, list[tuple[int, int]], int, int]]] = [{}]

    def together(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if len(self.neighbours) >= NEIGHBOURS:
            self.neighbours.clear()
        known = self.neighbours[a << 32 | b] = a == NONE or self.apart(a, b)
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge joins what stands on both sides of the border while a and b come about.

        Undoes their merges, the latest first. Before the merge that made one half, a join over the
        border would have come first if its rank is lower, or equal and it stands further left.
        """
        ranks, data, halves = self.table.ranks, self.table.bytes_of, self.halves
        before = len(ranks) + max(a, b)
        while True:
            joined = ranks.get(data[a] + data[b])
            if joined is not None and joined < before:
                return False
            made_a, made_b = halves.get(a), halves.get(b)
            if made_a and (a > b or not made_b):
                before, a = a, made_a[1]
            elif made_b:
                before, b = b + 1, made_b[0]
            else:
                return True

    def make(self, n: int, byte: int) -> tuple[int, list[tuple[int, int]], int, int]:
        """The step from state n: each place's node goes on, and a new place begins."""
        reached = [self.trie[node][byte] for node in self.state[n] if byte in self.trie[node]]
        alive = (*(node for node in reached if self.trie[node]), 0)
        to = self.number.setdefault(alive, len(self.state))
        if to == len(self.state):
            self.state.append(alive)
            self.step.append({})
        ending = [(self.ends[node], self.depth[node]) for node in reached if self.ends[node] != NONE]
        if not ending:
            raise ValueError("the vocabulary has a byte that is no token")
        made = self.step[n][byte] = (to, ending[:-1], *ending[-1])
        return made

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.table.ranks.get(data)
        if whole is not None:
            return [whole]
        steps, known, together = self.step, self.neighbours.get, self.together
        out: list[int] = []
        last, spans = [NONE], [0]  # of the token that ends at each place of the window, and its length
        at = i = 0
        for byte in data:
            i += 1
            got = steps[at].get(byte)
            if got is None:
                got = self.make(at, byte)
            at, trying, token, length = got  # exactly one token fits, so the last needs no test
            for t, n in trying:
                before = last[i - n]
                fits = known(before << 32 | t)
                if fits or fits is None and together(before, t):
                    token, length = t, n
                    break
            last.append(token)
            spans.append(length)
            if i >= WINDOW:
                self.emit(out, last, spans, [i - self.depth[node] for node in self.state[at]])
                i = len(last) - 1
        settled = []
        while i:
            settled.append(last[i])
            i -= spans[i]
        settled.reverse()
        return out + settled if out else settled

    @staticmethod
    def emit(out: list[int], last: list[int], spans: list[int], alive: list[int]) -> None:
        """Emit the tokens before the place at which the encodings up to all places alive meet; keep what is behind it."""
        meet = set(alive)
        while len(meet) > 1:
            late = max(meet)
            meet.remove(late)
            meet.add(late - spans[late])
        end = at = meet.pop()
        settled = []
        while at:
            settled.append(last[at])
            at -= spans[at]
        out.extend(settled[::-1])
        del last[:end], spans[:end]
        spans[0] = 0


class Utf8Stream:
    """Tokens to text as they come: the state is the bytes of a character that isn't complete, three at most.

    Steps by (state, token) are made when first met. Bytes that can't be UTF-8 become U+FFFD.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.pending = b""
        self.whole: dict[int, str] = {}  # of steps that begin and end between characters

    def make(self, state: bytes, token: int) -> tuple[str, bytes]:
        data = state + self.bytes_of[token]
        text, used = codecs.utf_8_decode(data, "replace", False)
        self.steps.setdefault(data[used:], {})
        made = self.steps[state][token] = (text, data[used:])
        if not state and not data[used:]:
            self.whole[token] = text
        return made

    def feed(self, tokens: list[int]) -> str:
        state, steps = self.pending, self.steps
        # steps between whole characters, all at once; the others one by one
        out: list = [None] * len(tokens) if state else list(map(self.whole.get, tokens))
        at = -1
        for _ in range(out.count(None)):
            try:
                at = out.index(None, at + 1)
            except ValueError:
                break
            while True:
                got = steps[state].get(tokens[at])
                if got is None:
                    got = self.make(state, tokens[at])
                out[at], state = got
                if not state or at + 1 == len(tokens):
                    break
                at += 1
        self.pending = state
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character at the end gives."""
        rest, self.pending = self.pending, b""
        return codecs.utf_8_decode(rest, "replace", True)[0]
