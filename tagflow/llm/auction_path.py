"""Cheapest edits of a short run of turns: an auction algorithm for shortest paths over an integer-cost lattice.

A node is (turns done, role state). The states spell (s?(ua)+)?: 0 nothing yet, 1 after a system turn,
2 after a user turn, 3 after an assistant turn. The arcs are edits, one letter each: D(elete), I(nsert),
K(eep), R(erole); with the node, the letter decides where an arc leads, since each state takes one of
user and assistant.

The auction keeps a price for each node, never above the cost of an arc plus the price where it leads, and a
path from the origin along arcs where both are equal. It extends the path by the best arc if that one is
tight, and else raises the last node's price and contracts the path. At the sink the prices are a dual
solution: every cheapest path runs on tight arcs alone, so the least word is traced along them.
"""

from __future__ import annotations

from functools import lru_cache

#: Where an inserted or renamed turn leads, by state, and the role it then has.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: What a conversation still costs when its turns end in a state, and the letters for it.
AT_END = (0, 4, 2, 0)
LETTERS_AT_END = ("", "II", "I", "")
STATES = range(4)
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1
#: Code of a turn: its initial (0 s, 1 u, 2 a, 3 another) plus 4 if it is truncated and 8 if it has to go.
TRUNCATED, MUST_GO = 4, 8
NO_WAY = -1

Arcs = list[list[tuple[str, int, int]]]


def code(initial: str, truncated: bool, must_go: bool) -> int:
    return ("sua".find(initial) if initial in ("s", "u", "a") else 3) + TRUNCATED * truncated + MUST_GO * must_go


def kept_state(initial: int, state: int) -> int | None:
    """The state after a turn that stays as it is; None if it can't stand here."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def lattice(codes: bytes, ends: tuple[int, ...]) -> tuple[Arcs, list[int]]:
    """Arcs out of each node 4 * turns + state, in the order of letters, and prices to start with.

    ends: the price of each state after the last turn (NO_WAY: can't end there). The sink is the last
    node. Arcs into nodes that have no way to the sink are left out.
    """
    n = len(codes)
    sink = 4 * (n + 1)
    arcs: Arcs = [[] for _ in range(sink + 1)]
    least = min(e for e in ends if e != NO_WAY)
    price = [0] * (sink + 1)
    live = [False] * sink + [True]
    for s in STATES:
        if ends[s] != NO_WAY:
            arcs[4 * n + s] = [("", ends[s], sink)]
            live[4 * n + s] = True
        price[4 * n + s] = least
    below = least
    for i in range(n - 1, -1, -1):
        c = codes[i]
        cut = CUT if c & TRUNCATED else 0
        below += DELETE if c & MUST_GO else cut  # no edit of this turn is cheaper
        out: list[list[tuple[str, int, int]]] = []
        for s in STATES:
            a = [("D", DELETE, 4 * (i + 1) + s), ("I", INSERT, 4 * i + NEXT[s])]
            if not c & MUST_GO:
                to = kept_state(c & 3, s)
                if to is not None:
                    a.append(("K", cut, 4 * (i + 1) + to))
                a.append(("R", RENAME + cut, 4 * (i + 1) + NEXT[s]))
            out.append(a)
            price[4 * i + s] = below
        for _ in range(3):  # insertions chain through states of the same turn
            for s in STATES:
                live[4 * i + s] = live[4 * i + s] or any(live[to] for _, _, to in out[s])
        for s in STATES:
            arcs[4 * i + s] = [a for a in out[s] if live[a[2]]]
    return arcs, price


def auction(arcs: Arcs, origin: int, price: list[int]) -> None:
    """Raises prices until a tight path leads from origin to the sink; price[origin] is then its cost."""
    sink = len(arcs) - 1
    path = [origin]
    while path[-1] != sink:
        at = path[-1]
        best, to = min((cost + price[j], j) for _, cost, j in arcs[at])
        if price[at] < best:
            price[at] = best
            if at != origin:
                path.pop()
        else:
            path.append(to)


@lru_cache(maxsize=20_000)
def costs(codes: bytes) -> tuple[int, ...]:
    """The least cost from each state before the turns to each state after them (16 numbers, NO_WAY where none)."""
    table = [NO_WAY] * 16
    for end in STATES:
        arcs, price = lattice(codes, tuple(0 if s == end else NO_WAY for s in STATES))
        for s in STATES:
            if arcs[s]:
                auction(arcs, s, price)
                table[4 * s + end] = price[s]
    return tuple(table)


def before(table: tuple[int, ...] | list[int], ends: tuple[int, ...]) -> tuple[int, ...]:
    """Prices before some turns, from their costs and the prices after them."""
    ways = [[table[4 * s + t] + ends[t] for t in STATES if table[4 * s + t] != NO_WAY and ends[t] != NO_WAY] for s in STATES]
    return tuple(min(w, default=NO_WAY) for w in ways)


@lru_cache(maxsize=20_000)
def traced(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state before the turns the least word of the cheapest edits and the state after them."""
    arcs, price = lattice(codes, ends)
    sink = len(arcs) - 1
    for s in STATES:
        if arcs[s]:
            auction(arcs, s, price)
    tight = [[(letter, to) for letter, cost, to in out if price[at] == cost + price[to]] for at, out in enumerate(arcs)]
    good = [False] * sink + [True]
    for i in range(len(codes), -1, -1):  # tight arcs that lead on to the sink
        for _ in range(3):
            for s in STATES:
                good[4 * i + s] = good[4 * i + s] or any(good[to] for _, to in tight[4 * i + s])
    found = []
    for s in STATES:
        word, at = [], s
        while good[at] and at < sink - 4:
            letter, at = min((letter, to) for letter, to in tight[at] if good[to])
            word.append(letter)
        found.append(("".join(word), at % 4 if good[s] else NO_WAY))
    return tuple(found)
