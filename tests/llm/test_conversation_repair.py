"""Repair of conversations against a plain search over every sequence of edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tagflow.llm import auction_path as ap
from tagflow.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, copies long, audit string, part int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Least (cost, word) by a best-first search whose entries are whole words, and the repaired lines."""
    faults, seen = [], set()
    for role, text in rows:
        marks = BLANK.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, word, at, last, lines = heapq.heappop(todo)
        if (at, last) in done:
            continue
        if at == len(rows) and last in ("", "a"):
            return faults, cost, word, lines
        done.add((at, last))
        wanted = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(todo, (cost + 2, word + "I", at, wanted, lines + (name + ":",)))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(todo, (cost + 3, word + "D", at + 1, last, lines))
            if faults[at] not in ("blank", "duplicate"):
                cut = faults[at] == "truncated"
                if role[:1] == wanted or role[:1] == "s" and last == "":
                    heapq.heappush(todo, (cost + cut, word + "K", at + 1, role[:1], lines + (f"{role}:{text}",)))
                heapq.heappush(todo, (cost + cut + 2, word + "R", at + 1, wanted, lines + (f"{name}:{text}",)))


def plain_report(ids, rows):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, cost, word, lines = plain_repair([r[2:] for r in own])
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        illegal = sum(x not in (("s", "u"), ("u", "a"), ("a", "u")) for x in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    illegal, cost, word, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def awkward(seed=3, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", " \t", None, "Ünï!", "x " * 2000 + ".", "Yes."]
    rows = []
    for c in range(convs):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    rows += [(None, 0, "user", "a."), (None, None, None, None), (7, 1, "user", "Yes."), (7, 1, "user", "Yes.")]
    rows += [(900, t, rng.choice(["user", "assistant", "user"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(150)]  # a long one
    rows += [(901, 0, "user", "same.")] * 40
    return rows


@pytest.mark.parametrize("block", [1, 3, 32])
def test_same_as_a_plain_search(spark, block):
    rows = awkward()
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], SCHEMA).repartition(3)
    done = cr.report(*cr.repair(cr.damaged(df), copies_col="copies", block=block))
    found = sorted((tuple(r) for r in done.select(*COLUMNS).collect()), key=repr)
    assert found == plain_report({r[0] for r in rows}, plain_damage(rows))


def test_empty_table_and_turns_of_the_result(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(*cr.repair(cr.damaged(empty), copies_col="copies")).collect() == []
    df = spark.createDataFrame([(1, 0, "assistant", "Hi.", 1, "", 0), (1, 1, "user", "Bye.", 1, "", 0)], SCHEMA)
    turns = cr.repaired_turns(cr.repair(df)[1]).orderBy("part", "seq", "at").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", ""), ("assistant", "Hi."), ("user", "Bye."), ("assistant", "")]


def test_prices_are_the_costs_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9, 10]) for _ in range(rng.randint(0, 12)))
        table = ap.costs(codes)
        for s in ap.STATES:
            dist = {(0, s): 0}
            todo = [(0, 0, s)]
            while todo:
                d, i, q = heapq.heappop(todo)
                if i == len(codes) or d > dist[i, q]:
                    continue
                cut = 1 if codes[i] & 4 else 0
                ways = [(3, i + 1, q), (2, i, ap.NEXT[q])]
                if not codes[i] & 8:
                    ways.append((2 + cut, i + 1, ap.NEXT[q]))
                    if ap.kept_state(codes[i] & 3, q) is not None:
                        ways.append((cut, i + 1, ap.kept_state(codes[i] & 3, q)))
                for w, j, r in ways:
                    if d + w < dist.get((j, r), 1e9):
                        dist[j, r] = d + w
                        heapq.heappush(todo, (d + w, j, r))
            assert [dist.get((len(codes), t), -1) for t in ap.STATES] == list(table[4 * s:4 * s + 4])
