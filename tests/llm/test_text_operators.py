"""PII, decontamination, SimHash, toxicity, LM scores and sharding on small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tagflow.llm import decontamination, lm_scoring, pii, sharding, simhash, toxicity
from tagflow.llm.fm_index import GAP, FMIndex

from .helpers import ascii_lower, awkward_docs, pairs, words

BENCHMARK = "item_id long, text string, spans string"


# --- sharding ---------------------------------------------------------------------------------

def test_shards_are_even_and_gapless(spark):
    docs = awkward_docs(spark)
    rows = sharding.feistel_shards(docs, shards=7).collect()
    assert sorted(r["position"] for r in rows) == sorted(r["row_no"] for r in rows) == list(range(len(rows)))
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for k, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n))
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 100, 1000])
def test_permutation_is_reproducible(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    one = pairs(sharding.feistel_shards(docs))
    assert pairs(sharding.feistel_shards(docs.repartition(5))) == one
    assert sorted(r[4] for r in one) == list(range(n))
    if n >= 100:
        assert pairs(sharding.feistel_shards(docs, seed=3)) != one


def spark_hash(*values):
    """XXH64 as Spark chains it over columns: ints in 4 bytes, longs in 8, nulls leave it as it is."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return h - (1 << 64) if h >> 63 else h


def test_places_are_those_of_a_plain_permutation(spark):
    docs = awkward_docs(spark)
    rows = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (spark_hash(("<q", r[0]), ("<q", r[1]), ("<q", r[2])) % sharding.BUCKETS, r[0] is not None, r[0] or 0, r[1], r[2]))
    n = len(rows)
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)

    def permute(x):
        u, v = divmod(x, b)
        for k in range(8):
            m = b if k % 2 else a
            u, v = v, (u + spark_hash(("<i", 20_240_611), ("<i", k), ("<q", v)) % m) % m
        return u * b + v

    want = []
    for k, row in enumerate(rows):
        at = permute(k)
        while at >= n:
            at = permute(at)
        want.append((*row, k, at, at % 16, at // 16))
    assert pairs(sharding.feistel_shards(docs)) == sorted(want, key=repr)


def test_many_copies_of_a_row(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.feistel_shards(docs, shards=2).collect()
    assert Counter(r["shard"] for r in rows) == {0: 1500, 1: 1500}


# --- decontamination --------------------------------------------------------------------------

def hits(docs, items, window):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k:k + window]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    found |= phrases[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [16_000_000, 200])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    docs = awkward_docs(spark)
    texts = [r["text"] for r in docs.collect() if r["text"]]
    items = [(1, " ".join(words(texts[8])[3:20])), (2, "one two"), (3, None), (4, ""), (None, texts[9]), (2, "under the same id"),
             (7, " ".join(words(texts[10])[:12])), (8, " ".join(words(texts[10])[:12]))]
    found = decontamination.find_passages(docs, spark.createDataFrame([(*x, "s") for x in items], BENCHMARK), prefix="p_")
    got = sorted(((r["doc_id"], r["p_n_words"], r["p_n_hit"], list(r["p_items"])) for r in found.collect()), key=repr)
    want = hits([(r["doc_id"], r["text"]) for r in docs.collect()], items, 10)
    assert got == want and any(x[2] for x in want)
    for r in found.withColumn("cut", decontamination.cut_out(F.col("text"), F.col("p_spans"))).collect():
        if r["text"] is not None:
            assert len(words(r["cut"])) == r["p_n_words"] - r["p_n_hit"]


def test_empty_sides(spark):
    docs, none = awkward_docs(spark), spark.createDataFrame([], BENCHMARK)
    assert decontamination.find_passages(docs, none, prefix="p_").where("p_n_hit > 0").count() == 0
    assert decontamination.find_passages(awkward_docs(spark, []), none, prefix="p_").count() == 0


def test_benchmark_is_compiled_once_for_each_text(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2_000)
    items = [(i % 7, f"item {i} of many words that stand in it {i}", "s") for i in range(100)]
    items += [(8, "one text in many rows", "s")] * 2_000
    blocks = decontamination.compile_benchmark(spark.createDataFrame(items, BENCHMARK))
    assert 1 < len(blocks.numbers) < 10 and blocks.shortest == 5
    owners = {}
    for block in blocks.blocks():
        for length, phrases, starts, of in block.phrases:
            assert phrases.shape == (len(starts) - 1, length)
            for p, row in enumerate(phrases.tolist()):
                text = b" ".join(block.vocabulary[w] for w in row).decode()
                owners.setdefault(text, set()).update(block.items[i] for i in of[starts[p]:starts[p + 1]])
    want = {}
    for item, text, _ in items:
        w = text.split()
        for k in range(max(1, len(w) - 9)):
            want.setdefault(" ".join(w[k:k + 10]), set()).add(str(item))
    assert owners == want


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 3000)
    text[-1] = GAP
    index = FMIndex(text, 4)
    for n in (1, 2, 5):
        phrases = np.array([text[k:k + n] for k in range(0, 200) if (text[k:k + n] != GAP).all()])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(text) - n + 1) if (text[k:k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- SimHash ----------------------------------------------------------------------------------

def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if x]
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, distance):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(fps))]


def test_components_are_those_of_all_pairs(spark):
    docs = awkward_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [fingerprint(t) for _, t in rows]
    top = groups(fps, 2)
    least = {g: min((rows[k][0] for k in range(len(rows)) if top[k] == g and rows[k][0] is not None), default=None) for g in set(top)}
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found), key=repr) == sorted(
        ((rows[k][0], fps[k], least[top[k]]) for k in range(len(rows))), key=repr)
    kept = simhash.keep_one(docs)
    assert kept.count() == len(set(top)) and kept.columns == docs.columns
    assert simhash.near_duplicates(awkward_docs(spark, [])).count() == 0


@pytest.mark.parametrize("distance,crowd", [(2, 24), (2, 1), (3, 24), (3, 1), (1, 2)])
def test_links_keep_every_component(spark, distance, crowd):
    rng = np.random.default_rng(distance)
    fps = [0, (1 << 64) - 1]
    for centre in rng.integers(0, 1 << 63, 6):
        for _ in range(40):
            x = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    from tagflow.llm.components import components

    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(df, distance, crowd=crowd)).collect()}
    top = groups(fps, distance)
    mine = [roots.get(x, x) for x in fps]
    assert len(set(zip(mine, top))) == len(set(mine)) == len(set(top))


# --- toxicity ---------------------------------------------------------------------------------

def toxic_docs(spark, n=600):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(["river", "stone", "house", "garden", "window", "paper", "light"]) for _ in range(rng.randint(3, 60))]
        bad = k % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilegrub", "vilemuck", "vilescab"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    extra = [(n, None), (n + 1, ""), (None, "river"), (0, rows[0][1]), (n + 2, "vileheap and vilegrub")]
    return (spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit(1)),
            spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int"))


def test_held_out_rows_are_told_apart(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score(docs, *model, out_col="s")
    assert scored.count() == docs.count() and scored.where("s < 0 OR s > 1 OR s IS NULL").count() == 0
    joined = scored.join(labels, "doc_id").where((toxicity.fold() == 1) & F.col("toxic").isNotNull()).select("toxic", "s").collect()
    assert sum((r["s"] >= 0.7) == (r["toxic"] == 1) for r in joined) >= 0.97 * len(joined)
    unseen = scored.where("text LIKE 'vileheap%'").collect()[0]
    assert unseen["s"] >= 0.7


def test_held_out_labels_are_not_read(spark):
    docs, labels = toxic_docs(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.score(docs, *toxicity.fit_toxicity(docs, x), out_col="s") for x in (labels, flipped))
    assert pairs(one.select("doc_id", "s")) == pairs(two.select("doc_id", "s"))


def test_without_labels(spark):
    docs, labels = toxic_docs(spark, 20)
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score(docs, *model, out_col="s").where("s > 0.001").count() == 0
    assert toxicity.score(docs.limit(0), *model, out_col="s").count() == 0


def test_pairs_add_what_single_terms_cannot():
    """Class 1 only where both terms stand: no additive model tells these apart with a margin on each side alike."""
    from tagflow.llm.factorization import FactorizationMachine

    texts = [[0], [1], [0, 1], [2]] * 50
    labels = np.array([1, 1, 0, 0] * 50)
    fm = FactorizationMachine(3).fit(np.concatenate(texts), np.cumsum([len(t) for t in texts]), labels, rounds=400, linear_decay=0, factor_decay=0)
    s = fm.scores(np.concatenate(texts[:4]), np.cumsum([len(t) for t in texts[:4]]))
    assert ((s > 0.5) == labels[:4]).all()


def test_a_pair_of_neutral_words_decides(spark):
    """Both words stand in half of the texts of either class; only one without the other is class 1."""
    import random

    rng = random.Random(4)
    fillers = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(200)]
    rows = []
    for k in range(1600):
        w = rng.sample(fillers, rng.randint(3, 40)) + ["korvanis"] * (k % 2) + ["meldrupo"] * (k // 2 % 2)
        rng.shuffle(w)
        rows.append((k, " ".join(w), int(k % 4 in (1, 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine, used = toxicity.fit_toxicity(docs, docs)
    for word in (b"korvanis", b"meldrupo"):
        place = np.searchsorted(used, toxicity.term_buckets(word)[0])
        assert used[place] == toxicity.term_buckets(word)[0] and np.abs(machine.factors[place]).max() > 0.05
    out = toxicity.score(docs, machine, used, out_col="s").where(toxicity.fold() == 1).select("toxic", "s").collect()
    assert sum((r["s"] >= 0.7) == (r["toxic"] == 1) for r in out) >= 0.97 * len(out)


# --- PII --------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def plain_spans(text):
    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if accepted(k, m.group()))


def pii_texts():
    import random

    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y.z_q@r.s", "@a.b", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.3.4", "4111111111111111",
             "4111 1111-1111 1111", "4111  1111 1111 1111", "12-34", "+1 (301) 555-0346", "+49--30", "++4930123456789", "é", "日本 ", " ", ".", "-",
             'token = "ede43f42c939b6405768150e0411590525cf889e"', "card 4111111111111112", "(301) 555-0346", "9" * 30, "mail: "]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(300)]


def test_base_spans_are_the_plain_ones(spark):
    docs = awkward_docs(spark, [None, "", *pii_texts(), "1 " * 20_000, "a" * 50_000 + "@", "1." * 20_000])
    found, spans = pii.find_pii(docs)
    for r in found.collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r[spans] if s["base"]]
        assert base == plain_spans(r["text"]), r["text"][:200]
    assert found.drop(spans).columns == docs.columns


def test_redaction_leaves_the_rest(spark):
    docs = awkward_docs(spark, ["Write a.b@c.de now", "é +1 (301) 555-0346!", None, "", "nothing", "x"])
    found, spans = pii.find_pii(docs)
    got = [r[0] for r in found.orderBy("row").select(pii.redacted(F.col("text"), F.col(spans))).collect()]
    assert "Write [EMAIL] now" in got and "é [PHONE]!" in got and "nothing" in got


def test_secrets_are_added_by_the_classifier(spark):
    key = hashlib.sha1(b"x").hexdigest()
    texts = [f'so token = "{hashlib.sha1(str(k).encode()).hexdigest()}" it goes {k}' for k in range(30)] + ["plain words only"] * 10
    found, spans = pii.find_pii(awkward_docs(spark, texts + [f'token = "{key}"']))
    n = found.select(F.explode(spans).alias("s")).where(F.col("s.kind") == pii.KINDS.index("secret")).count()
    assert n == 31


def test_expectation_maximisation_trusts_the_reliable():
    counts = [(0, (1, 1, 1, 1), 100), (0, (-1, -1, 0, -1), 100), (0, (1, 1, -1, 1), 5), (0, (-1, -1, 1, -1), 5)]
    belief, _ = pii.reliabilities(counts)
    assert belief[0, (1, 1, -1, 1)] > 0.9 and belief[0, (-1, -1, 1, -1)] < 0.1
    assert pii.train([]) == {}


def test_no_rows(spark):
    found, spans = pii.find_pii(awkward_docs(spark, []))
    assert found.count() == 0


# --- LM scores --------------------------------------------------------------------------------

def plain_scores(texts, alpha=0.4):
    per = [words(t) for t in texts]
    one, two = Counter(w for p in per for w in p), Counter(b for p in per for b in zip(p, p[1:]))
    total = sum(map(len, per))
    out = []
    for p in per:
        own1, own2, s = Counter(p), Counter(zip(p, p[1:])), 0.0
        n = max(total - len(p), 1)
        for k, w in enumerate(p):
            pair = two[p[k - 1], w] - own2[p[k - 1], w] if k else 0
            if pair:
                s += math.log(pair / (one[p[k - 1]] - own1[p[k - 1]]))
            else:
                s += math.log(max(one[w] - own1[w], 1) / n) + (math.log(alpha) if k else 0)
        out.append(s)
    return out


@pytest.mark.parametrize("range_bytes", [1_000_000, 1])
def test_scores_are_those_of_plain_counts(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(lm_scoring, "SLICE", 7)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 500)
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", range_bytes)
    docs = awkward_docs(spark).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((d, round(s, 6)) for (d, _), s in zip(rows, plain_scores([t for _, t in rows]))), key=repr)
    assert sorted(((r["doc_id"], round(r["log_score"], 6)) for r in lm_scoring.backoff_scores(docs).collect()), key=repr) == want


def test_slices_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 3)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 10)
    monkeypatch.setattr(lm_scoring.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 2})())
    texts = ["a" * 4, None, "b" * 6, "c" * 30, "", "", "", "", "d" * 9, "ee"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": pa.array(texts, pa.string())})
    got = list(lm_scoring.numbered_slices(iter([batch, batch.slice(0, 0), batch.slice(8)])))
    assert [p.column(0).to_pylist() for _, p in got] == [[0, 1, 2], [3], [4, 5, 6], [7, 8], [9], [8], [9]]
    assert [n - (2 << 32) for n, _ in got] == list(range(7))


def test_a_document_alone_and_no_document(spark):
    one = awkward_docs(spark, ["a b a b"]).where("doc_id = 0")
    assert round(lm_scoring.backoff_scores(one).collect()[0]["log_score"], 9) == round(3 * math.log(0.4), 9)
    assert lm_scoring.backoff_scores(awkward_docs(spark, [])).count() == 0
    deep = lm_scoring.backoff_scores(awkward_docs(spark, ["a b c d", "a b c e", "x", "y", "z", "b c d"]), order=3)
    assert deep.where("n_full > 0").count() == 5  # the last of these texts stands three times
