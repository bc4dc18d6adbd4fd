"""Folds over long arrays and cuts of long texts against plain forms; personal data in texts full of candidates."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tagflow.llm import arrays, pii


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_scan_is_a_running_sum(spark, n):
    values = list(range(n))
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(arrays.scan(F.col("v"), F.lit(5).cast("long"), "bigint", lambda s, x: (s + x, s)).alias("r")).collect()[0]["r"]
    assert got == [5 + sum(values[:k]) for k in range(n)]


def test_replaced_is_the_plain_cut(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 5, 300, 700):
        text = "".join(rng.choice("ab é😀\n") for _ in range(3000))
        spans = sorted((a, a + rng.randint(1, 12)) for a in (rng.randrange(2990) for _ in range(n)))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        rows.append((text, [{"start": a, "end": b} for a, b in spans], out + text[at:]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:long,end:long>>, wanted string")
    for r in df.withColumn("got", arrays.replaced(F.col("text"), F.col("spans"), lambda x: F.lit("#"))).collect():
        assert r["got"] == r["wanted"]


def test_a_base_match_shuts_out_what_it_overlaps(spark):
    """Checked against all pairs: no further candidate overlaps a match of a base pattern, and all others are there."""
    rng = random.Random(6)
    parts = ["(301) 555-0346", "+1 301 555 0346", "301-555-0346 x@y.de", "x (at) y.de", "4111111111111111", "a" * 30, "1.2.3.4", "b1c2d3e4f5a6b7c8d9e0f1a2b3c4@d.ef"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    alone = [F.transform(pii._found(text, s), lambda c: F.struct(c["start"], c["kind"], c["end"])).alias(f"s{n}") for n, s in enumerate(pii.shapes(text))]
    base = sum(s.base for s in pii.shapes(text))
    for r in pii.candidates(df.select("text", *alone)).collect():
        found = [[tuple(x) for x in r[f"s{n}"]] for n in range(len(alone))]
        taken = [x for f in found[:base] for x in f]
        more = [x for f in found[base:] for x in f if not any(x[0] < y[2] and y[0] < x[2] for y in taken)]
        assert [(c["start"], c["kind"], c["end"]) for c in r["candidates"]] == sorted(taken + more)


@pytest.mark.parametrize("text", [" ".join("a1b2c3" * 6 + f"{n:05x}" for n in range(20_000)), "1.2.3.4 " * 100_000], ids=["hex tokens", "addresses"])
def test_texts_full_of_candidates_take_seconds(spark, text):
    df = spark.createDataFrame([("warm 1.2.3.4",), (text,)], "text string")
    found = pii.candidates(df)
    found.where("length(text) < 100").select(F.size("candidates")).collect()  # planning and compilation
    long = found.where("length(text) > 100")
    begun = time.time()
    n = long.select(F.size("candidates")).collect()[0][0]
    assert time.time() - begun < 10 and n in (20_000, 100_000)
    cut = long.select(pii.redacted(F.col("text"), F.col("candidates"))).collect()[0][0]
    assert cut == (" ".join(["[SECRET]"] * 20_000) if n == 20_000 else "[IP] " * 100_000)
