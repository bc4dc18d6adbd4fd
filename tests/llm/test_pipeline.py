"""The pipeline's rows against plain forms of its stages on a small table."""

import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from tagflow.llm import bpe, pii, toxicity
from tagflow.sources.tables import read_table

from .helpers import awkward_docs, words
from .test_text_operators import fingerprint, groups, hits, plain_spans

SMALL = "/root/testdata/sf0.001"


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_are_those_of_the_stages_in_plain_form(spark):
    docs = read_table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, read_table(spark, SMALL, "labels"))
    rejected = {r["doc_id"] for r in toxicity.score(docs, *model).where("score >= 0.7").collect()}
    rows = {d: t for d, t in sorted(rows.items()) if d not in rejected}
    ids = list(rows)
    top = groups([fingerprint(rows[d]) for d in ids], 2)
    rows = {d: rows[d] for k, d in enumerate(ids) if top[k] == k}
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SMALL, "benchmark").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == set(rows)
    found = {d: n for d, _, n, _ in hits(list(rows.items()), items, 10)}
    clean = [d for d in rows if not found[d] and not any(k in rows[d] for k in ("@", "+", "token")) and not plain_spans(rows[d])]
    assert clean and any(found.values())
    ranks = bpe.read_ranks(P.path(bpe.RANKS))
    back = {n: b for b, n in ranks.items()}
    for d in rows:
        text = b"".join(back[i] for i in got[d]["ids"]).decode()
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert not plain_spans(text)
        if d in clean:
            assert text == rows[d]
        elif found[d]:
            assert len(words(text)) <= len(words(rows[d])) - found[d] + 10


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, k):
    docs = awkward_docs(spark)
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SMALL)
    assert out.dtypes == docs.dtypes
    assert out.count() <= docs.count()
    assert stage(spark, awkward_docs(spark, []), SMALL).count() == 0


def test_last_stage_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    assert corpus_pipeline.encode_and_decode(spark, docs, SMALL).count() == docs.count()
