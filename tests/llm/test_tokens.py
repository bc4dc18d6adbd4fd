"""Token counts, token files and the BPE transducer against the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tagflow.llm import bpe, token_counts, token_files
from tagflow.llm.bpe_transducer import Ranks, Transducer, Utf8Stream
from tagflow.session import state_path

from .helpers import awkward_docs, awkward_texts, pairs

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(spark, library):
    docs = awkward_docs(spark)
    got = pairs(token_counts.count_tokens(docs, JSON, limit=20), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 20))
    assert got == sorted(want, key=repr)


def test_whole_tokens_are_proved(library):
    whole = token_counts.vocabulary(JSON).whole
    assert len(whole) > 40_000
    some = sorted(whole)[::97]
    assert all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


def test_long_pretokens_merge_alike():
    vocab = token_counts.vocabulary(JSON)
    for n in (3, 47, 48, 49, 500):
        parts = list(("therenothing" * 50)[:n])
        assert token_counts.merge(parts[:], vocab.ranks) == token_counts.merge_long(parts[:], vocab.ranks)


def test_files_hold_every_id_in_order(spark, library):
    docs = awkward_docs(spark)
    folder = state_path(spark, "test-files")
    manifest = token_files.write_token_files(docs, folder, JSON)
    rows = docs.select("doc_id", "text").collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert manifest.agg({"n_ids": "sum"}).collect()[0][0] == total
    assert {r["dtype"] for r in manifest.collect()} == {"<u2"}
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(ids) == len(rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = []
    for d, t in rows:
        x = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((d, len(x), zlib.crc32(x.tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    none = awkward_docs(spark, [])
    folder = state_path(spark, "test-empty")
    token_files.write_token_files(none, folder, JSON)
    assert token_files.read_token_files(spark, folder).count() == 0
    assert token_counts.count_tokens(none, JSON).count() == 0
    assert bpe.digests(none, RANKS).count() == 0


def test_digests_are_those_of_the_library(spark, tik):
    docs = awkward_docs(spark)
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = tik.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert pairs(bpe.digests(docs, RANKS)) == sorted(want, key=repr)
    slim = docs.select("row", "text")
    apart = bpe.decode(bpe.encode(slim, RANKS), RANKS)
    assert pairs(apart, "row", "ids", "decoded") == pairs(bpe.encode_decode(slim, RANKS), "row", "ids", "decoded")


def test_transducer_equals_merging(tik):
    table = Ranks(bpe.read_ranks(RANKS))
    machine = Transducer(table)
    import random

    rng = random.Random(1)
    for n in (1, 2, 5, 30, 1023, 1024, 1025, 5000):
        for letters in (b"ab", b"the and", bytes(range(256))):
            data = bytes(rng.choice(letters) for _ in range(n))
            merged = [table.ranks[p] for p in table.parts(data, 1 << 30)]
            assert machine.encode(data) == ([table.ranks[data]] if data in table.ranks else merged)
    assert len(machine.state) <= len(machine.trie)


def test_decoding_streams(tik):
    table = Ranks(bpe.read_ranks(RANKS))
    for text in awkward_texts():
        ids = tik.encode_ordinary(text or "")
        stream = Utf8Stream(table.bytes_of)
        assert "".join([stream.feed([i]) for i in ids]) + stream.end() == (text or "")
    stream = Utf8Stream(table.bytes_of)
    assert stream.feed([table.ranks[b"\xe2"]]) + stream.end() == "�"
