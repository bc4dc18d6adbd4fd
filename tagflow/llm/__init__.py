"""Operators of a training-data pipeline; each module holds an operator, its query and its SQL."""

from . import (ann, bpe, conversation_repair, decontamination, lm_scoring, pii, sharding, simhash, token_counts, token_files,
               topk, toxicity, whitening)

MODULES = (ann, bpe, conversation_repair, decontamination, lm_scoring, pii, sharding, simhash, token_counts, token_files,
           topk, toxicity, whitening)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE_SQL.update(_m.ORACLE_SQL)
