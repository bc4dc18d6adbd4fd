"""Collects the registered queries and oracle statements of all plan modules."""

from __future__ import annotations


def all_queries() -> dict:
    from . import hierarchy_queries, queries, sink_queries, stream_queries

    out = dict(queries.QUERIES)
    out.update(hierarchy_queries.QUERIES)
    out.update(stream_queries.QUERIES)
    out.update(sink_queries.QUERIES)
    return out


# Oracle columns DuckDB types as BIGINT where Spark yields int (row_number, size, depth).
INT_COLUMNS = {
    "depth_histogram": ["depth"], "distinctive_tags": ["rank"], "example_bundles": ["rank"],
    "example_posts": ["rank"], "group_members": ["depth"], "hierarchy_classify": ["depth"],
    "hierarchy_flat": ["depth"], "hierarchy_normalised": ["depth"], "items_under_path_list": ["depth"],
    "parse_tags": ["n_tags"], "stop_tag_filter": ["n_tags"],
    "top_cluster_examples": ["rank"], "top_tags_per_type": ["rank"],
    "children_by_depth": ["depth"], "nested_items": ["depth"],
}


def _typed(sql: str, cols: list[str]) -> str:
    rep = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql})"


def all_oracle_sql() -> dict:
    from . import hierarchy_oracle, oracle, sink_oracle

    out = dict(oracle.ORACLE)
    out.update(hierarchy_oracle.ORACLE)
    out.update(sink_oracle.ORACLE)
    return {k: _typed(v, INT_COLUMNS[k]) if k in INT_COLUMNS else v for k, v in out.items()}
