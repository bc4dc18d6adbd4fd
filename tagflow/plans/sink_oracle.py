"""Oracle SQL (DuckDB) for the queries that write and read back, and for stored summaries."""

from __future__ import annotations

from . import hierarchy_oracle as HO
from . import oracle as O
from . import sink_queries as S

# Bounds and values of its own, not taken from the code under test.
SIZES = ", ".join(f"({n}, '{label}')" for n, label in zip(S.WRITTEN_SIZES, ("top100", "top1k"), strict=True))
EXAMPLES = """,
ex AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id ASC) AS rank FROM pc)"""
OVERVIEW = """,
nodes AS (SELECT src AS n FROM merged UNION SELECT dst FROM merged),
facts AS (SELECT (SELECT count(*) FROM filtered) AS posts, (SELECT count(*) FROM freq) AS tags, (SELECT count(*) FROM nodes) AS nodes,
                 (SELECT count(*) FROM merged) AS edges, (SELECT count(DISTINCT cluster_id) FROM cmap) AS clusters)"""
FULL_GRAPH = O.BASE + O._graph() + O.WIKI + O._links("section") + O.MERGED + O.CLUSTERS

ORACLE: dict[str, str] = {
    "samples_written": "WITH" + O.POSTS + O.SCORED + f""",
        rk AS (SELECT *, row_number() OVER (ORDER BY score_per_hour DESC, id ASC) AS rank FROM scored2),
        taken AS (SELECT s.label AS sample_label, rk.id, rk.rank, rk.score,
            (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY s.label)) // 3600000000 + 1 AS hours
          FROM rk JOIN (VALUES {SIZES}) AS s(n, label) ON rk.rank <= s.n)
        SELECT sample_label, id, rank, CAST(hours AS BIGINT) AS hours_since_start, round(score / CAST(hours AS DOUBLE), 9) AS score_per_hour FROM taken""",
    "tag_counts_written": "WITH" + O.POSTS + O.TAGCOUNT + " SELECT tag, tag_type, count FROM withall",
    "genre_tables": FULL_GRAPH + EXAMPLES + """ SELECT m.cluster_id, m.num_posts, m.num_unique_tags, round(m.demand_median, 9) AS demand_median,
        round(m.opportunity, 9) AS opportunity, t.member_tags, e.ids AS top_post_ids
        FROM metrics m LEFT JOIN (SELECT cluster_id, count(*) AS member_tags FROM cmap GROUP BY cluster_id) t USING (cluster_id)
        LEFT JOIN (SELECT cluster_id, string_agg(CAST(id AS VARCHAR), '|' ORDER BY rank) AS ids FROM ex WHERE rank <= 5 GROUP BY cluster_id) e USING (cluster_id)""",
    "report_lines": FULL_GRAPH + EXAMPLES + OVERVIEW + """ SELECT 'overview' AS part, line FROM (
          SELECT unnest(['posts: ' || posts, 'general tags: ' || tags, 'graph nodes: ' || nodes, 'graph edges: ' || edges, 'clusters: ' || clusters]) AS line FROM facts)
        UNION ALL SELECT 'example_posts', 'Cluster ' || ex.cluster_id || ' example ' || rank || ': ' || ex.id || ':' || ex.score || ', tags='
          || array_to_string(list_slice(f.tags, 1, 20), ', ')
        FROM ex JOIN filtered f ON f.id = ex.id WHERE rank <= 5 AND ex.cluster_id IN (
          SELECT cluster_id FROM metrics WHERE num_posts >= 50 ORDER BY opportunity DESC, cluster_id ASC LIMIT 20)""",
    "few_cluster_examples": O.BASE + O._graph() + O.CLUSTERS + EXAMPLES + """ SELECT cluster_id, rank, id, score FROM ex WHERE rank <= 5 AND cluster_id IN (
        SELECT cluster_id FROM metrics WHERE num_posts >= 50 ORDER BY opportunity DESC, cluster_id ASC LIMIT 2)""",
    "rating_filter_values": "WITH" + O.POSTS + """ SELECT f.filter, count(*) AS posts FROM active a JOIN (VALUES ('safe', 'gs'), ('nsfw', 'qe'), ('any', 'gsqe'))
        AS f(filter, kept) ON contains(f.kept, a.rating) GROUP BY f.filter""",
    "hierarchy_run_written": HO.SITE + """, """ + HO.EXPANDED + """ SELECT name, path,
        CASE WHEN contains(lower(name), 'tag group') THEN 'traditional_tag_group' WHEN has_nested AND linked THEN 'tag_and_tag_group'
             WHEN has_nested THEN 'tag_group_only' ELSE 'final_tag_only' END AS classification,
        CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM best""",
    "nested_json_items": "SELECT * REPLACE (CAST(depth AS INTEGER) AS depth) FROM (" + HO.ORACLE["hierarchy_flat"] + ")",
    "items_under_path_sql": HO.W + """ SELECT c.name, t.classification_name, CAST(c.depth AS INTEGER) AS depth FROM cons c
        JOIN tcls t ON t.classification_name = c.classification
        WHERE c.name IN (SELECT DISTINCT tag_id FROM tpaths WHERE path_value ILIKE '%brand#%') ORDER BY c.depth, c.name LIMIT 20""",
    "items_under_path_sql_count": HO.W + " SELECT count(DISTINCT tag_id) AS items FROM tpaths WHERE path_value ILIKE '%brand#%'",
    "ignored_items": HO.SITE + """,
        gone AS (SELECT page_id, brand FROM page_rows WHERE leaf = '' AND contains(lower(name), 'brand#1') AND brand <> ''),
        rows AS (
          SELECT page_id, 'ignored' AS kind FROM gone
          UNION ALL SELECT page_id, 'item' FROM page_rows p WHERE (page_id, brand) NOT IN (SELECT (page_id, brand) FROM gone)
          UNION ALL SELECT 0, CASE WHEN starts_with(name, 'first ') AND contains(lower(name), 'brand#1') THEN 'ignored' ELSE 'item' END
            FROM site_items WHERE page_id = 0)
        SELECT page_id, kind, count(*) AS rows FROM rows GROUP BY page_id, kind""",
    "ignored_log": HO.SITE + """,
        texts AS (SELECT name FROM page_rows WHERE leaf = '' AND brand <> '' AND contains(lower(name), 'brand#1')
          UNION ALL SELECT name FROM site_items WHERE page_id = 0 AND starts_with(name, 'first ') AND contains(lower(name), 'brand#1'))
        SELECT 'ignored_element' AS source, name AS original, lower(name) AS normalized, count(*) AS rows FROM texts WHERE lower(name) <> name GROUP BY name""",
    "tag_group_base_names": HO.W + """,
        x AS (SELECT string_split(name, ':')[-1] AS x FROM norm WHERE starts_with(name, 'tag group:')),
        planted AS (SELECT 'tag group:' || x AS name, trim(x) AS base FROM x
          UNION ALL SELECT 'tag group:' || chr(9) || x || ' tags ' || chr(10), trim(x || ' tags') FROM x
          UNION ALL SELECT 'tag group: ' || chr(13) || x || ' tags', trim(x || ' tags') FROM x)
        SELECT name, base, CASE WHEN ends_with(base, ' tags') THEN replace(base, ' tags', '') END AS alt FROM planted""",
    "hierarchy_cycles": HO.W.replace("WITH ", "WITH RECURSIVE ", 1) + """,
        deep AS (SELECT path[1] AS name, min(name) AS parent FROM cons WHERE len(path) >= 3 GROUP BY path[1]),
        links AS (SELECT name AS node, min(parent) AS parent FROM (SELECT name, parent FROM cons UNION ALL SELECT name, parent FROM deep)
                  WHERE parent IS NOT NULL GROUP BY name),
        walk AS (SELECT node AS origin, parent AS here, [node] AS seen FROM links
                 UNION ALL SELECT w.origin, l.parent, list_append(w.seen, w.here) FROM walk w JOIN links l ON l.node = w.here
                 WHERE NOT list_contains(w.seen, w.here))
        SELECT list_min(seen) AS "cycle", origin AS node, links.parent, len(seen) AS length FROM walk JOIN links ON links.node = origin WHERE here = origin""",
    "tag_counts_compacted": "WITH" + O.POSTS + O.TAGCOUNT + " SELECT tag, tag_type, count FROM bytype",
    "column_profile_sketched": "WITH" + O.POSTS + O.WIKI + "".join(
        f""" {'UNION ALL ' if n else ''}SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS rows, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
        true AS distinct_within, {'true' if c in ('id', 'score') else 'CAST(NULL AS BOOLEAN)'} AS quantiles_within FROM {t}"""
        for n, (t, c) in enumerate([("posts", c) for c in ("id", "score", "rating", "general", "artist")] + [("wiki", c) for c in ("id", "title", "tag", "body")])),
    "relational_posts": O.BASE + " SELECT post_id, score, CAST(len(tags) AS BIGINT) AS n_tags, tags[1] AS first_tag FROM filtered WHERE len(tags) > 0",
    "relational_tag_pages": O.BASE + O._graph() + O.WIKI + """ SELECT freq.tag, freq, wiki.id AS wiki_id, CAST(2 AS BIGINT) AS other_names
        FROM freq JOIN wiki ON coalesce(nullif(wiki.tag, ''), nullif(wiki.title, '')) = freq.tag""",
    "trait_swap": O.BASE + """,
        words AS (SELECT DISTINCT unnest(tags) AS tag FROM filtered),
        swaps AS (SELECT tag, 'hot' || substr(tag, 4) AS swapped FROM words
                  WHERE starts_with(tag, 'red ') AND 'hot' || substr(tag, 4) IN (SELECT tag FROM words)),
        long AS (SELECT post_id, generate_subscripts(tags, 1) AS i, unnest(tags) AS tag FROM filtered),
        met AS (SELECT post_id, i, coalesce(swapped, long.tag) AS tag, swapped IS NOT NULL AS hit FROM long LEFT JOIN swaps ON swaps.tag = long.tag)
        SELECT f.post_id, coalesce(string_agg(m.tag, '|' ORDER BY i), '') AS tags, count(*) FILTER (WHERE hit) AS n_swapped
        FROM filtered f LEFT JOIN met m USING (post_id) GROUP BY f.post_id""",
}
