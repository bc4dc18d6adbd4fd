"""Oracle SQL (DuckDB dialect) for the registered queries, over the raw test tables.

Each statement re-derives the adapter tables with plain SQL and computes the operator the
textbook way (self joins, windows), independent of the Spark plans it checks.
"""

from __future__ import annotations

from . import queries as Q

# Literals of its own: what the queries must find, not what the code under test says.
LINK_RE = r"\[\[([^\]]+)\]\]"
PARITY_SECTION_RE = r"(?s)^(.*[Ss]ee\s+also.*?)(?:h[1-6]\.|\n|$)"
SECTION_RE = r"(?s)^.*[Ss]ee\s+also(.*?)(?:\nh[1-6]\.|$)"
DEFAULT_BLOCKLIST = ('guro', 'gore', 'dismemberment', 'decapitation', 'corpse', 'blood', 'extreme_content', 'death', 'violence', 'injury')


def _lst(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


POSTS = """
lines AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_linestatus,
         p.p_name, p.p_brand, p.p_type, s.s_name
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
per_order AS (
  SELECT l_orderkey,
    string_agg(p_name, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS general,
    string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS character,
    string_agg(p_type, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS copyright,
    string_agg(s_name, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS artist,
    string_agg(l_returnflag || ' ' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS meta
  FROM lines GROUP BY l_orderkey),
posts AS (
  SELECT o.o_orderkey AS id,
    strftime(o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '.000+00:00' AS created_at,
    CAST(floor(o.o_totalprice / 1000) AS BIGINT) - 10 AS score,
    CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'g' WHEN '2' THEN 's' WHEN '3' THEN 'q' ELSE 'e' END AS rating,
    o.o_orderkey % 10 = 0 AS is_deleted, o.o_orderkey % 83 = 0 AS is_banned,
    a.general, a.character, a.copyright, a.artist,
    CASE WHEN o.o_orderkey % 70 = 0 THEN NULL ELSE a.meta END AS meta
  FROM orders o JOIN per_order a ON o.o_orderkey = a.l_orderkey),
active AS (SELECT * FROM posts WHERE NOT is_deleted AND NOT is_banned AND score > 0)"""


def _parse(col: str) -> str:
    g = f"regexp_replace(coalesce({col}, ''), '^\\s+|\\s+$', '', 'g')"
    return (f"list_filter(list_transform(CASE WHEN contains({g}, ',') THEN string_split({g}, ',') "
            f"ELSE string_split({g}, ' ') END, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')")


def _filtered(blocklist=DEFAULT_BLOCKLIST, stop=None, name="filtered") -> str:
    tags = _parse("general")
    if stop:
        tags = f"list_filter({tags}, lambda x: NOT list_contains({_lst(stop)}, x))"
    return f""",
{name}_t AS (SELECT *, id AS post_id, {tags} AS tags FROM active WHERE rating IN ('q', 'e')),
{name} AS (SELECT * FROM {name}_t WHERE NOT list_has_any(tags, {_lst(blocklist)}))"""


BASE = "WITH " + POSTS + _filtered()

SCORED = """,
scored0 AS (SELECT *, CAST(created_at AS TIMESTAMPTZ) AS ts FROM active),
scored AS (SELECT *, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM scored0)) // 3600000000 AS BIGINT) + 1 AS hours_since_start
           FROM scored0),
scored2 AS (SELECT *, score / CAST(hours_since_start AS DOUBLE) AS score_per_hour FROM scored)"""


def _graph(cap=Q.GRAPH["max_tags_per_post"], method="pmi") -> str:
    g = Q.GRAPH
    w = "ln(CAST(p.cooccur AS DOUBLE) * n.n / (CAST(fl.freq AS DOUBLE) * fr.freq))"
    if method == "lift":
        w = "CAST(p.cooccur AS DOUBLE) * n.n / (CAST(fl.freq AS DOUBLE) * fr.freq)"
    elif method != "pmi":
        w = "CAST(p.cooccur AS DOUBLE)"
    having = f"WHERE {w} > 0" if method == "pmi" else ""
    limit = f" LIMIT {g['top_k_tags']}" if g["top_k_tags"] else ""
    cut = f" WHERE r <= {cap}" if cap else ""
    return f""",
long AS (SELECT post_id, unnest(tags) AS tag FROM filtered),
freq AS (SELECT tag, count(*) AS freq FROM long WHERE tag <> '' GROUP BY tag),
vocab AS (SELECT tag, freq FROM freq WHERE freq >= {g['min_freq']} ORDER BY freq DESC, tag ASC{limit}),
lv AS (SELECT l.post_id, l.tag, v.freq FROM long l JOIN vocab v ON l.tag = v.tag),
ranked AS (SELECT post_id, tag, row_number() OVER (PARTITION BY post_id ORDER BY freq DESC, tag ASC) AS r FROM lv),
capped AS (SELECT post_id, tag FROM ranked{cut}),
pairs AS (SELECT a.tag AS tag_left, b.tag AS tag_right, count(*) AS cooccur
          FROM capped a JOIN capped b ON a.post_id = b.post_id AND a.tag < b.tag
          GROUP BY a.tag, b.tag HAVING count(*) >= {g['min_cooccur']}),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM filtered),
edges AS (SELECT p.tag_left, p.tag_right, p.cooccur, fl.freq AS freq_left, fr.freq AS freq_right, {w} AS weight
          FROM pairs p JOIN vocab fl ON fl.tag = p.tag_left JOIN vocab fr ON fr.tag = p.tag_right, n {having})"""


WIKI = """,
wnames AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name),
wn AS (SELECT w.id, w.p_name AS title, CASE WHEN w.id % 9 = 0 THEN NULL ELSE w.p_name END AS tag,
              coalesce(nx.p_name, w.p_name) AS nx, coalesce(pv.p_name, w.p_name) AS pv
       FROM wnames w LEFT JOIN part nx ON nx.p_partkey = w.id + 1 LEFT JOIN part pv ON pv.p_partkey = w.id - 1),
wiki AS (SELECT id, title, tag, CASE
    WHEN id % 5 <= 1 THEN 'Intro [[' || pv || ']].' || chr(10) || 'h4. See also' || chr(10) || '* [[' || nx || ']]' || chr(10) || 'h4. Notes' || chr(10) || '[[' || pv || ']]'
    WHEN id % 5 = 2 THEN 'Related to [[' || nx || ']], see also [[' || pv || ']]'
    WHEN id % 5 = 3 THEN 'Nothing here. [[' || nx || ']]'
    ELSE 'Intro [[' || pv || ']]' || chr(10) || 'See Also' || chr(10) || '[[' || nx || '|alias]]' END AS body
  FROM wn)"""


def _links(mode="section") -> str:
    sec = PARITY_SECTION_RE if mode == "parity" else SECTION_RE
    tail = "right(body, 2000)" if mode == "parity" else "body"
    return f""",
pl AS (SELECT coalesce(nullif(tag, ''), nullif(title, '')) AS tag,
         CASE WHEN regexp_matches(body, '[Ss]ee\\s+also') THEN regexp_extract_all(regexp_extract(body, '{sec}', 1), '{LINK_RE}', 1)
              WHEN contains(lower({tail}), 'see') OR contains(lower({tail}), 'also')
                THEN regexp_extract_all({tail}, '{LINK_RE}', 1) END AS links
       FROM wiki WHERE body IS NOT NULL),
pl2 AS (SELECT * FROM pl WHERE tag IS NOT NULL AND links IS NOT NULL),
linked AS (SELECT DISTINCT tag, unnest(links) AS link FROM pl2),
links AS (SELECT tag, link FROM linked
          UNION ALL SELECT DISTINCT tag, CAST(NULL AS VARCHAR) FROM pl2 WHERE tag NOT IN (SELECT tag FROM linked))"""


MERGED = f""",
lp AS (SELECT tag, link FROM links WHERE link IS NOT NULL AND ((SELECT count(*) FROM vocab) = 0
        OR (tag IN (SELECT tag FROM vocab) AND link IN (SELECT tag FROM vocab)))),
u AS (SELECT tag_left AS src, tag_right AS dst, weight, 1 AS is_cooc FROM edges
      UNION ALL SELECT least(tag, link), greatest(tag, link), {Q.WIKI_WEIGHT}, 0 FROM lp),
merged AS (SELECT src, dst, sum(weight) AS weight, max(is_cooc) AS from_cooccurrence,
                  CAST(sum(1 - is_cooc) AS BIGINT) AS wiki_links FROM u GROUP BY src, dst)"""


CLUSTERS = f""",
cmap AS (SELECT tag, CAST(length(tag) % {Q.N_FIXED_CLUSTERS} AS BIGINT) AS cluster_id FROM vocab),
hits AS (SELECT f.post_id, f.id, f.score, f.created_at, c.cluster_id, count(*) AS tag_hits
         FROM (SELECT post_id, id, score, created_at, unnest(tags) AS tag FROM filtered) f JOIN cmap c ON f.tag = c.tag
         GROUP BY f.post_id, f.id, f.score, f.created_at, c.cluster_id),
pc AS (SELECT post_id, id, score, created_at, cluster_id, tag_hits FROM (
         SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY tag_hits DESC, cluster_id ASC) AS r FROM hits) WHERE r = 1),
q AS (SELECT cluster_id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY score) AS rn,
             count(*) OVER (PARTITION BY cluster_id) AS n FROM pc),
qs AS (SELECT cluster_id, max(n) AS n,
         avg(CASE WHEN rn = floor((n + 1) / 2) OR rn = floor(n / 2) + 1 THEN CAST(score AS DOUBLE) END) AS demand_median,
         max(CASE WHEN rn = floor(((n - 1) * 9 + 5) / 10) + 1 THEN score END) AS q90,
         max(score) AS demand_max, min(score) AS demand_min FROM q GROUP BY cluster_id),
top AS (SELECT pc.cluster_id, avg(CAST(pc.score AS DOUBLE)) AS demand_top10_avg FROM pc JOIN qs ON pc.cluster_id = qs.cluster_id
        WHERE pc.score >= qs.q90 GROUP BY pc.cluster_id),
rep AS (SELECT cluster_id, count(*) AS num_unique_tags,
          array_to_string(list_slice(list(tag ORDER BY freq DESC, tag ASC), 1, 20), '|') AS representative_tags,
          array_to_string(list_slice(list(tag ORDER BY freq DESC, tag ASC), 1, 15), '|') AS rep15
        FROM (SELECT c.cluster_id, c.tag, coalesce(v.freq, 0) AS freq FROM cmap c LEFT JOIN vocab v ON c.tag = v.tag)
        GROUP BY cluster_id),
metrics AS (SELECT qs.cluster_id, CAST(qs.n AS BIGINT) AS num_posts, rep.num_unique_tags, qs.demand_median, top.demand_top10_avg,
                   qs.demand_max, qs.demand_min, CAST(qs.n AS BIGINT) AS competition, 0.0::DOUBLE AS trend_score,
                   qs.demand_median - ln(CAST(qs.n AS DOUBLE)) AS opportunity, rep.representative_tags, rep.rep15
            FROM qs JOIN top ON qs.cluster_id = top.cluster_id LEFT JOIN rep ON qs.cluster_id = rep.cluster_id)"""

METRICS_COLS = ("cluster_id, num_posts, num_unique_tags, round(demand_median, 9) AS demand_median, "
                "round(demand_top10_avg, 9) AS demand_top10_avg, demand_max, demand_min, competition, trend_score, "
                "round(opportunity, 9) AS opportunity, representative_tags")

EDGE_COLS = "tag_left, tag_right, cooccur, freq_left, freq_right, round(weight, 9) AS weight"

TAGCOUNT = """,
typed AS (SELECT 'general' AS tag_type, general AS s FROM active UNION ALL SELECT 'character', character FROM active
          UNION ALL SELECT 'copyright', copyright FROM active UNION ALL SELECT 'artist', artist FROM active
          UNION ALL SELECT 'meta', meta FROM active),
tl AS (SELECT tag_type, unnest(list_filter(list_transform(string_split(coalesce(s, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS tag FROM typed),
bytype AS (SELECT tag, tag_type, count(*) AS count FROM tl GROUP BY tag, tag_type),
withall AS (SELECT tag, tag_type, count FROM bytype UNION ALL SELECT tag, 'all', CAST(sum(count) AS BIGINT) FROM bytype GROUP BY tag)"""


ORACLE: dict[str, str] = {
    "active_posts": "WITH" + POSTS + " SELECT id, created_at, score, rating, general, character, copyright, artist, meta FROM active",
    "rating_filter": "WITH" + POSTS + " SELECT id, rating FROM active WHERE rating IN ('q', 'e')",
    "rating_distribution": "WITH" + POSTS + " SELECT rating, count(*) AS posts FROM active GROUP BY rating",
    "filter_rate": "WITH" + POSTS + """ SELECT CAST(sum(CASE WHEN NOT is_deleted AND NOT is_banned AND score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
        count(*) AS total, round(sum(CASE WHEN NOT is_deleted AND NOT is_banned AND score > 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS rate FROM posts""",
    "first_n": "WITH" + POSTS + f" SELECT id, score FROM posts ORDER BY id LIMIT {Q.FIRST_N}",
    "score_range": "WITH" + POSTS + """ SELECT min(score) AS min_score, max(score) AS max_score,
        min(created_at) AS min_created_at, max(created_at) AS max_created_at FROM active""",
    "parse_tags": BASE + " SELECT post_id, len(tags) AS n_tags, array_to_string(tags, '|') AS tags FROM filtered",
    "blocklist_filter": "WITH" + POSTS + _filtered(Q.FIXTURE_BLOCKLIST) + " SELECT post_id FROM filtered",
    "blocked_count": "WITH" + POSTS + _filtered(Q.FIXTURE_BLOCKLIST) + """ SELECT
        CAST(sum(CASE WHEN list_has_any(tags, """ + _lst(Q.FIXTURE_BLOCKLIST) + """) THEN 1 ELSE 0 END) AS BIGINT) AS blocked_posts,
        count(*) AS checked_posts FROM filtered_t""",
    "stop_tag_filter": "WITH" + POSTS + _filtered(stop=Q.FIXTURE_STOP_TAGS) +
        " SELECT post_id, len(tags) AS n_tags, array_to_string(tags, '|') AS tags FROM filtered",
    "tag_frequency": BASE + " SELECT tag, count(*) AS freq FROM (SELECT unnest(tags) AS tag FROM filtered) WHERE tag <> '' GROUP BY tag",
    "score_per_hour": "WITH" + POSTS + SCORED + " SELECT id, hours_since_start, round(score_per_hour, 9) AS score_per_hour FROM scored2",
    "top_n": "WITH" + POSTS + SCORED + f""" SELECT id, score, hours_since_start, round(score_per_hour, 9) AS score_per_hour
        FROM scored2 ORDER BY score_per_hour DESC, id ASC LIMIT {Q.TOP_N}""",
    "top_n_large": "WITH" + POSTS + SCORED + f""", ranked AS (
        SELECT id, row_number() OVER (ORDER BY score_per_hour DESC, id ASC) AS rank, round(score_per_hour, 9) AS score_per_hour FROM scored2)
        SELECT * FROM ranked WHERE rank <= {Q.TOP_N_LARGE}""",
    "top_n_sizes": "WITH" + POSTS + SCORED + """,
        rk AS (SELECT id, row_number() OVER (ORDER BY score_per_hour DESC, id ASC) AS rank FROM scored2),
        sizes AS (SELECT CAST(unnest(""" + "[" + ", ".join(str(s) for s in Q.SAMPLE_SIZES) + """]) AS BIGINT) AS sample_size)
        SELECT CASE WHEN sample_size % 1000000 = 0 THEN 'top' || CAST(sample_size // 1000000 AS VARCHAR) || 'm'
                    WHEN sample_size % 1000 = 0 THEN 'top' || CAST(sample_size // 1000 AS VARCHAR) || 'k'
                    ELSE 'top' || CAST(sample_size AS VARCHAR) END AS sample_label,
               sample_size, rank, id
        FROM rk JOIN sizes ON rk.rank <= sizes.sample_size WHERE sample_size <= (SELECT count(*) FROM active)""",
    "rebased_sample": "WITH" + POSTS + SCORED + f""",
        top AS (SELECT * FROM scored2 ORDER BY score_per_hour DESC, id ASC LIMIT {Q.TOP_N}),
        rb AS (SELECT *, CAST((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM top)) // 3600000000 AS BIGINT) + 1 AS h2 FROM top)
        SELECT id, round(score_per_hour, 9) AS rank_score_per_hour, h2 AS hours_since_start,
               round(score / CAST(h2 AS DOUBLE), 9) AS score_per_hour FROM rb""",
    "random_n": "WITH" + POSTS + f""" SELECT id, score FROM active
        ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT {Q.RANDOM_N}""",
    "random_n_spread": "WITH" + POSTS + f""" SELECT least({Q.RANDOM_N}, count(*)) AS rows, least({Q.RANDOM_N}, count(*)) AS distinct_ids,
        CAST(0 AS BIGINT) AS outside, true AS fair_in_every_tenth, count(*) > {Q.RANDOM_N} AS seeds_differ FROM active""",
    "parse_tags_whitespace": "WITH" + POSTS + """ SELECT id,
        array_to_string(CASE WHEN contains(general, ',') THEN string_split(general, ',') ELSE string_split(general, ' ') END, '|') AS tags,
        replace(general, ',', '|') AS comma_tags FROM active""",
    "created_lenient": "WITH" + POSTS + """ SELECT id, CAST(CASE id % 4 WHEN 0 THEN epoch(CAST(substr(created_at, 1, 10) AS TIMESTAMP)) WHEN 1 THEN NULL
        ELSE epoch(CAST(replace(substr(created_at, 1, 19), 'T', ' ') AS TIMESTAMP)) END AS BIGINT) AS seconds FROM active""",
    "sample_stats": "WITH" + POSTS + SCORED + """,
        rk AS (SELECT rating, score, row_number() OVER (ORDER BY score_per_hour DESC, id ASC) AS rank FROM scored2),
        sizes AS (SELECT CAST(unnest([""" + ", ".join(str(x) for x in Q.SAMPLE_SIZES) + """]) AS BIGINT) AS n)
        SELECT CASE WHEN n % 1000000 = 0 THEN 'top' || (n // 1000000) || 'm' WHEN n % 1000 = 0 THEN 'top' || (n // 1000) || 'k' ELSE 'top' || n END AS sample_label,
          count(*) AS rows, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (rating = 's') AS s, count(*) FILTER (rating = 'q') AS q,
          count(*) FILTER (rating = 'g') AS g, count(*) FILTER (rating = 'e') AS e
        FROM rk JOIN sizes ON rk.rank <= n WHERE n <= (SELECT count(*) FROM active) GROUP BY n""",
    "tag_counts_by_type": "WITH" + POSTS + TAGCOUNT + " SELECT tag, tag_type, count FROM bytype",
    "tag_counts_all": "WITH" + POSTS + TAGCOUNT + " SELECT tag, tag_type, count FROM withall",
    "top_tags_per_type": "WITH" + POSTS + TAGCOUNT + """ SELECT tag_type, rank, tag, count FROM (
        SELECT tag_type, row_number() OVER (PARTITION BY tag_type ORDER BY count DESC, tag ASC) AS rank, tag, count FROM withall)
        WHERE rank <= 20""",
    "tag_count_stats": "WITH" + POSTS + TAGCOUNT + """ SELECT tag_type, count(*) AS distinct_tags,
        CAST(sum(count) AS BIGINT) AS occurrences FROM withall GROUP BY tag_type""",
    "vocabulary": BASE + _graph() + " SELECT tag, freq FROM freq WHERE freq >= 400",
    "vocabulary_top_k": BASE + _graph() + " SELECT tag, freq FROM vocab ORDER BY freq DESC, tag LIMIT 40",
    "cooccur_counts": BASE + _graph(method="count") + f" SELECT {EDGE_COLS} FROM edges",
    "cooccur_pmi": BASE + _graph() + f" SELECT {EDGE_COLS} FROM edges",
    "cooccur_lift": BASE + _graph(method="lift") + f" SELECT {EDGE_COLS} FROM edges",
    "cooccur_capped": BASE + _graph(cap=Q.CAPPED_TAGS_PER_POST) + f" SELECT {EDGE_COLS} FROM edges",
    "adjacency": BASE + _graph() + """ SELECT tag_left AS tag, tag_right AS neighbor, round(weight, 9) AS weight FROM edges
        UNION ALL SELECT tag_right, tag_left, round(weight, 9) FROM edges""",
    "communities_louvain_invariants": BASE + _graph() + WIKI + _links("section") + MERGED + """ SELECT count(*) AS nodes, count(*) AS distinct_nodes,
        CAST(0 AS BIGINT) AS missing, true AS connected, true AS no_worse_than_fixed, true AS numbered, CAST(0 AS BIGINT) AS unsettled
        FROM (SELECT src AS tag FROM merged UNION SELECT dst FROM merged)""",
    "communities_leiden_invariants": BASE + _graph() + WIKI + _links("section") + MERGED + """ SELECT count(*) AS nodes, count(*) AS distinct_nodes,
        CAST(0 AS BIGINT) AS missing, true AS connected, true AS no_worse_than_fixed, true AS numbered, CAST(0 AS BIGINT) AS unsettled,
        true AS no_worse_than_louvain FROM (SELECT src AS tag FROM merged UNION SELECT dst FROM merged)""",
    "communities_lp_invariants": BASE + _graph() + WIKI + _links("section") + MERGED + """ SELECT count(*) AS nodes, count(*) AS distinct_nodes,
        CAST(0 AS BIGINT) AS missing, true AS connected, true AS numbered, CAST(0 AS BIGINT) AS unsettled
        FROM (SELECT src AS tag FROM merged UNION SELECT dst FROM merged)""",
    "see_also_links": "WITH" + POSTS + WIKI + _links("section") + " SELECT tag, link FROM links",
    "see_also_links_parity": "WITH" + POSTS + WIKI + _links("parity") + " SELECT tag, link FROM links",
    "merged_graph": BASE + _graph() + WIKI + _links() + MERGED +
        " SELECT src, dst, round(weight, 9) AS weight, from_cooccurrence, wiki_links FROM merged",
    "graph_size": BASE + _graph() + WIKI + _links() + MERGED + """ SELECT
        (SELECT count(*) FROM (SELECT src AS n FROM merged UNION SELECT dst FROM merged)) AS nodes,
        (SELECT count(*) FROM merged) AS edges""",
    "post_cluster": BASE + _graph() + CLUSTERS + " SELECT post_id, cluster_id, tag_hits FROM pc",
    "cluster_metrics": BASE + _graph() + CLUSTERS + f" SELECT {METRICS_COLS} FROM metrics",
    "distinctive_tags": BASE + _graph() + CLUSTERS + """,
        tlc AS (SELECT t.tag, p.cluster_id FROM (SELECT post_id, unnest(tags) AS tag FROM filtered) t JOIN pc p ON t.post_id = p.post_id
                WHERE t.tag IS NOT NULL AND t.tag <> ''),
        gt AS (SELECT tag, count(*) AS global_posts FROM tlc GROUP BY tag),
        cp AS (SELECT cluster_id, count(*) AS cluster_posts FROM pc GROUP BY cluster_id),
        ct AS (SELECT cluster_id, tag, count(*) AS cluster_tag_posts FROM tlc GROUP BY cluster_id, tag),
        lf AS (SELECT ct.cluster_id, ct.tag, ct.cluster_tag_posts, gt.global_posts,
                 ln((ct.cluster_tag_posts / CAST(cp.cluster_posts AS DOUBLE)) / (gt.global_posts / (SELECT CAST(count(*) AS DOUBLE) FROM filtered))) AS log_lift
               FROM ct LEFT JOIN gt ON ct.tag = gt.tag LEFT JOIN cp ON ct.cluster_id = cp.cluster_id
               WHERE ct.cluster_tag_posts >= 10 AND gt.global_posts >= 50)
        SELECT cluster_id, rank, tag, cluster_tag_posts, global_posts, round(log_lift, 9) AS log_lift FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY log_lift DESC, tag ASC) AS rank FROM lf) WHERE rank <= 15""",
    "example_posts": BASE + _graph() + CLUSTERS + """ SELECT cluster_id, rank, id, score, created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id ASC) AS rank FROM pc) WHERE rank <= 5""",
    "example_bundles": BASE + _graph() + CLUSTERS + """,
        ex AS (SELECT cluster_id, rank, id FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id ASC) AS rank FROM pc) WHERE rank <= 5)
        SELECT ex.cluster_id, ex.rank, ex.id, array_to_string(list_slice(f.tags, 1, 20), '|') AS tags20
        FROM ex LEFT JOIN filtered f ON ex.id = f.id""",
    "ranked_clusters": BASE + _graph() + CLUSTERS + f""" SELECT {METRICS_COLS} FROM metrics WHERE num_posts >= 50
        ORDER BY opportunity DESC, cluster_id ASC LIMIT 20""",
    "niche_clusters": BASE + _graph() + CLUSTERS + f""" SELECT {METRICS_COLS} FROM metrics WHERE num_posts < 1500
        ORDER BY demand_median DESC, cluster_id ASC LIMIT 2""",
    "all_clusters": BASE + _graph() + CLUSTERS + """ SELECT
        row_number() OVER (ORDER BY m.opportunity DESC NULLS LAST, r.cluster_id DESC) AS rank, r.cluster_id,
        CAST(coalesce(m.num_posts, 0) AS BIGINT) AS num_posts, round(m.opportunity, 9) AS opportunity,
        coalesce(m.rep15, r.rep15) AS representative_tags
        FROM rep r LEFT JOIN metrics m ON r.cluster_id = m.cluster_id""",
    "run_overview": BASE + _graph() + WIKI + _links() + MERGED + """ SELECT
        (SELECT count(*) FROM filtered) AS posts,
        (SELECT count(*) FROM (SELECT DISTINCT tag FROM long WHERE tag <> '')) AS unique_tags,
        (SELECT count(*) FROM (SELECT src AS n FROM merged UNION SELECT dst FROM merged)) AS nodes,
        (SELECT count(*) FROM merged) AS edges,
        (SELECT count(DISTINCT length(tag) % """ + str(Q.N_FIXED_CLUSTERS) + """) FROM vocab) AS clusters""",
    "incremental_ingest": "WITH" + POSTS + " SELECT id, created_at, score, rating, general, character, copyright, artist, meta FROM active",
    "streaming_tag_counts": "WITH" + POSTS + TAGCOUNT + " SELECT tag, tag_type, count FROM bytype",
    "modularity_fixed": BASE + _graph() + WIKI + _links() + MERGED + f""",
        cm AS (SELECT tag, CAST(length(tag) % {Q.N_FIXED_CLUSTERS} AS BIGINT) AS c FROM vocab),
        ea AS (SELECT m.weight, a.c AS ca, b.c AS cb FROM merged m JOIN cm a ON m.src = a.tag JOIN cm b ON m.dst = b.tag),
        win AS (SELECT ca AS c, sum(weight) AS w_in FROM ea WHERE ca = cb GROUP BY ca),
        st AS (SELECT node, sum(weight) AS k FROM (SELECT src AS node, weight FROM merged UNION ALL SELECT dst, weight FROM merged) GROUP BY node),
        kc AS (SELECT cm.c, sum(k) AS K FROM st JOIN cm ON st.node = cm.tag GROUP BY cm.c),
        tw AS (SELECT sum(weight) AS m FROM merged)
        SELECT round(sum(coalesce(w_in, 0)) / max(tw.m) - sum(K * K) / (4 * max(tw.m) * max(tw.m)), 9) AS modularity,
               count(*) AS communities, round(max(tw.m), 9) AS total_weight
        FROM kc LEFT JOIN win ON kc.c = win.c, tw""",
    "cluster_examples": BASE + _graph() + CLUSTERS + """,
        ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id ASC) AS rank FROM pc)
               WHERE rank <= 5)
        SELECT cluster_id, string_agg(CAST(id AS VARCHAR), '|' ORDER BY rank) AS top_post_ids,
               string_agg(CAST(score AS VARCHAR), '|' ORDER BY rank) AS top_post_scores,
               string_agg(created_at, '|' ORDER BY rank) AS top_post_created FROM ex GROUP BY cluster_id""",
    "top_cluster_examples": BASE + _graph() + CLUSTERS + """,
        top20 AS (SELECT cluster_id FROM metrics WHERE num_posts >= 50 ORDER BY opportunity DESC, cluster_id ASC LIMIT 20)
        SELECT cluster_id, rank, id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id ASC) AS rank FROM pc)
        WHERE rank <= 5 AND cluster_id IN (SELECT cluster_id FROM top20)""",
    "tag_trend": BASE + """ SELECT month, tag, count(*) AS uses FROM (
        SELECT substr(created_at, 1, 7) AS month, unnest(tags) AS tag FROM filtered) GROUP BY month, tag""",
    "tag_phi": BASE + _graph(method="count") + """ SELECT tag_left, tag_right, cooccur,
        round((CAST(cooccur AS DOUBLE) * n.n - CAST(freq_left AS DOUBLE) * freq_right) /
              sqrt(CAST(freq_left AS DOUBLE) * freq_right * (n.n - freq_left) * (n.n - freq_right)), 9) AS phi FROM edges, n""",
    "post_tag_bridge": BASE + """ SELECT post_id, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS position,
        unnest(tags) AS tag FROM filtered""",
    "column_profile": "WITH" + POSTS + """ SELECT count(*) AS rows,
        CAST(sum(CASE WHEN general IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_general,
        CAST(sum(CASE WHEN character IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_character,
        CAST(sum(CASE WHEN copyright IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_copyright,
        CAST(sum(CASE WHEN artist IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_artist,
        CAST(sum(CASE WHEN meta IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_meta,
        min(score) AS min_score, max(score) AS max_score, round(avg(score), 9) AS avg_score,
        count(DISTINCT rating) AS ratings, round(avg(CAST(is_deleted AS DOUBLE)), 9) AS deleted_share,
        round(avg(CAST(is_banned AS DOUBLE)), 9) AS banned_share FROM posts""",
}
