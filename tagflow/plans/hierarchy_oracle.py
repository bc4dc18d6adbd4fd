"""Oracle SQL (DuckDB) for the hierarchy queries."""

from __future__ import annotations

from . import hierarchy_queries as HQ

ITEMS = r"""
hp AS (SELECT DISTINCT p_type, p_brand, p_name FROM part),
ht AS (SELECT DISTINCT p_type FROM part),
tg AS (SELECT p_type, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'Tag group:' || p_type || ' tags'
                           ELSE 'Tag group:' || p_type END AS gname FROM ht),
tg2 AS (SELECT p_type, gname, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN ['Catalogue', 'Groups', gname]
                                   ELSE [gname] END AS gpath FROM tg),
leaf AS (SELECT DISTINCT hp.p_type, hp.p_brand, gpath,
           CASE WHEN CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) % 2 = 0
                THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END AS ln
         FROM hp JOIN tg2 ON hp.p_type = tg2.p_type),
raw AS (
  SELECT gname AS name, '/wiki_pages/' || gname AS href, gpath AS path, true AS has_link, true AS has_nested, 1 AS kind FROM tg2
  UNION ALL SELECT p_type, NULL, [p_type], false, true, 2 FROM ht
  UNION ALL SELECT DISTINCT hp.p_brand, '/wiki_pages/' || hp.p_brand, list_concat(gpath, [hp.p_brand]), true, true, 3
            FROM hp JOIN tg2 ON hp.p_type = tg2.p_type
  UNION ALL SELECT ln, '/wiki_pages/' || ln, list_concat(gpath, [p_brand, ln]), true, false, 4 FROM leaf
  UNION ALL SELECT 'See also ' || p_type, '/wiki_pages/See also ' || p_type, list_concat(gpath, ['See also ' || p_type]), true, false, 5 FROM tg2
  UNION ALL SELECT DISTINCT p_brand, '/wiki_pages/' || p_brand, ['Index', p_brand], true, false, 6 FROM hp),
items AS (SELECT *, array_to_string(path, '/') || '#' || CAST(kind AS VARCHAR) AS seq FROM raw),
c1 AS (SELECT *, CASE WHEN has_nested AND has_link AND NOT contains(lower(name), 'tag group') THEN 'tag_and_tag_group'
                      WHEN has_nested AND NOT has_link AND NOT contains(lower(name), 'tag group') THEN 'tag_group_only'
                      WHEN contains(lower(name), 'tag group') THEN 'traditional_tag_group' ELSE 'final_tag_only' END AS classification
       FROM items),
cls AS (SELECT *, CASE classification WHEN 'tag_and_tag_group' THEN 4 WHEN 'traditional_tag_group' THEN 3
                                      WHEN 'tag_group_only' THEN 2 WHEN 'final_tag_only' THEN 1 ELSE 0 END AS priority,
               CASE WHEN len(path) >= 2 THEN path[-2] END AS parent, len(path) AS depth,
               has_link AND (contains(lower(trim(name)), 'tag group') OR contains(lower(trim(name)), 'list of')) AS should_follow
        FROM c1),
cls2 AS (SELECT *, CASE WHEN should_follow THEN href END AS url FROM cls),
res AS (SELECT * EXCLUDE (r) FROM (
          SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority DESC, depth ASC, seq ASC) AS r,
                 min(seq) OVER (PARTITION BY name) AS first_seq, count(*) OVER (PARTITION BY name) AS raw_rows FROM cls2)
        WHERE r = 1),
nrm AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY priority DESC, depth ASC, first_seq ASC) AS r2,
                 first_value(name) OVER (PARTITION BY lower(name) ORDER BY first_seq ASC) AS first_raw_name,
                 min(first_seq) OVER (PARTITION BY lower(name)) AS gfs, count(*) OVER (PARTITION BY lower(name)) AS members
          FROM res) WHERE r2 = 1),
norm AS (SELECT lower(name) AS name, url, href, list_transform(path, lambda s: lower(s)) AS path, lower(parent) AS parent,
                depth, has_nested, classification, priority, should_follow, gfs AS first_seq, first_raw_name,
                name AS kept_raw_name, members FROM nrm),
grp AS (SELECT name AS gname, trim(replace(name, 'tag group:', '')) AS opt1, depth AS gdepth, first_seq AS gseq,
               url, path, parent, depth, has_nested, classification, should_follow
        FROM norm WHERE starts_with(name, 'tag group:')),
grp2 AS (SELECT *, CASE WHEN ends_with(opt1, ' tags') THEN replace(opt1, ' tags', '') END AS opt2 FROM grp),
m AS (SELECT g.*, b1.depth AS d1, b2.depth AS d2 FROM grp2 g LEFT JOIN norm b1 ON b1.name = g.opt1 LEFT JOIN norm b2 ON b2.name = g.opt2),
m2 AS (SELECT *, CASE WHEN d1 IS NOT NULL THEN opt1 WHEN d2 IS NOT NULL THEN opt2 END AS base, coalesce(d1, d2) AS bdepth FROM m),
m3 AS (SELECT *, CASE WHEN bdepth >= gdepth THEN 'base_item_preferred' ELSE 'tag_group_more_detailed' END AS branch
       FROM m2 WHERE base IS NOT NULL),
removed AS (SELECT gname AS name FROM m3 UNION SELECT base FROM m3 WHERE branch = 'tag_group_more_detailed'),
repl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY gseq DESC) AS rr FROM m3
                        WHERE branch = 'tag_group_more_detailed') WHERE rr = 1),
cons AS (SELECT name, url, path, parent, depth, has_nested, classification, should_follow, false AS consolidated
         FROM norm WHERE name NOT IN (SELECT name FROM removed)
         UNION ALL SELECT base, url, path, parent, depth, has_nested, classification, should_follow, true FROM repl),
tpaths AS (SELECT name AS tag_id, array_to_string(list_slice(path, 1, i), ' → ') AS path_value
           FROM cons, range(1, 64) t(i) WHERE i <= len(path)),
tcls AS (SELECT * FROM (VALUES (1, 'tag_and_tag_group'), (2, 'tag_group_only'), (3, 'final_tag_only'),
                               (4, 'traditional_tag_group')) v(classification_id, classification_name))"""

W = "WITH " + ITEMS

REWRITE = ("CASE WHEN contains(CASE WHEN starts_with(url, '/') THEN 'https://wiki.example.org' || url ELSE url END, '/wiki_pages/') "
           "THEN 'https://wiki.example.org/posts?tags=' || string_split(CASE WHEN starts_with(url, '/') THEN "
           "'https://wiki.example.org' || url ELSE url END, '/wiki_pages/')[-1] "
           "ELSE CASE WHEN starts_with(url, '/') THEN 'https://wiki.example.org' || url ELSE url END END")

EXCL = " OR ".join(f"contains(lower(trim({{x}})), '{t}')" for t in HQ.SELECT_CFG["exclude_sections"])

PAGE_ITEMS = r"""
pi AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS name,
              unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1)) AS href,
              CAST(unnest(generate_series(0, len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>', 0)) - 1)) AS INTEGER) AS pos
       FROM pages)"""

SITE = """WITH sp AS (SELECT DISTINCT p_type, p_brand, p_name FROM part),
site_types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS page_id, first_brand, n FROM (
  SELECT p_type, min(p_brand) AS first_brand, count(*) OVER () AS n FROM sp GROUP BY p_type)),
page_rows AS (
  SELECT page_id, p_type, '' AS brand, '' AS leaf, 'Brands' AS name, p_type || '/Brands' AS path, true AS has_nested, false AS linked FROM site_types
  UNION ALL SELECT DISTINCT page_id, p_type, p_brand, '', p_brand, p_type || '/Brands/' || p_brand, true, true FROM sp JOIN site_types USING (p_type)
  UNION ALL SELECT page_id, p_type, p_brand, p_name, p_name, p_type || '/Brands/' || p_brand || '/' || p_name, false, true FROM sp JOIN site_types USING (p_type)
  UNION ALL SELECT a.page_id, a.p_type, chr(1114109), '', 'List of ' || b.p_type, a.p_type || '/Brands/List of ' || b.p_type, false, true
    FROM site_types a JOIN site_types b ON b.page_id = a.page_id % a.n + 1),
site_items AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY brand, leaf) + 1 AS INTEGER) AS pos, name, path, has_nested, linked,
    len(string_split(path, '/')) AS depth FROM page_rows
  UNION ALL SELECT 0, 1, 'Types', 'Types', true, false, 1
  UNION ALL SELECT 0, CAST(2 * page_id AS INTEGER), 'Tag group:' || p_type, 'Types/Tag group:' || p_type, true, true, 2 FROM site_types
  UNION ALL SELECT 0, CAST(2 * page_id + 1 AS INTEGER), 'first ' || first_brand, 'Types/Tag group:' || p_type || '/first ' || first_brand, false, false, 3
    FROM site_types)"""

EXPANDED = """moved AS (
  SELECT 0 AS hop, 0 AS page, pos, name, path, has_nested, linked FROM site_items WHERE page_id = 0
  UNION ALL SELECT 1, i.page_id, pos, i.name, 'Types/Tag group:' || t.p_type || '/' || path, has_nested, linked
    FROM site_items i JOIN site_types t ON t.page_id = i.page_id WHERE i.page_id BETWEEN 2 AND 4),
best AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY name) AS raw_rows, row_number() OVER (PARTITION BY name ORDER BY
      CASE WHEN has_nested AND linked AND NOT contains(lower(name), 'tag group') THEN 1 WHEN contains(lower(name), 'tag group') THEN 2
           WHEN has_nested THEN 3 ELSE 4 END, len(string_split(path, '/')), hop, page, pos) AS r FROM moved) WHERE r = 1)"""

ORACLE = {
    "hierarchy_classify": W + " SELECT name, seq, classification, priority, parent, depth, should_follow, url, "
                          + REWRITE + " AS full_url FROM cls2",
    "hierarchy_resolved": W + " SELECT name, seq, first_seq, classification, array_to_string(path, '/') AS path, raw_rows FROM res",
    "hierarchy_normalised": W + """ SELECT name, array_to_string(path, '/') AS path, parent, depth, classification,
        should_follow, url, first_seq, first_raw_name, members FROM norm""",
    "hierarchy_removed_duplicates": W + """ SELECT lower(r.name) AS duplicate, n.classification AS kept_classification,
        array_to_string(n.path, ' → ') AS kept_path, r.classification AS discarded_classification,
        array_to_string(list_transform(r.path, lambda s: lower(s)), ' → ') AS discarded_path
        FROM res r JOIN norm n ON lower(r.name) = n.name WHERE r.name <> n.kept_raw_name""",
    "hierarchy_normalisation_log": W + """ SELECT 'lowercase' AS action, first_raw_name AS original, name AS normalized
        FROM norm WHERE first_raw_name <> name""",
    "hierarchy_consolidated": W + " SELECT name, array_to_string(path, '/') AS path, classification, consolidated FROM cons",
    "hierarchy_consolidation_log": W + " SELECT base AS kept, gname AS removed, branch AS reason FROM m3",
    "hierarchy_flat": W + """ SELECT name, url, array_to_string(path, ' → ') AS path, parent, depth,
        has_nested AS has_nested_list, classification, should_follow FROM cons""",
    "group_members": W + " SELECT parent, name, depth FROM cons WHERE parent IS NOT NULL",
    "ancestors": W + """ SELECT name, CAST(i AS INTEGER) AS level, path[i] AS ancestor FROM cons, range(1, 64) t(i)
        WHERE i < len(path)""",
    "items_under_path_count": W + f""" SELECT count(DISTINCT tag_id) AS items FROM tpaths
        WHERE path_value ILIKE '%{HQ.PATH_TERM}%'""",
    "items_under_path_list": W + f""" SELECT c.name, t.classification_name, c.depth FROM cons c
        JOIN tcls t ON t.classification_name = c.classification
        WHERE c.name IN (SELECT DISTINCT tag_id FROM tpaths WHERE path_value ILIKE '%{HQ.PATH_TERM}%')
        ORDER BY c.depth, c.name LIMIT 20""",
    "select_groups": W + """, f AS (SELECT *, row_number() OVER (ORDER BY first_seq) - 1 AS idx FROM res WHERE should_follow)
        SELECT idx, name, """ + REWRITE + """ AS full_url,
          CASE WHEN len(list_filter(path, lambda x: """ + EXCL.format(x="x") + """)) > 0 THEN 'excluded_path'
               WHEN """ + EXCL.format(x="name") + f""" THEN 'excluded_name'
               WHEN idx < {HQ.SELECT_CFG['skip_first_n']} THEN 'skipped'
               WHEN NOT (lower(name) LIKE 'tag group:%') THEN 'pattern_mismatch'
               WHEN url IS NULL THEN 'no_url' END AS skip_reason FROM f""",
    "depth_histogram": W + " SELECT depth, count(*) AS items FROM cons GROUP BY depth",
    "hierarchy_audit": W + """ SELECT CAST(sum(CASE WHEN parent IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS root_items,
        (SELECT count(*) FROM (SELECT DISTINCT parent FROM cons WHERE parent IS NOT NULL
                               AND parent NOT IN (SELECT name FROM cons))) AS dangling_parents FROM cons""",
    "children_by_depth": W + " SELECT depth, parent, count(*) AS children FROM cons WHERE parent IS NOT NULL GROUP BY depth, parent",
    "class_shares": W + """ SELECT classification, count(*) AS items,
        round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM cons), 9) AS share FROM cons GROUP BY classification""",
    "page_items": "WITH " + PAGE_ITEMS + """ SELECT page_id, pos, name, href, 1 AS depth, 'final_tag_only' AS classification FROM pi""",
    "page_hierarchy": "WITH " + PAGE_ITEMS + """ SELECT name, page_id AS first_page, pos AS first_pos,
        'final_tag_only' AS classification, raw_rows FROM (
          SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id, pos) AS r, count(*) OVER (PARTITION BY name) AS raw_rows FROM pi)
        WHERE r = 1""",
    "page_normalised": "WITH " + PAGE_ITEMS + """, res AS (SELECT name, min(page_id * 1000000 + pos) AS fs, min(page_id) AS fp FROM pi GROUP BY name)
        SELECT lower(name) AS name, arg_min(name, fs) AS first_raw_name, count(*) AS members,
               CAST(arg_min(fp, fs) AS BIGINT) AS first_page FROM res GROUP BY lower(name)""",
    "nested_items": SITE + """ SELECT page_id, pos, name, path, has_nested, depth,
        CASE WHEN contains(lower(name), 'tag group') THEN 'traditional_tag_group' WHEN has_nested AND linked THEN 'tag_and_tag_group'
             WHEN has_nested THEN 'tag_group_only' ELSE 'final_tag_only' END AS classification FROM site_items""",
    "catalogue_items": """WITH placed AS (
          SELECT p_partkey // 100 AS page_id, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS n,
            p_name || ' #' || p_partkey AS name, p_brand, p_type FROM part),
        ends AS (SELECT page_id, count(*) AS parts, 'List of parts ' || (page_id + 1) AS name FROM placed GROUP BY page_id)
        SELECT page_id, 1 AS pos, 'Parts ' || page_id AS name, 'Parts ' || page_id AS path, false AS has_link, true AS has_nested FROM ends
        UNION ALL SELECT page_id, 3 * n + 2, name, 'Parts ' || page_id || '/' || name, true, true FROM placed
        UNION ALL SELECT page_id, 3 * n + 3, p_brand, 'Parts ' || page_id || '/' || name || '/' || p_brand, false, false FROM placed
        UNION ALL SELECT page_id, 3 * n + 4, p_type, 'Parts ' || page_id || '/' || name || '/' || p_type, false, false FROM placed
        UNION ALL SELECT page_id, 3 * parts + 2, name, 'Parts ' || page_id || '/' || name, true, false FROM ends""",
    "nested_items_with_noise": SITE + """ SELECT page_id, CASE WHEN page_id > 0 THEN pos + 1 ELSE pos END AS pos, name, path FROM site_items
        UNION ALL SELECT page_id, 0, 'Home', 'Home' FROM site_types""",
    "page_headings": SITE + """ SELECT page_id, 'heading' AS kind, 0 AS pos, p_type AS name, 2 AS level FROM site_types
        UNION ALL SELECT page_id, 'heading', 1, 'Brands', 4 FROM site_types
        UNION ALL SELECT 0, 'heading', 0, 'Types', 2
        UNION ALL SELECT 0, k, CAST((SELECT 2 * count(*) + 2 FROM site_types) AS INTEGER) + CASE k WHEN 'heading' THEN 0 ELSE 1 END, 'See also', 3
        FROM (VALUES ('heading'), ('excluded')) AS v(k)""",
    "followed_pages": SITE + """ SELECT 1 AS hop, 'https://wiki.example.org/posts?tags=' || p_type AS full_url, 'Tag group:' || p_type AS "group",
        'Types/Tag group:' || p_type AS base_path FROM site_types WHERE page_id BETWEEN 2 AND 4""",
    "followed_pages_two_hops": SITE + """ SELECT 1 AS hop, 'https://wiki.example.org/posts?tags=' || p_type AS full_url,
        'Tag group:' || p_type AS "group" FROM site_types""",
    "expanded_items": SITE + """, """ + EXPANDED + """ SELECT name, path,
        CASE WHEN contains(lower(name), 'tag group') THEN 'traditional_tag_group' WHEN has_nested AND linked THEN 'tag_and_tag_group'
             WHEN has_nested THEN 'tag_group_only' ELSE 'final_tag_only' END AS classification, hop, raw_rows FROM best""",
    "run_statistics": SITE + """, """ + EXPANDED + """ SELECT count(*) AS total_items,
        CAST(sum(CASE WHEN linked AND (contains(lower(name), 'tag group') OR contains(lower(name), 'list of')) THEN 1 ELSE 0 END) AS BIGINT) AS total_followable_items,
        CAST(1 AS BIGINT) AS excluded_sections, CAST(0 AS BIGINT) AS ignored_elements, CAST(sum(raw_rows) AS BIGINT) AS raw_rows FROM best""",
    "text_logs": SITE + """ SELECT 'heading' AS source, name AS original, lower(name) AS normalized, count(*) AS rows FROM (
        SELECT p_type AS name FROM site_types UNION ALL SELECT 'Brands' FROM site_types UNION ALL SELECT 'Types' UNION ALL SELECT 'See also')
        WHERE lower(name) <> name GROUP BY name""",
    "glob_match": W + """ SELECT name, count(*) AS rows FROM (SELECT name FROM items UNION ALL SELECT 'my ' || name FROM items)
        WHERE regexp_full_match(lower(name), 'tag group:.*s') OR regexp_full_match(lower(name), 'brand#.[13]') GROUP BY name""",
}
