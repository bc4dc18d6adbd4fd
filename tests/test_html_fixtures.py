"""Structure cases of pages and the hierarchy rules, on small pages of a tool shed and a kitchen."""

import pytest
from pyspark.sql import functions as F

from tagflow.functions import hierarchy as HX
from tagflow.operators import hierarchy as H
from tagflow.operators.html_nodes import page_rows

HOST = HX.SITE_HOST


def walked(spark, html, base=(), **cfg):
    page = spark.createDataFrame([(7, html, list(base))], "page_id long, html string, base array<string>")
    rows = H.page_nodes(page, H.default_config(**cfg), "base").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return rows


def items(spark, html, base=(), **cfg):
    return {r["name"]: r for r in walked(spark, html, base, **cfg) if r["kind"] == "item"}


def link(name, inner=""):
    return f'<li><a href="/n/{name}">{name}</a>{inner}</li>'


def test_list_after_an_item_nests_under_it(spark):
    got = items(spark, f"<h2>Shed</h2><h5>Wall</h5><ul>{link('saws')}<ul>{link('rip')}{link('fret')}</ul>{link('nails')}</ul>", ["home"])
    assert got["saws"]["path"] == ["home", "Shed", "Wall", "saws"] and got["saws"]["has_nested"]
    assert got["fret"]["path"] == ["home", "Shed", "Wall", "saws", "fret"] and not got["fret"]["has_nested"]
    assert got["nails"]["path"] == ["home", "Shed", "Wall", "nails"]
    assert got["Wall"]["path"] == ["home", "Shed", "Wall"] and not got["Wall"]["has_link"]


def test_list_inside_an_item_uses_its_own_text(spark):
    html = '<ul><li>Pots of <a href="/n/iron">iron</a><ul><li>lid</li><li>grip<ul><li>screw</li></ul></li></ul></li></ul>'
    got = items(spark, html)
    assert got["iron"]["path"] == ["iron"] and got["iron"]["href"] == "/n/iron"
    assert got["lid"]["path"] == ["Pots ofiron", "lid"]
    assert got["screw"]["path"] == ["Pots ofiron", "grip", "screw"]


def test_which_following_list_counts(spark):
    html = f"<ul>{link('cups')}{link('pans')}<ul>{link('wok')}</ul></ul>"
    assert {n: r["has_nested"] for n, r in items(spark, html).items()} == {"cups": True, "pans": True, "wok": False}
    assert not items(spark, html, sibling="immediate")["cups"]["has_nested"]
    assert items(spark, html)["wok"]["path"] == ["pans", "wok"]


def test_headings_close_deeper_ones(spark):
    html = f"<h2>A</h2><h4>B</h4><ul>{link('b')}</ul><h3>C</h3><ul>{link('c')}</ul><h6></h6><h2>D</h2><p>x</p><ul>{link('d')}</ul>"
    got = items(spark, html)
    assert [got[n]["path"] for n in "bcd"] == [["A", "B", "b"], ["A", "C", "c"], ["D", "d"]]
    assert "D" not in got  # a paragraph lies between


def test_list_of_an_ignored_item_belongs_to_its_section(spark):
    rows = walked(spark, f"<h4>Oven</h4><ul><li>See also</li><ul>{link('grill')}</ul>{link('rack')}</ul>")
    assert [(r["kind"], r["name"]) for r in rows][2:] == [("ignored", "See also"), ("item", "rack"), ("item", "grill")]
    assert rows[-1]["path"] == ["Oven", "grill"]


def test_lists_of_any_depth(spark):
    deep = "".join(f"<ul><li>s{k}" for k in range(15)) + "</li></ul>" * 15
    assert set(items(spark, deep)) == {f"s{k}" for k in range(15)}
    assert set(items(spark, deep, max_depth=4)) == {f"s{k}" for k in range(5)}


def test_excluded_sections(spark):
    html = f'<h3>See also</h3><h4>Attic</h4><ul><li><a href="/wiki_pages/x">Tag group:Trunks</a></li></ul><h3>Cellar</h3><ul>{link("wine")}</ul>'
    rows = walked(spark, html)
    assert [r["name"] for r in rows if r["kind"] == "excluded"] == ["See also"]
    assert [r["name"] for r in rows if r["kind"] == "item"] == ["Cellar", "wine"]
    assert set(items(spark, html, exclude="follow")) == {"Attic", "Tag group:Trunks", "Cellar", "wine"}


def test_noise(spark):
    html = f'<nav><ul>{link("menu")}</ul></nav><div class="x paginator"><ul>{link("two")}</ul></div><h2>Wiki</h2><ul>{link("rug")}</ul>'
    assert set(items(spark, html)) == {"rug"}
    assert set(items(spark, html, noise=())) == {"menu", "two", "rug"}
    assert set(items(spark, f'<div id="wiki-page-body">{html}</div>')) == {"menu", "two", "rug"}


def test_selection_of_items_without_link(spark):
    html = f"<h2>House</h2><ul><li>Kitchen</li><ul>{link('sink')}</ul><li>Garage</li><ul>{link('car')}</ul></ul>"
    got = items(spark, html, target_groups=["Kitchen"])
    assert "Garage" not in got and got["sink"]["path"] == ["House", "Kitchen", "sink"] and got["car"]["path"] == ["House", "car"]
    assert "Garage" in items(spark, html, ["start"], target_groups=["Kitchen"])  # only a start page selects
    assert "Kitchen" not in items(spark, html, group_name_patterns=["gar*"])


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<ul><li>x</li></ul>"
    assert len(page_rows(deep)) == 2
    assert len(page_rows("<ul>" + "<li>a</li>" * 50_000 + "</ul>")) == 50_001
    assert page_rows(None) == page_rows("") == page_rows("</ul></li>") == []


@pytest.mark.parametrize("html", ["", None])
def test_empty_pages(spark, html):
    assert walked(spark, html) == []


def classified(spark, rows):
    return H.classify_items(spark.createDataFrame(rows, "name string, href string, path array<string>, has_link boolean, has_nested boolean, seq string"))


def test_one_item_for_each_folded_name(spark):
    rows = [("Red Bowl", "/1", ["Red Bowl"], True, False, "a"), ("red bowl", "/1", ["far", "red bowl"], True, False, "b"),
            ("Q", None, ["Q"], False, True, "c"), ("q", "/q", ["Q", "q"], True, True, "d"),
            ("m", "/m", ["i", "j", "m"], True, False, "e"), ("m", "/m", ["i", "m"], True, False, "f")]
    n = H.normalise(H.resolve_duplicates(classified(spark, rows)))
    got = {r["name"]: r for r in n.collect()}
    assert got["red bowl"]["path"] == ["red bowl"] and got["m"]["path"] == ["i", "m"]
    assert got["q"]["classification"] == HX.TAG_AND_TAG_GROUP
    assert {(r["original"], r["normalized"]) for r in H.normalisation_log(n).collect()} == {("Red Bowl", "red bowl"), ("Q", "q")}


def test_group_and_its_base_become_one(spark):
    rows = [("mug", "/mug", ["k", "mug"], True, False, "1"),
            ("tag group:mug tags", "/g", ["k", "t", "u", "tag group:mug tags"], True, True, "2"),
            ("jar", None, ["k", "t", "jar"], False, True, "3"), ("tag group:jar", "/h", ["tag group:jar"], True, True, "4")]
    c = {r["name"]: r for r in H.consolidate(H.normalise(H.resolve_duplicates(classified(spark, rows)))).collect()}
    assert set(c) == {"mug", "jar"}
    assert c["mug"]["path"] == ["k", "t", "u", "tag group:mug tags"] and c["mug"]["consolidated"]
    assert c["jar"]["path"] == ["k", "t", "jar"] and not c["jar"]["consolidated"]


def test_links_and_patterns(spark):
    df = spark.createDataFrame([("Tag group:V", "/wiki_pages/v"), ("\tList of w\n", "http://h/w"), ("z", "/z")], "n string, u string")
    got = df.select(HX.should_follow("n").alias("f"), HX.rewrite_url("u").alias("u"), HX.rewrite_url("u", "http://own").alias("o"),
                    HX.glob_match_any("n", ["tag group:*", "?"]).alias("g"),
                    HX.glob_match_any(F.concat(F.lit("my "), "n"), ["tag group:*"]).alias("inner"),
                    HX.contains_any_term("n", ["list of w"]).alias("t")).collect()
    assert [r["f"] for r in got] == [True, True, False] and [r["g"] for r in got] == [True, False, True]
    assert got[0]["u"] == HOST + "/posts?tags=v" and got[1]["u"] == "http://h/w" and got[2]["o"] == "http://own/z"
    assert not any(r["inner"] for r in got) and got[1]["t"]


def follow(name):
    return f'<li><a href="/wiki_pages/{name}">Tag group:{name}</a></li>'


def test_pages_are_followed_once(spark):
    pages = spark.createDataFrame(
        [(0, "start", f"<h2>All</h2><ul>{follow('b')}{follow('a')}{follow('lost')}</ul>"),
         (1, HOST + "/posts?tags=a", f"<ul>{link('one')}{follow('b')}{follow('c')}</ul>"),
         (2, HOST + "/posts?tags=b", f"<ul>{link('two')}{follow('a')}</ul>"),
         (3, HOST + "/posts?tags=c", f"<ul>{link('three')}</ul>")], "page_id long, url string, html string")
    cfg = H.default_config()
    start = H.page_nodes(pages.where("url = 'start'"), cfg)

    def run(hops, **more):
        found, followed = H.expand_links(start, pages, dict(cfg, **more), hops, "start")
        return {r["name"]: r["path"] for r in H.resolve_duplicates(found).collect()}, [(r["hop"], r["group"]) for r in followed.orderBy("hop", "order").collect()]

    names, followed = run(1)
    assert followed == [(1, "Tag group:b"), (1, "Tag group:a")]  # in the order of their links; one page is missing
    assert names["one"] == ["All", "Tag group:a", "one"] and "three" not in names and "Tag group:c" in names
    names, followed = run(2)
    assert followed == [(1, "Tag group:b"), (1, "Tag group:a"), (2, "Tag group:c")]
    assert names["three"] == ["All", "Tag group:a", "Tag group:c", "three"]
    assert run(1, max_groups=1)[1] == [(1, "Tag group:b")]
    assert run(1, skip_first_n=1)[1] == [(1, "Tag group:a")]
    assert run(1, target_groups=["Tag group:a"])[1] == [(1, "Tag group:a")]


def test_deep_nesting_takes_no_more_jobs(spark):
    """Lists in lists, 3 and 300 deep: the same paths as by hand, with the same number of Spark jobs."""
    jobs = {}
    for depth in (3, 300):
        html = "<h2>Box</h2>" + "".join(f"<ul><li>i{n}" for n in range(depth)) + "</li></ul>" * depth
        spark.sparkContext.setJobGroup(f"depth{depth}", "walk")
        got = items(spark, html, ["home"])
        jobs[depth] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth{depth}"))
        assert got[f"i{depth - 1}"]["path"] == ["home", "Box", *(f"i{n}" for n in range(depth))]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[300] <= jobs[3] + 3  # but for how an optimiser splits stages


def test_lists_too_deep_belong_to_their_section(spark):
    html = "<h2>Box</h2><ul><li>a</li><ul><li>b</li><ul><li>c</li><ul><li>d</li></ul></ul></ul></ul>"
    got = items(spark, html, ["home"], max_depth=1)
    assert [got[n]["path"] for n in "abcd"] == [["home", "Box", "a"], ["home", "Box", "a", "b"], ["home", "Box", "c"], ["home", "Box", "c", "d"]]
