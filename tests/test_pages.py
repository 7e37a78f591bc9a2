"""Page audits, links and crawls on hand-made pages."""

from pyspark.sql import functions as F

from changeproof.operators import pages as G

PAGES = "page_id long, url string, html string"


def measured(spark, *htmls):
    rows = spark.createDataFrame([(i, "http://H.org/p", h) for i, h in enumerate(htmls)], PAGES)
    return {r.page_id: r for r in G.measure(rows).collect()}


def test_headings_titles_and_pictures(spark):
    got = measured(
        spark, "<html lang=\"en\"><head><title>T</title></head><h1>a</h1><H1 class='x'>b</H1><img src=x><img alt=\"y\"><img alt><img role='presentation'><a href=\"/p?q#f\">x</a>",
        "<html lang><title> </title><!-- <h1>a</h1><img> --><script>var h = '<h1>';</script>", None, "",
    )
    assert [(r.app, r.h1_count, r.lang_set, r.title_set, r.images_no_alt, r.links) for _, r in sorted(got.items())] == [("h.org", 2, True, True, 1, 1)] + [("h.org", 0, False, False, 0, 0)] * 3


def test_fields_need_a_label_that_a_reader_can_reach(spark):
    bare = ["<input>", "<input type='text' id=a>", "<select></select>", "<textarea name='x'></textarea>", "<input aria-label=''>", "<label for='b'>x</label><input id='c'>", "<input data-title='x'>"]
    fine = [
        "<input type=hidden>", "<input type='SUBMIT'>", "<label>x <b></b><input></label>", "<label for=a>x</label><input id=\"a\">", "<input aria-labelledby='q'>", "<input title='t'>", "<input hidden>", "<input aria-hidden='true'>",
        "<input style='color: red; display:none'>", "<!-- <input> -->",
    ]
    got = measured(spark, *bare, *fine)
    assert [r.inputs_no_label for _, r in sorted(got.items())] == [1] * len(bare) + [0] * len(fine)


def test_buttons_need_a_name(spark):
    bare = ["<button></button>", "<button> <i class='x'></i>\n</button>", "<a role='button'></a>", "<button aria-labelledby='absent'></button>", "<button><img alt=' '></button>", "<button><img src='x'></button>"]
    fine = ["<button>Go</button>", "<button><b>Go</b></button>", "<button title='x'></button>", "<p id='t'></p><button aria-labelledby='s t'></button>", "<div role=button><img alt='i'></div>", "<button hidden></button>", "<div role='list'></div>"]
    got = measured(spark, *bare, *fine)
    assert [r.buttons_no_name for _, r in sorted(got.items())] == [1] * len(bare) + [0] * len(fine)


def test_meta_tags_in_any_order_and_quotes(spark):
    got = measured(
        spark, "<meta content='d' name='description'><meta property=og:image content=i><link rel='shortcut ICON' href=x><meta name=viewport>", "<meta name='description' content=''><meta property='og:description' content='d'>",
        "<meta name='description'><meta property='og:description' content='d'><meta property='og:title' content=''><link rel='icons'>",
    )
    assert [(r.description, r.og_title, r.og_image, r.viewport, r.favicon) for _, r in sorted(got.items())] == [(True, False, True, True, True), (False, False, False, False, False), (True, True, False, False, False)]


def test_fourteen_findings_with_their_severity(spark):
    row = {"page_id": 1, "app": "a", "h1_count": 0, "lang_set": False, "images_no_alt": 1, "inputs_no_label": 2, "buttons_no_name": 3, "viewport": False, "description": False, "og_image": False}
    visit = {"broken_images": 1, "collapsed_maps": 1, "empty_regions": 1, "overflow_px": 9, "broken_links": 4}
    got = {r.finding: (r.severity, r.what) for r in G.findings(spark.createDataFrame([row | visit])).collect()}
    assert set(got) == {n for n, _, _ in G.RULES} - {"many_h1"} and got["overflow_px"] == ("high", "scrolls sideways on a phone by 9px") and got["no_viewport"][0] == "high" and got["no_lang"][0] == "low"
    many = G.findings(spark.createDataFrame([row | {"h1_count": 3}])).where("finding LIKE '%h1'").collect()
    assert [(r.finding, r.severity, r.what) for r in many] == [("many_h1", "low", "3 <h1> elements, should be one")]
    # What was not measured is no finding.
    nulls = spark.createDataFrame([row | visit]).select("page_id", "app", *(F.lit(None).cast("int").alias(c) for c in visit), *(F.lit(None).cast("boolean").alias(c) for c in ("lang_set", "viewport", "description", "og_image")), *(F.lit(None).cast("int").alias(c) for c in ("h1_count", "images_no_alt", "inputs_no_label", "buttons_no_name")))
    assert G.findings(nulls).count() == 0


def test_links_stay_on_the_site_and_broken_ones_answer_badly(spark):
    html = '<a href="/p?q#f"><a href="//cdn.org/x"><a href="http://h.org/y"><a href="z"><a href="/gone/"><a href="/bad"><a href="/silent">'
    rows = spark.createDataFrame([(1, "http://H.org/p", html), (2, "http://h.org", None)], PAGES)
    links = G.internal_links(rows)
    assert {tuple(r) for r in links.collect()} == {("h.org", r) for r in ("/p", "/gone", "/bad", "/silent")}
    answers = spark.createDataFrame([("http://h.org/p/", 200), ("http://h.org/bad", 404), ("http://h.org/bad?x", 500), ("http://h.org/silent", None)], "url string, status int")
    assert {r.route for r in G.broken_internal_links(links, answers).collect()} == {"/gone", "/bad", "/silent"}
    assert {r.route for r in G.broken_internal_links(links, rows).collect()} == {"/gone", "/bad", "/silent"}


def crawled(pages, budget, seeds):
    """One site's routes, page by page as a visitor goes."""
    found = ["/"]
    take = lambda route: [r for r in pages.get(route, []) if r not in found]
    for route in pages.get("/", []):
        if len(found) < budget and route not in found:
            found.append(route)
    for seed in found[1 : 1 + seeds]:
        for route in take(seed):
            if len(found) < budget and route not in found:
                found.append(route)
    return sorted(found)


def test_a_crawl_goes_two_steps_under_its_budget(spark):
    sites = {
        "full": {"/": [f"/r{k}" for k in range(30)], "/r0": ["/never"]}, "two": {"/": ["/b", "/a", "/", "/b", "/c", "/d"], "/a": ["/a1", "/b", "/a2"], "/b": ["/z", "/a1"], "/c": ["/"], "/d": ["/fourth"]},
        "alone": {"/x": ["/y"]}, "deep": {"/": ["/1"], "/1": ["/2"], "/2": ["/3"]}, "wide": {"/": ["/a", "/b"], "/a": [f"/a{k}" for k in range(20)], "/b": ["/b0"]},
    }
    rows = [(app, route, "".join(f'<a href="{x}">' for x in to)) for app, pages in sites.items() for route, to in pages.items()]
    df = spark.createDataFrame([(i, f"https://{app}{route}", html) for i, (app, route, html) in enumerate(rows)] + [(99, "no url", '<a href="/x">'), (98, None, None), (97, "https://deep/", '<a href="/other">')], PAGES)
    for budget, seeds in ((12, 3), (4, 3), (2, 1), (1, 3), (100, 2)):
        got = {}
        for r in sorted(G.discover_routes(df, budget, seeds).collect(), key=lambda r: (r.app, r.rank)):
            got.setdefault(r.app, []).append(r.route)
        assert got == {app: crawled(pages, budget, seeds) if "/" in pages else ["/"] for app, pages in sites.items()}


def test_routes_that_a_crawl_must_not_follow(spark):
    bad = ["/logout", "/a/Sign-Out/b", "/signout", "/api", "/_next/x", "/cdn-cgi/", "/billing", "/x/delete", "/pay", "/a.PDF", "/robots.txt", "/f.woff"]
    fine = ["/apis", "/payment", "/login", "/deleted", "/a.mp4", "/pdf"]
    rows = spark.createDataFrame([(r,) for r in bad + fine], "route string")
    assert [r.x for r in rows.select(G.is_destructive(F.col("route")).alias("x")).collect()] == [True] * len(bad) + [False] * len(fine)
