"""Page audits over the recorded pages."""

from pyspark.sql import functions as F

from changeproof.operators import pages as G
from changeproof.plans import derive as D
from changeproof.plans.register import Register

REGISTER = Register()
query = REGISTER.query

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1))"
# Pages with tags by page_id: the SQL counts them from the number alone, the operators from the source.
HEAD = """concat('<head>', if(page_id % 2 = 0, '<meta name="viewport" content="w">', ''),
  element_at(array('<meta content="d" name="description">', '<meta property="og:description" content=d>', '<meta name="description" content=""><meta property="og:description" content="d">'), cast(page_id % 3 + 1 as int)),
  if(page_id % 5 = 0, '<meta property="og:image" content="i">', '<!-- <meta property="og:image"> -->'), if(page_id % 7 = 0, '<meta property="og:title" content="t"><link href="/f.ico" rel="shortcut icon">', ''))"""
BODY = """concat(repeat('<img src="a">', cast(page_id % 3 as int)), '<img src="b" role="presentation"><img alt src="c"><img src="d" alt="e">', repeat('<INPUT type="text">', cast(page_id % 4 as int)),
  '<input type="hidden"><input type=submit><label>n <input name="q"></label><label for="z">z</label><input id="z"><select aria-label="s"></select><textarea hidden></textarea><input style="display: none">',
  repeat('<button class="x"> </button>', cast(page_id % 2 as int)), '<b id="t"></b><button aria-labelledby="u t"></button><button>Go</button><button title="x"></button><a role="button"><i></i></a><div role=button><img alt="i"></div>',
  if(page_id % 11 = 0, '<h1>x</h1>', ''))"""
VISIT = {"broken_images": "if(page_id % 13 = 0, 2, 0)", "collapsed_maps": "if(page_id % 17 = 0, 1, 0)", "empty_regions": "if(page_id % 19 = 0, 1, null)", "overflow_px": "cast(page_id % 23 as int) - 20", "broken_links": "if(page_id % 29 = 0, 3, 0)"}
MEASURES_SQL = f"""m AS (SELECT page_id, {HOST} AS app, (len(regexp_extract_all(html, '(?i)<h1[ >]')) + CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END)::INT AS h1_count, regexp_matches(html, '(?i)<html[^>]*\\slang="[^"]+"') AS lang_set,
  regexp_matches(html, '(?i)<title>\\s*[^<\\s]') AS title_set, (page_id % 3)::INT AS images_no_alt, (page_id % 4)::INT AS inputs_no_label, (page_id % 2 + 1)::INT AS buttons_no_name,
  len(regexp_extract_all(html, '(?i)<a\\s[^>]*href='))::INT AS links, page_id % 2 = 0 AS viewport, page_id % 3 <> 2 AS description, page_id % 7 = 0 AS og_title, page_id % 5 = 0 AS og_image, page_id % 7 = 0 AS favicon FROM pages)"""
FINDINGS_SQL = f"""{MEASURES_SQL}, f AS (SELECT page_id, app, x.* FROM (SELECT page_id, app, unnest([
  CASE WHEN page_id % 13 = 0 THEN {{'finding': 'broken_images', 'severity': 'high', 'what': '2 image(s) fail to load'}} END, CASE WHEN page_id % 17 = 0 THEN {{'finding': 'collapsed_maps', 'severity': 'high', 'what': '1 map container(s) collapsed'}} END,
  CASE WHEN page_id % 19 = 0 THEN {{'finding': 'empty_regions', 'severity': 'high', 'what': '1 empty region(s) on screen'}} END,
  CASE WHEN page_id % 23 > 20 THEN {{'finding': 'overflow_px', 'severity': 'high', 'what': 'scrolls sideways on a phone by ' || (page_id % 23 - 20) || 'px'}} END,
  CASE WHEN page_id % 29 = 0 THEN {{'finding': 'broken_links', 'severity': 'high', 'what': '3 broken internal link(s)'}} END, CASE WHEN h1_count = 0 THEN {{'finding': 'no_h1', 'severity': 'medium', 'what': 'no <h1> on the page'}} END,
  CASE WHEN h1_count > 1 THEN {{'finding': 'many_h1', 'severity': 'low', 'what': h1_count || ' <h1> elements, should be one'}} END,
  CASE WHEN page_id % 3 > 0 THEN {{'finding': 'images_no_alt', 'severity': 'medium', 'what': (page_id % 3) || ' image(s) with no alt text'}} END,
  CASE WHEN page_id % 4 > 0 THEN {{'finding': 'inputs_no_label', 'severity': 'medium', 'what': (page_id % 4) || ' form field(s) with no label'}} END,
  {{'finding': 'buttons_no_name', 'severity': 'medium', 'what': (page_id % 2 + 1) || ' button(s) with no accessible name'}}, CASE WHEN NOT lang_set THEN {{'finding': 'no_lang', 'severity': 'low', 'what': '<html> has no lang attribute'}} END,
  CASE WHEN page_id % 2 = 1 THEN {{'finding': 'no_viewport', 'severity': 'high', 'what': 'no viewport meta tag'}} END, CASE WHEN page_id % 3 = 2 THEN {{'finding': 'no_description', 'severity': 'low', 'what': 'no meta description'}} END,
  CASE WHEN page_id % 5 > 0 THEN {{'finding': 'no_og_image', 'severity': 'low', 'what': 'no og:image'}} END]) AS x FROM m) WHERE x IS NOT NULL)"""
ROUTE = "CASE WHEN regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', '') END"
PATH = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"
LINKS_SQL = f"""h AS (SELECT {HOST} AS app, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT DISTINCT app, {ROUTE.format('href')} AS route FROM h WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))"""


def pages(spark, sf_dir):
    return D.table(spark, sf_dir, "pages")


def tagged(spark, sf_dir):
    """The pages with more tags in head and body."""
    return pages(spark, sf_dir).select("page_id", "url", F.concat(F.replace("html", F.lit("<head>"), F.expr(HEAD)), F.expr(BODY)).alias("html"))


def measured(spark, sf_dir):
    """What the source shows, and what a visit of each page counted."""
    return G.measure(tagged(spark, sf_dir)).select("*", *(F.expr(sql).alias(name) for name, sql in VISIT.items()))


@query(f"WITH {MEASURES_SQL} SELECT * FROM m")
def page_measures(spark, sf_dir):
    return G.measure(tagged(spark, sf_dir)).drop("size")


@query(f"WITH {FINDINGS_SQL} SELECT * FROM f")
def audit_findings(spark, sf_dir):
    return G.findings(measured(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT app, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, count(DISTINCT page_id) AS pages FROM f GROUP BY ROLLUP (app)")
def severity_totals(spark, sf_dir):
    return G.severity_totals(G.findings(measured(spark, sf_dir)))


@query(f"SELECT page_id, {ROUTE.format(PATH)} AS route FROM pages")
def normalise_routes(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", G.route_of(F.col("url")).alias("route"))


@query(f"WITH {LINKS_SQL} SELECT app, route FROM l")
def internal_links(spark, sf_dir):
    return G.internal_links(pages(spark, sf_dir))


# Each app has the routes that its pages link to, but for those of an odd length; those whose length is a multiple of 6 answer 404.
ANSWERS_SQL = "a AS (SELECT app, route, CASE WHEN length(route) % 6 = 0 THEN 404 WHEN length(route) % 4 = 0 THEN 301 ELSE 200 END AS status FROM l WHERE length(route) % 2 = 0)"


@query(f"WITH {LINKS_SQL}, {ANSWERS_SQL} SELECT app, route FROM l ANTI JOIN (SELECT app, route FROM a WHERE status < 400) USING (app, route)")
def broken_internal_links(spark, sf_dir):
    links = G.internal_links(pages(spark, sf_dir))
    size = F.length("route")
    answers = links.where(size % 2 == 0).select(F.concat(F.lit("https://"), "app", "route", F.lit("?x#y")).alias("url"), F.when(size % 6 == 0, 404).when(size % 4 == 0, 301).otherwise(200).alias("status"))
    return G.broken_internal_links(links, answers)


# Sites of eight pages: the first is the start page (but for each fifth site's), the others /r1 to /r7; their links stand before those that the pages have.
SITE = """concat('https://S', page_id div 8, '.example', if(page_id % 8 = 0, if(page_id div 8 % 5 = 4, '/home', '?start'), concat('/r', page_id % 8, '/')))"""
LINKED = """concat(if(page_id % 8 = 0, '<a href="//cdn.example/r7"><a class="n" href="/r1/?a=b"><a href="/Sign-Out"><a href="/x.PNG"><a href="/r2#t"><a href="/r1"><a href="/"><a href="/r5"><a href="/r3">',
  concat('<a href="/k', page_id % 8, 'a"><a href="/r1"><a href="/k', page_id % 8, 'b/c/"><a href="/api/v1"><a href="/k0">')), if(page_id div 8 % 3 = 0, '', html))"""


@query(
    f"""WITH p AS (SELECT page_id, page_id // 8 AS site, 's' || (page_id // 8) || '.example' AS app, CASE WHEN page_id % 8 > 0 THEN '/r' || (page_id % 8) WHEN page_id // 8 % 5 = 4 THEN '/home' ELSE '/' END AS here,
      regexp_extract_all({LINKED.replace(' div ', ' // ')}, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages),
    h AS (SELECT app, here, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS place FROM p),
    l AS (SELECT app, here, place, {ROUTE.format('href')} AS route FROM h WHERE starts_with(href, '/') AND NOT starts_with(href, '//')),
    ok AS (SELECT * FROM l WHERE NOT regexp_matches(route, '{G.DESTRUCTIVE}') AND NOT regexp_matches(route, '{G.ASSETS}')),
    one AS (SELECT app, route, min(place) AS place FROM ok WHERE here = '/' AND route <> '/' GROUP BY ALL),
    seeds AS (SELECT * FROM (SELECT app, route, row_number() OVER (PARTITION BY app ORDER BY place) AS seed FROM one) WHERE seed <= 3),
    met AS (SELECT DISTINCT app, '/' AS route, -1 AS seed, 0 AS place FROM p UNION ALL SELECT app, route, 0, place FROM one
      UNION ALL SELECT ok.app, ok.route, seeds.seed, ok.place FROM ok JOIN seeds ON ok.app = seeds.app AND ok.here = seeds.route),
    firsts AS (SELECT app, route, min((seed, place)) AS met FROM met GROUP BY ALL),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY met) AS n FROM firsts) WHERE n <= 12)
    SELECT app, route, (row_number() OVER (PARTITION BY app ORDER BY route))::INT AS rank FROM kept"""
)
def discover_routes(spark, sf_dir):
    return G.discover_routes(pages(spark, sf_dir).select("page_id", F.expr(SITE).alias("url"), F.expr(LINKED).alias("html")))


@query(f"SELECT app, page_id, size, rank::INT AS rank FROM (SELECT {HOST} AS app, page_id, length(html)::INT AS size, row_number() OVER (PARTITION BY {HOST} ORDER BY length(html) DESC, page_id) AS rank FROM pages) WHERE rank <= 3")
def largest_pages(spark, sf_dir):
    """The worst three pages of each app by size."""
    return G.worst(G.measure(pages(spark, sf_dir)), "app", "size", "page_id").select("app", "page_id", "size", "rank")
