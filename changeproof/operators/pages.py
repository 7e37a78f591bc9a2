"""Audits of recorded pages: measures, findings, links and routes."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.operators.scale import once

# Routes that a crawl must not follow, endings that are no pages, routes of an app it visits at most and those it goes on from.
DESTRUCTIVE = r"(?i)/(logout|sign-?out|api|_next|cdn-cgi|checkout|pay|billing|delete)(/|$)"
ASSETS = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|xml|txt|json|css|js|woff2?)$"
BUDGET, SEEDS = 12, 3

# Findings of an audit, how severe they are, and what is said of them. {n} is the measure.
RULES = (
    ("broken_images", "high", "{n} image(s) fail to load"),
    ("collapsed_maps", "high", "{n} map container(s) collapsed"),
    ("empty_regions", "high", "{n} empty region(s) on screen"),
    ("overflow_px", "high", "scrolls sideways on a phone by {n}px"),
    ("broken_links", "high", "{n} broken internal link(s)"),
    ("no_h1", "medium", "no <h1> on the page"),
    ("many_h1", "low", "{n} <h1> elements, should be one"),
    ("images_no_alt", "medium", "{n} image(s) with no alt text"),
    ("inputs_no_label", "medium", "{n} form field(s) with no label"),
    ("buttons_no_name", "medium", "{n} button(s) with no accessible name"),
    ("no_lang", "low", "<html> has no lang attribute"),
    ("no_viewport", "high", "no viewport meta tag"),
    ("no_description", "low", "no meta description"),
    ("no_og_image", "low", "no og:image"),
)


def normalise_route(path: Column) -> Column:
    """Without query, fragment and trailing slashes; empty is /."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def is_destructive(path: Column) -> Column:
    return F.rlike(path, F.lit(DESTRUCTIVE)) | F.rlike(path, F.lit(ASSETS))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty where there is none."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def _has(tag: Column, name: str) -> Column:
    return F.rlike(tag, F.lit(rf"(?is)\s{name}(?=[\s=/>])"))


def _tags(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def _reachable(tag: Column) -> Column:
    unseen = F.rlike(_attribute(tag, "style"), F.lit(r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden)"))
    return ~(_has(tag, "hidden") | (_attribute(tag, "aria-hidden") == "true") | unseen)


def _unlabelled(html: Column) -> Column:
    """Form fields that can be reached, stand in no label, are named by none, and have no name of their own."""
    owners = F.transform(_tags(html, r"(?is)<label\b[^>]*>"), lambda t: _attribute(t, "for"))
    outside = F.regexp_replace(html, r"(?is)<label\b[^>]*>.*?</label>", " ")

    def bare(tag: Column) -> Column:
        asks = ~(F.rlike(tag, F.lit("(?i)^<input")) & F.lower(_attribute(tag, "type")).isin("hidden", "submit", "button"))
        named = (_attribute(tag, "aria-label") != "") | (_attribute(tag, "aria-labelledby") != "") | (_attribute(tag, "title") != "")
        own = _attribute(tag, "id")
        return asks & _reachable(tag) & ~named & ~((own != "") & F.array_contains(owners, own))

    return F.size(F.filter(_tags(outside, r"(?is)<(?:input|select|textarea)\b[^>]*>"), bare))


def _unnamed(html: Column) -> Column:
    """Buttons that can be reached and have neither text, a picture's text nor a name by attribute."""
    ids = F.transform(_tags(html, r"(?is)<[a-z][^>]*\sid\s*=[^>]*>"), lambda t: _attribute(t, "id"))
    buttons = F.concat(_tags(html, r"(?is)<button\b[^>]*>.*?</button>"), _tags(html, r"(?is)<(?!button\b)([a-z][a-z0-9]*)\b[^>]*\srole\s*=\s*[\"']?button\b[^>]*>.*?</\1>"))

    def bare(button: Column) -> Column:
        tag = F.regexp_extract(button, r"(?s)^<[^>]*>", 0)
        pictured = F.exists(_tags(button, r"(?is)<img\b[^>]*>"), lambda t: F.trim(_attribute(t, "alt")) != "")
        named = (_attribute(tag, "aria-label") != "") | (_attribute(tag, "title") != "") | F.arrays_overlap(F.split(_attribute(tag, "aria-labelledby"), r"\s+"), ids)
        return _reachable(tag) & ~named & ~pictured & (trimmed(F.regexp_replace(button, r"(?s)<[^>]*>", "")) == "")

    return F.size(F.filter(buttons, bare))


def measure(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html): what a page's source shows of headings, title, language, images, fields, buttons, meta tags and links.

    Comments, scripts and styles do not count; null html counts as empty. Only the source is read: what a style sheet hides is not known.
    """
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", " ")
    rows = once(pages.select("page_id", "url", "html"), {"size": F.length(F.coalesce("html", F.lit(""))), "html": bare})
    html = F.col("html")
    metas = _tags(html, r"(?is)<meta\b[^>]*>")
    meta = lambda key, value: F.filter(metas, lambda t: _attribute(t, key) == value)
    told = F.get(F.filter(F.concat(meta("name", "description"), meta("property", "og:description")), lambda t: _has(t, "content")), F.lit(0))
    return rows.select(
        "page_id", host(F.col("url")).alias("app"), F.regexp_count(html, F.lit(r"(?i)<h1[\s>]")).alias("h1_count"), F.rlike(html, F.lit(r"(?is)<html\b[^>]*\slang\s*=\s*[\"']?[^\s\"'>]")).alias("lang_set"),
        F.rlike(html, F.lit(r"(?is)<title[^>]*>\s*[^<\s]")).alias("title_set"),
        F.size(F.filter(_tags(html, r"(?is)<img\b[^>]*>"), lambda t: ~_has(t, "alt") & (_attribute(t, "role") != "presentation"))).alias("images_no_alt"),
        _unlabelled(html).alias("inputs_no_label"), _unnamed(html).alias("buttons_no_name"), F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")).alias("links"),
        (F.size(meta("name", "viewport")) > 0).alias("viewport"), (F.coalesce(_attribute(told, "content"), F.lit("")) != "").alias("description"),
        (F.size(meta("property", "og:title")) > 0).alias("og_title"), (F.size(meta("property", "og:image")) > 0).alias("og_image"),
        F.exists(_tags(html, r"(?is)<link\b[^>]*>"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "icon")).alias("favicon"), "size",
    )


def findings(measures: DataFrame) -> DataFrame:
    """One row for each finding of a page: (page_id, app, finding, severity, what).

    Besides what ``measure`` gives, counts of a live visit may stand in columns broken_images, collapsed_maps, empty_regions, overflow_px and
    broken_links. What is null or has no column was not measured and is no finding.
    """
    tests = {"no_h1": F.col("h1_count") == 0, "many_h1": F.col("h1_count") > 1}
    tests |= {f"no_{c}": ~F.col(m) for c, m in (("lang", "lang_set"), ("viewport", "viewport"), ("description", "description"), ("og_image", "og_image")) if m in measures.columns}
    found = []
    for name, severity, what in RULES:
        number = "h1_count" if name == "many_h1" else name
        if name not in tests and number not in measures.columns:
            continue
        bad = tests[name] if name in tests else F.col(number) > 0
        told = F.replace(F.lit(what), F.lit("{n}"), F.col(number).cast("string")) if "{n}" in what else F.lit(what)
        found.append(F.when(bad, F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), told.alias("what"))))
    return measures.select("page_id", "app", F.explode(F.array_compact(F.array(*found))).alias("f")).select("page_id", "app", "f.*")


def severity_totals(found: DataFrame) -> DataFrame:
    """Findings by severity for each app and, with app null, for all; every row also counts the pages concerned."""
    return found.rollup("app").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count_distinct("page_id").alias("pages")
    )


def _own_links(html: Column) -> Column:
    """Routes that a page links to on its own site, in their order; // leads to another host."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    return F.transform(F.filter(hrefs, lambda h: F.rlike(h, F.lit("^/(?!/)"))), normalise_route)


def route_of(url: Column) -> Column:
    return normalise_route(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))


def internal_links(pages: DataFrame) -> DataFrame:
    """Distinct (app, route) that pages of the app link to on their own site, without queries and fragments."""
    return pages.select(host(F.col("url")).alias("app"), F.explode(F.array_distinct(_own_links(F.col("html")))).alias("route")).distinct()


def broken_internal_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to routes that no page of the app has, or whose every answer had a status of 400 or more where pages has a column status.

    A null status is a request without an answer.
    """
    if "status" in pages.columns:
        pages = pages.where("status < 400")
    return links.join(pages.select(host(F.col("url")).alias("app"), route_of(F.col("url")).alias("route")).distinct(), ["app", "route"], "left_anti")


def discover_routes(pages: DataFrame, budget: int = BUDGET, seeds: int = SEEDS) -> DataFrame:
    """pages(page_id, url, html) to (app, route, rank): the start page, what it links to, then what the first of those link to, up to a budget.

    Routes count in the order in which a visitor meets them and are ranked by name. Where several pages have one route the smallest page_id
    counts. An app without a start page has that route alone; pages without a host belong to no app.
    No more than ``budget`` routes of a page go through a shuffle: more can never be taken.
    """
    routed = pages.select("page_id", host(F.col("url")).alias("app"), route_of(F.col("url")).alias("route"), "html").where("app <> ''")
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min_by("next", "page_id").alias("next"))
    may = F.filter(_own_links(F.col("html")), lambda r: ~is_destructive(r) & (r != "/"))
    found = F.slice(F.array_distinct(may), 1, budget).alias("next")
    home = first(routed.where("route = '/'").select("app", "page_id", found), "app")
    start = routed.select("app").distinct().join(home, "app", "left").select("app", F.coalesce("next", F.array().cast("array<string>")).alias("next"))
    going = home.select("app", F.posexplode(F.slice("next", 1, seeds)).alias("seed", "route"))
    on = first(routed.join(going, ["app", "route"]).select("app", "seed", "page_id", found), "app", "seed")
    lists = start.select("app", F.lit(-1).alias("seed"), F.concat(F.array(F.lit("/")), "next").alias("next")).unionByName(on.select("app", "seed", "next"))
    met = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seed", "next"))), lambda x: x["next"])))
    kept = lists.groupBy("app").agg(F.sort_array(F.slice(met, 1, budget)).alias("routes"))
    return kept.select("app", F.posexplode("routes").alias("rank", "route")).select("app", "route", (F.col("rank") + 1).alias("rank"))


def worst(rows: DataFrame, by: str, measure_: str, row_id: str, n: int = 3) -> DataFrame:
    ranked = F.row_number().over(Window.partitionBy(by).orderBy(F.col(measure_).desc(), row_id))
    return rows.withColumn("rank", ranked).filter(F.col("rank") <= n)


# What a sweep of live pages takes for a dead page, a login and an asset that no page needs.
DEAD_TEXTS = [
    (r"(?i)this deployment (cannot be found|has been deleted)", "deployment deleted"),
    (r"(?i)404: NOT_FOUND|DEPLOYMENT_NOT_FOUND", "deployment not found"),
    (r"(?i)Application error: a client-side exception", "client-side exception"),
    (r"(?i)Internal Server Error", "internal server error"),
]
LOGIN = r"(?i)\b(sign in|log ?in|sign up|continue with|magic link|send sign-in link|email me a link|authenticate)\b"
NEEDLESS = r"(?i)insights|analytics|gtag|googletagmanager|hotjar|clarity|sentry|posthog|vitals"
NEEDED_TYPES = ["document", "script", "stylesheet"]
PLATFORM_ERROR = r"DEPLOYMENT_NOT_FOUND|DEPLOYMENT_PAUSED|DEPLOYMENT_DISABLED|NOT_FOUND_ERROR"
LEAST_TEXT, LOGIN_TEXT, BODY_READ = 60, 900, 8_000


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def request_severity(kind: Column, status: Column, url: Column) -> Column:
    """Whether a request's failure is fatal to the page, needless to it, or nothing."""
    failed = (status >= 400) & kind.isin(NEEDED_TYPES)
    return F.when(failed & F.rlike(url, F.lit(NEEDLESS)), "needless").when(failed, "fatal").otherwise("none")


def sweep_verdict(probes: DataFrame) -> DataFrame:
    """probes(page_id, status, title, text, requires_auth, fatal, page_errors, sw_broken, needless, csp): the first verdict that applies, and why.

    ``fatal``, ``page_errors``, ``needless`` and ``csp`` are counts; nulls count as absent, a null text as empty.
    """
    text = trimmed(F.coalesce("text", F.lit("")))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = lambda c: F.coalesce(F.col(c), F.lit(False))
    say = lambda verdict, note: F.struct(F.lit(verdict).alias("verdict"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))
    status = F.concat(F.lit("HTTP "), F.col("status"))
    named = F.when(F.length("title") > 0, F.col("title"))
    cases = [
        (told("requires_auth"), say("auth_wall", "not open to anyone")),
        (count("status") == 0, say("unreachable", "no response")),
        (F.col("status") >= 500, say("server_error", status)),
        (F.col("status") == 404, say("not_found", status)),
        *[(F.rlike(text, F.lit(pattern)), say("broken", label)) for pattern, label in DEAD_TEXTS],
        (count("fatal") > 0, say("broken", F.concat(F.col("fatal"), F.lit(" fatal requests")))),
        (count("page_errors") > 0, say("js_exception", F.concat(F.col("page_errors"), F.lit(" exceptions")))),
        (F.length(text) < LEAST_TEXT, say("renders_nothing", F.concat(F.length(text), F.lit(" characters")))),
        (F.rlike(text, F.lit(LOGIN)) & (F.length(text) < LOGIN_TEXT), say("ok_login_wall", F.coalesce(named, F.lit("login")))),
        (told("sw_broken"), say("ok_sw_broken", "no offline support")),
        (count("needless") > 0, say("ok_analytics_404", F.concat(F.col("needless"), F.lit(" needless requests")))),
        (count("csp") > 0, say("ok_csp_warnings", F.concat(F.col("csp"), F.lit(" policy violations")))),
    ]
    verdict = say("ok", F.coalesce(named, F.lit("renders")))
    for test, said in reversed(cases):
        verdict = F.when(test, said).otherwise(verdict)
    return probes.select("page_id", verdict.alias("v")).select("page_id", "v.verdict", "v.note")


def reached_target(fetches: DataFrame) -> DataFrame:
    """fetches(page_id, url, landed, status, body): null status is a failed request; whether the page asked for is what was got."""
    body = F.substring(F.coalesce("body", F.lit("")), 1, BODY_READ)
    title = trimmed(F.regexp_extract(body, r"<title[^>]*>([^<]*)", 1))
    why = (
        F.when(F.col("status").isNull(), "request failed").when(host(F.col("landed")) != host(F.col("url")), "off-origin")
        .when(F.rlike(body, F.lit(PLATFORM_ERROR)) | F.rlike(title, F.lit(r"^(404|500|503):")), "platform error").when(~F.col("status").between(200, 299), "status").otherwise("ok")
    )
    return fetches.select("page_id", why.alias("reached"))
