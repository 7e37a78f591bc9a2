"""Redaction and secret search over documents, customers and pages."""

from pyspark.sql import functions as F

from changeproof.operators import privacy as P
from changeproof.plans import derive as D
from changeproof.plans.register import Register

REGISTER = Register()
query = REGISTER.query

SECRETS = ["Licensed under the Apache License", "Licensed under", "short"]
TOKEN = r'token\s*=\s*"[0-9a-f]{40}"'
MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"


@query("SELECT c_custkey, 'sha256:' || substr(sha256(c_name), 1, 12) AS c_name, '[REDACTED]' AS c_mktsegment FROM customer")
def redact_columns(spark, sf_dir):
    once = P.redact_columns(D.table(spark, sf_dir, "customer"), {"c_name": "hash", "c_mktsegment": "mask"})
    return P.redact_columns(once, {"c_name": "hash", "c_mktsegment": "mask"}).select("c_custkey", "c_name", "c_mktsegment")


@query(
    """SELECT c_custkey, 'sha256:' || substr(sha256('"' || c_name || '"'), 1, 12) AS c_name, 'sha256:' || substr(sha256(c_nationkey::VARCHAR), 1, 12) AS c_nationkey, replace(c_mktsegment, 'MACHINERY', '[REDACTED]') AS c_mktsegment FROM customer"""
)
def redact_entity(spark, sf_dir):
    """Customers under entries for this table, for any and for another, twice over."""
    rows = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    policy = ["shop.customer.c_name", "*.c_nationkey", "shop.orders.c_custkey"]
    return P.redact_entity(P.redact_entity(rows, "shop.customer", policy, "hash", ("MACHINERY",)), "shop.customer", policy)


def _text_sql(text: str) -> str:
    """Registered secrets, longest first; then three runs of 8 or more with dots between, the first after eyJ; then Bearer and 12 or more."""
    for secret in ("Licensed under the Apache License", "Licensed under"):
        text = f"replace({text}, '{secret}', '[REDACTED]')"
    part = "[A-Za-z0-9_-]{8,}"
    text = f"regexp_replace({text}, '\\beyJ{part}\\.{part}\\.{part}\\b', '[REDACTED]', 'g')"
    return f"regexp_replace({text}, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/-]{{12,}}=*', '[REDACTED]', 'g')"


# Each text with tokens after it, long and short, so that every form of token is met.
TAIL = " eyJ0123abcd.ABCDefgh01.xyz_-0123 eyJshort.ABCDefgh01.xyz_-0123 bearer of good news, BEARER  abc.def~0123==, Bearer "
TAILED_SQL = f"text || '{TAIL}' || substr(md5(doc_id::VARCHAR), 1, 9 + doc_id % 7)"


def _tailed(docs):
    return F.concat("text", F.lit(TAIL), F.expr("substr(md5(cast(doc_id as string)), 1, 9 + cast(doc_id % 7 as int))"))


@query(f"SELECT doc_id, sha256({_text_sql(TAILED_SQL)}) AS text_sha256 FROM documents")
def redact_text(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(P.redact_text(_tailed(docs), SECRETS), 256).alias("text_sha256"))


# Fixed values, as in the operator: parameter names that are always redacted.
DENIED = "token|access_token|refresh_token|apikey|api_key|key|sig|signature|password|secret"


@query(
    f"""SELECT page_id, regexp_replace(regexp_replace(split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Sig=a' || page_id || '&api%5Fkey=b&monkey=c&SECRET' || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END,
      '(?i)([?&](?:{DENIED}|api%5Fkey))=[^&#]*', '\\1=[REDACTED]', 'g'), '(?i)([?&](?:{DENIED}))(&|#|$)', '\\1=[REDACTED]\\2', 'g') AS url FROM pages WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')
    UNION ALL SELECT page_id, '[UNPARSEABLE_URL]' FROM pages WHERE NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')"""
)
def redact_url(spark, sf_dir):
    """Every page's URL with four parameters more, two of them denied under other spellings and one without a value."""
    head, rest = F.regexp_extract("url", "^([^#]*)", 1), F.regexp_extract("url", "(?s)(#.*)$", 1)
    more = F.concat(head, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("Sig=a"), "page_id", F.lit("&api%5Fkey=b&monkey=c&SECRET"), rest)
    return D.table(spark, sf_dir, "pages").select("page_id", P.redact_url(more).alias("url"))


@query("SELECT event_id, '[REDACTED]' AS authorization, '[REDACTED]' AS csrf, event_type || ' [REDACTED]' AS accept FROM events")
def redact_headers(spark, sf_dir):
    headers = P.redact_headers(
        F.create_map(F.lit("Authorization"), F.col("props"), F.lit("X-CSRF-Token"), F.lit("t"), F.lit("accept"), F.concat("event_type", F.lit(" Bearer 0123456789ab")))
    )
    shown = D.table(spark, sf_dir, "events").select("event_id", headers.alias("h"))
    return shown.select("event_id", F.col("h")["Authorization"].alias("authorization"), F.col("h")["X-CSRF-Token"].alias("csrf"), F.col("h")["accept"].alias("accept"))


@query(
    f"""SELECT doc_id, sha256({_text_sql(TAILED_SQL)}) AS note_sha256, '["' || lang || '",[REDACTED],{{"n":' || doc_id || '}}]' AS deep, '[REDACTED] of ' || source AS name FROM documents""".replace("[REDACTED],{", '"[REDACTED]",{')
)
def redact_nested(spark, sf_dir):
    """Documents inside JSON: a text in an array in an object, a token four levels down, and a key that holds a secret."""
    docs = D.table(spark, sf_dir, "documents")
    note = F.to_json(F.struct(F.array(F.struct(_tailed(docs).alias("note"))).alias("items")))
    deep = F.concat(F.lit('{"a":{"b":["'), "lang", F.lit('","Bearer 0123456789abcdef",{"n":'), "doc_id", F.lit('}]},"Licensed under of '), "source", F.lit('":true}'))
    out = docs.select("doc_id", P.redact_nested(note, tuple(SECRETS)).alias("note"), P.redact_nested(deep, tuple(SECRETS)).alias("deep"))
    return out.select(
        "doc_id", F.sha2(F.get_json_object("note", "$.items[0].note"), 256).alias("note_sha256"), F.get_json_object("deep", "$.a.b").alias("deep"),
        F.regexp_extract("deep", r'"(\[REDACTED\] of [^"]*)":true', 1).alias("name"),
    )


def _scan_sql(name: str, pattern: str) -> str:
    return f"""SELECT doc_id AS path, '{name}' AS pattern, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line,
      replace(right(before, 28) || '[REDACTED]' || substr(text, length(before) + length(hit) + 1, 28), chr(10), '\\n') AS preview
      FROM (SELECT *, regexp_extract(text, '{pattern}') AS hit, substr(text, 1, strpos(text, regexp_extract(text, '{pattern}')) - 1) AS before FROM documents) WHERE hit <> ''"""


@query(f"{_scan_sql('token', TOKEN)} UNION ALL {_scan_sql('mail', MAIL)}")
def secret_scan(spark, sf_dir):
    files = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return P.secret_scan(files, {"token": TOKEN, "mail": MAIL})


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '*.' || p_type WHEN 1 THEN 'shop.' || p_brand || '.*' WHEN 2 THEN p_type ELSE 'shop.part.' || p_brand END AS target, CASE WHEN p_size > 45 THEN 'drop' ELSE 'hash' END AS mode FROM part)
    SELECT target, problem, count(*) AS n FROM (SELECT target, unnest([CASE WHEN mode = 'drop' THEN 'unknown_mode' END, CASE WHEN p_partkey % 4 = 1 THEN 'column_wildcard' END, CASE WHEN p_partkey % 4 = 2 THEN 'entity_not_qualified' END]) AS problem FROM p)
    WHERE problem IS NOT NULL GROUP BY ALL"""
)
def redaction_policy_check(spark, sf_dir):
    quarter = F.col("p_partkey") % 4
    target = (
        F.when(quarter == 0, F.concat(F.lit("*."), F.col("p_type"))).when(quarter == 1, F.concat(F.lit("shop."), F.col("p_brand"), F.lit(".*"))).when(quarter == 2, F.col("p_type"))
        .otherwise(F.concat(F.lit("shop.part."), F.col("p_brand")))
    )
    policy = D.table(spark, sf_dir, "part").select(target.alias("target"), F.when(F.col("p_size") > 45, "drop").otherwise("hash").alias("mode"))
    return P.policy_problems(policy).groupBy("target", "problem").agg(F.count("*").alias("n"))
