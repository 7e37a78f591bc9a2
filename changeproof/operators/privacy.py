"""Redaction of evidence and the search for what redaction missed."""

from pyspark.sql import Column, DataFrame, functions as F

# What stands for a redacted value, the header and parameter names that are always redacted, and the forms of tokens.
REDACTED, UNPARSEABLE = "[REDACTED]", "[UNPARSEABLE_URL]"
HEADERS = ("authorization", "cookie", "set-cookie", "apikey", "x-api-key", "x-auth-token", "proxy-authorization", "x-csrf-token")
PARAMETERS = ("token", "access_token", "refresh_token", "apikey", "api_key", "key", "sig", "signature", "password", "secret")
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{12,}=*"
LEAST_SECRET = 8


def redact_value(value: Column, mode: str) -> Column:
    """hash: sha256: and 12 digits; mask: the mark. Redacted values and nulls stay as they are."""
    text = value.cast("string")
    done = F.rlike(text, F.lit(r"^sha256:[0-9a-f]{12}$")) | (text == REDACTED)
    new = F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 12)) if mode == "hash" else F.lit(REDACTED)
    return F.when(text.isNull() | done, text).otherwise(new)


def redact_columns(df: DataFrame, policy: dict[str, str]) -> DataFrame:
    """policy: column to hash or mask."""
    unknown = {m for m in policy.values() if m not in ("hash", "mask")}
    if unknown:
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    return df.withColumns({c: redact_value(F.col(c), mode) for c, mode in policy.items() if c in df.columns})


def redact_entity(rows: DataFrame, entity: str, sensitive: list[str], mode: str = "hash", secrets: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one entity (schema.table) under a policy of entries `schema.table.col` and `*.col`.

    Sensitive columns become text: the mark, or sha256: and 12 digits of the value as JSON, null too; what is redacted stays. Other
    columns of text lose tokens and secrets, the rest are as they were. Entries of another form, unknown modes and bare entities are refused.
    """
    if mode not in ("hash", "mask"):
        raise ValueError(f"unknown mode: {mode}")
    for entry in sensitive:
        parts = entry.split(".")
        if not all(parts) or "*" in parts[-1] or len(parts) != (2 if parts[0] == "*" else 3):
            raise ValueError(f"not schema.table.col or *.col: {entry}")
    if "." not in entity:
        raise ValueError(f"not schema.table: {entity}")

    def one(name: str) -> Column:
        value = rows[f"`{name}`"]
        if f"*.{name}" in sensitive or f"{entity}.{name}" in sensitive:
            if mode == "mask":
                return F.coalesce(F.when(F.rlike(value.cast("string"), F.lit(r"^sha256:[0-9a-f]{12}$")), value.cast("string")), F.lit(REDACTED)).alias(name)
            json = F.to_json(F.array(value))
            hashed = F.concat(F.lit("sha256:"), F.substring(F.sha2(json.substr(F.lit(2), F.length(json) - 2), 256), 1, 12))
            return F.coalesce(F.when(redact_value(value, "hash") == value.cast("string"), value.cast("string")), hashed).alias(name)
        return redact_text(value, list(secrets)).alias(name) if rows.schema[name].dataType.simpleString() == "string" else value.alias(name)

    return rows.select(*(one(c) for c in rows.columns))


def redact_text(text: Column, secrets: list[str]) -> Column:
    """Registered secrets of 8 characters or more, longest first, then JSON web tokens, then bearer tokens."""
    out = text
    for secret in sorted((s for s in secrets if len(s) >= LEAST_SECRET), key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(secret), F.lit(REDACTED))
    return F.regexp_replace(F.regexp_replace(out, JWT, REDACTED), BEARER, REDACTED)


def redact_headers(headers: Column, secrets: tuple[str, ...] = (), names: tuple[str, ...] = HEADERS) -> Column:
    """Values of deny-listed headers; the other values as text."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*names), F.lit(REDACTED)).otherwise(redact_text(v, list(secrets))))


#: A JSON string with its quotes, once escaped backslashes and quotes are marked.
_STRING = r'"[^"]*"'
_MARKS = (("\\\\", "\u0001"), ('\\"', "\u0002"))


def redact_nested(json: Column, secrets: tuple[str, ...] = ()) -> Column:
    """JSON text of any depth with every key and string value redacted as text; null where the text is not JSON.

    Strings are the only parts of JSON that can hold a quote, so the text falls apart into strings and what stands between them. Each
    string is decoded, redacted and written again, and the parts are put together in their old order: no depth is too great.
    Escaped backslashes and quotes are marked meanwhile by control characters, which JSON text never holds as they are.
    """
    marked = F.to_json(F.try_parse_json(json))
    for escape, mark in _MARKS:
        marked = F.replace(marked, F.lit(escape), F.lit(mark))
    between, strings = F.split(marked, _STRING), F.regexp_extract_all(marked, F.lit(_STRING), F.lit(0))

    def again(s: Column) -> Column:
        for escape, mark in reversed(_MARKS):
            s = F.replace(s, F.lit(mark), F.lit(escape))
        plain = F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0]
        text = F.to_json(F.array(redact_text(plain, list(secrets))))
        return F.substring(text, 2, 1 << 30).substr(F.lit(1), F.length(text) - 2)

    # There is one part more between than there are strings.
    return F.array_join(F.zip_with(between, F.transform(strings, again), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def redact_url(url: Column, names: tuple[str, ...] = PARAMETERS, secrets: tuple[str, ...] = ()) -> Column:
    """Values of deny-listed query parameters, whose names count decoded and in any case; the rest as text.

    What has no scheme and host is not shown at all.
    """
    head, query, tail = (F.regexp_extract(url, r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$", k) for k in (1, 2, 3))

    def one(pair: Column) -> Column:
        name = F.regexp_extract(pair, r"(?s)^([^=]*)", 1)
        denied = F.lower(F.coalesce(F.try_url_decode(name), name)).isin(*names)
        return F.when(denied, F.concat(name, F.lit(f"={REDACTED}"))).otherwise(pair)

    clean = F.concat(F.lit("?"), F.array_join(F.transform(F.split(F.substring(query, 2, 1 << 30), "&"), one), "&"))
    whole = F.concat(head, F.when(query == "", "").otherwise(clean), tail)
    return F.when(F.rlike(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")), redact_text(whole, list(secrets))).otherwise(F.when(url.isNotNull(), F.lit(UNPARSEABLE)))


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based position."""
    return F.length(F.regexp_replace(text.substr(F.lit(1), position - 1), "[^\n]+", "")) + 1


def masked_preview(text: Column, position: Column, length: Column, around: int = 28) -> Column:
    """What stands on both sides of a hit, line ends escaped; the hit itself is masked."""
    start = F.greatest(position - around, F.lit(1))
    before, after = text.substr(start, position - start), text.substr(position + length, F.lit(around))
    return F.replace(F.concat(before, F.lit(REDACTED), after), F.lit("\n"), F.lit("\\n"))


def secret_scan(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """files(path, text): the first hit of every pattern in every file, with its line and a masked preview."""
    rows = []
    for name, pattern in patterns.items():
        hit = F.regexp_extract("text", pattern, 0)
        at = F.regexp_instr("text", F.lit(pattern))
        rows.append(F.when(at > 0, F.struct(F.lit(name).alias("pattern"), at.alias("at"), F.length(hit).alias("length"))))
    found = files.withColumn("hit", F.explode(F.array_compact(F.array(*rows)))).select("path", "text", "hit.*")
    at, length = F.col("at"), F.col("length")
    return found.select("path", "pattern", line_of(F.col("text"), at).alias("line"), masked_preview(F.col("text"), at, length).alias("preview"))


def policy_problems(policy: DataFrame) -> DataFrame:
    """policy(target, mode): entries `schema.table.col` or `*.col`; what is wrong with the others."""
    target, parts = F.col("target"), F.split("target", r"\.")
    column = F.element_at(parts, -1)
    checks = {
        "unknown_mode": ~F.coalesce(F.col("mode").isin("hash", "mask"), F.lit(False)),
        "column_wildcard": F.contains(column, F.lit("*")),
        "entity_not_qualified": ~(F.startswith(target, F.lit("*.")) & (F.size(parts) == 2)) & (F.size(parts) != 3),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in checks.items()]))
    return policy.select("target", F.explode(found).alias("problem"))
