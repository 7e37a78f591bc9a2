"""Canonical JSON, entity names and path patterns as column expressions."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

SEP = "\u0001"


def canonical_json(text: Column) -> Column:
    """Sorted keys, normalised numbers; null when the text is not JSON."""
    return whole_number(F.to_json(F.try_parse_json(text)))


def whole_number(text: Column) -> Column:
    """A number that is whole in its integer form, so that 1e2, 100.0 and 100 are the same text."""
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def image_map(image: Column) -> Column:
    """A row image as column -> canonical JSON text of its value."""
    parsed = F.from_json(image, "map<string,variant>")
    return F.transform_values(parsed, lambda _, v: whole_number(F.to_json(v)))


def json_value(image: Column, name: str) -> Column:
    """Text of one top-level column; null when absent or JSON null."""
    return F.get_json_object(image, f"$['{name}']")


def canonical_column(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # NaN and infinities have no JSON form; adding zero drops the sign of -0.
        finite = ~(F.isnan(c) | c.isin(float("inf"), float("-inf")))
        return F.when(finite, c + F.lit(0.0))
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.struct(F.base64(c).alias("$bytes")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c


def pack(struct: Column) -> Column:
    """Canonical JSON of a struct; null fields stay visible, because a null column counts."""
    return F.to_json(F.parse_json(F.to_json(struct, {"ignoreNullFields": "false"})))


def row_image(df: DataFrame, columns: list[str]) -> Column:
    """Canonical JSON object of typed columns."""
    fields = [df.schema[name] for name in sorted(columns)]
    return pack(
        F.struct(*[canonical_column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    )


def fingerprint(image: Column) -> Column:
    return F.sha2(image, 256)


def table_name(entity: Column) -> Column:
    return F.element_at(F.split(entity, r"\."), -1)


def entity_matches(declared: Column, actual: Column) -> Column:
    return (declared == actual) | (declared == table_name(actual))


def path_key(path: Column) -> Column:
    return F.array_join(path, ".")


def glob_regex(segment: Column) -> Column:
    """`*` stays inside its segment; every other character is literal."""
    literal = F.replace(segment, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("^\\Q"), F.replace(literal, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))


def path_matches(path: Column, pattern: Column) -> Column:
    segments = F.split(pattern, r"\.")

    def one(pair: Column) -> Column:
        value, segment = pair["value"], pair["segment"]
        return F.when(F.contains(segment, F.lit("*")), F.rlike(value, glob_regex(segment))).otherwise(
            value == segment
        )

    paired = F.zip_with(path, segments, lambda v, s: F.struct(v.alias("value"), s.alias("segment")))
    return (F.size(path) == F.size(segments)) & F.forall(paired, one)


def first_segments(paths: Column) -> Column:
    return F.transform(paths, lambda p: p[0])


def where_matches(where: Column, image: Column) -> Column:
    """Every declared column equals the image canonically; a missing column is null.

    No declared columns is a match; declared columns without an image are not.
    """
    row = image_map(image)
    null = F.lit("null")
    same = F.forall(
        F.map_entries(where),
        lambda e: F.coalesce(F.try_element_at(row, e["key"]), null)
        == F.coalesce(canonical_json(e["value"]), e["value"], null),
    )
    return F.when(where.isNull(), F.lit(True)).otherwise(F.coalesce(row.isNotNull() & same, F.lit(False)))


def compared_image(op: Column, key: Column, before: Column, after: Column) -> Column:
    """The image a declaration is compared with: before for deletes, else after; else the key."""
    return F.when(op == "delete", F.coalesce(before, key)).otherwise(F.coalesce(after, key))


def changed_matches(changed: Column, paths: Column) -> Column:
    return changed.isNull() | (F.size(F.array_except(changed, first_segments(paths))) == 0)
