"""Row-image log records: one record carries many rows, each becomes an event."""

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.functions.canonical import canonical_json, image_map
from changeproof.sources.events import Split, actor_column

# Record types that carry rows, and those that only carry statement text.
OP_OF_TYPE = {"write_rows": "insert", "update_rows": "update", "delete_rows": "delete"}
STATEMENT_TYPES = ["query", "intvar", "user_var"]


def differing_columns(before: Column, after: Column) -> Column:
    """Sorted columns whose canonical values differ; a missing column is null."""
    b, a = image_map(before), image_map(after)
    empty = F.array().cast("array<string>")
    names = F.array_sort(
        F.array_union(F.coalesce(F.map_keys(b), empty), F.coalesce(F.map_keys(a), empty))
    )
    null = F.lit("null")
    return F.filter(
        names,
        lambda n: F.coalesce(F.try_element_at(b, n), null) != F.coalesce(F.try_element_at(a, n), null),
    )


def key_image(image: Column, columns: Column) -> Column:
    """Canonical JSON of the key columns only."""
    from changeproof.sources.slot_log import quoted

    row = image_map(image)
    pairs = F.transform(
        F.array_sort(columns), lambda c: F.concat(quoted(c), F.lit(":"), F.try_element_at(row, c))
    )
    return canonical_json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def explode_row_log(
    df: DataFrame,
    key_columns: dict[str, list[str]],
    row_image: str = "full",
    actor: Column | None = None,
) -> Split:
    """Events of `df[type, schema, table, xid, rows array<JSON string>, ...]`.

    Update rows are objects with `before` and `after`. `row_in_record` keeps the place of the
    row; number the batch afterwards over (record position, row_in_record).
    """
    op_map = F.create_map(*[F.lit(x) for pair in OP_OF_TYPE.items() for x in pair])
    keys = F.create_map(
        *[x for e, ks in key_columns.items() for x in (F.lit(e), F.array(*map(F.lit, ks)))]
    )
    staged = (
        df.withColumn("op", F.try_element_at(op_map, F.col("type")))
        .withColumn("entity", F.concat_ws(".", "schema", "table"))
        .withColumn("key_cols", F.try_element_at(keys, F.col("entity")))
    )
    unnamed = F.col("schema").isNull() | F.col("table").isNull() | (F.col("schema") == "") | (F.col("table") == "")
    record_reason = (
        F.when(F.col("type").isNull(), "event_not_object")
        .when(F.col("type").isin(STATEMENT_TYPES), "statement_format_event")
        .when(F.col("op").isNull(), "unknown_event_type")
        .when(unnamed, "missing_table_map")
        .when(F.col("rows").isNull(), "rows_not_array")
        .when(F.col("key_cols").isNull(), "key_columns_required")
    )
    staged = staged.withColumn("reason", record_reason)
    bad_records = staged.filter(F.col("reason").isNotNull()).select(
        *[c for c in df.columns if c != "rows"], "reason"
    )

    carried = [c for c in df.columns if c not in ("rows", "type", "schema", "table", "xid")]
    rows = staged.filter(F.col("reason").isNull()).select(
        "*", F.posexplode("rows").alias("row_in_record", "row")
    )
    is_update = F.col("op") == "update"
    whole = canonical_json(F.col("row"))
    before = F.when(is_update, canonical_json(F.get_json_object("row", "$.before"))).when(
        F.col("op") == "delete", whole
    )
    after = F.when(is_update, canonical_json(F.get_json_object("row", "$.after"))).when(
        F.col("op") == "insert", whole
    )
    rows = rows.withColumn("before", before).withColumn("after", after)
    rows = rows.withColumn("identifying", F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after")))
    own = F.array_sort(F.map_keys(image_map(F.col("identifying"))))
    row_reason = F.when(is_update & F.col("after").isNull(), "update_row_missing_images").when(
        F.coalesce(F.size(F.array_except("key_cols", own)) > 0, F.lit(True)), "row_missing_key_column"
    )
    rows = rows.withColumn("reason", row_reason)
    bad_rows = rows.filter(F.col("reason").isNotNull()).select(
        *[c for c in df.columns if c != "rows"], "reason"
    )

    names = F.when(is_update, differing_columns(F.col("before"), F.col("after"))).otherwise(own)
    if row_image == "full":
        fidelity = F.lit("full")
    else:
        fidelity = F.when(F.col("op") == "delete", "key_only").otherwise("value_only")
    events = rows.filter(F.col("reason").isNull()).select(
        *carried,
        "row_in_record",
        "entity",
        "op",
        key_image(F.col("identifying"), F.col("key_cols")).alias("key"),
        "before",
        "after",
        F.transform(names, lambda n: F.array(n)).alias("paths"),
        F.col("xid").cast("string").alias("tx_id"),
        (actor_column() if actor is None else actor).alias("actor"),
        fidelity.alias("fidelity"),
    )
    return Split(events, bad_records.unionByName(bad_rows))
