"""Change events from pairs of table snapshots."""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from changeproof.errors import Refused
from changeproof.functions.canonical import canonical_column, pack
from changeproof.operators.scale import number_rows

# What a pair of snapshots cannot show; rules that need it are refused on such a source.
BLIND_SPOTS = ["ordering", "attribution", "round_trips"]


def snapshot_pair(
    spark: SparkSession, before_path: str, after_path: str, tenant: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of one entity, the tenant filter going down to the scan."""
    sides = [spark.read.parquet(p) for p in (before_path, after_path)]
    return tuple(s if tenant is None else s.filter(tenant) for s in sides)


def check_keys(df: DataFrame, keys: list[str], entity: str) -> None:
    if "." not in entity:
        raise Refused("E_SNAPSHOT_DIFF_INVALID", "entity_not_schema_qualified", entity=entity)
    if not keys:
        raise Refused("E_SNAPSHOT_DIFF_INVALID", "key_columns_required", entity=entity)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise Refused("E_SNAPSHOT_DIFF_INVALID", "row_missing_key_column", entity=entity, columns=missing)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row. Counted before the shuffle, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def refuse_duplicates(df: DataFrame, keys: list[str], entity: str) -> None:
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise Refused("E_SNAPSHOT_DIFF_INVALID", "duplicate_key", entity=entity, key=found[0].asDict())


def _side(df: DataFrame, mark: str) -> DataFrame:
    """Prefix the columns; NaN and infinities compare as null."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~(F.isnan(c) | c.isin(float("inf"), float("-inf"))), c)
        out.append(c.alias(mark + f.name))
    return df.select(*out, F.lit(True).alias(mark))


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows with both sides typed: op, changed (sorted names), b_* and a_* columns."""
    b, a = _side(before, "b_"), _side(after, "a_")
    on = reduce(lambda x, y: x & y, [F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys])
    both = b.join(a, on, "full")

    names = sorted(set(before.columns) | set(after.columns))

    def side(mark, df, name):
        return F.col(f"{mark}{name}") if name in df.columns else F.lit(None)

    differs = [
        F.when(~side("b_", before, n).eqNullSafe(side("a_", after, n)), F.lit(n)) for n in names
    ]
    own = lambda df: F.array(*[F.lit(n) for n in sorted(df.columns)])
    op = (
        F.when(F.col("b_").isNull(), "insert").when(F.col("a_").isNull(), "delete").otherwise("update")
    )
    changed = (
        F.when(op == "insert", own(after))
        .when(op == "delete", own(before))
        .otherwise(F.array_compact(F.array(*differs)))
    )
    return both.withColumn("op", op).withColumn("changed", changed).filter(F.size("changed") > 0)


def diff_entity(
    before: DataFrame,
    after: DataFrame,
    keys: list[str],
    entity: str,
    window: Callable[[Callable[[str], Column]], dict[str, Column]] | None = None,
    check: bool = True,
) -> DataFrame:
    """Change events of one entity. A snapshot pair carries no transaction, sequence or author.

    `window` maps a reader of the current row (after, else before) to extra columns,
    normally the window key.
    """
    for side in (before, after):
        check_keys(side, keys, entity)
        if check:
            refuse_duplicates(side, keys, entity)
    rows = changed_rows(before, after, keys)

    def image(df, mark):
        plain = rows.select(*[F.col(mark + c).alias(c) for c in df.columns])
        packed = _prefixed_image(plain, mark, df.columns)
        return F.when(F.col(mark).isNotNull(), packed)

    def current(name):
        return F.coalesce(F.col(f"a_{name}"), F.col(f"b_{name}"))

    key_before = _prefixed_image(rows.select(*[F.col(f"b_{k}").alias(k) for k in keys]), "b_", keys)
    key_after = _prefixed_image(rows.select(*[F.col(f"a_{k}").alias(k) for k in keys]), "a_", keys)
    extra = window(current) if window else {}
    return rows.select(
        *[c.alias(n) for n, c in extra.items()],
        F.lit(entity).alias("entity"),
        F.col("op"),
        F.when(F.col("op") == "delete", key_before).otherwise(key_after).alias("key"),
        image(before, "b_").alias("before"),
        image(after, "a_").alias("after"),
        F.transform("changed", lambda c: F.array(c)).alias("paths"),
        F.lit(None).cast("string").alias("tx_id"),
        F.lit(None).cast("long").alias("seq"),
        unknown_actor().alias("actor"),
        F.lit("full").alias("fidelity"),
    )


def _prefixed_image(plain: DataFrame, mark: str, columns: list[str]) -> Column:
    """row_image over prefixed columns of the same types."""
    fields = [plain.schema[c] for c in sorted(columns)]
    packed = F.struct(
        *[
            canonical_column(F.col(f"`{mark}{f.name}`"), f.dataType).alias(f.name)
            for f in fields
        ]
    )
    return pack(packed)


def unknown_actor() -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit("unknown").alias("kind"),
        null.alias("id"),
        null.alias("application_name"),
        null.alias("lsn"),
    )


@dataclass
class EntityPair:
    entity: str
    keys: list[str]
    before: DataFrame
    after: DataFrame
    window: Callable | None = field(default=None)


def diff_snapshots(pairs: list[EntityPair], number: bool = True, check: bool = True) -> DataFrame:
    """All entities' events; `idx` follows declared entity order, then key order."""
    parts = [
        diff_entity(p.before, p.after, p.keys, p.entity, p.window, check).withColumn(
            "entity_pos", F.lit(i)
        )
        for i, p in enumerate(pairs)
    ]
    events = reduce(DataFrame.unionByName, parts)
    return number_rows(events, ["entity_pos", "key"]) if number else events

