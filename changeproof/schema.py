"""Shared schemas and closed vocabularies."""

from pyspark.sql import types as T

# The closed vocabularies of the event row.
OPS = ["insert", "update", "delete"]
ACTOR_KINDS = ["app_session", "harness", "external", "unknown"]
FIDELITY_LEVELS = ["full", "key_only", "value_only"]
RULE_KINDS = ["volatile_columns", "derived", "external_writer", "ignore"]
BUCKETS = ["expected", "explained", "suppressed_external", "unexplained"]
RESULTS = ["pass", "fail", "infra_error", "skipped", "quarantined"]
DELTA_CODES = [
    "E_DELTA_MISSING_MUTATION",
    "E_DELTA_UNEXPLAINED",
    "E_RULE_TOO_BROAD",
    "E_RULE_EXPIRED",
    "E_DELTA_FIDELITY_INSUFFICIENT",
]
DEFAULT_RULE_CAP = 50
DEAD_RULE_RUNS = 3
EXPIRING_SOON_DAYS = 7

# The columns that name one change window; every operator is keyed by them.
WINDOW = ["run_id", "scenario_id", "surface", "window_seq"]

# Entity of the marker rows a harness writes into the log itself.
MARKER_ENTITY = "changeproof.marker"

MAX_SAFE_INTEGER = 2**53 - 1

_WINDOW_FIELDS = [
    T.StructField("run_id", T.StringType()),
    T.StructField("scenario_id", T.StringType()),
    T.StructField("surface", T.StringType()),
    T.StructField("window_seq", T.IntegerType()),
]

ACTOR = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("application_name", T.StringType()),
        T.StructField("lsn", T.StringType()),
    ]
)

# key, before and after are canonical JSON objects; idx is the arrival order.
CHANGE_EVENTS = T.StructType(
    [
        *_WINDOW_FIELDS,
        T.StructField("idx", T.LongType()),
        T.StructField("entity", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("paths", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("tx_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("actor", ACTOR),
        T.StructField("fidelity", T.StringType()),
    ]
)

# where holds one JSON literal per column, e.g. {"status": "\"created\"", "total_cents": "9900"}.
EXPECTATIONS = T.StructType(
    [
        *_WINDOW_FIELDS,
        T.StructField("exp_idx", T.IntegerType()),
        T.StructField("entity", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("where", T.MapType(T.StringType(), T.StringType())),
        T.StructField("changed", T.ArrayType(T.StringType())),
    ]
)

RULES = T.StructType(
    [
        T.StructField("ruleset_id", T.StringType()),
        T.StructField("rule_pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("cap", T.LongType()),
        T.StructField("paths", T.ArrayType(T.StringType())),
        T.StructField("caused_entity", T.StringType()),
        T.StructField("caused_op", T.StringType()),
        T.StructField("per_source", T.LongType()),
        T.StructField("identity_by", T.StringType()),
        T.StructField("identity_not_equals", T.StringType()),
        T.StructField("rule_op", T.StringType()),
        T.StructField("expires", T.DateType()),
    ]
)
