"""Screens as node rows: flattening of dumps, matching by selectors, locating one node, and assertions on it.

A dump is any recorded tree text; nodes and selectors are frames. Selectors and assertions are written by hand and refused beyond a bound.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.operators.scale import bounded

# The simple class names that each role stands for.
ROLE_CLASSES = {
    "button": ["Button", "ImageButton", "AppCompatButton", "MaterialButton", "FloatingActionButton", "ExtendedFloatingActionButton"],
    "link": ["TextView", "AppCompatTextView", "MaterialTextView"],
    "heading": ["TextView", "AppCompatTextView", "MaterialTextView"],
    "text": ["TextView", "AppCompatTextView", "MaterialTextView"],
    "textbox": ["EditText", "AppCompatEditText", "TextInputEditText"],
    "checkbox": ["CheckBox", "AppCompatCheckBox", "MaterialCheckBox"],
    "radio": ["RadioButton", "AppCompatRadioButton", "MaterialRadioButton"],
    "switch": ["Switch", "SwitchCompat", "SwitchMaterial", "MaterialSwitch"],
    "image": ["ImageView", "AppCompatImageView", "ShapeableImageView"],
    "tab": ["TabView", "TabItem"],
}
FLAGS = ["checkable", "checked", "clickable", "enabled", "focused", "scrollable", "selected"]
SAMPLES = 5
SELECTORS = (
    "selector_id string, resource_id string, resource_id_suffix string, text string, content_desc string, name_any string, class_name string, "
    "class_in array<string>, nth int, container_id string"
)


def decode_entities(text: Column) -> Column:
    """XML entities resolved in one pass, so that what one yields is not read again."""
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(x: Column) -> Column:
        number = F.regexp_extract(x, r"^&#(\d{1,7});$", 1)
        plain = x
        for entity, character in named.items():
            plain = F.when(x == entity, character).otherwise(plain)
        return F.when(number != "", F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")).otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"&(?:amp|lt|gt|quot|apos|#\d{1,7});|[^&]+|&"), F.lit(0)), one), "")


def parse_bounds(text: Column) -> Column:
    """"[l,t][r,b]" to edges, size and whole-number centre; null where it is not of that form."""
    edge = [F.regexp_extract(text, r"^\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]$", i).try_cast("int") for i in range(1, 5)]
    left, top, right, bottom = edge
    fields = {
        "left": left, "top": top, "right": right, "bottom": bottom, "width": right - left, "height": bottom - top,
        "center_x": F.floor((left + right) / 2).cast("int"), "center_y": F.floor((top + bottom) / 2).cast("int"),
    }
    return F.when(left.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def simple_class(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def accessible_text(text: Column, description: Column) -> Column:
    return F.regexp_replace(F.when(F.length(text) > 0, text).otherwise(description), r"^\s+|\s+$", "")


def flatten_dumps(dumps: DataFrame, dump_id: str = "dump_id", text: str = "dump") -> DataFrame:
    """One row for each node element of each dump, in document order, with typed attributes. Absent texts are empty."""
    raw = F.regexp_extract_all(text, F.lit(r"<node\s((?:[^\"<>]++|\"[^\"]*+\")*+)>"), F.lit(1))
    rows = dumps.select(F.col(dump_id), F.posexplode(raw).alias("index", "raw"))

    def attribute(name: str) -> Column:
        return decode_entities(F.regexp_extract("raw", rf"(?:^|\s){name}=\"([^\"]*)\"", 1))

    texts = {"resource_id": "resource-id", "text": "text", "content_desc": "content-desc", "class_name": "class", "package_name": "package"}
    return rows.select(
        dump_id, "index", *[attribute(a).alias(c) for c, a in texts.items()], *[(attribute(f) == "true").alias(f) for f in FLAGS],
        (attribute("displayed") != "false").alias("displayed"), parse_bounds(attribute("bounds")).alias("bounds"),
    )


def _entry(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def match_nodes(nodes: DataFrame, selectors: DataFrame, dump_id: str = "dump_id", visible: bool = True) -> DataFrame:
    """Pairs of node and selector (SELECTORS) where every stated part holds; a null part demands nothing.

    Each selector is looked up by one of its parts and each node is listed once under each of its values, so that the
    disjunctions (id or its suffix, text or description) become one equality join. Selectors without any part are refused.
    """
    selectors = bounded(selectors, "selectors")
    parts = [
        ("id", F.col("resource_id")), ("suffix", F.substring_index("resource_id_suffix", ":id/", -1)), ("text", F.col("text")), ("desc", F.col("content_desc")),
        ("name", F.col("name_any")), ("class", F.col("class_name")),
    ]
    no_part = F.raise_error(F.concat(F.lit("selector without any part: "), F.coalesce("selector_id", F.lit("null"))))
    roles = F.transform(F.array_distinct("class_in"), lambda c: _entry("simple", c))
    key = F.when(F.col("class_in").isNotNull(), roles).otherwise(F.array(_entry("none", no_part.cast("string"))))
    for kind, value in reversed(parts):
        key = F.when(value.isNotNull(), F.array(_entry(kind, value))).otherwise(key)
    wanted = selectors.select(F.explode(key).alias("k"), F.struct(*selectors.columns).alias("s"))

    listed = F.array_distinct(
        F.array(
            _entry("id", F.col("resource_id")), _entry("suffix", F.substring_index("resource_id", ":id/", -1)), _entry("text", F.col("text")), _entry("desc", F.col("content_desc")),
            _entry("name", F.col("text")), _entry("name", F.col("content_desc")), _entry("class", F.col("class_name")), _entry("simple", simple_class(F.col("class_name"))),
        )
    )
    seen = nodes.filter(F.col("displayed") & F.col("bounds").isNotNull()) if visible else nodes
    found = seen.withColumn("k", F.explode(listed)).join(F.broadcast(wanted), "k").drop("k")

    def holds(wanted_part: str, test: Column) -> Column:
        return F.col(f"s.{wanted_part}").isNull() | test

    suffix = F.col("s.resource_id_suffix")
    keep = (
        holds("resource_id", F.col("resource_id") == F.col("s.resource_id"))
        & holds("resource_id_suffix", (F.col("resource_id") == suffix) | F.endswith(F.col("resource_id"), F.concat(F.lit(":id/"), suffix)))
        & holds("text", F.col("text") == F.col("s.text"))
        & holds("content_desc", F.col("content_desc") == F.col("s.content_desc"))
        & holds("name_any", (F.col("text") == F.col("s.name_any")) | (F.col("content_desc") == F.col("s.name_any")))
        & holds("class_name", F.col("class_name") == F.col("s.class_name"))
        & holds("class_in", F.array_contains("s.class_in", simple_class(F.col("class_name"))))
    )
    chosen = ("selector_id", "nth", "container_id")
    return found.filter(keep).select(*nodes.columns, *[F.col(f"s.{c}").alias(c) for c in chosen])


def contained_in(matches: DataFrame, dump_id: str = "dump_id") -> DataFrame:
    """Matches whose box lies in the box of their container: the only match of selector ``container_id`` in the same dump.

    Matches without a container stay; where a container has no match or several, none of its matches stays.
    """
    boxes = matches.groupBy(dump_id, F.col("selector_id").alias("container_id")).agg(F.count("*").alias("n"), F.first("bounds").alias("box")).filter("n = 1")
    inside = " AND ".join(f"bounds.{a} {c} box.{a}" for a, c in (("left", ">="), ("top", ">="), ("right", "<="), ("bottom", "<=")))
    held = matches.join(boxes, [dump_id, "container_id"]).filter(inside)
    return matches.filter(F.col("container_id").isNull()).unionByName(held.select(*matches.columns))


def locate_one(matches: DataFrame, asked: DataFrame, dump_id: str = "dump_id") -> DataFrame:
    """For each asked(dump_id, selector_id, nth): found, not_found, nth_out_of_range or ambiguous, the node found, and samples.

    Several matches are never settled by taking the first one; only a stated nth (from 0) chooses.
    """
    place = Window.partitionBy(dump_id, "selector_id").orderBy("index")
    ranked = matches.withColumn("place", F.row_number().over(place) - 1)
    node = F.struct("index", "resource_id", "text", "bounds")
    pick = F.coalesce("nth", F.lit(0)) == F.col("place")
    found = ranked.groupBy(dump_id, "selector_id").agg(
        F.count("*").alias("matches"), F.min(F.when(pick, F.col("index"))).alias("index"),
        F.array_sort(F.collect_list(F.when(F.col("place") < SAMPLES, node))).alias("sample"),
    )
    rows = asked.select(dump_id, "selector_id", "nth").join(found, [dump_id, "selector_id"], "left")
    n = F.coalesce("matches", F.lit(0))
    reason = F.when(n == 0, "not_found").when(F.col("nth") >= n, "nth_out_of_range").when(F.col("nth").isNull() & (n > 1), "ambiguous").otherwise("found")
    return rows.select(
        dump_id, "selector_id", "nth", reason.alias("reason"), n.alias("matches"), F.when(reason == "found", F.col("index")).alias("index"),
        F.when(reason.isin("ambiguous", "nth_out_of_range"), F.col("sample")).alias("sample"),
    )


def ui_assertions(located: DataFrame, nodes: DataFrame, asserted: DataFrame, dump_id: str = "dump_id") -> DataFrame:
    """asserted(assert_id, selector_id, kind, equals, state) against what was located in every dump: what was observed and whether it holds.

    Kinds: visible, hidden, text, count (without regard to nth) and state (enabled, disabled, checked, unchecked, focused), where
    a stated text must hold too. Other kinds and states are refused.
    """
    at = nodes.select(dump_id, "index", "text", "content_desc", "enabled", "checkable", "checked", "focused")
    rows = located.join(at, [dump_id, "index"], "left").join(F.broadcast(bounded(asserted, "assertions")), "selector_id")
    found, words = F.col("reason") == "found", accessible_text(F.col("text"), F.col("content_desc"))
    expected = F.regexp_replace("equals", r"^\s+|\s+$", "")
    state = F.col("state")
    refused = F.raise_error(F.concat(F.lit("unknown assertion: "), F.coalesce("kind", F.lit("null")), F.lit(" "), F.coalesce(state, F.lit(""))))
    is_so = (
        F.when(state == "enabled", F.col("enabled")).when(state == "disabled", ~F.col("enabled")).when(state == "checked", F.col("checked"))
        .when(state == "unchecked", F.col("checkable") & ~F.col("checked")).when(state == "focused", F.col("focused")).otherwise(refused.cast("boolean"))
    )
    kind = F.col("kind")
    observed = (
        F.when(kind == "visible", F.when(found, "visible").otherwise(F.col("reason"))).when(kind == "hidden", F.when(found, "visible").otherwise("hidden"))
        .when(kind == "text", F.when(found, words).otherwise(F.col("reason"))).when(kind == "count", F.col("matches").cast("string"))
        .when(kind == "state", F.when(~found, F.col("reason")).when(is_so, state).otherwise(F.concat(F.lit("not_"), state))).otherwise(refused.cast("string"))
    )
    text_holds = F.col("equals").isNull() | (words == expected)
    ok = (
        F.when(kind == "visible", found).when(kind == "hidden", ~found).when(kind == "text", found & (words == expected))
        .when(kind == "count", F.col("matches") == F.col("equals").try_cast("long")).otherwise(found & is_so & text_holds)
    )
    return rows.select("assert_id", dump_id, "selector_id", "kind", observed.alias("observed"), F.coalesce(ok, F.lit(False)).alias("ok"))
