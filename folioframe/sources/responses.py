"""JSON in columns: stored signatures, detector and recogniser responses, canonical output.

Responses may have any shape. A body is parsed once into a VARIANT and taken apart level by level inside its own row, with higher-order functions and no
shuffle: a variant knows the type of a value but not the order of an object's keys, so the text of each object goes along and gives that order. Arrays
without an object inside (polygons, scores) are read where they are asked for and not taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys in the order in which detectors and recognisers are read.
BOX_KEYS = ("bbox", "box", "layout_bbox", "coordinate", "coordinates", "dt_polys", "poly", "points")
EDGE_KEYS = ("x", "y", "width", "height")
LABEL_KEYS = ("type", "label", "category", "layout_type", "block_type", "region_type")
SCORE_KEYS = ("score", "confidence", "prob")
TEXT_KEYS = ("rec_text", "text", "label")
CONFIDENCE_KEYS = ("rec_score", "confidence", "score", "prob")

#: Levels of nesting that a body may have; one with more is rejected as a whole.
LEVELS = 40
#: Levels opened at a time, so that a flat body is done after the first few; divides LEVELS.
LEVEL_BLOCK = 4
NODE = "struct<path: array<int>, raw: string, v: variant, o: map<string, variant>, a: array<variant>>"
ITEM = "struct<kind: string, score: double, box: struct<left: double, top: double, right: double, bottom: double>, reason: string>"
NUMERIC = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"
NUMBERS = "^ARRAY<(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"
EMPTY_VALUES = ("0", "0.0", "false", "[]", "{}")


def load_json(text: Column, schema: str) -> Column:
    """Typed value of a JSON text; null, blank or malformed text gives null instead of failing."""
    trimmed = F.trim(text)
    return F.when(trimmed != "", F.from_json(trimmed, schema, {"mode": "PERMISSIVE"}))


def dump_json(fields: dict[str, Column]) -> Column:
    """Canonical JSON of named columns: keys sorted, non-ASCII kept."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def _let(name: str, value: str, result: str) -> str:
    """SQL for a result that uses a value more than once."""
    return f"element_at(transform(array({value}), {name} -> {result}), 1)"


def _node(path: str, raw: str, v: str) -> str:
    return (
        f"named_struct('path', {path}, 'raw', {raw}, 'v', {v}, 'o', try_variant_get({v}, '$', 'map<string,variant>'),"
        f" 'a', try_variant_get({v}, '$', 'array<variant>'))"
    )


def _value(n: str, key: str, kind: str) -> str:
    """SQL for the value of a key of an object, null where it has none: a path that a variant lacks ends in an exception inside, so the map is asked."""
    return f"try_variant_get(element_at({n}.o, '{key}'), '$', '{kind}')"


def _children(n: str) -> str:
    """SQL for the objects, and arrays with objects inside, right below a node, in order.

    Only values with a brace in their text become nodes, and an object with no brace but its own is not read again.
    """
    braced = "filter(transform({0}, (t, i) -> named_struct('i', i, 't', t)), c -> contains(c.t, '{{'))"
    node = f"concat({n}.path, array(c.i))"
    held = _let("m", f"from_json({n}.raw, 'map<string,string>')", f"transform({braced.format('map_values(m)')}, c -> {_node(node, 'c.t', f'element_at({n}.o, get(map_keys(m), c.i))')})")
    listed = f"transform({braced.format(f"from_json({n}.raw, 'array<string>')")}, c -> {_node(node, 'c.t', f'get({n}.a, c.i)')})"
    alone = f"locate('{{', {n}.raw, locate('{{', {n}.raw) + 1) = 0"
    nothing = f"CAST(array() AS array<{NODE}>)"
    every = f"CASE WHEN {n}.o IS NOT NULL AND {alone} THEN {nothing} WHEN {n}.o IS NOT NULL THEN {held} WHEN {n}.a IS NOT NULL THEN {listed} ELSE {nothing} END"
    return f"filter({every}, c -> c.o IS NOT NULL OR c.a IS NOT NULL)"


def _before(x: str, y: str) -> str:
    return f"CASE WHEN {x}.path < {y}.path THEN -1 WHEN {x}.path > {y}.path THEN 1 ELSE 0 END"


def opened(responses: DataFrame, key: str, body: str) -> DataFrame:
    """key, `objects` (all objects of a body, each before the ones it holds) and `broken`: why a body could not be read, or null.

    A null or blank body has no objects. An object that repeats a key makes its body malformed.
    """
    source = responses.select(F.col(key), F.col(body).cast("string").alias("raw")).withColumn("v", F.try_parse_json(F.coalesce("raw", F.lit(""))))
    root = F.expr(f"filter(array({_node('CAST(array() AS array<int>)', 'raw', 'v')}), n -> n.o IS NOT NULL OR n.a IS NOT NULL)")
    state = f"struct<front: array<{NODE}>, seen: array<{NODE}>>"
    step = f"CASE WHEN size(s.front) = 0 THEN s ELSE named_struct('front', flatten(transform(s.front, n -> {_children('n')})), 'seen', concat(s.seen, filter(s.front, n -> n.o IS NOT NULL))) END"
    walked = source.withColumn("root", root).withColumn(
        "w", F.expr(f"aggregate(sequence(1, {LEVELS // LEVEL_BLOCK}), CAST(named_struct('front', root, 'seen', array()) AS {state}),"
                    f" (t, b) -> CASE WHEN size(t.front) = 0 THEN t ELSE aggregate(sequence(1, {LEVEL_BLOCK}), t, (s, i) -> {step}) END)"))
    blank = ~F.coalesce("raw", F.lit("")).rlike(r"[^\x20\t\n\r]")
    broken = F.when(F.col("v").isNull() & ~blank, "malformed_body").when(F.size("w.front") > 0, "nested_too_deep")
    objects = F.expr(f"array_sort(w.seen, (x, y) -> {_before('x', 'y')})")
    return walked.select(F.col(key), F.when(broken.isNull(), objects).alias("objects"), broken.alias("broken"))


def _corners(value: str) -> str:
    """SQL for the box of a variant: four numbers as they are, else the extent of the pairs that can be read; null for anything but a list."""
    ends = "filter(transform(q, e -> named_struct('x', try_variant_get(e, '$[0]', 'double'), 'y', try_variant_get(e, '$[1]', 'double'))), e -> e.x IS NOT NULL AND e.y IS NOT NULL)"
    extent = _let("p", ends, "CASE WHEN size(p) > 0 THEN named_struct('left', array_min(p.x), 'top', array_min(p.y), 'right', array_max(p.x), 'bottom', array_max(p.y)) END")
    edges = _let("d", f"try_variant_get({value}, '$', 'array<double>')", "named_struct('left', d[0], 'top', d[1], 'right', d[2], 'bottom', d[3])")
    numbers = f"(size(q) = 4 AND (kind RLIKE '{NUMBERS}' OR (kind = 'ARRAY<VARIANT>' AND forall(q, e -> schema_of_variant(e) RLIKE '{NUMERIC}'))))"
    read = _let("kind", f"schema_of_variant({value})", f"CASE WHEN {numbers} THEN {edges} ELSE {extent} END")
    return _let("q", f"try_variant_get({value}, '$', 'array<variant>')", f"CASE WHEN q IS NOT NULL THEN {read} END")


def _number(n: str, key: str) -> str:
    """SQL for a value that is a number, not a text of one."""
    return f"CASE WHEN schema_of_variant(element_at({n}.o, '{key}')) RLIKE '{NUMERIC}' THEN {_value(n, key, 'double')} END"


def _loose_item(n: str) -> str:
    """SQL for the item that an object is; null where nothing in it means a box."""
    lists = ", ".join(f"CASE WHEN map_contains_key({n}.o, '{k}') THEN {_let('u', f"element_at({n}.o, '{k}')", _corners('u'))} END" for k in BOX_KEYS)
    x, y, w, h = (_value(n, k, "double") for k in EDGE_KEYS)
    edges = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND {w} IS NOT NULL AND {h} IS NOT NULL THEN named_struct('left', {x}, 'top', {y}, 'right', {x} + {w}, 'bottom', {y} + {h}) END"
    has = lambda k: f"map_contains_key({n}.o, '{k}')"
    meant = [f"({has(k)} AND {_value(n, k, 'map<string,variant>')} IS NULL)" for k in BOX_KEYS if k != "dt_polys"] + ["(" + " AND ".join(map(has, EDGE_KEYS)) + ")"]
    empty = ", ".join(f"'{e}'" for e in EMPTY_VALUES)
    labels = ", ".join(
        _let("t", _value(n, k, "string"), f"CASE WHEN t <> '' AND (t NOT IN ({empty}) OR schema_of_variant(element_at({n}.o, '{k}')) = 'STRING') THEN t END") for k in LABEL_KEYS)
    scores = ", ".join(_number(n, k) for k in SCORE_KEYS)
    item = f"named_struct('kind', coalesce({labels}, 'text'), 'score', coalesce({scores}, 0.0D), 'box', b, 'reason', CASE WHEN b IS NULL THEN 'no_usable_box' END)"
    return _let("b", f"coalesce({lists}, {edges})", f"CASE WHEN b IS NOT NULL OR {' OR '.join(meant)} THEN {item} END")


def _polygon_items(n: str) -> str:
    """SQL for the polygons of an object, paired with its scores by place; those of an object with `res` are those of `res`, an object of its own."""
    item = "named_struct('kind', 'text', 'score', coalesce(try_variant_get(get(s, i), '$', 'double'), 0.0D), 'box', b, 'reason', CASE WHEN b IS NULL THEN 'no_usable_box' END)"
    one = _let("b", _corners("p"), item)
    every = _let("s", f"coalesce({_value(n, 'dt_scores', 'array<variant>')}, CAST(array() AS array<variant>))", f"transform({_value(n, 'dt_polys', 'array<variant>')}, (p, i) -> {one})")
    return f"CASE WHEN map_contains_key({n}.o, 'dt_polys') AND {_value(n, 'res', 'map<string,variant>')} IS NULL THEN {every} END"


def _spread(opened_bodies: DataFrame, key: str, items: str) -> DataFrame:
    """key, nth, kind, score, box edges and reason of every item of an array; a body that could not be read is one item with its reason."""
    unread = f"array(CAST(named_struct('kind', NULL, 'score', NULL, 'box', NULL, 'reason', broken) AS {ITEM}))"
    listed = opened_bodies.select(F.col(key), F.posexplode(F.expr(f"CASE WHEN broken IS NOT NULL THEN {unread} ELSE {items} END")).alias("nth", "i"))
    return listed.select(key, "nth", "i.kind", "i.score", "i.box.left", "i.box.top", "i.box.right", "i.box.bottom", "i.reason")


LOOSE = f"CAST(filter(transform(objects, n -> {_loose_item('n')}), i -> i IS NOT NULL) AS array<{ITEM}>)"
POLYGONS = f"CAST(flatten(filter(transform(objects, n -> {_polygon_items('n')}), p -> p IS NOT NULL)) AS array<{ITEM}>)"


def flattened(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Every object with a box at any depth, and what has none that can be read, with the reason. Where a polygon can be read, loose items are left out."""
    found = opened(responses, key, body).select(F.col(key), "broken", F.expr(LOOSE).alias("loose"), F.expr(POLYGONS).alias("polygons"))
    return _spread(found, key, "CASE WHEN exists(polygons, p -> p.reason IS NULL) THEN polygons ELSE concat(loose, polygons) END")


def detection_items(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Boxes of detector responses. Polygons pair with scores by index; where any exist, loose items are ignored."""
    return flattened(responses, key, body).filter("reason IS NULL").drop("reason")


def rejected_items(responses: DataFrame, key: str, body: str) -> DataFrame:
    """What `detection_items` leaves out for want of a readable box or body, with the reason."""
    return flattened(responses, key, body).filter("reason IS NOT NULL").select(key, "nth", "kind", "score", "reason")


def layout_items(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Table and image items of layout responses, polygons beside them or not; text blocks come from the text detector."""
    from folioframe.operators.regions import region_type

    loose = _spread(opened(responses, key, body).select(F.col(key), "broken", F.expr(LOOSE).alias("loose")), key, "filter(loose, i -> i.reason IS NULL)")
    return loose.filter("reason IS NULL").drop("reason").withColumn("kind", region_type(F.col("kind"))).filter(F.col("kind").isin("table", "image"))


def readings(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Text, confidence and, for a body that could not be read, the reason, per recogniser response."""
    blanks = r"^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$"
    text = lambda k: f"CASE WHEN schema_of_variant(element_at(n.o, '{k}')) = 'STRING' THEN regexp_replace(try_variant_get(n.v, '$.{k}', 'string'), '{blanks}', '') END"
    texts = f"flatten(transform(objects, n -> array({', '.join(map(text, TEXT_KEYS))})))"
    scores = f"flatten(transform(objects, n -> array({', '.join(_number('n', k) for k in CONFIDENCE_KEYS)})))"
    found = opened(responses, key, body).select(F.col(key), "broken", F.expr(f"filter({texts}, t -> t <> '')").alias("texts"), F.expr(f"filter({scores}, c -> c IS NOT NULL)").alias("scores"))
    mean = F.expr("CASE WHEN size(scores) > 0 THEN aggregate(scores, 0.0D, (s, c) -> s + c) / size(scores) ELSE 0.0D END")
    return found.select(key, F.coalesce(F.array_join(F.array_distinct("texts"), " "), F.lit("")).alias("text"), mean.alias("confidence"), F.col("broken").alias("reason"))


def recognition(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Distinct texts in first-seen order and the mean of all numeric scores, from objects at any depth of recogniser responses."""
    return readings(responses, key, body).drop("reason")
