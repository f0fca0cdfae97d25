"""Documents of any shape: walking JSON as VARIANT values, level by level, without a declared schema.

A walk is a chain of explosions inside one stage: at each level a container hands on itself, closed, and its children,
open; what is closed passes through. A document is parsed once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels below the root that a profile opens.
LEVELS = 8
ROOT = "$"
OBJECT, ARRAY, SCALAR = "object", "array", "scalar"


def parsed(text: Column) -> Column:
    """The text as VARIANT; null where it isn't JSON."""
    return F.try_parse_json(text)


def is_broken(text: Column, value: Column) -> Column:
    """Text that is there, and isn't JSON."""
    return has_text(text) & value.isNull()


def has_text(text: Column) -> Column:
    return text.rlike(r"\S")


def walk(
    df: DataFrame, value: str, keep: Sequence[str], levels: int, opens: Mapping[str, str] | None = None
) -> DataFrame:
    """One row for each node of the VARIANT column `value`: `keep`, `path` (any place in an array is `[]`), `place`
    (with positions), `level`, `type` (object, array, string, number, boolean, null), `size` (keys, elements,
    characters of a text), and `value` for nodes that were not opened.

    Nodes down to `levels` are listed; with `opens`, only nodes at its paths are opened, and only if they are of the
    kind (object or array) it names. A key that is no plain word is quoted. Null values give no row.
    """
    node = F.struct(
        F.lit(ROOT).alias("path"),
        F.lit(ROOT).alias("place"),
        F.lit(0).alias("level"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("int").alias("size"),
        F.col(value).alias("value"),
    )
    now = df.filter(F.col(value).isNotNull()).select(*keep, node.alias("node"))
    for _ in range(levels + 1):
        now = now.select(*keep, F.explode(_opened(F.col("node"), levels, opens)).alias("node"))
    return now.select(*keep, "node.*")


def _opened(node: Column, levels: int, opens: Mapping[str, str] | None) -> Column:
    """A closed node as it is; an open one closed, and its children."""
    value = node["value"]
    entries = F.map_entries(value.try_cast("map<string, variant>"))
    elements = value.try_cast("array<variant>")
    to_open = (entries.isNotNull() | elements.isNotNull()) & (node["level"] < levels)
    if opens is not None:
        objects, arrays = ([p for p, kind in opens.items() if kind == k] for k in (OBJECT, ARRAY))
        wanted = (entries.isNotNull() & node["path"].isin(objects)) | (elements.isNotNull() & node["path"].isin(arrays))
        to_open = to_open & wanted

    def child(path: Column, place: Column, of: Column) -> Column:
        return F.struct(
            path.alias("path"),
            place.alias("place"),
            (node["level"] + 1).alias("level"),
            F.lit(None).cast("string").alias("type"),
            F.lit(None).cast("int").alias("size"),
            of.alias("value"),
        )

    def key(entry: Column) -> Column:
        name = entry["key"]
        quoted = F.concat(F.lit('."'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(name.rlike(r"^\w+$"), F.concat(F.lit("."), name)).otherwise(quoted)

    inside = F.transform(entries, lambda e: child(F.concat(node["path"], key(e)), F.concat(node["place"], key(e)), e["value"]))
    among = F.transform(
        elements,
        lambda x, i: child(F.concat(node["path"], F.lit("[]")), F.concat(node["place"], F.lit("["), i, F.lit("]")), x),
    )
    kind, size = _facts(value)
    closed = F.struct(
        node["path"].alias("path"),
        node["place"].alias("place"),
        node["level"].alias("level"),
        kind.alias("type"),
        size.alias("size"),
        F.when(~to_open, value).alias("value"),
    )
    with_children = F.concat(F.array(closed), F.coalesce(inside, among))
    opened = F.when(to_open, with_children).otherwise(F.array(closed))
    return F.when(node["type"].isNotNull(), F.array(node)).otherwise(opened)


def _facts(value: Column) -> tuple[Column, Column]:
    entries, elements = value.try_cast("map<string, variant>"), value.try_cast("array<variant>")
    scalar = F.schema_of_variant(value)
    text = value.try_cast("string")
    kind = (
        F.when(entries.isNotNull(), OBJECT)
        .when(elements.isNotNull(), ARRAY)
        .when(F.is_variant_null(value), "null")
        .when(scalar == "STRING", "string")
        .when(scalar == "BOOLEAN", "boolean")
        .otherwise("number")
    )
    size = F.when(entries.isNotNull(), F.size(entries)).when(elements.isNotNull(), F.size(elements))
    return kind, size.when(scalar == "STRING", F.length(text))


def profile_keys(texts: DataFrame, text: str, levels: int = LEVELS) -> DataFrame:
    """Keys and types at each level of JSON texts of any shape: `level`, `path`, `type`, how often (`n`), and the
    least and greatest `size` (keys of an object, elements of an array, characters of a string).

    One pass, combined before the only shuffle; the result grows with the number of unlike paths. Texts that aren't
    JSON count as type `broken` at the root; null and blank ones aren't counted. Containers at `levels` are listed
    but not opened.
    """
    value = parsed(F.col(text))
    rows = texts.select(F.col(text).alias("text"), value.alias("value"))
    nodes = walk(rows, "value", (), levels).select("level", "path", "type", "size")
    broken = rows.filter(is_broken(F.col("text"), F.col("value"))).select(
        F.lit(0).alias("level"), F.lit(ROOT).alias("path"), F.lit("broken").alias("type"), F.lit(None).cast("int").alias("size")
    )
    return (
        nodes.unionByName(broken)
        .groupBy("level", "path", "type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))
    )


def declared(schema: T.DataType, path: str = ROOT) -> Iterator[tuple[str, str]]:
    """Each path of a declared shape and what is expected there."""
    if isinstance(schema, T.StructType):
        yield path, OBJECT
        for field in schema:
            yield from declared(field.dataType, f"{path}.{field.name}")
    elif isinstance(schema, T.ArrayType):
        yield path, ARRAY
        yield from declared(schema.elementType, f"{path}[]")
    else:
        yield path, SCALAR


def strays(df: DataFrame, value: str, keep: Sequence[str], schema: T.DataType) -> DataFrame:
    """What a declared shape has no place for: one row for each field that isn't declared (`undeclared`) and each
    declared one that holds another kind of value (`mismatched`), with its `place` and its whole `value`.

    Only declared containers are opened, so a stray part of any depth stays one value. A JSON null fits everywhere.
    """
    expected = dict(declared(schema))
    opens = {path: kind for path, kind in expected.items() if kind != SCALAR}
    levels = max(path.count(".") + path.count("[]") for path in expected)
    fits = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    wanted = F.try_element_at(fits, F.col("path"))
    found = F.when(F.col("type").isin(OBJECT, ARRAY), F.col("type")).otherwise(SCALAR)
    reason = F.when(wanted.isNull(), "undeclared").when((wanted != found) & (F.col("type") != "null"), "mismatched")
    nodes = walk(df, value, keep, levels, opens)
    return nodes.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*keep, "reason", "place", "path", "value")
