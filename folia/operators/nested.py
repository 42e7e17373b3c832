"""Deeply nested records to flat tables, by Dewey labels.

Every node of a record (struct, array, map, leaf) gets the ordinals of its path from the root as its label; the label without its
last ordinal is the parent's. Nodes of one schema path form one flat table. The walk over the *schema* happens while the plan is
built; over the *data* there is one expression per path, so a record is read once and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.runtime import not_blank

NODE = T.ArrayType(
    T.StructType(
        [
            T.StructField("dewey", T.ArrayType(T.IntegerType())),
            T.StructField("path", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
)


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All paths of a type: ``a.b`` for a field, ``a[]`` for an element, ``a{}`` for a map's value."""
    if isinstance(schema, T.StructType):
        own = [prefix] if prefix else []
        return own + [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return [prefix, *schema_paths(schema.elementType, f"{prefix}[]")]
    if isinstance(schema, T.MapType):
        return [prefix, *schema_paths(schema.valueType, f"{prefix}{{}}")]
    return [prefix]


def _nodes(e: Column, kind: T.DataType, path: str, dewey: Column, wanted: set[str] | None) -> Column | None:
    """An array of the nodes below ``e`` whose path is wanted, in document order; None if there can be none."""
    parts: list[Column] = []
    below = isinstance(kind, T.StructType | T.ArrayType | T.MapType)
    if wanted is None or path in wanted:
        name = "struct" if isinstance(kind, T.StructType) else "array" if isinstance(kind, T.ArrayType) else "map" if isinstance(kind, T.MapType) else "value"
        value = F.lit(None).cast("string") if below else F.base64(e) if isinstance(kind, T.BinaryType) else e.cast("string")
        node = F.struct(dewey.alias("dewey"), F.lit(path).alias("path"), F.lit(name).alias("kind"), value.alias("value"))
        parts.append(F.when(e.isNotNull(), F.array(node)).otherwise(F.array().cast(NODE)))
    if isinstance(kind, T.StructType):
        for i, f in enumerate(kind.fields):
            part = _nodes(e.getField(f.name), f.dataType, f"{path}.{f.name}", F.concat(dewey, F.array(F.lit(i))), wanted)
            if part is not None:
                parts.append(part)
    elif isinstance(kind, T.ArrayType | T.MapType):
        is_map = isinstance(kind, T.MapType)
        inner, step = (kind.valueType, "{}") if is_map else (kind.elementType, "[]")
        if wanted is None or any(p in wanted for p in schema_paths(inner, path + step)):
            items = F.map_entries(e) if is_map else e
            each = F.transform(
                items, lambda x, i: F.coalesce(_nodes(x.getField("value") if is_map else x, inner, path + step, F.concat(dewey, F.array(i)), wanted), F.array().cast(NODE))
            )
            parts.append(F.coalesce(F.flatten(each), F.array().cast(NODE)))
    return None if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def shred(df: DataFrame, key: str, columns: Iterable[str], paths: Iterable[str] | None = None) -> DataFrame:
    """One row per non-null node: ``(key, dewey, parent, path, kind, value)``.

    ``dewey`` starts with the column's place in ``columns``; struct fields count in schema order, array elements in their order, so
    null elements keep their place although they have no row. ``parent`` is ``dewey`` without its last ordinal (null for a root).
    ``paths`` keeps only those schema paths; a path that doesn't occur in the schema yields no rows. Null columns, empty arrays and empty tables
    give no rows; further columns of ``df`` are not read, whatever their names; repeated keys are kept apart only by the key's value.
    """
    columns, wanted = list(columns), None if paths is None else set(paths)
    src = df.select(df[key].alias("_key"), *[df[c].alias(f"_c{i}") for i, c in enumerate(columns)])
    parts = [
        p
        for i, c in enumerate(columns)
        if (p := _nodes(F.col(f"_c{i}"), src.schema[f"_c{i}"].dataType, c, F.array(F.lit(i)), wanted)) is not None
    ]
    all_nodes = F.concat(*parts) if parts else F.array().cast(NODE)
    n = F.col("n")
    return src.select("_key", F.explode(all_nodes).alias("n")).select(
        F.col("_key").alias(key),
        n["dewey"].alias("dewey"),
        F.when(F.size(n["dewey"]) > 1, F.slice(n["dewey"], 1, F.size(n["dewey"]) - 1)).alias("parent"),
        n["path"].alias("path"),
        n["kind"].alias("kind"),
        n["value"].alias("value"),
    )


def flat_tables(df: DataFrame, key: str, columns: Iterable[str]) -> dict[str, DataFrame]:
    """The nodes grouped by schema path: ``{path: (key, dewey, parent, value)}``, one flat table per path of the schema, each of which shreds only its own path."""
    columns = list(columns)
    found = [p for c in columns for p in schema_paths(df.schema[c].dataType, c)]
    return {p: shred(df, key, columns, [p]).select(key, "dewey", "parent", "value") for p in found}


def srp_children(srp: DataFrame) -> DataFrame:
    """Child rows of parsed replies: ``(srp_id, node, section, entity_pos, proxy_pos, label, parent, value)``.

    ``node`` is summary, relation, entity or proxy; positions are 0-based, -1 where they don't apply. Blank strings have no row, null entities neither;
    an entity whose fields are all null has one.
    """
    kinds = {f.name: f.dataType for f in srp.schema.fields}
    paths = []
    for c in ("section_summaries", "causal_relations"):
        paths += [f"{c}.{f.name}" for f in kinds[c].fields]
    for f in kinds["key_entities"].fields:
        paths += [f"key_entities.{f.name}[]", f"key_entities.{f.name}[].visual_proxies[]"]
    nodes = shred(srp, "srp_id", ["section_summaries", "key_entities", "causal_relations"], paths)
    root, path = F.col("dewey")[0], F.col("path")
    node = F.when(root == 0, "summary").when(root == 2, "relation").when(path.endswith("visual_proxies[]"), "proxy").otherwise("entity")
    return nodes.where((F.col("kind") == "struct") | not_blank(F.col("value"))).select(
        "srp_id",
        node.alias("node"),
        F.regexp_extract(path, r"^\w+\.(\w+)", 1).alias("section"),
        F.when(root == 1, F.col("dewey")[2]).otherwise(-1).cast("int").alias("entity_pos"),
        F.when((root == 1) & (F.size("dewey") > 4), F.col("dewey")[4]).otherwise(-1).cast("int").alias("proxy_pos"),
        F.array_join(F.col("dewey").cast("array<string>"), ".").alias("label"),
        F.array_join(F.col("parent").cast("array<string>"), ".").alias("parent"),
        "value",
    )
