"""Queries of the core operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators.nested import srp_children
from folia.operators.packed import index_fields, split_packed
from folia.runtime import table

_NB = "NOT regexp_full_match({0}, '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}\\x{{feff}}\\x{{200b}}]*')"
_SECTIONS = ("introduction", "methods", "results", "discussion")
_RELATIONS = ("intro_to_methods", "methods_to_results", "results_to_discussion")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srp_children(table(spark, sf_dir, "srp")).select("srp_id", "node", "section", "entity_pos", "proxy_pos")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every child table, with label, parent link and value."""
    return srp_children(table(spark, sf_dir, "srp"))


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "stage1_ga_index"), "row_id", index_fields(table(spark, sf_dir, "category_list")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_split(spark, sf_dir).where(F.col("n_values") >= 2).select("row_id", "field", F.col("pos").cast("int").alias("pos"), "val")


def _p3_sql() -> str:
    parts = []
    for node, col, fields in (("summary", "section_summaries", _SECTIONS), ("relation", "causal_relations", _RELATIONS)):
        for f in fields:
            parts.append(f"SELECT srp_id, '{node}' AS node, '{f}' AS section, -1 AS entity_pos, -1 AS proxy_pos FROM srp WHERE {col}.{f} IS NOT NULL AND {_NB.format(f'{col}.{f}')}")
    for f in _SECTIONS:
        ents = f"SELECT srp_id, unnest(key_entities.{f}) AS e, unnest(range(len(key_entities.{f}))) AS i FROM srp"
        parts.append(f"SELECT srp_id, 'entity', '{f}', i, -1 FROM ({ents}) WHERE e IS NOT NULL")
        prox = f"SELECT srp_id, i, unnest(e.visual_proxies) AS v, unnest(range(len(e.visual_proxies))) AS j FROM ({ents}) WHERE e IS NOT NULL"
        parts.append(f"SELECT srp_id, 'proxy', '{f}', i, j FROM ({prox}) WHERE v IS NOT NULL AND {_NB.format('v')}")
    return "SELECT srp_id, node, section, CAST(entity_pos AS INTEGER) AS entity_pos, CAST(proxy_pos AS INTEGER) AS proxy_pos FROM (" + " UNION ALL ".join(parts) + ")"


def _p3_tables_sql() -> str:
    parts = []
    for root, node, col, fields in ((0, "summary", "section_summaries", _SECTIONS), (2, "relation", "causal_relations", _RELATIONS)):
        for n, f in enumerate(fields):
            parts.append(f"SELECT srp_id, '{node}' AS node, '{f}' AS section, -1 AS entity_pos, -1 AS proxy_pos, '{root}.{n}' AS label, '{root}' AS parent, {col}.{f} AS value FROM srp WHERE {col}.{f} IS NOT NULL AND {_NB.format(f'{col}.{f}')}")
    for n, f in enumerate(_SECTIONS):
        ents = f"SELECT srp_id, unnest(key_entities.{f}) AS e, unnest(range(len(key_entities.{f}))) AS i FROM srp"
        parts.append(f"SELECT srp_id, 'entity', '{f}', i, -1, '1.{n}.' || i, '1.{n}', NULL FROM ({ents}) WHERE e IS NOT NULL")
        prox = f"SELECT srp_id, i, unnest(e.visual_proxies) AS v, unnest(range(len(e.visual_proxies))) AS j FROM ({ents}) WHERE e IS NOT NULL"
        parts.append(f"SELECT srp_id, 'proxy', '{f}', i, j, '1.{n}.' || i || '.2.' || j, '1.{n}.' || i || '.2', v FROM ({prox}) WHERE v IS NOT NULL AND {_NB.format('v')}")
    return "SELECT * REPLACE (CAST(entity_pos AS INTEGER) AS entity_pos, CAST(proxy_pos AS INTEGER) AS proxy_pos) FROM (" + " UNION ALL ".join(parts) + ")"


def _p5_sql(found: bool = True) -> str:
    """ISSNs by their form; categories by finding every entry of the list in the cell (none is part of another)."""
    issn = "SELECT row_id, 'issn' AS field, k AS pos, substr(v, 1, 4) || '-' || right(v, 4) AS val FROM (SELECT row_id, k, upper(regexp_replace(list_extract(a, CAST(k AS INTEGER)), '[^0-9Xx]', '', 'g')) AS v FROM (SELECT row_id, a, unnest(range(1, len(a) + 1)) AS k FROM (SELECT row_id, regexp_extract_all(issn, '[0-9]{4}\\s*[-–]?\\s*[0-9]{3}[0-9Xx]') AS a FROM stage1_ga_index WHERE issn IS NOT NULL)))"
    parts = [issn]
    for f in ("subject_categories", "scimago_categories"):
        cell = f"SELECT row_id, replace(replace({f}, '\"\"', '\"'), '\\\"', '\"') AS x FROM stage1_ga_index WHERE {f} IS NOT NULL"
        hits = f"SELECT row_id, category, k FROM (SELECT row_id, x, category, unnest(range(1, length(x) + 1)) AS k FROM ({cell}) JOIN category_list ON contains(x, category)) WHERE substr(x, k, length(category)) = category"
        parts.append(f"SELECT row_id, '{f}' AS field, row_number() OVER (PARTITION BY row_id ORDER BY k) AS pos, category AS val FROM ({hits})")
    columns, kept = ("", " WHERE n >= 2") if found else ("CAST(n AS INTEGER) AS n_values, ", "")
    return f"SELECT row_id, field, CAST(pos AS INTEGER) AS pos, {columns}val FROM (SELECT *, count(*) OVER (PARTITION BY row_id, field) AS n FROM (" + " UNION ALL ".join(parts) + "))" + kept


QUERIES = {"p3_found": p3_found, "p3_tables": p3_tables, "p5_found": p5_found, "p5_split": p5_split}
SQL = {"p3_found": _p3_sql(), "p3_tables": _p3_tables_sql(), "p5_found": _p5_sql(), "p5_split": _p5_sql(False)}
