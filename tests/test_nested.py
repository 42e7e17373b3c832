from pyspark.sql import Row

from folia.operators.nested import flat_tables, schema_paths, shred, srp_children

SCHEMA = "k long, a struct<x:string,y:array<struct<z:string,w:array<string>>>>, m map<string,int>, node string, path string, dewey string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def brute(k, a):
    """Paths and labels by walking the value itself."""
    out = []

    def walk(v, path, label):
        if v is None:
            return
        out.append((k, tuple(label), path))
        if isinstance(v, dict):
            for i, (n, x) in enumerate(v.items()):
                walk(x, f"{path}.{n}", [*label, i])
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, path + "[]", [*label, i])

    walk(a, "a", [0])
    return out


CASES = [
    {"x": "s", "y": [{"z": "1", "w": ["p", None, " "]}, None, {"z": None, "w": None}]},
    {"x": None, "y": []},
    {"x": "", "y": None},
    None,
]


def test_labels_equal_a_walk(spark):
    df = rows(spark, [(i, c, None, "n", "p", "d") for i, c in enumerate(CASES)] + [(None, CASES[0], None, None, None, None)])
    got = sorted((r["k"], tuple(r["dewey"]), r["path"]) for r in shred(df, "k", ["a"]).collect() if r["k"] is not None)
    assert got == sorted(x for i, c in enumerate(CASES) for x in brute(i, c))


def test_parents_are_labels_cut_short_and_exist(spark):
    got = shred(rows(spark, [(1, CASES[0], {"q": 3}, None, None, None)]), "k", ["a", "m"]).collect()
    labels = {tuple(r["dewey"]) for r in got}
    assert all(r["parent"] is None if len(r["dewey"]) == 1 else tuple(r["parent"]) in labels for r in got)


def test_repeated_rows_and_empty_tables(spark):
    df = rows(spark, [(1, CASES[0], None, None, None, None)] * 2)
    n = shred(df.limit(1), "k", ["a"]).count()
    assert shred(df, "k", ["a"]).count() == 2 * n
    assert shred(df.where("false"), "k", ["a"]).count() == 0
    assert shred(df, "k", ["a"], paths=["a.nothing"]).count() == 0


def test_flat_tables_have_one_table_per_path(spark):
    df = rows(spark, [(1, CASES[0], None, None, None, None)])
    tables = flat_tables(df, "k", ["a"])
    assert set(tables) == set(schema_paths(df.schema["a"].dataType, "a"))
    assert [r["value"] for r in tables["a.y[].w[]"].orderBy("dewey").collect()] == ["p", " "]


def test_children_of_replies(spark):
    sec = "introduction:{0},methods:{0},results:{0},discussion:{0}"
    kind = f"srp_id long, section_summaries struct<{sec.format('string')}>, key_entities struct<{sec.format('array<struct<entity:string,type:string,visual_proxies:array<string>>>')}>, causal_relations struct<intro_to_methods:string,methods_to_results:string,results_to_discussion:string>, section string"
    ents = [None, Row(entity=None, type=None, visual_proxies=[" ", "a", "\u00a0"])]
    df = spark.createDataFrame([(7, ("x", " ", "\u00a0", None), (None, ents, [], None), (None, "r", ""), "clash"), (8, None, None, None, None)], kind)
    got = {(r["node"], r["section"], r["entity_pos"], r["proxy_pos"]) for r in srp_children(df).collect()}
    assert got == {("summary", "introduction", -1, -1), ("relation", "methods_to_results", -1, -1), ("entity", "methods", 1, -1), ("proxy", "methods", 1, 1)}
