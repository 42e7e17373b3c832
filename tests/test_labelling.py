from pyspark.sql import functions as F

from folia.operators import labelling, models
from folia.operators.labelling import ROLES

SECTIONS = [
    (1, 0, "1", "1 Introduction", "x"), (1, 1, "2", "2 Materials and Methods", "x"), (1, 2, "2.1", "2.1 Samples", "x"), (1, 3, "3", "3 Results", "x"), (1, 4, None, "Peak shapes", "x"),
    (1, 5, None, "Noise", "x"), (1, 6, None, "Related Work", "x"), (1, 7, None, "After that", "x"), (1, 8, None, "Conclusions", "x"), (1, 9, None, "References", "x"),
    (2, 0, None, None, "The results showed that accuracy increased. We found that precision improved significantly."), (2, 1, None, "", ""),
]


def test_sections(spark):
    df = spark.createDataFrame(SECTIONS, "doc long, pos long, num string, heading string, body string")
    got = {(r["doc"], r["pos"]): (r["role"], r["role_source"]) for r in labelling.label_sections(df, "doc", "pos", "heading", "body", "num").collect()}
    assert got[1, 0] == ("introduction", "heading") and got[1, 2] == ("methods", "parent")
    assert got[1, 4] == got[1, 5] == ("results", "propagated")
    assert got[1, 6] == (None, "excluded") and got[1, 7][0] is None and got[1, 9] == (None, "excluded")
    assert got[2, 0] == ("results", "content") and got[2, 1] == (None, "none")
    rep = {r["doc"]: r["complete"] for r in labelling.label_report(labelling.label_sections(df, "doc", "pos", "heading", "body", "num"), "doc").collect()}
    assert rep == {1: True, 2: False}


def test_groups_and_prompts(spark):
    df = spark.createDataFrame([(1, 0, "Background", "a", "intro"), (1, 1, "Results and Discussion", "b", "results"), (1, 2, "End", "c", "conclusion")], "doc long, pos long, heading string, body string, role string")
    got = {r["role"]: r["text"] for r in labelling.group_by_role(df, "doc", "pos", "heading", "body", "role").collect()}
    assert got == {"introduction": "## Background\n\na", "results": "## Results and Discussion\n\nb", "discussion": "## Results and Discussion\n\nb\n\n## End\n\nc"}
    p = df.limit(1).select(labelling.assemble_prompt({"a": F.lit("x" * 30), "b": F.lit(" ")}, 20, ("a", "b")).alias("p")).first()["p"]
    assert p["prompt"].endswith("[TRUNCATED]") and p["error"] == "b is missing"


def test_tables_and_lines(spark):
    page = "Some prose stands here.\nTable 2. Yields of the\nfirst run\nsample  a  b\nx  1  2\ny  3  4\nThis sentence ends the table because it is long prose.\n"
    r = labelling.capture_tables(spark.createDataFrame([(1, 4, page), (2, 1, None)], "doc long, page long, body string"), "doc", "page", "body").collect()
    assert [(x["label"], x["caption"], x["table"]) for x in r] == [("Table 2", "Yields of the first run", "sample  a  b\nx  1  2\ny  3  4")]
    w = spark.createDataFrame([(1, 5.0, 1.0, "b"), (1, 0.0, 1.2, "a"), (1, 0.0, 9.0, "c")], "k long, x double, y double, t string")
    assert [x["line"] for x in labelling.words_to_rows(w, "k", "x", "y", "t", 3.0).orderBy("row").collect()] == ["a b", "c"]


def test_scorer_statuses(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "none")], "k long, p string")
    got = {r["k"]: r["status"] for r in labelling.score_rows(df.coalesce(1), "k", "p", lambda ps: ["{}" if p == "a" else None for p in ps]).collect()}
    assert got == {1: "success", 2: "skipped", 3: "skipped", 4: "empty_response_error"}

    def broken(ps):
        raise OSError

    assert {r["status"] for r in labelling.score_rows(df, "k", "p", broken).collect()} == {"api_error", "skipped"}


def test_policies(spark):
    one = spark.range(1)
    keep = labelling.override_label(F.lit("methods"), F.lit("heading"), F.lit(0.9), F.lit("results"), F.lit(False))
    weak = labelling.override_label(F.lit("methods"), F.lit("content"), F.lit(0.9), F.lit("results"), F.lit(False))
    gone = labelling.override_label(F.lit("methods"), F.lit("heading"), F.lit(0.9), F.lit("results"), F.lit(True))
    assert tuple(one.select(keep.alias("a"), weak.alias("b"), gone.alias("c")).first()) == ("methods", "results", None)
    better = labelling.better_caption(F.lit("Fig. 1"), F.lit("Fig. 1. A whole caption of some length."))
    assert one.select(better.alias("c")).first()["c"].endswith("length.")
    assert len(ROLES) == 4


def test_boundaries_and_inferred_methods(spark):
    rows = [
        (1, 0, "Introduction", "x"), (1, 1, None, "Some text.\n2. Materials and Methods"), (1, 2, "Samples", "y"), (1, 3, "Results", "z"),
        (2, 0, "Introduction", "x"), (2, 1, "Our way", "We used a dataset and trained a model with the learning rate and batch size of the baseline."), (2, 2, "Results", "z"), (2, 3, "Our way", "We used a dataset and trained a model."),
        (3, 0, None, "No headings here"), (3, 1, "References", "a"),
    ]
    df = spark.createDataFrame(rows, "doc long, pos long, heading string, body string")
    got = {(r["doc"], r["pos"]): (r["role"], r["role_source"]) for r in labelling.label_sections(df, "doc", "pos", "heading", "body", most=0).collect()}
    assert got[1, 2] == ("methods", "boundary") and got[1, 3] == ("results", "heading")
    assert got[2, 1] == ("methods", "inferred") and got[2, 3] != ("methods", "inferred")
    assert got[3, 0] == (None, "none") and got[3, 1] == (None, "excluded")


def test_recovery_of_roles(spark):
    rows = [(1, 0, None, "Opening words.", None, "An abstract."), (1, 1, "Procedure", "We used a dataset, trained a model and set parameters of the protocol.", None, None), (1, 2, "Results and Discussion", "Joint.", "results", None), (2, 0, "References", "r", None, "Only this.")]
    df = spark.createDataFrame(rows, "doc long, pos long, heading string, body string, role string, abs string")
    got = {(r["doc"], r["role"]): (r["note"], (r["text"] or "")[-7:]) for r in labelling.recover_roles(df, "doc", "pos", "heading", "body", "role", "abs").collect()}
    assert got[1, "introduction"] == ("first_section", " words.") and got[1, "methods"][0] == "content"
    assert got[1, "results"][0] == "labelled" and got[1, "discussion"] == ("combined_section", " Joint.".strip().rjust(7, "\n"))
    assert got[2, "introduction"] == ("abstract", "y this.") and got[2, "results"] == ("missing", "")


def test_prompt_budgets_and_items(spark):
    one = spark.range(1)
    p = one.select(labelling.assemble_prompt({"a": F.lit("x" * 30), "b": F.lit("y")}, 200, budgets={"a": 5}).alias("p")).first()["p"]["prompt"]
    assert p == "# a\nxxxxx [TRUNCATED]\n\n# b\ny"
    items = F.array(*[F.struct(F.lit(f"Fig. {i}").alias("label"), F.lit("c" * i).alias("caption")) for i in range(1, 4)])
    assert one.select(labelling.items_block(items, "Figures", 2, 1).alias("p")).first()["p"] == "# Figures\n1. Fig. 1: c\n2. Fig. 2: c [TRUNCATED]\n(1 more)"


def test_mentions_and_stops_of_tables(spark):
    page = "Table 1 shows the yields of all runs.\nTable 2. Yields\nsample  a  b\nx  1  2\nFig. 3. A figure\nz  9  9\nReferences"
    r = labelling.capture_tables(spark.createDataFrame([(1, 4, page)], "doc long, page long, body string"), "doc", "page", "body").collect()
    assert [(x["label"], x["table"]) for x in r] == [("Table 2", "sample  a  b\nx  1  2")]
    parts = spark.createDataFrame([(1, 2, "3", "Yields", "a  b"), (1, 3, "3", "", "1  2"), (1, 3, "4", None, "x")], "doc long, page long, num string, c string, b string")
    assert sorted(tuple(x) for x in labelling.merge_continued(parts, "doc", "page", "num", "c", "b").collect()) == [(1, "3", 2, "Yields", "a  b\n1  2"), (1, "4", 3, "", "x")]


def test_cells_of_words(spark):
    words = [(1, x, y, 8.0, t) for y, row in ((0.0, ["ab", "c"]), (10.0, ["1", "2"]), (20.0, ["3"])) for x, t in zip((0.0, 100.0), row, strict=False)] + [(1, 9.0, 0.5, 8.0, "b2")]
    got = labelling.words_to_cells(spark.createDataFrame(words, "k long, x double, y double, w double, t string"), "k", "x", "y", "w", "t", 3.0, 20.0).orderBy("row").collect()
    assert [r["cells"] for r in got] == [["ab b2", "c"], ["1", "2"], ["3"]] and abs(got[0]["regular"] - 2 / 3) < 1e-9


def test_model_suites(spark):
    df = spark.range(400).select("id", (F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - F.col("b"))
    assert models.nested_ridge(df, "id", ["a", "b"], "y", (0.1,))["r2"] > 0.99
    ranked = models.ablation(df, "id", {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}, "y", {"a alone": F.col("a")})
    assert [r[1] for r in ranked] == ["ab", "a", "b", "a alone"] and ranked[3][0] == "baseline"
    best = models.rank_correlation_grid(df.select("a", "b", F.col("a").alias("y")), ["a", "b"], "y", 4).first()
    assert best["weights"] == [1.0, 0.0] and abs(best["spearman"] - 1) < 1e-9
