"""Equations, captions, tables, replies, figures: forms with the reading they must have."""

import json

import pytest
from pyspark.sql import functions as F

from folia.functions import captions, coercion, tables
from folia.operators import equations, figures


def one(spark, expr, c=None):
    return spark.createDataFrame([(c,)], "c string").select(expr.alias("x")).first()["x"]


def test_equation_parts(spark):
    c = F.col("c")
    assert one(spark, equations.split_numbered(c), "a = b (1) c=d (2) and some prose") == ["a = b (1)", "c = d (2)"]
    assert one(spark, equations.split_numbered(c), " ") == []
    assert one(spark, equations.printed_number(c), "x = 1 (3) y (12)") == 12 and one(spark, equations.printed_number(c), "none") is None
    assert one(spark, equations.latex_like(c), "P tot ≤ α × β") == r"P_{tot} \le \alpha \times \beta"
    for text, rejected in (("", True), ("ab", True), ("a = b + c", False), ("The rate of the samples is shown in Table 2 with all of the values", True), ("✓ yes no", True)):
        assert one(spark, equations.rejections(c)["rejected"], text) is rejected, text
    assert one(spark, equations.confidence(c, c, F.lit(False))["level"], "f(x = a + b") == "needs_review"
    assert one(spark, equations.confidence(c, c, F.lit(True))["level"], "f(x) = a + b") == "repaired"
    for text, frag in ((")", True), ("(4)", True), ("12", True), ("", True), ("x", False), ("a = b", False)):
        assert one(spark, equations.is_fragment(c), text) is frag, text
    assert one(spark, equations.drop_fragment_blocks(c), "x [Equation 1: a = b] y [Equation 2: )] z") == "x [Equation 1: a = b] y z"


def test_equations_of_documents(spark):
    rows = [(1, 0, "E = m c + (a"), (1, 1, ")"), (1, 2, "(4)"), (1, 3, "u = v (7) w = x + y (8)"), (1, 4, "u=v (7)"), (1, 5, None), (2, 0, "It is shown in Table 3 that the samples were measured with the rate")]
    got = equations.extract_equations(spark.createDataFrame(rows, "doc long, pos long, raw string"), "doc", "pos", "raw").orderBy("equation_id").collect()
    assert [(r["equation_id"], r["num"], r["confidence"]) for r in got] == [("eq001", None, "repaired"), ("eq002", 7, "repaired"), ("eq003", 8, "repaired")]
    assert got[0]["raw_text"].endswith(")") and {r["doc"] for r in got} == {1}


def test_merged_captions(spark):
    c = F.col("c")
    got = one(spark, captions.split_merged(c), "Head Fig. 1. Short. Table S2: Values; Fig. 1. A longer text of it")
    assert [(r["id"], r["caption"]) for r in got] == [("fig_01", "Fig. 1. A longer text of it"), ("table_S2", "Table S2: Values")]
    assert one(spark, captions.split_merged(c), "no label") == [] and one(spark, captions.split_merged(c), None) == []
    assert one(spark, captions.is_cross_reference(c), "Table 19, available online). For the") is True
    assert one(spark, captions.is_cross_reference(c), "Table 19. Values of the load") is False


def test_captions_are_freed_of_body_text(spark):
    c = F.col("c")
    long = "Fig. 1. Values of the load over time in all of the runs that were made here."
    assert one(spark, captions.sanitise(c), long + "\nAcknowledgements\nWe thank all") == long
    assert one(spark, captions.sanitise(c), long + " In the next section we go on.") == long
    assert one(spark, captions.sanitise(c), None) == ""
    assert len(one(spark, captions.sanitise(c), "Fig. 1. " + "Word after word. " * 90)) <= 650
    text = "Before.\nFig. 1. Values of the\nload over time.\nAfter."
    cap, mark = F.array(F.lit("Fig. 1. Values of the load over time.")), F.array(F.lit("[Figure 1]"))
    assert one(spark, captions.remove_leaked(c, cap, mark), text) == "Before.\n [Figure 1] \nAfter."
    assert one(spark, captions.remove_leaked(c, F.array(F.lit("a (b")), mark), text) == text  # too short to look for


def test_table_lines(spark):
    c = F.col("c")
    for line, kind in (("Table 3. Values", "3"), ("TABLE S2 Loads", "S2"), ("Table 4 shows loads", None), ("Table 1. wi is unknown", None), ("Table 2), see", None)):
        assert one(spark, tables.caption_number(c), line) == kind, line
    for line, stop in (("Fig. 3 shows", True), ("3.1 Discussion of it", True), ("References", True), ("32", False), ("0.5  0.7", False), ("Okunre et al.", True)):
        assert one(spark, tables.stop_line(c), line) is stop, line
    body = "a  b\n1  2\n3  4\nPublished by Anyone\n5  6\nThese results show that the load was higher in all of the runs than in the rest"
    got = one(spark, tables.clean_body(c), body)
    assert got["body"] == "a  b\n1  2\n3  4\n5  6" and set(got["reasons"]) == {"removed_header_footer_line", "removed_trailing_prose"}
    q = one(spark, tables.quality(c, F.lit("")), "x")
    assert q["needs_review"] and "too_few_table_lines" in q["reasons"] and "missing_caption" in q["reasons"]
    assert one(spark, tables.quality(c, F.lit("Loads")), "sample  a  b  c  of all the runs that were made\n" * 8 + "1 2\n3 4")["score"] == 0.85
    assert one(spark, tables.quality(c, c), None)["score"] == 0.0
    assert one(spark, tables.clean_caption(c), "Loads of\nall runs\nTable 4. Next")["caption"] == "Loads of\nall runs"
    assert one(spark, tables.same_table(F.lit("Table 2"), c, F.lit("TABLE 2"), F.lit("a b\n1 2\n3 4")), "a b\n1 2") is True
    assert one(spark, tables.same_table(F.lit("Table 2"), c, F.lit("Table 3"), c), "a b\n1 2") is False


SCHEMA = coercion.Schema(enums={"kind": ("bar_chart", "photo")}, scores={"clarity": (1, 5)}, counts={"panels": 1}, booleans=("legend",), lists=("labels",), strings=("note",))
FULL = {"kind": "photo", "clarity": 3, "panels": 2, "legend": True, "labels": ["a"], "note": "n"}


@pytest.mark.parametrize(
    ("change", "value", "changed", "error"),
    [
        ({}, {}, 0, None),
        ({"kind": "Bar-Chart"}, {"kind": "bar_chart"}, 1, None),
        ({"kind": "pie"}, {"kind": "pie"}, 0, "kind invalid value"),
        ({"clarity": "4"}, {"clarity": 4}, 1, None),
        ({"clarity": 3.0}, {"clarity": 3}, 0, None),
        ({"clarity": 9}, {"clarity": 9}, 0, "clarity not an int in [1,5]"),
        ({"clarity": True}, {"clarity": None}, 0, "clarity not an int in [1,5]"),
        ({"panels": 0}, {"panels": 1}, 1, None),
        ({"panels": None}, {"panels": None}, 0, "missing or unreadable panels"),
        ({"legend": "No"}, {"legend": False}, 1, None),
        ({"legend": "maybe"}, {"legend": None}, 0, "legend not a boolean"),
        ({"labels": "a"}, {"labels": []}, 1, None),
        ({"note": 5}, {"note": "5"}, 1, None),
        ({"note": None}, {"note": ""}, 1, None),
    ],
)
def test_strict_coercion(spark, change, value, changed, error):
    c = coercion.coerce(F.col("c"), SCHEMA)
    got = spark.createDataFrame([(json.dumps(FULL | change),)], "c string").select(c.alias("x")).select("x", coercion.first_error(F.col("x"), SCHEMA).alias("e")).first()
    assert got["x"].asDict() == FULL | value | {"n_changed": changed} and got["e"] == error


def test_other_policies(spark):
    reply = json.dumps({"type": "Bars", "clarity": 11})
    policy = coercion.Policy(aliases={"kind": {"bars": "bar_chart"}}, key_aliases={"type": "kind"}, defaults={"panels": 1, "legend": False}, clamp=True)
    got = one(spark, coercion.coerce(F.col("c"), SCHEMA, policy), reply)
    assert (got["kind"], got["clarity"], got["panels"], got["legend"]) == ("bar_chart", 5, 1, False) and got["n_changed"] >= 4
    for bad in ("[1]", "no json", None):
        x = coercion.coerce(F.col("c"), SCHEMA)
        got = spark.createDataFrame([(bad,)], "c string").select(x.alias("x")).select("x", coercion.first_error(F.col("x"), SCHEMA).alias("e")).first()
        assert got["x"] is None and got["e"] == "root is not a JSON object"
    assert one(spark, coercion.section_map(F.col("c")), '{"Intro": "a", "Methodology": "b", "Odd": "c", "summary": "d"}') == {"introduction": "a", "methods": "b", "discussion": "c\n\nd"}


def test_figures_find_their_sections(spark):
    f = spark.createDataFrame([("a", 1, 2, {"results": 3, "methods": 1}), ("a", 2, 9, None), ("a", 3, 1, {}), ("b", 4, 5, None), (None, 5, 1, None), ("c", 6, 4, {"methods": 1}), ("c", 7, 6, None)], "doi string, k long, page int, m map<string,int>")
    s = spark.createDataFrame([("a", 3, "methods", 0), ("a", 8, "discussion", 1), ("a", 8, "other", 2)], "doi string, page int, role string, order int")
    got = {r["k"]: (r["section"], r["method"]) for r in figures.map_to_sections(f, "doi", "k", "page", "m", s).collect()}
    assert got == {1: ("results", "mention"), 2: ("discussion", "section_page"), 3: ("results", "figure_page"), 4: (None, "unassigned"), 5: (None, "unassigned"), 6: ("methods", "mention"), 7: ("methods", "figure_page")}
    assert figures.map_to_sections(f.where("false"), "doi", "k", "page", "m", s).count() == 0
    assert one(spark, figures.guess_role(F.col("c")), "Our experiments") == "methods"
    assert one(spark, figures.section_key(F.lit(None).cast("string"), F.col("c")), " Data & Code ") == "data_code"
    assert one(spark, figures.fallback_id(F.col("c"), F.lit("table"), F.lit(3)), "odd") == "table_unlabeled_03"


def test_layout(spark):
    b = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("xywh", v, strict=True)])
    w, h = F.lit(90.0), F.lit(90.0)
    assert abs(one(spark, figures.union_share(F.array(b(0, 0, 45, 90), b(30, 0, 30, 90), b(0, 0, 1, 1)), w, h, 90)) - 2 / 3) < 1e-9
    assert one(spark, figures.grid_weights(F.array(b(0, 0, 30, 30), b(60, 60, 30, 30)), w, h)) == [0.5, 0, 0, 0, 0, 0, 0, 0, 0.5]
    assert one(spark, figures.grid_weights(F.array(b(0, 0, 0, 0)), w, h)) == [0.0] * 9
    assert one(spark, figures.imbalance(F.array(*[F.lit(x) for x in (0.5, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0)]))) == 1.0
    assert one(spark, figures.spread(F.array(b(0, 0, 2, 2)), w, h)) == 0.0
    boxes = spark.createDataFrame([(1, (0.0, 0.0, 50.0, 50.0), (80.0, 80.0, 4.0, 4.0)), (1, (70.0, 70.0, 20.0, 20.0), (80.0, 80.0, 4.0, 4.0)), (1, (80.0, 80.0, 1.0, 1.0), None)], "k long, b struct<x:double,y:double,w:double,h:double>, c struct<x:double,y:double,w:double,h:double>")
    assert figures.recover_box(boxes, "k", "b", 8100.0).first()["b"]["w"] == 50.0
    assert figures.recover_box(boxes, "k", "b", 8100.0, "c").first()["b"]["w"] == 20.0


def test_front_matter_and_page_captions(spark):
    pages = F.array(F.lit("Abstract. By a@b.org"), F.lit("text"), F.lit(None).cast("string"), F.lit("Keywords: x"))
    assert [(r["page"], r["classes"]) for r in one(spark, captions.front_matter_pages(pages))] == [(1, ["abstract", "contact"]), (4, ["keywords"])]
    assert [r["page"] for r in one(spark, captions.front_matter_pages(pages, 3))] == [1]
    assert one(spark, captions.caption_from_pages(F.lit("Fig. 3"), F.lit(1), F.array(F.lit("See Fig. 3.\nFig. 31. No.\nFigure 3. Loads\nof runs.\n\nText")))) == "Figure 3. Loads\nof runs."
    assert one(spark, captions.caption_from_pages(F.lit("odd"), F.lit(1), F.array(F.lit("Fig. 3")))) is None
