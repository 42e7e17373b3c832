import pytest
from pyspark.sql import functions as F

from folia.functions import geometry, replies, text, values


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


#: Headings and labels with the reading they must have.
@pytest.mark.parametrize(
    ("heading", "label"),
    [("Introduction", "introduction"), ("1. Background", "introduction"), ("Related Work", None), ("2 Materials and Methods", "methods"), ("Results and Discussion", "results"), ("Conclusion", "discussion"), ("Acknowledgments", None), ("XRD", "results"), ("Practical implication of electrochemical sensor in real water samples", "results"), ("Discussion, implications, and limitations", "discussion"), ("Cyclic voltammetry", "results"), ("E = mc^2", None), ("", None)],
)
def test_headings(spark, heading, label):
    assert one(spark, text.classify_heading(F.col("h"))["label"], h=heading) == label


@pytest.mark.parametrize(("label", "ident", "key"), [("Fig. A.1", "fig_A_1", "figure:A:1"), ("Figure 3", "fig_03", "figure::3"), ("Supplementary Figure 8b", "fig_S8", "figure:S:8"), ("TABLE 12", "table_12", "table::12"), ("nothing", None, None)])
def test_labels(spark, label, ident, key):
    got = one(spark, text.parse_label(F.col("c")), c=label)
    assert (got and got["id"], got and got["key"]) == (ident, key)


def test_mentions(spark):
    assert one(spark, text.mention_numbers(F.col("c")), c="see Figs. 2-4, 6 and 8, and Fig. 1a; Table 3") == [1, 2, 3, 4, 6, 8]
    assert one(spark, text.mention_numbers(F.col("c"), "table"), c="Tables 1 and 3") == [1, 3]


def test_casts(spark):
    assert one(spark, values.number(F.col("c")), c="1,200%") == 1200.0
    assert one(spark, values.number(F.col("c")), c="nan") is None
    assert one(spark, values.whole(F.col("c")), c="2.5") == 2
    assert one(spark, values.year_of(F.col("c")), c="12-03-1999") == 1999
    assert one(spark, values.year_of(F.col("c")), c="n 3000") is None
    assert one(spark, values.py_round(F.col("c"), 2), c=2.675) == round(2.675, 2)
    assert one(spark, values.file_key(F.col("c")), c="https://dx.doi.org/10.1/A-b") == "10_1_a_b"
    assert one(spark, values.presence_flag(F.col("c")), c="implied") is True
    assert one(spark, values.row_mean(F.lit(None).cast("double"), F.col("c")), c=4.0) == 4.0


def test_text(spark):
    assert one(spark, text.clean_artifacts(F.col("c"), True), c="ﬁne mea-\nsure ,  x\r\n\n\n\ny") == "fine measure, x\n\ny"
    assert one(spark, text.is_code(F.col("c")), c="import a\nx = 1\n# c\nfor i in x:\nreturn y\nprint(x)") is True
    assert one(spark, text.trim_caption(F.col("c"), 10, 30), c="First part. Second part that is longer") == "First part."
    assert one(spark, text.incomplete_caption(F.col("c")), c="The range of the") is True
    assert one(spark, text.issns(F.col("c")), c="12345678, 1234-567x") == ["1234-5678", "1234-567X"]


@pytest.mark.parametrize(("reply", "mode"), [('{"a": 1}', "direct"), ('<think>x</think>```json\n{"a": 1}\n```', "salvaged"), ('Here: {"a": [1, 2,],}', "repaired"), ('{"a": ', "failed"), ("", "empty"), (None, "empty")])
def test_replies(spark, reply, mode):
    assert one(spark, replies.parse_reply(F.col("c"))["mode"], c=reply) == mode


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("xywh", v, strict=True)])
    assert one(spark, geometry.iou(box(0, 0, 2, 2), box(1, 0, 2, 2)), c=1.0) == pytest.approx(1 / 3)
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), c=1.0) == 0.0
    assert one(spark, geometry.suspect_reasons(box(0, 0, 10, 600)), c=1.0) == ["small_side", "extreme_aspect"]


def test_normal_forms(spark):
    """Headings and journal titles reduced to what tells them apart."""
    for heading, want in (("2.1.  Results & Discussion: ", "results and discussion"), ("IV. Data_sets/Code", "data sets code"), ("(a) Set-up -", "set-up"), ("Intro", "intro"), ("3", "3"), (None, "")):
        assert one(spark, text.normal_heading(F.col("h")), h=heading) == want
    assert one(spark, text.journal_keys(F.col("c")), c="The Journal of Heat & Mass (Online)") == ["journal of heat and mass", "heat and mass", "journal of heat mass", "journalofheatandmass"]
    assert one(spark, text.journal_key(F.col("c")), c="  A–Z Letters! ") == "a z letters"
    for heading, want in (("E = mc", True), ("λ", True), ("Growth of λ phages in many cold tanks", False), ("n + rate laws", False), ("Plain words", False), ("a > b", False)):
        assert one(spark, text.equation_heading(F.col("h")), h=heading) is want
    assert one(spark, text.is_code(F.col("c")), c="From here on\nthe text\nis only\nprose of\nsix whole\nlines.") is False


def test_symbols(spark):
    assert one(spark, text.clean_artifacts(F.col("c")), c="3 Â 4 ( a ) , 5 AE 6 fig .2 − x") == "3 × 4 (a), 5 ± 6 Fig. 2 - x"
    assert one(spark, text.remap_glyphs(F.col("c")), c="\uf061 \uf0b3 \uf044 𝐱") == "α ≥ Δ x"
    assert len(text._SYMBOL_UPPER) == len(text._SYMBOL_LOWER) == 26 and len(text._SYMBOL_SIGNS) == 0xFE - 0xA1 + 1
