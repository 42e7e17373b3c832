import random

import pytest
from pyspark.sql import functions as F

from folia.llm.truncation import cut_captions, cut_replies, cut_shares, open_at_end, reply_is_cut


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ('{"a": [1, 2]}', ""), ('{"a": [1', "{["), ('{"a": "x', '{"'), ('{"a": "x\\', '{"\\'), ("```json\n{}\n```", ""), ("```json\n{}", "f"), ("<think>x", "<"), ('{"a": "b{["}', ""), ("", ""),
        ('{"a": [1}}', "["), ('{"a": [1}', "["), ('[{"a": 1]', "{"), ('f({"a": 1}', "("), ("<think>a <b>c</b>", "<"), ("<think>a</think>{}", ""), ("<think>{</think>{}", "{"), ('{"a": "<b"}', ""), ("x <thi", "<"), ("a<br>b", ""),
        ('{"a": "\\u00', '{"\\'), ('{"a": "x\\"', '{"'), ("{}\ufffd", "\\"), ("na\xc3\x83", "\\"), ("caf\xe9", ""), ("a â€", "\\"), ("x &am", "\\"), ("AT&T", ""),
    ],
)
def test_automaton(text, left):
    assert open_at_end(text) == left


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ('A 5" pipe was used.', ""), ('It is called "hot', '"'), ('It is called "hot" here.', ""), ("a) first; b) second", ""), ("see (left and [right)", "["), ("see (left", "("), ("the “hot” and “cold", "“"), ("» «x» «", "«"),
        ("{a (b} c", "("), ("a <sub>2", "<"), ("a <sub>2</sub>", ""), ("p < 0.05 and r > 2", ""), ('the ("so-called") x', ""),
    ],
)
def test_automaton_of_running_text(text, left):
    assert open_at_end(text, prose=True) == left


def test_a_missing_terminator_is_judged_by_the_source(spark):
    rows = [(i, "stops", f"The page {i} is empty.") for i in range(60)] + [(100 + i, "bare", f"page {i} left empty") for i in range(60)] + [(200, "stops", "The page is em"), (201, "bare", "page left em"), (202, None, "The page (of")]
    df = spark.createDataFrame(rows, "result_id long, model string, raw_output string").withColumn("raw_output_length", F.lit(None).cast("int"))
    assert sorted(r["result_id"] for r in cut_replies(df).where("truncated").collect()) == [200, 202]


@pytest.mark.parametrize(("text", "noted", "cut"), [('{"a": 1}', 8, False), ('{"a": 1}', 10, False), ('{"a": 1}', 80, True), ('{"a": 1', 7, True), ('{"a": 1}…', 9, True), ("I cannot describe it.", 21, False), ("I cannot desc", 13, True), (" ", 900, False), ('{"a": 1}\nLet me know', 19, False), ('{"a": 1}', None, False)])
def test_replies(text, noted, cut):
    assert reply_is_cut(text, noted) is cut


def test_every_cut_of_a_structure_is_found():
    t = '{"doi": "10.1/x", "s": {"a": "It rose. \\"Well\\".", "b": [1, {"c": null}]}}'
    assert all(open_at_end(t[:k]) for k in range(1, len(t)))


def test_captions(spark):
    rng = random.Random(3)
    things = ["polymer coating", "grain boundary", "optical trap", "battery pack", "neural network", "soil sample"]
    whole = [f"Fig. {i % 8 + 1}. Comparison of {rng.choice(things)} for Xk-{rng.randint(1, 9)} and Bm-{rng.randint(1, 9)}. Arrows point to the {rng.choice(things)}. The {rng.choice(things)} is drawn in grey." for i in range(300)]
    bare = [w[:-1] for w in whole[:20]]
    cut = [w[: len(w) - k] for k, w in zip(range(4, 24), whole[20:40], strict=True)]
    rows = [(i, t, "feed") for i, t in enumerate([*whole, *bare, *cut])] + [(9001, None, "feed"), (9002, " ", None), (9003, whole[0], None), (9003, whole[0], None), (9004, "The polymer coating is drawn in gr…", None)]
    df = spark.createDataFrame(rows, "fig_row_id long, caption string, source string").withColumn("truncated", F.lit("clash"))
    got = {r["fig_row_id"]: r["truncated"] for r in cut_captions(df).collect()}
    assert 9001 not in got and 9002 not in got and got[9003] is False and got[9004] is True
    assert not any(got[i] for i in range(320))
    assert sum(got[i] for i in range(320, 340)) >= 18
    assert cut_captions(df.where("false")).count() == 0
    shares = {r["source"]: r["n_texts"] for r in cut_shares(cut_captions(df), "source").collect()}
    assert shares == {"feed": 340, None: 3}


def test_reply_rows(spark):
    df = spark.createDataFrame([(1, "m", None, 5), (2, "m", '{"a"', 4), (2, "m", '{"a"', 4), (3, None, "{}" + " " * 9, None)], "result_id long, model string, raw_output string, raw_output_length int")
    assert sorted((r["result_id"], r["truncated"]) for r in cut_replies(df).collect()) == [(2, True), (2, True), (3, False)]
    assert cut_replies(df.where("false")).count() == 0
