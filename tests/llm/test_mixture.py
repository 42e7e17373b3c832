import pytest

from folia.llm.mixture import budgets, count_tokens, mix


def test_budgets():
    assert budgets({"a": 100, "b": 50}, {"a": (0.5, 1), "b": (0.5, 1)}) == {"a": 50.0, "b": 50.0}
    assert budgets({"a": 100, "b": 50}, {"a": (0.5, 1), "b": (0.5, 4)}) == {"a": 100.0, "b": 100.0}
    assert budgets({"a": 100}, {"a": (0.25, 1), "gone": (0.75, 1)}) == {"a": 100.0}
    assert budgets({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, total=100) == {"a": 50.0, "b": 20.0}
    assert budgets({}, {"a": (1.0, 1)}) == {}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big" if i % 10 else "small", f"some words number {i} " * (1 + i % 7)) for i in range(3000)]
    rows += [(5000, "big", None), (5001, "big", " "), (5002, None, "text"), (5003, "unlisted", "text"), (1, "big", rows[1][2])]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'clash' AS uses", "1 AS n_tokens")


def test_shares_are_met(spark, docs):
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.39, 9), ("gone", 0.01, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mix(docs, targets)
    r = {x["source"]: x for x in report.collect()}
    assert r["gone"]["tokens_used"] == 0 and r["gone"]["actual_share"] == 0
    assert r["big"]["actual_share"] == pytest.approx(0.6 / 0.99, abs=0.001)
    assert r["small"]["actual_share"] == pytest.approx(0.39 / 0.99, abs=0.001)
    rows = chosen.collect()
    assert max(x["uses"] for x in rows if x["source"] == "small") <= 9 and all(x["uses"] == 1 for x in rows if x["source"] == "big")
    small = sorted({x["uses"] for x in rows if x["source"] == "small"})
    assert len(small) <= 2 and small[-1] - small[0] <= 1  # whole passes and one partial pass
    assert not {5000, 5001, 5002, 5003} & {x["doc_id"] for x in rows}
    again = {(x["doc_id"], x["uses"]) for x in mix(docs, targets)[0].collect()}
    assert again == {(x["doc_id"], x["uses"]) for x in rows}


def test_budget_is_cut_within_half_a_document(spark, docs):
    targets = spark.createDataFrame([("big", 1.0, 3)], "source string, target_share double, max_repeats int")
    have = sum(x["n_tokens"] for x in count_tokens(docs.where("source = 'big'"), ["doc_id"], "text").collect())
    for total in (10, 777, have - 3, have + 500, 2 * have):
        rows = mix(docs, targets, total=total)[0].collect()
        assert abs(sum(x["n_tokens"] * x["uses"] for x in rows) - total) <= 40


def test_empty(spark, docs):
    targets = spark.createDataFrame([("big", 1.0, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mix(docs.where("false"), targets)
    assert chosen.count() == 0 and report.first()["docs_used"] == 0
    chosen, report = mix(docs, targets.where("false"))
    assert chosen.count() == 0 and report.count() == 0


def test_tokens_equal_a_second_library(spark):
    import base64

    import public_tokenizers as pt
    import tiktoken

    texts = ["Plain text, 12.5 µm.", "<|endoftext|> is text", "ß   x" * 50, ""]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pt.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r["k"]: r["n_tokens"] for r in count_tokens(df, ["k"], "t").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}
