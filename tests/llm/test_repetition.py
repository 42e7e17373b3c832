import random

from pyspark.sql import functions as F

from folia.llm.repetition import drop_common_lines, repeated_share, repeated_words


def brute(words, n):
    hit = set()
    for i in range(len(words) - n + 1):
        if any(words[j : j + n] == words[i : i + n] for j in range(i)):
            hit |= set(range(i, i + n))
    return len(hit)


def test_equals_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            w += w[: rng.randint(0, 20)]
        for n in (2, 4, 8):
            assert repeated_words(" ".join(w), n) == (len(w), brute(w, n))


def test_words_ignore_case_digits_and_signs():
    assert repeated_words("A b1c D; " * 2, 4) == (8, 4)
    assert repeated_words("", 8) == (0, 0)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two three four five six seven eight " * 2, "x"), (3, "one two three four five six seven eight " * 2, "x"), (4, "w " * 300_000, "x")], "k long, t string, share string")
    got = sorted((r["k"], r["n_words"], round(r["share"], 2)) for r in repeated_share(df, "k", F.col("t")).collect())
    assert got == [(1, 0, 0.0), (2, 0, 0.0), (3, 16, 0.5), (3, 16, 0.5), (4, 300_000, 1.0)]
    assert repeated_share(df.where("false"), "k", F.col("t")).count() == 0


def test_common_lines(spark):
    rows = [(i, "h", f"Shared line 12.\nOwn line {'abcdefgh'[i]}.") for i in range(6)] + [(9, "h", "Shared line 7.\nShared line 8."), (10, None, "Shared line."), (11, "h", None), (12, "g", "Shared line 1.")]
    df = spark.createDataFrame(rows, "k long, host string, t string").withColumn("rejected", F.lit("clash"))
    got = {r["k"]: (r["n_lines"], r["n_common"], r["rejected"]) for r in drop_common_lines(df, "k", "host", "t", max_docs=3, max_share=0.1).collect()}
    assert got[0] == (2, 1, False) and got[9] == (2, 2, True)
    assert got[10] == (1, 0, False) and got[11] == (0, 0, False) and got[12] == (1, 0, False)
    assert drop_common_lines(df.where("false"), "k", "host", "t").count() == 0


def test_common_lines_are_joined_alike_when_they_are_many_or_hot(spark):
    rows = [(i, "h" if i % 3 else "g", f"Shared line {i}. Second line. Own line {'abcdefgh'[i % 8]}{i}.") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, host string, t string")
    got = [sorted(tuple(r) for r in drop_common_lines(df, "k", "host", "t", max_docs=3, max_share=0.1, **how).collect()) for how in ({}, {"most_broadcast": 0}, {"most_broadcast": 0, "hot_share": 0.4, "salts": 3})]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60
