import random

import pytest
from pyspark.sql import functions as F

from folia.operators import agreement, duplicates, joins, models, windows
from folia.sources import readers, writers
from folia.streaming import queue


def test_similar_titles_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    titles = ["journal of lattice " + "".join(rng.choice("abcdefgh ") for _ in range(12)).strip() for _ in range(40)]
    values = [t[:9] + t[10:] for t in titles] + ["short", "quite another thing"]
    got = {r["value"]: r["ratio"] for r in joins.similar_titles(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    want = {v: m for v in set(values) if len(v) >= 8 and " " in v and (m := max(SequenceMatcher(None, v, t).ratio() for t in titles)) >= 0.94}
    assert got == pytest.approx(want)


def test_hamming_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    hs = [rng.getrandbits(63) for _ in range(40)]
    hs += [h ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for h in hs[:20]]
    df = spark.createDataFrame(list(enumerate(hs)), "k long, h long")
    got = {(r["a"], r["b"]) for r in joins.hamming_pairs(df, "k", "h", 3).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if 0 < bin(hs[i] ^ hs[j]).count("1") <= 3}


def test_star_clusters_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    nb = {}
    for a, b in edges:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    want = {}
    for k in sorted(nb):
        if k not in want:
            want[k] = k
            for x in nb[k]:
                want.setdefault(x, k)
    pairs = spark.createDataFrame(edges, "a long, b long")
    got = {r["k"]: r["seed"] for r in windows.star_clusters(spark.range(80).withColumnRenamed("id", "k"), pairs, "k").collect()}
    assert got == want
    chain = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["component"] for r in duplicates.components(chain).collect()} == {1}
    assert windows.star_clusters(spark.range(5).withColumnRenamed("id", "k"), chain.where("false"), "k").count() == 0


def test_ridge_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    coef = models.ridge(df, ["a", "b"], "y", 5.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 5 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert [coef["a"], coef["b"]] == pytest.approx(list(w))


def test_random_intercept_finds_the_variances(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(60), 20)
    x = rng.normal(size=1200)
    y = 2 + 0.5 * x + rng.normal(size=60)[g] * 2 + rng.normal(size=1200)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "g long, x double, y double")
    m = models.random_intercept(df, [F.lit(1.0), F.col("x")], "y", "g")
    assert m["beta"][1] == pytest.approx(0.5, abs=0.1)
    assert m["sigma2"] == pytest.approx(1, abs=0.15)
    assert m["tau2"] == pytest.approx(4, abs=1.8)


def test_simplex_grid():
    g = models.simplex_grid(3)
    assert len(g) == 231 and all(abs(sum(w) - 1) < 1e-9 for w in g)


def test_ordinal_alpha_hand_computed(spark):
    rows = [(u, r, float(v)) for u, vs in enumerate([(1, 1), (2, 2), (3, 3), (1, 2)]) for r, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "u long, r long, v double")
    # margins 3, 3, 2 of 8; delta(1,2) = (6 - 3)^2 = 9, delta(1,3) = (8 - 2.5)^2, delta(2,3) = (5 - 2.5)^2
    do = 2 * 9
    de = 2 * (3 * 3 * 9 + 3 * 2 * 5.5**2 + 3 * 2 * 2.5**2) / 7
    assert agreement.krippendorff(df, "u", "v", "ordinal").first()[0] == pytest.approx(1 - do / de)


def test_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0)], "g long, x double, y double")
    assert df.groupBy("g").agg(agreement.pearson("x", "y").alias("p")).first()["p"] is None
    assert agreement.spearman(df, ["g"], "x", "y").first()["spearman"] is None


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b", None), ("2", 'q"x', "y")], "id string, t string, u string")
    writers.write_csv(df, str(tmp_path / "c"), ["id", "t", "none"])
    back = readers.read_csv(spark, str(tmp_path / "c"), "id string, t string, none string")
    assert {tuple(r) for r in back.collect()} == {("1", "a,b", None), ("2", 'q"x', None)}
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "s.csv").write_text("\ufeffa;b\n1;2\n")
    assert readers.read_sniffed(spark, str(tmp_path / "s.csv")).columns == ["a", "b"]
    d = tmp_path / "docs" / "p1"
    d.mkdir(parents=True)
    (d / "x_eval.json").write_text('{"doi": "10.1/x"}')
    (d / "y_eval.json").write_text("not json")
    from folia.functions.replies import PROFILE

    got = {r["id"]: (r["parse_ok"], r["doc"] and r["doc"]["doi"]) for r in readers.read_json_documents(spark, str(tmp_path / "docs"), PROFILE, r"_eval\.json$").collect()}
    assert got == {"x": (True, "10.1/x"), "y": (False, None)}
    assert {(r["folder"], r["file"]) for r in readers.walk(spark, str(tmp_path / "docs"), "*.json").collect()} == {("p1", "x_eval.json"), ("p1", "y_eval.json")}
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert readers.read_ids(spark, str(tmp_path / "ids.txt")).count() == 2


def test_tei(spark, tmp_path):
    (tmp_path / "d1.tei.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head n="1">Intro</head><p>a <b>c</b></p><div><head>Sub</head><p>x</p></div></div><div><p>z</p></div></body></text></TEI>')
    (tmp_path / "bad.xml").write_text("<TEI")
    got = [(r["order"], r["level"], r["heading"], r["text"]) for r in readers.read_tei(spark, str(tmp_path)).orderBy("order").collect()]
    assert got == [(0, 1, "Intro", "a c"), (1, 2, "Sub", "x"), (2, 1, None, "z")]


def test_stream_equals_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "in"
    ev.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))
    seen = []
    q = queue.drain(stream, lambda b, i: seen.append(b.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == ev.count()
    counts = queue.windowed(stream, "ts", ["event_type"], "6 hours", late="1 hour")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = queue.windowed(ev, "ts", ["event_type"], "6 hours")
    assert {tuple(r)[:3] for r in spark.table("w").collect()} == {tuple(r)[:3] for r in batch.collect()}
