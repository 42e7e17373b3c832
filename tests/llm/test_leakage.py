import random

from folia.llm.leakage import leaked_passages, word_spans


def brute(doc, item, n):
    a, b = [w for w, _, _ in word_spans(doc)], [w for w, _, _ in word_spans(item)]
    return any(a[i : i + n] == b[j : j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


def test_equals_brute_force_and_offsets_point_to_the_original(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(12)] + [(12, None), (13, "too short")]
    items += [(14, items[0][1])]  # two items share a passage
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(40)]
        if d % 3 == 0:
            p = items[rng.randrange(12)][1].split()
            k = rng.randint(3, 20)
            w[10:10] = p[-k:]
        t = " ".join(x.upper() if rng.random() < 0.3 else f"<b>{x}</b>" if rng.random() < 0.1 else x for x in w)
        docs.append((d, t.replace(" ", "\n> ", 3)))
    docs += [(100, None), (101, ""), (102, "x " * 200_000 + items[3][1]), (0, docs[0][1])]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(i, p, "clash") for i, p in items], "item_id long, passage string, doc_id string")
    got = leaked_passages(dd, ii, window=6).collect()
    want = {(d, i) for d, t in docs[:60] for i, p in items if p and brute(t, p, 6)} | {(102, 3)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    text, passage = dict(docs), dict(items)
    for r in got:
        inside = " ".join(w for w, _, _ in word_spans(text[r["doc_id"]][r["start_char"] : r["end_char"]]))
        assert inside in " ".join(w for w, _, _ in word_spans(passage[r["item_id"]]))
        assert len(inside.split()) == r["n_words"] >= 6
    small = leaked_passages(dd, ii, window=6, max_windows=40)
    assert small._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1  # one scan, however many automata
    for many in (small, leaked_passages(dd, ii, window=6, max_windows=40, chunk_chars=500), leaked_passages(dd, ii, window=6, max_windows=150, kept=100)):
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, got))
    assert leaked_passages(dd.where("false"), ii).count() == 0
    assert leaked_passages(dd, ii.where("false")).count() == 0
