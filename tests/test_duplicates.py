import random

from folia.operators import duplicates, joins


def shingles(t, n=5):
    w = t.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_near_clusters_hold_copies_and_edited_copies(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    head = [word() for _ in range(8)]  # all texts begin alike
    texts = [" ".join(head + [word() for _ in range(rng.randint(20, 60))]) for _ in range(30)]
    texts += [texts[i] for i in (0, 0, 1, 2, 3)]
    for i in (2, 3, 4, 5, 6, 7, 7, 7):  # an edit at the end, and more of them
        w = texts[i].split()
        for _ in range(rng.randint(1, 4)):
            w[-rng.randint(1, 3)] = word()
        texts.append(" ".join(w))
    texts += ["two words", "Two  words", "other words", None, " "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = dict(zip(order, texts, strict=True))
    sets = {k: shingles(t) for k, t in docs.items() if t and t.strip()}
    want, seen = {}, set()
    for k in sorted(sets):
        if k not in seen:
            star = [x for x in sorted(sets) if x not in seen and (x == k or len(sets[x] & sets[k]) / len(sets[x] | sets[k]) >= 0.8)]
            seen.update(star)
            if len(star) > 1:
                want.update(dict.fromkeys(star, k))
    df = spark.createDataFrame(list(docs.items()), "k long, t string")
    rows = duplicates.near_clusters(df, "k", "t").collect()
    assert len(rows) == len(want) >= 15 and {r["k"]: r["seed"] for r in rows} == want
    assert duplicates.near_clusters(df.where("false"), "k", "t").count() == 0


def test_jaccard_pairs_broadcast_no_sets(spark):
    rng = random.Random(5)
    sets = {k: set(rng.sample(range(400), 20)) for k in range(60)}
    for k in range(60, 90):
        sets[k] = {*sorted(sets[k - 60])[rng.randint(0, 4) :], 500 + k}
    df = duplicates.cut_lineage(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k long, s array<long>"))
    pairs = duplicates.jaccard_pairs(df, "k", "s", 0.8)
    got = [tuple(r) for r in pairs.collect()]
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert len(got) == len(want) > 10 and set(got) == want
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_hamming_members_hold_every_row(spark):
    rng = random.Random(9)
    hs = [rng.getrandbits(63) for _ in range(12)]
    hs += [hs[0]] * 15 + [hs[1]] + [hs[0] ^ 1, hs[0] ^ 1, hs[2] ^ 8, hs[3] ^ 16 ^ 64]
    got = {r["k"]: (r["rep"], r["class_size"], r["links"]) for r in joins.hamming_members(spark.createDataFrame([*enumerate(hs), (99, None)], "k long, h long"), "k", "h", 1).collect()}
    assert got == {k: (hs.index(h), hs.count(h), sum((h ^ x).bit_count() <= 1 for x in hs) - 1) for k, h in enumerate(hs)}
