import random

from pyspark.sql import functions as F

from folia.llm import scans


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    nouns = ["lattice", "polymer", "electron", "membrane", "resistance", "survey", "container", "gradient", "scheduler", "hydrogel", "particle", "battery", "network", "pollution"]
    verbs = ["increases", "contains", "describes", "follows", "measures"]
    out = []
    for i in range(n):
        s = [f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} during the {rng.choice(nouns)} phase of sample Xk-{rng.randint(1, 99)}." for _ in range(3)]
        out.append(f"Figure {i % 9 + 1}. " + " ".join(s))
    return out


def test_repair(spark):
    clean = corpus()
    noisy = {
        "hyphen": "Figure 1. The poly-\nmer contains the lattice during the survey phase of sample Xk-3.",
        "chars": "Figure 1. The polymer contalns the mernbrane during the survcy phase of sample Xk-3.",
        "pageno": "Figure 1. The polymer contains\nPage 4 of 9\nthe lattice during the survey phase of sample Xk-3.",
        "header": "Figure 1. The polymer contains\nOkunre et al. / Journal of Heat Reports\nthe lattice during the survey phase of sample Xk-3.",
    }
    rows = [(i, t, False) for i, t in enumerate([*clean, *noisy.values(), "", " ", None])] + [(9000, "sample  polymer  lattice\nXk-4  5.1  12\nXk-5  7  3", True)]
    df = spark.createDataFrame(rows, "k long, text string, is_table boolean").withColumn("defects", F.lit("clash"))
    got = {r["k"]: (r["defects"], r["repaired"]) for r in scans.repair(df, ["k"]).collect()}
    assert len(got) == len(rows) - 1  # null has no row
    assert sum(bool(got[i][0]) for i in range(len(clean))) <= 2
    for j, (kind, _) in enumerate(noisy.items()):
        assert kind in got[len(clean) + j][0], kind
    assert got[len(clean) + 1][1] == "Figure 1. The polymer contains the membrane during the survey phase of sample Xk-3."
    assert got[len(clean)][1] == "Figure 1. The polymer contains the lattice during the survey phase of sample Xk-3."
    assert "\n" not in got[len(clean) + 2][1] and "Page" not in got[len(clean) + 2][1]
    assert got[9000][0] == []


def test_heldout_words():
    """Words never seen in training are restored if the lexicon knows them."""
    words = {w: 50 + i for i, w in enumerate({x for t in corpus(50) for x in t.split()})} | {"unseenword": 40, "distillation": 60, "interference": 80}
    m = scans.train_chars({w: n for w, n in words.items() if w not in ("unseenword", "distillation", "interference")})
    prefixes = {w[:k].lower() for w in words for k in range(len(w) + 1)}
    for bad, good in (("urisecnword", "unseenword"), ("distl1lation", "distillation"), ("intcrfcrence", "interference")):
        assert scans.word_correction(bad, m, words, prefixes) == good
    assert scans.word_correction("distillation", m, words, prefixes) is None


def test_explains_is_exact():
    assert scans.explains("modern", "modem") and scans.explains("learn", "leam") and scans.explains("clear", "dear")
    assert not scans.explains("ion", "in") and not scans.explains("same", "same")


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, text string, is_table boolean")
    assert scans.repair(df, ["k"]).count() == 0
    one = spark.createDataFrame([(1, "abc " * 50_000, False), (1, "abc " * 50_000, False)], "k long, text string, is_table boolean")
    assert scans.repair(one, ["k"]).count() == 2


def test_last_words(spark):
    """A misread last word is found whatever its length; what may be the beginning of a longer word is left alone."""
    ends = {0: ("sample is the rnain lattice phasc", ["chars"]), 1: ("sample follows the latti", []), 2: ("sample follows the poly", [])}
    clean = [c[:-1] + " in the main phase." for c in corpus(200)]
    rows = [(i, t, False) for i, t in enumerate(clean)] + [(1000 + k, "The polymer increases the lattice during the main " + t, False) for k, (t, _) in ends.items()]
    got = {r["k"]: r["defects"] for r in scans.repair(spark.createDataFrame(rows, "k long, text string, is_table boolean"), ["k"]).collect()}
    for k, (_, want) in ends.items():
        assert got[1000 + k] == want


def test_long_texts_train_only_up_to_the_stated_bound(spark):
    """Texts of over the old limit of 4,000 characters train like others; the bound is a parameter and changes no repair of theirs."""
    long = ["\n".join(corpus(40, seed)) for seed in range(12)]
    assert min(map(len, long)) > 4000
    noisy = long[0].replace("polymer contains", "polyrner contalns")
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate([*long, noisy])], "k long, text string, is_table boolean")
    fitted = scans.fit(df.select("text", "is_table"))
    assert fitted.lines.p.w and fitted.chars.edits.w
    assert not scans.fit(df.select("text", "is_table"), max_chars=100).lines.p.w
    got = {r["k"]: r["defects"] for r in scans.repair(df, ["k"], fitted).collect()}
    assert got[12] == ["chars"] or long[0] == noisy
