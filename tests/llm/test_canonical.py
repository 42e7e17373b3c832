import random

import pytest

from folia.llm.canonical import Check, best_entries, described_names, map_values, normal, rarity_prefix, token_sets

TITLES = ["Journal of Spin Transport", "Open Spin Transport", "The Photon Statistics Quarterly", "Spin Transport: Theory & Methods", "Annals of Renal Pathology", "Program Repair Reviews", "Program Repair Reports", "Nordic Journal of Porous Sorbents"]


def refs(spark, titles=TITLES):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(titles)], "entry string, name string")


def test_prefix_filter_loses_no_pair():
    rng = random.Random(2)
    sets = [token_sets("".join(rng.choice("abcd ") for _ in range(14)).strip() or "x")["g"] for _ in range(80)]
    freq = {}
    for s in sets:
        for x in s:
            freq[x] = freq.get(x, 0) + 1
    for t in (0.45, 0.6, 0.8):
        for a in sets:
            for b in sets:
                if len(set(a) & set(b)) / len(set(a) | set(b)) >= t:
                    assert set(rarity_prefix(a, freq, t)) & set(rarity_prefix(b, freq, t))


def test_spellings(spark):
    cases = {
        "J. Spin Trans.": "0", "SPIN TRANSPORT, JOURNAL OF": "0", "Journal_of_Spin_Transport": "0", "JournalofSpinTransport": "0", "Journаl of Spin Transport": "0", "Jounal of Spin Transprt": "0", "Journal of Spin Transport, vol. 7": "0",
        "open  spin transport (Print)": "1", "Phot. Stati. Q.": "2", "Spin Transport: Theory and Methods": "3", "Ann. Rena. Patho.": "4", "Pr0gram Repair Rev.": "5", "Prog Repa Rep": "6",
        "Archives of Renal Pathology": None, "Notes from Cave Acoustics": None, "n/a": None, "Journal of Porous Sorbents": None, "-": None,
    }
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate([*cases, *cases, None, "", " "])], "row_id long, journal string, canon string")
    got = {r["value"]: r["canon"] for r in map_values(df, "row_id", {"journal": refs(spark)}).collect()}
    assert got == cases
    assert map_values(df, "row_id", {"journal": refs(spark)}).count() == 2 * len(cases)
    assert map_values(df.where("false"), "row_id", {"journal": refs(spark)}).count() == 0
    assert map_values(df, "row_id", {"journal": refs(spark).where("false")}).where("canon IS NOT NULL").count() == 0


def test_a_long_list_is_joined_without_a_broadcast_alike(spark):
    v = spark.createDataFrame([("open spin transport",), ("Ann Renal Pathology",), ("x" * 20_000,)], "value string")
    a = {tuple(r) for r in best_entries(v, refs(spark)).collect()}
    b = {tuple(r) for r in best_entries(v, refs(spark), small=2).collect()}
    assert {x[:2] for x in a} == {x[:2] for x in b} == {("open spin transport", "1"), ("Ann Renal Pathology", "4")}


def test_real_words_are_no_misspellings():
    c = Check(frozenset("journal of renal pathology reviews reports".split()))
    assert c.cost("renal reviews", "renal reports") is None
    assert c.cost("renal reveiws", "renal reviews") == 1.0
    assert normal("  “Renal—Pathology” [Online] ") == "renal pathology"


def test_long_lists_and_long_names_get_the_same_check(spark):
    long = "Proceedings of the Northern Regional Symposium on Applied Porous Sorbent Synthesis Measurement Storage Transport Recovery Separation Modelling Practice"
    titles = [*TITLES, "Penal Law Review", long]
    cases = {"Annals of Penal Pathology": None, "Annals of Renal Pathologi": "4", long.replace("Regional", "Reginal"): "9", long.replace("Proceedings", "Proc").replace("Symposium", "Symp"): "9", "Practice, " + long.replace(" Practice", ""): "9"}
    values = spark.createDataFrame([(v,) for v in cases], "value string")
    for small in (20_000, 2):
        got = {r["value"]: r["entry"] for r in best_entries(values, refs(spark, titles), small=small).collect()}
        assert {v: got.get(v) for v in cases} == cases
    with pytest.raises(ValueError, match="more than 5 words"):
        best_entries(values, refs(spark, titles), max_words=5)


def test_names_from_descriptions(spark):
    """A list whose entries come with a description is matched by the words that tell its entries apart."""
    names = described_names([("by_post", "parcel found by its address"), ("by_courier", "parcel found by a close address"), ("lost", "parcel not found at all"), (None, "x"), (" ", "x"), ("odd", None)])
    assert {e for e, _ in names} == {"by_post", "by_courier", "lost", "odd"}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["post", "found by courier", "BY_COURIER", "curier", "parcel", "no", "not found", "none found", "pending", "by-post"])], "k long, v string")
    got = {r["value"]: r["canon"] for r in map_values(df, "k", {"v": spark.createDataFrame(names, "entry string, name string")}).collect()}
    assert got == {"post": "by_post", "found by courier": "by_courier", "BY_COURIER": "by_courier", "curier": "by_courier", "parcel": None, "no": "lost", "not found": "lost", "none found": "lost", "pending": None, "by-post": "by_post"}
    with pytest.raises(ValueError, match="more than 2 described"):
        described_names([("a", None)] * 3, most=2)


def test_hot_values_and_many_values_get_the_same_result(spark):
    values = ["open spin transport"] * 300 + ["J. Spin Trans."] * 3 + ["n/a"] * 40 + [None, ""]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v string")
    got = [sorted((r["k"], r["value"], r["canon"]) for r in map_values(df, "k", {"v": refs(spark)}, **how).select("k", "value", "canon").na.fill("-").collect()) for how in ({}, {"most_broadcast": 0}, {"most_broadcast": 0, "hot_share": 0.5, "salts": 3})]
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 343
