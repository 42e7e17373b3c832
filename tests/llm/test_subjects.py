import random

import pytest

from folia.llm.subjects import NONE, SOURCE_PLACES, UNKNOWN, Tokens, common_words, composition, sentences_of, source_place, stop_words, subject_areas

WORDS = {s: [f"{s[:2]}{a}{b}" for a in ("ra", "to", "mi", "ne", "lu", "ka", "so") for b in ("ban", "dor", "fel", "gim", "hul", "jat", "kes")] for s in ("law", "physics", "food")}


def make(n, seed):
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        kind = rng.random()
        subjects = rng.sample(sorted(WORDS), 2) if kind < 0.25 else [] if kind > 0.92 else [rng.choice(sorted(WORDS))]
        sents = []
        for s in subjects:
            for _ in range(rng.randint(3, 6)):
                a, b = rng.sample(WORDS[s], 2)
                sents.append(f"The {a} was compared with the {b} in {rng.randint(2, 99)} runs.")
        if len(subjects) == 1 and rng.random() < 0.2 and len(sents) > 4:  # a passing mention
            o = rng.choice([x for x in sorted(WORDS) if x != subjects[0]])
            sents[1] = f"The {WORDS[o][0]} was compared with the {WORDS[o][1]} in 3 runs."
        if not subjects:
            sents = [f"Page {rng.randint(1, 99)} is left blank.", "Please quote the editors in all letters.", "Colour plates are printed free."]
        docs.append((i, " ".join(sents), rng.choice(["en", "EN", None]), rng.choice(["a", "b", None]), None))
        truth.append(set(subjects))
    return docs, truth


@pytest.fixture(scope="module")
def found(spark):
    docs, truth = make(500, 1)
    rng = random.Random(2)
    labels = [(i, s, "r1") for i in range(0, 240) for s in (truth[i] or {NONE})]
    labels = [(i, rng.choice(sorted(WORDS)) if rng.random() < 0.04 else s, r) for i, s, r in labels]
    docs += [(900, None, None, None, None), (901, " ", "en", "a", None), (0, *docs[0][1:])]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, section string").selectExpr("*", "'clash' AS subject")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    lst = spark.createDataFrame([(s, "d") for s in WORDS], "subject string, description string")
    return d, lab, lst, truth


def test_held_out_accuracy(spark, found):
    d, lab, lst, truth = found
    rows = subject_areas(d, lab, lst).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = range(240, 500)
    tp = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert tp / sum(len(truth[i]) for i in held) >= 0.97
    assert tp / sum(len(got.get(i, set())) for i in held) >= 0.97
    assert 900 not in got and 901 not in got
    assert sum(r["doc_id"] == 0 for r in rows) == 2 * len(truth[0])


def test_no_labels_no_documents(spark, found):
    d, lab, lst, _ = found
    assert subject_areas(d.where("false"), lab, lst).count() == 0
    unlabelled = subject_areas(d.limit(20), lab.where("false"), lst)  # without labels every subject is as likely: shares below a half decide
    assert all(0 <= r["share"] <= 1 for r in unlabelled.collect())
    assert subject_areas(d.limit(20), lab, lst.where("false")).count() == 0
    assert composition(subject_areas(d.limit(50), lab, lst)).count() <= 3


def test_sentences():
    assert sentences_of("A b. C d!\n\nTitle\n\n<b>E</b> f. 12 g.") == ["A b.", "C d!", "Title", "E f.", "12 g."]


def test_stop_words_are_common_in_their_language_and_even_over_the_subjects(spark):
    docs = [(f"the cat sat on the mat {'goal' if i % 3 == 0 else 'court'} x{i}", "en") for i in range(60)] + [(f"das tor y{i}", "de") for i in range(8)] + [("le but z", "fr")]
    df = spark.createDataFrame(docs, "text string, lang string")
    common = common_words(df)
    assert {"the", "cat", "goal", "court"} <= common["en"] and {"das", "tor"} <= common["de"]
    assert "z" not in common.get("fr", set()) and "le" not in common.get("fr", set())  # one text makes no common word
    labelled = [(t, lang, {"sport" if "goal" in t else "law"}) for t, lang in docs[:60]]
    stop = stop_words(common, labelled)
    assert "the" in stop["en"] and not {"goal", "court"} & stop["en"]
    assert "das" in stop["de"] and "das" not in stop["en"]
    assert {"the", "das"} <= stop[UNKNOWN]


def test_tokens_equal_a_plain_count():
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choice(["the", "cat", "Ab-3", "7", "mat", "dog"]).capitalize() if k == 0 else rng.choice(["the", "cat", "ab-3", "7", "mat", "dog"]) for k in range(rng.randint(1, 6))) for _ in range(4)) + "." for _ in range(30)] + ["", "..."]
    stop = {"en": frozenset(["the"]), "de": frozenset(["cat"])}
    langs = [rng.choice(["en", "de", "xx"]) for _ in texts]
    t = Tokens.read(texts, langs, stop)
    got = {}
    for s, k in zip(t.sent.tolist(), t.term.tolist(), strict=True):
        got.setdefault(s, set()).add(t.names[k])
    want, n = {}, 0
    for text, lang in zip(texts, langs, strict=True):
        for x in sentences_of(text):
            w = x.lower().replace(".", "").split()
            keep = [not (y in stop.get(lang, ()) or y in ("ab-3", "7")) for y in w]
            terms = {y for y, k in zip(w, keep, strict=True) if k} | {a + " " + b for a, b, i, j in zip(w, w[1:], keep, keep[1:], strict=False) if i or j}
            if terms:
                want[n] = terms
            n += 1
    assert got == want and t.sizes.sum() == n and len(t.which) == 30


def test_sources_of_any_number_have_a_place():
    places = {source_place(f"source {i}") for i in range(1000)}
    assert places == set(range(SOURCE_PLACES)) and source_place(None) == -1


def test_too_many_subjects_are_an_error(spark, found):
    d, lab, lst, _ = found
    with pytest.raises(ValueError, match="more than 2 subjects"):
        subject_areas(d.limit(5), lab, lst, max_subjects=2)
