import random

import pytest

from folia.operators.packed import PLACEHOLDERS, Field, Model, _lattice, atoms, best_split, category_field, clean_category, clean_issn, index_fields, issn_field, learn, split_packed

NAMES = ["Optics", "Particles, Fields", "Rights; Theory", "Metals/Alloys", "Manufacturing | Processing", 'The "Green" Chemistries', "Finance", "Ceramics", "Coatings, Films and Interfaces"]


def pack(values, rng):
    """A random way to write values, and the only reading of it."""
    style = rng.choice(["; ", " | ", "\n", "list", "csv", "mixed", ";; "])
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    if style == "list":
        return "[" + ", ".join('"' + v.replace('"', '\\"') + '"' for v in values) + "]"
    if style == "csv":
        return ",".join(quote(v) for v in values)
    out = ""
    for i, v in enumerate(values):
        v = v + rng.choice(["", " (Q1)", " (Q4)"])
        if '"' in v or rng.random() < 0.2:
            v = quote(v) if "(Q" not in v else quote(v[:-5]) + v[-5:]
        out += v + ("" if i + 1 == len(values) else rng.choice(["; ", ";", "|"]) if style == "mixed" else style)
    return out


def test_round_trip(spark):
    rng = random.Random(5)
    truth = [[rng.choice(NAMES) for _ in range(rng.randint(1, 6))] for _ in range(400)]
    cells = [pack(v, rng) for v in truth]
    f = category_field(NAMES)
    df = spark.createDataFrame([(c, 1) for c in sorted(set(cells))], "cell string, n long")
    m = learn(df, f)
    wrong = [(c, v, best_split(c, f, m, 8)) for c, v in zip(cells, truth, strict=True) if best_split(c, f, m, 8) != v]
    assert not wrong, wrong[:3]


def test_unlisted_values_are_learned_from_the_column(spark):
    f = category_field([])
    cells = [(f"{a};{b}", 1) for a in ("Alpha, One", "Beta", "Gamma") for b in ("Beta", "Alpha, One", "Delta")] + [("Alpha, One", 9), ("Beta", 5)]
    m = learn(spark.createDataFrame(cells, "cell string, n long"), f)
    assert best_split("Beta;Alpha, One", f, m, 8) == ["Beta", "Alpha, One"]


@pytest.mark.parametrize(("cell", "want"), [("ISSN: 1234-567x", ["1234-567X"]), ("9000 - 7190|8405–7092", ["9000-7190", "8405-7092"]), ("1234567X 12345678", ["1234-567X", "1234-5678"]), ("1111-2222; n/a", ["1111-2222"]), ("e-ISSN: 8156-4740; ISSN 8717-6947", ["8156-4740", "8717-6947"]), ("1111-2222 (print), 1111-2222 (online)", ["1111-2222", "1111-2222"]), ("n/a", []), (";", [])])
def test_issn(cell, want):
    f = issn_field()
    assert best_split(cell, f, Model({"9999-9999": 0.5}, {}, frozenset(f.listed)), 8) == want


def test_atoms_keep_quoted_spans_and_ends():
    assert [x[2] for x in atoms('"a;b";c', ";")] == [";", ""]
    assert [x[2] for x in atoms('"never closed;c', ";")] == [";", ""]
    assert clean_category('"The ""Green"" Chemistries" (Q3)') == 'The "Green" Chemistries'
    assert clean_issn(" issn 1234-5678 ") == "1234-5678"
    assert "n/a" in PLACEHOLDERS


def test_edge_rows(spark):
    long = "; ".join(["Optics"] * 3000)
    data = [(1, None, None, None, "v"), (2, "", " \u00a0", "n/a", "v"), (3, "1111-2222", "Optics; Finance", long, "v"), (3, "1111-2222", "Optics; Finance", long, "v"), (None, None, "Optics", None, None)]
    df = spark.createDataFrame(data, "row_id long, issn string, subject_categories string, scimago_categories string, val string")
    fields = index_fields(spark.createDataFrame([(n,) for n in NAMES], "category string"))
    got = split_packed(df, "row_id", fields)
    rows = got.where("row_id = 3 AND field = 'subject_categories'").orderBy("pos").collect()
    assert [(r["pos"], r["val"]) for r in rows] == [(1, "Optics"), (1, "Optics"), (2, "Finance"), (2, "Finance")]
    assert got.where("row_id = 2").count() == 0
    assert got.where("row_id = 3 AND field = 'scimago_categories'").count() == 6000
    assert split_packed(df.where("false"), "row_id", fields).count() == 0


def test_long_cells_are_split_like_short_ones():
    """A value of many atoms is kept whole in a cell of any length, and its width may be any."""
    six, nine = "a,b,c;d,e|f", "q,r,s,t;u,v|w,x,y"
    f = category_field([six, nine, "other"])
    m = Model({six: 0.3, nine: 0.3, "other": 0.3}, {}, frozenset(f.listed))
    assert f.widest == 9
    for times in (1, 40, 50, 700):
        assert best_split(";".join([six] * times), f, m) == [six] * times
        assert best_split(";".join([nine, "other"] * times), f, m) == [nine, "other"] * times


def test_fields_of_equal_delimiters_keep_their_own_keys():
    """The keys of segments belong to a field: another field with the same delimiters reads the same text otherwise."""
    a, b = Field(";", str.strip, str.upper), Field(";", str.strip, str.lower)
    m = Model({"X": 0.9, "x": 0.1}, {}, frozenset())
    assert [k for ends in _lattice("X;x", a, m)[1] for _, _, k in ends] == ["X", "X", "X;X"]
    assert [k for ends in _lattice("X;x", b, m)[1] for _, _, k in ends] == ["x", "x", "x;x"]
