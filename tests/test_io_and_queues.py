"""Sources, sinks, scorers and queues: files there and back, failures, races."""

import io
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from folia import runtime
from folia.operators import scoring
from folia.sources import readers, writers
from folia.streaming.claims import Log, Memo, Queue, work


def workbook(sheets):
    """A workbook as zipped XML: shared, inline and plain strings and numbers."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out, shared = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = ""
            for k, row in enumerate(rows, 1):
                cells = ""
                for j, v in enumerate(row):
                    ref = f"{chr(65 + j)}{k}"
                    if isinstance(v, (int, float)):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v and j % 2:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                    elif v:
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                body += f'<row r="{k}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"Instructions": [["read", "this"]], "One": [["id", "name"], ["x1", "Ann"], ["", ""], [2, "Bo"]], "Two": [["id", "age"], ["x3", 7]]}))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = readers.read_workbooks(spark, str(tmp_path))
    got = sorted((r["file"], r["sheet"], r["row"], r["id"], r["name"], r["age"]) for r in readers.sheet_table(rows, ["id", "name", "age"]).na.fill("-").collect())
    assert got == [("a.xlsx", "One", 2, "x1", "Ann", "-"), ("a.xlsx", "One", 4, "2", "Bo", "-"), ("a.xlsx", "Two", 2, "x3", "-", "7")]
    assert rows.where("sheet IS NULL").select("file").first()[0] == "b.xlsx"


def test_ocr_boxes(spark, tmp_path):
    (tmp_path / "p1_ocr.json").write_text(json.dumps({"words": [{"text": "a", "confidence": 0.9, "box": [5, 6, 1, 2]}, {"text": " ", "box": [0, 0, 1, 1]}, {"text": "no box"}]}))
    (tmp_path / "p2.json").write_text(json.dumps([{"text": "b", "polygon": [[0, 0], [4, 1], [2, 8]]}]))
    (tmp_path / "p3.json").write_text("broken")
    got = {r["id"]: r for r in readers.read_ocr(spark, str(tmp_path)).collect()}
    assert [tuple(x) for x in got["p1"]["boxes"]] == [("a", 0.9, 1.0, 2.0, 4.0, 4.0)]
    assert [tuple(x) for x in got["p2"]["boxes"]] == [("b", None, 0.0, 0.0, 4.0, 8.0)]
    assert got["p3"]["boxes"] == [] and not got["p3"]["parse_ok"]


def test_documents_by_folder_and_tei(spark, tmp_path):
    for f, n in (("b", "2.pdf"), ("a", "1.pdf"), ("a", "note.txt")):
        (tmp_path / "walk" / f).mkdir(parents=True, exist_ok=True)
        (tmp_path / "walk" / f / n).write_bytes(b"x")
    assert [(r["folder"], r["file"]) for r in readers.walk(spark, str(tmp_path / "walk"), "*.pdf").orderBy("folder").collect()] == [("a", "1.pdf"), ("b", "2.pdf")]
    (tmp_path / "x.tei.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head n="1">Intro</head><p>A <b>b</b></p><div><head n="1.1">Sub</head><p>c</p></div></div></body></text></TEI>')
    (tmp_path / "bad.xml").write_text("<TEI>")
    got = [(r["doc_id"], r["level"], r["number"], r["heading"], r["text"]) for r in readers.read_tei(spark, str(tmp_path)).orderBy("order").collect()]
    assert got == [("x", 1, "1", "Intro", "A b"), ("x", 2, "1.1", "Sub", "c")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "d1_srp.json").write_text('{"a": 1}')
    (tmp_path / "j" / "d2_srp.json").write_text("[1]")
    docs = {r["id"]: (r["doc"] and r["doc"]["a"], r["parse_ok"]) for r in readers.read_json_documents(spark, str(tmp_path / "j"), "a int", r"_srp\.json$").collect()}
    assert docs == {"d1": (1, True), "d2": (None, False)}


def test_external_tools_fail_row_by_row(spark):
    df = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "k long, path string").coalesce(1)

    def tool(b):
        if (b["k"] == 3).any():
            raise OSError("tool crashed")
        return b[b["k"] != 4].assign(pages=2)[["k", "pages"]]

    got = {r["k"]: (r["status"], r["error"], r["pages"]) for r in readers.external(df, "k", tool, "pages int").collect()}
    assert got[0] == ("success", None, 2) and got[3] == ("error", "tool crashed", None) and got[4] == ("empty", None, None) and len(got) == 6


def test_publish_and_reset(spark, tmp_path):
    target = f"{tmp_path}/out/t"
    writers.publish(spark.range(3).toDF("k"), target)
    writers.publish(spark.range(5).toDF("k"), target)
    assert spark.read.parquet(target).count() == 5 and [p.name for p in (tmp_path / "out").iterdir()] == ["t"]
    with pytest.raises(ValueError, match="isn't below"):
        writers.reset(spark, ["/elsewhere/x"], str(tmp_path))
    with pytest.raises(ValueError, match="isn't below"):
        writers.reset(spark, [f"{tmp_path}/../x"], str(tmp_path))
    assert writers.reset(spark, [target, f"{tmp_path}/none"], str(tmp_path)) == [target] and not (tmp_path / "out" / "t").exists()


def test_context_and_schema_retries():
    calls = []

    def model(prompt, tokens):
        calls.append((prompt, tokens))
        if tokens > 600:
            raise ValueError("This request has 300 input tokens, too many")
        return "bad" if "|" not in prompt else "good"

    ask = scoring.with_schema_retry(scoring.with_context_retry(model, 900), lambda r: None if r == "good" else "no object", lambda p, r, e: f"{p}|{r}|{e}")
    assert ask("p", 4096) == "good"
    assert [t for _, t in calls] == [4096, 536, 4096, 536] and calls[2][0] == "p|bad|no object"
    assert scoring.room_left("has 300 input tokens", 1000, 4096) == 636
    assert scoring.room_left("has 900 input tokens", 1000, 4096) == 256 and scoring.room_left("down", 1000, 9) is None and scoring.room_left("has 1 input tokens", 1000, 500) is None
    with pytest.raises(OSError, match="down"):
        scoring.with_context_retry(lambda p, t: (_ for _ in ()).throw(OSError("down")), 10)("p", 5)


def test_scores_and_counter(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "boom"), (4, "none"), (5, None)], "k long, p string")

    def model(p, tokens):
        if p == "boom":
            raise OSError("x" * 900)
        return None if p == "none" else "{}"

    got = {r["k"]: (r["status"], len(r["error"] or ""), r["raw_output_length"]) for r in scoring.score(df, "k", "p", model).collect()}
    assert got == {1: ("success", 0, 2), 2: ("skipped", 0, 0), 3: ("api_error", 500, 0), 4: ("empty_response_error", 0, 0), 5: ("skipped", 0, 0)}
    out, seen = scoring.counted(df)
    assert out.count() == 5 and seen() == 5


def test_image_blocks(spark):
    png, jpg = bytes.fromhex("89504E470D0A1A0A00000000"), bytes.fromhex("FFD8FFE0") + b"x" * 20
    rows = [("a", 1, png), ("a", 2, None), ("a", 3, b"text"), ("a", 4, jpg), ("a", 5, png), ("b", 1, None)]
    df = spark.createDataFrame(rows, "d string, k int, c binary")
    got = {r["d"]: r for r in scoring.image_blocks(df, "d", "k", "c", most=2).collect()}
    assert [x[:15] for x in got["a"]["blocks"]] == ["data:image/png;", "data:image/jpeg"] and (got["a"]["n_images"], got["a"]["n_missing"], got["a"]["n_left_out"]) == (2, 2, 1)
    assert got["b"]["blocks"] == [] and got["b"]["n_missing"] == 1
    assert scoring.image_blocks(df, "d", "k", "c", most_bytes=20).where("d = 'a'").first()["n_images"] == 1


def test_tiers(spark):
    df = spark.createDataFrame([(i, i) for i in range(6)], "k long, v long")
    ran = []

    def tier(limit):
        def f(x):
            ran.append(x.count())
            return x.where(F.col("v") != 5).select("k", F.when(F.col("v") < limit, F.col("v")).alias("r"))

        return f

    got = {r["k"]: (r["r"], r["tier"]) for r in scoring.in_tiers(df, "k", [("cheap", tier(2)), ("dear", tier(4))], F.col("r").isNotNull()).collect()}
    assert got == {0: (0, "cheap"), 1: (1, "cheap"), 2: (2, "dear"), 3: (3, "dear"), 4: (None, "dear")} and ran == [6, 4]


def test_one_worker_gets_each_task(tmp_path):
    q = Queue(tmp_path)
    assert all(q.enqueue(f"t{i}", {"n": i}) for i in range(40)) and not q.enqueue("t1", {})
    got, lock = [], threading.Lock()

    def run(name):
        def do(task, payload):
            with lock:
                got.append(task)
            if payload["n"] % 10 == 0:
                raise ValueError("bad")
            return {"by": name}

        work(Queue(tmp_path), do, name, empty_polls=2, pause=0.01)

    threads = [threading.Thread(target=run, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == sorted(f"t{i}" for i in range(40)) and q.counts() == {"pending": 0, "in_progress": 0, "done": 36, "failed": 4}
    assert not q.enqueue("t1", {}) and json.loads(q.path("failed", "t10").read_text())["error"] == "bad"


def test_limits_recovery_log_and_memo(tmp_path):
    q = Queue(tmp_path / "q")
    for i in range(5):
        q.enqueue(str(i), {})
    assert work(q, lambda t, p: 1 / 0, most_errors=2, pause=0) == {"done": 0, "errors": 2, "idle": 0}
    task, _ = q.claim("w", seed=1)
    assert q.recover(60) == [] and q.recover(60, now=10**12) == [task]
    assert "worker" not in json.loads(q.path("pending", task).read_text())
    assert Queue(tmp_path / "empty").claim("w") is None
    log = Log(tmp_path / "log")
    assert list(log) == []
    log.add("a")
    log.add("b\nc")
    with (tmp_path / "log").open("ab") as f:
        f.write(b'"cut')
    assert list(log) == ["a", "b\nc"]
    log.add("d")
    assert list(log) == ["a", "b\nc", "d"]
    now, made = [0.0], []
    memo = Memo(lambda: made.append(1) or len(made), 60, lambda: now[0])
    assert memo() == memo() == 1
    now[0] = 60
    assert memo() == 2


def test_checkpoint_folder(spark):
    runtime.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert spark.sparkContext.applicationId in folder or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert runtime.scratch(spark).startswith(folder)


def test_images(spark, tmp_path):
    """A bitmap's features: a black square on white."""
    import struct

    import numpy as np

    from folia.functions import pixels

    rgb = np.full((60, 90, 3), 255, np.uint8)
    rgb[20:40, 10:30] = 0
    body = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * (-90 * 3 % 4) for y in range(59, -1, -1))
    (tmp_path / "a.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 90, 60, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    (tmp_path / "b.bmp").write_bytes(b"none")
    r = readers.read_images(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0]["width"], r[0]["height"]) == (90, 60) and len(r[0]["dhash"]) == 16
    f = r[0]["features"]
    assert f["connected_component_count"] == 1 and f["contour_count"] == 1 and abs(f["non_background_ratio"] - 400 / 5400) < 1e-6 and abs(f["visual_center_x_norm"] - 19.5 / 90) < 1e-6
    assert f["quantized_color_count"] == 2 and f["horizontal_balance_difference"] == 1.0 and f["vertical_balance_difference"] == 0.0 and 0.005 < f["edge_density"] < 0.04
    assert pixels.connected(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0]], bool))[1] == 1 and pixels.connected(np.array([[1, 0, 1], [0, 1, 0]], bool), False)[1] == 3
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    assert pixels.connected(ring)[1] == 2 and pixels.outer_parts(ring) == 1
    assert pixels.shrink(rgb, 30).shape == (20, 30, 3)


def test_tei_tables_and_references(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p>Orphan.</p><div><head>Res</head><figure type="table"><table><row><cell>a</cell><cell>b|c</cell></row><row><cell>1</cell></row></table></figure></div></body><back><div><listBibl>'
        '<biblStruct><analytic><title>On heat</title><author><persName><forename>A</forename><surname>B</surname></persName></author><idno type="DOI">10.1/x</idno></analytic><monogr><title>J. Heat</title><imprint><biblScope unit="volume">3</biblScope><biblScope unit="page" from="1" to="9"/><date when="2020-01"/></imprint></monogr></biblStruct>'
        "</listBibl></div></back></text></TEI>"
    )
    got = readers.read_tei(spark, str(tmp_path)).orderBy("order").collect()
    assert [(r["heading"], r["text"]) for r in got] == [("Introduction", "Orphan."), ("Res", "")]
    assert got[1]["tables"] == ["| a | b\\|c |\n| --- | --- |\n| 1 |  |"]
    ref = readers.read_tei_references(spark, str(tmp_path)).first()
    assert (ref["reference"], ref["year"], ref["doi"]) == ("A B. (2020). On heat. J. Heat, 3, pp. 1-9. doi:10.1/x", "2020", "10.1/x")


def test_located_texts(spark):
    from folia.operators.joins import locate

    texts = spark.createDataFrame([(1, 1, "The load of  the cell rose"), (1, 2, "a b c d e 5 % of all the runs there x y z w v u"), (1, 3, "nothing like this at all"), (1, 4, "short"), (2, 5, None)], "d long, k long, q string")
    pages = spark.createDataFrame([(1, 1, "other"), (1, 2, "so the LOAD of\nthe cell rose again"), (1, 3, "e 5 % of all the runs there x was")], "d long, p int, b string")
    got = {r["k"]: (r["p"], r["how"]) for r in locate(texts, pages, "d", "k", "q", "p", "b").collect()}
    assert got == {1: (2, "whole"), 2: (3, "9"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none")}
