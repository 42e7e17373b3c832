"""Sources: files to typed DataFrames (SRC1-SRC15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.runtime import cut_lineage


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """A CSV with header under a given schema; blank is null (SRC2)."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def last_per_key(df: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The last row of each key (SRC1): a partial aggregate, no sort."""
    o = order if order is not None else F.monotonically_increasing_id()
    best = df.withColumn("_o", o).groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.col("_o")).alias("_r"))
    return best.select("_r.*")


def sniff_delimiter(spark: SparkSession, path: str, among: str = ",;\t|") -> str:
    """The delimiter a file's first line holds most often; a byte-order mark is ignored (SRC3). Only the first line is read."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0].lstrip("﻿") if head else ""
    return max(among, key=lambda d: (line.count(d), -among.index(d)))


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of unknown delimiter, all columns strings, names trimmed (SRC3)."""
    df = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType, suffix: str = r"\.json$", recursive: bool = True) -> DataFrame:
    """``(id, doc, parse_ok)``: one JSON object per file, id from the file's name without ``suffix``; unreadable files have a null doc (SRC4, SRC5)."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path)
    doc = F.when(F.trim("value").startswith("{"), F.from_json("value", schema))
    return t.select(F.regexp_replace(F.col("_metadata.file_name"), suffix, "").alias("id"), doc.alias("doc"), F.coalesce(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"), F.lit(False)).alias("parse_ok"))


def walk(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(folder, file, path, length, modified)`` of all files under a folder; contents aren't read (SRC6)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", "length", F.col("modificationTime").alias("modified"))


def pick_file(files: DataFrame, by: str, name: str, tiers: Sequence[str]) -> DataFrame:
    """``(by, name, tier, n_candidates)``: each folder's file that fits the earliest pattern; the first by name among equals (SRC7)."""
    rank = reduce(lambda acc, x: acc.when(F.col(name).rlike(x[1]), x[0]), enumerate(tiers), F.when(F.lit(False), 0))
    r = files.withColumn("_t", rank).where(F.col("_t").isNotNull())
    return r.groupBy(by).agg(F.min(F.struct("_t", F.col(name).alias("_f"))).alias("b"), F.count("*").alias("n_candidates")).select(by, F.col("b._f").alias(name), F.col("b._t").alias("tier"), "n_candidates")


def union_sheets(frames: Sequence[DataFrame]) -> DataFrame:
    """Sheets with differing columns as one table of strings (SRC8)."""
    text = [f.select(*[F.col(c).cast("string") for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), text)


def workbook_rows(content: bytes) -> list[tuple[str, int, dict[str, str]]]:
    """``(sheet, row, {column letters: text})`` of a workbook (zipped XML), cells as they are stored: shared, inline and plain strings, numbers as written. Empty rows are left out."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in x.iter(f"{main}t")) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{main}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            path = targets[sheet.get(f"{rel}id")]
            path = path if path in names else f"xl/{path}"
            for k, row in enumerate(ET.fromstring(z.read(path)).iter(f"{main}row"), 1):
                cells = {}
                for c in row.findall(f"{main}c"):
                    v, kind = c.find(f"{main}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if kind == "inlineStr" else None if v is None else strings[int(v.text)] if kind == "s" else v.text
                    if text is not None and text.strip():
                        cells["".join(ch for ch in (c.get("r") or "") if ch.isalpha())] = text
                if cells:
                    out.append((sheet.get("name"), int(row.get("r") or k), cells))
    return out


def read_workbooks(spark: SparkSession, path: str, skip: str = r"(?i)^\s*(?:instructions?|read\s*me|notes?|legend|guide)") -> DataFrame:
    """``(file, sheet, row, cells map<header, text>)`` of workbooks, all values strings; the first row of a sheet names its columns; sheets whose name fits ``skip`` are left out (SRC8).

    One file is read by one task; a file that is no workbook has one row with a null sheet. ``sheet_table`` gives columns.
    """
    src = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import re

        for b in batches:
            rows = []
            for name, content in zip(b["file"], b["content"], strict=True):
                try:
                    got = workbook_rows(bytes(content))
                except Exception:  # noqa: BLE001 - whatever a broken file raises
                    rows.append((name, None, None, None))
                    continue
                heads: dict[str, dict[str, str]] = {}
                for sheet, k, cells in got:
                    if re.search(skip, sheet):
                        continue
                    if sheet not in heads:
                        heads[sheet] = {c: x.strip() for c, x in cells.items()}
                    else:
                        rows.append((name, sheet, k, json.dumps({heads[sheet].get(c, c): x for c, x in cells.items()})))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kind) for i, (c, kind) in enumerate((("file", object), ("sheet", object), ("row", "Int64"), ("cells", object)))})

    return src.mapInPandas(run, "file string, sheet string, row long, cells string").withColumn("cells", F.from_json("cells", "map<string,string>"))


def sheet_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Workbook rows as a table of the named columns, null where a sheet lacks one (SRC8)."""
    return rows.where(F.col("sheet").isNotNull()).select("file", "sheet", "row", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


OCR_BOX = "array<struct<text:string,confidence:double,box:array<double>,polygon:array<array<double>>>>"


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """``(id, boxes array<struct<text, confidence, x, y, w, h>>, parse_ok)`` of a recogniser's JSON file per image (SRC12).

    Boxes come as four corners' numbers or as a polygon, in a list or under ``boxes``, ``words`` or ``results``; ones without either or without text are left out. Unreadable files have none.
    """
    from folia.operators.figures import polygon_to_box

    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    v = F.col("value")
    listed = F.coalesce(F.when(F.trim(v).startswith("["), F.from_json(v, OCR_BOX)), *[F.from_json(v, f"struct<{k}:{OCR_BOX}>")[k] for k in ("boxes", "words", "results")])
    box = lambda x: polygon_to_box(F.coalesce(x["polygon"], F.array().cast("array<array<double>>")), F.coalesce(x["box"], F.array().cast("array<double>")))
    full = F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), box(x)["x"].alias("x"), box(x)["y"].alias("y"), box(x)["w"].alias("w"), box(x)["h"].alias("h")))
    kept = F.filter(F.coalesce(full, F.array().cast("array<struct<text:string,confidence:double,x:double,y:double,w:double,h:double>>")), lambda x: x["x"].isNotNull() & (F.coalesce(F.trim(x["text"]), F.lit("")) != ""))
    return t.select(F.regexp_replace(F.col("_metadata.file_name"), r"(?i)([._-]ocr)?\.json$", "").alias("id"), kept.alias("boxes"), F.try_parse_json("value").isNotNull().alias("parse_ok"))


def dimension(df: DataFrame, keys: Column, value: str, order: str) -> DataFrame:
    """``(k, value)``: a lookup by any of a row's keys; the last row of a key holds (SRC9)."""
    return df.select(F.explode(keys).alias("k"), F.col(value).alias("value"), F.col(order).alias("_o")).where(F.coalesce("k", F.lit("")) != "").groupBy("k").agg(F.max_by("value", "_o").alias("value"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(id)`` from a file of lines (SRC14)."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def shard(df: DataFrame, order: str, k: int, which: int | None = None) -> DataFrame:
    """Contiguous shards of ``ceil(n / k)`` rows of a sorted table, numbered from 1 (SRC15).

    Places are found in two steps: counts per range partition, then places within partitions, so that no task sorts the whole table.
    """
    n = max(1, df.count())
    r = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    r = cut_lineage(r)  # sizes and rows must come from one and the same partitioning
    sizes = r.groupBy("_p").agg(F.count("*").alias("_c"))
    off = sizes.withColumn("_off", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    out = r.join(F.broadcast(off.select("_p", F.coalesce("_off", F.lit(0)).alias("_off"))), "_p").withColumn("shard", (F.floor((F.col("_off") + F.col("_i")) / F.lit(-(-n // k))) + 1).cast("int")).drop("_p", "_i", "_off")
    return out if which is None else out.where(F.col("shard") == which)


TEI_SECTION = "doc_id string, order int, level int, number string, heading string, text string, tables array<string>"
_TEI = "{http://www.tei-c.org/ns/1.0}"


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """Sections of TEI files in document order, with their tables as Markdown (SRC10, F31). A file that isn't XML yields no rows; text that stands before the first section is an introduction."""
    return tei_files(spark, path).mapInPandas(tei_sections, TEI_SECTION)


def read_tei_references(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, order, reference, title, year, doi)`` of the bibliographies of TEI files."""
    return tei_files(spark, path).mapInPandas(tei_references, "doc_id string, order int, reference string, title string, year string, doi string")


def tei_files(spark: SparkSession, path: str) -> DataFrame:
    src = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path)
    return src.select(F.regexp_replace(F.col("_metadata.file_name"), r"(\.tei)?\.xml$", "").alias("doc_id"), "value")


def _roots(b: pd.DataFrame) -> Iterator[tuple]:
    import xml.etree.ElementTree as ET

    for doc, xml in zip(b["doc_id"], b["value"], strict=True):
        try:
            yield doc, ET.fromstring(xml)
        except ET.ParseError:
            continue


def _plain(node) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def tei_table(table) -> str:
    """A TEI table as Markdown, short rows filled, bars within cells escaped."""
    rows = [[_plain(c).replace("|", "\\|") for c in r.findall(f"{_TEI}cell")] for r in table.iter(f"{_TEI}row")]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else ""


def tei_sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, root in _roots(b):
            place = 0
            for body in root.iter(f"{_TEI}body"):
                orphans = [x for p in body.findall(f"{_TEI}p") if (x := _plain(p))]
                if orphans:
                    rows.append((doc, place, 1, None, "Introduction", "\n\n".join(orphans), []))
                    place += 1
                stack = [(d, 1) for d in reversed(body.findall(f"{_TEI}div"))]
                while stack:
                    div, level = stack.pop()
                    head = div.find(f"{_TEI}head")
                    paras = [x for p in div.findall(f"{_TEI}p") if (x := _plain(p))]
                    tables = [x for f in div.findall(f"{_TEI}figure") for t in f.iter(f"{_TEI}table") if (x := tei_table(t))]
                    rows.append((doc, place, level, None if head is None else head.get("n"), None if head is None else _plain(head), "\n\n".join(paras), tables))
                    place += 1
                    stack += [(d, level + 1) for d in reversed(div.findall(f"{_TEI}div"))]
        yield pd.DataFrame(rows, columns=["doc_id", "order", "level", "number", "heading", "text", "tables"])


def tei_references(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, root in _roots(b):
            for k, bib in enumerate(x for lst in root.iter(f"{_TEI}listBibl") for x in lst.findall(f"{_TEI}biblStruct")):
                part, whole = bib.find(f"{_TEI}analytic"), bib.find(f"{_TEI}monogr")
                of = part if part is not None else whole
                names = [" ".join(x for x in (*(_plain(f) for f in n.findall(f"{_TEI}forename")), _plain(n.find(f"{_TEI}surname"))) if x) for a in (of.findall(f"{_TEI}author") if of is not None else []) for n in a.iter(f"{_TEI}persName")]
                people = ", ".join(names[:3]) + (" et al." if len(names) > 3 else "")
                title, host = _plain(of.find(f"{_TEI}title") if of is not None else None), _plain(whole.find(f"{_TEI}title")) if part is not None and whole is not None else ""
                dates = [d.get("when") or _plain(d) for d in bib.iter(f"{_TEI}date")]
                year = next((d[:4] for d in dates if d[:4].isdigit()), None)
                scope = {u.get("unit"): u.get("from") and f"{u.get('from')}-{u.get('to')}" or _plain(u) for u in bib.iter(f"{_TEI}biblScope")}
                doi = next((_plain(i) for i in bib.iter(f"{_TEI}idno") if (i.get("type") or "").upper() == "DOI"), None)
                where = ", ".join(x for x in (host, scope.get("volume"), scope.get("page") and f"pp. {scope['page']}") if x)
                bits = [people, f"({year})" if year else "", title, where, f"doi:{doi}" if doi else ""]
                rows.append((doc, k, ". ".join(x.rstrip(".") for x in bits if x), title or None, year, doi))
        yield pd.DataFrame(rows, columns=["doc_id", "order", "reference", "title", "year", "doi"])


def read_images(spark: SparkSession, path: str, longest: int = 1200) -> DataFrame:
    """``(path, width, height, dhash, features struct)`` of images by Spark's decoder, looked at in at most ``longest`` pixels a side (SRC11, F25, F28). Files that are no images have no row."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from folia.functions import pixels

        for b in batches:
            rows = []
            for origin, h, w, ch, data in b[["origin", "height", "width", "nChannels", "data"]].itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, ch)
                rgb = pixels.shrink(a[:, :, 2::-1] if ch >= 3 else np.repeat(a[:, :, :1], 3, axis=2), longest)  # the decoder gives blue, green, red
                rows.append((origin, w, h, pixels.difference_hash(rgb), *pixels.pixel_features(rgb).values()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "dhash", *pixels.FEATURES])

    from folia.functions.pixels import FEATURES

    flat = img.mapInPandas(run, "path string, width int, height int, dhash string, " + ", ".join(f"{f} double" for f in FEATURES))
    return flat.select("path", "width", "height", "dhash", F.struct(*FEATURES).alias("features"))


def external(df: DataFrame, key: str, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``(key, status, error, <schema>)``: rows through an external tool in Arrow batches (SRC13).

    ``scorer`` takes a batch and gives the key with the columns of ``schema``. If it fails on a batch, its rows are tried one by one, and those that fail alone are rows of status ``error`` with
    the message; rows it gives nothing for have status ``empty``. The job goes on.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [f.name for f in T._parse_datatype_string(schema).fields] if hasattr(T, "_parse_datatype_string") else [x.split()[0] for x in schema.split(",")]

    def attempt(b: pd.DataFrame) -> pd.DataFrame:
        got = scorer(b)
        out = b[[key]].merge(got[[key, *names]], on=key, how="left", indicator=True)
        out["status"] = ["success" if x == "both" else "empty" for x in out.pop("_merge")]
        out["error"] = None
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield attempt(b)[[key, "status", "error", *names]]
            except Exception:  # noqa: BLE001 - a tool raises what it likes
                for k in range(len(b)):
                    row = b.iloc[k : k + 1]
                    try:
                        yield attempt(row)[[key, "status", "error", *names]]
                    except Exception as e:  # noqa: BLE001
                        yield pd.DataFrame({key: row[key], "status": ["error"], "error": [str(e)[:500]], **{n: [None] for n in names}})

    return df.mapInPandas(run, f"`{key}` {kind}, status string, error string, {schema}")
