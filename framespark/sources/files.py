"""Readers and writers: file manifests, CIF layouts, EDIF netlists, verdict XML, vertex tables, series and selection manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_manifest(spark: SparkSession, root: str, exts: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, name, ext, size) of the files below root whose lower suffix is in exts (all if none); content isn't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", F.col("length").alias("size"))
    base = root.rstrip("/").split("://")[-1]
    f = f.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(base)}/", "").alias("path"), "size")
    f = f.withColumns({"name": F.regexp_replace("path", r"^.*/", ""), "ext": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))})
    return f.where(F.col("ext").isin(*[e.lower() for e in exts])) if exts else f


def parse_cif(texts: DataFrame) -> DataFrame:
    """(path, name, w, h, polygons...) rows of texts(path, value): one per shape with polygon_id, category, points.

    P rings have their y flipped and the closing vertex dropped; B boxes become vias around the flipped centre. A shape before the
    size, an odd number of coordinates or fewer than three vertices raise an error.
    """
    nums = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    head = texts.select("path", F.regexp_extract("value", r"\(\s*R\s+([^)]*?)\s*\)", 1).alias("name"), nums(F.regexp_extract("value", r"\(\s*S\s+([^)]*)\)", 1)).alias("_s"), F.regexp_replace("value", r"\([^)]*\)", "").alias("_body"))
    s = head.select("path", "name", F.get("_s", F.lit(0)).alias("w"), F.get("_s", F.lit(1)).alias("h"), F.posexplode(F.filter(F.transform(F.split("_body", ";"), lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: x.rlike(r"^[PB]\s"))).alias("i", "_c"))
    s = s.withColumns({"polygon_id": F.col("i") + 1, "_n": nums(F.col("_c")), "_via": F.col("_c").startswith("B")})
    h = F.when(F.col("h").isNull(), F.raise_error(F.lit("shape before the size"))).otherwise(F.col("h"))
    n = F.col("_n")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    bad = (F.size(n) % 2 != 0) | (F.size(n) < 6)
    ring = F.transform(F.sequence(F.lit(0), F.greatest((F.size(n) / 2).cast("int") - 1, F.lit(0))), lambda i: pt(F.get(n, 2 * i), h - F.get(n, 2 * i + 1)))
    closed = (F.size(ring) > 3) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1))
    ring = F.when(bad, F.raise_error(F.concat(F.lit("bad polygon: "), F.col("_c")))).when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    g = lambda i: F.get(n, F.lit(i))
    x0, x1, y0, y1 = g(2) - g(0) / 2, g(2) + g(0) / 2, h - g(3) - g(1) / 2, h - g(3) + g(1) / 2
    box = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))
    return s.select("path", "name", "w", "h", "polygon_id", F.when(F.col("_via"), "via").otherwise("conductor").alias("category"), F.when(F.col("_via"), box).otherwise(ring).alias("points"))


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_cif(t)


def format_cif(polygons: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_key, value): CIF text of polygons(frame_key, polygon_id, points, is_hole, category) for frames(frame_key, w, h): by id, holes left out, clamped, rounded, closed."""
    j = polygons.where("not is_hole").join(frames.select("frame_key", "w", "h"), "frame_key")
    at = lambda v, top: F.least(F.greatest(F.rint(v), F.lit(0.0)), top.cast("double")).cast("long").cast("string")
    closed = F.concat("points", F.slice("points", 1, 1))
    ring = F.concat(F.lit("P "), F.array_join(F.transform(closed, lambda p: F.concat(at(p["x"], F.col("w")), F.lit(" "), at(F.col("h") - p["y"], F.col("h")))), " "), F.lit(";"))
    lo, hi = lambda k: F.array_min(F.transform("points", lambda p: p[k])), lambda k: F.array_max(F.transform("points", lambda p: p[k]))
    whole = lambda v: F.rint(v).cast("long").cast("string")
    box = F.concat_ws(" ", F.lit("B"), whole(hi("x") - lo("x")), whole(hi("y") - lo("y")), whole((lo("x") + hi("x")) / 2), F.concat(whole(F.col("h") - (lo("y") + hi("y")) / 2), F.lit(";")))
    line = F.when(F.col("category") == "via", box).otherwise(ring)
    g = j.groupBy("frame_key").agg(F.array_sort(F.collect_list(F.struct("polygon_id", line.alias("line")))).alias("_l"))
    head = F.concat(F.lit("( R "), F.col("frame_key").cast("string"), F.lit(" );\n( S "), F.col("w").cast("long").cast("string"), F.lit(" "), F.col("h").cast("long").cast("string"), F.lit(" );\n"))
    body = F.coalesce(F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n")), F.lit(""))
    return frames.join(g, "frame_key", "left").select("frame_key", F.concat(head, body, F.lit("DF;\nE\n")).alias("value"))


def write_cif(polygons: DataFrame, frames: DataFrame, path: str) -> None:
    """One text part per frame below path/frame_key=..."""
    format_cif(polygons, frames).write.partitionBy("frame_key").text(path)


def explode_vertices(polygons: DataFrame) -> DataFrame:
    """One row per vertex with coordinates as text of six decimals, is_hole 0 or 1, and an empty parent if there is none."""
    p = polygons.select("frame_key", "polygon_id", F.col("is_hole").cast("int").alias("is_hole"), F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("parent_id"), "category", F.posexplode("points").alias("vertex", "p"))
    return p.select("frame_key", "polygon_id", "is_hole", "parent_id", "category", "vertex", F.format_string("%.6f", "p.x").alias("x"), F.format_string("%.6f", "p.y").alias("y"))


def _edif_rows(text: str) -> Iterator[tuple]:
    """(kind, net, instance, port, seq, x, y) rows of the nets of an EDIF text."""
    stack: list[list] = [[]]
    for t in re.findall(r'[()]|"[^"]*"|[^\s()]+', text):
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        else:
            stack[-1].append(t)

    def walk(node, net=None):
        if not isinstance(node, list) or not node:
            return
        head = node[0] if isinstance(node[0], str) else ""
        if head == "net" and len(node) > 1:
            name = node[1]
            net = name[1] if isinstance(name, list) and len(name) > 1 else name
        elif head == "portRef" and net is not None and len(node) > 2 and isinstance(node[2], list):
            yield ("pin", net, node[2][1] if len(node[2]) > 1 else None, node[1], None, None, None)
        elif head == "pointList" and net is not None:
            for i, p in enumerate(x for x in node[1:] if isinstance(x, list) and x[:1] == ["pt"]):
                yield ("wire", net, None, None, i, int(p[1]), int(p[2]))
        elif head == "instance" and len(node) > 1:
            name = node[1]
            yield ("instance", None, name[1] if isinstance(name, list) else name, None, None, None, None)
        for x in node[1:]:
            yield from walk(x, net)

    for top in stack[0]:
        yield from walk(top)


EDIF_SCHEMA = "design string, kind string, net string, instance string, port string, seq int, x int, y int"


def parse_edif(texts: DataFrame) -> DataFrame:
    """Long rows (EDIF_SCHEMA) of texts(path, value): pins, wire points and instances of each design, read one file at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, *r) for p, v in zip(pdf["path"], pdf["value"], strict=True) for r in _edif_rows(v)]
            out = pd.DataFrame(rows, columns=["design", "kind", "net", "instance", "port", "seq", "x", "y"])
            yield out.astype({c: "Int32" for c in ("seq", "x", "y")})

    return texts.select("path", "value").mapInPandas(run, EDIF_SCHEMA)


def read_edif(spark: SparkSession, path: str) -> DataFrame:
    return parse_edif(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def verdict_number(name: Column) -> Column:
    """The last all-digit token of a name split at / _ and ."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.split(name, "[/_.]+"), lambda t: t.rlike(r"^\d+$"))), -1).cast("long")


def verdicts(rows: DataFrame) -> DataFrame:
    """(number, is_correct) of rows(pos, name, correct): 0 and false are wrong, nothing is right; the last row of a number wins; names without a number are dropped."""
    ok = ~F.lower(F.coalesce("correct", F.lit("1"))).isin("0", "false")
    v = rows.select("pos", verdict_number(F.col("name")).alias("number"), ok.alias("is_correct")).where("number is not null")
    return v.groupBy("number").agg(F.max_by("is_correct", "pos").alias("is_correct"))


def read_verdict_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    x = spark.read.format("xml").option("rowTag", row_tag).load(path)
    correct = F.col("_Correct").cast("string") if "_Correct" in x.columns else F.lit(None).cast("string")
    return verdicts(x.select(F.monotonically_increasing_id().alias("pos"), F.col("_Name").alias("name"), correct.alias("correct")))


def series_table(series: DataFrame, labels: list[str], x_name: str = "Epoch") -> DataFrame:
    """One row per x of series(label, x, y) and a column per label, blank where it has no value; whole x without decimals."""
    p = series.groupBy("x").pivot("label", labels).agg(F.last("y")).orderBy("x")
    x = F.when(F.col("x") == F.floor("x"), F.floor("x").cast("string")).otherwise(F.col("x").cast("string"))
    return p.select(x.alias(x_name), *labels)


def selection_lines(selected: DataFrame) -> DataFrame:
    """(reason, value): one JSON text of each row of selected(frame, score, percentile, reason), for selections of any size."""
    return selected.select("reason", F.to_json(F.struct("frame", "score", "percentile", "reason")).alias("value"))


def write_selection(selected: DataFrame, path: str) -> None:
    """selection_lines as text files, a folder for each reason."""
    selection_lines(selected).write.partitionBy("reason").text(path)


def selection_manifest(selected: DataFrame) -> DataFrame:
    """(value): one JSON text of selected(frame, score, percentile, reason): keys by reason in order, and score, percentile and reason of each.

    All rows go into one text, so this is for small selections (the top k); selection_lines takes any.
    """
    keys = lambda r: F.array_sort(F.collect_list(F.when(F.col("reason") == r, F.col("frame")))).alias(r)
    info = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("string"), F.struct("score", "percentile", "reason"))))).alias("frames")
    return selected.agg(keys("primary"), keys("neighbor"), info).select(F.to_json(F.struct("primary", "neighbor", "frames")).alias("value"))
