"""Frame keys, ranges, layouts and matching of files to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions.common import global_row_number, stem

BIN = 1024


def frame_number(name: Column, mode: str = "strict") -> Column:
    """Number of a frame in its file name.

    strict: digits after the last underscore of the stem, else null. plan: the same, but something must stand before
    the underscore. matrix: the last token split by underscores if it is all digits, else 0.
    """
    s = stem(name)
    if mode == "strict":
        return F.nullif(F.regexp_extract(s, r"_(\d+)$", 1), F.lit("")).cast("long")
    if mode == "plan":
        return F.nullif(F.regexp_extract(s, r"^.+_(\d+)$", 1), F.lit("")).cast("long")
    if mode == "matrix":
        last = F.element_at(F.split(s, "_"), -1)
        return F.when(last.rlike(r"^\d+$"), last.cast("long")).otherwise(F.lit(0).cast("long"))
    raise ValueError(f"unknown mode {mode!r}")


def natural_key(c: Column, width: int = 20) -> Column:
    """Lower-case text whose digit runs are padded, so that text order is the natural order."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), width, "0")).otherwise(x)), "")


def natural_sort(names: Column) -> Column:
    """An array of texts in natural order, equals of one key in order of the text."""
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(natural_key(x).alias("key"), x.alias("name")))), lambda x: x["name"])


def frame_identity(df: DataFrame, path: str = "path") -> DataFrame:
    """df with sequence_id (parent folder or null), sequence_group (__root__ when null) and display_name."""
    parent = F.nullif(F.regexp_extract(F.col(path), r"(?:^|/)([^/]+)/[^/]+$", 1), F.lit(""))
    return df.withColumns({"sequence_id": parent, "display_name": F.regexp_replace(path, r"^.*/", "")}).withColumn("sequence_group", F.coalesce("sequence_id", F.lit("__root__")))


def parse_frame_ranges(df: DataFrame, expr: str = "expr") -> DataFrame:
    """One row (pos, start, end) per part of a range text: parts split by ; or , and bounds by - or :, put in order.

    An empty part, more than two bounds or anything but digits raises an error.
    """
    parts = df.select("*", F.posexplode(F.split(F.col(expr), "[;,]")).alias("pos", "part")).withColumn("part", F.trim("part"))
    ok = F.col("part").rlike(r"^\s*\d+\s*([-:]\s*\d+\s*)?$")
    part = F.when(ok, F.col("part")).otherwise(F.raise_error(F.concat(F.lit("bad frame range: "), F.col("part"))))
    bounds = F.transform(F.split(part, "[-:]"), lambda x: F.trim(x).cast("long"))
    return parts.withColumn("_b", bounds).withColumns({"start": F.array_min("_b"), "end": F.array_max("_b")}).drop("_b", "part")


def select_frames(df: DataFrame, ranges: DataFrame, mode: str = "full_range", per_row: int | None = None, frame: str = "frame") -> DataFrame:
    """The rows of df whose frame lies in one of ranges(start, end).

    full_range: between start and end. rectangle: the rectangle between both frames on a grid of per_row columns; if end
    stands left of start, the columns are swapped. area: start's column up to end's column in the rows between, without a
    swap. Ranges are cut in bins, so the join has a key and every row is kept once whatever the number of ranges.
    """
    if mode != "full_range" and not per_row:
        raise ValueError("per_row is needed")
    r = ranges.select("start", "end").distinct()
    f = F.col(frame)
    if mode == "full_range":
        test = f.between(F.col("start"), F.col("end"))
        r = r.withColumns({"_lo": F.col("start"), "_hi": F.col("end")})
    else:
        col = lambda x: (F.col(x) - 1) % per_row
        row = lambda x: F.floor((F.col(x) - 1) / per_row)
        left, right = (F.least(col("start"), col("end")), F.greatest(col("start"), col("end"))) if mode == "rectangle" else (col("start"), col("end"))
        r = r.withColumns({"_left": left, "_right": right, "_top": row("start"), "_bottom": row("end")})
        r = r.withColumns({"_lo": F.col("_top") * per_row + 1, "_hi": (F.col("_bottom") + 1) * per_row})
        at = (f - 1) % per_row
        test = at.between(F.col("_left"), F.col("_right")) & F.floor((f - 1) / per_row).between(F.col("_top"), F.col("_bottom"))
    bins = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / BIN), F.floor(F.col("_hi") / BIN))))
    return df.withColumn("_bin", F.floor(f / BIN)).alias("d").join(bins.alias("r"), (F.col("d._bin") == F.col("r._bin")) & test, "left_semi").drop("_bin")


def matrix_layout(df: DataFrame, columns: int, frame: str = "frame", name: str = "name") -> DataFrame:
    """df with idx, row and col of a dense grid in order of (frame number, natural key of the name)."""
    n = global_row_number(df, [F.col(frame), natural_key(F.col(name)), F.col(name)], "idx")
    return n.withColumns({"row": F.floor(F.col("idx") / columns), "col": F.col("idx") % columns})


def base_frames(df: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(first file of each frame number by lower stem and path, warnings(path, reason))."""
    d = df.withColumn("frame", frame_number(F.col(path)))
    w = Window.partitionBy("frame").orderBy(F.lower(stem(F.col(path))), F.lower(path), path)
    ranked = d.where("frame is not null").withColumn("_n", F.row_number().over(w))
    bad = d.where("frame is null").select(path, F.lit("no number").alias("reason"))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").select(path, F.lit("duplicate").alias("reason")).unionByName(bad)


def layer_frames(df: DataFrame, base: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(first file of each number that base has, warnings): files of other numbers are outside of the base."""
    d = df.withColumn("frame", frame_number(F.col(path)))
    w = Window.partitionBy("frame").orderBy(F.lower(path), path)
    inside = d.join(base.select("frame"), "frame", "left_semi").withColumn("_n", F.row_number().over(w))
    outside = d.where("frame is not null").join(base.select("frame"), "frame", "left_anti")
    warn = inside.where("_n > 1").select(path, F.lit("duplicate").alias("reason"))
    warn = warn.unionByName(outside.select(path, F.lit("outside").alias("reason"))).unionByName(d.where("frame is null").select(path, F.lit("no number").alias("reason")))
    return inside.where("_n = 1").drop("_n"), warn


def resolve_assets(keys: DataFrame, files: DataFrame) -> DataFrame:
    """keys(key) with the path of files(path): exact path, else the one file of that lower name, else of that lower stem."""
    name = lambda c: F.lower(F.regexp_replace(c, r"^.*/", ""))
    lone = lambda by: files.groupBy(by(F.col("path")).alias("k")).agg(F.min("path").alias("p"), F.count(F.lit(1)).alias("n")).where("n = 1").select("k", "p")
    exact = files.select(F.col("path").alias("k"), F.col("path").alias("p0")).distinct()
    by_name, by_stem = lone(name).withColumnRenamed("p", "p1"), lone(lambda c: F.lower(stem(c))).withColumnRenamed("p", "p2")
    j = keys.join(exact, keys["key"] == exact["k"], "left").drop("k")
    j = j.join(by_name, name(j["key"]) == by_name["k"], "left").drop("k")
    j = j.join(by_stem, F.lower(stem(j["key"])) == by_stem["k"], "left").drop("k")
    return j.withColumn("path", F.coalesce("p0", "p1", "p2")).drop("p0", "p1", "p2")


def assemble_frames(assets: DataFrame, base: str, models: list[str]) -> DataFrame:
    """One row per frame of the base model that every other model has, from assets(frame_key, role, model_id, path).

    masks and probs map models to paths; original and gt are optional.
    """
    wanted = assets.where(F.col("role").isin("original", "gt") | F.col("model_id").isin(models))
    pick = lambda role: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("model_id", "path")))))
    g = wanted.dropDuplicates(["frame_key", "role", "model_id"]).groupBy("frame_key").agg(
        pick("mask").alias("masks"), pick("prob").alias("probs"), F.min(F.when(F.col("role") == "original", F.col("path"))).alias("original"), F.min(F.when(F.col("role") == "gt", F.col("path"))).alias("gt")
    )
    return g.where((F.size("masks") == len(set(models))) & F.map_contains_key("masks", base))


def pair_report(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """(key, n_left, n_right, status): matched, left_only, right_only, or duplicate if a side has the key twice."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    j = a.join(b, key, "full_outer").na.fill(0, ["n_left", "n_right"])
    status = F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate").when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").otherwise("matched")
    return j.withColumn("status", status)


def transfer_plan(files: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, missing, summary) of files(folder, name, ext, size) for frames(frame).

    The first file by lower name stands for a frame in its (folder, ext). Groups without a hit are skipped and miss nothing.
    """
    f = files.withColumn("frame", frame_number(F.col("name"), "plan"))
    w = Window.partitionBy("folder", "ext", "frame").orderBy(F.lower("name"), "name")
    hits = f.join(frames.select("frame").distinct(), "frame").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    dest = F.concat(F.regexp_replace("ext", r"^\.", ""), F.lit("_"), "folder", F.lit("/"), "name")
    ops = hits.withColumn("destination", dest)
    groups = hits.select("folder", "ext").distinct()
    # every group that was hit wants every frame; the product is as large as the answer may be
    missing = frames.select("frame").distinct().crossJoin(F.broadcast(groups)).join(hits, ["folder", "ext", "frame"], "left_anti")
    summary = ops.groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
    return ops, missing, summary


def sample_copy_plan(frames: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies(frame, pos, name, target), missing(frame)) for frames(frame, pos): the first source by name whose stem has the number."""
    numbers = sources.select("name", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(stem(F.col("name")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)")))).alias("frame"))
    best = numbers.groupBy("frame").agg(F.min("name").alias("name"))
    j = frames.join(best, frames["frame"] == best["frame"], "left").drop(best["frame"])
    target = F.concat(F.lit("check_"), F.lpad(F.col("pos").cast("string"), 4, "0"), F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return j.where("name is not null").withColumn("target", target), j.where("name is null").select("frame")


def model_pairs(df: DataFrame, frame: str = "frame_key", model: str = "model_id", order: str = "ord") -> DataFrame:
    """(frame, model_a, model_b) for all unordered pairs of models of a frame, in model order."""
    a = df.select(F.col(frame), F.col(model).alias("model_a"), F.col(order).alias("_a"))
    b = df.select(F.col(frame), F.col(model).alias("model_b"), F.col(order).alias("_b"))
    return a.join(b, frame).where("_a < _b").drop("_a", "_b")


def author_quality(checks: DataFrame, author_frames: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(author, n_checked, n_wrong, wrong_percent): a frame counts for each author who owns it, wrong only if a verdict says so."""
    v = checks.join(verdicts, checks["vector_no"] == verdicts["number"], "left").select("frame", (~F.coalesce("is_correct", F.lit(True))).cast("long").alias("wrong"))
    own = author_frames.select("author", "frame").distinct()
    g = own.join(v, "frame", "left").groupBy("author").agg(F.count("wrong").alias("n_checked"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong"))
    return g.withColumn("wrong_percent", F.when(F.col("n_checked") > 0, F.floor(F.col("n_wrong") * 10000 / F.col("n_checked") + 0.5) / 100).otherwise(0.0))
