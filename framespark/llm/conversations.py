"""Conversation repair: turns aligned to the alternating grammar by Wagner-Fischer tables within Ukkonen bands.

A conversation should read (s?(ua)+)?: perhaps a system turn, then user and assistant in turn. Every feasible length of that
grammar is one target string. All targets of a length end alike, so one table of suffixes, which gives the cheapest edits from
any turn on to the last m roles, holds the tables of all lengths. Cells so far off the diagonal that they would cost more than the
incumbent, a repair by a simple left-to-right rule, are left out. The audits of all lengths of least cost are traced back and
compared. Turns that must go are set aside first: their deletions cost the same everywhere and come as early as possible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.llm.common import CRC_SQL, CRC_TABLE_SQL, runs_of, salted_join, stash, work_dir

#: Costs (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ROLES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
BIG = 1 << 28
#: Conversations of more turns, or of more text, are aligned in segments.
LONG_TURNS, LONG_BYTES, SEGMENT = 4096, 64 << 20, 1024
#: Alignments of so few turns are kept, since the same patterns come again and again.
SHORT = 16

#: What has been written of a conversation: nothing, a system turn, up to a user turn, up to an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role that comes next.
NEXT = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}


# ---------------------------------------------------------------- alignment


def incumbent(initials: str, cuts: int, system: bool = True) -> int:
    """Cost of repairing turns that may stay by a left-to-right rule: a missing role goes in, an unknown one is changed."""
    costs = [DELETE * len(initials)] if system else []
    for skip in (0, 1) if system and initials[:1] == "s" else (0,):
        cost, expect = TRUNCATED * cuts, "u"
        for c in initials[skip:]:
            if c == expect:
                expect = OTHER[expect]
            elif c in OTHER:
                cost += INSERT
            else:
                cost += REROLE
                expect = OTHER[expect]
        cost += INSERT * (expect == "a") + 2 * INSERT * (skip == len(initials) == 1)
        costs.append(cost)
    return min(costs)


class Suffixes:
    """Least costs of turning turns i and after into the last m roles of a target that ends with ``last``, up to ``bound``."""

    def __init__(self, initials: str, cuts: np.ndarray, last: str, bound: int):
        self.initials, self.cuts, self.last = initials, cuts, last
        n = self.n = len(initials)
        many = int(cuts.sum())
        # every cut turn costs 3 if it stays and 4 if it goes; what else there is to spend limits inserts and deletes
        excess = bound - TRUNCATED * many
        self.high = excess // INSERT
        self.low = max(-(min(excess, many) + max(excess - many, 0) // DELETE), -n)
        width = self.high - self.low + 1
        d = np.arange(self.low, self.high + 1)
        step = INSERT * np.arange(width)
        self.rows = np.full((n + 1, width + 1), BIG, np.int32)  # the last column stands for what lies beyond the band
        self.rows[n, :width] = np.where(d >= 0, INSERT * d, BIG)
        for i in range(n - 1, -1, -1):
            m = d + (n - i)
            fits = (m & 1 == 1) if initials[i] == last else (m & 1 == 0) if initials[i] == OTHER[last] else False
            keep = self.rows[i + 1, :width] + np.where(fits, 0, REROLE) + TRUNCATED * int(cuts[i])
            now = np.minimum(np.where(m >= 1, keep, BIG), self.rows[i + 1, 1:] + DELETE)
            self.rows[i, :width] = np.minimum.accumulate(now - step) + step

    def cost(self, i: int, m: int) -> int:
        d = m - (self.n - i)
        return int(self.rows[i, d - self.low]) if m >= 0 and self.low <= d <= self.high else BIG

    def lengths(self, i: int, first: str, least: int) -> range:
        """Lengths in the band at turn i whose target begins with ``first`` (or is empty, if least is 0)."""
        low = max(self.low + self.n - i, least)
        return range(low + ((low & 1) != (first == self.last)), self.high + self.n - i + 1, 2)

    def trace(self, i: int, m: int) -> str:
        """The ASCII-least of the cheapest audits: at every step the least letter that stays on a cheapest way."""
        out = []
        while i < self.n or m:
            here = self.cost(i, m)
            if i < self.n and self.cost(i + 1, m) + DELETE == here:
                out.append("D")
                i += 1
            elif m and self.cost(i, m - 1) + INSERT == here:
                out.append("I")
                m -= 1
            else:
                out.append("K" if self.initials[i] == (self.last if m & 1 else OTHER[self.last]) else "R")
                i, m = i + 1, m - 1
        return "".join(out)


def paths(initials: str, cuts: np.ndarray, start: int, ends: tuple[int, ...], bound: int) -> dict[int, tuple[int, str]]:
    """Per end state the least cost and its ASCII-least audit, for turns that may stay, from a start state."""
    n = len(initials)
    system = [i for i, c in enumerate(initials) if c == "s"] if start == NOTHING else []
    found: dict[int, tuple[int, str]] = {}
    if start in (NOTHING, SYSTEM) and start in ends:
        found[start] = (DELETE * n, "D" * n)
    if SYSTEM in ends and system:
        # D comes before K, so the last of the cheapest system turns stays
        cost, i = min((DELETE * (n - 1) + TRUNCATED * int(cuts[i]), -i) for i in system)
        found[SYSTEM] = (cost, "D" * -i + "K" + "D" * (n - 1 + i))
    for end in ends:
        if end not in (USER, ASSISTANT):
            continue
        table = Suffixes(initials, cuts, OTHER[NEXT[end]], bound)
        ways = [(table.cost(0, m), 0, m, "") for m in table.lengths(0, NEXT[start], 0 if start == end else 1)]
        for i in system:
            if DELETE * i <= bound:
                spent = DELETE * i + TRUNCATED * int(cuts[i])
                ways += [(spent + table.cost(i + 1, m), i + 1, m, "D" * i + "K") for m in table.lengths(i + 1, "u", 1)]
        least = min((w[0] for w in ways), default=BIG)
        if least < BIG:
            found[end] = (least, min(head + table.trace(i, m) for cost, i, m, head in ways if cost == least))
    return found


def with_forced(audit: str, forced: np.ndarray) -> str:
    """The audit of all turns: those that must go are deleted as soon as they come, since D precedes every other letter."""
    out, at, n = [], 0, len(forced)
    for op in audit:
        while at < n and forced[at]:
            out.append("D")
            at += 1
        out.append(op)
        at += op != "I"
    return "".join(out) + "D" * (n - at)


def align(initials: list[str], forced: np.ndarray, cuts: np.ndarray) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: role initials, which turns must go, which stay truncated."""
    if len(initials) <= SHORT:
        return _align_short(tuple(initials), forced.tobytes(), cuts.tobytes())
    return _align(initials, forced, cuts)


@lru_cache(1 << 16)
def _align_short(initials: tuple[str, ...], forced: bytes, cuts: bytes) -> tuple[int, str]:
    return _align(list(initials), np.frombuffer(forced, bool), np.frombuffer(cuts, bool))


def _align(initials: list[str], forced: np.ndarray, cuts: np.ndarray) -> tuple[int, str]:
    some = "".join(c or " " for c, f in zip(initials, forced, strict=True) if not f)
    short = cuts[~forced]
    bound = incumbent(some, int(short.sum()))
    cost, audit = min((c, with_forced(a, forced)) for c, a in paths(some, short, NOTHING, (NOTHING, ASSISTANT), bound).values())
    return cost + DELETE * int(forced.sum()), audit


# ---------------------------------------------------------------- conversations


def flags(texts: list[str], roles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blank, duplicate, truncated) of the turns of a conversation in order; each has its first fault only."""
    out = np.zeros((3, len(texts)), bool)
    seen: set[tuple[str, str]] = set()
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        bare = text.rstrip(BLANK)
        if not bare:
            out[0, i] = True
        elif (role, text) in seen:
            out[1, i] = True
        else:
            out[2, i] = not bare.endswith(ENDS)
        seen.add((role, text))
    return out[0], out[1], out[2]


def gaps_of(turns: list[int | None]) -> int:
    """Turn numbers that lack between the least and the greatest."""
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repaired(audit: str, turns: Iterator[tuple[str, str]], expect: str | None = None) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that an audit leaves, changes or puts in; expect is the role due first, if turns were written before."""
    for op in audit:
        if op == "I":
            expect = expect or "u"
            yield ROLES[expect], ""
        else:
            role, text = next(turns)
            if op == "D":
                continue
            if op == "K" and role[:1] == "s":
                expect = "u"
                yield role, text
                continue
            expect = expect or "u"
            yield role if op == "K" else ROLES[expect], text
        expect = OTHER[expect]


class Conversation:
    """One conversation: turns, roles and texts in order."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str]):
        initials = [r[:1] for r in roles]
        blank, duplicate, truncated = flags(texts, roles)
        self.cost, self.audit = align(initials, blank | duplicate, truncated)
        self.counts = (gaps_of(turns), int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), illegal_pairs(initials), self.cost)
        self.result = list(repaired(self.audit, iter(zip(roles, texts, strict=True))))

    def digest(self) -> str:
        return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in self.result).encode()).hexdigest()


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, list, list]]:
    """(conv_id, turns, roles, texts) of the rows that are there of each conversation; rows come sorted by conversation and turn."""
    now, rows, some = None, ([], [], []), False
    for b in batches:
        for conv, there, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "there", "turn", "role", "text")), strict=True):
            if some and conv != now:
                yield now, *rows
                rows = ([], [], [])
            now, some = conv, True
            if there:
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
    if some:
        yield now, *rows


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


TURNS = "conv_id long, turn long, role string, text string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield _batch(some, schema)


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one blank, and there."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), there.alias("there"))


def _parted(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a task takes whole, in order within partitions, and those of long ones, if there are any."""
    n, size = F.count_if("there"), F.sum(F.when(F.col("there"), F.octet_length("text")))
    long = rows.groupBy("conv_id").agg(n.alias("n"), size.alias("size")).where((F.col("n") > LONG_TURNS) | (F.col("size") > LONG_BYTES))
    long = stash(long.select(F.col("conv_id").alias("_id")), folder, "long")
    in_task = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    if long.isEmpty():
        return in_task(rows), None
    same = rows["conv_id"].eqNullSafe(long["_id"])
    return in_task(rows.join(long, same, "left_anti")), rows.join(long, same, "left_semi").where("there").drop("there")


def repair_reports(turns: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): faults, least cost, audit and the digest of the repaired turns.

    Turns are taken by number (nulls first), equal numbers by role and text. Null roles and texts count as one blank; a null conv_id is a
    conversation of its own. Rows whose column ``there``, if there is one, is false only name their conversation; one without
    other rows has zeros, an empty audit and the digest of empty text. Other columns are ignored; an empty table gives none.
    Conversations of more than LONG_TURNS turns or LONG_BYTES of text are aligned in segments of many tasks.
    """
    folder = folder or work_dir(turns.sparkSession)
    short, long = _parted(_rows(turns), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((conv, Conversation(*columns)) for conv, *columns in in_order(batches))
        return _batches(((conv, *c.counts, c.audit, c.digest()) for conv, c in each), REPORT)

    out = short.mapInArrow(run, REPORT)
    return out if long is None else out.unionByName(_long_reports(*_long(long, folder)))


def repaired_turns(turns: DataFrame, folder: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) of the repaired conversations, turns numbered from 0; input as for repair_reports."""
    folder = folder or work_dir(turns.sparkSession)
    short, long = _parted(_rows(turns), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((conv, Conversation(*columns).result) for conv, *columns in in_order(batches))
        return _batches(((conv, i, role, text) for conv, result in each for i, (role, text) in enumerate(result)), TURNS)

    out = short.mapInArrow(run, TURNS)
    return out if long is None else out.unionByName(_long_turns(*_long(long, folder)[:2]))


# ---------------------------------------------------------------- long conversations

PLACE = "conv_id long, part int, seg int"
ORDERED = f"{PLACE}, pos int, turn long, role string, text string, blank boolean, duplicate boolean, truncated boolean"
WAYS = f"{PLACE}, start int, end int, cost long, audit string, first string, last string, blank long, duplicate long, truncated long, illegal long"
JOINED = f"{PLACE}, start int, audit string, blank long, duplicate long, truncated long, illegal long, cost long"


def _long(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of long conversations in order and in segments, the audit of each segment, and the totals of each conversation.

    Range partitions put the turns in order without one task for a conversation; segments of SEGMENT turns are aligned each for itself, from
    every state to every state of the grammar; and what is joined one after the other per conversation is only these few audits a
    segment. Where a text was seen first is found by a grouping of its digest over all tasks.
    """
    known = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("t"))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), F.col("role"), F.col("text")), 256)
    t = rows.withColumns({"k": key, "at": known})
    t = salted_join(t, t.groupBy("k").agg(F.min("at").alias("seen")), "k", "at").withColumn("later", F.col("at") > F.col("seen"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = t.withColumn("head", F.substring("text", 1, 32)).repartitionByRange(parts, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = placed.select("conv_id", "turn", "role", "text", "later", F.spark_partition_id().alias("part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            before = None
            seg = pos = 0
            for b in batches:
                for conv, turn, role, text, later, part in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "later", "part")), strict=True):
                    if before is None or before[0] != conv:
                        seg, pos = 0, 0
                    elif pos == SEGMENT:
                        seg, pos = seg + 1, 0
                    bare = text.rstrip(BLANK)
                    # rows of equal turn, role and text stand together, and all but the first repeat it
                    again = bool(bare) and (later or before == (conv, role, text))
                    yield conv, part, seg, pos, turn, role, text, not bare, again, bool(bare) and not again and not bare.endswith(ENDS)
                    before = (conv, role, text)
                    pos += 1

        return _batches(each(), ORDERED)

    ordered = stash(placed.mapInArrow(cut, ORDERED), folder, "ordered")
    narrow = ordered.select("conv_id", "part", "seg", "pos", F.substring("role", 1, 1).alias("initial"), "blank", "duplicate", "truncated")
    narrow = narrow.repartition("conv_id", "part", "seg").sortWithinPartitions("conv_id", "part", "seg", "pos")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for rows in runs_of(batches, ("conv_id", "part", "seg")):
                initials = rows["initial"]
                blank, duplicate, truncated = (np.array(rows[c], bool) for c in ("blank", "duplicate", "truncated"))
                forced = blank | duplicate
                some = "".join(c or " " for c, f in zip(initials, forced, strict=True) if not f)
                cuts = truncated[~forced]
                # from any state to any other costs no more than a repair from the beginning and three turns put in
                bound = incumbent(some, int(cuts.sum()), system=False) + 3 * INSERT
                facts = (initials[0], initials[-1], int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), illegal_pairs(initials))
                for start in range(4):
                    for end, (cost, audit) in paths(some, cuts, start, (NOTHING, SYSTEM, USER, ASSISTANT), bound).items():
                        yield (rows["conv_id"][0], rows["part"][0], rows["seg"][0], start, end, cost + DELETE * int(forced.sum()), with_forced(audit, forced), *facts)

        return _batches(each(), WAYS, 100)

    by_segment = stash(narrow.mapInArrow(ways, WAYS), folder, "ways")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each conversation a row with its totals, then one a segment."""
        for conv, segments in groupby(_records(batches), key=lambda r: r[0]):
            best: dict[int, tuple[int, str, list[tuple[int, str]]]] = {NOTHING: (0, "", [])}
            places, totals, last = [], np.zeros(4, np.int64), None
            for (part, seg), some in groupby(segments, key=lambda r: r[1:3]):
                new: dict[int, tuple[int, str, list[tuple[int, str]]]] = {}
                for _, _, _, start, end, cost, audit, first, end_initial, *facts in some:
                    if start in best:
                        c, a, pieces = best[start]
                        if end not in new or (c + cost, a + audit) < new[end][:2]:
                            new[end] = (c + cost, a + audit, [*pieces, (start, audit)])
                totals += facts
                totals[3] += last is not None and last + first not in ("su", "ua", "au")
                best, last = new, end_initial
                places.append((part, seg))
            cost, audit, pieces = min(best[e] for e in (NOTHING, ASSISTANT) if e in best)
            yield _batch([(conv, None, None, None, audit, *totals.tolist(), cost)], JOINED)
            yield from _batches(((conv, *place, *piece, None, None, None, None, None) for place, piece in zip(places, pieces, strict=True)), JOINED)

    joined = by_segment.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", "start", "end").mapInArrow(join, JOINED)
    joined = stash(joined, folder, "joined")
    return ordered, joined.where("part is not null").select("conv_id", "part", "seg", "start", "audit"), joined.where("part is null").drop("part", "seg", "start")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _written(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    """Turns of each segment in order, after a row with the audit of the segment."""
    head = pieces.select("conv_id", "part", "seg", F.lit(-1).alias("pos"), F.col("start").cast("string").alias("role"), F.col("audit").alias("text"))
    every = head.unionByName(ordered.select("conv_id", "part", "seg", "pos", "role", "text"))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", "pos")


def _each_repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """(conv_id, its repaired turns) from rows of _written(); one segment is held at a time."""

    def turns(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
        for _, segment in groupby(rows, key=lambda r: r[1:3]):
            *_, start, audit = next(segment)
            yield from repaired(audit, ((role, text) for *_, role, text in segment), None if int(start) == NOTHING else NEXT[int(start)])
            for _ in segment:  # turns deleted at the end
                pass

    for conv, rows in groupby(_records(batches), key=lambda r: r[0]):
        yield conv, turns(rows)


def _long_turns(ordered: DataFrame, pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((conv, i, role, text) for conv, turns in _each_repaired(batches) for i, (role, text) in enumerate(turns)), TURNS)

    return _written(ordered, pieces).mapInArrow(run, TURNS)


def _long_reports(ordered: DataFrame, pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Reports of long conversations. The digest reads the repaired turns one by one, as SHA-256 must; nothing is kept of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in _each_repaired(batches):
            h = hashlib.sha256()
            for i, (role, text) in enumerate(turns):
                h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            yield _batch([(conv, h.hexdigest())], "_id long, repaired_sha256 string")

    digests = _written(ordered, pieces).mapInArrow(run, "_id long, repaired_sha256 string")
    known = F.count_distinct("turn")
    gaps = ordered.groupBy(F.col("conv_id").alias("_gap_id")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - known, F.lit(0)).alias("gaps"))
    out = totals.join(digests, totals["conv_id"].eqNullSafe(digests["_id"])).join(gaps, totals["conv_id"].eqNullSafe(gaps["_gap_id"]))
    return out.select("conv_id", *COUNTS, "audit", "repaired_sha256")


# ---------------------------------------------------------------- query


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by a checksum of "conv_id:turn" modulo 20 (nulls: one blank): 0 drops the row (``there`` is
    false), 1 empties its text, 2 takes out its [.!?], 3 repeats it, 4 makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repair_reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


SQL = f"""
with recursive {CRC_TABLE_SQL},
convs as (select conv_id, row_number() over (order by conv_id nulls first) as g from (select distinct conv_id from conversations)),
raw as (select g, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(c.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as f from conversations c join convs on c.conv_id is not distinct from convs.conv_id),
kinds as (select raw.*, {CRC_SQL} % 20 as kind from raw, tab),
rows as (
  select g, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(2) x(copy) where kind <> 0 and (copy = 0 or kind = 3)
),
num as (select *, row_number() over (partition by g order by turn nulls first, role, text) as i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as bare from rows),
flags as (
  select *, bare = '' as blank, bare <> '' and again as duplicate, bare <> '' and not again and right(bare, 1) not in ('.', '!', '?') as truncated, left(role, 1) as initial
  from (select *, row_number() over (partition by g, role, text order by i) > 1 as again from num)
),
ops(p, q, e, o) as (values (0, 0, '', 'D'), (1, 1, '', 'D'), (2, 2, '', 'D'), (3, 3, '', 'D'), (0, 2, 'u', 'E'), (1, 2, 'u', 'E'), (2, 3, 'a', 'E'), (3, 2, 'u', 'E'), (0, 1, 's', 'S')),
ins(q, k, r) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
states as (
  select g, 0::bigint as i, r as p, struct_pack(c := 3 * k, a := repeat('I', k)) as best from convs, ins where q = 0
  union all
  select s.g, n.i, ins.r, min(struct_pack(
      c := best.c + 3 * ins.k + case o when 'D' then 4 when 'S' then 3 * truncated::int else 3 * truncated::int + 3 * (initial <> e)::int end,
      a := best.a || case o when 'D' then 'D' when 'S' then 'K' else case when initial = e then 'K' else 'R' end end || repeat('I', ins.k)))
  from states s join flags n on n.g = s.g and n.i = s.i + 1 join ops on ops.p = s.p join ins on ins.q = ops.q
  where o = 'D' or (not (blank or duplicate) and (o = 'E' or initial = 's')) group by 1, 2, 3
),
ends as (select g, max(i) as n from states group by 1),
done as (select s.g, min(best) as best from states s join ends on ends.g = s.g and s.i = ends.n where p in (0, 3) group by 1),
letters as (
  select g, j, op, sum((op <> 'I')::int) over w as i, sum((op <> 'D')::int) over w as k, sum((op <> 'D')::int) over (partition by g) as size
  from (select g, j, best.a[j] as op from done, range(1, 1 + len(best.a)) x(j)) window w as (partition by g order by j)
),
texts as (
  select l.g, string_agg(case when op = 'K' then role when (k - size % 2) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end, chr(10) order by j) as t
  from letters l left join flags f on f.g = l.g and f.i = l.i where op <> 'D' group by 1
),
pairs as (select g, count(*) as illegal from (select g, initial || lead(initial) over (partition by g order by i) as two from flags) where two is not null and two not in ('su', 'ua', 'au') group by 1),
counts as (select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(duplicate) as duplicate, count_if(truncated) as truncated from flags group by 1)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  best.c::bigint as cost, best.a as audit, sha256(coalesce(t, '')) as repaired_sha256
from convs join done using (g) left join counts using (g) left join pairs using (g) left join texts using (g)
"""
