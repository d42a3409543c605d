"""Exact substring dedup by sorting suffixes: bytes covered by a 50-byte string of an earlier document are removed.

A sparse set of suffixes carries the work. In every 50-byte window the least 26-byte hash marks an anchor, so two equal
windows share their anchor and its place; consecutive windows with one anchor form a segment. Anchors that stand in a
single document can't take part in a repeat and are dropped after a count over hash buckets. The segments of the others
meet in buckets, where the suffixes that begin at their windows are sorted to a depth of 50 bytes by deep-shallow
sorting: multikey quicksort over eight-byte words down to a shallow depth, then blind tries for what still agrees, which
skip what all suffixes below a node share and look only at the byte where they branch. Suffixes equal to the full
depth are one string; it is removed from every document but the one with the smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.llm.common import _R, _RI, mix, powers, ragged, slices, stash, text_bytes, work_dir

LENGTH = 50
#: Longer grams stand in several documents by chance less often as the corpus grows, but mark more anchors.
GRAM = 26
#: Words of eight bytes that the multikey quicksort goes by; beyond them groups go to blind tries.
SHALLOW_WORDS = 2
#: Hash buckets for each shuffle partition, so that hashing deals them evenly.
BUCKETS_EACH = 4
SLICE = 2 << 20
#: Windows whose anchors are sought at once.
CHUNK = 1 << 24
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5AFE))
_MASK32 = np.uint64((1 << 32) - 1)
#: Segments overlap, and their bytes are most of what is moved.
_PACKED = "zstd"
_PLACE = np.uint64(28)


def _anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of at most CHUNK + LENGTH - 1 bytes, whose places fit in 28 bits."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers(_R, n))))
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(_RI, n)[: n - GRAM + 1])
    # order by 36 bits of the hash, then by place: of equal ones the leftmost
    least = (gram >> _PLACE << _PLACE) | np.arange(len(gram), dtype=np.uint64)
    wide, span = LENGTH - GRAM + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    counts = np.maximum(off[1:] - off[:-1] - LENGTH + 1, 0)
    window = ragged(off[:-1], counts)
    place = (least[window] & np.uint64((1 << 28) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    last = window[np.append(a[1:], len(window)) - 1] if len(a) else none
    return doc[a], window[a], last, gram[place[a]]


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, hash) of the segments of a slice; windows never cross documents.

    A slice longer than CHUNK (one long document) is cut by the windows' starts; that only cuts segments in two.
    """
    parts = []
    for low in range(0, max(len(data) - LENGTH + 1, 1), CHUNK):
        high = min(low + CHUNK + LENGTH - 1, len(data))
        doc, first, last, h = _anchors(data[low:high], np.clip(off, low, high) - low)
        parts.append((doc, first + low, last + low, h))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _packs(parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bounds) of the runs of equal buckets in a sorted array."""
    at = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if n else np.zeros(0, np.int64)
    return parts[at], np.append(at, n)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _short(h: np.ndarray) -> np.ndarray:
    """The low four bytes of each hash. Buckets go by the whole hash, so what meets within one rarely agrees in them by chance, and such a hash only lets an anchor through."""
    return h.astype(np.uint32)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors have small hashes, being the least of their windows, so buckets go by a hash of the hash."""
    return ((mix(h) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _grams(buckets: int):
    """Anchor hashes by bucket. A hash that several documents of a slice share is known to repeat: it goes out once for
    the other slices to see, and its documents get their mark at once, so a passage in every document is no hot spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            data, off = text_bytes(b.column("text"))
            ids = b.column("id").to_numpy()
            doc, _, _, h = anchors(data, off)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new_h = np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new = new_h.copy()
            new[1:] |= doc[1:] != doc[:-1]
            doc, h, new_h = doc[new], h[new], new_h[new]
            at = np.append(np.flatnonzero(new_h), len(h))
            shared = np.repeat(np.diff(at) > 1, np.diff(at))
            for marked, some in ((False, new_h), (True, shared)):
                d, g = ids[doc[some]], h[some]
                part = _bucket(g, buckets)
                o = np.lexsort((d, part))
                d, g, part = d[o], g[o], part[o]
                which, bound = _packs(part, len(g))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(which, pa.int32()),
                        pa.array([marked] * len(which), pa.bool_()),
                        pa.array([_bytes(np.diff(d[x:y], prepend=0)) for x, y in zip(bound[:-1], bound[1:], strict=True)], pa.binary()),
                        pa.array([_bytes(_short(g[x:y])) for x, y in zip(bound[:-1], bound[1:], strict=True)], pa.binary()),
                    ],
                    names=["bucket", "marked", "ids", "hashes"],
                )

    return run


def _runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The rows of each run of equal keys, as lists of columns; rows come sorted by the key."""
    now, rows = None, None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        for i in range(b.num_rows):
            if rows is None or cols[key][i] != now:
                if rows is not None:
                    yield rows
                now, rows = cols[key][i], {c: [] for c in cols}
            for c, v in cols.items():
                rows[c].append(v[i])
    if rows is not None:
        yield rows


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hashes) of the anchor hashes that stand in more than one document."""
    for rows in _runs_of(batches, "bucket"):
        ids = [np.cumsum(np.frombuffer(x, np.int64)) for x in rows["ids"]]
        marks = np.repeat(np.array(rows["marked"]), [len(x) for x in ids])
        d, h = np.concatenate(ids), np.concatenate([_longs(x) for x in rows["hashes"]])
        o = np.lexsort((d, h))
        d, h, marks = d[o], h[o], marks[o]
        at = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        several = np.repeat(d[at[:-1]] != d[at[1:] - 1], np.diff(at))
        d, h = d[several | marks], h[several | marks]
        o = np.lexsort((h, d))
        d, h = d[o], h[o]
        at = np.append(np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))), len(d)) if len(d) else np.zeros(1, np.int64)
        # four bytes of each hash
        raw = pa.py_buffer(_bytes(_short(h)))
        packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), raw])
        yield pa.RecordBatch.from_arrays([pa.array(d[at[:-1]] if len(d) else d, pa.int64()), packed], names=["id", "hashes"])


def _segments(buckets: int):
    """The segments of repeating anchors by bucket, equal ones of a slice once, with their documents and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            data, off = text_bytes(b.column("text"))
            ids = b.column("id").to_numpy()
            doc, first, last, h = anchors(data, off)
            want = [[_longs(x) for x in v] for v in b.column("hashes").to_pylist()]
            size = [sum(map(len, v)) for v in want]
            owner = np.repeat(np.arange(len(want)), size).astype(np.uint64)
            flat = np.concatenate([x for v in want for x in v] or [np.zeros(0, np.uint64)])
            wanted = np.sort(mix(flat ^ mix(owner)))
            have = mix((h & _MASK32) ^ mix(doc.astype(np.uint64)))
            at = np.minimum(np.searchsorted(wanted, have), max(len(wanted) - 1, 0))
            hit = wanted[at] == have if len(wanted) else np.zeros(len(have), bool)
            doc, first, last, h = doc[hit], first[hit], last[hit], h[hit]
            if not len(doc):
                continue
            n = len(data)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers(_R, n))))
            end = last + LENGTH
            body = mix((sums[end] - sums[first]) * powers(_RI, n)[first] + (end - first).astype(np.uint64))
            part = _bucket(h, buckets)
            o = np.lexsort((ids[doc], body, h, part))
            doc, first, end, h, body, part = doc[o], first[o], end[o], h[o], body[o], part[o]
            new = np.ones(len(doc), bool)
            new[1:] = (body[1:] != body[:-1]) | (h[1:] != h[:-1])
            seg = np.flatnonzero(new)
            which, bound = _packs(part[seg], len(seg))
            occ = np.append(seg, len(doc))
            out: dict[str, list] = {"size": [], "bytes": [], "times": [], "ids": [], "starts": []}
            for x, y in zip(bound[:-1], bound[1:], strict=True):
                s = seg[x:y]
                length = end[s] - first[s]
                a, z = occ[x], occ[y]
                out["size"].append(_bytes(length.astype(np.uint16)))
                out["bytes"].append(pa.compress(_bytes(data[ragged(first[s], length)]), _PACKED, asbytes=True))
                out["times"].append(_bytes(np.diff(occ[x : y + 1]).astype(np.uint32)))
                out["ids"].append(_bytes(ids[doc[a:z]]))
                out["starts"].append(_bytes((first[a:z] - off[doc[a:z]]).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.array(v, pa.binary()) for v in out.values())], names=["bucket", *out])

    return run


def _multikey(word: np.ndarray, start: np.ndarray, order: np.ndarray, head: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Multikey quicksort of ``order`` by the words at ``offsets``; sets ``head`` where suffixes differ. Returns the
    (begin, size) rows of the groups that agree in all of them.

    All parts of one round are partitioned at once round the median of three of their words: smaller and greater ones
    stay at their word, equal ones go on to the next.
    """
    deep = []
    begin, size, level = np.zeros(1, np.int64), np.array([len(order)]), np.zeros(1, np.int64)
    offs = np.array(offsets)
    key = word[start[order] + offsets[0]]
    while len(begin):
        first = np.cumsum(size) - size
        a, m, z = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, m), np.minimum(np.maximum(a, m), z)), size)
        side = (key > pivot).view(np.int8) + (key >= pivot).view(np.int8)
        at = ragged(begin, size)
        old = order[at]
        part = np.repeat(np.arange(len(begin)) * 3, size) + side
        count = np.bincount(part, minlength=3 * len(begin))
        base = np.cumsum(count) - count
        moved, keys = np.empty_like(old), np.empty_like(key)
        for s in range(3):
            to, by = ragged(base[s::3], count[s::3]), np.flatnonzero(side == s)
            moved[to], keys[to] = old[by], key[by]
        order[at] = moved
        # the parts of the next round
        begin = np.repeat(begin - first, 3) + base
        level = np.repeat(level, 3)
        level[1::3] += 1
        some = count > 0
        head[begin[some]] = True
        done = (count > 1) & (level == len(offsets))
        deep.append(np.stack((begin[done], count[done]), axis=1))
        live = (count > 1) & (level < len(offsets))
        keep = ragged(base[live], count[live])
        key, moved = keys[keep], moved[keep]
        onward = np.flatnonzero(np.repeat((np.arange(3 * len(size)) % 3 == 1)[live], count[live]))
        begin, size, level = begin[live], count[live], level[live]
        key[onward] = word[start[moved[onward]] + np.repeat(offs[level], size)[onward]]
    return np.concatenate(deep)


def _blind_tries(word: np.ndarray, start: np.ndarray, order: np.ndarray, head: np.ndarray, groups: np.ndarray, offsets: list[int]) -> None:
    """Order the suffixes of each group by a blind trie over the words at ``offsets``; sets ``head`` where they differ.

    A node knows only the byte at which its suffixes first branch; what they share before it is skipped, not compared.
    Its children are the values of that byte, in order. Nodes are opened level by level, those of all tries at once; a
    node of one suffix, or one without a branch up to the depth, is a leaf.
    """
    if not len(groups) or not offsets:
        return
    offs = np.array(offsets)
    groups = groups[np.argsort(groups[:, 0])]
    size, level = groups[:, 1], np.zeros(len(groups), np.int64)
    at = ragged(groups[:, 0], size)
    key = word[start[order[at]] + offsets[0]]
    while len(size):
        first = np.cumsum(size) - size
        branch = np.bitwise_or.reduceat(key ^ np.repeat(key[first], size), first)
        shift = np.zeros(len(size), np.uint64)
        for s in (32, 16, 8):
            shift += np.where(branch >> (shift + np.uint64(s)) > 0, np.uint64(s), np.uint64(0))
        forks = np.repeat(branch > 0, size)
        new = np.zeros(len(at), bool)
        new[first] = True
        b = np.flatnonzero(forks)
        if len(b):
            node = np.repeat(np.arange(len(size)), size)[b]
            child = (node << 8) | ((key[b] >> np.repeat(shift, size)[b]) & np.uint64(255)).astype(np.int64)
            by = np.argsort(child, kind="stable")
            order[at[b]] = order[at[b[by]]]
            key[b] = key[b[by]]
            child = child[by]
            fork = b[1:][child[1:] != child[:-1]]
            new[fork] = True
            head[at[fork]] = True
        level = np.repeat(level + (branch == 0), size)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        level = level[begin]
        live = (size > 1) & (level < len(offsets))
        keep = ragged(begin[live], size[live])
        at, key, onward = at[keep], key[keep], np.flatnonzero(~forks[keep])
        size, level = size[live], level[live]
        key[onward] = word[start[order[at[onward]]] + np.repeat(offs[level], size)[onward]]


def sort_suffixes(buf: np.ndarray, start: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): the suffixes sorted by their first ``depth`` bytes, and the class of equal ones, in that order.

    Deep-shallow sorting: multikey quicksort by the first SHALLOW_WORDS words of eight bytes, then blind tries for the
    groups that still agree. The last word overlaps the one before so as to end at the depth.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    word = np.zeros(len(buf) + 1, np.uint64)
    for i in range(8):
        word |= padded[i : i + len(word)].astype(np.uint64) << np.uint64(56 - 8 * i)
    offsets = [min(x, depth - 8) for x in range(0, depth, 8)]
    order = np.arange(n)
    head = np.zeros(n, bool)
    head[0] = True
    deep = _multikey(word, start, order, head, offsets[:SHALLOW_WORDS])
    _blind_tries(word, start, order, head, deep, offsets[SHALLOW_WORDS:])
    return order, np.cumsum(head) - 1


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, starts, ends): byte ranges to remove, found by sorting the suffixes of each bucket's segments."""
    for rows in _runs_of(batches, "bucket"):
        sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in rows["size"]]
        size = np.concatenate(sizes)
        buf = np.frombuffer(b"".join(pa.decompress(x, int(n.sum()), _PACKED, asbytes=True) for x, n in zip(rows["bytes"], sizes, strict=True)), np.uint8)
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["times"]]).astype(np.int64)
        ids = np.frombuffer(b"".join(rows["ids"]), np.int64)
        starts = np.frombuffer(b"".join(rows["starts"]), np.uint32).astype(np.int64)
        base = np.cumsum(size) - size
        # equal segments of different slices are one; what is left differs somewhere
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * powers(_R, len(buf)))))
        body = mix((sums[base + size] - sums[base]) * powers(_RI, len(buf))[base] + size.astype(np.uint64))
        _, one, alike = np.unique(body, return_index=True, return_inverse=True)
        seg = np.repeat(alike, times)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, seg, ids)
        windows = size[one] - LENGTH + 1
        at = ragged(base[one], windows)
        of = np.repeat(np.arange(len(one)), windows)
        order, group = sort_suffixes(buf, at)
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        owner = np.empty(len(at), np.int64)
        owner[order] = np.minimum.reduceat(least[of[order]], heads)[group]
        # a document after the segment's first loses all of it; the first loses what an earlier document has elsewhere
        later = ids > least[seg]
        begin, end, who = [starts[later]], [starts[later] + size[one][seg[later]]], [ids[later]]
        gone = owner < least[of]
        if gone.any():
            edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
            border = np.flatnonzero((of[1:] != of[:-1]) & gone[1:] & gone[:-1]) + 1
            a = np.sort(np.concatenate((np.flatnonzero(edge == 1), border)))
            z = np.sort(np.concatenate((np.flatnonzero(edge == -1), border)))
            first_window = np.cumsum(windows) - windows
            # each run of windows goes to every occurrence in the segment's first document
            firsts = np.flatnonzero(~later)
            firsts = firsts[np.argsort(seg[firsts], kind="stable")]
            many = np.bincount(seg[firsts], minlength=len(one))
            where = np.cumsum(many) - many
            run_seg = of[a]
            pick = firsts[ragged(where[run_seg], many[run_seg])]
            run = np.repeat(np.arange(len(a)), many[run_seg])
            begin.append(starts[pick] + a[run] - first_window[run_seg[run]])
            end.append(starts[pick] + z[run] - first_window[run_seg[run]] + LENGTH - 1)
            who.append(ids[pick])
        begin, end, who = np.concatenate(begin), np.concatenate(end), np.concatenate(who)
        o = np.lexsort((begin, who))
        begin, end, who = begin[o], end[o], who[o]
        docs = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
        cuts = pa.array(np.append(docs, len(who)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(who[docs]), pa.ListArray.from_arrays(cuts, pa.array(begin.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(end.astype(np.int32)))], names=["id", "starts", "ends"]
        )


def removal_ranges(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, starts, ends) of docs (id, text), copies (id) left out; ranges of one document may overlap and come in rows."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = parts * BUCKETS_EACH
    own = docs.join(copies, "id", "left_anti")
    packs = own.mapInArrow(_grams(buckets), "bucket int, marked boolean, ids binary, hashes binary")
    marks = packs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeating, "id long, hashes binary")
    marks = marks.groupBy("id").agg(F.collect_list("hashes").alias("hashes"))
    found = docs.join(marks, "id").mapInArrow(_segments(buckets), "bucket int, size binary, bytes binary, times binary, ids binary, starts binary")
    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_removed, "id long, starts array<int>, ends array<int>")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, limit=SLICE):
        data, off = text_bytes(b.column("text"))
        n = len(off) - 1
        cover = np.zeros(len(data) + 1, np.int64)
        for name, by in (("starts", 1), ("ends", -1)):
            col = b.column(name)
            lists = col.to_pylist()
            owner = np.repeat(np.arange(n), [sum(map(len, v)) if v else 0 for v in lists])
            flat = np.array([x for v in lists if v for part in v for x in part], np.int64)
            np.add.at(cover, off[owner] + flat, by)
        gone = np.cumsum(cover[:-1]) > 0
        size = np.diff(off)
        for i in np.flatnonzero(b.column("copy").to_numpy(zero_copy_only=False) & (size >= LENGTH)).tolist():
            gone[off[i] : off[i + 1]] = True
        lost = np.concatenate(([0], np.cumsum(gone)))
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        cuts = off[:-1][size > 0]
        starts[cuts] = gone[cuts]
        spans = np.concatenate(([0], np.cumsum(starts)))
        kept = data[~gone]
        where = off - lost[off]
        texts = [kept[a:z].tobytes() for a, z in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
        rest = [c for c in b.schema.names if c not in ("text", "starts", "ends", "copy")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in rest), pa.array(size, pa.int64()), pa.array(lost[off[1:]] - lost[off[:-1]], pa.int64()), pa.array(spans[off[1:]] - spans[off[:-1]], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
            names=[*rest, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): each row of docs with the bytes that stay.

    Null texts count as empty; texts under 50 bytes are never cut; rows without a doc_id are neither compared nor cut;
    rows that repeat a doc_id and its text count as one document, and those of a doc_id with several different texts
    name no document and are left whole. Other columns are ignored. Kept bytes may cut a character in two, so they are
    binary.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    all_rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sums = stash(all_rows.where("id is not null").select("id", F.unhex(F.md5("text")).alias("h")), folder, "sums")
    # a whole text that an earlier document has needs no search
    first = sums.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    odd = sums.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id", F.lit(False).alias("copy"))
    copies = sums.join(first, "h").where("id > first").select("id", F.lit(True).alias("copy")).distinct()
    left_out = stash(copies.join(odd, "id", "left_anti").union(odd), folder, "left-out")
    # one and the same set of rows meets the marks and the ranges, so its exchange is reused
    named = all_rows.where("id is not null")
    ranges = removal_ranges(named, left_out.select("id"))
    ranges = ranges.groupBy("id").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    marked = left_out.groupBy("id").agg(F.max("copy").alias("copy"))
    j = named.join(ranges, "id", "left").join(marked, "id", "left").select("id", "text", "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy"))
    none = F.lit(None).cast("array<array<int>>")
    j = j.union(all_rows.where("id is null").select("id", "text", none, none, F.lit(False))).withColumnRenamed("id", "doc_id")
    return j.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
