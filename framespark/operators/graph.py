"""Components of graphs kept as edge tables, by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.functions.common import by_group, stash, whole_groups, work_dir


def _least_around(a: list, b: list) -> tuple[list, list]:
    """The nodes of undirected edges and the least node of each one's component."""
    up = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    return list(up), [root(x) for x in list(up)]


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(keys, node, component): the smallest node reached from each end of the undirected edges, per key.

    The edges of a key are joined in one task if it can hold them, so rows move once. The keys of more edges go by rounds over all tasks: each
    node takes the smallest label around it and then that label's own label (pointer jumping); every round is written to the
    shared folder, so neither plans nor lineages grow. Edges with a null end are left out.
    """
    k = list(keys)
    e = edges.select(*k, F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    small, large = whole_groups(stash(e, f"{work_dir(edges.sparkSession)}/given"), k)
    if not k:
        return _components_by_rounds(large, k, rounds)
    kind = e.schema["a"].dataType.simpleString()
    found = by_group(small, k, _least_around, f"node {kind}, component {kind}")
    return found if large is None else found.union(_components_by_rounds(large, k, rounds))


def _components_by_rounds(e: DataFrame, k: list[str], rounds: int) -> DataFrame:
    folder = work_dir(e.sparkSession)
    e = stash(e.union(e.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
    lab = stash(e.groupBy(*k, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{folder}/0")
    for i in range(1, rounds + 1):
        near = e.join(lab.withColumnRenamed("node", "b"), [*k, "b"]).groupBy(*k, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = lab.join(near, [*k, "node"]).select(*k, "node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = lab.select(*k, F.col("node").alias("component"), F.col("component").alias("up"))
        new = stash(hop.join(up, [*k, "component"], "left").select(*k, "node", F.least("component", "up").alias("component"), "was"), f"{folder}/{i}")
        lab = new.drop("was")
        if new.where("component <> was").isEmpty():
            return lab
    raise RuntimeError(f"components still change after {rounds} rounds")


#: Edges times starts of a key that one task may walk through.
GROUP_WALKS = 1 << 20


def _reached(src: list, dst: list) -> tuple[list, list]:
    """Pairs of a start and a node it reaches; a start is a row without a source."""
    ahead, starts = {}, {}
    for x, y in zip(src, dst, strict=True):
        if x is None:
            starts[y] = None
        else:
            ahead.setdefault(x, {})[y] = None
    found = ([], [])
    for start in starts:
        seen = dict(ahead.get(start, ()))
        todo = list(seen)
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen[y] = None
                    todo.append(y)
        found[0].extend([start] * len(seen))
        found[1].extend(seen)
    return found


def reach(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = (), src: str = "src", dst: str = "dst") -> DataFrame:
    """(keys, start, node): nodes reached from each start along directed edges, the start itself only through a cycle or as given.

    Keys of few edges and starts are walked through in one task each, so rows move once. The others go breadth first: every round joins the newest
    nodes with the edges and keeps what is new, until nothing is, however deep the graph. Rounds are written to the shared folder
    and merged now and then, so that plans stay small. Edges with a null end are left out.
    """
    k = list(keys)
    e = edges.select(*k, F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null")
    begin = starts.select(*k, F.col("start")).where("start is not null")
    if not k:
        return _reach_by_rounds(e, begin, k)
    kind = e.schema["_d"].dataType.simpleString()
    both = stash(e.unionByName(begin.select(*k, F.lit(None).cast(kind).alias("_s"), F.col("start").cast(kind).alias("_d"))), f"{work_dir(edges.sparkSession)}/given")
    small, large = whole_groups(both, k, (F.count("_s") + 1) * (F.count_if(F.col("_s").isNull()) + 1), GROUP_WALKS)
    found = by_group(small, k, _reached, f"start {begin.schema['start'].dataType.simpleString()}, node {kind}")
    if large is None:
        return found
    return found.union(_reach_by_rounds(large.where("_s is not null"), large.where("_s is null").select(*k, F.col("_d").alias("start")), k))


def _reach_by_rounds(edges: DataFrame, starts: DataFrame, k: list[str]) -> DataFrame:
    folder = work_dir(edges.sparkSession)
    e = stash(edges.distinct(), f"{folder}/edges")
    front = starts.select(*k, F.col("start"), F.col("start").alias("node")).distinct()
    parts: list[DataFrame] = []
    i = 0
    while True:
        step = front.join(e, [*[front[c] == e[c] for c in k], front["node"] == e["_s"]]).select(*[front[c] for c in k], "start", F.col("_d").alias("node")).distinct()
        for seen in parts:
            step = step.join(seen, [*k, "start", "node"], "left_anti")
        front = stash(step, f"{folder}/new-{i}")
        if front.isEmpty():
            return reduce(DataFrame.union, parts) if parts else front
        parts.append(front)
        if len(parts) == 8:
            parts = [stash(reduce(DataFrame.union, parts), f"{folder}/seen-{i}")]
        i += 1


def _chains(e: DataFrame, k: list[str], folder: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Of edges (a, b): nodes with one edge in and one out as (node, entry, exit), the ends of their chain; those on closed rings as (node, component); edges over the chains. None without such nodes.

    Pointers along the chains double every round; on rings they never leave, and carry the least node along.
    """
    out = e.groupBy(*k, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("next")).where("n = 1").drop("n")
    into = e.groupBy(*k, F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("prev")).where("n = 1").drop("n")
    chain = stash(out.join(into, [*k, "node"]), f"{folder}/chain")
    if chain.isEmpty():
        return None
    p = chain.select(*k, "node", F.col("next").alias("to"), F.col("node").alias("last"), F.col("node").alias("low"))
    before = -1
    i = 0
    while True:
        far = p.select(*k, F.col("node").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        moved = F.col("to2").isNotNull()
        low = F.least("low", F.coalesce("low2", "low"))
        p = p.join(far, [*k, "to"], "left").select(*k, "node", F.coalesce("to2", "to").alias("to"), F.coalesce("last2", "last").alias("last"), low.alias("low"), moved.alias("on"), (low < F.col("low")).alias("less"))
        p = stash(p, f"{folder}/jump-{i}")
        on, less = p.agg(F.count_if("on"), F.count_if(F.col("on") & F.col("less"))).head()
        # while some chain ends ahead, fewer nodes move in every round
        if not on or (on == before and not less):
            break
        before = on
        i += 1
    ring = p.where("on").select(*k, "node", F.col("low").alias("component"))
    first = chain.join(chain.select(*k, F.col("node").alias("prev")), [*k, "prev"], "left_anti").select(*k, "node", F.col("prev").alias("entry"))
    ends = p.where("not on").select(*k, "node", "last", F.col("to").alias("exit"))
    entry = first.join(ends, [*k, "node"]).select(*k, "last", "entry")
    links = stash(ends.join(entry, [*k, "last"]).select(*k, "node", "entry", "exit"), f"{folder}/links")
    over = links.select(*k, F.col("entry").alias("a"), F.col("exit").alias("b")).where("a <> b").distinct()
    return links, ring, over


def _strong_around(a: list, b: list) -> tuple[list, list, list]:
    """The nodes of directed edges, the least node of each one's strong component and its size (Tarjan)."""
    ahead = {}
    for x, y in zip(a, b, strict=True):
        ahead.setdefault(x, []).append(y)
        ahead.setdefault(y, [])
    low, open_, least, size = {}, [], {}, {}
    for first in ahead:
        if first in low:
            continue
        low[first] = len(low)
        open_.append(first)
        path = [(first, low[first], iter(ahead[first]))]
        while path:
            x, number, more = path[-1]
            for y in more:
                if y not in low:
                    low[y] = len(low)
                    open_.append(y)
                    path.append((y, low[y], iter(ahead[y])))
                    break
                if y not in least and low[y] < low[x]:
                    low[x] = low[y]
            else:
                path.pop()
                if path and low[x] < low[path[-1][0]]:
                    low[path[-1][0]] = low[x]
                if low[x] == number:
                    members = [open_.pop()]
                    while members[-1] != x:
                        members.append(open_.pop())
                    name = min(members)
                    least.update(dict.fromkeys(members, name))
                    size[name] = len(members)
    return list(least), list(least.values()), [size[x] for x in least.values()]


def strong_components(edges: DataFrame, keys: tuple[str, ...] = (), src: str = "src", dst: str = "dst") -> DataFrame:
    """(keys, node, component, size): strongly connected components of directed edges, named by their smallest node.

    The edges of a key are walked through in one task if it can hold them; keys of more go by rounds over all tasks. Edges with a null end are left out.
    """
    k = list(keys)
    folder = work_dir(edges.sparkSession)
    e = stash(edges.select(*k, F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), f"{folder}/given")
    small, large = whole_groups(e, k)
    if not k:
        return _strong_by_rounds(large, k)
    kind = e.schema["a"].dataType.simpleString()
    found = by_group(small, k, _strong_around, f"node {kind}, component {kind}, size long")
    return stash(found if large is None else found.union(_strong_by_rounds(large, k)), f"{folder}/strong")


def _strong_by_rounds(edges: DataFrame, k: list[str]) -> DataFrame:
    """Strong components by rounds.

    Nodes without an edge in or out are trimmed, and chains of nodes with one edge in and one out become one edge, by pointers
    that double, so long paths and rings take a number of rounds that grows with the logarithm of their length. What is left
    is coloured: labels flow forward to a fixed point (least node that reaches a node), then back along edges of one colour from each
    colour's root; what the root is reached from is its component and leaves the graph. Every loop runs until nothing
    changes. At last the nodes of a chain join the component of its ends if both ends are in one.
    """
    folder = work_dir(edges.sparkSession)
    every = edges.select(*k, F.col("a").alias("node")).union(edges.select(*k, F.col("b").alias("node"))).distinct()
    e = stash(edges.where("a <> b").distinct(), f"{folder}/edges")
    n = e.count()
    levels: list[DataFrame] = []
    found: list[DataFrame] = []
    i = 0
    both = lambda e: e.select(*k, F.col("a").alias("node")).intersect(e.select(*k, F.col("b").alias("node")))
    inside = lambda e, nodes, how: e.join(nodes.withColumnRenamed("node", "a"), [*k, "a"], how).join(nodes.withColumnRenamed("node", "b"), [*k, "b"], how).select(*k, "a", "b")
    while n:
        here = f"{folder}/{i}"
        i += 1
        chains = _chains(e, k, here)
        if chains is not None:
            links, ring, over = chains
            levels.append(links)
            found.append(ring)
            gone = links.select(*k, "node").union(ring.select(*k, "node"))
            e = inside(e, gone, "left_anti").union(over).distinct()
        e = stash(inside(e, both(e), "left_semi"), f"{here}/trimmed")
        left = e.count()
        if chains is not None or left < n:
            n = left
            continue
        members = _coloured(e, k, here)
        found.append(members)
        e = stash(inside(e, members.select(*k, "node"), "left_anti"), f"{here}/rest")
        n = e.count()
    if not found:
        return every.select(*k, "node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    comp = reduce(DataFrame.union, found)
    for j, links in reversed(list(enumerate(levels))):
        comp = stash(comp, f"{folder}/comp-{j}")
        end = lambda name: comp.select(*k, F.col("node").alias(name), F.col("component").alias(f"c_{name}"))  # noqa: B023, E731
        at = links.join(end("entry"), [*k, "entry"], "left").join(end("exit"), [*k, "exit"], "left")
        at = at.select(*k, "node", F.coalesce("c_entry", "entry").alias("component"), F.coalesce("c_exit", "exit").alias("other"))
        # an end that is the whole component of its own joins what it closes a ring with
        closed = at.where("component = other").drop("other")
        ends = closed.select(*k, F.col("component").alias("node"), "component").distinct().join(comp, [*k, "node"], "left_anti")
        comp = comp.union(closed).union(ends)
    comp = stash(comp, f"{folder}/comp")
    names = comp.groupBy(*k, "component").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("size"))
    named = comp.join(names, [*k, "component"]).select(*k, "node", F.col("name").alias("component"), "size")
    return every.join(named, [*k, "node"], "left").select(*k, "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))


def _coloured(e: DataFrame, k: list[str], folder: str) -> DataFrame:
    """(keys, node, component) of at least one component a key: nodes that reach the least node which reaches them."""
    lab = stash(e.select(*k, F.col("a").alias("node"), F.col("a").alias("color")).distinct(), f"{folder}/color")
    j = 0
    while True:
        inc = e.join(lab.withColumnRenamed("node", "a"), [*k, "a"]).groupBy(*k, F.col("b").alias("node")).agg(F.min("color").alias("in"))
        new = stash(lab.join(inc, [*k, "node"], "left").select(*k, "node", F.least("color", "in").alias("color"), F.col("color").alias("was")), f"{folder}/color-{j}")
        lab = new.drop("was")
        j += 1
        if new.where("color <> was").isEmpty():
            break
    c = lab.withColumnRenamed("node", "x")
    inner = e.join(c.withColumnRenamed("x", "a"), [*k, "a"]).withColumnRenamed("color", "ca").join(c.withColumnRenamed("x", "b"), [*k, "b"]).where("ca = color")
    inner = stash(inner.select(*k, F.col("b").alias("src"), F.col("a").alias("dst"), "color"), f"{folder}/inner")
    root = lab.where("node = color")
    back = reach(inner, root.withColumnRenamed("node", "start").select(*k, "color", "start"), (*k, "color"))
    members = back.select(*k, "node", F.col("color").alias("component")).union(root.select(*k, "node", "color")).distinct()
    return stash(members, f"{folder}/members")
