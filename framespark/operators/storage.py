"""Storage found in netlists by topology: latches and flip-flops, features of their cores, and truth tables of outputs."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions.common import by_group, stash, whole_groups, work_dir
from framespark.operators.frames import natural_sort
from framespark.operators.graph import GROUP_WALKS
from framespark.operators.netlist import GROUND, POWER, bistable_cores, logic_cone

MAX_INPUTS = 12


def _core_nets(cores: DataFrame) -> DataFrame:
    """(design, net, ca, cb) of cores(design, a, b), a row for each of the two nets."""
    return cores.select("design", F.explode(F.array("a", "b")).alias("net"), F.col("a").alias("ca"), F.col("b").alias("cb"))


def _both_ways(inverters: DataFrame) -> DataFrame:
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    # no union, which would lose that rows lie by design
    return inverters.select("design", F.explode(F.array(way("gate", "out"), way("out", "gate"))).alias("w")).select("design", "w.*").distinct()


def topological_latches(inverters: DataFrame, switches: DataFrame) -> DataFrame:
    """(design, a, b, enable, level, data, complements): cores of two mutual inverters with switches at them.

    inverters(design, gate, out), switches(design, a, b, n_gates, p_gates) as of cmos_inverters and controlled_switches.
    Switches vote for the gate and level that opens them, if there is one; the gate with the most switches to nets
    outside all cores wins, then to nets outside its own core, to other cores, in all, and across the core, then n-gates
    and names. Without a switch that leaves the core there is no latch. Data are the far nets of the winner's switches,
    those outside all cores before the others; complements are its switches' opposite gates that an inverter joins to it. Lists
    are in natural order.
    """
    cores = bistable_cores(inverters)
    signal = lambda c: F.filter(c, lambda g: ~g.rlike(POWER) & ~g.rlike(GROUND))
    s = switches.select("design", F.col("a").alias("sa"), F.col("b").alias("sb"), signal("n_gates").alias("n"), signal("p_gates").alias("p"))
    by_n = F.size("n") == 1
    s = s.where(by_n | ((F.size("n") == 0) & (F.size("p") == 1)))
    s = s.select("design", "sa", "sb", F.when(by_n, F.get("n", F.lit(0))).otherwise(F.get("p", F.lit(0))).alias("enable"), F.when(by_n, "high").otherwise("low").alias("level"), F.when(by_n, F.col("p")).otherwise(F.col("n")).alias("other"))
    inverse = _both_ways(inverters)
    comp = s.select("design", "sa", "sb", F.col("enable").alias("u"), F.explode("other").alias("v")).join(inverse, ["design", "u", "v"], "left_semi")
    comp = comp.groupBy("design", "sa", "sb").agg(F.collect_set("v").alias("complements"))
    s = s.drop("other").join(comp, ["design", "sa", "sb"], "left")
    # a switch meets a core at one of its nets or at both
    ends = s.select("*", F.explode(F.array("sa", "sb")).alias("net")).join(_core_nets(cores), ["design", "net"])
    met = ends.groupBy("design", "ca", "cb", "sa", "sb", "enable", "level", "complements").agg(F.count(F.lit(1)).alias("touch"))
    met = met.withColumn("far", F.when(F.col("touch") == 1, F.when(F.col("sa").isin(F.col("ca"), F.col("cb")), F.col("sb")).otherwise(F.col("sa"))))
    inside = _core_nets(cores).select("design", F.col("net").alias("far"), F.lit(True).alias("_in")).distinct()
    met = met.join(inside, ["design", "far"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    leaves, free = F.col("far").isNotNull(), F.col("far").isNotNull() & ~F.col("_in")
    votes = met.groupBy("design", "ca", "cb", "enable", "level").agg(
        F.count_if(free).alias("_free"), F.count_if(leaves).alias("_leaves"), F.count_if(leaves & F.col("_in")).alias("_stage"), F.count(F.lit(1)).alias("_all"), F.count_if(F.col("touch") == 2).alias("_across"),
        F.collect_set(F.when(free, F.col("far"))).alias("_data"), F.collect_set(F.when(leaves & F.col("_in"), F.col("far"))).alias("_from"), natural_sort(F.array_distinct(F.flatten(F.collect_list("complements")))).alias("complements"),
    )
    order = [F.desc(c) for c in ("_free", "_leaves", "_stage", "_all", "_across")] + [F.col("level") == "low", F.col("enable"), F.col("level")]
    best = votes.withColumn("_r", F.row_number().over(Window.partitionBy("design", "ca", "cb").orderBy(*order))).where("_r = 1 and _leaves > 0")
    data = natural_sort(F.when(F.size("_data") > 0, F.col("_data")).otherwise(F.col("_from")))
    return best.select("design", F.col("ca").alias("a"), F.col("cb").alias("b"), "enable", "level", data.alias("data"), "complements")


def latch_pairs(latches: DataFrame, inverters: DataFrame, outputs: DataFrame) -> DataFrame:
    """(design, master, slave, score, drives): latches of opposite phase where one feeds the other; a latch is named by its net a.

    Opposite phase: one enable at two levels, or two enables that an inverter joins at one level. The score is 3 where a
    net of the master's core is data of the slave, 2 where an inverter lies between. If both feed each other alike, the one
    that drives outputs(design, net) is the slave; if that doesn't tell them apart, there is no pair.
    """
    inverse = _both_ways(inverters)
    out = latches.select("design", F.col("a").alias("m"), F.explode(F.array("a", "b")).alias("net"))
    into = latches.select("design", F.col("a").alias("s"), F.explode("data").alias("net"))
    direct = out.join(into, ["design", "net"]).select("design", "m", "s", F.lit(3).alias("score"))
    over = out.join(inverse.withColumnRenamed("u", "net"), ["design", "net"]).select("design", "m", F.col("v").alias("net")).join(into, ["design", "net"]).select("design", "m", "s", F.lit(2).alias("score"))
    feeds = direct.union(over).where("m <> s").groupBy("design", "m", "s").agg(F.max("score").alias("score"))
    ends = out.join(outputs.select("design", "net"), ["design", "net"], "left_semi").select("design", "m").distinct().withColumn("drives", F.lit(True))
    own = latches.select("design", F.col("a").alias("m"), "enable", "level").join(ends, ["design", "m"], "left").na.fill(False, ["drives"])
    other = own.select("design", *[F.col(c).alias(f"{c}_s") for c in ("m", "enable", "level", "drives")]).withColumnRenamed("m_s", "s")
    f = feeds.join(own, ["design", "m"]).join(other, ["design", "s"])
    joined = inverse.select("design", F.col("u").alias("enable"), F.col("v").alias("enable_s"), F.lit(True).alias("_inv"))
    f = f.join(joined, ["design", "enable", "enable_s"], "left")
    f = f.where("(enable = enable_s and level <> level_s) or (coalesce(_inv, false) and level = level_s)")
    back = f.select("design", F.col("s").alias("m"), F.col("m").alias("s"), F.col("score").alias("_back"))
    f = f.join(back, ["design", "m", "s"], "left").withColumn("_back", F.coalesce("_back", F.lit(0)))
    f = f.where("score > _back or (score = _back and drives_s and not drives)")
    return f.select("design", F.col("m").alias("master"), F.col("s").alias("slave"), "score", F.col("drives_s").alias("drives"))


def _paired(a: list, b: list, enable: list, level: list, data: list, gate: list, out: list) -> tuple[list, list, list, list]:
    """flip_flops() of one design, from rows of latches, of inverters, and of outputs, which have no gate."""
    own, nets, into, near, ends = {}, {}, {}, {}, set()
    for x, y, e, v, far, g, o in zip(a, b, enable, level, data, gate, out, strict=True):
        if x is not None:
            own.setdefault(x, []).append((e, v))
            nets.setdefault(x, set()).update((x, y))
            for net in far or ():
                into.setdefault(net, set()).add(x)
        elif g is not None:
            near.setdefault(g, set()).add(o)
            near.setdefault(o, set()).add(g)
        else:
            ends.add(o)
    for x in (own, nets, into, near):
        x.pop(None, None)
    ends.discard(None)
    feeds = {}
    for m, own_nets in nets.items():
        for net in own_nets:
            feeds.update(((m, s), 3) for s in into.get(net, ()))
            for v in near.get(net, ()):
                for s in into.get(v, ()):
                    feeds.setdefault((m, s), 2)
    drives = {m: not own_nets.isdisjoint(ends) for m, own_nets in nets.items()}
    opposite = lambda m, s: any((e == f and u != v) if e == f else (u == v and f in near.get(e, ())) for e, u in own[m] for f, v in own[s] if None not in (e, f, u, v))
    pairs = {p: score for p, score in feeds.items() if p[0] != p[1] and opposite(*p)}
    order = []
    for (m, s), score in pairs.items():
        back = pairs.get((s, m), 0)
        if score > back or (score == back and drives[s] and not drives[m]):
            order.append((-score, not drives[s], m, s))
    used, found = set(), ([], [], [], [])
    for _, _, m, s in sorted(order):
        if m not in used and s not in used:
            used.update((m, s))
            for clock, v in own[s]:
                for f, x in zip(found, (m, s, clock, "rising" if v == "high" else "falling"), strict=True):
                    f.append(x)
    return found


def flip_flops(latches: DataFrame, inverters: DataFrame, outputs: DataFrame) -> DataFrame:
    """(design, master, slave, clock, edge): pairs of latch_pairs(), greedily by score, then whether the slave drives an output, then names; each latch once.

    A design of few latches is paired in one task, so its rows move once and no table of latches goes through the driver. In the others, pairs that are
    the best ones of both their latches are taken at once, round by round, which gives the greedy result.
    """
    kind = latches.schema["a"].dataType.simpleString()
    none = lambda c: F.lit(None).cast(latches.schema[c].dataType).alias(c)
    columns = ("a", "b", "enable", "level", "data")
    net = lambda c, name: (F.lit(None) if c is None else F.col(c)).cast(kind).alias(name)
    rows = latches.select("design", *columns, net(None, "gate"), net(None, "out"))
    rows = rows.union(inverters.select("design", *map(none, columns), net("gate", "gate"), net("out", "out")))
    rows = rows.union(outputs.select("design", *map(none, columns), net(None, "gate"), net("net", "out")))
    rows = stash(rows, f"{work_dir(latches.sparkSession)}/rows")
    small, large = whole_groups(rows, ["design"], F.count("a") * F.count("a") + F.count(F.lit(1)), GROUP_WALKS)
    clock = latches.schema["enable"].dataType.simpleString()
    found = by_group(small, ["design"], _paired, f"master {kind}, slave {kind}, clock {clock}, edge string")
    if large is None:
        return found
    inverters, outputs = large.where("a is null and gate is not null").select("design", "gate", "out"), large.where("a is null and gate is null").select("design", F.col("out").alias("net"))
    return found.union(_flip_flops_by_rounds(large.where("a is not null").select("design", *columns), inverters, outputs))


def _flip_flops_by_rounds(latches: DataFrame, inverters: DataFrame, outputs: DataFrame) -> DataFrame:
    folder = work_dir(latches.sparkSession)
    # each is read many times
    latches, inverters = stash(latches, f"{folder}/latches"), stash(inverters, f"{folder}/inverters")
    left = stash(latch_pairs(latches, inverters, outputs).withColumn("_k", F.struct(-F.col("score"), ~F.col("drives"), "master", "slave")), f"{folder}/pairs-0")
    done = left.limit(0).select("design", "master", "slave")
    i = 0
    while True:
        i += 1
        if left.isEmpty():
            slave = latches.select("design", F.col("a").alias("slave"), F.col("enable").alias("clock"), F.when(F.col("level") == "high", "rising").otherwise("falling").alias("edge"))
            return done.join(slave, ["design", "slave"]).select("design", "master", "slave", "clock", "edge")
        ends = left.select("design", "_k", F.explode(F.array("master", "slave")).alias("end"))
        best = ends.groupBy("design", "end").agg(F.min("_k").alias("_k"))
        taken = best.groupBy("design", "_k").count().where("count = 2").select("design", "_k.master", "_k.slave")
        taken = stash(taken, f"{folder}/taken-{i}")
        done = done.union(taken)
        used = taken.select("design", F.explode(F.array("master", "slave")).alias("_u"))
        for end in ("master", "slave"):
            left = left.join(used.withColumnRenamed("_u", end), ["design", end], "left_anti")
        left = stash(left, f"{folder}/pairs-{i}")


def storage_elements(latches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(design, kind, a, b, control, mode, trigger, data, outputs, nets): the flip-flops of pairs(design, master, slave, clock, edge) and the latches that none of them uses.

    A flip-flop takes its data from the master and has its outputs at the slave's core; mode is edge and trigger rising or falling. A
    latch has both of its own, mode level and trigger high or low. a and b are master and slave, or the nets of the latch's core; nets are
    all nets of the cores. Lists are in natural order.
    """
    core = latches.select("design", F.col("a").alias("_n"), F.array("a", "b").alias("_core"), F.col("data").alias("_data"))
    of = lambda end, *cols: core.select("design", F.col("_n").alias(end), *[F.col(c).alias(f"{end}{c}") for c in cols])
    # latches are as many as the designs, however small their files, so none is broadcast through the driver
    ff = pairs.join(of("master", "_core", "_data").hint("merge"), ["design", "master"]).join(of("slave", "_core").hint("merge"), ["design", "slave"])
    ff = ff.select(
        "design", F.lit("flip_flop").alias("kind"), F.col("master").alias("a"), F.col("slave").alias("b"), F.col("clock").alias("control"), F.lit("edge").alias("mode"), F.col("edge").alias("trigger"),
        F.col("master_data").alias("data"), natural_sort(F.col("slave_core")).alias("outputs"), natural_sort(F.array_union("master_core", "slave_core")).alias("nets"),
    )
    used = pairs.select("design", F.explode(F.array("master", "slave")).alias("a"))
    own = natural_sort(F.array("a", "b"))
    left = latches.join(used.hint("merge"), ["design", "a"], "left_anti")
    return ff.union(left.select("design", F.lit("latch"), "a", "b", F.col("enable"), F.lit("level"), F.col("level"), "data", own, own))


def input_muxes(cores: DataFrame, edges: DataFrame) -> DataFrame:
    """(design, node, select, data, feedback, level): core nets that one control joins at one level to a net outside and at the other to a net of the core, from switch_edges; level is the one that lets data in."""
    c = _core_nets(cores).withColumnRenamed("net", "dst")
    e = edges.where("control is not null").join(c, ["design", "dst"])
    own = F.col("src").isin(F.col("ca"), F.col("cb"))
    g = e.groupBy("design", F.col("dst").alias("node"), "ca", "cb", F.col("control").alias("select")).agg(
        F.count_distinct("level").alias("_n"), F.array_sort(F.collect_set(F.when(~own, F.col("src")))).alias("data"), F.array_sort(F.collect_set(F.when(own, F.col("src")))).alias("feedback"), F.min(F.when(~own, F.col("level"))).alias("level")
    )
    return g.where("_n = 2 and size(data) > 0 and size(feedback) > 0").select("design", "node", "select", "data", "feedback", "level")


def async_controls(cores: DataFrame, transistors: DataFrame) -> DataFrame:
    """(design, a, b, signal, role, level): gates outside a core that tie one of its nets to a supply: power sets, ground resets."""
    t = transistors.select("design", "kind", F.col("gate").alias("signal"), F.explode(F.array(F.struct(F.col("source").alias("far"), F.col("drain").alias("net")), F.struct(F.col("drain").alias("far"), F.col("source").alias("net")))).alias("e")).select("design", "kind", "signal", "e.*")
    t = t.withColumn("role", F.when(F.col("far").rlike(POWER), "set").when(F.col("far").rlike(GROUND), "reset")).where("role is not null")
    j = t.join(_core_nets(cores), ["design", "net"]).where("signal <> ca and signal <> cb")
    return j.groupBy("design", F.col("ca").alias("a"), F.col("cb").alias("b"), "signal", "role").agg(F.max(F.when(F.col("kind") == "nmos", "high").otherwise("low")).alias("level"))


def clock_gating(edges: DataFrame, clocks: DataFrame) -> DataFrame:
    """(design, clock, sources, enables): clocks(design, signal) under the influence of clock-like and of other nets."""
    e = edges.where("semantic = 'influence' and src <> dst").select("design", F.col("dst").alias("signal"), "src").join(clocks.select("design", "signal").distinct(), ["design", "signal"])
    like = F.col("src").rlike("(?i)clk|clock|ck")
    g = e.groupBy("design", F.col("signal").alias("clock")).agg(F.array_sort(F.collect_set(F.when(like, F.col("src")))).alias("sources"), F.array_sort(F.collect_set(F.when(~like, F.col("src")))).alias("enables"))
    return g.where("size(sources) > 0 and size(enables) > 0")


def _spread(marks: np.ndarray, a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Marks(net, assignment) carried over open channels(transistor, assignment) until nothing changes."""
    while True:
        got = (marks[a] | marks[b]) & open_
        new = marks.copy()
        np.logical_or.at(new, a, got)
        np.logical_or.at(new, b, got)
        if (new == marks).all():
            return marks
        marks = new


def _primes(on: np.ndarray) -> np.ndarray:
    """Prime implicants of a table of n axes of length 2, a row each: 0, 1, or 2 for an input that doesn't matter.

    Along each axis a third place says whether both others hold, so the array holds all cubes; a prime is in no larger one.
    """
    cubes = on
    for axis in range(on.ndim):
        no, yes = (np.take(cubes, [v], axis) for v in (0, 1))
        cubes = np.concatenate((no, yes, no & yes), axis)
    prime = cubes.copy()
    for axis in range(on.ndim):
        larger = np.take(cubes, [2], axis)
        prime &= ~np.concatenate((larger, larger, np.zeros_like(larger)), axis)
    return np.argwhere(prime)


def _sum_text(on: np.ndarray, inputs: list[str]) -> str:
    """A short sum of products: primes that alone hold some row, then by most rows still open, fewest literals, and order."""
    primes, rows = _primes(on), np.argwhere(on)
    holds = np.ones((len(rows), len(primes)), bool)
    for axis in range(on.ndim):
        holds &= (primes[:, axis] == 2) | (primes[:, axis] == rows[:, axis, None])
    chosen = set(holds[holds.sum(axis=1) == 1].argmax(axis=1).tolist())
    literals = (primes < 2).sum(axis=1)
    open_ = ~holds[:, sorted(chosen)].any(axis=1)
    while open_.any():
        gain = holds[open_].sum(axis=0)
        best = int(np.lexsort((literals, -gain))[0])
        chosen.add(best)
        open_ &= ~holds[:, best]
    terms = [[i if v else f"!{i}" for i, v in zip(inputs, primes[c], strict=True) if v < 2] for c in sorted(chosen)]
    return " | ".join(" & ".join(t) if len(t) == 1 or len(terms) == 1 else f"({' & '.join(t)})" for t in terms)


def expression_of(value: list[int | None], inputs: list[str]) -> str | None:
    """A short expression of a truth table: a constant, a parity (^) of the inputs that matter, or the shorter of a sum of products and the inverse of one; null if a value is."""
    if any(v is None for v in value):
        return None
    on = np.array(value, bool).reshape((2,) * len(inputs))
    if on.all() or not on.any():
        return str(int(on.all()))
    used = [a for a in range(on.ndim) if (np.take(on, 0, a) != np.take(on, 1, a)).any()]
    if len(used) > 1 and all((np.take(on, 0, a) != np.take(on, 1, a)).all() for a in used):
        text = " ^ ".join(inputs[a] for a in used)
        return f"!({text})" if on.flat[0] else text
    direct, inverse = _sum_text(on, inputs), _sum_text(~on, inputs)
    if not any(c in inverse for c in "&|"):
        inverse = inverse[1:] if inverse.startswith("!") else f"!{inverse}"
    else:
        inverse = f"!({inverse})"
    return min(direct, inverse, key=lambda t: (sum(t.count(c) for c in "&|"), len(t)))


@lru_cache(maxsize=256)
def _evaluate(inputs: tuple[str, ...], out: str, transistors: tuple[tuple, ...]) -> tuple[list[int | None], str | None]:
    """Truth table and expression of one output from the transistors (kind, gate, source, drain) of its cone; all assignments of the inputs at once."""
    kind, *ends = (np.array(x, dtype=object) for x in zip(*transistors, strict=True))
    nets, at = np.unique(np.concatenate([*ends, np.array([out, *inputs], dtype=object)]), return_inverse=True)
    n = len(transistors)
    gate, a, b = np.split(at[: 3 * n], 3)
    out_at, in_at = at[3 * n], at[3 * n + 1 :]
    m = 1 << len(inputs)
    level = np.full((len(nets), m), -1, np.int8)
    power, ground = (np.array([bool(re.match(p, n)) for n in nets]) for p in (POWER, GROUND))
    level[power], level[ground] = 1, 0
    for j, i in enumerate(in_at):
        level[i] = (np.arange(m) >> (len(inputs) - 1 - j)) & 1
    opens = (kind == "nmos").astype(np.int8)[:, None]
    while True:
        on = level[gate] == opens
        one, zero = (_spread(level == v, a, b, on) for v in (1, 0))
        new = (level < 0) & (one != zero)  # components at both levels tell nothing
        if not new.any():
            break
        level = np.where(new, one.astype(np.int8), level)
    value = level[out_at].copy()
    for open_ in (on, on | (level[gate] < 0)):  # open for sure, then perhaps
        up, down = (_spread(np.repeat(s[:, None], m, axis=1), a, b, open_)[out_at] for s in (power, ground))
        value = np.where((value < 0) & (up != down), up.astype(np.int8), value)
    value = [None if v < 0 else int(v) for v in value]
    return value, expression_of(value, list(inputs))


def _table_of(inputs: list, start: list, kind: list, gate: list, source: list, drain: list) -> tuple[list, list, list]:
    """Inputs, values and expression of one output from the rows of its cone; cones alike in all but their design are evaluated once."""
    names = tuple(inputs[0])
    value, text = _evaluate(names, start[0], tuple(sorted(zip(kind, gate, source, drain, strict=True))))
    return [list(names)], [value], [text]


def truth_tables(transistors: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(design, output, inputs, value, sop, depends_on, reason, expression) of outputs(design, output) by inputs(design, net), the first input being the highest bit.

    Levels go from supplies and inputs over open channels until nothing changes; a part of the net at both levels has none.
    An output without a level takes the supply that it alone reaches over open channels, then over those that may be
    open, else null. sop, depends_on and expression, a short form of the function, are null if a value is. Tables double with
    each input: an output of a design of more than MAX_INPUTS has null tables and the reason too_many_inputs; reason is null otherwise.
    Each output is evaluated in one task from the transistors of its cone, and a task keeps the last tables, so cones alike in all but their design cost little. Tables are as long as the designs are many, however
    small their files, so none is broadcast through the driver.
    """
    every = inputs.groupBy("design").agg(F.array_sort(F.collect_set("net")).alias("inputs"))
    names = every.where(F.size("inputs") <= MAX_INPUTS)
    want = outputs.select("design", F.col("output").alias("start"))
    t = transistors.select("design", "device", "kind", "gate", "source", "drain")
    cone = logic_cone(t, want)
    cone = cone.select("design", "start", "node").union(want.select("design", "start", "start")).distinct()
    near = t.select("*", F.explode(F.array_distinct(F.array("source", "drain"))).alias("node")).join(cone.hint("merge"), ["design", "node"]).drop("node").distinct()
    near = near.join(names.hint("merge"), "design").withColumn("output", F.col("start"))
    v = by_group(near.select("design", "output", "inputs", "start", "kind", "gate", "source", "drain"), ["design", "output"], _table_of, "inputs array<string>, value array<int>, expression string")
    literal = "array_join(transform(inputs, (v, j) -> if(shiftright(i, size(inputs) - 1 - j) & 1 = 1, v, '!' || v)), ' & ')"
    sop = f"""case when exists(value, x -> x is null) then null when not exists(value, x -> x = 1) then '0' when not exists(value, x -> x = 0) then '1'
        else array_join(transform(filter(sequence(0, size(value) - 1), i -> value[i] = 1), i -> {literal}), ' | ') end"""
    depends = """case when exists(value, x -> x is null) then null else transform(filter(transform(inputs, (v, j) -> struct(v, shiftleft(1, size(inputs) - 1 - j) as bit)),
        p -> exists(sequence(0, size(value) - 1), i -> value[i] <> value[i ^ p.bit])), p -> p.v) end"""
    done = v.select("design", "output", "inputs", "value", F.expr(sop).alias("sop"), F.expr(depends).alias("depends_on"), F.lit(None).cast("string").alias("reason"), "expression")
    wide = outputs.select("design", "output").join(every.where(F.size("inputs") > MAX_INPUTS).hint("merge"), "design")
    no = F.lit(None)
    return done.union(wide.select("design", "output", "inputs", no.cast("array<int>"), no.cast("string"), no.cast("array<string>"), F.lit("too_many_inputs"), no.cast("string")))
