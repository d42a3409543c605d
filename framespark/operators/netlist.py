"""Netlists as tables: aliases, devices, edges, inverters, switches, storage features, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions.common import by_group, stash, whole_groups, work_dir
from framespark.operators.frames import natural_key
from framespark.operators.graph import GROUP_WALKS, connected_components, reach

POWER = r"(?i)^(vdd|vcc|vpp|pwr|power|vdda|vddd)\d*$"
GROUND = r"(?i)^(gnd|vss|ground|vssa|agnd|dgnd)\d*$"


def net_aliases(wire_points: DataFrame, pins: DataFrame) -> DataFrame:
    """(design, net, canonical): nets that share a wire point or a pin (instance, PORT) are one; the smallest name stands for it. Crossing wires don't connect."""
    star = lambda df, k: df.groupBy("design", *k).agg(F.min("net").alias("dst")).join(df, ["design", *k]).select("design", F.col("net").alias("src"), "dst")
    a = star(wire_points.select("design", "net", "x", "y").distinct(), ["x", "y"])
    b = star(pins.select("design", "net", "instance", F.upper("port").alias("port")).distinct(), ["instance", "port"])
    return connected_components(a.union(b), ("design",)).select("design", F.col("node").alias("net"), F.col("component").alias("canonical"))


def infer_pins(instances: DataFrame, symbol_pins: DataFrame, wire_points: DataFrame, pins: DataFrame) -> DataFrame:
    """(design, instance, port, net): the net at the exact place of each symbol pin, turned by the instance's orientation; explicit pins win."""
    x, y, o = F.col("px"), F.col("py"), F.col("orientation")
    turn = {"R0": (x, y), "R90": (-y, x), "R180": (-x, -y), "R270": (y, -x), "MX": (x, -y), "MY": (-x, y), "MXR90": (y, x), "MYR90": (-y, -x)}
    dx, dy = F.lit(None), F.lit(None)
    for name, (u, v) in turn.items():
        dx, dy = F.when(o == name, u).otherwise(dx), F.when(o == name, v).otherwise(dy)
    j = instances.join(symbol_pins, "cell").select("design", "instance", "port", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    at = wire_points.groupBy("design", "x", "y").agg(F.min("net").alias("_net"))
    own = pins.groupBy("design", "instance", "port").agg(F.min("net").alias("_own"))
    j = j.join(at, ["design", "x", "y"], "left").join(own, ["design", "instance", "port"], "left")
    return j.select("design", "instance", "port", F.coalesce("_own", "_net").alias("net")).where("net is not null")


def supplies(nets: DataFrame) -> DataFrame:
    """nets(design, net) with is_power and is_ground by name."""
    return nets.withColumns({"is_power": F.col("net").rlike(POWER), "is_ground": F.col("net").rlike(GROUND)})


def top_ports(ports: DataFrame, wire_points: DataFrame) -> DataFrame:
    """(design, port, net, direction, is_power, is_ground): the nets with a wire point at each port's place.

    direction is input or output by the port's name, else null; a supply port makes its nets supplies. Ports without a
    place, or with no wire there, have no row.
    """
    name = F.upper("port")
    direction = F.when(name.rlike(r"^IN(\d+$|_)"), "input").when(name.rlike(r"^OUT(\d+$|_)"), "output").when(name.rlike("CLK|^CLOCK$|RST|RESET|SET|EN"), "input")
    # the wire points of a place are distinct nets, so a net is met once however many of its wires cross there
    at = wire_points.select("design", "x", "y", "net").distinct()
    supply = {"is_power": name.rlike(r"VDD|VCC|POWER|\+5|5PLUS"), "is_ground": name.isin("0", "&0", "GND")}
    return ports.select("design", "port", "x", "y").distinct().join(at, ["design", "x", "y"]).select("design", "port", "net", direction.alias("direction"), *[v.alias(k) for k, v in supply.items()]).distinct()


def port_nets(ports: DataFrame, wire_points: DataFrame) -> DataFrame:
    """(design, port, net, direction): the net of each port IN<n> or OUT<n>, the first in natural order of those with a wire point at its place; inputs are named in capitals.

    Other ports, ports without a place and ports with no wire there have no row; where one name stands at several places, the first net of them all counts.
    """
    name = F.upper("port")
    direction = F.when(name.rlike(r"^IN\d+$"), "input").when(name.rlike(r"^OUT\d+$"), "output")
    p = ports.withColumn("direction", direction).where("direction is not null").withColumn("port", F.when(F.col("direction") == "input", name).otherwise(F.col("port")))
    met = p.select("design", "port", "direction", "x", "y").join(wire_points.select("design", "x", "y", "net"), ["design", "x", "y"])
    return met.groupBy("design", "port", "direction").agg(F.min_by("net", F.struct(natural_key(F.col("net")), F.col("net"))).alias("net")).select("design", "port", "net", "direction")


def classify_devices(devices: DataFrame) -> DataFrame:
    """devices(design, device, cell, pins map) with kind and domain by the first rule that fits: pin shapes of transistors first, then name tokens."""
    names = F.map_keys("pins")
    has = lambda *p: F.size(F.array_except(F.array(*[F.lit(x) for x in p]), names)) == 0
    c = F.upper("cell")
    kind = (
        F.when(has("GATE", "DRAIN", "SOURCE") & ~c.rlike("PMOS|PFET|PCH"), "nmos").when(has("GATE", "DRAIN", "SOURCE"), "pmos").when(c.rlike("TGATE|TRANSMISSION"), "tgate").when(c.rlike("DFF|FLIP"), "dff").when(c.rlike("LATCH"), "latch")
        .when(c.rlike("MUX"), "mux2").when(c.rlike("XNOR"), "xnor").when(c.rlike("XOR"), "xor").when(c.rlike("NAND"), "nand").when(c.rlike("NOR"), "nor").when(c.rlike("INV|NOT"), "inv").when(c.rlike("AND"), "and").when(c.rlike("OR"), "or").when(c.rlike("BUF"), "buf")
        .when(has("D", "Q", "CLK"), "dff").when(has("A", "Y"), "buf").otherwise("unknown")
    )
    domain = F.when(F.col("kind").isin("nmos", "pmos", "tgate"), "switch").when(F.col("kind").isin("dff", "latch"), "storage").when(F.col("kind") == "unknown", "unknown").otherwise("gate")
    return devices.withColumn("kind", kind).withColumn("domain", domain)


def switch_edges(transistors: DataFrame, supply_nets: DataFrame | None = None) -> DataFrame:
    """(design, src, dst, semantic, inversion, control, level, device): two guarded conduction edges and two influence edges of the gate per transistor; supply ends are left out.

    Without supply_nets(design, net) the names tell supplies, which spares a join.
    """
    t = transistors.select("design", "device", "kind", "gate", "source", "drain")
    level = F.when(F.col("kind") == "nmos", 1).otherwise(0)
    e = lambda s, d, sem, ctl: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(sem).alias("semantic"), (F.col("gate") if ctl else F.lit(None).cast("string")).alias("control"), (level if ctl else F.lit(None).cast("int")).alias("level"))
    ways = [("source", "drain", "conduction", True), ("drain", "source", "conduction", True), ("gate", "source", "influence", False), ("gate", "drain", "influence", False)]
    if supply_nets is None:
        t = t.withColumns({f"_{end}": _supply_name(end) for end in ("gate", "source", "drain")})
        each = [F.when(~F.col(f"_{s}") & ~F.col(f"_{d}"), e(s, d, *more)) for s, d, *more in ways]
        x = t.select("design", "device", F.explode(F.array(*each)).alias("e")).where("e is not null").select("design", "device", "e.*")
    else:
        x = t.select("design", "device", F.explode(F.array(*[e(*w) for w in ways])).alias("e")).select("design", "device", "e.*")
        x = _signals_at(x, ("src", "dst"), supply_nets)
    return x.select("design", "src", "dst", "semantic", "control", "level", "device")


def _supply_name(net: str) -> Column:
    """Whether a net is a supply by its name."""
    return F.coalesce(F.col(net).rlike(f"{POWER}|{GROUND}"), F.lit(False))


def _signals_at(df: DataFrame, ends: tuple[str, ...], supply_nets: DataFrame | None) -> DataFrame:
    """df without rows that have a supply at one of the ends, by supply_nets(design, net) or by name."""
    if supply_nets is None:
        return df.where(reduce(lambda a, b: a & b, [~_supply_name(end) for end in ends]))
    s = supply_nets.select("design", F.col("net").alias("_s"))
    for end in ends:
        df = df.join(s, (df["design"] == s["design"]) & (df[end] == s["_s"]), "left_anti")
    return df


def cmos_inverters(transistors: DataFrame, nets: DataFrame | None = None) -> DataFrame:
    """(design, gate, out): pmos with exactly one power end and nmos with exactly one ground end on the same gate and output.

    Without nets(design, net, is_power, is_ground) the names tell supplies, which spares two joins.
    """
    if nets is None:
        rail = lambda end: F.when(F.col("kind") == "pmos", F.col(end).rlike(POWER)).otherwise(F.col(end).rlike(GROUND))
        j = transistors.select("design", "kind", "gate", "source", "drain", rail("source").alias("_at"), rail("drain").alias("_to")).where("_at <> _to")
        j = j.withColumn("out", F.when(F.col("_at"), F.col("drain")).otherwise(F.col("source")))
    else:
        n = nets.select("design", "net", "is_power", "is_ground")
        s = n.select(F.col("design").alias("_d1"), F.col("net").alias("_n1"), F.col("is_power").alias("_p1"), F.col("is_ground").alias("_g1"))
        d = n.select(F.col("design").alias("_d2"), F.col("net").alias("_n2"), F.col("is_power").alias("_p2"), F.col("is_ground").alias("_g2"))
        j = transistors.join(s, (F.col("design") == F.col("_d1")) & (F.col("source") == F.col("_n1"))).join(d, (F.col("design") == F.col("_d2")) & (F.col("drain") == F.col("_n2")))
        one = lambda a, b: F.when(F.col(a) & ~F.col(b), F.col("drain")).when(~F.col(a) & F.col(b), F.col("source"))
        j = j.withColumn("out", F.when(F.col("kind") == "pmos", one("_p1", "_p2")).otherwise(one("_g1", "_g2"))).where("out is not null")
    return j.groupBy("design", "gate", "out").agg(F.count_if(F.col("kind") == "pmos").alias("p"), F.count_if(F.col("kind") == "nmos").alias("n")).where("p > 0 and n > 0").select("design", "gate", "out")


def controlled_switches(transistors: DataFrame, nets: DataFrame | None = None) -> DataFrame:
    """(design, a, b, n_gates, p_gates, kind) per pair of signal nets: transmission gate if both kinds conduct, else pass; constant if a gate ties it on.

    Without nets(design, net, is_power, is_ground) the names tell supplies, which spares three joins.
    """
    t = _signals_at(transistors, ("source", "drain"), None if nets is None else nets.where("is_power or is_ground"))
    if nets is None:
        t = t.withColumns({"is_power": F.col("gate").rlike(POWER), "is_ground": F.col("gate").rlike(GROUND)})
    else:
        gate = nets.select(F.col("design").alias("_d"), F.col("net").alias("_n"), "is_power", "is_ground")
        t = t.join(gate, (F.col("design") == F.col("_d")) & (F.col("gate") == F.col("_n")), "left")
    on = F.coalesce(((F.col("kind") == "nmos") & F.col("is_power")) | ((F.col("kind") == "pmos") & F.col("is_ground")), F.lit(False))
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("gate"))))
    g = t.groupBy("design", F.least("source", "drain").alias("a"), F.greatest("source", "drain").alias("b")).agg(pick("nmos").alias("n_gates"), pick("pmos").alias("p_gates"), F.max(on).alias("_on"))
    kind = F.when(F.col("_on"), "constant").when((F.size("n_gates") > 0) & (F.size("p_gates") > 0), "transmission").otherwise("pass")
    return g.withColumn("kind", kind).drop("_on")


def bistable_cores(inverters: DataFrame) -> DataFrame:
    """(design, a, b): pairs of nets that inverters drive from each other both ways."""
    g = inverters.where("gate <> out").groupBy("design", F.least("gate", "out").alias("a"), F.greatest("gate", "out").alias("b"))
    up = F.col("gate") < F.col("out")
    return g.agg(F.max(up).alias("_up"), F.max(~up).alias("_down")).where("_up and _down").select("design", "a", "b")


def clock_candidates(edges: DataFrame) -> DataFrame:
    """(design, signal, n, name_score, rank): controls of guarded edges by (clock-like name, count, name)."""
    g = edges.where("control is not null").groupBy("design", F.col("control").alias("signal")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("name_score", F.when(F.col("signal").rlike("(?i)clk|clock|ck"), 2).when(F.col("signal").rlike("(?i)^(en|phi|ph)"), 1).otherwise(0))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("design").orderBy(F.desc("name_score"), F.desc("n"), "signal")))


def inverse_pairs(signals: DataFrame, inverters: DataFrame) -> DataFrame:
    """(design, signal, inverse): complements by a name suffix (B, _N, N, BAR) or an inverter between both."""
    # as long as the designs are many, so not broadcast through the driver
    s = signals.select("design", "signal").distinct().hint("merge")
    named = s.select("design", "signal", F.explode(F.array(*[F.concat("signal", F.lit(x)) for x in ("B", "_N", "N", "BAR")])).alias("inverse"))
    named = named.join(s.withColumnRenamed("signal", "inverse"), ["design", "inverse"], "left_semi").select("design", "signal", "inverse")
    wired = inverters.select("design", F.col("gate").alias("signal"), F.col("out").alias("inverse")).join(s, ["design", "signal"], "left_semi").join(s.withColumnRenamed("signal", "inverse"), ["design", "inverse"], "left_semi")
    return named.union(wired.select("design", "signal", "inverse")).distinct()


def _chains_of(src: list, dst: list) -> tuple[list, list]:
    """Starts and their paths of two nodes or more."""
    to = {}
    for x, y in zip(src, dst, strict=True):
        to[x] = min(y, to.get(x, y))
    found = ([], [])
    for start in set(src).difference(dst) or to:
        path, x = {start: None}, start
        while (x := to.get(x)) is not None and x not in path:
            path[x] = None
        if len(path) > 1:
            found[0].append(start)
            found[1].append(list(path))
    return found


def toggle_chains(links: DataFrame) -> DataFrame:
    """(design, start, path) of links(design, src, dst): from nodes nobody points at (all if there are none in a design) along the smallest successor, until one repeats; at least two nodes.

    A design of few links is followed in one task. In the others, both the known part of every path and the pointers double each
    round, until a round meets no new node. Links with a null end are left out.
    """
    links = links.select("design", "src", "dst").where("src is not null and dst is not null")
    small, large = whole_groups(stash(links, f"{work_dir(links.sparkSession)}/links"), ["design"], F.count(F.lit(1)) * F.count(F.lit(1)), GROUP_WALKS)
    kind = links.schema["src"].dataType.simpleString()
    found = by_group(small, ["design"], _chains_of, f"start {kind}, path array<{kind}>")
    return found if large is None else found.union(_chains_by_rounds(large))


def _chains_by_rounds(links: DataFrame) -> DataFrame:
    roots = links.select("design", "src").join(links.select("design", F.col("dst").alias("src")), ["design", "src"], "left_anti").distinct()
    no_root = links.select("design", "src").distinct().join(roots.select("design").distinct(), "design", "left_anti")
    folder = work_dir(links.sparkSession)
    jump = stash(links.groupBy("design", F.col("src").alias("node")).agg(F.min("dst").alias("to")), f"{folder}/jump")
    path = stash(roots.union(no_root).select("design", F.col("src").alias("start"), F.col("src").alias("node"), F.lit(0).cast("long").alias("at")), f"{folder}/path")
    n = path.count()
    i = 0
    while True:
        ahead = path.join(jump, ["design", "node"]).select("design", "start", F.col("to").alias("node"), F.col("at") + (1 << i))
        path = stash(path.union(ahead).groupBy("design", "start", "node").agg(F.min("at").alias("at")), f"{folder}/path-{i}")
        now = path.count()
        if now == n:
            break
        far = jump.select("design", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = stash(jump.join(far, ["design", "to"]).select("design", "node", F.col("far").alias("to")), f"{folder}/jump-{i}")
        n, i = now, i + 1
    row = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
    return path.groupBy("design", "start").agg(row.alias("path")).where("size(path) >= 2").select("design", "start", "path")


def phase_transparency(edges: DataFrame, phases: DataFrame, source: DataFrame) -> DataFrame:
    """(design, phase, start, node): nodes that each source(design, start) reaches in each phase over edges whose control stands at its level.

    phases(design, phase, signal, level); a control that a phase doesn't name blocks.
    """
    free = edges.where("control is null").join(phases.select("design", "phase").distinct(), "design").select("design", "phase", "src", "dst")
    guarded = edges.where("control is not null").select("design", "src", "dst", F.col("control").alias("signal"), "level").join(phases, ["design", "signal", "level"]).select("design", "phase", "src", "dst")
    starts = source.join(phases.select("design", "phase").distinct(), "design").select("design", "phase", "start")
    return reach(free.union(guarded), starts, ("design", "phase"))


def phase_report(conduction: DataFrame, influence: DataFrame, phases: DataFrame, source: DataFrame, storage: DataFrame, hold: DataFrame) -> DataFrame:
    """(design, phase, conduction_paths, influence_paths, transparent, hold_isolated) of every phase.

    Paths are pairs of a source(design, start) and a storage(design, node) that edges of the kind connect in the phase; a
    node that is a source itself counts. A phase with any is transparent; one of hold(design, phase) without any is
    isolated, and hold_isolated is null in other phases.
    """
    every = phases.select("design", "phase").distinct()
    out = every
    for name, edges in (("conduction_paths", conduction), ("influence_paths", influence)):
        reached = phase_transparency(edges, phases, source).select("design", "phase", "start", "node")
        own = every.join(source, "design").select("design", "phase", "start", F.col("start").alias("node"))
        paths = reached.union(own).distinct().join(storage.select("design", "node").distinct(), ["design", "node"])
        out = out.join(paths.groupBy("design", "phase").agg(F.count(F.lit(1)).alias(name)), ["design", "phase"], "left")
    out = out.na.fill(0, ["conduction_paths", "influence_paths"]).join(hold.select("design", "phase", F.lit(True).alias("_hold")).distinct(), ["design", "phase"], "left")
    open_ = (F.col("conduction_paths") > 0) | (F.col("influence_paths") > 0)
    return out.select("design", "phase", "conduction_paths", "influence_paths", open_.alias("transparent"), F.when(F.col("_hold"), ~open_).alias("hold_isolated"))


def classify_storage(devices: DataFrame) -> DataFrame:
    """(design, device, structure, confidence, features) of storage macros: the class of greatest confidence, with set, reset and enable features by pins."""
    names = F.map_keys("pins")
    any_of = lambda *p: F.arrays_overlap(names, F.array(*[F.lit(x) for x in p]))
    s = devices.where("domain = 'storage'")
    structure = F.when((F.col("kind") == "dff") & any_of("J") & any_of("K"), "jk_flip_flop").when((F.col("kind") == "dff") & any_of("T"), "t_flip_flop").when(F.col("kind") == "dff", "d_flip_flop").when(any_of("EN", "G", "CLK"), "gated_d_latch").otherwise("rs_latch")
    tests = {"sync_reset": ("SCLR", "SRST"), "async_reset": ("RN", "CLR", "ACLR", "RST"), "async_set": ("SN", "PRE", "SET"), "enable": ("CE", "EN")}
    feats = F.filter(F.array(*[F.when(any_of(*p), F.lit(k)) for k, p in tests.items()]), lambda x: x.isNotNull())
    return s.select("design", "device", structure.alias("structure"), F.lit(0.75).alias("confidence"), feats.alias("features"))


def logic_cone(transistors: DataFrame, outputs: DataFrame, supply_nets: DataFrame | None = None) -> DataFrame:
    """(design, start, node): nets that each output(design, start) depends on: across channels and then to gates; supplies end the walk.

    Without supply_nets(design, net) the names tell supplies, which spares two joins.
    """
    t = transistors
    dep = t.select("design", F.col("source").alias("src"), F.col("drain").alias("dst")).union(t.select("design", "drain", "source")).union(t.select("design", "source", "gate")).union(t.select("design", "drain", "gate"))
    dep = _signals_at(dep, ("src", "dst"), supply_nets)
    return reach(dep, outputs, ("design",))


def netlist_diagnostics(nets: DataFrame, pins: DataFrame, wire_points: DataFrame, ports: DataFrame, instances: DataFrame | None = None, views: DataFrame | None = None) -> DataFrame:
    """(design, code, name) distinct; designs without any get an info row.

    Duplicate net names; nets without pins, without wires, with a wire of fewer than two points (where wire_points names
    the wire); ports without a place; designs without input or output ports (name ''); and instances(design, instance,
    library, cell, view) whose symbol is not named in full or is not among views(library, cell, view).
    """
    kinds = {"_nets": nets, "_pins": pins, "_wires": wire_points}
    wired = "wire" in wire_points.columns
    if wired:
        kinds["_wires"] = wire_points.groupBy("design", "net", "wire").agg(F.count(F.lit(1)).alias("_points"))
    short = lambda k: F.col("_points") < 2 if wired and k == "_wires" else F.lit(False)
    rows = reduce(DataFrame.union, [df.select("design", "net", *[F.lit(k == x).alias(x) for x in kinds], short(k).alias("_short")) for k, df in kinds.items()])
    # a net is judged from one row, so nets, pins and wires are moved once
    net = rows.groupBy("design", "net").agg(F.count_if("_nets").alias("_n"), *[F.max(c).alias(c) for c in ("_pins", "_wires", "_short")])
    known, null = F.col("_n") > 0, F.col("design").isNull() | F.col("net").isNull()
    tests = {"duplicate_net": F.col("_n") > 1, "net_without_pins": known & (null | ~F.col("_pins")), "net_without_wires": known & (null | ~F.col("_wires")), "degenerate_wire": F.col("_short")}
    codes = F.array_compact(F.array(*[F.when(on, F.lit(code)) for code, on in tests.items()]))
    of_nets = net.select("design", F.explode(codes).alias("code"), F.col("net").alias("name"))
    folder = work_dir(nets.sparkSession)
    # one row a design, read three times
    designs = stash(net.groupBy("design").agg(F.max(known).alias("_known"), F.max(reduce(lambda a, b: a | b, tests.values())).alias("_bad")).where("_known"), f"{folder}/designs")
    other = ports.where("x is null or y is null").select("design", F.lit("port_without_location").alias("code"), F.col("port").alias("name")).distinct()
    has = ports.groupBy("design").agg(*[F.coalesce(F.max(F.col("port").rlike(names)), F.lit(False)).alias(c) for c, names in (("_in", r"(?i)^(IN|INSIN)\d+$"), ("_out", r"(?i)^OUT\d+$"))])
    lacks = [F.when(~F.coalesce(c, F.lit(False)), code) for c, code in (("_in", "no_input_ports"), ("_out", "no_output_ports"))]
    other = other.union(designs.join(has, "design", "left").select("design", F.explode(F.array_compact(F.array(*lacks))), F.lit("")))
    if instances is not None:
        code = F.when(F.expr("library is null or cell is null or view is null"), "missing_symbol_reference")
        i = instances.select("design", F.col("instance").alias("name"), "library", "cell", "view")
        if views is not None:
            i = i.join(views.select("library", "cell", "view", F.lit(True).alias("_found")).distinct(), ["library", "cell", "view"], "left")
            code = code.when(F.col("_found").isNull(), "unresolved_symbol")
        other = other.union(i.select("design", code.alias("code"), "name").where("code is not null").distinct())
    other = stash(other, f"{folder}/other")
    fine = designs.where("not _bad or design is null").join(other.select("design"), "design", "left_anti")
    return of_nets.union(other).union(fine.select("design", F.lit("info"), F.lit("no problems")))


def structure_report(nodes: DataFrame, edges: DataFrame, scc: DataFrame, storage: DataFrame) -> DataFrame:
    """(design, report): counts of nodes, edges, strong components of two or more, storage classes and their features as JSON; what a design lacks is left out."""
    n = lambda df, name: df.groupBy("design").agg(F.count(F.lit(1)).alias(name))
    counted = lambda df, key, name: df.groupBy("design", key).count().groupBy("design").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count")))).alias(name))
    j = n(nodes, "nodes").join(n(edges, "edges"), "design", "left").join(n(scc.where("size > 1 and node = component"), "scc"), "design", "left")
    feats = storage.select("design", F.explode("features").alias("feature"))
    j = j.na.fill(0).join(counted(storage, "structure", "storage"), "design", "left").join(counted(feats, "feature", "features"), "design", "left")
    return j.select("design", F.to_json(F.struct("nodes", "edges", "scc", "storage", "features")).alias("report"))
