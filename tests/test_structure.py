"""Graphs and netlist structure on literal cases, and geometry against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import graph, netlist, selection, storage, structure
from framespark.operators import polygons as pg
from framespark.operators import rasters as ra


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    ahead = {x: {x} for x in nodes}
    for _ in nodes:
        for a, b in edges:
            ahead[a] |= ahead[b]
    out = {}
    for x in nodes:
        mine = {y for y in ahead[x] if x in ahead[y]}
        out[x] = (min(mine), len(mine))
    return out


def test_strong_components_random(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for d in range(40):
        n = rng.randrange(2, 14)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))}
        if d % 3 == 0:  # rings and chains
            order = rng.sample(range(n), n)
            edges = {(order[i], order[(i + 1) % n]) for i in range(n - d % 2)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(d % 4)}
        rows += [(d, a, b) for a, b in edges]
        want |= {(d, x): v for x, v in brute_components(edges).items()}
    got = graph.strong_components(spark.createDataFrame(rows, "design int, src int, dst int"), ("design",)).collect()
    assert {(r.design, r.node): (r.component, r["size"]) for r in got} == want


def test_long_chains_and_rings(spark):
    n = 5000
    rows = [(0, i, (i + 1) % n) for i in range(n)] + [(1, i, i + 1) for i in range(n)] + [(2, (n - i) % n, n - i - 1) for i in range(n)] + [(3, i, i + 1) for i in range(n)] + [(3, 3000, 1000), (3, 4000, 2500)]
    edges = spark.createDataFrame(rows, "design int, src int, dst int")
    got = graph.strong_components(edges, ("design",)).groupBy("design").agg(F.max("size").alias("most"), F.count_distinct("component").alias("many")).collect()
    assert {(r.design, r.most, r.many) for r in got} == {(0, n, 1), (1, 1, n + 1), (2, n, 1), (3, 3001, n + 1 - 3000)}
    chains = netlist.toggle_chains(edges.where("design in (1, 3)")).collect()
    assert {(r.design, r.start, tuple(r.path)) for r in chains} == {(1, 0, tuple(range(n + 1))), (3, 0, tuple(range(3001)))}


def test_reach_is_not_capped(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    assert graph.reach(edges, spark.createDataFrame([(0,)], "start int")).count() == 30


LATCH = [
    ("P1", "pmos", "A", "VDD", "B"), ("N1", "nmos", "A", "GND", "B"), ("P2", "pmos", "B", "VDD", "A"), ("N2", "nmos", "B", "GND", "A"), ("P3", "pmos", "EN", "VDD", "ENB"),
    ("N3", "nmos", "EN", "GND", "ENB"), ("P4", "pmos", "ENB", "D", "A"), ("N4", "nmos", "EN", "D", "A"), ("P5", "pmos", "EN", "B", "A"), ("N5", "nmos", "ENB", "B", "A"),
]
MASTER_SLAVE = [
    ("PCLK", "pmos", "CLK", "VDD", "CLKB"), ("NCLK", "nmos", "CLK", "GND", "CLKB"), ("MP1", "pmos", "MA", "VDD", "MB"), ("MN1", "nmos", "MA", "GND", "MB"), ("MP2", "pmos", "MB", "VDD", "MA"), ("MN2", "nmos", "MB", "GND", "MA"),
    ("MP3", "pmos", "CLK", "D", "MA"), ("MN3", "nmos", "CLKB", "D", "MA"), ("MP4", "pmos", "CLKB", "MB", "MA"), ("MN4", "nmos", "CLK", "MB", "MA"), ("SP1", "pmos", "SA", "VDD", "SB"), ("SN1", "nmos", "SA", "GND", "SB"),
    ("SP2", "pmos", "SB", "VDD", "SA"), ("SN2", "nmos", "SB", "GND", "SA"), ("SP3", "pmos", "CLKB", "MB", "SA"), ("SN3", "nmos", "CLK", "MB", "SA"), ("SP4", "pmos", "CLK", "SB", "SA"), ("SN4", "nmos", "CLKB", "SB", "SA"),
]


def classes(spark, rows):
    t = spark.createDataFrame([(1, *r) for r in rows], "design int, device string, kind string, gate string, source string, drain string")
    nets = netlist.supplies(t.select("design", F.explode(F.array("gate", "source", "drain")).alias("net")).distinct())
    inverters = netlist.cmos_inverters(t, nets)
    edges = netlist.switch_edges(t, nets.where("is_power or is_ground").select("design", "net"))
    cores, clocks = netlist.bistable_cores(inverters), netlist.clock_candidates(edges)
    latches = structure.core_classes(cores, storage.input_muxes(cores, edges), storage.async_controls(cores, t), clocks)
    pairs = structure.flip_flop_classes(latches, netlist.inverse_pairs(clocks, inverters), edges.where("semantic = 'influence'").select("design", "src", "dst"))
    return latches.collect(), pairs.collect()


def test_gated_latch(spark):
    latches, pairs = classes(spark, LATCH)
    assert [(r.a, r.b, r.structure, r.confidence, r.data, [tuple(c) for c in r.clocks]) for r in latches] == [("A", "B", "gated_d_latch", 0.8, ["D"], [("EN", 1), ("ENB", 0)])] and not pairs


def test_master_slave(spark):
    latches, pairs = classes(spark, MASTER_SLAVE)
    assert len(latches) == 2
    assert {(r.master, r.slave, r.structure, r.confidence) for r in pairs} == {("MA", "SA", "master_slave_dff", 0.88), ("MA", "SA", "edge_triggered_dff", 0.84)}


def devices(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "design int, device string, kind string, pins map<string,string>")


def test_latch_stores_by_its_states(spark):
    rows = [(d, k, {"GATE": g, "SOURCE": s, "DRAIN": e}) for d, k, g, s, e in LATCH]
    edges = structure.device_edges(devices(spark, *rows)).where("semantic = 'influence' and src not in ('VDD', 'GND') and dst not in ('VDD', 'GND')")
    inverters = netlist.cmos_inverters(spark.createDataFrame([(1, *r) for r in LATCH], "design int, device string, kind string, gate string, source string, drain string"), spark.createDataFrame([(1, n, n == "VDD", n == "GND") for n in ("VDD", "GND", "A", "B", "D", "EN", "ENB")], "design int, net string, is_power boolean, is_ground boolean"))
    wired = inverters.select("design", F.col("gate").alias("src"), F.col("out").alias("dst"), F.lit("influence").alias("semantic"), F.lit(1).alias("inversion"), F.array().cast(structure.CONTROLS).alias("controls"), F.lit("").alias("device"))
    every = edges.unionByName(wired)
    core = structure.core_states(every, graph.strong_components(every, ("design",))).collect()
    assert [(r.nodes, r.positive, r.states, r.storage) for r in core] == [(["A", "B"], True, ["01", "10"], True)]


def test_toggle_flip_flop(spark):
    dev = devices(spark, ("XOR1", "xor", {"A": "Q", "B": "T", "Y": "D"}), ("FF1", "dff", {"D": "D", "Q": "Q", "CLK": "CLK"}), ("FF2", "dff", {"d": "Z", "q": "T", "CLK": ""}), ("BAD", "nmos", {"S": "a", "D": "b"}), ("NONE", "inv", None))
    macros = netlist.classify_storage(dev.where("kind = 'dff'").withColumn("domain", F.lit("storage")))
    toggles = structure.xor_toggles(dev)
    assert [(r.flip_flop, r.gate, r.toggles) for r in toggles.collect()] == [("FF1", "XOR1", ["T"])]
    more = structure.upgraded_macros(macros, dev, structure.device_edges(dev), toggles).collect()
    assert [(r.device, r.structure, round(r.confidence, 6)) for r in more] == [("FF1", "t_flip_flop", 0.85)]
    assert {(r.device, r.code) for r in structure.device_diagnostics(dev).collect()} == {("BAD", "missing_gate"), ("NONE", "no_output_pin")}
    assert {(r.src, r.dst) for r in structure.device_edges(dev).where("device = 'FF2'").collect()} == {("Z", "T")}


def test_phases_of_many_signals(spark):
    """A chain of nine switches is open in one phase of 512; an unknown control blocks unless allowed."""
    schema = f"design int, src string, dst string, controls {structure.CONTROLS}"
    chain = [(1, f"n{i}", f"n{i + 1}", [(f"s{i}", i % 2)]) for i in range(9)] + [(1, "n9", "end", [("other", 1)])]
    e = spark.createDataFrame(chain, schema)
    signals = spark.createDataFrame([(1, [f"s{i}" for i in range(9)])], "design int, signals array<string>")
    start, node = spark.createDataFrame([(1, "n0")], "design int, start string"), spark.createDataFrame([(1, "n9"), (1, "end"), (1, "n1")], "design int, node string")
    only = sum((i % 2) << i for i in range(9))
    got = {(r.node, r.phase) for r in structure.enumerated_phases(e, signals, start, node).collect()}
    assert got == {("n9", only)} | {("n1", p) for p in range(512) if p % 2 == 0}
    assert {r.phase for r in structure.enumerated_phases(e, signals, start, node, allow_unknown=True).where("node = 'end'").collect()} == {only}
    leaks = structure.phase_leaks(e, e.limit(0), signals, start, node).where("node = 'n9'").collect()
    assert [(r.phase, r.kind) for r in leaks] == [(only, "conduction")]


# ---------------------------------------------------------------- geometry


def test_nearest_distance(spark):
    rng = random.Random(2)
    sides = []
    for _ in range(2):
        pts = [(k, i, rng.gauss(0, 1) * 10 ** rng.randrange(3), rng.gauss(0, 1)) for k in range(4) for i in range(k * 40 + 1)]
        sides.append(pts + [(9, 0, 5.0, 5.0)] * 3 + [(9, 1, 5.0, 5.0)])
    a, b = sides
    got = {r.k: (r.chamfer, r.hausdorff) for r in pg.nearest_distance(*[spark.createDataFrame(s, "k int, id int, x double, y double") for s in sides], ["k"]).collect()}
    for k in (0, 1, 2, 3, 9):
        p, q = ({(i, x, y) for kk, i, x, y in s if kk == k} for s in (a, b))
        d = [[min(math.dist(u[1:], v[1:]) for v in w) for u in z] for z, w in ((p, q), (q, p))]
        assert got[k] == pytest.approx((sum(sum(x) / len(x) for x in d) / 2, max(map(max, d))))
    assert pg.nearest_distance(spark.createDataFrame([], "k int, id int, x double, y double"), spark.createDataFrame(a, "k int, id int, x double, y double"), ["k"]).count() == 0


def test_nearest_distance_of_large_sides(spark):
    """A hundred thousand points a side stay far from all pairs; the second side is the first, moved by half a step."""
    p = spark.range(100_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 400).cast("double").alias("x"), F.floor(F.col("id") / 400).cast("double").alias("y"))
    r = pg.nearest_distance(p, p.withColumn("x", F.col("x") + 0.25), ["k"]).first()
    assert (r.chamfer, r.hausdorff) == (0.25, 0.25)


def test_hull_and_depth(spark):
    rows = [(1, None, [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]), (2, 1, [(0, 0), (1, 0), (1, 1)]), (3, 2, [(0, 0), (1, 1), (2, 2)]), (4, 3, []), (5, 99, [(0, 0), (2, 0), (2, 2), (0, 2)])]
    rows = [(i, up, [(float(x), float(y)) for x, y in ring]) for i, up, ring in rows]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, id int, parent_id int, points array<struct<x:double,y:double>>")
    assert [r.a for r in df.orderBy("id").select(pg.hull_area(F.col("points")).alias("a")).collect()] == [16.0, 0.5, 0.0, 0.0, 4.0]
    assert {(r.id, r.depth) for r in pg.hierarchy_depth(df, ["f"]).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 1)}


def test_rings_overlap():
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    assert not pg.rings_overlap(ell, box(2, 2, 2, 2)) and pg.rings_overlap(ell, box(0.5, 0.5, 9, 9)) and pg.rings_overlap(ell, ell) and pg.rings_overlap(ell, ell[::-1])
    assert not pg.rings_overlap(box(0, 0, 1, 1), box(1, 0, 1, 1)) and pg.rings_overlap(box(0, 0, 2, 1), box(1, 0, 2, 1)) and pg.rings_overlap(box(0, 0, 9, 9), box(3, 3, 1, 1))
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(6), rng.randrange(6), rng.randrange(1, 5), rng.randrange(1, 5)] for _ in range(2))
        want = a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
        assert pg.rings_overlap(box(*a), box(*b)) == want


def test_border_distance():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 9), (7, 1), (6, 11), (12, 5)):
        mask = rng.random(shape) < 0.3
        at = np.argwhere(np.ones(shape, bool))
        want = [min((math.dist(p, q) for q in at if mask[tuple(q)] != mask[tuple(p)]), default=math.inf) for p in at]
        assert ra.border_distance(mask, 99).ravel().tolist() == pytest.approx(want)


def test_near_fingerprints_by_bands(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        base = rows[-1] if rows and rng.random() < 0.5 else (0, [rng.random(), rng.random()], "".join(rng.choice("01") for _ in range(70)), 0)
        bits = "".join(rng.choice("01") if rng.random() < 0.1 else c for c in base[2])
        rows.append((i, [x + rng.random() * 0.05 for x in base[1]], bits, i % 2))
    want = set()
    for i, f, s, c in rows:
        for j, g, t, e in rows:
            d, same = math.dist(f, g), sum(x == y for x, y in zip(s, t, strict=True)) / 70
            if i < j and c == e and (d <= 0.05 or (same >= 0.85 and d <= 0.09)):
                want.add((i, j))
    text = spark.createDataFrame(rows, "id int, features array<double>, bits string, cluster int")
    for df, length in ((text, None), (text.withColumn("bits", selection.pack_bits(F.col("bits"))), 70)):
        assert {(r.a, r.b) for r in selection.near_duplicates(df, 0.05, 0.85, length).collect()} == want and want


def test_supervised_quality(spark):
    """Equal masks score 1; shifted and empty ones follow their terms."""
    square = lambda x: [1.0 if 2 <= i // 8 < 6 and x <= i % 8 < x + 4 else 0.0 for i in range(64)]
    rows = [(0, 8, 8, square(2), square(2)), (1, 8, 8, square(3), square(2)), (2, 8, 8, [0.0] * 64, square(2)), (3, 8, 8, [0.0] * 64, [0.0] * 64)]
    got = {r.id: r for r in ra.supervised_quality(spark.createDataFrame(rows, "id int, h int, w int, pred array<double>, gt array<double>")).collect()}
    assert got[0].quality == pytest.approx(1) and got[3].quality == pytest.approx(1) and got[0].error == pytest.approx(0)
    r = got[1]
    assert (r.boundary_f1, r.hausdorff, r.count_error) == (1.0, 1.0, 0.0) and r.hausdorff_term == pytest.approx(1 - 1 / math.hypot(8, 8))
    terms = {"soft_dice": 0.20, "soft_iou": 0.15, "ssim": 0.15, "dice": 0.20, "iou": 0.10, "hausdorff_term": 0.12, "centroid": 0.08}
    assert r.quality == pytest.approx(sum(w * r[k] for k, w in terms.items())) and r.dice == pytest.approx(0.75) and r.iou == pytest.approx(0.6)
    assert (got[2].hausdorff, got[2].boundary_f1, got[2].count_error) == (math.hypot(8, 8), 0.0, 1.0) and got[2].quality < 0.2


def test_wide_truth_tables_give_a_reason(spark):
    t = spark.createDataFrame([(1, "P", "pmos", "A", "VDD", "Y"), (1, "N", "nmos", "A", "GND", "Y"), (2, "P", "pmos", "A", "VDD", "Y")], "design int, device string, kind string, gate string, source string, drain string")
    inputs = spark.createDataFrame([(1, "A")] + [(2, f"I{i}") for i in range(13)], "design int, net string")
    got = storage.truth_tables(t, inputs, spark.createDataFrame([(1, "Y"), (2, "Y")], "design int, output string")).collect()
    assert {(r.design, str(r.value), r.reason) for r in got} == {(1, "[1, 0]", None), (2, "None", "too_many_inputs")}


def test_supplies_by_name_and_by_table_agree(spark):
    rng = random.Random(5)
    names = ["VDD", "vcc1", "GND", "VSS", "a", "b", "c", "EN"]
    rows = [(d, f"T{i}", rng.choice(["nmos", "pmos"]), *rng.choices(names, k=3)) for d in range(6) for i in range(60)]
    t = spark.createDataFrame(rows, "design int, device string, kind string, gate string, source string, drain string")
    n = netlist.supplies(t.select("design", F.explode(F.array("gate", "source", "drain")).alias("net")).distinct())
    got = lambda df: sorted(map(str, df.collect()))
    assert got(netlist.cmos_inverters(t)) == got(netlist.cmos_inverters(t, n))
    assert got(netlist.controlled_switches(t)) == got(netlist.controlled_switches(t, n))
    assert got(netlist.switch_edges(t)) == got(netlist.switch_edges(t, n.where("is_power or is_ground").select("design", "net")))


@pytest.mark.parametrize("name", ["gr12_input_muxes", "gr12_async_controls", "gr16_topological_latches"])
def test_registers_move_line_items_and_orders_only(spark, name):
    from framespark.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # every exchange is that of the rows by design, before there are transistors
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("REPARTITION_BY_COL" in x for x in moved)


def test_rings_of_a_batch_are_judged_together():
    rng = np.random.default_rng(2)
    rings = [rng.integers(0, 6, (n, 2)).astype(float) for n in rng.integers(1, 8, 400)]
    alone = [bool(pg._simple_rings([r])[0]) for r in rings]
    assert pg._simple_rings(rings).tolist() == alone and 0 < sum(alone) < 400
    assert not pg._simple_rings([np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)])[0]
    got = pg._without_spikes(rings, 40.0)
    assert all(np.array_equal(g, pg._without_spikes([r], 40.0)[0]) for g, r in zip(got, rings, strict=True))
    spiked = [np.array([(0, 0), (4, 0), (4, 4), (0, 4), (-50, 0.5)], float)] * 3
    assert [len(r) for r in pg._without_spikes(spiked, 40.0)] == [4, 4, 4]


def test_groups_in_a_task_and_by_rounds_agree(spark, monkeypatch):
    """Groups that a task can hold move once; the rounds over all tasks, for larger ones, give the same rows."""
    from framespark.functions import common

    rng = random.Random(6)
    rows = [(d, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.randrange(2)) for d in range(6) for _ in range(rng.randrange(1, 30))] + [(None, "a", "b", 1)]
    e = spark.createDataFrame(rows, "design int, src string, dst string, inversion int")
    starts = spark.createDataFrame([(d, f"n{i}") for d in range(6) for i in range(3)], "design int, start string")
    boxes = spark.createDataFrame([(rng.randrange(5), i, rng.random() * 30, rng.random() * 30, 3.0, 4.0, rng.random()) for i in range(300)], "f int, id int, x double, y double, w double, h double, score double")
    controls = F.array(F.struct(F.lit("s").alias("signal"), F.col("inversion").alias("level")))
    signals = starts.select("design", F.array(F.lit("s"), F.lit("t")).alias("signals")).distinct()
    every = {
        "components": lambda: graph.connected_components(e, ("design",)), "reach": lambda: graph.reach(e, starts, ("design",)),
        "chains": lambda: netlist.toggle_chains(e.where("src <> dst")),
        "phases": lambda: structure.enumerated_phases(e.withColumn("controls", controls), signals, starts, e.select("design", F.col("dst").alias("node"))),
        "via": lambda: pg.suppress_nms(boxes, ["f"], "via").select("f", "id", "suppressed_by"), "grid": lambda: pg.suppress_nms(boxes, ["f"], "grid", 3.0).select("f", "id", "suppressed_by"),
        "match": lambda: pg.match_points(boxes.where("id < 150"), boxes.where("id >= 150"), 4.0, ["f"]),
    }
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("components", "reach", "chains", "match"):
        assert "MapInArrow" in plan(every[name]())
    moved = plan(graph.connected_components(e, ("design",)))
    assert sum("Exchange hashpartitioning" in x for x in moved.splitlines()) == 1
    got = lambda: {k: sorted(map(str, f().collect())) for k, f in every.items()}
    whole = got()
    for place, name in ((common, "GROUP_ROWS"), (graph, "GROUP_WALKS"), (structure, "GROUP_WALKS"), (netlist, "GROUP_WALKS")):
        monkeypatch.setattr(place, name, 20)
    assert got() == whole and all(whole.values())


def test_strong_components_by_rounds(spark):
    rng = random.Random(7)
    e = spark.createDataFrame([(d, rng.randrange(9), rng.randrange(9)) for d in range(4) for _ in range(12)], "design int, a int, b int")
    row = lambda df: sorted((r.design, r.node, r.component, r["size"]) for r in df.collect())
    assert row(graph._strong_by_rounds(e, ["design"])) == row(graph.strong_components(e, ("design",), "a", "b"))


def test_pairs_of_rings_are_judged_together():
    rng = np.random.default_rng(8)
    ell = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)])
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    a, b = ([(ell, box)[i % (2 + k)](*rng.integers(0, 6, 2).astype(float), *rng.integers(1, 5, 2).astype(float)) if i % (2 + k) < 2 else ell(1.0, 1.0, 2.0, 2.0) for i in range(400)] for k in (0, 1))
    got = pg.each_overlaps(a, b)
    assert got.tolist() == [pg.rings_overlap(x, y) for x, y in zip(a, b, strict=True)] and 0 < got.sum() < 400
    # an L is the union of two rectangles
    halves = lambda r: [(r[0], r[2]), (r[0], r[4])] if len(r) == 6 else [(r[0], r[2])]
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        assert got[i] == any((p[0] < q[1]).all() and (q[0] < p[1]).all() for p in halves(x) for q in halves(y))
    assert pg.each_overlaps([], []).tolist() == []


def _lookups(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_roles_are_looked_up_once_a_device(spark):
    rows = [("d", "a", "nmos", {"g": "first", "G": "second", "S": "x", "SOURCE": "y", "D": ""}), ("d", "b", "nmos", {"G": "g", "SOURCE": "x", "p2": "z"}), ("d", "c", "inv", None), ("d", "e", "inv", {})]
    # entries keep their order in a list, not in a dict
    rows = [(*r[:3], None if r[3] is None else list(r[3].items())) for r in rows]
    devices = spark.createDataFrame(rows, "design string, device string, kind string, pins array<struct<key:string,value:string>>").withColumn("pins", F.map_from_entries("pins"))
    found = {r.device: (r.gate, r.source, r.drain) for r in structure._with_pins(devices).collect()}
    assert found == {"a": ("first", "x", None), "b": ("g", "x", "z"), "c": (None,) * 3, "e": (None,) * 3}
    edges = structure.device_edges(devices)
    assert _lookups(edges) == 1
    assert {(r.src, r.dst, r.semantic) for r in edges.collect()} == {("x", "z", "conduction"), ("z", "x", "conduction"), ("g", "x", "influence"), ("g", "z", "influence")}


def test_dynamic_nodes_and_keepers_by_names_of_supplies(spark):
    rows = [("d", "P", "pmos", {"G": "CLK", "S": "VDD", "D": "n"}), ("d", "E", "nmos", {"G": "CLK", "S": "n", "D": "m"}), ("d", "I", "inv", {"A": "n", "Y": "k"}), ("d", "J", "inv", {"A": "k", "Y": "n"}), ("d", "K", "inv", {"A": "n", "Y": "one_way"})]
    edges = structure.device_edges(spark.createDataFrame(rows, "design string, device string, kind string, pins map<string,string>"))
    clocks = spark.createDataFrame([("d", "CLK")], "design string, signal string")
    dynamic = structure.dynamic_nodes(edges.where("semantic = 'conduction'"), None, clocks, spark.createDataFrame([], "design string, signal string, inverse string"))
    assert [tuple(r) for r in dynamic.collect()] == [("d", "n", "CLK", 0, ["m"])]
    keepers = structure.keepers(dynamic, edges, dynamic.limit(0))
    assert [tuple(r) for r in keepers.collect()] == [("d", "n", "k")]
    assert _lookups(keepers) <= 3


def test_fingerprint_takes_the_mean_once_a_raster(spark):
    px = [float(i % 7) for i in range(64)]
    bits = selection.fingerprint(F.col("px"), F.lit(8), F.lit(8))
    df = spark.createDataFrame([(px,), ([],), (None,)], "px array<double>").select(bits.alias("bits"))
    sample = [px[(i // 16 // 2) * 8 + i % 16 // 2] for i in range(256)]
    assert [r.bits for r in df.collect()][0] == "".join("1" if v >= sum(sample) / 256 else "0" for v in sample)
    # the mean is bound to a variable: what is joined holds no sum
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan[plan.index("array_join(") :]


def test_truth_tables_send_nothing_through_the_driver(spark):
    t = spark.createDataFrame([("d", "P", "pmos", "A", "VDD", "Y"), ("d", "N", "nmos", "A", "GND", "Y")], "design string, device string, kind string, gate string, source string, drain string")
    out = storage.truth_tables(t, spark.createDataFrame([("d", "A")], "design string, net string"), spark.createDataFrame([("d", "Y")], "design string, output string"))
    assert [tuple(r) for r in out.select("design", "output", "value", "expression").collect()] == [("d", "Y", [1, 0], "!A")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
