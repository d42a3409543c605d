"""The library's operators: literal cases, and every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from framespark.operators import frames, netlist, scoring, selection
from framespark.operators import polygons as pg
from framespark.operators import rasters as ra
from framespark.plans import registry, sources
from framespark.sources import files
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of many small jobs; the driver checks it, here it would take minutes.
SLOW = {"se13_bootstrap_sample"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in registry.oracle_sql():
        res = duck.sql(registry.oracle_sql()[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ranges(spark):
    got = frames.parse_frame_ranges(one(spark, [("10-12;20:21,30",), ("7-3",)], "expr string")).orderBy("expr", "pos").collect()
    assert [(r.start, r.end) for r in got] == [(10, 12), (20, 21), (30, 30), (3, 7)]
    for bad in ("1-a", "1,,2", "1-2-3"):
        with pytest.raises(Exception, match="bad frame range"):
            frames.parse_frame_ranges(one(spark, [(bad,)], "expr string")).collect()


@pytest.mark.parametrize(("mode", "bounds", "want"), [("full_range", [(1, 3), (3, 4)], [1, 2, 3, 4]), ("rectangle", [(1, 12)], [1, 2, 11, 12]), ("rectangle", [(8, 13)], [*range(3, 9), *range(13, 19)]), ("area", [(3, 17)], [*range(3, 8), *range(13, 18)])])
def test_select_frames(spark, mode, bounds, want):
    got = frames.select_frames(spark.range(1, 40).withColumnRenamed("id", "frame"), one(spark, bounds, "start long, end long"), mode, 10)
    assert sorted(r.frame for r in got.collect()) == want


def test_frame_numbers(spark):
    df = one(spark, [("xxxx_1.png",), ("xxxx_1237.tif",), ("sample_name_00042.jpg",), ("sample_name.jpg",)], "n string").select("n", frames.frame_number(F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == [1, 1237, 42, None]
    order = one(spark, [("demo_10",), ("demo_2",), ("demo_1237",), ("demo_1",)], "n string").orderBy(frames.natural_key(F.col("n")))
    assert [r.n for r in order.collect()] == ["demo_1", "demo_2", "demo_10", "demo_1237"]


def test_author_quality(spark):
    got = frames.author_quality(one(spark, [(1, 101), (2, 102), (3, 103), (4, 104)], "frame long, vector_no long"), one(spark, [("Alice", 1), ("Alice", 2), ("Bob", 3), ("Bob", 4)], "author string, frame long"), one(spark, [(102, False), (103, False), (101, True)], "number long, is_correct boolean"))
    assert {r.author: (r.n_wrong, r.wrong_percent) for r in got.collect()} == {"Alice": (1, 50.0), "Bob": (1, 50.0)}


def test_quality_gates(spark):
    names = list(scoring.GATES)
    df = one(spark, [(0.92, 0.86, 0.94, 0.6, 1.3), (0.70, 0.79, 0.82, 2.2, 2.8)], ", ".join(f"{n} double" for n in names))
    got = scoring.quality_gates(df).collect()
    assert [(r.passed, r.failures) for r in got] == [(True, []), (False, names)]


def test_cif(spark):
    text = one(spark, [("f", "( R sample.png );\n( S 32 32 );\nP 4 28 24 28 24 12 4 12 4 28;\nDF;\nE\n")], "path string, value string")
    r = files.parse_cif(text).withColumn("m", pg.polygon_metrics(F.col("points"))).first()
    assert [(p.x, p.y) for p in r.points] == [(4, 4), (24, 4), (24, 20), (4, 20)] and r.m.area == 320 and r.category == "conductor"
    with pytest.raises(Exception, match="before the size"):
        files.parse_cif(one(spark, [("f", "P 1 2 3 4 5 6;")], "path string, value string")).collect()


def test_patches(spark):
    r = one(spark, [(1, 6, 4, [1.0] * 24), (2, 2, 2, [1.0] * 4)], "k long, h int, w int, px array<double>")
    back = ra.stitch_patches(ra.cut_patches(r, 3, 1, ["k"]), 3, 1, ["k"]).orderBy("k").collect()
    assert [x.px for x in back] == [[1.0] * 24, [1.0] * 4]
    ring = one(spark, [(1, 3, 3, [1.0] * 4 + [0.0] + [1.0] * 4)], "k long, h int, w int, px array<double>")
    assert ra.apply_steps(ring, [{"name": "close"}], "k long").first().px == [1.0] * 9
    n = selection.patch_counts(one(spark, [(32, 32)], "h int, w int"), 16, 16)
    assert n.first().n_patches == 4


def test_spikes_and_rings(spark):
    ring = [(0.0, 0.0), (30.0, 0.0), (30.1, -35.0), (30.2, 0.0), (60.0, 0.0), (60.0, 40.0), (0.0, 40.0)]
    df = one(spark, [([{"x": x, "y": y} for x, y in ring],)], "points array<struct<x:double,y:double>>")
    n = df.select(F.size(pg.remove_spikes(F.col("points"), 40.0)).alias("n")).first().n
    assert 4 <= n < 7


def test_latch(spark):
    from framespark.plans.netlist import LATCH

    t = one(spark, [(1, *x) for x in LATCH], "design int, device string, kind string, gate string, source string, drain string")
    nets = netlist.supplies(t.select("design", F.explode(F.array("gate", "source", "drain")).alias("net")).distinct())
    inv = netlist.cmos_inverters(t, nets)
    assert {(r.gate, r.out) for r in inv.collect()} == {("A", "B"), ("B", "A"), ("EN", "ENB")}
    assert [(r.a, r.b) for r in netlist.bistable_cores(inv).collect()] == [("A", "B")]


def test_rarity_beyond_small_tables(spark):
    """More rows than one cell or slab, with equal rows and an outlier, against all distances."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(1400, 3)), np.tile([[0.5, 0.5, 0.5]], (100, 1)), [[50.0, 0.0, 0.0]]])
    df = one(spark, [(i, f.tolist()) for i, f in enumerate(x)], "id long, features array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :5].mean(1)
    want = (mean - mean.min()) / (mean.max() - mean.min())
    got = {r.id: r.rarity for r in selection.rarity(df).collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want)
    near = {r.id: r.distances for r in selection.nearest_distances(df, block=16).collect()}
    assert np.allclose([near[i] for i in range(len(x))], np.sort(d, axis=1)[:, :5])
    assert selection.nearest_distances(df.limit(1)).first().distances == []


def test_select_diverse_without_groups_in_pandas(spark):
    """Equal to greedy picks one by one, and no task holds a cluster."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, i % 10 // 8, float(rng.random()), float(rng.random()), np.round(rng.random(3), 1).tolist()) for i in range(300)]
    df = one(spark, rows, "id long, cluster int, priority double, structure double, features array<double>")
    want = set()
    for cluster, quota in ((0, 9), (1, 4)):
        mine = [r for r in rows if r[1] == cluster]
        x = np.array([r[4] for r in mine])
        scale, out = np.linalg.norm(x.max(0) - x.min(0)), []
        for k in range(quota):
            near = [min((np.linalg.norm(x[i] - x[j]) for j in out), default=scale) for i in range(len(x))]
            value = [0.6 * r[2] + 0.1 * r[3] + 0.4 * near[i] / scale - 0.2 * (near[i] < 1e-6) if i not in out else -9 for i, r in enumerate(mine)]
            out.append(int(np.argmax(value)))
            want.add((mine[out[-1]][0], cluster, k + 1))
    got = selection.select_diverse(df, one(spark, [(0, 9), (1, 4), (2, 3)], "cluster int, quota int"))
    assert {tuple(r) for r in got.collect()} == want
    assert "Pandas" not in got._jdf.queryExecution().toString()


def test_selection_lines(spark, tmp_path):
    df = one(spark, [(1, 0.5, 1.0, "primary"), (2, 0.4, 0.9, "neighbor"), (3, 0.3, 0.8, "primary")], "frame long, score double, percentile double, reason string")
    files.write_selection(df, f"{tmp_path}/m")
    back = spark.read.text(f"{tmp_path}/m").select("reason", F.get_json_object("value", "$.frame").alias("frame"))
    assert sorted(map(tuple, back.collect())) == [("neighbor", "2"), ("primary", "1"), ("primary", "3")]


def test_stream_equals_batch(spark):
    got = sorted(map(tuple, sources.Q["st2_stream_loss_weights"](spark, SF).collect()))
    assert got == sorted(map(tuple, sources.batch_loss_weights(spark, SF).collect()))


def test_pattern_vectors(spark):
    import numpy as np

    from framespark.operators import patterns

    rng = np.random.default_rng(0)

    def flood(mask):
        todo, areas = {tuple(p) for p in np.argwhere(mask)}, []
        while todo:
            edge, n = [todo.pop()], 0
            while edge:
                y, x = edge.pop()
                n += 1
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if p in todo:
                        todo.remove(p)
                        edge.append(p)
            areas.append(n)
        return sorted(areas)

    for _ in range(20):
        mask = rng.random((rng.integers(1, 20), rng.integers(1, 20))) < 0.6
        assert sorted(patterns.component_areas(mask)) == flood(mask)
    levels = np.zeros(256)
    levels[[10, 12, 200]] = 5
    assert 12 <= patterns.otsu(levels) < 200
    flat, bars = np.full((10, 12), 90.0), np.zeros((32, 32))
    bars[:, ::4] = 255
    image = spark.createDataFrame([(i, g.ravel().tolist(), *g.shape) for i, g in enumerate((flat, bars))], "id long, px array<double>, h int, w int")
    got = {r.id: r for r in patterns.pattern_vectors(image, "id long").collect()}
    assert len(got[0].hardness) == 11 and len(got[0].pattern) == 33 and got[0].pattern[2] == 1 and got[0].hardness[:3] == [0, 0, 0]
    p = dict(zip(patterns.PATTERN, got[1].pattern[8:], strict=True))
    # eight bars of 32 pixels, a quarter of the image, of period four along the rows
    assert p["many"] == 8 / 24 and p["mean_area"] == 1 / 32 and p["active"] == 0.25 and p["saturation"] == 1 and p["turns_y"] == 0
    assert p["axis_bias"] == 1 and p["row_std"] == 0 and abs(p["col_period"] - 0.5) < 0.2 and got[1].edge > 0.4
    assert patterns.pattern_vectors(image.limit(0), "id long").count() == 0


def test_flip_flops_are_the_greedy_pairs(spark, tmp_path):
    from framespark.functions.common import stash
    from framespark.operators import storage
    from framespark.plans import storage as plan

    t, inverters, switches, _ = plan._parts(spark, SF)
    inverters = stash(inverters, f"{tmp_path}/inverters")
    latches = stash(storage.topological_latches(inverters, switches), f"{tmp_path}/latches")
    outputs = t.limit(0).select("design", t.gate.alias("net"))
    pairs = storage.latch_pairs(latches, inverters, outputs).collect()
    used, want = set(), set()
    for p in sorted(pairs, key=lambda p: (-p.score, not p.drives, p.master, p.slave)):
        ends = {(p.design, p.master), (p.design, p.slave)}
        if not ends & used:
            used |= ends
            want.add((p.design, p.master, p.slave))
    got = storage.flip_flops(latches, inverters, outputs).collect()
    assert len(got) == len(want) > 100 and {(r.design, r.master, r.slave) for r in got} == want
    by_name = {(r.design, r.a): r for r in latches.collect()}
    for r in got:
        slave, master = by_name[r.design, r.slave], by_name[r.design, r.master]
        assert r.clock == slave.enable != master.enable and r.edge == ("rising" if slave.level == "high" else "falling")


def test_expressions_of_truth_tables():
    """Literal cases; and each expression of random tables has the table's values and is no longer than its sum of products."""
    import itertools
    import random
    import re

    from framespark.operators.storage import expression_of

    cases = {"10": "!A", "1110": "!A | !B", "1000": "!A & !B", "0110": "A ^ B", "1001": "!(A ^ B)", "01101001": "A ^ B ^ C", "00000000": "0", "11": "1", "0011": "A", "00010111": "(B & C) | (A & C) | (A & B)"}
    for table, want in cases.items():
        got = expression_of([int(v) for v in table], list("ABC")[: len(table).bit_length() - 1])
        assert got == want or sorted(got.split(" | ")) == sorted(want.split(" | "))
    assert expression_of([0, None], ["A"]) is None
    rng = random.Random(7)
    for n in (1, 2, 3, 4, 5):
        for _ in range(30):
            value = [rng.randrange(2) for _ in range(1 << n)]
            text = expression_of(value, [f"x{i}" for i in range(n)])
            env = lambda bits: {f"x{i}": b for i, b in enumerate(bits)}
            code = re.sub(r"!x(\d)", r"(1 - x\1)", text).replace("!(", "1 - (")
            assert [eval(code, {}, env(bits)) for bits in itertools.product((0, 1), repeat=n)] == value
            assert text.count("&") + text.count("|") <= max(sum(value) * n - 1, 0)


def test_storage_elements(spark):
    """Each latch is in one element: in its flip-flop, or by itself; lists are in natural order."""
    from framespark.operators import storage

    latches = one(
        spark, [(1, "A9", "B10", "EN", "high", ["D10", "D9"]), (1, "A10", "B2", "ENB", "high", ["B10"]), (1, "A3", "B3", "EN", "low", ["X"]), (2, "A9", "B9", "G", "low", ["D"])],
        "design int, a string, b string, enable string, level string, data array<string>",
    )
    pairs = one(spark, [(1, "A9", "A10", "ENB", "rising")], "design int, master string, slave string, clock string, edge string")
    got = {(r.design, r.a): tuple(r)[1:] for r in storage.storage_elements(latches, pairs).collect()}
    assert got == {
        (1, "A9"): ("flip_flop", "A9", "A10", "ENB", "edge", "rising", ["D10", "D9"], ["A10", "B2"], ["A9", "A10", "B2", "B10"]),
        (1, "A3"): ("latch", "A3", "B3", "EN", "level", "low", ["X"], ["A3", "B3"], ["A3", "B3"]),
        (2, "A9"): ("latch", "A9", "B9", "G", "level", "low", ["D"], ["A9", "B9"], ["A9", "B9"]),
    }


def test_ports_take_the_first_net_in_natural_order(spark):
    wires = one(spark, [(1, 0, 0, "n10"), (1, 0, 0, "n9"), (1, 5, 5, "n1"), (2, 0, 0, "z")], "design int, x int, y int, net string")
    ports = one(spark, [(1, "in1", 0, 0), (1, "OUT2", 5, 5), (1, "CLK", 5, 5), (1, "IN3", 7, 7), (2, "IN_1", 0, 0), (2, "out1", 0, 0), (2, "IN4", None, None)], "design int, port string, x int, y int")
    got = {tuple(r) for r in netlist.port_nets(ports, wires).collect()}
    assert got == {(1, "IN1", "n9", "input"), (1, "OUT2", "n1", "output"), (2, "out1", "z", "output")}


def test_truth_tables_of_unknown_and_fought_outputs(spark):
    from framespark.operators import storage

    rows = [
        (1, "P1", "pmos", "A", "VDD", "Y"), (1, "N1", "nmos", "A", "GND", "Y"),  # inverter
        (2, "P1", "pmos", "A", "VDD", "Y"), (2, "N1", "nmos", "B", "GND", "Y"),  # fights or floats
        (3, "P1", "pmos", "GND", "VDD", "Y"), (3, "N1", "nmos", "A", "q", "r"),  # tied
        (4, "N1", "nmos", "A", "B", "m"), (4, "P1", "pmos", "m", "VDD", "Y"), (4, "N2", "nmos", "A", "Y", "n"), (4, "N3", "nmos", "m", "n", "GND"),  # a gate that is unknown
    ]
    t = spark.createDataFrame(rows, "design long, device string, kind string, gate string, source string, drain string")
    inputs = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, "A"), (4, "A"), (4, "B")] + [(5, f"I{i}") for i in range(13)], "design long, net string")
    outputs = spark.createDataFrame([(i, "Y") for i in range(1, 6)], "design long, output string")
    got = {r.design: r for r in storage.truth_tables(t, inputs, outputs).collect()}
    assert got[1].value == [1, 0] and got[1].sop == "!A" and got[1].depends_on == ["A"]
    assert got[2].value == [1, None, None, 0] and got[2].sop is None and got[2].depends_on is None
    assert got[3].value == [1, 1] and got[3].sop == "1" and got[3].depends_on == []
    assert got[4].value == [1, 1, 1, 0] and got[4].sop == "!A & !B | !A & B | A & !B" and got[4].depends_on == ["A", "B"]
    assert got[5].value is None and got[5].reason == "too_many_inputs"
    assert [got[i].expression for i in range(1, 6)] == ["!A", None, "1", "!A | !B", None]


def test_frames_with_one_side(spark):
    from framespark.operators import polygons

    point = "f long, id long, x double, y double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 5.0, 5.0)], point)
    b = spark.createDataFrame([(1, 7, 3.0, 4.0), (3, 1, 5.0, 5.0)], point)
    frames = spark.createDataFrame([(i, 6, 8) for i in (1, 2, 3, 4)], "f long, w int, h int")
    got = {r.f: (r.chamfer, r.hausdorff) for r in polygons.frame_distance(a, b, frames, ["f"]).collect()}
    assert got == {1: (5.0, 5.0), 2: (10.0, 10.0), 3: (10.0, 10.0), 4: (0.0, 0.0)}


def test_ports_phases_and_diagnostics(spark):
    wires = spark.createDataFrame([(1, "a", 0, 0, 0), (1, "a", 0, 1, 0), (1, "b", 0, 1, 0), (2, "c", 0, 9, 9)], "design long, net string, wire long, x long, y long")
    ports = spark.createDataFrame([(1, "in1", 1, 0), (1, "VDD", 0, 0), (1, "XCLOCK", 0, 0), (1, "OUT2", 5, 5), (1, "OUT3", None, None)], "design long, port string, x long, y long")
    got = {(r.port, r.net, r.direction, r.is_power) for r in netlist.top_ports(ports, wires).collect()}
    assert got == {("in1", "a", "input", False), ("in1", "b", "input", False), ("VDD", "a", None, True), ("XCLOCK", "a", None, False)}

    nets = wires.select("design", "net").distinct()
    pins = nets.withColumn("instance", F.lit("i"))
    inst = spark.createDataFrame([(1, "u", "l", "c", "v"), (1, "w", "l", "c", None), (1, "z", "l", "d", "v")], "design long, instance string, library string, cell string, view string")
    views = spark.createDataFrame([("l", "c", "v")], "library string, cell string, view string")
    got = {(r.design, r.code, r.name) for r in netlist.netlist_diagnostics(nets, pins, wires, ports, inst, views).collect()}
    assert got == {
        (1, "degenerate_wire", "b"), (2, "degenerate_wire", "c"), (1, "port_without_location", "OUT3"), (2, "no_input_ports", ""), (2, "no_output_ports", ""),
        (1, "missing_symbol_reference", "w"), (1, "unresolved_symbol", "z"),
    }

    edges = spark.createDataFrame([(1, "D", "Q", "EN", 1), (1, "Q", "P", "X", 1)], "design long, src string, dst string, control string, level int")
    phases = spark.createDataFrame([(1, "on", "EN", 1), (1, "off", "EN", 0)], "design long, phase string, signal string, level int")
    one_of = lambda name, v: spark.createDataFrame([(1, v)], f"design long, {name} string")
    rows = netlist.phase_report(edges, edges.limit(0), phases, one_of("start", "D"), one_of("node", "Q"), one_of("phase", "off")).collect()
    assert {(r.phase, r.conduction_paths, r.transparent, r.hold_isolated) for r in rows} == {("on", 1, True, None), ("off", 0, False, True)}
