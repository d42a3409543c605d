"""Findings of round 3: each test fails on the code before its finding."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from framespark.operators import netlist, selection
from framespark.plans import selection as selection_plans


def test_diagnostics_judge_each_net_once(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    nets = t([(1, "a"), (1, "a"), (1, "b"), (1, None), (None, "c")], "design long, net string")
    pins = t([(1, "a"), (1, None), (None, "c")], "design long, net string")
    wires = t([(1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "b", 2), (1, "z", 1)], "design long, net string, wire long")
    ports = t([(1, "IN1", 1, 1), (1, "OUT1", 1, 1)], "design long, port string, x long, y long")
    out = netlist.netlist_diagnostics(nets, pins, wires, ports)
    got = sorted(((r.design, r.code, r.name) for r in out.collect()), key=str)
    want = [
        (1, "degenerate_wire", "b"), (1, "degenerate_wire", "z"), (1, "duplicate_net", "a"), (1, "net_without_pins", "b"), (1, "net_without_pins", None), (1, "net_without_wires", None),
        (None, "info", "no problems"), (None, "net_without_pins", "c"), (None, "net_without_wires", "c"), (None, "no_input_ports", ""), (None, "no_output_ports", ""),
    ]
    assert got == sorted(want, key=str)
    # nets meet pins and wires in one grouping, by no join on their names
    assert "net#" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)


def test_cluster_means_add_rows_in_the_order_of_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    files, parts, each = 4, 300, 7
    tax = rng.integers(0, 6, (parts, files * each // 2)) / 100
    tax = rng.permuted(np.concatenate((tax, 0.1 - tax), axis=1).round(2), axis=1)  # means of 0.05
    (tmp_path / "lineitem.parquet").mkdir()
    for f in range(files):
        n = parts * each
        key = np.repeat(np.arange(parts), each)
        cols = {"l_orderkey": key, "l_linenumber": np.arange(n), "l_partkey": key, "l_quantity": np.full(n, 25.0), "l_discount": np.full(n, 0.08), "l_tax": tax[:, f * each : (f + 1) * each].ravel()}
        pq.write_table(pa.table(cols), tmp_path / "lineitem.parquet" / f"{f}.parquet")

    def name(values):
        mean = lambda v: float(np.cumsum(v)[-1]) / len(v)  # noqa: E731  # one by one
        return "blur_or_low_detail" if mean(values) * 2 < 0.1 else "exposure" if mean(values * 6) > 0.3 else "mixed"

    got = {r.cluster: r.name for r in selection_plans.Q["se7_label_clusters"](spark, str(tmp_path)).collect()}
    assert got == {i: name(tax[i]) for i in range(parts)}


def test_nearest_distances_hold_no_object_a_row(spark):
    x = np.random.default_rng(5).normal(size=(90, 4)).round(3)
    df = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(x)], "id string, features array<double>")
    out = selection.nearest_distances(df, block=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.where(np.eye(90), np.inf, 0)
    for r in out.collect():
        assert np.allclose(r.distances, np.sort(d[int(r.id[1:])])[:5])


def test_near_duplicates_meet_once_where_bands_tell_little(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(scale=0.12, size=(120, 3)).round(4)
    bits = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in x]
    df = spark.createDataFrame([(i, x[i].tolist(), bits[i] if i % 9 else None, i % 2) for i in range(120)], "id long, features array<double>, bits string, cluster long")
    out = selection.near_duplicates(df, 0.1, 0.1)
    assert "xxhash64" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for i in range(120):
        for j in range(i + 2, 120, 2):
            d = float(np.sqrt(((x[i] - x[j]) ** 2).sum()))
            same = sum(p == q for p, q in zip(bits[i], bits[j], strict=True)) / 32 if i % 9 and j % 9 else 0
            if d <= 0.1 or (same >= 0.1 and d <= 0.18):
                want.add((i, j))
    assert want and sorted((r.a, r.b) for r in out.collect()) == sorted(want)
