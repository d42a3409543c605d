"""Queries of netlist operators: a gated latch per supplier, with parts left out in some; links and graphs from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.common import laid_by
from framespark.operators import graph
from framespark.operators import netlist as op
from framespark.operators import structure
from framespark.plans.tables import table

Q, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: (device, kind, gate, source, drain) of a gated D latch.
LATCH = [
    ("P1", "pmos", "A", "VDD", "B"), ("N1", "nmos", "A", "GND", "B"), ("P2", "pmos", "B", "VDD", "A"), ("N2", "nmos", "B", "GND", "A"), ("P3", "pmos", "EN", "VDD", "ENB"),
    ("N3", "nmos", "EN", "GND", "ENB"), ("P4", "pmos", "ENB", "D", "A"), ("N4", "nmos", "EN", "D", "A"), ("P5", "pmos", "EN", "B", "A"), ("N5", "nmos", "ENB", "B", "A"),
]
_V = ", ".join(str(x) for x in LATCH)
# every third design lacks P2, every fourth N4
T_SQL = f"(select s_suppkey as design, t.* from supplier, (values {_V}) t(device, kind, gate, source, drain) where not (s_suppkey % 3 = 0 and device = 'P2') and not (s_suppkey % 4 = 0 and device = 'N4'))"
INV_SQL = f"""(select design, gate, o as out from (select design, gate, kind, case when source in ('VDD', 'GND') then drain else source end as o from {T_SQL} where (kind = 'pmos' and source = 'VDD') or (kind = 'nmos' and source = 'GND')) group by 1, 2, 3 having count(distinct kind) = 2)"""


def transistors(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("design"))
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("device", "kind", "gate", "source", "drain"), t, strict=True)]) for t in LATCH]))
    t = s.select("design", rows.alias("t")).select("design", "t.*")
    return t.where("not (design % 3 = 0 and device = 'P2') and not (design % 4 = 0 and device = 'N4')")


def nets(spark, d):
    t = transistors(spark, d)
    n = t.select("design", F.col("gate").alias("net")).union(t.select("design", "source")).union(t.select("design", "drain")).distinct()
    return op.supplies(n)


def supply_nets(spark, d):
    return nets(spark, d).where("is_power or is_ground").select("design", "net")


#: Wires and pins of a supplier's design: every line item is both, a wire on the net of its order and a pin on that net or the next one.
#: The columns of a sheet and the instances of a design have fixed numbers of names.
COLUMNS, INSTANCES = 1009, 499
_WIRES = f"(select l_suppkey as design, 'n' || l_orderkey as net, l_partkey % {COLUMNS} as x, l_linenumber as y, l_partkey % 2 as wire from lineitem)"
_PINS = f"(select l_suppkey as design, 'n' || (l_orderkey + l_linenumber % 2) as net, cast(l_partkey % {INSTANCES} as varchar) as instance, l_returnflag as port from lineitem)"


def _net(number):
    return F.concat(F.lit("n"), number.cast("string")).alias("net")


def wires(spark, d, items=None):
    c = F.col
    return (table(spark, d, "lineitem") if items is None else items).select(c("l_suppkey").alias("design"), _net(c("l_orderkey")), (c("l_partkey") % COLUMNS).alias("x"), c("l_linenumber").alias("y"), (c("l_partkey") % 2).alias("wire"))


def pins(spark, d, items=None):
    c = F.col
    return (table(spark, d, "lineitem") if items is None else items).select(c("l_suppkey").alias("design"), _net(c("l_orderkey") + c("l_linenumber") % 2), (c("l_partkey") % INSTANCES).cast("string").alias("instance"), c("l_returnflag").alias("port"))


@query("gr2_net_aliases", f"""with recursive e as (select a.design, a.net as a, b.net as b from {_WIRES} a join {_WIRES} b on a.design = b.design and a.x = b.x and a.y = b.y union select a.design, a.net, b.net from {_PINS} a join {_PINS} b on a.design = b.design and a.instance = b.instance and a.port = b.port),
 r as (select design, a, b from e union select r.design, r.a, e.b from r join e on e.design = r.design and e.a = r.b), m as (select design, a as net, min(b) as canonical from r group by 1, 2) select * from m where net in (select net from m m2 where m2.design = m.design and m2.canonical = m.canonical)""")
def gr2(spark, d):
    aliases = op.net_aliases(wires(spark, d), pins(spark, d))
    every = wires(spark, d).select("design", "net").union(pins(spark, d).select("design", "net")).distinct()
    return every.join(aliases, ["design", "net"], "left").select("design", "net", F.coalesce("canonical", "net").alias("canonical"))


@query("gr3_infer_pins", f"""with i as (select l_suppkey as design, l_orderkey || '-' || l_linenumber as instance, l_partkey % {COLUMNS} as x, l_linenumber as y, l_returnflag as f from lineitem group by 1, 2, 3, 4, 5),
 p as (select i.*, port, x + case f when 'A' then px when 'N' then -py else -px end as u, y + case f when 'A' then py when 'N' then px else -py end as v from i, (values ('G', 1, 0), ('S', 0, 1)) t(port, px, py))
 select p.design, instance, port, min(w.net) as net from p join {_WIRES} w on p.design = w.design and p.u = w.x and p.v = w.y group by 1, 2, 3""")
def gr3(spark, d):
    c = F.col
    i = table(spark, d, "lineitem").select(c("l_suppkey").alias("design"), F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("instance"), F.lit("m").alias("cell"), (c("l_partkey") % COLUMNS).alias("x"), c("l_linenumber").alias("y"), F.when(c("l_returnflag") == "A", "R0").when(c("l_returnflag") == "N", "R90").otherwise("R180").alias("orientation")).distinct()
    sym = spark.createDataFrame([("m", "G", 1, 0), ("m", "S", 0, 1)], "cell string, port string, px int, py int")
    out = op.infer_pins(i, sym, wires(spark, d), pins(spark, d).limit(0))
    return out.groupBy("design", "instance", "port").agg(F.min("net").alias("net"))


@query("gr4_supplies", f"select design, net, net = 'VDD' as is_power, net = 'GND' as is_ground from (select design, gate as net from {T_SQL} union select design, source from {T_SQL} union select design, drain from {T_SQL})")
def gr4(spark, d):
    return nets(spark, d)


#: (name) of the ports of a design; each stands at (number of the design modulo 60, 1 + its place in this list).
PORTS = ["IN1", "out_q", "CLK", "RST", "VDD", "GND", "X"]
_PORTS = f"(select s_suppkey as design, port, s_suppkey % 60 as x, i as y from supplier, (values {', '.join(f'({x!r}, {i})' for i, x in enumerate(PORTS, 1))}) t(port, i))"


def port_places(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("design"))
    return s.select("design", F.posexplode(F.array(*[F.lit(x) for x in PORTS])).alias("i", "port")).select("design", "port", (F.col("design") % 60).alias("x"), (F.col("i") + 1).alias("y"))


@query("gr4_ports", f"""select distinct design, port, net, case when port in ('IN1', 'CLK', 'RST') then 'input' when port = 'out_q' then 'output' end as direction, port = 'VDD' as is_power, port = 'GND' as is_ground from {_PORTS} join {_WIRES} w using (design, x, y)""")
def gr4_ports(spark, d):
    return op.top_ports(port_places(spark, d), wires(spark, d))


#: Ports of a design at the sheet's first columns, where several nets meet.
_SIDES = "(values ('in1', 1), ('OUT1', 2), ('IN2', 3), ('INX', 4), ('OUT10', 5), ('in2', 6)) t(port, y)"


@query("gr4_port_nets", f"""select design, case when port in ('in1', 'in2') then upper(port) else port end as port, 'n' || min(cast(net[2:] as bigint)) as net, case when port like 'OUT%' then 'output' else 'input' end as direction
 from (select s_suppkey as design, s_suppkey % 20 as x, t.* from supplier, {_SIDES}) p join (select design, net, x % 20 as x, y from {_WIRES}) w using (design, x, y) where port <> 'INX' group by 1, 2, 4""")
def gr4_port_nets(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("design"), (F.col("s_suppkey") % 20).alias("x"))
    sides = F.array(*[F.struct(F.lit(p).alias("port"), F.lit(y).alias("y")) for p, y in (("in1", 1), ("OUT1", 2), ("IN2", 3), ("INX", 4), ("OUT10", 5), ("in2", 6))])
    return op.port_nets(s.select("design", "x", F.explode(sides).alias("p")).select("design", "p.port", "x", "p.y"), wires(spark, d).withColumn("x", F.col("x") % 20))


@query("gr5_classify_devices", """select p_partkey as device, case p_partkey % 6 when 0 then 'nmos' when 1 then 'pmos' when 2 then 'nand' when 3 then 'dff' when 4 then 'xor' else 'unknown' end as kind, case p_partkey % 6 when 0 then 'switch' when 1 then 'switch' when 2 then 'gate' when 3 then 'storage' when 4 then 'gate' else 'unknown' end as domain from part""")
def gr5(spark, d):
    k = F.col("p_partkey") % 6
    p = lambda *names: F.create_map(*[F.lit(x) for n in names for x in (n, "w")])
    dev = table(spark, d, "part").select(F.lit(1).alias("design"), F.col("p_partkey").alias("device"), F.element_at(F.array(*[F.lit(x) for x in ("M1", "PMOS4", "nand2", "MYDFF", "XOR2", "BOX")]), (k + 1).cast("int")).alias("cell"), F.when(k < 2, p("GATE", "DRAIN", "SOURCE")).otherwise(p("P", "Q2")).alias("pins"))
    return op.classify_devices(dev).select("device", "kind", "domain")


@query("gr6_switch_edges", f"""select design, s as src, t as dst, sem as semantic, device from (select design, device, source as s, drain as t, 'conduction' as sem from {T_SQL} union all select design, device, drain, source, 'conduction' from {T_SQL} union all select design, device, gate, source, 'influence' from {T_SQL} union all select design, device, gate, drain, 'influence' from {T_SQL})
 where s not in ('VDD', 'GND') and t not in ('VDD', 'GND')""")
def gr6(spark, d):
    return op.switch_edges(transistors(spark, d), supply_nets(spark, d)).select("design", "src", "dst", "semantic", "device")


@query("gr7_cmos_inverters", f"select design, gate, out from {INV_SQL}")
def gr7(spark, d):
    return op.cmos_inverters(transistors(spark, d), nets(spark, d))


@query("gr8_controlled_switches", f"""select design, least(source, drain) as a, greatest(source, drain) as b, array_to_string(list_sort(list_distinct(list(gate) filter (where kind = 'nmos'))), ',') as n_gates, array_to_string(list_sort(list_distinct(list(gate) filter (where kind = 'pmos'))), ',') as p_gates, case when count(distinct kind) = 2 then 'transmission' else 'pass' end as kind
 from {T_SQL} where source not in ('VDD', 'GND') and drain not in ('VDD', 'GND') group by 1, 2, 3""".replace("array_to_string(list_sort(list_distinct(list(gate) filter (where kind = 'nmos'))), ',')", "coalesce(string_agg(distinct case when kind = 'nmos' then gate end, ','), '')").replace("array_to_string(list_sort(list_distinct(list(gate) filter (where kind = 'pmos'))), ',')", "coalesce(string_agg(distinct case when kind = 'pmos' then gate end, ','), '')"))
def gr8(spark, d):
    out = op.controlled_switches(transistors(spark, d), nets(spark, d))
    return out.withColumns({"n_gates": F.array_join("n_gates", ","), "p_gates": F.array_join("p_gates", ",")})


#: Every line item is an edge of its supplier's design, between nodes of a fixed set of names.
NODES = 211
_G = f"(select distinct l_suppkey as design, l_partkey % {NODES} as src, l_orderkey % {NODES} as dst from lineitem)"


def digraph(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("design"), (c("l_partkey") % NODES).alias("src"), (c("l_orderkey") % NODES).alias("dst")).distinct()


@query("gr9_strong_components", f"""with recursive e as {_G}, n as (select design, src as node from e union select design, dst from e), r as (select design, src as a, dst as b from e union select r.design, r.a, e.dst from r join e on e.design = r.design and e.src = r.b),
 c as (select n.design, n.node, least(n.node, min(x.b)) as component from n left join (select f.design, f.a, f.b from r f join r g on f.design = g.design and f.a = g.b and f.b = g.a) x on x.design = n.design and x.a = n.node group by n.design, n.node)
 select design, node, component, count(*) over (partition by design, component) as size from (select design, node, coalesce(component, node) as component from c)""")
def gr9(spark, d):
    return graph.strong_components(digraph(spark, d), ("design",))


@query("gr10_bistable_cores", f"select i.design, i.gate as a, i.out as b from {INV_SQL} i join {INV_SQL} j on i.design = j.design and i.gate = j.out and i.out = j.gate where i.gate < i.out")
def gr10(spark, d):
    return op.bistable_cores(op.cmos_inverters(transistors(spark, d), nets(spark, d)))


@query("gr10_parity_cores", f"""with recursive e as (select *, (src + dst) % 2 as v from {_G}), n as (select design, src as node from e union select design, dst from e), r as (select design, src as a, dst as b from e union select r.design, r.a, e.dst from r join e on e.design = r.design and e.src = r.b),
 c as (select n.design, n.node, coalesce(least(n.node, min(x.b)), n.node) as component from n left join (select f.design, f.a, f.b from r f join r g on f.design = g.design and f.a = g.b and f.b = g.a) x on x.design = n.design and x.a = n.node group by n.design, n.node),
 i as (select e.design, c.component, e.src, e.dst, e.v from e join c on c.design = e.design and c.node = e.src join c d on d.design = e.design and d.node = e.dst and d.component = c.component),
 w as (select design, component, src as a, dst as b, v as p from i union select w.design, w.component, w.a, i.dst, (w.p + i.v) % 2 from w join i on i.design = w.design and i.component = w.component and i.src = w.b)
 select design, component, bool_or(a = b and p = 0) as positive, bool_or(a = b and p = 1) as negative from w group by 1, 2""")
def gr10b(spark, d):
    e = digraph(spark, d).withColumn("inversion", ((F.col("src") + F.col("dst")) % 2).cast("int"))
    return structure.parity_cores(e, graph.strong_components(digraph(spark, d), ("design",)))


@query("gr11_clock_candidates", f"""select design, signal, n, case when signal like 'EN%' then 1 else 0 end as name_score, row_number() over (partition by design order by case when signal like 'EN%' then 1 else 0 end desc, n desc, signal) as rank from (select design, gate as signal, 2 * count(*) as n from {T_SQL} where source not in ('VDD', 'GND') and drain not in ('VDD', 'GND') group by 1, 2)""")
def gr11(spark, d):
    return op.clock_candidates(op.switch_edges(transistors(spark, d), supply_nets(spark, d)))


@query("gr11_inverse_pairs", f"select design, gate as signal, out as inverse from {INV_SQL} where gate = 'EN'")
def gr11b(spark, d):
    t = transistors(spark, d)
    sig = op.clock_candidates(op.switch_edges(t, supply_nets(spark, d)))
    return op.inverse_pairs(sig, op.cmos_inverters(t, nets(spark, d)))


@query("gr13_toggle_chains", f"""with recursive e as (select * from {_G} where src < dst), n as (select design, src, min(dst) as dst from e group by 1, 2), s as (select distinct design, src from e where not exists (select 1 from e f where f.design = e.design and f.dst = e.src)),
 r as (select design, src as start, src as at, 1 as k, cast(src as varchar) as path from s union all select r.design, r.start, n.dst, r.k + 1, r.path || ',' || n.dst from r join n on n.design = r.design and n.src = r.at)
 select design, start, path from (select *, row_number() over (partition by design, start order by k desc) as i from r) where i = 1 and k >= 2""")
def gr13(spark, d):
    out = op.toggle_chains(digraph(spark, d).where("src < dst"))
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


@query("gr14_phase_transparency", f"""with recursive e as (select design, source as s, drain as t, gate, case when kind = 'nmos' then 1 else 0 end as level from {T_SQL} where source not in ('VDD', 'GND') and drain not in ('VDD', 'GND')), f as (select * from e union all select design, t, s, gate, level from e),
 p as (select * from (values ('on', 'EN', 1), ('on', 'ENB', 0), ('off', 'EN', 0), ('off', 'ENB', 1)) v(phase, signal, level)), g as (select design, phase, s, t from f join p on f.gate = p.signal and f.level = p.level),
 r as (select distinct design, phase, t as node from g where s = 'D' union select r.design, r.phase, g.t from r join g on g.design = r.design and g.phase = r.phase and g.s = r.node) select design, phase, 'D' as "start", node from r""")
def gr14(spark, d):
    e = op.switch_edges(transistors(spark, d), supply_nets(spark, d)).where("semantic = 'conduction'")
    designs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("design"))
    ph = F.explode(F.array(*[F.struct(F.lit(a).alias("phase"), F.lit(b).alias("signal"), F.lit(c).alias("level")) for a, b, c in (("on", "EN", 1), ("on", "ENB", 0), ("off", "EN", 0), ("off", "ENB", 1))])).alias("p")
    return op.phase_transparency(e, designs.select("design", ph).select("design", "p.*"), designs.select("design", F.lit("D").alias("start")))


@query("gr14_phase_report", f"""with recursive t as (select *, case when kind = 'nmos' then 1 else 0 end as level from {T_SQL}), p as (select * from (values ('on', 'EN', 1), ('on', 'ENB', 0), ('off', 'EN', 0), ('off', 'ENB', 1)) v(phase, signal, level)), x as (select s_suppkey as design, phase, start from supplier, (values ('on'), ('off')) a(phase), (values ('D'), ('EN')) b(start)),
 c as (select 'c' as sem, design, phase, source as s, drain as t from t join p on t.gate = p.signal and t.level = p.level union all select 'c', design, phase, drain, source from t join p on t.gate = p.signal and t.level = p.level
  union all select 'i', design, phase, gate, source from t, (values ('on'), ('off')) a(phase) union all select 'i', design, phase, gate, drain from t, (values ('on'), ('off')) a(phase)), g as (select distinct * from c where s not in ('VDD', 'GND') and t not in ('VDD', 'GND')),
 r as (select sem, design, phase, start, start as node from x, (values ('c'), ('i')) k(sem) union select r.sem, r.design, r.phase, r.start, g.t from r join g on g.sem = r.sem and g.design = r.design and g.phase = r.phase and g.s = r.node),
 n as (select design, phase, count(*) filter (where sem = 'c' and node in ('A', 'B')) as conduction_paths, count(*) filter (where sem = 'i' and node in ('A', 'B')) as influence_paths from r group by 1, 2)
 select *, conduction_paths + influence_paths > 0 as transparent, case when phase = 'off' then conduction_paths + influence_paths = 0 end as hold_isolated from n""")
def gr14_report(spark, d):
    e = op.switch_edges(transistors(spark, d), supply_nets(spark, d))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("design"))
    each = lambda name, *values: s.select("design", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    levels = F.explode(F.array(*[F.struct(F.lit(a).alias("phase"), F.lit(b).alias("signal"), F.lit(c).alias("level")) for a, b, c in (("on", "EN", 1), ("on", "ENB", 0), ("off", "EN", 0), ("off", "ENB", 1))])).alias("p")
    return op.phase_report(e.where("semantic = 'conduction'"), e.where("semantic = 'influence'"), s.select("design", levels).select("design", "p.*"), each("start", "D", "EN"), each("node", "A", "B"), each("phase", "off"))


@query("gr15_classify_storage", """select p_partkey as device, case p_partkey % 5 when 0 then 'd_flip_flop' when 1 then 'jk_flip_flop' when 2 then 't_flip_flop' when 3 then 'gated_d_latch' else 'rs_latch' end as structure, case p_partkey % 5 when 0 then 'sync_reset' when 1 then '' when 2 then '' when 3 then 'enable' else 'async_reset' end as features from part""")
def gr15(spark, d):
    k = F.col("p_partkey") % 5
    p = lambda *names: F.create_map(*[F.lit(x) for n in names for x in (n, "w")])
    shapes = F.when(k == 0, p("D", "Q", "CLK", "SCLR")).when(k == 1, p("J", "K", "Q", "CLK")).when(k == 2, p("T", "Q", "CLK")).when(k == 3, p("D", "Q", "EN")).otherwise(p("S", "R", "CLR"))
    dev = table(spark, d, "part").select(F.lit(1).alias("design"), F.col("p_partkey").alias("device"), shapes.alias("pins"), F.when(k < 3, "dff").otherwise("latch").alias("kind"), F.lit("storage").alias("domain"))
    return op.classify_storage(dev).select("device", "structure", F.array_join("features", ",").alias("features"))


@query("gr17_logic_cone", f"""with recursive t as (select * from {T_SQL}), e as (select design, source as s, drain as d from t union select design, drain, source from t union select design, source, gate from t union select design, drain, gate from t), f as (select * from e where s not in ('VDD', 'GND') and d not in ('VDD', 'GND')),
 r as (select design, d as node from f where s = 'A' union select r.design, f.d from r join f on f.design = r.design and f.s = r.node) select design, 'A' as "start", node from r""")
def gr17(spark, d):
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("design"), F.lit("A").alias("start"))
    return op.logic_cone(transistors(spark, d), starts, supply_nets(spark, d))


#: Instances of pins' designs; every eleventh lacks a view, and cell c6 has no symbol.
_INSTANCES = f"(select distinct l_suppkey as design, cast(l_partkey % {INSTANCES} as varchar) as instance, 'c' || l_partkey % {INSTANCES} % 7 as cell, case when l_partkey % {INSTANCES} % 11 <> 0 then 'symbol' end as view from lineitem)"


@query("gr19_netlist_diagnostics", f"""with n as (select design, net from {_WIRES} union select design, net from {_PINS}) select distinct design, code, name from (select design, 'net_without_pins' as code, net as name from n where not exists (select 1 from {_PINS} p where p.design = n.design and p.net = n.net)
 union all select design, 'net_without_wires', net from n where not exists (select 1 from {_WIRES} p where p.design = n.design and p.net = n.net) union all select design, 'duplicate_net', net from n where net like '%7' union all select distinct design, 'port_without_location', 'IN1' from n where design % 2 = 0
 union all select design, 'degenerate_wire', net from {_WIRES} group by design, net, wire having count(*) = 1 union all select distinct design, 'no_output_ports', '' from n where design % 5 = 0
 union all select design, case when view is null then 'missing_symbol_reference' else 'unresolved_symbol' end, instance from {_INSTANCES} where view is null or cell = 'c6')""")
def gr19(spark, d):
    # a supplier's few hundred line items go to one task, and what is made of them stays there
    items = laid_by(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "l_suppkey")
    w, p = wires(spark, d, items), pins(spark, d, items)
    n = w.select("design", "net").union(p.select("design", "net")).distinct()
    designs = w.select("design").union(p.select("design")).distinct()
    inputs = designs.select("design", F.lit("IN1").alias("port"), F.when(F.col("design") % 2 == 1, 1).alias("x"), F.lit(1).alias("y"))
    outputs = designs.where("design % 5 <> 0").select("design", F.lit("OUT1"), F.lit(2), F.lit(1))
    k = F.col("instance").cast("int")
    used = p.select("design", "instance", F.lit("lib").alias("library"), F.concat(F.lit("c"), (k % 7).cast("string")).alias("cell"), F.when(k % 11 != 0, "symbol").alias("view")).distinct()
    symbols = used.where("view is not null and cell <> 'c6'").select("library", "cell", "view").distinct()
    return op.netlist_diagnostics(n.withColumn("_i", F.explode(F.expr("if(net like '%7', array(1, 2), array(1))"))).drop("_i"), p, w, inputs.union(outputs), used, symbols)


@query("gr20_structure_report", f"""with recursive e as {_G}, n as (select design, src as node from e union select design, dst from e), r as (select design, src as a, dst as b from e union select r.design, r.a, e.dst from r join e on e.design = r.design and e.src = r.b),
 c as (select n.design, n.node, coalesce(least(n.node, min(x.b)), n.node) as component from n left join (select f.design, f.a, f.b from r f join r g on f.design = g.design and f.a = g.b and f.b = g.a) x on x.design = n.design and x.a = n.node group by n.design, n.node),
 s as (select design, component from c group by 1, 2 having count(*) > 1), d as (select p_partkey % 100 as design, case when p_partkey % 3 = 0 then 'enable' end as feature from part)
 select x.design, '{{"nodes":' || x.nodes || ',"edges":' || (select count(*) from e where e.design = x.design) || ',"scc":' || (select count(*) from s where s.design = x.design)
  || case when exists (select 1 from d where d.design = x.design) then ',"storage":{{"d_flip_flop":' || (select count(*) from d where d.design = x.design) || '}}' else '' end
  || case when exists (select 1 from d where d.design = x.design and feature is not null) then ',"features":{{"enable":' || (select count(feature) from d where d.design = x.design) || '}}' else '' end || '}}' as report from (select design, count(*) as nodes from n group by 1) x""")
def gr20(spark, d):
    g = digraph(spark, d)
    scc = graph.strong_components(g, ("design",))
    pins = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("D"), F.lit("w"), F.lit("CE"), F.lit("w"))).otherwise(F.create_map(F.lit("D"), F.lit("w")))
    st = op.classify_storage(table(spark, d, "part").select((F.col("p_partkey") % 100).alias("design"), F.col("p_partkey").alias("device"), pins.alias("pins"), F.lit("dff").alias("kind"), F.lit("storage").alias("domain")))
    return op.structure_report(scc.select("design", "node"), g, scc, st)
