"""Hand-made cases, sequential replays and skewed keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voltgrain.functions import logic, lut, names
from voltgrain.operators import checks, constraints, events as ev, graph as gr, library, parasitics as ps, power as pw
from voltgrain.operators.ordered import ordered, plan_block_ticks, time_block
from voltgrain.sources import rcnet, trace
from voltgrain.streaming import power_stream as st

EV = "sig_id bigint, gate bigint, pin_idx int, t bigint, seq bigint, v int"


def log(spark, rows):
    return spark.createDataFrame([(g * 3 + p, g, p, t, i, v) for i, (g, p, t, v) in enumerate(rows)], EV)


def random_log(n, gates, span, hot, seed=7):
    """Rows of a log in which gate 0 holds the share ``hot``."""
    r = random.Random(seed)
    return [(0 if r.random() < hot else r.randrange(1, gates), r.randrange(3), r.randrange(span), r.randrange(4)) for _ in range(n)]


def replay(rows):
    """Clean changes per signal, one event after the other."""
    per = defaultdict(dict)
    for i, (g, p, t, v) in enumerate(rows):
        per[(g, p)][t] = v   # the last row of a tick wins
    out = {}
    for k, ch in per.items():
        seq = sorted(ch.items())
        if seq[0][0] > 0:
            seq = [(0, 2)] + seq
        kept = []
        for t, v in seq:
            if not kept or kept[-1][1] != v:
                kept.append((t, v))
        out[k] = kept
    return out


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_changes_state_and_leakage_match_a_replay(spark, block):
    rows = random_log(1500, 6, 1000, 0.5)
    want = replay(rows)
    ch = ev.dedup_changes(log(spark, rows), block)
    got = defaultdict(list)
    for r in sorted(ch.collect(), key=lambda r: r.t):
        got[(r.gate, r.pin_idx)].append((r.t, r.v))
    assert got == want

    ticks = ev.gate_ticks(ch)
    seen = {(r.gate, r.t): (r.state_before, r.state_after) for r in ticks.collect()}
    exp, hold = {}, defaultdict(int)
    for g in {k[0] for k in want}:
        at = sorted({t for (gg, _), s in want.items() if gg == g for t, _ in s})
        state, vals = 0, {p: dict(want.get((g, p), [])) for p in range(3)}
        cur = {}
        for i, t in enumerate(at):
            before = state
            for p in range(3):
                if t in vals[p]:
                    cur[p] = vals[p][t]
            state = sum((cur.get(p) == 1) << p for p in range(3))
            exp[(g, t)] = (before, state)
            hold[g] += (10 + state) * ((at[i + 1] if i + 1 < len(at) else 1000) - t)
    assert seen == exp

    table = spark.createDataFrame([("c", s, 10.0 + s) for s in range(8)], "cell_name string, state int, power double")
    gates = ch.select("gate").distinct().withColumn("cell_name", F.lit("c"))
    iv = pw.leakage_intervals(pw.hold_intervals(ticks, F.lit(1000)), gates, table)
    leak = {r.gate: r.leakage for r in pw.leakage_per_gate(iv, F.lit(1000)).collect()}
    assert leak == pytest.approx({g: x / 1000 for g, x in hold.items()})
    cyc = pw.leakage_per_cycle(iv, 30, 4)
    assert sum(r.leakage for r in cyc.collect()) * 30 == pytest.approx(sum(hold.values()))


def test_causes_match_a_replay(spark):
    rows = random_log(800, 4, 600, 0.5, seed=3)
    want = replay(rows)
    out = ev.asof_inputs(ev.dedup_changes(log(spark, rows), 50), 2).filter("pv is not null").collect()
    assert out
    for r in out:
        for k in (0, 1):
            earlier = [c for c in want.get((r.gate, k), []) if c[0] < r.t]
            got = r[f"in{k}"]
            if earlier:
                assert (got.t, got.v) == earlier[-1]
            elif (r.gate, k) in want:
                assert (got.t, got.v) == want[(r.gate, k)][0]
            else:
                assert got is None


def test_causes_of_an_uncleaned_log_fall_back_to_the_first_change(spark):
    rows = log(spark, [(0, 2, 0, 0), (0, 2, 5, 1), (0, 0, 5, 1), (0, 0, 8, 0), (0, 1, 2, 1)]).withColumns(
        {"blk": time_block("t", 4), "pv": F.when(F.col("t").isin(5, 8) & F.col("pin_idx").isin(2, 0), 1 - F.col("v"))})
    r = ev.asof_inputs(rows, 2, first_fallback=True).filter("t = 5").first()
    assert (r.in0.t, r.in0.v, r.in1.t) == (5, 1, 2)
    assert ev.asof_inputs(rows, 2).filter("t = 5").first().in0 is None


def test_glitches_by_hand(spark):
    # Cycle 10: one regular change, one pair, then three (the last of three stays regular).
    rows = [(0, 0, 0, 0), (0, 0, 3, 1), (0, 0, 12, 0), (0, 0, 15, 1), (0, 0, 21, 0), (0, 0, 25, 1), (0, 0, 29, 0)]
    g = ev.glitch_width(ev.glitch_flags(ev.dedup_changes(log(spark, rows), 10), 10))
    got = {r.t: (r.glitch, r.pulse) for r in g.collect()}
    assert got == {0: (False, None), 3: (False, None), 12: (True, 3), 15: (True, 6), 21: (True, 6), 25: (True, 4), 29: (False, None)}
    cyc = ev.glitch_width(ev.glitch_flags(ev.dedup_changes(log(spark, rows), 10), 10), neighbour="cycle")
    assert {r.t: r.pulse for r in cyc.collect()}[15] == 3


def test_blocked_order_on_a_hot_key(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(5)}", i, r.randrange(100), r.choice([None, 1, 2])) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t int, x int, y int").withColumn("blk", time_block("t", 40))
    got = ordered(df, ["k"], ["t"], "blk", lag={"p": F.col("x")}, lead={"n": F.col("x")}, sum_before={"s": F.col("x")}, last_before={"l": F.col("y")}).collect()
    per = defaultdict(list)
    for row in data:
        per[row[0]].append(row)
    exp = {}
    for k, rows in per.items():
        s, last = 0, None
        for i, row in enumerate(rows):
            exp[row[1]] = (rows[i - 1][2] if i else None, rows[i + 1][2] if i + 1 < len(rows) else None, s, last)
            s += row[2]
            last = row[3] if row[3] is not None else last
    assert {r.t: (r.p, r.n, r.s, r.l) for r in got} == exp
    assert plan_block_ticks(df, ["k"], "t", 10, 20) >= 10


def test_tables(spark):
    one = spark.range(1)
    a1, a2 = F.array(F.lit(0.1), F.lit(0.2)), F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))
    v = F.array(*[F.lit(float(x)) for x in (1, 2, 4, 3, 5, 9)])
    got = one.select(
        lut.lut2(a1, a2, v, F.lit(0.1), F.lit(2.0)), lut.lut2(a1, a2, v, F.lit(0.15), F.lit(3.0)), lut.lut2(a1, a2, v, F.lit(0.3), F.lit(0.0)),
        lut.lut2(F.array(F.lit(0.1)), a2, F.slice(v, 1, 3), F.lit(9.0), F.lit(4.0)), lut.lut1(F.array(F.lit(1.0)), F.array(F.lit(7.0)), F.lit(5.0)),
        lut.lut1_clip(a2, F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.lit(0.5)), lut.segment(a2, F.lit(100.0))).first()
    assert list(got) == pytest.approx([2, 5, 2, 4, 7, 0, 1])


def test_functions():
    assert logic.truth_bits("A&B|!C", ["A", "B", "C"]) == [1, 1, 1, 1, 0, 0, 0, 1]
    assert logic.truth_bits("A' * B + 0", ["A", "B"]) == [0, 0, 1, 0]
    assert logic.truth_bits("A & Q", ["A", "B"]) is None
    assert logic.truth_bits("__import__", ["A"]) is None
    assert logic.unateness_of(logic.truth_bits("!A|B", ["A", "B"]), 0) == "negative_unate"


def test_first_and_last_match(spark):
    leak = spark.createDataFrame([("c", 0, 1, 1, 10.0), ("c", 1, 3, 3, 20.0)], "cell_name string, ord int, care_mask int, value_mask int, power double")
    cells = spark.createDataFrame([("c", 2, 1.0), ("w", 17, 5.0)], "cell_name string, n_pin int, default_leakage double")
    got = {(r.cell_name, r.state): r.power for r in pw.expand_leakage(leak, cells).collect()}
    assert got == {("c", 0): 1.0, ("c", 1): 10.0, ("c", 2): 1.0, ("c", 3): 20.0, ("w", None): 5.0}


def test_globs(spark):
    df = spark.createDataFrame([("r1q",), ("r2q",), ("u1",), ("R1Q",), ("a\nq",)], "n string")
    pick = lambda *a, **k: sorted(r.n for r in df.filter(names.matches(F.col("n"), *a, **k)).collect())
    assert pick("*q") == ["a\nq", "r1q", "r2q"]
    assert pick("r?q", nocase=True) == ["R1Q", "r1q", "r2q"]
    assert pick("r[12]q", regexp=True) == ["r1q", "r2q"]
    assert pick("r[12]q") == []


def test_levels_and_loops(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5)], "from_v bigint, to_v bigint")
    assert {r.v: r.level for r in gr.levelize(e).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    c = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7)], "from_v bigint, to_v bigint")
    assert sorted((r.loop_id, r.v) for r in gr.loop_members(c).collect()) == [(3, 1), (3, 2), (3, 3), (6, 5), (6, 6), (7, 7)]


def test_k_worst_paths_against_all_paths(spark):
    r = random.Random(5)
    rows, eid = [], 0
    for a in range(1, 10):
        for z in range(a + 1, 10):
            if r.random() < 0.5:
                eid += 1
                rows.append((eid, a, "rise", z, "rise", r.randrange(50)))
    e = spark.createDataFrame(rows, "e_id bigint, from_v bigint, from_rf string, to_v bigint, to_rf string, d_max bigint")
    seeds = spark.createDataFrame([(1, "rise", 0)], "v bigint, rf string, a_max bigint")
    got = defaultdict(list)
    for x in gr.k_worst(gr.Levelled(e), seeds, 4).collect():
        got[x.v].append(x.a_max)
    ways = defaultdict(list)
    ways[1] = [0]
    for v in range(2, 10):
        ways[v] = [w + d for _, a, _, z, _, d in rows if z == v for w in ways[a]]
    for v, w in ways.items():
        assert sorted(got[v], reverse=True) == sorted(w, reverse=True)[:4]


def test_rc_network_with_a_loop(spark):
    res = spark.createDataFrame([("n", "d", "a", 2.0), ("n", "a", "b", 3.0), ("n", "a", "c", 5.0), ("n", "b", "c", 7.0), ("n", "a", "a", 1.0)], "net_id string, n1 string, n2 string, ohm double")
    caps = spark.createDataFrame([("n", "a", 1.0), ("n", "b", 2.0), ("n", "c", 4.0)], "net_id string, node string, cap double")
    tree = ps.root_tree(res, spark.createDataFrame([("n", "d")], "net_id string, node string"))
    m = ps.moments(tree, caps)
    tau = {r.node: r.tau for r in ps.elmore(m).collect()}
    assert tau == {"d": 0.0, "a": 14.0, "b": 20.0, "c": 34.0}
    p = ps.pi_model(m).first()
    assert p.c1 + p.c2 == pytest.approx(7.0)


def test_divided_clock(spark):
    df = spark.createDataFrame([(5.0, [0.0, 2.5], 3, None, None, None, False, None), (5.0, [0.0, 2.5], None, None, [1, 3, 5], None, False, None), (5.0, [0.0, 2.5], 2, None, None, None, True, None)],
                               "m_period double, m_wave array<double>, divide_by int, multiply_by int, edges array<int>, edge_shifts array<double>, invert boolean, duty_cycle double")
    got = [(r.period, list(r.waveform)) for r in constraints.generated_waveform(df).collect()]
    assert got == [(15.0, [0.0, 7.5]), (10.0, [0.0, 5.0]), (10.0, [5.0, 10.0])]


def test_clock_pair(spark):
    df = spark.createDataFrame([(10, 0, 15, 0, 7), (10, 0, 10, 0, 5), (10, 5, 10, 0, 5)], "s_period bigint, s_edge bigint, t_period bigint, t_edge bigint, t_opp bigint")
    got = [(r.setup_delay, r.hold_delay, r.setup_required) for r in constraints.cycle_distances(df).collect()]
    assert got == [(5, 0, 5), (10, 0, 10), (5, 5, 10)]


def test_exceptions_against_brute_force(spark):
    r = random.Random(9)
    opt = lambda n: r.choice([None, *range(n)])
    exc = [(i, r.choice(["false", "path_delay", "multicycle"]), r.randrange(5), opt(4), opt(3)) for i in range(25)]
    paths = [(i, r.randrange(4), r.randrange(3)) for i in range(60)]
    got = constraints.match_exceptions(spark.createDataFrame(paths, "id int, to_pin int, from_clk int"),
                                       spark.createDataFrame(exc, "exc_id int, kind string, value int, to_pin int, from_clk int"), ["to_pin", "from_clk"], ["id"])
    base = {"false": 4000, "path_delay": 3000, "multicycle": 2000}
    for x in got.collect():
        hits = [(base[k] + (32 if t is not None else 0) + (8 if c is not None else 0), -v, -i, k) for i, k, v, t, c in exc
                if t in (None, x.to_pin) and c in (None, x.from_clk)]
        assert (x.exc_kind, x.exc_value) == ((max(hits)[3], -max(hits)[1]) if hits else (None, None))


def test_top_paths_keep_whole_groups(spark):
    ends = spark.createDataFrame([(v, rf, v % 2, (v * 7) % 13) for v in range(40) for rf in ("rise", "fall")], "v int, rf string, clk int, slack int")
    got = checks.top_paths(ends, 1, 5).collect()
    for c in (0, 1):
        mine = sorted((r.slack, r.v) for r in got if r.clk == c)
        assert mine == sorted(((v * 7) % 13, v) for v in range(40) if v % 2 == c)[:5]


def test_trace_text_round_trip(spark, tmp_path):
    text = "\n".join([
        "$timescale 10ps $end", "$scope module tb $end", "$var wire 1 ! clk $end", "$scope module u1 $end", "$var reg 4 \" q/x [3:0] $end", "$upscope $end",
        "$upscope $end", "$enddefinitions $end", "#0", "$dumpvars", "x!", "b00x1 \"", "$end", "#5", "1! b1010 \"", "#12", "0!", "z!"]) + "\n"
    f = tmp_path / "t.vcd"
    f.write_text(text)
    lines = trace.read_lines(spark, str(f))
    ch = [(r.t, r.code, r.bits) for r in trace.parse_changes(lines).orderBy("line", "pos").collect()]
    assert ch == [(0, "!", "x"), (0, '"', "00x1"), (5, "!", "1"), (5, '"', "1010"), (12, "!", "0"), (12, "!", "z")]
    h = {r.code: (r.name, list(r.scope), r.width, r.msb, r.lsb) for r in trace.parse_header(lines).collect()}
    assert h == {"!": ("clk", ["tb"], 1, 0, 0), '"': ("q\\/x", ["tb", "u1"], 4, 3, 0)}
    assert trace.time_scale(lines).first().time_scale == pytest.approx(1e-11)
    # Many small splits must give the same events.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
    try:
        again = [(r.t, r.code, r.bits) for r in trace.parse_changes(trace.read_lines(spark, str(f))).orderBy("t", "blk", "line", "pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert again == ch
    with pytest.raises(ValueError):
        trace.read_lines(spark, "x.txt")


def test_trace_header_as_token_stream(spark, tmp_path):
    deep = [f"$scope module s{k} $end" for k in range(40)]
    text = "\n".join(["$date", " Nov 10 2024 10:30:45", "$end", "$comment #7 1! $end", "$timescale", "  1ps", "$end", *deep, "$var wire", " 1 !", "deep $end", *["$upscope $end"] * 40, "$enddefinitions $end", "$dumpvars 0! b01 %", "$end", "#5", "$comment note", "#9 1!", "$end", "1!", "1s"]) + "\n"
    f = tmp_path / "h.vcd"
    f.write_text(text)
    lines = trace.read_lines(spark, str(f))
    assert [(r.t, r.code, r.bits) for r in trace.parse_changes(lines).orderBy("line", "pos").collect()] == [(0, "!", "0"), (0, "%", "01"), (5, "!", "1"), (5, "s", "1")]
    (h,) = trace.parse_header(lines).collect()
    assert (h.code, h.name, h.width, list(h.scope)) == ("!", "deep", 1, [f"s{k}" for k in range(40)])
    assert [r.time_scale for r in trace.time_scale(lines).collect()] == [pytest.approx(1e-12)]


def test_boolean_texts(spark):
    assert logic.truth_bits("A^B&C", list("ABC")) == [int((s & 1 ^ s >> 1 & 1) and s >> 2) for s in range(8)]
    assert logic.truth_bits("A B' + !(A|B)", list("AB")) == [1, 1, 0, 0]
    assert logic.truth_bits("(A B)'", list("AB")) == [1, 1, 1, 0]
    assert logic.truth_bits("A (B", list("AB")) is None and logic.truth_bits("A &", ["A"]) is None
    assert sum(logic.truth_bits("&".join(f"P{i}" for i in range(18)), [f"P{i}" for i in range(18)])) == 1
    with pytest.raises(ValueError):
        logic.truth_bits("A", [f"P{i}" for i in range(30)] + ["A"])
    rows = [("(A & !B)", True, 3, 1), ("A' & B", True, 3, 2), ("A B", True, 3, 3), ("!(A)", True, 1, 0), ("!(A | B')", True, 3, 2), ("A & !A", False, 0, 0), ("A | B", False, 0, 0), ("Q", False, 0, 0), (None, True, 0, 0), ("", True, 0, 0)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, w string")
    got = df.select("i", logic.conjunction_masks("w", F.array(F.lit("A"), F.lit("B"))).alias("m")).orderBy("i").collect()
    assert [tuple(r.m) for r in got] == [r[1:] for r in rows]


def test_loops_and_lone_seeds(spark):
    e = spark.createDataFrame([(1, "rise", 2, "rise", 1, 10, 10), (2, "rise", 3, "rise", 2, 10, 10), (3, "rise", 2, "rise", 3, 10, 10), (3, "rise", 4, "rise", 4, 10, 10)], "from_v long, from_rf string, to_v long, to_rf string, e_id long, d_max long, d_min long")
    kept, gone, levels = gr.break_loops(e)
    assert [(r.from_v, r.to_v) for r in gone.collect()] == [(3, 2)]
    assert levels.filter("level is null").count() == 0
    s = spark.createDataFrame([(1, "rise", 0, 0, 0), (9, "rise", 0, 5, 5)], "v long, rf string, clk int, a_max long, a_min long")
    got = {r.v: r.a_max for r in gr.arrivals(gr.Levelled(e), s).collect()}
    assert got == {1: 0, 2: 10, 3: 20, 4: 30, 9: 5}


def test_many_latches(spark):
    from voltgrain.plans.check_plans import latch_passes
    n = 12
    lat = spark.createDataFrame([(i, "open", 0, 0) for i in range(n)], "v long, kind string, enable long, max_borrow long")
    e = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)], "from_v long, to_v long, d long")
    s = spark.createDataFrame([(0, 4)], "v long, arrival long")
    assert sorted((r.v, r.arrival) for r in latch_passes(lat, e, s).collect()) == [(i, 4 + i) for i in range(n)]
    with pytest.raises(RuntimeError):
        latch_passes(lat.filter("v < 2"), spark.createDataFrame([(0, 1, 1), (1, 0, 1)], e.schema), s)


def test_rc_text(spark, tmp_path):
    f = tmp_path / "n.spef"
    f.write_text("*C_UNIT 1.0 PF\n*R_UNIT 1.0 KOHM\n*NAME_MAP\n*1 top/n1\n*2 u2\n\n*D_NET *1 1.5\n*CONN\n*I *2:A I\n*CAP\n1 *1:1 0.5\n2 *1:1 *2:7 0.25\n*RES\n1 *1:1 *2:A 3.0\n*END\n\n*D_NET *2 0.1\n*CAP\n1 *2:1 0.1\n*END\n")
    rec = rcnet.read_records(spark, str(f))
    nm = rcnet.name_map(rec)
    caps = rcnet.expand_names(rcnet.caps(rec), "node", nm)
    assert sorted((r.net_id, r.node, r.gnd_cap) for r in caps.collect()) == [("*1", "top/n1:1", 0.5), ("*2", "u2:1", 0.1)]
    assert [(r.n1, r.n2, r.ohm) for r in rcnet.resistors(rec).collect()] == [("*1:1", "*2:A", 3.0)]
    assert rcnet.coupling(rec).count() == 1 and rcnet.connections(rec).first().pin == "*2:A"
    assert rcnet.unit_factor(rec, "R").first().factor == 1000.0


def test_slices_carry_state_and_flag_late_events(spark):
    rows = random_log(400, 4, 900, 0.5, seed=11)
    whole = ev.dedup_changes(log(spark, rows), 100)
    df = log(spark, rows)
    state, got = None, []
    for lo, hi in ((0, 300), (300, 600), (600, 900)):
        ch, state, late = st.slice_changes(df.filter((F.col("t") >= lo) & (F.col("t") < hi)), state, 100)
        state = state.cache()
        got += [(r.sig_id, r.t, r.pv, r.v) for r in ch.collect()]
        assert late.count() == 0
    assert sorted(map(str, got)) == sorted(str((r.sig_id, r.t, r.pv, r.v)) for r in whole.collect())
    _, _, late = st.slice_changes(log(spark, [(0, 0, 5, 1)]), state, 100)
    assert late.count() == 1


def test_hierarchy(spark):
    t = spark.createDataFrame([("top", "a", "m"), ("top", "b", "m"), ("m", "x", "inv"), ("m", "y", "odd")], "module string, inst string, child string")
    leaf = spark.createDataFrame([("inv",)], "module string")
    got = sorted((r.path, r.kind) for r in library.elaborate(t, leaf, F.lit("top")).collect())
    assert got == [("a/x", "leaf"), ("a/y", "black_box"), ("b/x", "leaf"), ("b/y", "black_box")]
    with pytest.raises(ValueError):
        library.elaborate(t, leaf, F.lit("top"), black_boxes=False)


def test_block_plan_follows_the_counts(spark):
    for n in (2_000, 20_000):  # one key holds a third of the rows; ten times the rows
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"), (F.col("id") * 7919 % 1000).alias("t"))
        ticks = plan_block_ticks(df, ["k"], "t", 100, 200)
        top = df.groupBy("k", time_block("t", ticks)).count().agg(F.max("count")).first()[0]
        assert top <= 200 and (ticks < 100) == (n == 20_000)
    assert plan_block_ticks(df.limit(0), [], "t", 100, 200) > 0


def test_tighter_exception_by_side(spark):
    exc = spark.createDataFrame([(1, "path_delay", 5, "a", "max"), (2, "path_delay", 9, "a", "max"), (3, "path_delay", 5, "a", "min"), (4, "path_delay", 9, "a", "min")], "exc_id int, kind string, value bigint, to_pin string, minmax string")
    paths = spark.createDataFrame([("p", "a", "max"), ("q", "a", "min"), ("r", "b", "min")], "path string, to_pin string, minmax string")
    got = {r.path: r.exc_value for r in constraints.match_exceptions(paths, exc, ["to_pin", "minmax"], ["path"]).collect()}
    assert got == {"p": 5, "q": 9, "r": None}


def test_periods_and_coverage(spark):
    from voltgrain.operators import activity as ac

    ch = spark.createDataFrame([(1, 0, None, 1), (1, 10, 1, 0), (1, 20, 0, 1), (1, 70, 0, 1), (1, 120, 0, 1), (2, 5, 0, 1)], "sig_id int, t bigint, pv int, v int")
    traced = ac.traced_periods(ch)
    assert [tuple(r) for r in traced.collect()] == [(1, 50.0)]
    assert ac.period_mismatch(traced, F.lit(46.0)).count() == 0 and ac.period_mismatch(traced, F.lit(45.0)).count() == 1
    g = spark.createDataFrame([(3, 1), (5, 10), (9, 100), (40, 1000)], "n_pin int, n_event int")
    assert {r.threshold: (r.n_gate, r.n_event, r.ratio) for r in ac.pin_count_coverage(g).collect()} == {4: (3, 1110, 0.75), 8: (2, 1100, 0.5), 16: (1, 1000, 0.25), 32: (1, 1000, 0.25)}


def test_late_rows_are_kept_and_old_state_goes(spark, tmp_path):
    run = st.SlicedTrace(spark, str(tmp_path), 10, 100)
    for k, rows in enumerate(([(0, 0, 5, 1)], [(0, 0, 15, 0)], [(0, 0, 3, 0), (0, 0, 25, 1)])):
        run.process(log(spark, rows), k)
    assert [r.t for r in run.late_events().collect()] == [3]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["b1", "b2"]


def test_trace_back_with_order_keys_above_1e8(spark, tmp_path):
    """Packed edge numbers of (part 1, order 1e8 + 5) and (part 2, order 5) are equal."""
    from voltgrain.plans import graph_plans as gp
    tables = {"lineitem": ([(1, 1, 100_000_005, 10), (1, 2, 5, 10)], "l_suppkey long, l_partkey long, l_orderkey long, l_quantity int"),
              "orders": ([(100_000_005, 2), (5, 1)], "o_orderkey long, o_custkey long"),
              "customer": ([(1, 0), (2, 1)], "c_custkey long, c_nationkey long"),
              "nation": ([(0, 0), (1, 1)], "n_nationkey long, n_regionkey long"),
              "supplier": ([(1, 0)], "s_suppkey long, s_nationkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    paths = defaultdict(list)
    for x in gp.g6(spark, str(tmp_path)).collect():
        paths[x.path_id].append(x.v)
    K = gp.K
    for path_id, vs in paths.items():
        low = path_id // 100 == 5 * K
        part, order, cust, nat = (2, 5, 1, 0) if low else (1, 100_000_005, 2, 1)
        assert sorted(vs) == [1, K + part, 2 * K + order, 3 * K + cust, 4 * K + nat, 5 * K + nat]
    assert len(paths) == 4
