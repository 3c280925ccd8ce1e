"""Registered queries against their SQL. VOLTGRAIN_ALL=1 runs every query."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, norm, same

D = os.environ.get("VOLTGRAIN_SF_DIR", "/root/testdata/sf0.001")
QUICK = """a1_trace_ingest a3_dedup_initial_x a4_bus_split a5_rc_ingest b1_get_cells b8_property_filter b10_filter_or c2_annotate_signals c4_asof_inputs
c5_nearest_cause c11_clock_pairs d2_duty d9_pin_count_coverage d17_percentiles e2_state_index e4_glitch_flag e5_glitch_width e8_equal_event_slices f3_set_operations
g3_loops g8_k_worst_paths g12_unateness g14_generated_clocks h2_pi_model h5_wire_load h14_parallel_drivers j3_carried_state k5_lut_value k13_condition_masks
l1_leakage l2_leakage_per_cycle l5_internal_output l13_averaged_output m4_toggle_rate n1_register_checks n5_latch_borrow n22_reconvergence_credit
o2_cycle_accounting o3_multicycle o4_exception_priority o13_pulse_width_limit p1_equivalent_cells c18_flatten_nets""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("VOLTGRAIN_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(entry.queries()) - set(entry.LLM_QUERIES) == set(entry.oracle_sql()) - set(entry.LLM_ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    kinds, want_kinds = dict(df.dtypes), {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert all(same(kinds[c], want_kinds[c]) for c in cols)
    gi, wi = [df.columns.index(c) for c in cols], [rel.columns.index(c) for c in cols]
    got = sorted(tuple(norm(r[i]) for i in gi) for r in df.collect())
    want = sorted(tuple(norm(r[i]) for i in wi) for r in rel.fetchall())
    assert got == want
