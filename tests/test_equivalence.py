"""Equal cells across libraries, the check report, by hand-made tables."""

from __future__ import annotations

import pytest

from voltgrain.operators import checks as ck, equivalence as eq


def test_cells_match_by_ports_functions_and_registers(spark):
    cells = [("a", "and1", 3.0, False), ("a", "and2", 5.0, False), ("b", "nor_bar", 9.0, False), ("a", "or", 1.0, False), ("a", "old", 1.0, True),
             ("m", "and_m", 2.0, False), ("m", "or_m", 2.0, None), ("a", "ff", 1.0, False), ("b", "ff", 2.0, False), ("a", "latch", 1.0, False), ("a", "tri", 1.0, False)]
    f = {"and1": "A&B", "and2": "B A", "nor_bar": "!(!A | !B)", "or": "A|B", "old": "A&B", "and_m": "A*B", "or_m": "A+B", "tri": "A&B"}
    ports = []
    for lib, cell, *_ in cells:
        ports += [(lib, cell, p, "input", None, None) for p in ("B", "A")]
        ports.append((lib, cell, "Z", "output", f.get(cell, "IQ"), "B" if cell == "tri" else None))
    seqs = [("a", "ff", True, "A", "B", None, None, "IQ", "IQN"), ("b", "ff", True, "A", "!!B", None, None, "IQ", "IQN"), ("a", "latch", False, "A", "B", None, None, "IQ", "IQN")]
    d = eq.described_cells(spark.createDataFrame(cells, "lib string, cell string, drive double, dont_use boolean"),
                           spark.createDataFrame(ports, "lib string, cell string, port string, dir string, function string, enable string"),
                           spark.createDataFrame(seqs, "lib string, cell string, is_register boolean, clock string, data string, clear string, preset string, out string, out_inv string"))
    got = {(r.lib, r.cell): (r.class_id, r.n_members, r["rank"], r.mapped) for r in eq.equivalent_across(d, ["a", "b"], ["m", "a"]).collect()}
    # or has no partner among the first libraries, so or_m is mapped to nothing; tri and latch differ
    assert got == {("a", "and1"): ("a/and1", 3, 3, False), ("a", "and2"): ("a/and1", 3, 2, False), ("b", "nor_bar"): ("a/and1", 3, 1, False),
                   ("m", "and_m"): ("a/and1", 3, None, True), ("a", "ff"): ("a/ff", 2, 2, False), ("b", "ff"): ("a/ff", 2, 1, False)}
    assert eq.equivalent_across(d.limit(0), ["a"]).count() == 0


def test_check_report(spark):
    rows = spark.createDataFrame([("setup", "b", -1.0), ("setup", "a", -1.0), ("setup", "c", 2.0), ("hold", "h", 3.0), ("max_skew", "s", None)], "kind string, o string, slack double")
    from pyspark.sql import functions as F
    rows = ck.check_rows(rows, F.col("kind"), ["o", F.lit(7)])
    assert sorted(map(tuple, ck.check_report(rows).collect())) == [("hold", "h/7", 3.0), ("setup", "a/7", -1.0)]
    assert sorted(map(tuple, ck.check_report(rows, violators=True).collect())) == [("setup", "a/7", -1.0), ("setup", "b/7", -1.0)]
    assert ck.check_report(rows, ["hold"], violators=True).count() == 0
    with pytest.raises(ValueError):
        ck.check_report(rows, ["setup", "typo"])
