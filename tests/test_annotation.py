"""Annotations on conditional arcs, by hand."""

import pytest

from voltgrain.operators.annotation import annotate_arcs

ARCS = [("u1", 0, "A & B", 1.0, 2.0), ("u1", 1, "!A", 1.0, 2.0), ("u1", 2, None, 1.0, 2.0), ("u2", 0, None, 5.0, 6.0)]
NOTES = "inst string, seq int, cond string, condelse boolean, a_min double, a_max double"


def run(spark, notes, use=None):
    arcs = spark.createDataFrame(ARCS, "inst string, arc int, when string, d_min double, d_max double")
    got = annotate_arcs(arcs, spark.createDataFrame(notes, NOTES), ["inst"], use).collect()
    return {(r["inst"], r["arc"]): (r["d_min"], r["d_max"]) for r in got}


def test_conditions_and_order(spark):
    got = run(spark, [("u1", 1, None, False, 7.0, 8.0), ("u1", 2, "A&B", None, 3.0, 4.0), ("u1", 3, None, True, 9.0, 9.5), ("u1", 4, "C", False, 0.0, 99.0), (None, 5, None, False, 0.0, 0.0)])
    assert got == {("u1", 0): (3.0, 4.0), ("u1", 1): (7.0, 8.0), ("u1", 2): (9.0, 9.5), ("u2", 0): (5.0, 6.0)}


@pytest.mark.parametrize("use, want", [(None, (7.0, 8.0)), ("min", (3.0, 4.0)), ("max", (9.0, 12.0)), ("both", (3.0, 12.0))])
def test_condition_use(spark, use, want):
    # the first is replaced by the second; the later ones are merged with it where conditions may be used
    notes = [("u1", 1, "C", False, 0.0, 99.0), ("u1", 2, None, False, 7.0, 8.0), ("u1", 3, "C", False, 3.0, 4.0), ("u1", 4, "D", False, 9.0, 12.0)]
    got = run(spark, notes, use)
    assert got["u1", 2] == want and got["u1", 0] == (7.0, 8.0) and got["u2", 0] == (5.0, 6.0)


def test_no_notes(spark):
    assert run(spark, [], "both")["u1", 2] == (1.0, 2.0)
    with pytest.raises(ValueError):
        run(spark, [], "all")
