"""Four-state logic, transition weights, state indices and boolean functions.

Value codes: 0 low, 1 high, 2 unknown, 3 high impedance.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

X = 2
# Trace characters and their codes.
VALUE_CODES = {"0": 0, "1": 1, "x": 2, "X": 2, "u": 2, "U": 2, "z": 3, "Z": 3}


def value_code(ch: Column) -> Column:
    low = F.lower(ch)
    return F.when(low == "0", 0).when(low == "1", 1).when(low == "z", 3).otherwise(2).cast("int")


def n_rise(prev: Column, cur: Column) -> Column:
    """1 for a full rise, one half when one side is unknown, else 0."""
    return (F.when((prev == 0) & (cur == 1), 1.0)
            .when(((prev == 0) & (cur == X)) | ((prev == X) & (cur == 1)), 0.5)
            .otherwise(0.0))


def n_toggle(prev: Column, cur: Column) -> Column:
    """Energy weight of a change: none 0, unknown side one half, else 1."""
    return F.when(prev == cur, 0.0).when((prev == X) | (cur == X), 0.5).otherwise(1.0)


def n_transition(prev: Column, cur: Column) -> Column:
    """Activity weight of a change: high impedance also counts one half."""
    return F.when(prev == cur, 0.0).when((prev >= X) | (cur >= X), 0.5).otherwise(1.0)


def edge(prev: Column, cur: Column) -> Column:
    return F.when(n_rise(prev, cur) > 0, "rise").otherwise("fall")


def state_bit(value: Column, pin_idx: Column) -> Column:
    """The pin's bit of a state index; set only for an exact high."""
    return F.call_function("shiftleft", F.when(value == 1, 1).otherwise(0), pin_idx.cast("int"))


def state_label(bit: Column, port: Column) -> Column:
    return F.when(bit == 1, port).otherwise(F.concat(F.lit("!"), port))


def state_matches(state: Column, care: Column, value: Column) -> Column:
    return state.bitwiseAND(care) == value


_TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w\[\].]*)|([01])(?!\w)|([!~'&*|+^()]))")


def parse_function(text: str) -> tuple | None:
    """Tree of a boolean text: ("name", x), ("const", 0 or 1), ("not", a), ("xor" / "and" / "or", a, b); None if it is not one.

    Negation (``!`` or ``~`` before, ``'`` behind) binds tightest, then ``^``, then and (``&``, ``*`` or nothing between
    two terms), then or (``|``, ``+``).
    """
    signs, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        signs.append(("name", m[1]) if m[1] else ("const", int(m[2])) if m[2] else m[3])
        at = m.end()
    signs.append(None)
    i = 0

    def term():
        nonlocal i
        s, i = signs[i], i + 1
        if s in ("!", "~"):
            out = ("not", term())
        elif s == "(":
            out = level(0)
            if signs[i] != ")":
                raise SyntaxError
            i += 1
        elif isinstance(s, tuple):
            out = s
        else:
            raise SyntaxError
        while signs[i] == "'":
            out, i = ("not", out), i + 1
        return out

    def level(k):
        nonlocal i
        below = term if k == 2 else lambda: level(k + 1)
        out = below()
        while True:
            s = signs[i]
            if s in (("|", "+"), ("&", "*"), ("^",))[k]:
                i += 1
            elif not (k == 1 and (isinstance(s, tuple) or s in ("!", "~", "("))):
                return out
            out = (("or", "and", "xor")[k], out, below())

    try:
        tree = level(0)
    except (SyntaxError, IndexError):
        return None
    return tree if signs[i] is None else None


def _literals(tree: tuple, positive: bool) -> dict[str, int] | None:
    """Ports with the values they must have if the tree is a conjunction (De Morgan included); a contradiction or another shape gives None."""
    kind = tree[0]
    if kind == "name":
        return {tree[1]: int(positive)}
    if kind == "const":
        return {} if tree[1] == int(positive) else None
    if kind == "not":
        return _literals(tree[1], not positive)
    if kind != ("and" if positive else "or"):
        return None
    a, b = _literals(tree[1], positive), _literals(tree[2], positive)
    if a is None or b is None or any(b.get(k, v) != v for k, v in a.items()):
        return None
    return a | b


def condition_masks(when: str | None, ports: list[str]) -> tuple[bool, int, int]:
    """(ok, care, value) of a conjunction over an ordered port list; an empty one cares about nothing and always matches."""
    if when is None or not when.strip():
        return True, 0, 0
    tree = parse_function(when)
    found = None if tree is None else _literals(tree, True)
    if found is None or not set(found) <= set(ports):
        return False, 0, 0
    return True, sum(1 << ports.index(p) for p in found), sum(v << ports.index(p) for p, v in found.items())


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("care", T.IntegerType()), T.StructField("value", T.IntegerType())]))
def conjunction_masks(when: pd.Series, ports: pd.Series) -> pd.DataFrame:
    """``condition_masks`` of distinct library rows: ``A & !B``, ``(A B')``, ``!(A | B)``, ...; not for events."""
    return pd.DataFrame([condition_masks(w, list(p)) for w, p in zip(when, ports)], columns=["ok", "care", "value"])


#: A truth table has two to this power entries at most; a wider function is refused, not skipped.
MAX_PORTS = 20


def truth_bits(function: str, ports: list[str]) -> list[int] | None:
    """All outputs of a boolean text function; entry s holds the value in state s. None if it is no function of these ports."""
    if function is None or (tree := parse_function(function)) is None:
        return None
    if len(ports) > MAX_PORTS:
        raise ValueError(f"{len(ports)} ports in one function; at most {MAX_PORTS} are supported: {function[:80]}")
    states = np.arange(1 << len(ports))

    def value(t: tuple) -> np.ndarray:
        kind = t[0]
        if kind == "name":
            return (states >> ports.index(t[1]) & 1).astype(bool)
        if kind == "const":
            return np.full(len(states), bool(t[1]))
        if kind == "not":
            return ~value(t[1])
        a, b = value(t[1]), value(t[2])
        return a & b if kind == "and" else a | b if kind == "or" else a ^ b

    try:
        return value(tree).astype(int).tolist()
    except ValueError:  # a name that is no port
        return None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def truth_table(function: pd.Series, ports: pd.Series) -> pd.Series:
    """Truth table of a text function; run it on distinct library rows, not on events."""
    return pd.Series([truth_bits(f, list(p)) for f, p in zip(function, ports)])


def tt_value(tt: Column, state: Column) -> Column:
    return F.get(tt, state.cast("int"))


def _states(tt: Column) -> Column:
    return F.sequence(F.lit(0), F.size(tt) - 1)


def _bit(s: Column, i: Column) -> Column:
    return F.call_function("shiftright", s, i).bitwiseAND(F.lit(1))


def state_probability(s: Column, duty: Column) -> Column:
    """Chance of one input state when inputs are independent."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(duty) - 1), F.lit(1.0),
        lambda a, i: a * F.when(_bit(s, i) == 1, F.get(duty, i)).otherwise(1.0 - F.get(duty, i)))


def probability(tt: Column, duty: Column) -> Column:
    """P(f = 1) from the inputs' duties."""
    return F.aggregate(_states(tt), F.lit(0.0), lambda a, s: F.when(
        F.get(tt, s) == 1, a + state_probability(s, duty)).otherwise(a))


def difference_probability(tt: Column, duty: Column, i: Column) -> Column:
    """P(f changes when input i changes)."""
    flip = F.call_function("shiftleft", F.lit(1), i.cast("int"))
    return F.aggregate(_states(tt), F.lit(0.0), lambda a, s: F.when(
        F.get(tt, s) != F.get(tt, s.bitwiseXOR(flip)), a + state_probability(s, duty)).otherwise(a))


def toggle_rate(tt: Column, duty: Column, activity: Column) -> Column:
    """Output toggles per cycle: each input's toggles times the chance they pass."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(activity) - 1), F.lit(0.0),
        lambda a, i: a + F.get(activity, i) * difference_probability(tt, duty, i))


def unateness(tt: Column, i: Column, known_mask: Column | None = None, known_value: Column | None = None) -> Column:
    """positive / negative / non_unate / none of a function in one input.

    States that contradict the known (constant) inputs are left out.
    """
    flip = F.call_function("shiftleft", F.lit(1), i.cast("int"))
    km = known_mask if known_mask is not None else F.lit(0)
    kv = known_value if known_value is not None else F.lit(0)
    low = F.filter(_states(tt), lambda s: (s.bitwiseAND(flip) == 0) & (s.bitwiseAND(km) == kv))
    up = F.exists(low, lambda s: F.get(tt, s) < F.get(tt, s.bitwiseOR(flip)))
    down = F.exists(low, lambda s: F.get(tt, s) > F.get(tt, s.bitwiseOR(flip)))
    return (F.when(up & down, "non_unate").when(up, "positive_unate")
            .when(down, "negative_unate").otherwise("none"))


def ternary_value(tt: Column, known_mask: Column, known_value: Column) -> Column:
    """0 / 1 when the known inputs fix the output, else unknown."""
    hits = F.array_distinct(F.transform(
        F.filter(_states(tt), lambda s: s.bitwiseAND(known_mask) == known_value), lambda s: F.get(tt, s)))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(X)


# ------------------------------------------------------------------ known functions as plain arithmetic
def probability_expr(bits: list[int], duty: list[Column]) -> Column:
    """P(f = 1) of one known truth table as a sum of products, so it stays in generated code."""
    if all(b == bits[0] for b in bits):
        return F.lit(float(bits[0]))
    low, high = bits[: len(bits) // 2], bits[len(bits) // 2:]
    top, rest = duty[-1], duty[:-1]
    if low == high:
        return probability_expr(low, rest)
    return probability_expr(high, rest) * top + probability_expr(low, rest) * (1.0 - top)


def difference_bits(bits: list[int], i: int) -> list[int]:
    """Truth table of the difference of f in input i (input i itself no longer matters)."""
    return [bits[s] ^ bits[s ^ (1 << i)] for s in range(len(bits))]


def toggle_rate_expr(bits: list[int], duty: list[Column], activity: list[Column]) -> Column:
    out = F.lit(0.0)
    for i, a in enumerate(activity):
        out = out + a * probability_expr(difference_bits(bits, i), duty)
    return out


def by_function(which: Column, table: dict, build) -> Column:
    """One branch per known function: ``build(bits)`` for the function that ``which`` names."""
    out = None
    for name, bits in table.items():
        out = F.when(which == name, build(bits)) if out is None else out.when(which == name, build(bits))
    return out


def unateness_of(bits: list[int], i: int) -> str:
    pairs = [(bits[s], bits[s | (1 << i)]) for s in range(len(bits)) if not s >> i & 1]
    up, down = any(a < b for a, b in pairs), any(a > b for a, b in pairs)
    return "non_unate" if up and down else "positive_unate" if up else "negative_unate" if down else "none"


MAX_KNOWN_FUNCTIONS, MAX_KNOWN_PINS = 64, 6


def known_functions(gates, max_pins: int) -> list[list[int]] | None:
    """The distinct truth tables of a gate table when they are few and small, else None.

    At most a bounded handful of library functions reaches the driver.
    """
    if max_pins > MAX_KNOWN_PINS:
        return None
    rows = gates.select("tt").distinct().limit(MAX_KNOWN_FUNCTIONS + 1).collect()
    return None if len(rows) > MAX_KNOWN_FUNCTIONS else sorted(list(r.tt) for r in rows)


def function_index(tt: Column, functions: list[list[int]]) -> Column:
    return F.array_position(F.array(*[F.array(*map(F.lit, t)) for t in functions]), tt).cast("int") - 1


def ternary_table(bits: list[int], n: int) -> list[int]:
    """Output for every pair (known mask, known value), at index mask * 2^n + value."""
    size = 1 << n
    out = []
    for km in range(size):
        for kv in range(size):
            seen = {bits[s] for s in range(len(bits)) if s & km == kv}
            out.append(seen.pop() if len(seen) == 1 else X)
    return out
