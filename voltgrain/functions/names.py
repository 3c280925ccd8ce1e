"""Object names: globs, bus subscripts, hierarchy, escaping, and units."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def glob_to_regex(pattern: str) -> str:
    """``*`` any run, ``?`` any one character, all else literal; a backslash keeps the next character."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(ch, re.escape(ch)))
        i += 1
    return "".join(out)


def matches(col: Column, pattern: str, regexp: bool = False, nocase: bool = False) -> Column:
    """Whole-value match against a glob, or an anchored regular expression."""
    body = pattern if regexp else glob_to_regex(pattern)
    return col.rlike(("(?is)" if nocase else "(?s)") + "^(?:" + body + r")\z")


def split_path(path: Column, divider: str = "/") -> Column:
    """Levels of a path; an escaped divider stays inside its level."""
    return F.split(path, r"(?<!\\)" + re.escape(divider))


def first_level(path: Column, divider: str = "/") -> Column:
    return F.element_at(split_path(path, divider), 1)


def last_level(path: Column, divider: str = "/") -> Column:
    return F.element_at(split_path(path, divider), -1)


def depth(path: Column, divider: str = "/") -> Column:
    return F.size(split_path(path, divider))


def bus_parts(name: Column) -> Column:
    """struct(base, from, to, wildcard) of ``a[3:0]``, ``a[2]`` or ``a[*]``; null base when not a bus."""
    pat = r"^(.*[^\\])\[(?:(\d+)(?::(\d+))?|(\*))\]$"
    base = F.regexp_extract(name, pat, 1)
    lo, hi = F.regexp_extract(name, pat, 2), F.regexp_extract(name, pat, 3)
    is_bus = name.rlike(pat)
    return F.struct(
        F.when(is_bus, base).alias("base"),
        F.when(is_bus & (lo != ""), lo.try_cast("int")).alias("from"),
        F.when(is_bus & (lo != ""), F.when(hi != "", hi.try_cast("int")).otherwise(lo.try_cast("int"))).alias("to"),
        F.when(is_bus, F.regexp_extract(name, pat, 4) == "*").alias("wildcard"))


def escape_divider(name: Column, divider: str = "/") -> Column:
    return F.regexp_replace(name, r"(?<!\\)" + re.escape(divider), r"\\" + divider)


def unescape(name: Column) -> Column:
    return F.regexp_replace(name, r"\\(.)", "$1")


def to_netlist_name(name: Column) -> Column:
    """Netlist text form: names with characters outside the plain set get ``\\`` in front and a blank behind."""
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_$]*$"), name).otherwise(F.concat(F.lit("\\"), name, F.lit(" ")))


def from_netlist_name(name: Column) -> Column:
    return F.when(name.startswith("\\"), F.rtrim(F.substr(name, F.lit(2)))).otherwise(name)


def replace_last(name: Column, what: str, by: str) -> Column:
    """Replace only the last occurrence."""
    return F.regexp_replace(name, "(?s)^(.*)" + re.escape(what), "$1" + by.replace("\\", "\\\\"))


# Unit prefixes and their scale.
PREFIX = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9}


def to_unit(value: Column, prefix: str) -> Column:
    return value / PREFIX[prefix]


def from_unit(value: Column, prefix: str) -> Column:
    return value * PREFIX[prefix]


def format_unit(value: Column, prefix: str, suffix: str, digits: int = 3) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", to_unit(value, prefix)), F.lit(prefix + suffix))


REL_TOL, ABS_TOL = 1e-6, 1e-15


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Equal, both near zero, or within a relative tolerance of the larger."""
    near = F.abs(a - b) < REL_TOL * F.greatest(F.abs(a), F.abs(b))
    tiny = F.when(a == 0, F.abs(b) < ABS_TOL).when(b == 0, F.abs(a) < ABS_TOL)
    return (a == b) | F.coalesce(tiny, near)


def fuzzy_less(a: Column, b: Column) -> Column:
    return (a < b) & ~fuzzy_equal(a, b)


def max_frequency_mhz(min_period_s: Column) -> Column:
    """Null stands for no bound (a period of 0)."""
    return F.when(min_period_s > 0, 1e-6 / min_period_s)
