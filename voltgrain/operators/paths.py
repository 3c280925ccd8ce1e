"""The k worst paths of each end or group: a path is its parent with one edge diverted, found best-first in rounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut, cut_watch, sized
from .graph import Levelled, advanced, union_all

#: Stands for the edge into a vertex where a path starts.
START = -1


class PathSearch:
    """In-edges of all vertices with the worst arrival of their starts, for one side (``max``: latest, ``min``: earliest).

    Every vertex has its worst edge; a path follows these but where it is diverted. Diversions are listed from the end to the start as (v, rf, e_id).
    An edge number need only be unique among the edges into one (v, rf).
    """

    def __init__(self, g: Levelled, seeds: DataFrame, arr: DataFrame, tags: Sequence[str] = ("clk",), which: str = "max", advance: Mapping[str, Column] | None = None):
        self.tags, self.sign, self.depth = list(tags), 1 if which == "max" else -1, g.depth
        a, worst, d = f"a_{which}", F.coalesce(f"e_{which}", F.lit(START)), f"d_{which}"
        self.arr = arr.select("v", "rf", *tags, F.col(a).alias("total"), worst.alias("e"))
        start = arr.select(F.col("v").alias("from_v"), F.col("rf").alias("from_rf"), *tags, F.col(a).alias("_a"), worst.alias("_e"))
        moved = advanced(tags, advance, g.columns())
        j = start.join(g.edges, ["from_v", "from_rf"]).select(
            F.col("to_v").alias("v"), F.col("to_rf").alias("rf"), *[moved[t].alias(t) for t in tags], F.col("from_v").alias("pv"), F.col("from_rf").alias("prf"), *[F.col(t).alias(f"p_{t}") for t in tags],
            "e_id", F.col(d).alias("d"), (F.col("_a") + F.col(d)).alias("reach"), F.col("_e").alias("pe"))
        best = F.max(a) if which == "max" else F.min(a)
        s = seeds.groupBy("v", "rf", *tags).agg(best.alias("reach"))
        none = {"pv": F.lit(None), "prf": F.lit(None), **{f"p_{t}": F.lit(None) for t in tags}, "e_id": F.lit(START), "d": F.col("reach"), "pe": F.lit(None)}
        types = dict(j.dtypes)
        s = s.select(*[(none[c] if c in none else F.col(c)).cast(types[c]).alias(c) for c in j.columns])
        self.into = cut(j.unionByName(s))

    def _best(self, paths: DataFrame, k: int) -> DataFrame:
        w = W.partitionBy("end_id").orderBy((self.sign * F.col("total")).desc(), F.size("diverted"), "diverted", "ev", "erf", *[f"e_{t}" for t in self.tags])
        return paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def k_worst(self, ends: DataFrame, k: int) -> DataFrame:
        """(end_id, rank, total, ev, erf, e_<tags>, diverted) of the k worst paths of each ``end_id``.

        ``ends``: end_id, v, rf and the tags; an end_id may name one end or a whole group of ends. Exact: a path is no worse than the parent from which it
        is diverted, so once all k best known paths are expanded none is missing. A round expands all that are new among the k best; the
        number of rounds is that of diversions in a path. The limit k applies before the shuffle, so ends or vertices with many edges send k rows a task.
        """
        key = ["v", "rf", *self.tags]
        none = F.array().cast(f"array<struct<v:{dict(self.into.dtypes)['v']},rf:string,e_id:bigint>>")
        first = ends.select("end_id", *key).join(self.arr, key)
        first = first.select("end_id", *key, *[F.col(c).alias(f"e_{c}" if c in self.tags else f"e{c}") for c in key], "e", (F.col("total") * 0).alias("suffix"), "total", none.alias("diverted"), F.lit(True).alias("fresh"))
        known = cut(self._best(first, k))
        while True:
            cur, found = known.filter("fresh").drop("rank", "fresh", "total"), []
            for _ in range(self.depth + 1):
                j, n = cut_watch(cur.join(self.into, key), F.col("e_id") == F.col("e"))
                if not n:
                    break
                end = ["end_id", "ev", "erf", *[f"e_{t}" for t in self.tags]]
                tail = [F.col("pv").alias("v"), F.col("prf").alias("rf"), *[F.col(f"p_{t}").alias(t) for t in self.tags], F.col("pe").alias("e"), (F.col("suffix") + F.col("d")).alias("suffix")]
                other = j.filter("e_id <> e").select(*end, *tail, (F.col("reach") + F.col("suffix")).alias("total"), F.concat("diverted", F.array(F.struct("v", "rf", "e_id"))).alias("diverted"), F.lit(True).alias("fresh"))
                found.append(self._best(other, k).drop("rank"))
                cur = j.filter(f"e_id = e and e_id <> {START}").select(*end, *tail, "diverted")
            known, n = cut_watch(self._best(union_all([known.drop("rank").withColumn("fresh", F.lit(False)), *found]), k), F.col("fresh"))
            if not n:
                return known.drop("fresh", "suffix", "e", *key)

    def points(self, paths: DataFrame) -> DataFrame:
        """(end_id, rank, step, v, rf, tags, e_id, time): the points of each path from its end (step 0) to its start, e_id the edge by which it came, null at the start."""
        key = ["v", "rf", *self.tags]
        at_end = {"v": "ev", "rf": "erf", **{t: f"e_{t}" for t in self.tags}}

        def chosen(v: str, rf: str, worst: str) -> Column:
            hit = F.filter("diverted", lambda x: (x["v"] == F.col(v)) & (x["rf"] == F.col(rf)))
            return F.coalesce(F.get(hit, F.lit(0))["e_id"], F.col(worst))

        cur = paths.select("end_id", "rank", "total", "diverted", *[F.col(c).alias(k) for k, c in at_end.items()]).join(self.arr.drop("total"), key)
        cur = cur.withColumn("e_id", chosen("v", "rf", "e")).withColumn("time", F.col("total")).drop("e", "total")
        out = []
        for step in range(self.depth + 2):
            j, n = cut_watch(cur.join(self.into, [*key, "e_id"]), F.lit(True))
            if not n:
                break
            out.append(j.select("end_id", "rank", F.lit(step).alias("step"), *key, F.when(F.col("e_id") != START, F.col("e_id")).alias("e_id"), "time"))
            cur = j.filter(F.col("e_id") != START).select("end_id", "rank", "diverted", F.col("pv").alias("v"), F.col("prf").alias("rf"), *[F.col(f"p_{t}").alias(t) for t in self.tags],
                                                         chosen("pv", "prf", "pe").alias("e_id"), (F.col("time") - F.col("d")).alias("time"))
        return union_all(out)


#: So many arrivals may be broadcast to the edges that leave them.
FEW_STARTS = 1_000_000


def k_worst_from_ends(g: Levelled, seeds: DataFrame, arr: DataFrame, ends: DataFrame, k: int, tags: Sequence[str] = ("clk",), which: str = "max") -> DataFrame:
    """(end_id, rank, total, ev, erf, e_<tags>, points) of the k worst paths of each ``end_id`` (end_id, v, rf, tags), in one pass from the ends to the starts.

    ``points``: v, rf, e_id (null at the start) and d, from the end to the start; d adds up to the total. Every part of a path behind a vertex stands for its
    worst completion, the vertex's arrival in ``arr`` (as a sweep returns it) before it. Exact: a part that is not among the k worst of its end has k others before it, each with a path no better than any
    of its own; so a step keeps k parts an end, and reads only the edges into the vertices of its level. ``PathSearch`` reads all edges again in each of its rounds.
    Which of equally bad paths stay is left open. Tags must not change on the way.
    """
    key, a = ["v", "rf", *tags], f"a_{which}"
    name = {c: f"e_{c}" if c in tags else f"e{c}" for c in key}
    sign, best = (1, F.max) if which == "max" else (-1, F.min)
    first = g.place(seeds.groupBy(*key).agg(best(a).alias("reach")))
    point = f"array<struct<v:{dict(ends.dtypes)['v']},rf:string,e_id:bigint,d:{dict(arr.dtypes)[a]}>>"
    fixed = ["end_id", *name.values()]

    def at(rows: DataFrame, levels: set[int] | None) -> DataFrame:
        return rows if levels is None else rows.filter(F.col("level").isin(sorted(levels)))

    cur = ends.select("end_id", *key, *[F.col(c).alias(n) for c, n in name.items()], F.array().cast(point).alias("points"))
    cur = cut(cur.hint("merge").join(arr.select(*key, (F.col(a) * 0).alias("suffix")), key).withColumn("part", F.monotonically_increasing_id()))
    levels = {r[0] for r in g.place(cur.select("v")).select("level").distinct().collect()} if g.source is not None else None
    starts = {r[0] for r in first.select("level").distinct().collect()} if levels is not None else set()
    done, none, total = None, F.lit(None), (F.col("reach") + F.col("suffix")).alias("total")
    for _ in range(g.depth + 1):
        before, d = None if levels is None else {x - 1 for x in levels}, F.col(f"_e.d_{which}")
        slim = cur.drop("points", *name.values())
        # Few vertices, as the starts are, are looked up where the parts meet their edges; the k best leave a task.
        reach = sized(at(arr, before).select(*[F.col(c).alias(f"_{c}") for c in key], F.col(a).alias("reach")), FEW_STARTS)
        types = dict(cur.dtypes)
        at_start = levels is None or bool(levels & starts)
        whole = slim.join(sized(at(first, levels).drop("level"), FEW_STARTS) if at_start else first.drop("level").limit(0), key).select("end_id", "part", *[none.cast(types[c]).alias(f"_{c}") for c in key], none.cast("bigint").alias("e_id"), F.col("reach").alias("d"), total, F.col("suffix"))
        more = g.into(slim, levels).select("end_id", "part", F.col("from_v").alias("_v"), F.col("_e.from_rf").alias("_rf"), *[F.col(t).alias(f"_{t}") for t in tags], F.col("_e.e_id").alias("e_id"), d.alias("d"), (F.col("suffix") + d).alias("suffix"))
        more = more.join(reach, [f"_{c}" for c in key]).select(*whole.columns[:-2], total, "suffix")
        old = [] if done is None else [done.select("end_id", "part", *[none.cast(types[c]).alias(f"_{c}") for c in key], none.cast("bigint").alias("e_id"), none.cast(dict(more.dtypes)["d"]).alias("d"), "total", none.cast(types["suffix"]).alias("suffix"))]
        w = W.partitionBy("end_id").orderBy((sign * F.col("total")).desc(), "part", "e_id")
        found = union_all([*old, *([whole] if at_start else []), more]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        # The points stay with the parts and join the k best only.
        parts = cur.select("end_id", "part", "v", "rf", *name.values(), "points")
        if done is not None:
            parts = parts.unionByName(done.select("end_id", "part", none.cast(types["v"]).alias("v"), none.cast("string").alias("rf"), *name.values(), "points"))
        new = F.when(F.col("v").isNull(), F.col("points")).otherwise(F.concat("points", F.array(F.struct("v", "rf", "e_id", "d")).cast(point)))
        found = found.join(parts.hint("merge"), ["end_id", "part"]).select(*fixed, *[F.col(f"_{c}").alias(c) for c in key], "suffix", "total", "rank", new.alias("points"))
        found, n = cut_watch(found.withColumn("part", F.monotonically_increasing_id()), F.col("v").isNotNull())
        if not n:
            return found.select("end_id", "rank", "total", *name.values(), "points")
        done, cur = found.filter("v is null").drop("rank"), found.filter("v is not null").drop("rank", "total")
        levels = before
    raise ValueError("arrivals of vertices that no start reaches")


#: So many vertices may be broadcast to pick their edges.
FEW_VERTICES = 100_000


def k_worst_unique_from_ends(g: Levelled, seeds: DataFrame, arr: DataFrame, ends: DataFrame, k: int, tags: Sequence[str] = ("clk",), which: str = "max") -> DataFrame:
    """(end_id, rank, time, vertices) of the k worst paths of each ``end_id`` (end_id, v, rf, tags) that pass different vertices, in one pass from the ends to the starts.

    Paths that differ in edges, transitions or tags only are one, with the worst time of all. ``vertices`` is the list from start to end. A list behind a vertex stands for its worst
    completion, the arrival in ``arr`` (as a sweep returns it) before it. Exact: the completions of different lists are different, so a list that is not among the k
    worst of its end has k others before it; a step keeps k lists an end, with all their transitions. ``k_worst_unique`` keeps k lists at every vertex; this one reads only edges into lists that are
    still open. Of equally bad lists the smaller (by vertices, nearest to the start) stay. Tags must not change on the way.
    """
    key, a = ["v", "rf", *tags], f"a_{which}"
    sign, best = (1, F.max) if which == "max" else (-1, F.min)
    first = g.place(seeds.groupBy(*key).agg(best(a).alias("reach")))
    lists = f"array<{dict(ends.dtypes)['v']}>"
    point, none = ["rf", *tags, "suffix"], F.lit(None)

    def at(rows: DataFrame, levels: set[int] | None) -> DataFrame:
        return rows if levels is None else rows.filter(F.col("level").isin(sorted(levels)))

    cur = cut(ends.join(arr.select(*key, (F.col(a) * 0).alias("suffix")), key).select("end_id", *key, "suffix", F.array("v").cast(lists).alias("vertices")))
    levels = {r[0] for r in g.place(cur.select("v")).select("level").distinct().collect()} if g.source is not None else None
    done = None
    for _ in range(g.depth + 1):
        before = None if levels is None else {x - 1 for x in levels}
        few = cur.select("v").distinct().limit(FEW_VERTICES + 1).count() <= FEW_VERTICES
        whole = cur.join(at(first, levels).drop("level"), key).groupBy("end_id", "vertices").agg(best(F.col("reach") + F.col("suffix")).alias("time"))
        whole = whole.select("end_id", "vertices", none.cast(dict(ends.dtypes)["v"]).alias("v"), "time", none.alias("points"))
        more = g.into(cur, levels, few).select("end_id", F.col("from_v").alias("_v"), F.col("_e.from_rf").alias("_rf"), *tags, (F.col("suffix") + F.col(f"_e.d_{which}")).alias("suffix"), F.concat(F.array("from_v"), "vertices").cast(lists).alias("vertices"))
        more = more.withColumnsRenamed({"_v": "v", "_rf": "rf"}).groupBy("end_id", "vertices", *key).agg(best("suffix").alias("suffix"))
        # Written, so that few lists are broadcast and the arrivals stay where they are.
        more = cut(more).join(at(arr, before).select(*key, F.col(a).alias("reach")), key)
        more = more.groupBy("end_id", "vertices", "v").agg(best(F.col("reach") + F.col("suffix")).alias("time"), F.collect_list(F.struct(*point)).alias("points"))
        whole = whole.withColumn("points", F.col("points").cast(dict(more.dtypes)["points"]))
        w = W.partitionBy("end_id").orderBy((sign * F.col("time")).desc(), "vertices", F.col("v").isNull())
        found = union_all([*([] if done is None else [done]), whole, more]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found, n = cut_watch(found, F.col("v").isNotNull())
        if not n:
            return found.select("end_id", "rank", "time", "vertices")
        done = found.filter("v is null").drop("rank")
        cur = found.filter("v is not null").select("end_id", "v", "vertices", F.inline("points"))
        levels = before
    raise ValueError("arrivals of vertices that no start reaches")


def k_worst_unique(g: Levelled, seeds: DataFrame, k: int, tags: Sequence[str] = ("clk",), which: str = "max") -> DataFrame:
    """The k worst paths into every (v, rf) that pass different vertices: v, rf, tags, sig, time, rank, and the row each extends (p_v, p_rf, p_sig, e_id; null at a start).

    Paths that differ in edges or transitions only are one, with the worst time of all. ``sig`` is a 128-bit hash of the vertex
    list, folded along the path, so equal lists meet in one group before the limit. Exact: where a list is not among the k worst of a
    vertex, k other lists lead on through the same edge. The limit applies before the shuffle of the ranking too.
    """
    tags, d = list(tags), f"d_{which}"
    worst = F.max if which == "max" else F.min
    order = F.desc("time") if which == "max" else F.asc("time")

    def folded(before: Column, v: str) -> Column:
        return F.struct(F.xxhash64(F.lit(1), before["a"], before["b"], v).alias("a"), F.xxhash64(F.lit(2), before["a"], before["b"], v).alias("b"))

    def receive(j: DataFrame) -> DataFrame:
        return j.select(
            F.col("to_v").alias("v"), F.col("to_rf").alias("rf"), *tags, folded(F.col("from_sig"), "to_v").alias("sig"), (F.col("time") + F.col(d)).alias("time"), F.lit(0).alias("rank"),
            F.col("from_v").alias("p_v"), F.col("from_rf").alias("p_rf"), F.col("from_sig").alias("p_sig"), "e_id", "to_level")

    def merge(rows: DataFrame) -> DataFrame:
        # The worst of a list; ties go to the smaller edge and transition.
        sign = F.col("time") if which == "max" else -F.col("time")
        back = F.min(F.struct((-sign).alias("o"), "e_id", "p_rf", "p_v", "p_sig"))
        one = rows.groupBy("v", "rf", *tags, "sig").agg(worst("time").alias("time"), back.alias("_b"), F.first("level").alias("level"))
        w = W.partitionBy("v", "rf", *tags).orderBy(order, "sig")
        one = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return one.select("v", "rf", *tags, "sig", "time", "rank", *[F.col(f"_b.{c}").alias(c) for c in ("p_v", "p_rf", "p_sig", "e_id")], "level")

    zero = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    none = F.lit(None)
    kind = g.columns()
    s = seeds.select("v", "rf", *tags, folded(zero, "v").alias("sig"), F.col(f"a_{which}").alias("time"), none.cast(kind["from_v"]).alias("p_v"),
                     none.cast("string").alias("p_rf"), none.cast("struct<a:bigint,b:bigint>").alias("p_sig"), none.cast("bigint").alias("e_id"))
    return g.sweep(g.place(s), receive, merge, {"sig": "from_sig"}, ["rank", "p_v", "p_rf", "p_sig", "e_id"])


def unique_ends(found: DataFrame, ends: DataFrame, k: int, tags: Sequence[str] = ("clk",), which: str = "max") -> DataFrame:
    """The k worst different vertex lists of each end (v, tags), whatever the transition at the end; ``found`` from ``k_worst_unique`` with at least k."""
    order = F.desc("time") if which == "max" else F.asc("time")
    rows = found.join(ends.select("v").distinct(), "v", "left_semi")
    best = (F.max_by if which == "max" else F.min_by)(F.struct("rf", "time"), F.struct("time", "rf"))
    one = rows.groupBy("v", *tags, "sig").agg(best.alias("_b")).select("v", *tags, "sig", "_b.rf", "_b.time")
    w = W.partitionBy("v", *tags).orderBy(order, "sig")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unique_lists(found: DataFrame, paths: DataFrame, depth: int, tags: Sequence[str] = ("clk",)) -> DataFrame:
    """``paths`` with ``vertices``, their vertex list from start to end. Walks one edge per round."""
    back = found.select("v", "rf", *tags, "sig", "p_v", "p_rf", "p_sig")  # a sweep has written its rows
    key = ["v", "rf", *tags, "sig"]
    cur = paths.select(F.struct(*paths.columns).alias("_path"), *key, F.array().cast(f"array<{dict(paths.dtypes)['v']}>").alias("vertices"))
    out = []
    for _ in range(depth + 1):
        j, n = cut_watch(cur.join(back, key).withColumn("vertices", F.concat(F.array("v"), "vertices")), F.col("p_v").isNotNull())
        out.append(j.filter("p_v is null").select("_path.*", "vertices"))
        if not n:
            break
        cur = j.filter("p_v is not null").select("_path", F.col("p_v").alias("v"), F.col("p_rf").alias("rf"), *tags, F.col("p_sig").alias("sig"), "vertices")
    return union_all(out)


def rank_slacks(ends: DataFrame, limit: int, group: str, keys: Sequence[str]) -> DataFrame:
    """The ``limit`` worst ends of each group by slack; among latch ends of slack 0 the larger ``borrow`` comes first, then ``keys``. A null borrow is no latch."""
    tie = F.when((F.col("slack") == 0) & F.col("borrow").isNotNull(), -F.col("borrow")).otherwise(F.lit(0))
    w = W.partitionBy(group).orderBy("slack", tie, *keys)
    return ends.withColumn("group_rank", F.row_number().over(w)).filter(F.col("group_rank") <= limit)
