"""Value-change text: header variables and change events, read in parallel splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.logic import value_code
from ..operators.ordered import ordered

SUFFIXES = (".vcd", ".vcd.gz")
# Time unit words of a header and their seconds.
UNITS = {"fs": 1e-15, "ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(trace, blk, line, text) of a trace file, in file order.

    A line's place is its file, the offset of its split in the file, and its running
    number inside the split; no global count is needed. Gzip files come as one split
    and are spread out afterwards by (trace, blk).
    """
    if not path.rstrip("/").endswith(SUFFIXES):
        raise ValueError(f"not a trace file: {path}")
    t = spark.read.text(path)
    return t.select(
        F.col("_metadata.file_path").alias("trace"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def header_end(lines: DataFrame, order: list[str]) -> DataFrame:
    """(trace, _end): place of the line that ends the header; one row for each trace that has one."""
    return lines.filter(F.col("text").contains("$enddefinitions")).groupBy("trace").agg(F.min(F.struct(*order)).alias("_end"))


def tokens(lines: DataFrame, order: list[str]) -> DataFrame:
    """One row per token of the body, which starts behind ``$enddefinitions`` (text without it is all body).

    A vector or real value stays together with its name.
    """
    pat = r"(?:[bBrR]\S+\s+\S+)|(?:\S+)"
    here = F.struct(*order)
    body = lines.join(header_end(lines, order), "trace", "left").filter(F.col("_end").isNull() | (here >= F.col("_end")))
    text = F.when(here == F.col("_end"), F.regexp_replace("text", r"^.*?\$enddefinitions(\s+\$end)?", "")).otherwise(F.col("text"))
    return body.select("trace", "blk", *order, F.posexplode(F.regexp_extract_all(text, F.lit(pat), F.lit(0))).alias("pos", "tok"))


def parse_changes(lines: DataFrame, order: list[str] = ["line"]) -> DataFrame:  # noqa: B006
    """Change events (trace, t, code, bits) of the body; ``$`` words are passed over, and comments with all they hold.

    ``lines`` has trace, blk, text and the order columns; ``blk`` must not decrease
    along them. The time of a value is the last ``#`` token before it, which may
    stand in an earlier block: only one time per block is handed on.
    """
    tk = tokens(lines, order)
    word = F.when(F.col("tok").startswith("$"), F.col("tok"))
    if not tk.filter("tok = '$comment'").isEmpty():
        tk = ordered(tk.withColumn("_w", word), ["trace"], [*order, "pos"], "blk", last_before={"_in": F.col("_w")})
        tk = tk.filter(F.coalesce(F.col("_in") != "$comment", F.lit(True))).drop("_w", "_in")
    time = F.when(F.col("tok").rlike(r"^#\d+$"), F.substr("tok", F.lit(2)).cast("bigint"))
    at = ordered(tk.filter(word.isNull()).withColumn("_t", time), ["trace"], [*order, "pos"], "blk", last_before={"t": F.col("_t")})
    v = at.filter(F.col("_t").isNull() & F.col("tok").rlike(r"^[01xXzZuUbB]"))
    vec = F.lower(F.substring("tok", 1, 1)) == "b"
    bits = F.when(vec, F.regexp_extract("tok", r"^[bB](\S+)\s", 1)).otherwise(F.substring("tok", 1, 1))
    code = F.when(vec, F.regexp_extract("tok", r"\s(\S+)$", 1)).otherwise(F.substr("tok", F.lit(2)))
    return v.select("trace", F.coalesce("t", F.lit(0).cast("bigint")).alias("t"), *order, "pos", code.alias("code"), bits.alias("bits"))


def scalar_value(bits: Column) -> Column:
    return value_code(F.substring(bits, -1, 1))


def statements(lines: DataFrame, order: list[str], kinds: list[str]) -> DataFrame:
    """(trace, blk, order, kind, args) of the header's statements of these kinds: the tokens from a ``$`` word to ``$end``, on however many lines."""
    here = F.struct(*order)
    head = lines.join(header_end(lines, order), "trace", "left").filter(F.col("_end").isNull() | (here <= F.col("_end")))
    tk = head.select("trace", "blk", *order, F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("pos", "tok"))
    opens = F.col("tok").startswith("$") & (F.col("tok") != "$end")
    tk = tk.withColumns({"_n": opens.cast("int"), "_w": F.when(F.col("tok").startswith("$"), F.col("tok"))})
    tk = ordered(tk, ["trace"], [*order, "pos"], "blk", sum_before={"_s": F.col("_n")}, last_before={"_k": F.col("_w")})
    tk = tk.withColumn("_stmt", F.col("_s") + F.col("_n")).withColumn("kind", F.when(F.col("_n") == 1, F.col("tok")).otherwise(F.col("_k")))
    tk = tk.filter(F.col("kind").isin(kinds) & (F.col("tok") != "$end"))
    g = tk.groupBy("trace", "_stmt", "kind").agg(F.min(F.struct("blk", *order, "pos")).alias("_at"), F.array_sort(F.collect_list(F.struct(*order, "pos", "tok"))).alias("_all"))
    args = F.filter(F.transform("_all", lambda x: x["tok"]), lambda x: ~x.startswith("$"))
    return g.select("trace", "_at.*", "kind", args.alias("args"))


def parse_header(lines: DataFrame, order: list[str] = ["line"]) -> DataFrame:  # noqa: B006
    """Variables (trace, code, name, scope, type, width, msb, lsb) from the header's statements.

    Depth is a running count of scope opens less closes, and the scope at depth k is the
    last one opened there, so both are prefix computations over blocks. The data tell how deep scopes go.
    """
    h = statements(lines, order, ["$scope", "$upscope", "$var"])
    order = [*order, "pos"]
    up, down = F.col("kind") == "$upscope", F.col("kind") == "$scope"
    h = h.withColumn("_step", F.when(down, 1).when(up, -1).otherwise(0))
    h = ordered(h, ["trace"], order, "blk", sum_before={"depth": F.col("_step")})
    deepest = (h.agg(F.max("depth")).first()[0] or 0) + 1
    at = {f"_s{k}": F.when(down & (F.col("depth") == k), F.get("args", F.lit(1))) for k in range(deepest)}
    h = ordered(h, ["trace"], order, "blk", last_before=at).filter((F.col("kind") == "$var") & (F.size("args") >= 4))
    arg = lambda i: F.get("args", F.lit(i))
    span = F.array_join(F.slice("args", F.lit(5), F.greatest(F.size("args") - 4, F.lit(0))), "")
    pat = r"^\[(\d+)(?::(\d+))?\]$"
    width, hi, lo = arg(1).try_cast("int"), F.regexp_extract(span, pat, 1).try_cast("int"), F.regexp_extract(span, pat, 2).try_cast("int")
    scope = F.slice(F.array(*[F.col(c) for c in at]), F.lit(1), F.col("depth").cast("int"))
    return h.select(
        "trace", arg(2).alias("code"), F.regexp_replace(arg(3), "/", r"\\/").alias("name"), scope.alias("scope"), arg(0).alias("type"), width.alias("width"),
        F.coalesce(hi, F.when(width > 1, width - 1).otherwise(0)).alias("msb"), F.coalesce(lo, hi, F.lit(0)).alias("lsb"))


def time_scale(lines: DataFrame, order: list[str] = ["line"]) -> DataFrame:  # noqa: B006
    """(trace, seconds per tick) from the time-scale statement."""
    pat = r"^(\d+)(fs|ps|ns|us|ms|s)$"
    text = F.array_join("args", "")
    unit = F.coalesce(*[F.when(F.regexp_extract(text, pat, 2) == u, s) for u, s in UNITS.items()])
    t = statements(lines, order, ["$timescale"]).filter(text.rlike(pat))
    return t.select("trace", (F.regexp_extract(text, pat, 1).cast("double") * unit).alias("time_scale"))
