"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from voltgrain.llm.store import give_back, set_aside
from voltgrain.llm.wordhash import pieces, word_ids, words

WORD_BUCKETS = 1 << 13
#: Bins of a statistic; each (statistic, bin) is one feature.
BINS = 12
STATISTICS = ("log_words", "mean_word", "symbols", "shouts", "bars", "upper", "digits", "full_stops", "commas", "lines", "distinct", "n_chars")
FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)
#: Upper ends of the bins but the last: lengths as logarithms, all else as shares.
SHARES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
LENGTHS = np.array([0.7, 1.5, 2.5, 3.5, 4.2, 5.0, 5.7, 6.5, 7.5, 8.5, 10.0])
FACTORS, EPOCHS, RATE, DECAY, MINI = 6, 12, 0.05, 1e-4, 256
#: Bound of the labelled rows a model is fitted on.
MAX_TRAINING_ROWS = 12_000
BATCH_BYTES = 4 << 20


def _byte_set(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


SYMBOL, SHOUT, BAR, UPPER, DIGIT, STOP, COMMA = map(_byte_set, (b"#*$%&<>", b"!", b"|", bytes(range(65, 91)), bytes(range(48, 58)), b".", b","))


def features(texts: pa.Array, n_chars: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, feature ids, values) of the texts: one value for each distinct hashed word, share of the square-root counts, and one bin of each statistic."""
    n = len(texts)
    data, starts, ends, counts = words(texts, lower=False)
    row = np.repeat(np.arange(n), counts)
    ids = word_ids(data, starts, ends)
    key, times = np.unique(row * WORD_BUCKETS + (ids % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    r, f = key // WORD_BUCKETS, key % WORD_BUCKETS
    value = np.sqrt(times)
    norm = np.sqrt(np.bincount(r, value**2, n))
    value = value / norm[r]
    text_bytes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    bounds = np.concatenate([[0], np.cumsum(text_bytes)])

    def count(table: np.ndarray) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(table[data])])
        return hits[bounds[1:]] - hits[bounds[:-1]]

    w, b = np.maximum(counts, 1), np.maximum(text_bytes, 1)
    used = np.bincount(r, minlength=n)
    length = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)) if n_chars is None else np.asarray(pc.fill_null(n_chars.cast(pa.int64()), 0))
    lines = count(_byte_set(b"\n")) + 1
    stats = [np.log1p(counts), np.bincount(row, ends - starts, n) / w / 20, count(SYMBOL) / b, count(SHOUT) / b * 4, count(BAR) / w, count(UPPER) / b, count(DIGIT) / b, count(STOP) / w, count(COMMA) / w, lines / w, used / w, np.log1p(length)]
    bins = [np.searchsorted(LENGTHS if k in (0, 11) else SHARES, s) + WORD_BUCKETS + BINS * k for k, s in enumerate(stats)]
    r = np.concatenate([r, np.tile(np.arange(n), len(bins))])
    f = np.concatenate([f, *bins])
    value = np.concatenate([value, np.full(n * len(bins), 0.5)])
    order = np.argsort(r, kind="stable")
    return np.searchsorted(r[order], np.arange(n + 1)), f[order], value[order]


class Machine:
    """score = sigmoid(b + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j).

    The pair sum is half the sum over factors of (sum v_i x_i)^2 - sum (v_i x_i)^2, so a text costs its number of features times the number of factors.
    """

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def raw(self, bounds: np.ndarray, f: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = bounds[:-1]  # no row is without features
        vx = self.v[f] * x[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        return self.bias + np.add.reduceat(self.w[f] * x, at) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), at)), s

    def score(self, bounds: np.ndarray, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(bounds, f, x)[0], -35, 35)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> Machine:
    """Adaptive-gradient descent on the log loss over (features, values, label) rows; the rows are a bounded sample. No rows: every score 1/2."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.01, (FEATURES, FACTORS)))
    if not rows:
        m.v[:] = 0
        return m
    share = min(max(np.mean([y for *_, y in rows]), 0.01), 0.99)
    m.bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), MINI):
            part = [rows[i] for i in order[lo : lo + MINI]]
            bounds = np.concatenate([[0], np.cumsum([len(f) for f, *_ in part])])
            f, x, y = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]), np.array([p[2] for p in part])
            z, s = m.raw(bounds, f, x)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(part)
            each = np.repeat(np.arange(len(part)), np.diff(bounds))
            m.bias -= RATE * g.sum()
            touched, at = np.unique(f, return_inverse=True)
            dw = np.bincount(at, g[each] * x, len(touched)) + DECAY * m.w[touched]
            pull = (g[each] * x)[:, None] * (s[each] - m.v[f] * x[:, None])
            dv = np.stack([np.bincount(at, pull[:, k], len(touched)) for k in range(FACTORS)], axis=1) + DECAY * m.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            m.w[touched] -= RATE * dw / np.sqrt(gw[touched])
            m.v[touched] -= RATE * dv / np.sqrt(gv[touched])
    return m


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 5 = 0"), F.lit(False))


def _inputs(docs: DataFrame) -> list:
    return ["text", *([F.col("n_chars").cast("long").alias("n_chars")] if "n_chars" in docs.columns else [])]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Machine:
    """A machine fitted on at most ``max_rows`` labelled rows that are not held out, chosen by a hash of doc_id.

    Only the chosen ids are broadcast (a bounded number); features are computed on the executors, and only the features of
    the chosen rows (some kilobytes each) reach the driver. Of rows that share a doc_id the one with the smallest hash of its text counts. Labels null or other than 0 and 1, and null ids, are left out.
    """
    chosen = labels.select("doc_id", F.col("quality").alias("__label")).where("doc_id is not null and __label in (0, 1)").where(~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_rows)
    has_chars = "n_chars" in docs.columns
    inputs = ["text", "n_chars"] if has_chars else ["text"]
    rows = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(chosen), "doc_id")
    # rows that share a doc_id are one example, so never more than max_rows of them go on
    first = F.min(F.struct(F.xxhash64("text").alias("h"), *inputs, "__label")).alias("x")
    rows = rows.groupBy("doc_id").agg(first).select("doc_id", *[f"x.{c}" for c in inputs], "x.__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1, BATCH_BYTES):
            bounds, f, x = features(b.column(1), b.column(2) if has_chars else None)
            cut = lambda a: pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(a)).cast(pa.list_(pa.array(a).type))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), cut(f.astype(np.int32)), cut(x.astype(np.float32)), b.column(b.num_columns - 1).cast(pa.int32())], names=["doc_id", "f", "x", "label"])

    got = rows.mapInArrow(run, "doc_id long, f array<int>, x array<float>, label int").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    return fit_machine([(np.asarray(f.values), np.asarray(x.values, np.float64), y.as_py()) for f, x, y in zip(got["f"], got["x"], got["label"])])


def score(docs: DataFrame, machine: Machine, all_columns: bool = False) -> DataFrame:
    """doc_id (or all columns of ``docs``) with held_out, score and predicted of every row.

    Inputs are the text and, where there is one, n_chars; labels, lang, source and doc_id are none. Null and empty texts are scored
    by their statistics alone; a null doc_id counts as not held out; repeated rows get equal scores; an empty table
    gives no rows. With ``all_columns``, columns that have the name of a result are replaced.
    """
    new = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")] if all_columns else ["doc_id"]
    old = [docs.schema[c] for c in names]
    has_chars = "n_chars" in docs.columns
    source = docs.select(*names, held_out("doc_id").alias("held_out"), docs["text"].alias("__voltgrain_text"), *([F.col("n_chars").cast("long").alias("__voltgrain_n")] if has_chars else []))
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, k + 1, BATCH_BYTES):
            s = machine.score(*features(b.column(k + 1), b.column(k + 2) if has_chars else None))
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], pa.array(s), pa.array((s >= 0.3).astype(np.int32))], names=[*names, "held_out", "score", "predicted"])
        give_back()

    return source.mapInArrow(run, T.StructType([*old, *new]))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Documents predicted 1 by a machine fitted on the labelled rows of ``learn_from``, else on those among the documents.

    After other filters few bad documents are left to learn from, so a pipeline passes the table before them. All columns stay, whatever their names.
    """
    own, back = set_aside(docs, ["held_out", "score", "predicted"])
    machine = fit(docs if learn_from is None else learn_from, labels)
    return score(own, machine, all_columns=True).where("predicted = 1").select(*own.columns).withColumnsRenamed(back)
