"""Fill-in-middle rearrangement. Cuts in code points become byte offsets by a piecewise-linear learned rank index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voltgrain.llm.store import give_back
from voltgrain.llm.wordhash import pieces

SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts from which forms are drawn: h3 % 100 at or above the first stays plain, h4 % 100 below the second is suffix first.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Largest distance of a boundary from its segment; residuals, which also hold the rounding, fit a signed byte.
ERROR = 120
#: Boundaries looked at first when a segment grows; the window doubles while the segment holds.
WINDOW = 256
#: Bytes of text worked on at once; a longer text stands alone.
PIECE_BYTES = 4 << 20


@dataclass
class RankIndex:
    """Byte offset of every code point boundary: segments (first rank, its offset, slope) and one residual for each boundary."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, bounds: np.ndarray, error: int = ERROR) -> RankIndex:
        """Greedy segments over ``bounds`` (offsets of ranks 0, 1, …): each is the longest for which a line from its first point passes within ``error`` of all."""
        n, lo = len(bounds), 0
        ranks, slopes = [], []
        while lo < n:
            hi, width, low, high = lo + 1, WINDOW, -np.inf, np.inf
            while hi < n:
                stop = min(n, hi + width)
                run = np.arange(hi - lo, stop - lo, dtype=np.float64)
                rise = bounds[hi:stop] - bounds[lo]
                # slopes of the lines through the first point that pass all points so far
                upper = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                lower = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                if lower[-1] > upper[-1]:
                    keep = int((lower > upper).argmax())
                    if keep:
                        low, high = lower[keep - 1], upper[keep - 1]
                    hi += keep
                    break
                low, high, hi, width = lower[-1], upper[-1], stop, 2 * width
            ranks.append(lo)
            slopes.append((low + high) / 2 if hi > lo + 1 else 1.0)
            lo = hi
        index = cls(np.array(ranks, np.int64), bounds[ranks].astype(np.int64), np.array(slopes), np.zeros(0, np.int8))
        left = bounds - index.predict(np.arange(n))
        if n and max(-left.min(), left.max()) > 127:
            raise AssertionError("a residual leaves the signed byte")
        index.residuals = left.astype(np.int8)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """Offsets on the lines, rounded down."""
        s = np.searchsorted(self.ranks, rank, "right") - 1
        return self.offsets[s] + np.floor(self.slopes[s] * (rank - self.ranks[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets: the prediction and its stored residual."""
        return self.predict(rank) + self.residuals[rank]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets of all code point boundaries of UTF-8 bytes, the end included."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def draws(doc_id: object, seed: str) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id``; a null id is the word null."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Joining parts with such signs makes no further sign where they meet, so each stands once in an output."""
    if len(set(sentinels)) < 3 or any(len(s) < 3 or s[0] != "<" or s[-1] != ">" or set(s[1:-1]) & {"<", ">"} for s in sentinels):
        raise ValueError("sentinels are three different texts of the form <...>")
    return sentinels


def arrange(raw: bytes, doc_id: object, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, bytes, int]:
    """(code points, form, prefix and middle length in code points, output bytes, segments of the index) of one text."""
    index = RankIndex.fit(boundaries(np.frombuffer(raw, np.uint8)))
    n, signs = len(index.residuals) - 1, [s.encode() for s in sentinels]
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= PLAIN_FROM or any(s in raw for s in signs):
        return n, "plain", None, None, raw, len(index.ranks)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.offset(np.array([first, second])).tolist()
    p, s, m = signs
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        form, out = "spm", b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    else:
        form, out = "psm", b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))
    return n, form, first, second - first, out, len(index.ranks)


def fill_in_middle(docs: DataFrame, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, n_segments for every row; whole texts, one pass without a shuffle.

    A null or empty text is plain with an empty output, as is a text that holds a sentinel (its output is the text). Rows stand alone:
    repeated rows give repeated results, a null doc_id draws as the word null, an empty table gives no rows, other columns are
    ignored. Memory follows the longest text: its bytes, nine bytes a boundary and its output.
    """
    sentinels = _checked(tuple(sentinels))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("n_segments", T.LongType()),
        ]
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1, PIECE_BYTES):
            rows = [arrange((t or "").encode(), i, seed, sentinels) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            cols = [list(c) for c in zip(*rows)]
            cols[4] = pa.array(cols[4], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output: its parts found by the sentinels, put back in their order."""
    p, s, m = _checked(tuple(sentinels))
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring(F.substring_index(head, s, 1), len(p) + 1, 2**31 - 1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring(F.substring_index(head, p, 1), len(s) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
