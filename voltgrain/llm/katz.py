"""Katz backoff language model over words: counts, Good-Turing discounts, normalised backoff weights, scores of texts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voltgrain.llm.store import Scratch, give_back, rows_per_batch
from voltgrain.llm.wordhash import mix, pieces, word_ids, words

#: Text bytes of one piece, of one bucket of word pairs (half of that for longer n-grams), and how many of these share a bucket of words.
PIECE_BYTES, BUCKET_BYTES, WIDER = 10 << 20, 24 << 20, 2
#: Rows of an Arrow batch, about a piece of usual texts.
BATCH_ROWS = 3000
#: Pieces of an Arrow batch.
BATCH_PIECES = 4
#: Counts up to this one are discounted.
K = 5
#: Parts, by bucket, in which n-grams of three words and more are counted and weighed one after another, so that only one part's shuffles lie on disk.
SHARES = 3
#: Bits that the digits of a context's id may take before it is hashed.
ID_BITS = 63
#: Least number of n-grams of each count that is smoothed: a tenth of standard error.
ENOUGH = 100
END = mix(np.array([2], np.uint64))[0]
SALT = np.uint64(0xA5A5A5A5A5A5A5A5)


def pack(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def gaps(ids: np.ndarray) -> np.ndarray:
    """Ascending ids as the differences to those before, byte plane by byte plane, which leaves the high planes empty."""
    return planes(np.diff(ids, prepend=np.uint64(0)))


def planes(x: np.ndarray) -> np.ndarray:
    """Whole numbers byte plane by byte plane."""
    return np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8).T.copy()


def whole(x: np.ndarray) -> np.ndarray:
    """The numbers of these planes."""
    return np.ascontiguousarray(x.T).view(np.uint64).ravel()


def ids_of(x: np.ndarray) -> np.ndarray:
    """The ids of these gaps."""
    return np.cumsum(whole(x), dtype=np.uint64)


def _factors(n: np.ndarray) -> np.ndarray:
    """Katz's factors of the counts 1 to K from n[1], ..., n[K + 1]."""
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (K + 1) * n[K + 1] / n[1]
        return ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - common) / (1 - common)


def discounts(n: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Discount factors of the counts 0 to K from n, the numbers of n-grams that are seen so many times (0, 1, ... where ``seen`` is not given).

    Katz's factors of Good and Turing's r* = (r + 1) n[r + 1] / n[r], scaled so that the mass of the n-grams seen once
    goes to unseen ones. Where the raw counts of counts give a factor outside (0, 1), they are smoothed as in Simple
    Good-Turing: a line through log(n[r] / half the distance of the neighbouring counts) over log r, for all counts. Half a count
    is taken off each only where one of n[1] to n[K + 1] is under ENOUGH, or the line falls less than 1 / r.
    """
    seen = np.arange(len(n)) if seen is None else seen
    seen, n = seen[(n > 0) & (seen > 0)], n[(n > 0) & (seen > 0)].astype(float)
    low = np.zeros(K + 2)
    low[seen[seen <= K + 1]] = n[seen <= K + 1]
    fine = lambda d: bool(np.isfinite(d).all() and (d > 0).all() and (d < 1).all())
    d = _factors(low)
    if not fine(d) and low[1:].min() >= ENOUGH:
        before = np.concatenate([[0], seen[:-1]])
        after = np.concatenate([seen[1:], [2 * seen[-1] - before[-1]]])
        slope = np.polyfit(np.log(seen), np.log(2 * n / (after - before)), 1)[0]
        d = _factors(np.maximum(np.arange(K + 2), 1) ** slope)
    if not fine(d):
        d = 1 - 0.5 / np.arange(1, K + 1)
    return np.concatenate([[0.0], d])


def counts_of_counts(count: np.ndarray) -> list[list[int]]:
    """The counts above 0 that occur, and how often each does."""
    return [x.tolist() for x in np.unique(count[count > 0], return_counts=True)]


def _sum_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of n-grams, their counts) over all buckets; there are at most about the square root of twice the tokens."""
    got = rows.select(F.explode(F.arrays_zip(F.col("seen")[0].alias("r"), F.col("seen")[1].alias("n"))).alias("x")).groupBy("x.r").agg(F.sum("x.n").alias("n")).orderBy("r").collect()
    return np.array([x["n"] for x in got], np.int64), np.array([x["r"] for x in got], np.int64)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= K, d[np.minimum(count, K)] * count, count)


@dataclass
class Words:
    """Totals of the training words: tokens, distinct tokens, numbers of words and their counts, discount factors, mass of an unknown word."""

    n: int
    distinct: int
    numbers: np.ndarray
    seen: np.ndarray

    def __post_init__(self):
        self.d = discounts(self.numbers, self.seen)
        # one more count than there are tokens stands for unknown words, so their mass is never nothing
        self.unknown = (1 + sum((1 - self.d[r]) * r * n for n, r in zip(self.numbers, self.seen) if r <= K)) / (self.n + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / (self.n + 1), self.unknown)


@dataclass
class Ids:
    """Dense ids of words: 0 is the start, then place by falling count in a bucket of words, bucket by bucket.

    A context of m words is the number that its ids are the digits of, while that fits ``bits``; a hash beyond.
    """

    n_words: int = 1
    size: int = 1
    end: int = -1
    bits: int = 63

    def exact(self, length: int) -> bool:
        return self.size**length < 1 << self.bits

    def extend(self, ctx: np.ndarray, word: np.ndarray, length: int) -> np.ndarray:
        """Ids of the contexts of ``length`` words that contexts and the words after them make together."""
        return ctx * np.uint64(self.size) + word if self.exact(length) else mix(ctx * np.uint64(0x9E3779B97F4A7C15) + word)

    def start(self, length: int) -> np.ndarray:
        """Id of the context of so many starts, in which a text begins."""
        c = np.zeros(1, np.uint64)
        for m in range(2, length + 1):
            c = self.extend(c, np.zeros(1, np.uint64), m)
        return c

    def carried(self, order: int) -> bool:
        """Whether contexts of n-grams do not show their suffixes (the contexts without their first word)."""
        return order > 2 and not self.exact(order - 1)

    def suffixes(self, ctx: np.ndarray, order: int) -> np.ndarray:
        return ctx % np.uint64(self.size ** (order - 2))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending values, where each of them stands once, which of them each element is)"""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], order[new], at


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the runs of equal neighbours, their lengths)"""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return x[at], np.diff(at, append=len(x))


def coded(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as places in the list of the different ones, where many are equal."""
    at, values = pd.factorize(p)
    return (values, small(at)) if 2 * len(values) < len(p) else (p, np.zeros(0, np.uint8))


def decoded(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(at) else values


def _texts(docs: DataFrame):
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of the table: its number, its training rows, and packed its doc_ids, which are held out, their numbers of tokens, the hashes of its words and which of these each token is.

    Tokens are words in order, then one end for each text. What follows reads these rows, so all passes see the same pieces and no text is read twice."""
    part, at = TaskContext.get().partitionId(), 0
    for b in pieces(batches, 2, PIECE_BYTES):
        data, starts, ends, counts = words(b.column(2))
        tok = np.full(len(starts) + b.num_rows, END)
        tok[np.arange(len(starts)) + np.repeat(np.arange(b.num_rows), counts)] = word_ids(data, starts, ends)
        own, _, w = distinct(tok)
        held = np.asarray(b.column(1).to_pylist(), bool)
        packed = pack(b.column(0).to_pylist(), held, small(counts + 1), gaps(own), small(w))
        yield pa.RecordBatch.from_arrays([pa.array([(part << 33) + at]), pa.array([int((~held).sum())]), pa.array([packed], pa.binary())], names=["piece", "n_train", "data"])
        at += b.num_rows
        give_back()


def _by_bucket(bucket: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by bucket, where each bucket starts in it)"""
    order = np.argsort(bucket.astype(np.min_scalar_type(n_buckets)), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    k, piece, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "piece", "data"])


def _word_buckets(own: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    return _by_bucket((own % np.uint64(n_words)).astype(np.int64), n_words)


def _word_blobs(n_words: int):
    """For each piece and bucket the words and how often training rows have them; nothing for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data in zip(b.column(0).to_pylist(), b.column(1)):
                _, held, sizes, own, w = unpack(data.as_py())
                own = ids_of(own)
                count = np.bincount(w, np.repeat(~held, sizes), len(own)).astype(np.int64)
                order, first = _word_buckets(own, n_words)
                mine = [order[first[k] : first[k + 1]] for k in range(n_words)]
                yield _blob_rows([(k, piece, pack(gaps(own[i]), small(count[i]))) for k, i in enumerate(mine) if len(i)])
                give_back()

    return run


def _count_words(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of one bucket of words, most frequent first, and for each piece the places of its words in that list and their counts."""
    blobs = [unpack(x) for x in group["data"]]
    every = [ids_of(b[0]) for b in blobs]
    vocabulary, _, at = distinct(np.concatenate(every))
    count = np.bincount(at, np.concatenate([b[1] for b in blobs]), len(vocabulary)).astype(np.int64)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    end = np.flatnonzero(vocabulary == END)
    rows = [("words", -1, pack(small(count[order])), int(count.sum()), int((count > 0).sum()), len(order), int(place[end[0]]) if len(end) else -1, counts_of_counts(count))]
    start = 0
    for piece, w in zip(group["piece"], every):
        mine = at[start : start + len(w)]
        rows.append(("reply", piece, pack(small(place[mine]), small(count[mine])), 0, 0, 0, -1, []))
        start += len(w)
    del blobs, every, vocabulary, count, at, order, place
    give_back()
    out = pd.DataFrame(rows, columns=["kind", "piece", "data", "n", "distinct", "size", "end", "seen"])
    out.insert(0, "bucket", group["bucket"].iloc[0])
    return out


def _recode(n_words: int, per_token: float):
    """A piece with dense ids in place of hashes, and the base scores and numbers of known tokens of its texts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(group["bucket"], group["data"]))
        ids, held, sizes, own, w = unpack(by.pop(-1))
        own = ids_of(own)
        order, first = _word_buckets(own, n_words)
        dense, count = np.empty(len(own), np.uint64), np.empty(len(own), np.int64)
        for k, data in by.items():
            mine, (place, c) = order[first[k] : first[k + 1]], unpack(data)
            dense[mine], count[mine] = 1 + place.astype(np.uint64) * np.uint64(n_words) + np.uint64(k), c
        row = np.repeat(np.arange(len(held)), sizes)
        base = np.bincount(row, (np.log10(count + 0.1) - per_token)[w], len(held))
        known = np.bincount(row, (count > 0)[w], len(held)).astype(np.int64)
        order = np.argsort(dense)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        give_back()
        return pd.DataFrame([(group["piece"].iloc[0], pack(ids, held, sizes, base, known, gaps(dense[order]), small(rank[w])))], columns=["piece", "data"])

    return run


@dataclass
class Level:
    """How the n-grams of one order lie: buckets, and contexts spread over several of them (id: times in training rows, buckets)."""

    order: int
    n_buckets: int
    hot: dict[int, tuple[int, int]]
    ids: Ids

    def bucket(self, ctx: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        return ((word - np.uint64(1)) % np.uint64(self.n_buckets)).astype(np.int64) if self.order == 1 else _bucket(ctx, word, self.n_buckets, self.hot)


def _bucket(ctx: np.ndarray, word: np.ndarray, n_buckets: int, hot: dict[int, tuple[int, int]]) -> np.ndarray:
    """Bucket of an n-gram: that of its context; a hot context is spread over as many buckets as its share of all tokens asks for."""
    out = mix(ctx) % np.uint64(n_buckets)
    if hot:
        keys = np.array(sorted(hot), np.uint64)
        at = np.minimum(np.searchsorted(keys, ctx), len(keys) - 1)
        is_hot = keys[at] == ctx
        split = np.array([hot[int(k)][1] for k in keys], np.uint64)[at[is_hot]]
        out[is_hot] = (out[is_hot] + mix(word[is_hot] ^ SALT) % split) % np.uint64(n_buckets)
    return out.astype(np.int64)


class Grams:
    """The n-grams of a piece (contexts, suffixes where these are carried, words), by bucket and in each by context and word; ``where``: that of each token."""

    def __init__(self, sizes: np.ndarray, own: np.ndarray, w: np.ndarray, level: Level):
        ids, order = level.ids, level.order
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        w = w.astype(np.int64) + 1  # among the own words 0 is the start
        own = np.concatenate([np.zeros(1, np.uint64), own])
        tok, before, key, span = own[w], [], np.zeros(len(w), np.int64), 1
        back = w
        for _ in range(1, order):
            back = np.concatenate([np.zeros(1, np.int64), back[:-1]])
            back[first] = 0
            before.append(back)
        ctx = suffix = np.zeros(len(w), np.uint64)
        for m, b in enumerate(reversed(before), 1):
            if span * len(own) >= 1 << 63:
                u, _, key = distinct(key)
                span = len(u)
            key, span = key * len(own) + b, span * len(own)
            ctx = own[b] if m == 1 else ids.extend(ctx, own[b], m)
            if m > 1 and ids.carried(order):
                suffix = own[b] if m == 2 else ids.extend(suffix, own[b], m - 1)
        if span * len(own) >= 1 << 63:
            key = distinct(key)[2]
        _, i, where = distinct(key * len(own) + w)
        del key, before, back
        self.ctx, self.word, self.suffix = ctx[i], tok[i], suffix[i] if ids.carried(order) else suffix[:0]
        bucket = level.bucket(self.ctx, self.word)
        by, self.first = _by_bucket(bucket, level.n_buckets)
        if not ids.exact(order - 1):
            by = np.lexsort((self.word, self.ctx, bucket))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.ctx, self.word, self.where = self.ctx[by], self.word[by], rank[where]
        self.suffix = self.suffix[by] if len(self.suffix) else self.suffix


def _gram_blobs(level: Level, share: int, shares: int):
    """For each piece and bucket of a share its n-grams and how often training rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data in zip(b.column(0).to_pylist(), b.column(1)):
                _, held, sizes, _, _, own, w = unpack(data.as_py())
                g = Grams(sizes, ids_of(own), w, level)
                count = np.bincount(g.where, np.repeat(~held, sizes), len(g.word)).astype(np.int64)
                out = []
                for k in range(share, level.n_buckets, shares):
                    lo, hi = g.first[k], g.first[k + 1]
                    if hi > lo:
                        c, per = runs(g.ctx[lo:hi])
                        at = lo + np.cumsum(per) - per
                        out.append((k, piece, pack(gaps(c), small(per), planes(g.word[lo:hi]), planes(g.suffix[at]) if len(g.suffix) else None, small(count[lo:hi]))))
                yield _blob_rows(out)
                del g, count
                give_back()

    return run


def _lower(level: Level, below: Level, suffix: np.ndarray, ctx_of: np.ndarray, word: np.ndarray):
    """The n-grams without their first words: (contexts or None, words, which of these each n-gram has, buckets), ascending."""
    if level.order == 2:
        w, _, at = distinct(word)
        return None, w, at, below.bucket(None, w)
    v = level.ids.size
    s, _, of = distinct(suffix)
    key, _, at = distinct(of[ctx_of] * v + word.astype(np.int64))
    ctx, w = s[key // v], (key % v).astype(np.uint64)
    return ctx, w, at, below.bucket(ctx, w)


def _count_grams(level: Level, below: Level, top: bool):
    """One bucket of n-grams: its counts, where it has those of each piece (of the highest order), and the lower n-grams whose probabilities are needed."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v, carried = level.ids.size, level.ids.carried(level.order)
        blobs = [unpack(x) for x in group["data"]]
        each = [ids_of(b[0]) for b in blobs]
        contexts = np.unique(np.concatenate(each))
        suffix = np.zeros(len(contexts), np.uint64) if carried else level.ids.suffixes(contexts, level.order) if level.order > 2 else np.zeros(0, np.uint64)
        keys = []
        for c, (_, per, w, s, _) in zip(each, blobs):
            c = np.searchsorted(contexts, c)
            keys.append(np.repeat(c, per) * v + whole(w).astype(np.int64))
            if carried:
                suffix[c] = whole(s)
        sizes = np.concatenate([b[4] for b in blobs])
        del blobs, each
        gram, _, at = distinct(np.concatenate(keys))
        count = np.bincount(at, sizes, len(gram)).astype(np.int64)
        ctx_of, word = gram // v, (gram % v).astype(np.uint64)
        total = np.bincount(ctx_of, count, len(contexts)).astype(np.int64)
        for h, (c, _) in level.hot.items():
            i = np.searchsorted(contexts, np.uint64(h))
            if i < len(contexts) and contexts[i] == np.uint64(h):
                total[i] = c
        bucket = int(group["bucket"].iloc[0])
        rows = [(bucket, "grams", -1, pack(gaps(contexts), small(total), small(np.bincount(ctx_of, minlength=len(contexts))), planes(word), planes(suffix) if carried else None, small(count)), counts_of_counts(count))]
        start = 0
        for piece, key in zip(group["piece"], keys):
            if top:
                rows.append((bucket, "map", piece, pack(small(np.diff(at[start : start + len(key)], prepend=0))), []))
            start += len(key)
        del keys, gram, at, count
        ctx, w, _, to = _lower(level, below, suffix, ctx_of, word)
        order, first = _by_bucket(to, below.n_buckets)
        for k in range(below.n_buckets):
            mine = order[first[k] : first[k + 1]]
            if len(mine):
                if ctx is None:
                    data = pack(gaps(w[mine]))
                else:
                    c, per = runs(ctx[mine])
                    data = pack(gaps(c), small(per), planes(w[mine]))
                rows.append((k, "wanted", bucket, data, []))
        del ctx_of, word
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "kind", "piece", "data", "seen"])

    return run


ANSWERS = "bucket int, kind string, piece long, data binary"


def _answer_words(totals: Words, ids: Ids):
    """Probabilities of the words that buckets of pairs want, from a bucket of words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        count = unpack(group.loc[group["kind"] == "words", "data"].iloc[0])[0].astype(np.int64)
        rows = []
        for to, data in group.loc[group["kind"] == "wanted", ["piece", "data"]].itertuples(index=False):
            place = (ids_of(unpack(data)[0]) - np.uint64(1)) // np.uint64(ids.n_words)
            rows.append((int(to), "answer", int(group["bucket"].iloc[0]), pack(*coded(totals.p(count[place.astype(np.int64)])))))
        return pd.DataFrame(rows, columns=["bucket", "kind", "piece", "data"])

    return run


def _answer_grams(hot_alpha: dict[int, float], ids: Ids):
    """The same of n-grams, from a bucket of n-grams of their order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        contexts, per, word, *p = unpack(group.loc[group["kind"] == "p", "data"].iloc[0])
        contexts, p = ids_of(contexts), decoded(*p)
        ctx_of = np.repeat(np.arange(len(contexts)), per)
        key = ctx_of * ids.size + whole(word).astype(np.int64)
        p = _with_hot(p, contexts[ctx_of[p < 0]], hot_alpha)
        rows = []
        for to, data in group.loc[group["kind"] == "wanted", ["piece", "data"]].itertuples(index=False):
            c, n, w = unpack(data)
            want = np.repeat(np.searchsorted(contexts, ids_of(c)), n) * ids.size + whole(w).astype(np.int64)
            at = np.searchsorted(key, want)
            if len(want) and not (at[-1] < len(key) and (key[at] == want).all()):
                raise ValueError("an n-gram stands in a text and its end does not")
            rows.append((int(to), "answer", int(group["bucket"].iloc[0]), pack(*coded(p[at]))))
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "kind", "piece", "data"])

    return run


def _with_hot(p: np.ndarray, ctx: np.ndarray, hot_alpha: dict[int, float]) -> np.ndarray:
    """Probabilities; negative ones, which are of unseen n-grams after contexts spread over buckets (``ctx``), still lack the backoff weight."""
    if len(ctx):
        which, at = np.unique(ctx, return_inverse=True)
        p = p.copy()
        p[p < 0] *= -np.array([hot_alpha[int(c.astype(np.int64))] for c in which])[at]
    return p


def _back_off(level: Level, below: Level, d: np.ndarray, top: bool):
    """Backoff weights of one bucket of contexts, and the probabilities of its n-grams: as a table, or of the highest order for each piece. A hot context's sums go on as rows of their own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        by = {k: g for k, g in group.groupby("kind")}
        bucket = int(group["bucket"].iloc[0])
        contexts, total, per, word, suffix, count = unpack(by["grams"]["data"].iloc[0])
        total, count, packed = total.astype(np.int64), count.astype(np.int64), (contexts, per, word)
        contexts, word = ids_of(contexts), whole(word)
        suffix = whole(suffix) if suffix is not None else level.ids.suffixes(contexts, level.order) if level.order > 2 else contexts[:0]
        ctx_of = np.repeat(np.arange(len(contexts)), per)
        _, w, at, to = _lower(level, below, suffix, ctx_of, word)
        low = np.full(len(w), np.nan)
        for k, data in by["answer"][["piece", "data"]].itertuples(index=False):
            low[to == k] = decoded(*unpack(data))
        low = low[at]
        del at, to, w
        seen = count > 0
        p = np.where(seen, discounted(count, d) / (total[ctx_of] + 1), low)
        used = np.bincount(ctx_of[seen], p[seen], len(contexts))
        lower = np.bincount(ctx_of[seen], low[seen], len(contexts))
        is_hot = np.isin(contexts, np.array(sorted(level.hot), np.uint64))
        alpha = np.where(is_hot, -1.0, (1 - used) / (1 - lower))
        p[~seen] *= alpha[ctx_of[~seen]]
        rows = [(bucket, "hot", -1, int(contexts[i].astype(np.int64)), b"", float(used[i]), float(lower[i])) for i in np.flatnonzero(is_hot)]
        if not top:
            rows.append((bucket, "p", -1, 0, pack(*packed, *coded(p)), 0.0, 0.0))
        for piece, data in by["map"][["piece", "data"]].itertuples(index=False) if top else ():
            own = np.cumsum(unpack(data)[0], dtype=np.int64)
            rows.append((bucket, "reply", piece, 0, pack(contexts[ctx_of[own[p[own] < 0]]], *coded(p[own])), 0.0, 0.0))
        del low, p, seen, ctx_of, count
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "kind", "piece", "ctx", "data", "left", "rest"])

    return run


def _score(level: Level, hot_alpha: dict[int, float]):
    """Scores of the texts of a piece from the probabilities of its n-grams."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(group["bucket"], group["data"]))
        ids, held, sizes, base, known, own, w = unpack(by.pop(-1))
        g = Grams(sizes, ids_of(own), w, level)
        p = np.empty(len(g.word))
        for k in np.flatnonzero(np.diff(g.first)):
            ctx, *got = unpack(by[int(k)])
            p[g.first[k] : g.first[k + 1]] = _with_hot(decoded(*got), ctx, hot_alpha)
        score = np.bincount(np.repeat(np.arange(len(held)), sizes), np.log10(p)[g.where], len(held))
        del g, p, w
        give_back()
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": sizes.astype(np.int64), "n_known": known, "base_score": base, "score": score})

    return run


class Katz:
    """A trained model of word n-grams up to ``order``, and the scores of the texts it was counted with.

    All passes read the table cut into numbered pieces, which is written first as hashes of words, then, when the words are counted, as dense ids by frequency. For each order, pieces send their
    distinct n-grams with training counts to hash buckets; nothing in these buckets grows with the number of documents. A bucket asks the buckets of the order below for the
    probabilities that its backoff weights need. Those of the highest order send the probabilities of its n-grams back to each piece, where its texts are scored.

    p(w | h) = d * c(h, w) / (c(h) + 1) for an n-gram seen, else alpha(h) * p(w | h without its first word); p(w) = d * c(w) / (N + 1) for a word seen, else the unknown word's mass. The
    one count added to N and c(h) always leaves some mass to unseen words. alpha(h) = (1 - mass of the n-grams seen) / (1 - lower p of their words), so that p(. | h) sums to 1.
    """

    def __init__(self, docs: DataFrame, order: int = 2):
        if order < 2:
            raise ValueError("the order is at least 2")
        self.spark, self.scratch, self.order = docs.sparkSession, Scratch(docs.sparkSession, "katz"), order
        texts = _texts(docs)
        self.size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        with rows_per_batch(self.spark, BATCH_ROWS):
            self.pieces = self.scratch.save(texts.mapInArrow(_cut_pieces, "piece long, n_train long, data binary"))
        self.n_train = self.pieces.agg(F.sum("n_train")).first()[0] or 0
        with rows_per_batch(self.spark, BATCH_PIECES):
            self._count_words()
            for n in range(2, order + 1):
                self._count(n)

    def _dealt(self, blobs, n_buckets: int, count, schema: str) -> DataFrame:
        rows = self.pieces.select("piece", "data").mapInArrow(blobs, "bucket int, piece long, data binary")
        return self.scratch.save(rows.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(count, schema))

    def _count_words(self) -> None:
        n_words = max(1, ceil(max(1, ceil(self.size / BUCKET_BYTES)) / WIDER))
        rows = self._dealt(_word_blobs(n_words), n_words, _count_words, "bucket int, kind string, piece long, data binary, n long, distinct long, size long, end long, seen array<array<long>>")
        self.below = rows.where("kind = 'words'")
        end = F.max(F.when(F.col("end") >= 0, 1 + F.col("end") * n_words + F.col("bucket")))
        n, known, size, end = self.below.agg(F.sum("n"), F.sum("distinct"), F.max("size"), end).first()
        self.totals = Words(n or 0, known or 0, *_sum_counts(self.below))
        self.ids = Ids(n_words, 1 + (size or 0) * n_words, -1 if end is None else end, ID_BITS)
        self.levels, self.discounts = {1: Level(1, n_words, {}, self.ids)}, {}
        both = self.pieces.select(F.lit(-1).alias("bucket"), "piece", "data").union(rows.where("kind = 'reply'").select("bucket", "piece", "data"))
        per_token = log10(self.totals.n + 0.1 * (self.totals.distinct + 1))
        recoded = self.scratch.save(both.groupBy("piece").applyInPandas(_recode(n_words, per_token), "piece long, data binary"))
        self.scratch.drop(self.pieces)
        self.pieces = recoded
        self.answer, self.counted, self.weighed = _answer_words(self.totals, self.ids), self.below, [rows]

    def _hot(self, order: int, n_buckets: int) -> dict[int, tuple[int, int]]:
        """Contexts with a large share of all tokens, at most four for each bucket by the threshold; those of starts always."""
        if n_buckets == 1:
            return {}
        ids, least = self.ids, max(1.0, self.totals.n / (4 * n_buckets))
        split = lambda c: min(n_buckets, ceil(4 * n_buckets * c / max(1, self.totals.n)))

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                    if order == 2:
                        (c,) = unpack(x.as_py())
                        key = word = np.arange(len(c), dtype=np.uint64) * np.uint64(ids.n_words) + np.uint64(1 + k)
                    else:
                        contexts, _, per, word, _, c = unpack(x.as_py())
                        word = whole(word)
                        key = ids.extend(np.repeat(ids_of(contexts), per), word, order - 1)
                    i = np.flatnonzero((c >= least) & (word.astype(np.int64) != ids.end))  # nothing follows an end
                    yield pa.RecordBatch.from_arrays([pa.array(key[i].astype(np.int64)), pa.array(c[i].astype(np.int64))], names=["ctx", "c"])

        got = self.counted.select("bucket", "data").mapInArrow(frequent, "ctx long, c long").collect()
        hot = {int(np.int64(r["ctx"]).astype(np.uint64)): (r["c"], split(r["c"])) for r in got}
        return hot | {int(ids.start(order - 1)[0]): (self.n_train, split(self.n_train))}

    def _count(self, n: int) -> None:
        top, below = n == self.order, self.levels[n - 1]
        n_buckets = max(1, ceil(self.size / (BUCKET_BYTES // (1 if n == 2 else 2))))
        level = self.levels[n] = Level(n, n_buckets, self._hot(n, n_buckets), self.ids)
        if n > 2:
            self.scratch.drop(*self.tables)
        shares = 1 if n == 2 else min(SHARES, n_buckets)
        width = ceil(n_buckets / shares)
        schema = "bucket int, kind string, piece long, data binary, seen array<array<long>>"
        self.tables = [self._dealt(_gram_blobs(level, i, shares), width, _count_grams(level, below, top), schema) for i in range(shares)]
        self.counted = reduce(DataFrame.union, self.tables).where("kind = 'grams'")
        d = self.discounts[n] = discounts(*_sum_counts(self.counted))
        weighed, schema = [], "bucket int, kind string, piece long, ctx long, data binary, left double, rest double"
        for rows in self.tables:
            wanted = rows.where("kind = 'wanted'").select("bucket", "kind", "piece", "data").union(self.below.select("bucket", "kind", "piece", "data"))
            answers = wanted.repartition(below.n_buckets, "bucket").groupBy("bucket").applyInPandas(self.answer, ANSWERS)
            both = rows.where("kind in ('grams', 'map')").select("bucket", "kind", "piece", "data").union(answers)
            weighed.append(self.scratch.save(both.repartition(width, "bucket").groupBy("bucket").applyInPandas(_back_off(level, below, d, top), schema)))
            del wanted, answers, both
            if top:
                self.scratch.drop(rows)
        every = reduce(DataFrame.union, weighed)
        hot = every.where("kind = 'hot'").groupBy("ctx").agg(((1 - F.sum("left")) / (1 - F.sum("rest"))).alias("alpha"))
        self.hot_alpha = {r["ctx"]: r["alpha"] for r in hot.collect()}  # at most four contexts for each bucket
        self.scratch.drop(*self.weighed)
        self.weighed, self.below, self.answer = weighed, every.where("kind = 'p'"), _answer_grams(self.hot_alpha, self.ids)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
        rows = self.pieces.select(F.lit(-1).alias("bucket"), "piece", "data").union(reduce(DataFrame.union, self.weighed).where("kind = 'reply'").select("bucket", "piece", "data"))
        got = rows.groupBy("piece").applyInPandas(_score(self.levels[self.order], self.hot_alpha), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.totals.n).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of every row of (doc_id, text) under the model of n-grams up to ``order`` words, counted over the rows whose crc32(doc_id) mod 10 is not 0.

    Words are lower-cased (A-Z), each text ends with one end token. Null and empty texts have that token alone. A null doc_id counts as a training row; repeated rows
    count as often as they stand and get equal scores; an empty table gives no rows; with no training row every token is unknown. Other columns are ignored.
    """
    return Katz(docs, order).scores()
