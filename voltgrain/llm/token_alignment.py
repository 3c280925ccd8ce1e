"""Alignment of the tokens of a byte-level and a merge-type vocabulary, and corpus-wide counts of the pairs it links."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from voltgrain.llm.store import Scratch, give_back
from voltgrain.llm.wordhash import pieces

#: A single space between two signs that are no white space: no token of either vocabulary reaches across the place before it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries of one generation of the cache of aligned segments, and the longest segment kept there.
CACHE, CACHED_CHARS = 100_000, 40
#: Signs of new segments that are encoded as one text.
RUN_CHARS = 1 << 16
PIECE_BYTES = 2 << 20
#: Linked id pairs are packed as A << SHIFT | B.
SHIFT = 20
#: Tallied pairs held before equal ones are added up, and pairs of one row of a written tally.
TALLY, TALLY_ROW = 1 << 20, 1 << 16


def byte_of_sign() -> dict[str, int]:
    """Byte-level alphabet: bytes that print stand for themselves, the others for the signs from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both encoders and the bytes of their tokens.

    A text is aligned in segments between single spaces, where both encoders start anew; segments are remembered in a cache of two generations.
    """

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        sign = byte_of_sign()
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: x.encode() if i in special else bytes(sign[c] for c in x) for x, i in self.a.get_vocab().items()}
        self.b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
        if any("▁" in b.id_to_piece(i).lstrip("▁") for i in self.b_bytes):
            raise ValueError("pieces with a space sign after another sign are not supported")
        self.a_sizes, self.b_sizes = (np.array([len(x[i]) for i in range(len(x))]) for x in (self.a_bytes, self.b_bytes))
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        #: Segments too long for the cache, of the texts at work.
        self.long: dict[str, tuple | None] = {}

    def align(self, rests: list[str]) -> list[tuple | None]:
        """For each segment (a space and one of ``rests``): (tokens of A, tokens of B, groups as text, linked pairs packed as A << SHIFT | B, as bytes); None where bytes differ.

        The segments are encoded as one text, in which each starts anew. The cumulative ends of both id lists become keys of two dictionaries from an end
        to an index; the sorted keys that both have are where the lists are sliced into groups.
        """
        text = " " + " ".join(rests)
        want = text.encode()
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:])
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return [None] if len(rests) == 1 else [x for r in rests for x in self.align([r])]
        a_at = dict(zip(self.a_sizes[a].cumsum().tolist(), range(1, len(a) + 1)))
        b_at = dict(zip(self.b_sizes[b].cumsum().tolist(), range(1, len(b) + 1)))
        common = sorted(a_at.keys() & b_at.keys())
        a_cuts, b_cuts = [0, *map(a_at.__getitem__, common)], [0, *map(b_at.__getitem__, common)]
        a_text, b_text = list(map(str, a)), list(map(str, b))
        groups = [
            f"{a_text[i]}|{b_text[k]}" if j - i == 1 == m - k else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}"
            for i, j, k, m in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:])
        ]
        # every token holds a byte, so of each slice only the last tokens end with it
        links = (np.array(a)[np.array(a_cuts[1:]) - 1] << SHIFT | np.array(b)[np.array(b_cuts[1:]) - 1]).tobytes()
        order = dict(zip(common, range(1, len(common) + 1)))
        out, g = [], 0
        sizes = [len(r) + 1 for r in rests] if len(want) == len(text) else [len(r.encode()) + 1 for r in rests]
        for e in accumulate(sizes):
            h = order[e]
            out.append((a_cuts[h] - a_cuts[g], b_cuts[h] - b_cuts[g], ";".join(groups[g:h]), links[8 * g : 8 * h]))
            g = h
        return out

    def learn(self, wanted: set[str]) -> None:
        """Bring all segments of the texts at work into the cache."""
        if len(self.young) >= CACHE:
            self.young, self.old = {}, self.young
        self.long = {}
        run: list[str] = []
        held = 0
        for r in wanted.difference(self.young):
            if r in self.old:
                self.young[r] = self.old[r]
            elif not r or r[0].isspace() or r[-1].isspace():
                self.keep([r])
            else:
                run.append(r)
                held += len(r)
                if held > RUN_CHARS:
                    self.keep(run)
                    run, held = [], 0
        if run:
            self.keep(run)

    def keep(self, rests: list[str]) -> None:
        for r, got in zip(rests, self.align(rests)):
            (self.young if len(r) <= CACHED_CHARS else self.long)[r] = got

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray] | None]:
        """(tokens of A, tokens of B, groups as text, linked pairs packed) of each text; None where it has no tokens."""
        cut = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        young, long = self.young, self.long
        for rests in cut:
            got = [young[r] if r in young else long[r] for r in rests]
            if not rests or None in got:
                yield None
                continue
            n_a, n_b, groups, links = zip(*got)
            yield sum(n_a), sum(n_b), ";".join(groups), np.frombuffer(b"".join(links), np.int64)

    @staticmethod
    def split(text: str) -> list[str]:
        """What follows the space in front of each segment of a space and ``text``."""
        head, *rests = CUT.split(" " + text)
        return [head[1:], *rests] if text else []


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    if (k := (a_file, b_file)) not in _aligners:
        _aligners[k] = Aligner(a_file, b_file)
    return _aligners[k]


class Tally:
    """Counts of packed pairs; its size follows the number of different pairs."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((pairs, times))
        self.held += len(pairs)
        if self.held > TALLY:
            total = self.total()
            self.parts, self.held = [total], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, at = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([t for _, t in self.parts]), len(pairs)).astype(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _aligned(docs: DataFrame, a_file: str, b_file: str, groups: bool) -> DataFrame:
    """One row for each document with its different linked pairs, and rows of each task's tally of them (``tally`` true)."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind), *T._parse_datatype_string("n_a long, n_b long, n_groups long, groups_sha256 string, groups string, pairs array<long>, times array<long>, tally boolean").fields,
        ]
    )
    doc_kind = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}.get(kind)
    many = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, tally, id_kind = aligner(a_file, b_file), Tally(), doc_kind
        none = np.zeros(0, np.int64)
        for part in pieces(batches, 1, PIECE_BYTES):
            id_kind = part.schema.field(0).type
            rows, pairs, times = [], [], []
            for got in c.documents([t or "" for t in part.column(1).to_pylist()]):
                n_a, n_b, joined, links = got or (0, 0, "", none)
                p, t = np.unique(links, return_counts=True)
                tally.add(p, t)
                pairs.append(p)
                times.append(t)
                rows.append((n_a, n_b, len(links), hashlib.sha256(joined.encode()).hexdigest() if joined else "", joined if groups else None, False))
            n_a, n_b, n, digest, joined, flag = zip(*rows)
            cols = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, lists(pairs, pa.int64()), lists(times, pa.int64()), pa.array(flag, pa.bool_())], names=schema.names)
        pairs, times = tally.total()
        for lo in range(0, len(pairs), TALLY_ROW):
            p, t = pairs[lo : lo + TALLY_ROW], times[lo : lo + TALLY_ROW]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_kind), *[pa.nulls(1, pa.int64())] * 3, *[pa.nulls(1, pa.string())] * 2, lists([p], pa.int64()).cast(many), lists([t], pa.int64()).cast(many), pa.array([True])], names=schema.names
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def align_documents(docs: DataFrame, a_file: str, b_file: str, groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of every row; the table a_id, b_id, n, best of linked pairs).

    Every text is encoded once, without special tokens; ends of tokens of A and B at the same byte cut both id lists into groups and link
    the tokens that end there. A null or empty text, or one whose token bytes are not its own bytes after a space, has zeros and empty groups.
    Repeated rows count each time; a null doc_id stays null; an empty table gives no rows; other columns are ignored.

    Counts are added up per task, then by Spark. Of two linked tokens one ends with the bytes of the other, so the number of different pairs
    is bounded by the suffixes that both vocabularies share (``pair_bound``, 324,302 for the two 50k and 32k files) whatever the corpus; only that table
    is sent to the workers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = scratch.save(_aligned(docs, a_file, b_file, groups), by="tally")
    zipped = rows.where("tally").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = zipped.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    ids = counts.select("pair", F.shiftright("pair", SHIFT).alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b_id"), "n")
    counts = scratch.save(ids.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id"))))
    table = counts.select("pair", "n", "best").toArrow().combine_chunks().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            held, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, held.flatten().to_numpy())
            row = np.repeat(np.arange(b.num_rows), np.diff(held.offsets.to_numpy()))
            # whole numbers: sums in floating point would round above 2^53
            sums = []
            for x in (times, times * best[at], times * n[at]):
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, row, x)
                sums.append(pa.array(total))
            keep = [b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*keep, *sums, b.column("groups_sha256"), b.column("groups")], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    kinds = {c: T.LongType() for c in names} | {"doc_id": docs.schema["doc_id"].dataType, "groups_sha256": T.StringType(), "groups": T.StringType()}
    out = rows.where("not tally").mapInArrow(weigh, T.StructType([T.StructField(c, kinds[c]) for c in names]))
    return out, counts.drop("pair")


def pair_bound(a_file: str, b_file: str) -> int:
    """Number of pairs of ids of both vocabularies of which one's bytes end with the other's; several ids may have the same bytes."""
    c = Aligner(a_file, b_file)
    a, b = Counter(c.a_bytes.values()), Counter(c.b_bytes.values())
    return sum(n * b[t[i:]] for t, n in a.items() for i in range(len(t))) + sum(n * a[t[i:]] for t, n in b.items() for i in range(1, len(t)))
