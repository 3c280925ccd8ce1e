"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Entries of one generation of the cache of encoded words, and the longest word kept there.
CACHE, CACHED_CHARS = 200_000, 48
#: Signs up to which a part's agenda is a plain list, and the cost of a pair that is no piece.
SHORT, NEVER = 32, float("inf")
#: Of so many texts of an Arrow batch, one is also encoded and decoded by the library.
CHECK_EVERY = 64


class PieceCodec:
    """Encoder and decoder of one merge-type model with byte fallback.

    Encoding keeps an agenda of adjacent symbol pairs whose join is a piece, ordered by score, then
    by position, and joins the best pair until the agenda is empty. No piece has a space sign
    after another sign, so a text is cut before each run of space signs and the parts are encoded on
    their own; parts are remembered in a cache of two generations.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        special = [p.is_byte(i) or p.is_control(i) or p.is_unknown(i) for i in range(n)]
        self.pieces = {p.id_to_piece(i): (i, p.get_score(i)) for i in range(n) if not special[i] and not p.is_unused(i)}
        self.cost = {x: -score for x, (_, score) in self.pieces.items()}.get
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.surface = {i: p.id_to_piece(i) for i in range(n) if not special[i]}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if len(self.bytes) != 256 or any(SPACE in x.lstrip(SPACE) for x in self.pieces) or p.encode("  a ") != self.encode("  a "):
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and kept spaces are supported")
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def merge(self, part: str) -> list[int]:
        """Ids of one part (a run of space signs and what follows up to the next run)."""
        symbols = self._join_short(part) if len(part) <= SHORT else self._join_long(part)
        ids: list[int] = []
        for s in symbols:
            if s in self.pieces:
                ids.append(self.pieces[s][0])
            else:
                ids += [self.bytes[b] for b in s.encode()]
        return ids

    def _join_short(self, part: str) -> list[str]:
        """The agenda of a word as a plain list, one cost for each adjacent pair; the first of the least costs is next."""
        cost, symbols = self.cost, list(part)
        agenda = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (least := min(agenda)) < NEVER:
            i = agenda.index(least)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _join_long(self, part: str) -> list[str]:
        """The agenda of a long part as a heap, n log n for n signs; pairs that have changed since are passed over."""
        cost, symbols = self.cost, list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (c := cost(a + b, NEVER)) < NEVER]
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (c := cost(pair := symbols[left] + symbols[right], NEVER)) < NEVER:
                    heapq.heappush(agenda, (c, left, pair))
        return [s for s in symbols if s]

    def encode(self, text: str) -> list[int]:
        return [i for part in CHUNK.findall(SPACE + text.replace(" ", SPACE)) for i in self.merge(part)] if text else []

    def surfaces(self, ids: list[int]) -> str:
        """Pieces joined, space signs kept, runs of byte pieces read as UTF-8."""
        try:
            return "".join([self.surface[i] for i in ids])
        except KeyError:
            out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(run.decode(errors="replace"))
            run.clear()
            out.append(self.surface.get(i, ""))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their surfaces without the dummy prefix, space signs as spaces."""
        return self.surfaces(ids).removeprefix(SPACE).replace(SPACE, " ")

    def part(self, rest: str) -> tuple[str, str]:
        """Ids joined by commas and the surface decoded from them, of a space sign and ``rest``; put into the cache."""
        if (got := self.old.get(rest)) is None:
            ids = self.merge(SPACE + rest)
            got = (",".join(map(str, ids)), self.surfaces(ids))
        if len(rest) <= CACHED_CHARS:
            if len(self.young) >= CACHE:
                self.young, self.old = {}, self.young
            self.young[rest] = got
        return got

    def both(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the text decoded from them."""
        if not text:
            return "", 0, ""
        if text[0] == " " or "  " in text or SPACE in text:
            rests = [p[1:] for p in CHUNK.findall(SPACE + text.replace(" ", SPACE))]
        else:
            rests = text.split(" ")
        got = list(map(self.young.get, rests))
        if None in got:
            got = [g or self.part(r) for g, r in zip(got, rests)]
        ids, surfaces = zip(*got)
        joined = ",".join(ids)
        return joined, joined.count(",") + 1, "".join(surfaces)[1:].replace(SPACE, " ")


_codecs: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def encode_documents(docs: DataFrame, model: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text.

    One pass without a shuffle; each row stands alone. Of every ``CHECK_EVERY`` texts of a batch one is also
    encoded and decoded by the library, and a difference stops the job. A null or empty text has no
    ids and decodes to the empty text; repeated rows give repeated results; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[list] = [[] for _ in names[1:]]
                for k, text in enumerate(part.column(1).to_pylist()):
                    joined, n, decoded = c.both(text or "")
                    if (lo + k) % CHECK_EVERY == 0:
                        want = c.library.encode(text or "")
                        if ",".join(map(str, want)) != joined or c.library.decode(want) != decoded:
                            raise AssertionError(f"the library encodes or decodes doc_id {part.column(0)[k]} differently")
                    row = [n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    if ids:
                        row += [[int(x) for x in joined.split(",")] if joined else [], decoded]
                    for col, x in zip(out, row):
                        col.append(x)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
