"""Personal data by fixed forms, and the terms that give it away, found from the co-occurrences of the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voltgrain.llm.store import Scratch, give_back
from voltgrain.llm.wordhash import pieces

#: Kinds of spans in the order in which they are listed; the last is what the method adds.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits and points, in which addresses are looked for; an address starts at the start of a run of digits.
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
#: Terms at most so many places before or after an entity count as seen with it; shorter words are no terms.
NEAR, MIN_LETTERS = 6, 3
#: A term is judged if it stands by an entity in so many different surroundings.
MIN_SUPPORT = 3
#: Bits about the entity that the term leaves open: at most so many, and it is generalised; at most the second, and it is removed.
GENERALISE_BITS, REMOVE_BITS = 1.0, 0.25
#: The term must give at least this share of the information of the entity.
MIN_SHARE = 0.5
#: Terms held as one set by every Python worker; with more, terms are joined instead.
BROADCAST_TERMS = 200_000
PIECE_BYTES = 4 << 20


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @: the signs allowed before it, back to the last match, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def _digits(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans of the fixed forms in code points, by kind, then start; linear in the text."""
    out = [(0, a, b) for a, b in _emails(text)]
    for run in DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            for m in IP.finditer(text, run.start(), run.end()):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                    out.append((1, m.start(), m.end()))
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def key(*parts: str) -> int:
    """A signed 64-bit id."""
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def entity(kind: int, found: str) -> int:
    """The id of a protected entity: its kind and its value without case, signs and spaces that do not matter."""
    return key(KINDS[kind], found.lower() if kind == 0 else found if kind == 1 else _digits(found))


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, lower case) of all terms outside ``spans``, in order."""
    out, taken, i = [], sorted((a, b) for _, a, b in spans), 0
    # spans of different kinds may overlap: from here on only their union matters
    union: list[list[int]] = []
    for a, b in taken:
        if union and a <= union[-1][1]:
            union[-1][1] = max(union[-1][1], b)
        else:
            union.append([a, b])
    for m in WORD.finditer(text):
        a, b = m.span()
        while i < len(union) and union[i][1] <= a:
            i += 1
        if b - a >= MIN_LETTERS and not (i < len(union) and union[i][0] < b):
            out.append((a, b, m[0].lower()))
    return out


def surroundings(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str]]]:
    """(entity, id of its surroundings, different terms near it) for each entity of one text; an entity met several times has one entry."""
    terms = terms_of(text, spans)
    starts = [t[0] for t in terms]
    near: dict[int, list[list[str]]] = {}
    for kind, a, b in spans:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        near.setdefault(entity(kind, text[a:b]), []).append([t[2] for t in terms[max(0, i - NEAR) : i] + terms[j : j + NEAR]])
    return [(e, key(*map(" ".join, windows)), sorted({t for w in windows for t in w})) for e, windows in near.items()]


def distinct_terms(text: str, wanted: frozenset[str] | None) -> set[str]:
    """The different terms of a text outside its base spans; only those of ``wanted``, if given."""
    if wanted is not None and wanted.isdisjoint(map(str.lower, WORD.findall(text))):
        return set()
    found = {t for _, _, t in terms_of(text, base_spans(text))}
    return found if wanted is None else found & wanted


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and entity."""
    for part in pieces(batches, 0, PIECE_BYTES):
        rows = [s for t in part.column(0).to_pylist() if t and (spans := base_spans(t)) for s in surroundings(t, spans)]
        e, c, t = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(c, pa.int64()), pa.array(t, pa.list_(pa.string()))], names=["entity", "context", "terms"])
    give_back()


def _small(terms: DataFrame, most: int) -> frozenset[str] | None:
    """The terms as a set if they are at most ``most``, else None; never more than one above are fetched."""
    rows = terms.limit(most + 1).collect()
    return frozenset(r[0] for r in rows) if len(rows) <= most else None


def document_counts(docs: DataFrame, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, n): documents that hold each of ``terms``. A small set goes to the workers and is counted there per batch; a large one is joined."""
    wanted = _small(terms, broadcast_terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0, PIECE_BYTES):
            c: Counter[str] = Counter()
            for t in part.column(0).to_pylist():
                c.update(distinct_terms(t or "", wanted))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])
        give_back()

    got = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return got if wanted is not None else got.join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, scratch: Scratch, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, bits_left, share, removed): the terms that give an entity away, written as a table.

    Documents are the events: of those with the term, the share that has the entity near it is the chance p(e | t), and the
    pointwise mutual information of both is log2 p(e | t) / p(e). A term discloses an entity if it stands near it in at least
    ``MIN_SUPPORT`` different surroundings (so copies of a passage count once), leaves at most ``GENERALISE_BITS`` of the entity's
    information open and gives at least ``MIN_SHARE`` of it. The entity that the term discloses most decides.
    """
    seen = scratch.save(docs.select("text").mapInArrow(_evidence, "entity long, context long, terms array<string>"))
    n_docs = docs.count()
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = seen.select("entity", "context", F.explode("terms").alias("term"))
    # per (pair, surroundings) first, so that an entity in many documents spreads
    pairs = pairs.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support"))
    pairs = scratch.save(pairs.where(F.col("support") >= MIN_SUPPORT).join(entities, "entity"))
    counts = document_counts(docs, pairs.select("term").distinct(), broadcast_terms).withColumnRenamed("n", "n_term")
    information = F.log2(F.lit(float(max(n_docs, 1))) / F.col("n_entity"))
    judged = pairs.join(counts, "term").withColumn("bits_left", F.log2(F.col("n_term") / F.col("n_both"))).withColumn("share", (information - F.col("bits_left")) / information)
    out = judged.where((F.col("bits_left") <= GENERALISE_BITS) & (F.col("share") >= MIN_SHARE)).groupBy("term").agg(F.min("bits_left").alias("bits_left"), F.max("share").alias("share"))
    out = scratch.save(out.withColumn("removed", F.col("bits_left") <= REMOVE_BITS))
    scratch.drop(seen, pairs)
    return out


def replaced(text: str, spans: list[tuple[int, int, int]], removed: frozenset[str]) -> str:
    """The text with its spans replaced: base ones by their kind, terms by their class (a number or a word) or by nothing. Of overlapping spans the first stands for all."""
    out, last = [], 0
    for a, k, b in sorted((a, k, b) for k, a, b in spans):
        if a >= last:
            term = text[a:b].lower()
            out.append(text[last:a])
            out.append(f"<{KINDS[k].upper()}>" if k < 4 else "" if term in removed else "<NUMBER>" if term.isdigit() else "<WORD>")
        last = max(last, b)
    return "".join([*out, text[last:]])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string, sanitised string"


def _judge(text: str, doubtful: dict[str, bool] | None, sanitised: bool) -> tuple:
    base = base_spans(text)
    spans = base
    if doubtful and not doubtful.keys().isdisjoint(map(str.lower, WORD.findall(text))):
        spans = base + [(4, a, b) for a, b, t in terms_of(text, base) if t in doubtful]
    n = Counter(k for k, _, _ in spans)
    out = replaced(text, spans, frozenset(t for t, r in (doubtful or {}).items() if r)) if sanitised and spans else text if sanitised else None
    return n[0], n[1], n[2], n[3], n[4], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), out


def sanitise(docs: DataFrame, sanitised: bool = True, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, counts of spans by kind, base_sha256, spans and (unless ``sanitised`` is off, then null) the sanitised text of every row.

    Three passes over whole texts: surroundings of the entities, documents of the terms near them, the spans. Between them only
    (entity, surroundings, terms) rows are shuffled. Entities are kept as ids. Counts cover all rows, copies included; a null text is empty and has no
    span; a null doc_id stays null; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sanitise")
    source = docs.select("doc_id", "text")
    found = disclosures(source, scratch, broadcast_terms)
    rows = found.select("term", "removed").limit(broadcast_terms + 1).collect()
    small = dict(map(tuple, rows)) if len(rows) <= broadcast_terms else None
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(RESULT).fields])
    arrow = [*[pa.int64()] * 5, *[pa.string()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1, PIECE_BYTES):
            if small is None:
                own = [dict(zip(t or [], r or [])) for t, r in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            else:
                own = [small] * part.num_rows
            got = [_judge(t or "", d, sanitised) for t, d in zip(part.column(1).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*got), arrow))], names=schema.names)
        give_back()

    if small is not None:
        scratch.drop(found)
        return source.mapInArrow(run, schema)
    # too many terms for a set: each row gets its own ones by a join of its different terms
    held = scratch.save(source.withColumn("__row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1, PIECE_BYTES):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                terms = list(distinct_terms(t or "", None))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["__row", "term"])

    of_row = held.select("__row", "text").mapInArrow(split, "__row long, term string").join(found, "term").groupBy("__row").agg(F.collect_list("term").alias("terms"), F.collect_list("removed").alias("removals"))
    return held.join(of_row, "__row", "left").select("doc_id", "text", "terms", "removals").mapInArrow(run, schema)
