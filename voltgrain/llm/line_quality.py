"""Line-first quality rules: failing lines go, then documents that lost too much text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from voltgrain.llm.store import give_back, set_aside

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Thresholds of the line rules and of the document verdict.
MAX_SYMBOLS_PER_WORD, MAX_SHOUTS_PER_WORD, MIN_SEPARATORS, MAX_LOST = 0.25, 0.25, 4, 0.5
TERMINAL = tuple(".!?…。！？\"'”’»)]:;")
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "accept all cookies", "we use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here to", "skip to content", "skip to main content", "sign up for our newsletter",
    "subscribe to our newsletter", "share this article", "powered by wordpress", "page not found", "back to top", "log in to your account",
)
SEPARATORS = "|»›·•/>"
SEPARATOR = re.compile(r"\s[|»›·•/>]\s|\s\|$")


def line_fails(line: str, seen: bool) -> str | None:
    """Name of the first rule that a line with a word fails: ``punctuation``, ``navigation`` or ``boilerplate``.

    punctuation: signs of ``SYMBOLS`` other than separators, or doubled exclamation marks, at a quarter of its words or more, or no letter and no digit.
    navigation: four or more separators between items and at least one for ten words, whatever the length, or two to four words without any closing mark.
    boilerplate: a phrase of ``BOILERPLATE`` in a line of at most 30 words, or a line equal to an earlier one.
    """
    words = len(line.split())
    if seen:
        return "boilerplate"
    symbols = sum(line.count(s) for s in SYMBOLS if s != "|")
    if symbols > MAX_SYMBOLS_PER_WORD * words or line.count("!!") > MAX_SHOUTS_PER_WORD * words or not any(map(str.isalnum, line)):
        return "punctuation"
    if sum(map(line.count, SEPARATORS)) >= MIN_SEPARATORS and len(SEPARATOR.findall(line)) >= max(MIN_SEPARATORS, 0.1 * words):
        return "navigation"
    if 2 <= words <= 4 and not line.rstrip().endswith((*TERMINAL, ",")):
        return "navigation"
    if words <= 30:
        low = line.lower()
        if any(p in low for p in BOILERPLATE):
            return "boilerplate"
    return None


def measure(text: str | None) -> tuple:
    """Base figures and the verdict of one text, with the text left over.

    (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, lost_words, cleaned)
    """
    text = text or ""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = failed = lost = 0
    left = []
    for line in text.split("\n"):
        if not (size := len(line.encode().split())):
            left.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if line_fails(line, again):
            failed += 1
            lost += size
        else:
            left.append(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        reach = 0  # first word not yet counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    base_failed = n < 50 or 100 * repeated > 50 * n
    kept = not base_failed and lost <= MAX_LOST * n
    return n, word_chars, symbols, dup, repeated, base_failed, kept, failed, lost, "\n".join(left) if failed else text


FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("n_failed_lines", T.LongType()), ("lost_words", T.LongType())]


def clean_documents(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """doc_id and the figures and verdict of every row; with ``cleaned`` all columns of ``docs`` and cleaned_text.

    One pass, rows stand alone, texts are read whole. A null text has no words (and fails); a null doc_id stays null; repeated rows
    give repeated results; an empty table gives no rows. Columns of ``docs`` that have the name of a result are replaced.
    """
    kinds = FIELDS + ([("cleaned_text", T.StringType())] if cleaned else [])
    new = [T.StructField(k, t) for k, t in kinds]
    old = [f for f in docs.schema if f.name not in dict(kinds) and (cleaned or f.name == "doc_id")]
    arrow = [pa.int64() if t == T.LongType() else pa.bool_() if t == T.BooleanType() else pa.string() for _, t in kinds]
    names = [f.name for f in old]
    source = docs.select(*names, docs["text"].alias("__voltgrain_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = [measure(t.as_py())[: len(kinds)] for t in part.column(len(names))]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*names, *(k for k, _ in kinds)])
        give_back()

    return source.mapInArrow(run, T.StructType([*old, *new]))


def keep_clean(docs: DataFrame) -> DataFrame:
    """Documents the rules keep, with their failing lines removed and n_chars, if there is one, brought up to date. All other columns stay, whatever their names."""
    own, back = set_aside(docs, [*dict(FIELDS), "cleaned_text"])
    kept = clean_documents(own).where("kept")
    kept = kept.selectExpr(*["cleaned_text as text" if c == "text" else "cast(length(cleaned_text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in own.columns])
    return kept.withColumnsRenamed(back)
