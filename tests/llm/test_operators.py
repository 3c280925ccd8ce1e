"""Operators of the training-text subpackage against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, place string, cell string, rep string, host string, size string"


def words_of(text):
    return WORD.findall((text or "").encode())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "house", "river", "ñandú", "Straße", "run", "Stone.", "seven,", "light", "under", "walks", "x1", "▁odd"]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))) + "." for _ in range(60)]
    near = out[0].split()
    out += [out[0], out[0], " ".join([*near[:-1], "changed"]), " ".join(near + ["more"])]
    out += [None, "", "   \n\t ", "one", "two  spaces", " lead", "trail ", "tab\tand\nline\r\n\x0b\x0c", "nbsp kept wide", "a" * 5000, "▁", "emoji 👩‍👩‍👧 end", "\x00nul", "<s> </s> <unk> <0x0A>"]
    out += [" ".join(f"w{i % 977}" for i in range(30_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3 if i % 2 else 0}", len(t) if t else None, "x", "y", "z", "c", "r", "h", "s") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "row without id", "en", "s0", 3, *"xyzcrhs")]
    return spark.createDataFrame(rows, DOCS).repartition(3).sortWithinPartitions("doc_id").transform(lambda d: save(d))


def save(df):
    from voltgrain.llm.store import Scratch

    return Scratch(df.sparkSession, "test").save(df)


@pytest.fixture(scope="module")
def none(spark):
    return save(spark.createDataFrame([], DOCS))


def test_katz(spark, docs, none):
    from voltgrain.llm import katz

    rows = docs.collect()
    k = 5
    held = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
    toks = [[w.lower() for w in words_of(r["text"])] + ["END"] for r in rows]
    uni, big, ctx = Counter(), Counter(), Counter()
    for r, t in zip(rows, toks):
        if not held(r):
            uni.update(t)
            big.update(zip(["START", *t], t))
            ctx.update(["START", *t][: len(t)])

    def gt(counts):
        n = Counter(counts.values())
        try:
            common = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)]
        except ZeroDivisionError:
            d = [-1]
        return d if all(0 < x < 1 for x in d) else [(r - 0.5) / r for r in range(1, k + 1)]

    d1, d2 = gt(uni), gt(big)
    cut = lambda c, d: c * d[c - 1] if c <= k else c
    n, v = sum(uni.values()), len(uni)
    unknown = 1 - sum(cut(c, d1) for c in uni.values()) / (n + 1)
    p1 = lambda w: cut(uni[w], d1) / (n + 1) if uni[w] else unknown
    after = defaultdict(list)
    for a, b in big:
        after[a].append(b)
    alpha = {a: (1 - sum(cut(big[a, b], d2) for b in bs) / (ctx[a] + 1)) / (1 - sum(map(p1, bs))) for a, bs in after.items()}
    p2 = lambda a, b: cut(big[a, b], d2) / (ctx[a] + 1) if big[a, b] else alpha.get(a, 1) * p1(b)
    for a in [*list(after)[:20], "never"]:
        assert abs(sum(p2(a, b) for b in uni) + alpha.get(a, 1) * unknown - 1) < 1e-9
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, held(r), len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(sum(math.log10(p2(a, b)) for a, b in zip(["START", *t], t)), 6)) for r, t in zip(rows, toks))
    sizes = katz.BUCKET_BYTES, katz.PIECE_BYTES
    for bucket, piece in (sizes, (40_000, 3_000)):  # the second spreads frequent contexts over buckets
        katz.BUCKET_BYTES, katz.PIECE_BYTES = bucket, piece
        try:
            got = katz.score_documents(docs).collect()
        finally:
            katz.BUCKET_BYTES, katz.PIECE_BYTES = sizes
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-4)
    assert katz.score_documents(none).count() == 0


def test_katz_of_order_three(spark, docs, none):
    from voltgrain.llm import katz

    rows = docs.collect()
    held = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
    toks = [[w.lower() for w in words_of(r["text"])] + ["END"] for r in rows]
    count = [Counter() for _ in range(4)]  # of n-grams; at 0 none
    ctx = [Counter() for _ in range(4)]
    grams = lambda t, n: list(zip(*[[*["START"] * (n - 1), *t][i : len(t) + i] for i in range(n)]))
    for r, t in zip(rows, toks):
        if not held(r):
            for n in (1, 2, 3):
                count[n].update(grams(t, n))
                ctx[n].update(g[:-1] for g in grams(t, n))
    total = sum(count[1].values())

    def factors(n):
        most = Counter(count[n].values())
        return katz.discounts(np.array([most[r] for r in range(max(most) + 1)]))

    d = [None, factors(1), factors(2), factors(3)]
    cut = lambda c, n: c * d[n][c] if c <= 5 else c
    unknown = 1 - sum(cut(c, 1) for c in count[1].values()) / (total + 1)
    after = [defaultdict(list) for _ in range(4)]
    for n in (2, 3):
        for g in count[n]:
            after[n][g[:-1]].append(g[-1])

    def p(g):
        n = len(g)
        if n == 1:
            return cut(count[1][g], 1) / (total + 1) if count[1][g] else unknown
        if count[n][g]:
            return cut(count[n][g], n) / (ctx[n][g[:-1]] + 1)
        return alpha(g[:-1]) * p(g[1:])

    memo = {}

    def alpha(h):
        if h not in memo:
            n = len(h) + 1
            memo[h] = (1 - sum(p((*h, w)) for w in after[n][h])) / (1 - sum(p((*h[1:], w)) for w in after[n][h])) if h in after[n] else 1
        return memo[h]

    for h in [*list(after[3])[:5], ("never", "the")]:
        assert abs(sum(p((*h, w)) for (w,) in count[1]) + alpha(h) * alpha(h[1:]) * unknown - 1) < 1e-9
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(sum(math.log10(p(g)) for g in grams(t, 3)), 6)) for r, t in zip(rows, toks))

    class Spread(katz.Katz):
        def _hot(self, order, n_buckets):
            return {k: (c, n_buckets) for k, (c, _) in super()._hot(order, n_buckets).items()}

    sizes = katz.BUCKET_BYTES, katz.PIECE_BYTES, katz.ID_BITS
    for katz.BUCKET_BYTES, katz.PIECE_BYTES, katz.ID_BITS in (sizes, (40_000, 3_000, 4), (40_000, 3_000, 63)):  # the last two spread frequent contexts over buckets, the second has hashed contexts
        try:
            model = Spread(docs, 3)
            got = model.scores().select("doc_id", "score").collect()
        finally:
            katz.BUCKET_BYTES, katz.PIECE_BYTES, katz.ID_BITS = sizes
        got = sorted((-1 if k is None else k, x) for k, x in got)
        assert [k for k, _ in got] == [k for k, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-4)
    assert len(model.weighed) == katz.SHARES
    assert all(split > 1 for _, split in [*model.levels[2].hot.values(), *model.levels[3].hot.values()])
    assert katz.score_documents(none, 3).count() == 0


def test_katz_when_splits_change(spark, docs, monkeypatch):
    from voltgrain.llm import katz

    want = sorted(katz.score_documents(docs).collect(), key=str)
    real, key = katz.Scratch.save, "spark.sql.files.minPartitionNum"

    def save_and_change(self, df):
        out = real(self, df)
        spark.conf.set(key, "1")  # as when executors come or go between passes
        return out

    monkeypatch.setattr(katz.Scratch, "save", save_and_change)
    spark.conf.set(key, "8")
    try:
        got = sorted(katz.score_documents(docs).collect(), key=str)
    finally:
        spark.conf.unset(key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-6)


def test_katz_buckets_hold_no_documents(spark, monkeypatch):
    from voltgrain.llm import katz

    def largest(group):
        return max((len(a) for x in group["data"] for a in katz.unpack(x) if hasattr(a, "__len__")), default=0)

    count_words, count_grams = katz._count_words, katz._count_grams

    def watched_words(group):
        assert largest(group) <= 20, "a bucket of words has entries for each document"
        return count_words(group)

    def watched_grams(*args):
        run = count_grams(*args)

        def watched(group):
            assert largest(group) <= 20, "a bucket of n-grams has entries for each document"
            return run(group)

        return watched

    monkeypatch.setattr(katz, "_count_words", watched_words)
    monkeypatch.setattr(katz, "_count_grams", watched_grams)
    df = save(spark.createDataFrame([(i, "the head of every page") for i in range(2_000)], "doc_id long, text string").coalesce(1))
    assert katz.score_documents(df, 3).count() == 2_000


def test_katz_discounts():
    from voltgrain.llm.katz import discounts

    d = discounts(np.array([0, 1000, 400, 200, 120, 80, 55], float))
    assert (d[1:] > 0).all() and (d[1:] < 1).all()
    assert d[1] == pytest.approx((2 * 400 / 1000 - 6 * 55 / 1000) / (1 - 6 * 55 / 1000))
    assert discounts(np.zeros(7))[1] == 0.5


def test_katz_discounts_are_smoothed():
    from voltgrain.llm.katz import discounts

    # raw factors leave (0, 1) at the fourth count, as on usual tables; the line through all counts keeps Good-Turing
    n = np.array([0, 215810, 61309, 26017, 14862, 13741, 7222], float)
    d = discounts(n)[1:]
    assert (d > 0).all() and (d < 1).all() and (np.diff(d) > 0).all()
    assert d != pytest.approx([(r - 0.5) / r for r in range(1, 6)], abs=1e-3)
    exact = discounts(np.array([0, *(1e6 / np.arange(1, 400) ** 2)]))[1:]
    assert exact == pytest.approx([(r / (r + 1) - 1 / 6) / (1 - 1 / 6) for r in range(1, 6)], rel=0.02)
    assert discounts(n / 1e4)[1] == 0.5  # too few


def test_metric_join(spark):
    from voltgrain.llm import metric_join

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(size=8) * (0.02 if i < 150 else 0.15)).tolist()) for i in range(400)]
    rows += [(400 + i, (base[0] * (1 + i)).tolist()) for i in range(30)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, float("nan")] + [0.0] * 6), (504, [float("inf")] * 8), (505, [None] + [1.0] * 7), (506, base[0].tolist()[:7]), (None, base[0].tolist()), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rep string, m int")

    def fine(x):
        return x is not None and len(x) and None not in x and np.isfinite(x).all() and np.any(x)

    ok = [i for i, (k, x) in enumerate(rows) if k is not None and fine(x)]
    links = {i: [j for j in ok if j != i and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.95] for i in ok}
    comp = {k: k for k, _ in rows if k is not None}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            for j in js:
                a, b = rows[i][0], rows[j][0]
                low = min(comp[a], comp[b])
                changed |= comp[a] != low or comp[b] != low
                comp[a] = comp[b] = low
    want = sorted((-1 if k is None else k, len(links.get(i, [])), comp.get(k, -1), k is not None and comp[k] == k) for i, (k, _) in enumerate(rows))
    sizes = metric_join.CELL, metric_join.TILE
    for cell, tile in (sizes, (40, 25)):  # many cells, and tiles of several blocks
        metric_join.CELL, metric_join.TILE = cell, tile
        try:
            got = metric_join.near_duplicates(df).collect()
        finally:
            metric_join.CELL, metric_join.TILE = sizes
        assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in got) == want
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def test_sentencepiece(docs, none):
    import public_tokenizers
    import sentencepiece

    from voltgrain.llm.sentencepiece_codec import PieceCodec, encode_documents

    model = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    got = encode_documents(docs, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        ids = p.encode(by[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == p.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()
    c = PieceCodec(model)
    rng = random.Random(5)
    for _ in range(600):
        t = "".join(rng.choice("aeth  ing▁.\nñ👩0") for _ in range(rng.randrange(0, 90)))
        assert c.encode(t) == p.encode(t) and c.decode(p.encode(t)) == p.decode(p.encode(t))
        j, n, d = c.both(t)
        assert j == ",".join(map(str, p.encode(t))) and n == len(p.encode(t)) and d == p.decode(p.encode(t))
    assert encode_documents(none, model).count() == 0


def test_line_quality(spark, docs, none, texts):
    from voltgrain.llm.line_quality import clean_documents, keep_clean, line_fails, measure

    for t in [*texts, "a b c a b c d\na b c a b c d\n\n x", "same line here\nsame line here\nother", "# * $ | <>&%"]:
        w = words_of(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if words_of(line):
                dup += line in lines
                lines.add(line)
        assert measure(t)[:6] == (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(s) for s in "#*$%&|<>"), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))
    good = "\n".join(f"A plain sentence number {i} that says something about the old {x} in the valley." for i, x in enumerate("mill barn church road bridge tower".split()))
    good = "\n".join(" ".join(f"{w}{i}" for w in line.split()) + "." for i, line in enumerate(good.split("\n")))
    assert measure(good)[6]
    assert not measure("Some plain opening that is clean here.\n" + " ".join(f"WORD{i}!!" for i in range(60)))[6]
    assert not measure(" ".join(f"word{i} |" for i in range(70)))[6]
    assert measure(good + "\nHome | About | News | Shop | Contact\nAll rights reserved.")[9] == good
    assert line_fails("Home", False) is None and line_fails("Sign up here", False) == "navigation" and line_fails("*** ### ***", False) == "punctuation"
    got = clean_documents(docs).collect()
    assert len(got) == docs.count() and {r["host"] for r in got} == {"h"} and {type(r["kept"]) for r in got} == {bool}
    assert [r for r in got if r["doc_id"] is None][0]["n_words"] == 3
    clean = keep_clean(docs)
    assert clean.columns == docs.columns and {r["kept"] for r in clean.collect()} == {"x"}
    assert clean_documents(none).count() == 0 and keep_clean(none).count() == 0


PAGE = "<html><head><title>t</title></head><body class='no-sidebar'><div class='top'>{menu}</div><nav><a href=/>x</a></nav><div class='cookie-bar'>We use cookies</div><article><header><h1>Title {i}</h1></header><p>First &amp; {i}<br>line <b>bold</b>er<p>Second <i>part {i}</i>.<ul><li>one {i}<li>two</ul><aside>related</aside></article><div id='comments'>nice {i}</div><form><input value=q><button>Go</button></form><footer>&copy; all</footer><script>if (a < b) document.write('<p>no</p>')</script></body></html>"


def test_style_tree(spark):
    from voltgrain.llm.html_style_tree import main_text, read

    rows = [(i, f"https://User@Site.example:80/{i}", PAGE.format(i=i, menu="Same words on all pages")) for i in range(12)]
    rows += [(20 + i, f"https://other.example/{i}", PAGE.format(i=i, menu=f"Own words of page {i}")) for i in range(12)]
    rows += [(40, None, None), (41, "x", ""), (42, "https://one.example/", "<p>open <b>bold<p>next &lt;tag&gt; <!-- no --> <style>p{}</style>5 < 6"), (None, None, "plain"), rows[0]]
    rows += [(43, "https://deep.example/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = main_text(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    body = "Title {i} First & {i} line bolder Second part {i}. one {i} two"
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[3] == body.format(i=3)  # the same words on all pages of a host go
    assert text[23] == "Own words of page 3 " + body.format(i=3)  # words that differ stay
    assert text[40] == "" and text[41] == "" and text[None] == "plain" and text[43] == "deep"
    assert text[42] == "open bold next <tag> 5 < 6"
    assert read("<article>a<nav>b<article>c</article>", frozenset()) in ("a c", "c", "a")
    assert main_text(df.limit(0)).count() == 0
    # a host where one page was copied many times: its article is no furniture
    copies = [(i, "https://copied.example/", PAGE.format(i=max(0, i - 30), menu=f"Own words of page {max(0, i - 30)}")) for i in range(40)]
    got = main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Own words of page {max(0, r['page_id'] - 30)} " + body.format(i=max(0, r["page_id"] - 30)) for r in got)


def test_warc(spark):
    from voltgrain.llm.store import Scratch
    from voltgrain.llm.warc_dictionary import archive, records

    rng = random.Random(2)
    big = ["<p>" + " ".join(rng.choice(["river", "stone", "light", "ö"]) for _ in range(400)) + f" {k}</p>" for k in range(6)]
    rows = [(i, f"https://h.example/{i}?q= x\n", big[i % 6] if i % 4 else f"small {i % 3}") for i in range(80)]
    rows += [(90, None, None), (91, "u", ""), (92, "u", big[0] * 300), (93, "u", big[0] * 300), rows[1], (None, "u", "no id"), (None, "u", big[1])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    folder = Scratch(spark, "warc-test").path()
    got = archive(df, folder, payloads=True).collect()
    want = []
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    for i, _, h in rows:
        p = (h or "").encode()
        other = len(p) >= 1000 and largest.get(h) != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", largest[h] if other else None, b"" if other else p))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    files = spark.read.format("binaryFile").load(folder).collect()
    for f in files:
        heads = [h for h, _ in records(bytes(f["content"]))]
        assert heads[0]["WARC-Type"] == "warcinfo" and bytes(f["content"])[:4] == b"\x5d\x2a\x4d\x18"
    assert archive(df.limit(0)).count() == 0


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(3, 2) * sum(sizes.values())
    while free:
        rate = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * rate > most * sizes[s]}
        if not over:
            return target | {s: w[s] * rate for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(docs, none):
    from voltgrain.llm.mixing import mix, mixed_documents

    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words_of(r["text"]))
    target = mix_targets(sizes)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(target[r["source"]]))
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    most = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= most for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    texts = mixed_documents(docs)
    assert texts.columns == docs.columns
    assert Counter(r["doc_id"] for r in texts.collect()) == Counter({i: sum(r["copies"] for r in got if r["doc_id"] == i) for i in {r["doc_id"] for r in got}})
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def test_sharding(docs, none):
    from voltgrain.llm.sharding import interleave

    rows = docs.collect()
    got = interleave(docs, shards=7).collect()
    by_text = {r["doc_id"]: r["text"] or "" for r in rows}
    per = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    for r in got:
        t = by_text[r["doc_id"]].encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "rows" and r["grown_shard"] is None
    n = Counter(r["source"] for r in rows)
    for s in n:
        shares = Counter(r["shard"] for r in got if r["source"] == s)
        assert all(abs(shares[k] - n[s] / 7) <= 1.5 for k in range(7))
    assert interleave(none).count() == 0
    assert len(interleave(docs.limit(3), shards=24).select("shard").distinct().collect()) == 3


def test_simhash(spark, docs, none):
    import xxhash

    from voltgrain.llm import simhash_pivots

    rows = docs.collect()

    def fp(t):
        w = [x.lower() for x in words_of(t)]
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r["text"]) for r in rows]
    got = simhash_pivots.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % (1 << 64)) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, f) for r, f in zip(rows, fps))
    comp = {r["doc_id"]: r["doc_id"] for r in rows if r["doc_id"] is not None}
    for _ in range(10):
        for r, f in zip(rows, fps):
            for s, g in zip(rows, fps):
                if r["doc_id"] is not None and s["doc_id"] is not None and (f ^ g).bit_count() <= 4:
                    comp[r["doc_id"]] = comp[s["doc_id"]] = min(comp[r["doc_id"]], comp[s["doc_id"]])
    assert {r["doc_id"]: r["component_id"] for r in got} == {**comp, None: None}
    kept = simhash_pivots.keep_one(docs).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([None, *{c for c in comp.values()}])
    assert simhash_pivots.near_duplicates(none).count() == 0


def test_simhash_links(spark):
    from voltgrain.llm import simhash_pivots
    from voltgrain.llm.components import components
    from voltgrain.llm.store import Scratch

    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 64, 40, np.uint64)
    fps = set()
    for c in centres:
        for _ in range(30):
            f = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = simhash_pivots.forest(len(fps), *map(np.array, zip(*[(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])))
    tile = simhash_pivots.TILE
    for t, n in ((tile, len(fps)), (20, len(fps)), (tile, 1 << 21)):  # tiles of several blocks; cells of two bands
        simhash_pivots.TILE = t
        try:
            links = simhash_pivots.fingerprint_links(df, n)
            got = {r["node"]: r["component"] for r in components(links, Scratch(spark, "t")).collect()}
        finally:
            simhash_pivots.TILE = tile
        assert [got.get(i, i) for i in range(len(fps))] == want.tolist()


def test_components(spark):
    from voltgrain.llm.components import components
    from voltgrain.llm.store import Scratch

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(60, 50), (61, 50), (61, 62), (7, 7), (None, 3), (62, 60)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 50: 50, 60: 50, 61: 50, 62: 50}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_factorisation(spark, docs, none):
    import pyarrow as pa

    from voltgrain.llm import factorisation as fm

    rng = np.random.default_rng(0)
    m = fm.Machine(0.3, rng.normal(size=fm.FEATURES), rng.normal(size=(fm.FEATURES, fm.FACTORS)))
    bounds, f, x = fm.features(pa.array(["some words and some more", None, "", "x"]), None)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):  # all pairs against the sum-of-squares identity
        z = m.bias + sum(m.w[i] * u for i, u in zip(f[a:b], x[a:b])) + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert m.raw(bounds, f, x)[0][k] == pytest.approx(z)
    got = fm.score(docs, fm.fit_machine([])).collect()
    assert {r["score"] for r in got} == {0.5} and len(got) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    rows = [(i, ("bad ### stuff *** word%d " % (i % 50) if i % 4 == 0 else "good plain words here word%d. " % (i % 50)) * 8, "en", "s", 100) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(1500)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    machine = fm.fit(df, labels)
    held = [r for r in fm.score(df, machine).collect() if r["held_out"]]
    assert len(held) > 200 and all(r["predicted"] == (0 if r["doc_id"] % 4 == 0 else 1) for r in held)
    again = fm.fit(df, labels)
    assert np.array_equal(again.w, machine.w)
    assert set(fm.keep_good(df, labels).columns) == set(df.columns)
    good = df.where("doc_id % 4 > 0").selectExpr("*", "'mine' as Score", "doc_id as held_out")  # no bad one to learn from, names that clash
    left = fm.keep_good(good.union(df.where("doc_id = 4").selectExpr("*", "'mine'", "doc_id")), labels, learn_from=df).collect()
    assert {r["doc_id"] for r in left} == {i for i in range(1500) if i % 4} and all(r["Score"] == "mine" and r["held_out"] == r["doc_id"] for r in left)
    assert fm.score(none, machine).count() == 0 and fm.keep_good(none, labels.limit(0)).count() == 0


def test_pipeline_and_registration(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, save(stage(spark, docs, d))
        if k < 4:
            assert docs.columns == before.columns and docs.count() > 0
    assert docs.count() == before.count()
