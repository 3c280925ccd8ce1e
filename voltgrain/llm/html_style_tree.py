"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltgrain.llm.store import Scratch

#: A node is removed from the pages of a host if at least so many of them have it and its importance is lower.
MIN_PAGES, MIN_IMPORTANCE = 8, 0.4
#: Share of the content in a node's importance; the rest is its presentation.
CONTENT = 0.9
#: Comments, declarations and tags. A < outside quotes or a quote of over 4096 signs ends the first reading of a tag; then the nearest > ends it.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: One attribute: its name and its value, double quoted, single quoted or plain.
ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NOISE = frozenset("head script style noscript template iframe object embed applet svg canvas audio video nav footer aside form button select option textarea input dialog menu title noembed noframes".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sidebar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe comment comments disqus breadcrumb breadcrumbs menu nav navbar navigation topnav footer pagination pager related share sharing social promo promotion sponsor sponsored widget login signup masthead toolbar skip disclaimer".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WHOLE = frozenset("html body article main".split())
#: An opening tag ends an open element of the second set unless one of the third is nearer.
CLOSES = {t: (frozenset(a.split()), frozenset(b.split())) for ts, a, b in (
    ("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul", "p", "article aside body button div footer header main nav section table td th"),
    ("li", "li p", "ul ol menu"), ("dt dd", "dt dd p", "dl"), ("tr", "tr td th p", "table"), ("td th", "td th p", "tr table"), ("option", "option", "select"),
) for t in ts.split()}
_labels: dict[tuple[str, str], tuple[str, bool, bool]] = {}
_paths: dict[tuple[int, str], int] = {}


def label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A node's name in the tree (its tag and class), and whether its kind alone tells page furniture: outside an article, and inside one.

    Outside, one furniture word in a part of a class or id is enough; inside, a class or id must be such a word as a whole, so that ``menu-recipes`` stays.
    """
    if (got := _labels.get((tag, attributes))) is None:
        found = {k.lower(): a or b or c or "" for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}  # the first of equal names counts
        names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        sure = tag in NOISE or tag not in WHOLE and (found.get("role", "").lower().strip() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true")
        words, whole = set(re.split(r"[^a-z0-9]+", names)), set(names.split())
        got = (f"{tag}.{found.get('class', '')}", sure or tag not in WHOLE and bool(words & NOISE_WORDS), sure or tag not in WHOLE and bool(whole & NOISE_WORDS))
        if len(_labels) > 50_000:
            _labels.clear()
        _labels[tag, attributes] = got
    return got


def child(path: int, name: str) -> int:
    import xxhash

    if (got := _paths.get((path, name))) is None:
        got = xxhash.xxh64_intdigest(f"{path}/{name}") - (1 << 63)
        if len(_paths) > 200_000:
            _paths.clear()
        _paths[path, name] = got
    return got


class Node:
    __slots__ = ("tag", "path", "off", "cut", "children", "content")

    def __init__(self, tag: str, path: int, off: bool, cut: bool = False):
        self.tag, self.path, self.off, self.cut, self.children, self.content = tag, path, off, cut, [], []


def read(page: str, removed: frozenset[int], nodes: list[Node] | None = None) -> str:
    """Text of the branches that are neither furniture by kind nor ``removed``; ``nodes`` gets the closed nodes that are not furniture."""
    stack = [Node("", 0, False)]
    blocks: list[str] = [""]
    at, size = 0, page.rfind(">") + 1  # no tag ends behind it

    def say(text: str) -> None:
        if text and not stack[-1].off:
            if "&" in text:
                text = html_lib.unescape(text)
            blocks.append(text)
            if nodes is not None:
                stack[-1].content.append(text)

    def close() -> None:
        node = stack.pop()
        if node.tag not in INLINE:
            blocks.append(" ")
        if nodes is not None and not node.off:
            text = " ".join("".join(node.content).split())
            stack[-1].content.append(f" {text} " if node.tag not in INLINE else text)
            node.content = [text]
            nodes.append(node)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag == "br":
                say(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
            continue
        if (rule := CLOSES.get(tag)) is not None:
            ends, stops = rule
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in stops:
                    break
        if tag in ("article", "main"):
            while any(n.tag in ("nav", "head") for n in stack):  # left open
                close()
        if tag == "body":
            while any(n.tag == "head" for n in stack):
                close()
        top = stack[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                say(" ")
            continue
        name, noise, inside = label(tag, attributes)
        if noise and not inside:
            noise = not any(n.tag in ("article", "main") for n in stack)
        if tag == "header" and not noise:
            noise = not any(n.tag in ("article", "main") for n in stack)
        path = child(top.path, name)
        off = top.off or noise or path in removed
        if tag in ("article", "main") and top.off and path not in removed and all(n.tag == "form" or not n.cut for n in stack):
            off = noise  # some sites put the whole page into one form
        if nodes is not None and not top.off:
            top.children.append(tag)
        if tag not in INLINE:
            blocks.append(" ")
        if attributes.endswith("/") and tag not in INLINE and tag not in WHOLE and tag in ("script", "iframe"):
            continue
        stack.append(Node(tag, path, off, noise or path in removed))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                say(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
            close()
    say(page[at:])
    while len(stack) > 1:
        close()
    return " ".join("".join(blocks).split())


def host_of(url) -> F.Column:
    """Host of a URL in lower case without port; what has no host is one site of its own."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def node_facts(pages: DataFrame) -> DataFrame:
    """(host, path, style, content, page): for each page and block node of its tree with text, hashes of the sequence of child tags, of the text below and of the whole page. Inline nodes belong to their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def number(s: str) -> int:
            return xxhash.xxh64_intdigest(s) - (1 << 63)

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                hosts, paths, styles, contents, whole = [], [], [], [], []
                for host, page in zip(b.column(0)[lo : lo + 1024].to_pylist(), b.column(1)[lo : lo + 1024].to_pylist()):
                    nodes: list[Node] = []
                    read(page or "", frozenset(), nodes)
                    page_hash = number(page or "")
                    merged: dict[int, tuple[list, list]] = {}
                    for n in nodes:
                        if n.content[0] and n.tag not in INLINE:
                            tags, texts = merged.setdefault(n.path, ([], []))
                            tags += [t for k, t in enumerate(n.children) if not k or t != n.children[k - 1]]
                            texts += n.content
                    for path, (tags, texts) in merged.items():
                        hosts.append(host)
                        paths.append(path)
                        styles.append(number(" ".join(tags)))
                        contents.append(number("\n".join(texts)))
                        whole.append(page_hash)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(styles, pa.int64()), pa.array(contents, pa.int64()), pa.array(whole, pa.int64())], names=["host", "path", "style", "content", "page"])

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, path long, style long, content long, page long")


def importance(facts: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content, importance).

    With m pages that have the node, presentation importance is the entropy of its child sequences and content importance that of its texts, to the base m: 0 if all
    pages agree, 1 if all differ. A node on one page has importance 1. Counts of equal styles and texts come first, so a host with a third
    of all pages is summed up from many tasks.
    """

    def entropy(kind: str) -> DataFrame:
        counts = facts.groupBy("host", "path", kind).agg(F.count("*").alias("n"))
        sums = counts.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return sums.select("host", "path", F.col("m").alias(f"{kind}_pages"), F.when(F.col("m") < 2, 1.0).otherwise(1 - F.col("s") / F.col("m") / F.log("m")).alias(f"{kind}_imp"))

    both = entropy("style").join(entropy("content"), ["host", "path"])
    return both.select("host", "path", F.col("style_pages").alias("pages"), F.col("style_imp").alias("presentation"), F.col("content_imp").alias("content"), ((1 - CONTENT) * F.col("style_imp") + CONTENT * F.col("content_imp")).alias("importance"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    Pages of one host form a style tree: its nodes are the paths of tags and classes. Nodes whose presentation and content hardly vary over the pages
    are removed with all below them (copies of a page on a host count once, so that an article does not pass for furniture by being copied); so are nodes that are page furniture by their kind (menus, footers, forms, adverts, comments, ...), whatever their host. The rest is
    read in page order: white space inside a block becomes one space, blocks are joined by one space.

    Null or empty html has an empty text; broken markup is read as far as it goes; a null url belongs to one host without name, whose nodes are judged as
    any other's; repeated rows get repeated results; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "style-tree")
    facts = scratch.save(node_facts(pages).distinct())
    low = importance(facts).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < MIN_IMPORTANCE))
    low = scratch.save(low.groupBy("host").agg(F.collect_set("path").alias("__removed")))
    scratch.drop(facts)
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(low, "host", "left").select("page_id", "url", "html", "__removed")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, removed = None, frozenset()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = []
                for page, paths in zip(part.column(2), part.column(3)):
                    if (now := tuple(paths.as_py() or ())) != last:
                        last, removed = now, frozenset(now)
                    texts.append(read(page.as_py() or "", removed))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
