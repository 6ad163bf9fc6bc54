"""Main text of pages by template deduction from equivalence classes.

A page is a sequence of tokens, each at its DOM path: opening tags (with their
identifying attribute) and whole text nodes. Per host, each distinct page once, Spark counts each token
page by page; the occurrence vector of a token over the host's pages is kept as a
signature, a sum of hashes of (page, count), so that tokens with equal vectors have equal
signatures and no vector is ever gathered. Tokens of one signature form an
equivalence class. A class is valid if it occurs on at least SUPPORT of the host's
pages, its tags nest (a class whose paths all lie under another valid class's path
hangs below it), and it holds a tag. The nested valid classes are the host's template;
what lies between its tokens are the slots.

Extraction. Slots below a template tag whose role is not content (menus, headers,
footers, sidebars, notices, adverts, forms, comments: by element or by the words of its
class and id) go, as do template texts outside the content root, the repeated wording
of the site. The content root is the template's article or main element; on hosts
without one it is the slot with most text outside links over the host's pages, cut
down to the deepest element that still holds nearly all of it. Pages of a host with
too few pages (or no template) use the same rules without classes.

Blocks: block-level elements part them, inline elements and line breaks don't;
character references are decoded, white space becomes one space. An unclosed
element ends with its parent, and p, li, options and table parts end as HTML says.

Defined cases: null or empty html gives an empty text; a null or hostless url belongs
to the host ""; pages without markup are one block of text; repeated rows (equal page
ids too) are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checked_broadcast, slices, written

SUPPORT = 0.1
NEARLY = 0.8
#: Tokens a task counts before it sends what it has.
HELD = 500_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"

#: Public HTML element lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul head title".split())
CLOSES_P = BLOCKS - {"option", "optgroup", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "body", "html", "head", "title"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
NOT_CONTENT = frozenset("nav footer aside form button select dialog menu head title canvas object embed audio video".split())
#: Words of class, id or role that name parts beside the article.
BESIDE = frozenset("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside widget related recommended share sharing social cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login comment comments disqus replies reply pagination pager copyright search toolbar topbar masthead complementary contentinfo".split())
#: Of these, words that name an article's own head when they stand inside it.
TITLE_WORDS = frozenset("header masthead".split())
ROOTS = ("article", "main")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Element:
    __slots__ = ("name", "label", "path", "beside")

    def __init__(self, name: str, label: str, path: str, beside: bool):
        self.name, self.label, self.path, self.beside = name, label, path, beside


def is_beside(name: str, marks: str, in_root: bool) -> bool:
    """Whether an element's role is not content; a header inside the article is."""
    if name in NOT_CONTENT or (name == "header" and not in_root):
        return True
    words = {w.lower() for w in WORD.findall(marks)} & BESIDE
    if in_root:
        words -= TITLE_WORDS
    return bool(words) and name not in ("body", "html", *ROOTS)


def tokens(page: str):
    """(open, element), (close, element), (text, string, parents), (break) of a page in order."""
    stack: list[Element] = []
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at: m.start()], stack
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    for element in reversed(stack[i:]):
                        stack.pop()
                        yield "close", element, stack
                    break
            continue
        if name == "br":
            yield "br", None, stack
            continue
        ends = ENDED_BY.get(name)
        while stack:
            top = stack[-1]
            inline = top.name not in BLOCKS
            if ends and top.name in ends or name in CLOSES_P and top.name == "p":
                yield "close", stack.pop(), stack
            elif inline and (name in CLOSES_P and any(e.name == "p" for e in stack) or ends and any(e.name in ends for e in stack)):
                # an unclosed inline element ends with the paragraph or item around it
                yield "close", stack.pop(), stack
            else:
                break
        marks = " ".join(v for x in MARK.findall(m[4]) for v in x[1:] if v)
        label = f"{name}.{marks}" if marks else name
        path = f"{stack[-1].path}/{label}" if stack else label
        in_root = any(e.name in ROOTS for e in stack)
        element = Element(name, label, path, is_beside(name, marks, in_root))
        if name in VOID or m[4].endswith("/") and name not in BLOCKS:
            if name in BLOCKS:
                yield "open", element, stack
                yield "close", element, stack
            continue
        stack.append(element)
        yield "open", element, stack
    if at < len(page):
        yield "text", page[at:], stack
    while stack:
        yield "close", stack.pop(), stack


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_counts(page: str) -> tuple[Counter, dict[str, int]]:
    """How often each token stands on a page, and the characters of text outside links and asides below each path."""
    counts: Counter = Counter()
    sizes: dict[str, int] = {}
    for kind, what, stack in tokens(page):
        if kind == "open":
            counts[what.path] += 1
        elif kind == "text":
            text = plain(what)
            if text:
                path = stack[-1].path if stack else ""
                counts[f"{path}\t{text}"] += 1
                if not any(e.beside or e.name == "a" for e in stack):
                    for e in stack:
                        sizes[e.path] = sizes.get(e.path, 0) + len(text)
    return counts, sizes


def token_counts(pages: DataFrame) -> DataFrame:
    """host, token (hash), path (null for texts), pages, signature, chars over all pages(page_id, host, html); a row with null token counts a host's pages."""

    def count(batches):
        def sent():
            if held:
                keys, values = list(held), np.array(list(held.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()), *(pa.array(values[:, i]) for i in range(3))],
                                                 names=["host", "token", "path", "pages", "signature", "chars"])

        held: dict[tuple, list] = {}
        for batch in batches:
            for page_id, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html"))):
                counts, sizes = page_counts(page or "")
                held.setdefault((host, None, None), [0, 0, 0])[0] += 1
                for token, n in counts.items():
                    path = None if "\t" in token else token
                    sign = _hash(f"{page_id} {n}") >> 24  # 40 bits: sums over 2**23 pages stay in a long, and wrap beyond
                    old = held.setdefault((host, _hash(token), path), [0, 0, 0])
                    old[0] += 1
                    old[1] += sign
                    old[2] += sizes.get(path, 0) if path else 0
            if len(held) > HELD:
                yield from sent()
                held = {}
        yield from sent()

    raw = pages.mapInArrow(count, "host string, token long, path string, pages long, signature long, chars long")
    return raw.groupBy("host", "token", "path").agg(F.sum("pages").alias("pages"), F.sum(F.col("signature").cast("decimal(38,0)")).alias("signature"), F.sum("chars").alias("chars"))


def templates(pages: DataFrame) -> DataFrame:
    """host, root (path of the content, null if there is no tag for it), texts (hashes of template texts)."""
    # copies tell nothing about what a host's pages have in common: each distinct page counts once. It passes one shuffle and is
    # told apart by its hash, which is the same whichever copy came first and whenever a task is repeated
    distinct = pages.groupBy("host", F.xxhash64("html").alias("page_id"), F.unhex(F.md5("html")).alias("other")).agg(F.first("html").alias("html"))
    counted = written(token_counts(distinct), "tokens")
    n_pages = counted.where("token IS NULL").select("host", F.col("pages").alias("n_pages"))
    frequent = counted.where("token IS NOT NULL").join(checked_broadcast(n_pages), "host").where(F.col("pages") >= F.greatest(F.lit(2), F.col("n_pages") * SUPPORT))
    # an equivalence class: one signature; valid if it holds a tag
    classes = frequent.groupBy("host", "signature", "pages", "n_pages").agg(
        F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "chars"))).alias("tags"),
        F.collect_list(F.when(F.col("path").isNull(), F.col("token"))).alias("texts"))
    valid = classes.where(F.size("tags") > 0)

    # the nesting: a host's template is small (frequent paths only), its classes come together
    per_host = valid.groupBy("host").agg(F.collect_list(F.struct("signature", "tags")).alias("classes"), F.flatten(F.collect_list("texts")).alias("texts"))

    def nest(batches):
        for batch in batches:
            roots = [root_of(classes) for classes in batch.column("classes").to_pylist()]
            # texts matter where no article or main element tells the content apart
            texts = [None if root and is_named(root) else own for root, own in zip(roots, batch.column("texts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(roots, pa.string()), pa.array(texts, pa.list_(pa.int64()))], names=["host", "root", "texts"])

    return per_host.mapInArrow(nest, "host string, root string, texts array<long>")


def is_named(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] in ROOTS


def root_of(classes: list[dict]) -> str | None:
    """Path of the slot that holds the content: classes are nested by their paths, then followed down while one child holds nearly all text."""
    tags = {t["path"]: t["chars"] for c in classes for t in c["tags"]}
    named = [p for p in tags if is_named(p) and tags[p]]
    if named:
        return max(named, key=lambda p: (tags[p], p))
    inside = [p for p in tags if "/" in p]
    if not inside:
        return None
    # classes hang below the class whose path is the longest prefix of theirs
    children: dict[str, list[str]] = {}
    for path in tags:
        parent = path.rpartition("/")[0]
        while parent and parent not in tags:
            parent = parent.rpartition("/")[0]
        children.setdefault(parent, []).append(path)
    at = max(children[""], key=lambda p: (tags[p], p))
    while children.get(at):
        best = max(children[at], key=lambda p: (tags[p], p))
        container = best.rpartition("/")[2].partition(".")[0] in ("body", "div", "section", "td", "table", "tbody", "tr", "center", "html")
        if not container or tags[best] < NEARLY * tags[at]:
            break
        at = best
    return at


def extract(page: str, root: str | None, template_texts: frozenset[int]) -> str:
    """Blocks of the page's content, one a line."""
    blocks: list[str] = []
    part: list[str] = []

    def end():
        text = plain("".join(part))
        if text:
            blocks.append(text)
        part.clear()

    stream = list(tokens_with_parents(page))
    has_named = any(kind == "open" and what.name in ROOTS and not any(e.beside for e in parents) for kind, what, parents in stream)
    has_root = not has_named and root is not None and any(kind == "open" and what.path == root for kind, what, parents in stream)
    for kind, what, parents in stream:
        if kind in ("open", "close"):
            if what.name in BLOCKS:
                end()
        elif any(e.beside for e in parents):
            continue
        elif kind == "br":
            part.append(" ")
        else:
            named = any(e.name in ROOTS for e in parents)
            if has_named and not named or has_root and not any(e.path == root for e in parents):
                continue
            if not named and not has_root and template_texts and _hash(f"{parents[-1].path if parents else ''}\t{plain(what)}") in template_texts:
                continue
            part.append(what)
    end()
    return "\n".join(blocks)


def tokens_with_parents(page: str):
    for kind, what, stack in tokens(page):
        yield kind, what, tuple(stack)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for pages(page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    found = written(templates(rows), "templates")
    joined = rows.join(checked_broadcast(found.withColumnRenamed("host", "__host")), F.col("host") == F.col("__host"), "left")

    def run(batches):
        known: dict[str, frozenset] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for i, (own, page, root) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "html", "root")))):
                    if own not in known:
                        known = {own: frozenset(part.column("texts")[i].as_py() or ())}
                    texts.append(extract(page or "", root, known[own]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "host", "root", "texts").mapInArrow(run, "page_id long, url string, text string")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
