"""Main text of web pages by removing the templates of their sites.

Pages are parsed into element trees (tag soup is accepted: raw-text elements,
void elements, omitted end tags). Every block element's subtree is hashed; Spark
counts with how many different remainders of the page (the kept text outside
the subtree) each hash occurs on a host, so pages that are copies count as one
and their content is no template. A subtree with at least ``MIN_PAGES``
remainders, and as many as ``SHARE`` of the host's different pages, is template
and deleted; on a host of ``LEAST_PAGES`` different pages or more, but under
``MIN_PAGES``, one that is on all of them. Paragraphs, headings and list items
inside the article are never template, so text that many articles share stays.
What is left is read from the
article (else ``main``, else the body), without the elements that hold menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments by their tag, role, class or id. A class or id counts only as a whole
token (``sidebar``, not ``has-sidebar``), never on an article or a heading, and
not on an element around the only article or ``main`` of the page; an element
that is also named as content (``content share``) stays. A form around the
article, around ``main`` or with most of the page's text is a wrapper, as pages
built of one form have it, and stays.

Inside the article a subtree is template only if ``ARTICLE_SHARE`` of the host's
different pages have it: a list or figure that some articles share stays.

Each host has at most ten times as many template subtrees as an average page of
it has subtrees (1 / ``SHARE``), so its row of the template table is bounded.

Defined cases: null or empty html gives an empty text; a null url has an empty
host; repeated pages are counted and extracted one by one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import materialize
from actlens.llm.urls import url_host

MIN_PAGES = 5
LEAST_PAGES = 3
SHARE = 0.1
ARTICLE_SHARE = 0.5
MAX_BROADCAST_BYTES = 32 << 20
MASK = (1 << 64) - 1

_TOKEN = re.compile(
    r"""<!--(?P<comment>.*?)(?:-->|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?>[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<[/]?[A-Za-z][^>]*+>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")

#: fixed values of HTML: raw-text elements, void elements, blocks, omitted end tags
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section
summary table tbody td tfoot th thead tr ul""".split())
_P_CLOSERS = BLOCK - set("td th tr tbody thead tfoot caption li dd dt option legend summary figcaption body html".split())
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "td": {"td", "th"},
           "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead"},
           "tfoot": {"td", "th", "tr", "tbody", "thead"}}
_SCOPES = set("table ul ol dl article section div aside nav main footer header body html form blockquote select".split())
#: elements that are not main text by their tag
DROP_TAGS = set("""script style noscript template head title nav header footer aside form button select textarea
input iframe object embed svg canvas audio video dialog menu noembed noframes""".split())
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: whole class and id tokens that mark what is not main text
DROP_NAMES = set("""ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored
promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies
consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup social share
sharing toolbar pagination pager login skip site-header site-footer page-footer main-nav main-menu nav-menu
ad-banner cookie-banner cookie-notice cookie-consent newsletter-signup share-buttons social-share social-links
skip-link""".split())
#: those whose elements often hold short articles of their own
DROP_ASIDES = set("""sidebar related recommended recommendations comment comments disqus respond replies widget widgets
related-posts related-articles comment-list comments-area""".split())
#: those that mark an element as content whatever else it is named
CONTENT_NAMES = set("""content article post entry story main article-body article-content entry-content post-body
post-content main-content page-content""".split())
_NEVER_BY_NAME = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: what drops an element, from the weakest: a name, the name of an aside, its tag, role or ``hidden``
BY_NAME, BY_ASIDE, BY_TAG = 1, 2, 3
#: blocks of running text: inside the article they are never template
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr tbody thead tfoot caption figcaption".split())


class Node:
    __slots__ = ("tag", "names", "dropped", "children", "digest", "in_article", "mass", "around", "letters")

    def __init__(self, tag: str, names: str, dropped: int, in_article: bool) -> None:
        self.tag, self.names, self.dropped, self.in_article = tag, names, dropped, in_article
        self.children: list[Node | str] = []
        self.digest = 0
        self.mass = 0            # sum of the hashes of its kept text
        self.around = False      # holds an article or main
        self.letters = 0         # characters of its text without white space, all but that of BY_TAG elements


def _attributes(tag: str, text: str) -> tuple[str, int]:
    """Class and id as one string, and what marks the element as something
    other than main text (0: nothing)."""
    by_tag = BY_TAG if tag in DROP_TAGS else 0
    if not text or text.isspace():
        return "", by_tag
    values = {}
    for name, a, b, c, bare in _ATTR.findall(text):
        values.setdefault((name or bare).lower(), a or b or c)
    names = f"{values.get('class', '')} {values.get('id', '')}"
    if by_tag or "hidden" in values or values.get("role", "").lower() in DROP_ROLES:
        return names, BY_TAG
    if tag in _NEVER_BY_NAME or names.isspace():
        return names, 0
    tokens = set(names.lower().split())
    return names, BY_ASIDE if tokens & DROP_ASIDES else BY_NAME if tokens & DROP_NAMES and not tokens & CONTENT_NAMES else 0


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _close(node: Node) -> None:
    h = blake2b(f"{node.tag}|{node.names}|".encode("utf-8", "replace"), digest_size=8)
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(c.split()).encode("utf-8", "replace")
            h.update(text)
            node.letters += len(text)
            if text:
                node.mass += int.from_bytes(blake2b(text, digest_size=8).digest(), "little")
        else:
            h.update(c.digest.to_bytes(8, "little", signed=True))
            if c.tag == "form" and c.around and c.dropped:
                c.dropped = 0
            inside = c.dropped < BY_TAG and (c.around or c.tag in ("article", "main"))
            if c.dropped < BY_TAG or c.tag == "form":
                node.letters += c.letters
            node.around |= inside
            if not c.dropped or inside:
                node.mass += c.mass
    node.mass &= MASK
    node.digest = int.from_bytes(h.digest(), "little", signed=True)


def parse(page: str) -> Node:
    """The element tree of a page; every node carries the hash of its subtree."""
    root = Node("html", "", 0, False)
    stack, at, n = [root], 0, len(page)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            _close(stack.pop())

    def close_open(tags: set[str]) -> None:
        for d in range(len(stack) - 1, 0, -1):
            if stack[d].tag in tags:
                return pop_to(d)
            if stack[d].tag in _SCOPES:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    pop_to(d)
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _P_CLOSERS:
            close_open({"p"})
        if tag in _CLOSES:
            close_open(_CLOSES[tag])
        names, dropped = _attributes(tag, m["attrs"])
        parent = stack[-1]
        node = Node(tag, names, dropped, parent.in_article or parent.tag in ("article", "main"))
        parent.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            node.children.append(page[at:end.start() if end else n])
            at = end.end() if end else n
            _close(node)
        elif tag in VOID or m["attrs"].rstrip().endswith("/") and tag not in BLOCK:
            _close(node)
        else:
            stack.append(node)
    if at < n:
        stack[-1].children.append(page[at:])
    pop_to(0)
    if not root.around:
        _open_forms(root)
    return root


def _open_forms(root: Node) -> None:
    """Forms that hold most of a page without an article are no forms."""
    node: Node | None = root
    while node:
        node = next((c for c in node.children if not isinstance(c, str) and 2 * c.letters > root.letters
                     and (c.dropped < BY_TAG or c.tag == "form")), None)
        if node and node.tag == "form":
            node.dropped = 0


def _is_unit(node: Node) -> bool:
    """Subtrees that can be template: blocks, but no prose of the article."""
    if node.tag not in BLOCK or node.tag in ("article", "main"):
        return False
    return not (node.in_article and node.tag in PROSE)


def _unit_key(node: Node) -> int:
    """The digest by which a subtree is counted; its last bit says: inside an article."""
    return node.digest & ~1 | node.in_article


def subtree_hashes(page: str | None) -> set[tuple[int | None, int]]:
    """(digest, remainder) of the subtrees that can be template; the page itself
    has no digest, and all of its kept text as remainder."""
    if not page:
        return set()
    tree = parse(page)
    out, stack = {(None, _signed(tree.mass))} if tree.mass else set(), [(tree, True)]
    while stack:
        node, counted = stack.pop()
        for c in node.children:
            if isinstance(c, str) or c.dropped == BY_TAG:
                continue
            # an element that is dropped anyway takes nothing from the page
            part = counted and (not c.dropped or c.around)
            if _is_unit(c):
                out.add((_unit_key(c), _signed((tree.mass - c.mass) & MASK if part else tree.mass)))
            stack.append((c, part))
    return out


def _roots(tree: Node, template: set[int]) -> list[Node]:
    """The outermost articles that are not deleted, else ``main``, else all.
    Names of elements around them are set aside where nothing else is found."""
    for wanted, level in (("article", 0), ("article", BY_NAME), ("main", 0), ("main", BY_NAME),
                          ("article", BY_ASIDE), ("main", BY_ASIDE)):
        found, stack = [], [tree]
        while stack:
            node = stack.pop()
            if node.tag == wanted and node is not tree:
                found.append(node)
                continue
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str)
                         and c.dropped <= level and not (_is_unit(c) and _unit_key(c) in template))
        if found:
            return found
    return [tree]


def main_text(page: str | None, template: set[int]) -> str:
    """Blocks of the main text, joined by newlines."""
    if not page:
        return ""
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocks.append(text)

    for root in _roots(parse(page), template):
        stack: list[tuple[Node, int]] = [(root, 0)]
        while stack:
            node, i = stack.pop()
            if i >= len(node.children):
                if node.tag in BLOCK:
                    flush()
                continue
            stack.append((node, i + 1))
            c = node.children[i]
            if isinstance(c, str):
                current.append(html_lib.unescape(c))
            elif c.dropped or (_is_unit(c) and _unit_key(c) in template):
                continue
            elif c.tag == "br":
                current.append(" ")
            else:
                if c.tag in BLOCK:
                    flush()
                stack.append((c, 0))
        flush()
    return "\n".join(blocks)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(host, *found) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for found in subtree_hashes(page)}
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()),
             pa.array([k[2] for k in seen], pa.int64())], names=["host", "digest", "remainder"])


def site_templates(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES,
                   article_share: float = ARTICLE_SHARE) -> DataFrame:
    """host, template: the hashes of the subtrees that recur on the host's
    different pages."""
    counts = (pages.select(url_host(F.col("url")).alias("host"), "html")
              .mapInArrow(_count_batches, "host string, digest long, remainder long").distinct()
              .groupBy("host", "digest").agg(F.count("*").alias("n"))
              .filter((F.col("n") >= min(min_pages, LEAST_PAGES)) | F.col("digest").isNull()))
    counts = materialize(counts, "page-subtrees")
    sizes = counts.filter("digest is null").select("host", F.col("n").alias("pages"))
    part = F.when(F.col("digest").bitwiseAND(F.lit(1)) == 1, article_share).otherwise(share)
    need = F.greatest(F.least(F.lit(min_pages), F.col("pages")), F.col("pages") * part)
    return (counts.filter("digest is not null").join(sizes, "host").filter(F.col("n") >= need)
            .groupBy("host").agg(F.collect_set("digest").alias("template")))


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, set(template or ())) for page, template in
                 zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    templates = materialize(site_templates(pages), "page-templates")
    if (templates.agg(F.sum(F.size("template") * 8 + F.octet_length("host") + 64)).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        templates = F.broadcast(templates)
    keyed = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    return (keyed.join(templates, "host", "left").select("page_id", "url", "html", "template")
            .mapInArrow(_extract_batches, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
