"""Main text of HTML pages by equivalence-class template deduction.

Pages of one host are made from templates. A page is a sequence of tokens, tags
and text blocks, each told apart by its path; boxes of one kind in one element
(such as a page's divs) are told apart by their order too. Tokens of a host that occur equally
often in every page have the same occurrence vector; they are grouped by a
commutative hash of it, so the vectors are added up before and after the shuffle
and no task ever holds a host's pages. A class is large enough when it has
MIN_TOKENS tokens on MIN_PAGES pages; the class on most pages is the template's
root and other valid classes nest between its tokens. A class counts on a page
only where its tokens stand in the class's order. What no template token covers
are the slots. Marks only choose among them: the text of slots in the article is
kept; a page without an article keeps the slots outside of menus, headers,
footers, sidebars, notices, adverts, forms and comments. Of these the deduction
keeps the boxes that are the host's main ones: on all its pages together the
varying text outside of links that stands in a box is added up, and boxes with
less than MAIN_SHARE of the most go, but for headings that lead to kept text.

Constant text is content where deduction shows it: in an article, text of a
class on at most half of the host's pages counts as a slot if its element holds
varying text elsewhere on the host (copied articles, repeated paragraphs).
So does, in an article or not, text of a class on less than MIN_SHARE of the
pages if that element also stands on pages without the class. Where nothing else
would be left, the class on fewest pages is content.

Defined results: null html gives empty text; pages without a host (null or
malformed url) share one nameless host; rows that share a page_id are pages of
their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, drop_cut, rows_of

#: Least tokens of a class and least pages that it is on, however many the host
#: has; and the share of them below which its text may be a copied passage.
MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.05
#: Share of the largest box's varying text that a main box holds; boxes of one
#: kind in one element that are told apart.
MAIN_SHARE, BOXES = 0.25, 8

# HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br script style noscript template iframe object svg math canvas audio video button select textarea input".split()
)
_NOT_TEXT = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav footer aside form button select option textarea input fieldset dialog menu".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
_BOX = frozenset("div section center table tbody td ul ol dl".split())
#: Blocks whose text counts for the element around them.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre figcaption figure caption tr td th address details summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?i)\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_APART = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising|orial)?|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banner|cookies?|consent|gdpr|notices?|sidebar|side-bar|rail|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|commentlist|replies|disqus|footer|masthead|site-header|page-header|topbar|toolbar|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|pagination|pager|skip-link|outbrain|taboola)(?:$|[\s_-])"
)

_COMMENT = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])")
_WHOLE = frozenset(("html", "body", "main", "article"))
#: What an article is divided into: inside it, names of these say what they are about.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup section".split())
#: What ends each raw element.
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*(?:>|\Z)") for name in _RAW}


class Node:
    """An open element, what its text counts as, and the box that it stands in."""

    __slots__ = ("apart", "article", "box", "heading", "kinds", "link", "name", "path")

    def __init__(self, name: str, path: int, apart: bool, article: bool, around: Node | None = None):
        self.name, self.path, self.apart, self.article, self.kinds = name, path, apart, article, None
        inside = name in _INLINE or name in _LEAF
        self.box = (around.box if name in _INLINE else around.path) if around and inside else path
        self.link = bool(around) and (around.link or name == "a")
        self.heading = name in _HEADINGS or bool(around) and around.heading and name in _INLINE

    def order(self, kind: str) -> int:
        """How many children of a kind came before."""
        if self.kinds is None:
            self.kinds = {}
        n = self.kinds.get(kind, 0)
        self.kinds[kind] = n + 1
        return min(n, BOXES)


class _Open:
    """The open elements, with the places of each name and of blocks among them,
    so that no tag searches them: parsing takes time linear in the page."""

    def __init__(self):
        self.nodes = [Node("", 0, False, False)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        if node.name not in _INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def innermost(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def cut(self, k: int) -> None:
        for node in self.nodes[k:]:
            self.at[node.name].pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()
        del self.nodes[k:]


def _describe(raw: str, name: str, inside: bool) -> tuple[str, bool, bool]:
    """Class and id for the path, whether the element stands apart from the
    main text, and whether it is the article; ``inside``: it divides an <article>."""
    apart, article, mark = name in _NOT_TEXT, name in ("article", "main"), ""
    if "=" in raw or "hidden" in raw:
        for m in _ATTR.finditer(raw, len(name) + 1):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                mark += f"{'.' if key == 'class' else '#'}{value}"
                # An article, and what divides it, are apart as comments alone, whatever
                # else their names say.
                apart = apart or bool((_COMMENT if inside or name in _WHOLE else _APART).search(value))
            elif key == "role":
                apart = apart or value.lower() in _ROLES
                article = article or value.lower() in ("main", "article")
            elif key == "itemprop":
                article = article or value == "articleBody"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                apart = True
    return mark, apart, article and not apart


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)))


class Page:
    """Tokens of a page in order.

    ``tokens``: hash of each token; ``texts``: (index of its token, text, block
    number, stands apart, in the article); ``places``: (box, in a link, in a
    heading) of each text; ``elements``: path of the element that each text token
    stands in, and its box and characters outside of links.
    """

    def __init__(self, source: str):
        self.tokens: list[int] = []
        self.texts: list[tuple[int, str, int, bool, bool]] = []
        self.places: list[tuple[int, bool, bool]] = []
        self.elements: dict[int, tuple[int, int, int]] = {}
        stack = _Open()
        block, raw_until, at = 0, None, 0
        while at < len(source):
            # Inside a raw element all is its text up to its end tag.
            m = _TOKEN.match(source, at) if raw_until is None else _RAW_END[raw_until].search(source, at)
            if m is None:
                break
            raw_until, at, token = None, m.end(), m[0]
            tag = _TAG.match(token) if token[0] == "<" else None
            if tag is None:
                if token[0] == "<" and len(token) > 1:
                    continue
                top = stack.nodes[-1]
                if token.isspace():
                    if self.texts and self.texts[-1][2] == block:
                        self._add(token, block, top)
                    continue
                self._add(token, block, top)
                self.tokens.append(_hash("t", top.path, token.strip()))
                self.elements[self.tokens[-1]] = (top.path, top.box, 0 if top.link or top.apart else len(token.strip()))
                continue
            name = tag[2].lower()
            if tag[1]:
                if name not in _INLINE:
                    block += 1
                k = stack.innermost((name,))
                # An end tag doesn't close what an inline one would cross.
                if k and not (name in _INLINE and stack.blocks[-1] > k):
                    self.tokens.append(_hash("e", stack.nodes[k].path, name))
                    stack.cut(k)
                continue
            if name not in _INLINE:
                block += 1
            if name in _CLOSES_P:
                self._close(stack, ("p",), ("article", "section", "div", "td", "th", "body", "li", "main", "button", "table"))
            if name in _CLOSES_SAME and name != "p":
                self._close(stack, _CLOSES_SAME[name], _SCOPE[name])
            top = stack.nodes[-1]
            mark, apart, article = _describe(token, name, name in _PARTS and bool(stack.at.get("article")))
            if name == "header" and not top.article:
                apart = True
            path = _hash("p", top.path, name, mark, top.order(name + mark)) if name in _BOX else _hash("p", top.path, name, mark)
            self.tokens.append(path)
            if name == "br":
                self.texts.append((len(self.tokens) - 1, " ", block, top.apart, top.article))
                self.places.append((top.box, top.link, top.heading))
            if name in _VOID or token.endswith("/>"):
                continue
            stack.push(Node(name, path, top.apart or apart, top.article or article, top))
            if name in _RAW and name != "noscript":
                raw_until = name

    def _add(self, text: str, block: int, top: Node) -> None:
        self.texts.append((len(self.tokens), text, block, top.apart, top.article))
        self.places.append((top.box, top.link, top.heading))

    def _close(self, stack: _Open, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        k = stack.innermost(names)
        # Inline elements that were left open go on in the next block.
        if k > stack.innermost(scope) and stack.blocks[-1] == k:
            self.tokens.append(_hash("e", stack.nodes[k].path, stack.nodes[k].name))
            stack.cut(k)


def host_of(url):
    """Lower-cased host of a URL column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _signed(t: int | None) -> int | None:
    return t - (1 << 64) if t is not None and t >> 63 else t


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, token, pages it is on, signature of its occurrence vector, mean
    place, and the element, box and characters of a text; added up over a batch,
    then by key."""

    def run(batches):
        for batch in batches:
            for part in rows_of(batch, column="html"):
                total: dict[tuple[str, int], list[int]] = {}
                for host, key, source in zip(*(part.column(c).to_pylist() for c in ("host", "page_key", "html")), strict=True):
                    own: dict[int, list[int]] = {}
                    page = Page(source or "")
                    for i, t in enumerate(page.tokens):
                        if (seen := own.get(t)) is None:
                            own[t] = [1, i]
                        else:
                            seen[0] += 1
                    for t, (n, i) in own.items():
                        # Vectors are compared by sums of hashes of (page, count).
                        sign = xxhash.xxh3_64_intdigest(b"%d:%d" % (key, n)) >> 16
                        if (row := total.get((host, t))) is None:
                            element, box, chars = page.elements.get(t, (None, None, 0))
                            total[host, t] = [1, sign, i, _signed(element), _signed(box), chars]
                        else:
                            row[0] += 1
                            row[1] += sign
                            row[2] += i
                if total:
                    rows = [(h, _signed(t), *v) for (h, t), v in total.items()]
                    types = (pa.string(), *[pa.int64()] * 7)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["host", "token", "pages", "sign", "place", "element", "box", "chars"])

    found = pages.mapInArrow(run, "host string, token long, pages long, sign long, place long, element long, box long, chars long")
    return found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum(F.col("sign").cast("decimal(38,0)")).alias("sign"), F.sum("place").alias("place"),
        *[F.max(c).alias(c) for c in ("element", "box", "chars")],
    )


def templates(vectors: DataFrame, sizes: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The classes of hosts, a row each: ``tokens`` in order of their mean place,
    what ``marks`` each (1: content in an article, 2: content anywhere), and the
    ``key``, a token that a page with the class has; main boxes are rows of one
    token marked 3. By ``pages``, ``size`` and
    ``tokens`` the class on most pages and of most tokens is first. ``sizes`` has
    each host's number of pages; ``vectors`` is read again for each join.

    A class holds at most the tokens of one page; a host may have any number.
    """
    often = vectors.filter(F.col("pages") >= min_pages).join(sizes, "host")
    varying = vectors.filter((F.col("pages") < min_pages) & F.col("element").isNotNull()).select("host", "element").distinct().withColumn("varies", F.lit(True))
    around = vectors.filter((F.col("pages") >= min_pages) & F.col("element").isNull()).select("host", F.col("token").alias("element"), F.col("pages").alias("element_pages"))
    often = often.join(varying, ["host", "element"], "left").join(around, ["host", "element"], "left")
    rare = (F.col("pages") < min_share * F.col("host_pages")) & (F.col("element_pages") > F.col("pages"))
    mark = F.when(F.col("varies") & rare, 2).when(F.col("varies") & (2 * F.col("pages") <= F.col("host_pages")), 1).otherwise(0)
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", mark.cast("byte").alias("mark"))
    classes = often.groupBy("host", "sign", "pages").agg(F.sort_array(F.collect_list(member)).alias("members")).filter(F.size("members") >= min_tokens)
    tokens = F.transform("members", lambda m: m["token"])
    classes = classes.select(
        "host", F.array_min(tokens).alias("key"), (-F.col("pages")).alias("pages"), (-F.size("members")).alias("size"), tokens.alias("tokens"),
        F.transform("members", lambda m: m["mark"]).alias("marks"),
    )
    return classes.unionByName(main_boxes(vectors, sizes, min_pages))


def main_boxes(vectors: DataFrame, sizes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Boxes of hosts with pages enough that hold much of their varying text."""
    varying = vectors.filter((F.col("pages") < min_pages) & F.col("box").isNotNull() & (F.col("chars") > 0))
    held = varying.groupBy("host", "box").agg(F.sum(F.col("chars") * F.col("pages")).alias("held"))
    most = held.groupBy("host").agg(F.max("held").alias("most")).join(sizes.filter(F.col("host_pages") >= min_pages), "host")
    main = held.join(most, "host").filter(F.col("held") >= MAIN_SHARE * F.col("most"))
    return main.select("host", F.col("box").alias("key"), F.lit(0).cast("long").alias("pages"), F.lit(0).alias("size"), F.array("box").alias("tokens"), F.array(F.lit(3).cast("byte")).alias("marks"))


def template_tokens(tokens: list[int], classes: list[list[int]]) -> np.ndarray:
    """Flags of the page's tokens that valid classes cover."""
    return covering(tokens, classes) >= 0


def covering(tokens: list[int], classes: list[list[int]]) -> np.ndarray:
    """The valid class that covers each of the page's tokens, or -1: a class is
    valid on the page where its tokens occur equally often, each round in order;
    later classes must nest between two tokens of the root."""
    owner = np.full(len(tokens), -1)
    at: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        at.setdefault(t, []).append(i)
    root: list[int] = []
    for c, members in enumerate(classes):
        places = [at.get(int(t) & 0xFFFFFFFFFFFFFFFF) for t in members]
        if any(p is None for p in places) or len({len(p) for p in places}) != 1:
            continue
        flat = [p[r] for r in range(len(places[0])) for p in places]
        if any(a >= b for a, b in zip(flat, flat[1:], strict=False)):
            continue
        if root:
            slot = {int(np.searchsorted(root, p)) for p in (flat[0], flat[-1])}
            if len(places[0]) > 1 and len(slot) != 1:
                continue
        else:
            root = flat
        owner[flat] = c
    return owner


def main_text(source: str | None, classes: list) -> str:
    return _read(Page(source or ""), classes)[0]


def _read(page: Page, classes: list) -> tuple[str, int]:
    """Text of a page and number of valid classes on it; ``classes`` are pairs of
    tokens and marks, main boxes among them."""
    boxes = {int(tokens[0]) & 0xFFFFFFFFFFFFFFFF for tokens, marks in classes if marks[0] == 3}
    classes = [c for c in classes if c[1][0] != 3]
    owner = covering(page.tokens, [tokens for tokens, _ in classes])
    valid = len(set(owner.tolist()) - {-1})
    in_article = any(article and not apart and text.strip() for _, text, _, apart, article in page.texts)
    own = [not apart and (article or not in_article) for _, _, _, apart, article in page.texts]
    if not in_article:
        own = _in_main(page, own, boxes)
    kept = [(i, t, b) for (i, t, b, _, _), good in zip(page.texts, own, strict=True) if good]
    content = {int(t) & 0xFFFFFFFFFFFFFFFF for tokens, marks in classes for t, m in zip(tokens, marks, strict=True) if m == 2 or m and in_article}
    # The class that takes each text, -1 for slots.
    taken = [-1 if t.isspace() or page.tokens[i] in content else int(owner[i]) for i, t, _ in kept]
    # All of a page may be constant, as among copies: then its rarest class is slot.
    for least in [len(classes), *sorted({c for c in taken if c >= 0}, reverse=True)]:
        text = _join([(b, t) for c, (_, t, b) in zip(taken, kept, strict=True) if c < 0 or c >= least])
        if text:
            return text, valid
    return "", valid


def _in_main(page: Page, own: list[bool], boxes: set[int]) -> list[bool]:
    """Of a page's own texts those in main boxes, and headings that lead to them;
    all where none stands in one."""
    main = [good and box in boxes for good, (box, _, _) in zip(own, page.places, strict=True)]
    if not any(m and not t[1].isspace() for m, t in zip(main, page.texts, strict=True)):
        return own
    leads = False
    for i in range(len(main) - 1, -1, -1):
        _, _, heading = page.places[i]
        if not page.texts[i][1].isspace() and not (own[i] and heading):
            leads = main[i]
        main[i] = main[i] or own[i] and heading and leads
    return main


def _join(parts: list[tuple[int, str]]) -> str:
    out: list[str] = []
    now, held = None, []
    for block, text in [*parts, (None, "")]:
        if block != now and held:
            line = " ".join(entities.unescape("".join(held)).split())
            if line:
                out.append(line)
            held = []
        now = block
        held.append(text)
    return "\n".join(out)


#: Bytes of templates up to which every task gets them all.
BROADCAST_BYTES = 16 << 20


class Templates:
    """Classes of all hosts in memory, found by the tokens of a page."""

    def __init__(self, rows: list):
        self.hosts: dict[str, dict[tuple, tuple]] = {}
        for r in sorted(rows, key=lambda r: (r.host, r.pages, r.size, r.tokens)):
            own = self.hosts.setdefault(r.host, {})
            own[r.key & 0xFFFFFFFFFFFFFFFF, r.marks[0] == 3] = (len(own), np.array(r.tokens, np.int64), np.array(r.marks, np.int8))

    def on(self, host: str, tokens: list[int]) -> list[tuple]:
        """Classes whose key is on the page, in order."""
        own = self.hosts.get(host)
        if not own:
            return []
        seen = set(tokens)
        found = (own[k] for k in own if k[0] in seen) if len(own) < len(seen) else (own[t, b] for t in seen for b in (False, True) if (t, b) in own)
        return [c[1:] for c in sorted(found, key=lambda c: c[0])]


def keyed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the classes whose key is on the page. Pages and classes meet by
    host and token, so no task ever holds a host's classes."""

    def run(batches):
        for batch in batches:
            for part in rows_of(batch, column="html"):
                found = [[_signed(t) for t in set(Page(h or "").tokens)] for h in part.column("html").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column("host").take(at), part.column("page_key").take(at), pa.array([t for f in found for t in f], pa.int64())], ["host", "page_key", "key"])

    tokens = rows.select("host", "page_key", "html").mapInArrow(run, "host string, page_key long, key long")
    met = tokens.join(classes, ["host", "key"]).groupBy("host", "page_key").agg(F.sort_array(F.collect_set(F.struct("pages", "size", "tokens", "marks"))).alias("classes"))
    return rows.join(met, ["host", "page_key"], "left")


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars and n_classes (of the host's template, valid on
    the page)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    vectors = cut(token_vectors(rows.select("host", "page_key", "html")), "token_vectors")
    deduced = cut(templates(vectors, sizes, min_tokens, min_pages, min_share), "templates")
    drop_cut(vectors)
    # Templates of a measured size are broadcast, so html stays where it is.
    size = deduced.agg(F.sum(128 + 9 * F.size("tokens")).alias("n")).first().n or 0
    shared = pages.sparkSession.sparkContext.broadcast(Templates(deduced.collect())) if size <= broadcast_bytes else None
    met = rows.select("page_id", "url", "html", "host") if shared else keyed(rows, deduced).select("page_id", "url", "html", "classes")

    def run(batches):
        for batch in batches:
            for part in rows_of(batch, column="html"):
                read = []
                for source, of in zip(part.column("html").to_pylist(), part.column(3).to_pylist(), strict=True):
                    page = Page(source or "")
                    read.append(_read(page, shared.value.on(of, page.tokens) if shared else [(c["tokens"], c["marks"]) for c in of or []]))
                texts = [t for t, _ in read]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in read], pa.int32())],
                    ["page_id", "url", "text", "n_chars", "n_classes"],
                )

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_classes int")
