"""Main text of web pages by template deduction over equivalence classes of a host's tokens.

A page's tokens are the paths of its block elements and its strings. A path differentiates roles: it names an element's
tag and its class, id and role, and counts containers among their like siblings. Tokens whose occurrence vectors over a
host's distinct pages are equal form an equivalence class. A class is valid if it has two tokens or more and lies on
most of the pages; since a path holds its ancestors' paths, valid classes nest into the host's template. Its elements
that each page has once bound the slots. The content slot is the deepest of them that holds half of the host's text,
one that is marked as an article or main element before others, and what remains in it is the main text: without
containers of which the template has the whole text, without parts that HTML marks as no text of the page, and without slots of
the template whose names say so. A string that pages repeat stays where it stands among others that differ, as headings do. Names decide nothing else, unless a host has too few pages for a template or a page is off its
host's template; such a page is read by the same rule on itself alone.

Occurrence vectors never meet in one place: sums of page hashes stand for them, so a host with most of the pages is
summed before it is shuffled.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, written

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<(?:/?)[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template iframe textarea title svg math select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("html body head td th tr tbody thead tfoot caption li dd dt figcaption summary legend".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements and names of classes that hold no main text.
ASIDE = frozenset("nav footer aside form button menu dialog".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adsbygoogle|sponsor\w*|promo\w*|banner|sidebar|widget\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|comments?|commentlist|"
    r"disqus\w*|respond|reply|replies|cookies?|consent|notices?|notification|gdpr|newsletter|subscribe|signup|social|share|sharing|related|recommend\w*|popup|modal|overlay|alert|search|pagination|skip)(?:$|[\s_-])",
    re.I,
)
#: Elements that are blocks of text rather than containers of the whole.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption legend summary pre address hgroup head".split())
TAG, NAME = 1, 2
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)


class Page:
    """Block elements of a page, as (path, parent, rank, depth, aside), and its text blocks, as (element, text).

    rank is 2 for an article, 1 for a main element, -1 for a leaf that can't hold a page's text, -2 for a title and -3 for a
    lesser heading, else 0.
    aside has bit TAG under an element that HTML sets aside, and bit NAME under one whose class, id or role does.
    """

    __slots__ = ("blocks", "elements", "siblings")

    def __init__(self, source: str):
        self.elements: list[tuple[int, int, int, int, int]] = [(0, -1, 0, 0, 0)]
        self.siblings: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        parts: list[str] = []
        at, end = 0, len(source)

        def flush() -> None:
            if parts:
                text = " ".join(references.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                parts.clear()

        def pop(n: int) -> None:
            flush()
            del stack[n:]

        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if name in BLOCK:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            pop(k)
                            break
                    else:
                        flush()
                continue
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = close.end() if close else end
                if name not in ("script", "style", "noscript", "template"):
                    parts.append(" ")
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name not in BLOCK:
                continue
            flush()
            if name in VOID:
                continue
            if name in _CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in ("td", "th", "table", "li", "div", "article", "section"):
                        break
            elif name in _ENDS:
                ends, bounds = _ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        pop(k)
                        break
                    if stack[k][0] in bounds:
                        break
            self._open(name, m.group(3), stack)
        flush()

    def _open(self, name: str, attributes: str, stack: list[tuple[str, int]]) -> None:
        parent = stack[-1][1]
        path, _, _, depth, aside = self.elements[parent]
        label, body, hidden = "", False, False
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    label += f" {value}"
                elif key == "itemprop":
                    body |= value == "articleBody"
                elif key == "hidden":
                    hidden = True
                elif re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        rank = 2 if name == "article" or body else 1 if name == "main" or "main" in label.split() else -2 if name in ("h1", "h2") else -3 if name in ("h3", "h4", "h5", "h6") else -1 if name in LEAF else 0
        if rank > 0:
            aside |= NAME * bool(COMMENT.search(label))
        elif name == "header":
            aside |= TAG * (not any(self.elements[i][2] > 0 for _, i in stack))
        elif name not in ("html", "body"):
            aside |= TAG * (name in ASIDE) | NAME * bool(label and BOILERPLATE.search(label))
        step = f"{name}{label}"
        if rank >= 0:
            at = self.siblings[parent, step] = self.siblings.get((parent, step), 0) + 1
            step = f"{step}[{at}]"
        key = xxhash.xxh64_intdigest(f"{path}/{step}") >> 1
        self.elements.append((key, parent, rank, depth + 1, aside | TAG * hidden))
        stack.append((name, len(self.elements) - 1))

    def masses(self, aside: int = 3) -> dict[int, list[int]]:
        """path -> [occurrences, rank, depth, characters under it that have none of the bits ``aside``]."""
        chars = [0] * len(self.elements)
        for i, text in self.blocks:
            if not self.elements[i][4] & aside:
                while i >= 0:
                    chars[i] += len(text)
                    i = self.elements[i][1]
        out: dict[int, list[int]] = {}
        for (path, _, rank, depth, apart), n in zip(self.elements, chars, strict=True):
            e = out.setdefault(path, [0, 0, depth, 0])
            e[0] += 1
            e[1] = -1 if rank < 0 else max(e[1], 0 if apart & aside else rank)
            e[3] += n
        return out

    def content(self) -> int:
        """The path that holds the content, by this page alone: see choose()."""
        masses = self.masses()
        total = masses[0][3]
        ranked = [(rank, chars if rank > 0 else depth, -path, path) for path, (_, rank, depth, chars) in masses.items() if chars and (rank > 0 or rank == 0 and 2 * chars >= total)]
        return max(ranked)[3] if ranked else 0

    def inside(self, root: int) -> list[bool]:
        """Whether each element lies in an element of path ``root``; a title that stands just beside it belongs to it."""
        out: list[bool] = []
        for path, parent, _, _, _ in self.elements:
            out.append(path == root or (parent >= 0 and out[parent]))
        if not any(e[2] == -2 and own for e, own in zip(self.elements, out, strict=True)):
            for i in [i for i, e in enumerate(self.elements) if e[0] == root and i]:
                for k, e in enumerate(self.elements[:i]):
                    out[k] = out[k] or e[2] == -2 and e[1] == self.elements[i][1]
        return out

    def constant(self, inside: list[bool], root: int, repeated: frozenset[int]) -> list[bool]:
        """Whether each element lies in a container in the slot whose blocks the template repeats, all of them, headings and more."""
        varies, holds = [False] * len(self.elements), [False] * len(self.elements)
        for i, t in self.blocks:
            marks = holds if string_token(self.elements[i][0], t) in repeated else varies
            if marks is varies or self.elements[i][2] >= -1:
                while i >= 0 and not marks[i]:
                    marks[i], i = True, self.elements[i][1]
        out = [False]
        for i, (path, parent, rank, _, _) in enumerate(self.elements[1:], 1):
            out.append(out[parent] or (inside[i] and path != root and rank == 0 and holds[i] and not varies[i]))
        return out

    def slot(self, root: int, template: frozenset[int], repeated: frozenset[int]) -> str:
        """Blocks of the template's content slot, one a line."""
        inside, named = self.inside(root), [False]
        constant = self.constant(inside, root, repeated)
        for path, parent, _, _, aside in self.elements[1:]:
            begins = bool(aside & NAME) and not self.elements[parent][4] & NAME
            named.append(named[parent] or begins and path in template)
        return "\n".join(t for i, t in self.blocks if inside[i] and not self.elements[i][4] & TAG and not named[i] and not constant[i])

    def text(self, root: int | None, template: frozenset[int] = frozenset(), repeated: frozenset[int] = frozenset()) -> str:
        """What slot() gives, or without a template or off it the blocks of the page's own content that don't stand aside."""
        if root is not None and any(e[0] == root for e in self.elements) and (found := self.slot(root, template, repeated)):
            return found
        inside = self.inside(self.content())
        return "\n".join(t for i, t in self.blocks if inside[i] and not self.elements[i][4])


def string_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}|{text}") >> 1


_HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)"


def host_of(url: str | None) -> str | None:
    m = re.match(_HOST, url or "", re.ASCII)
    return m[1].lower() or None if m else None


def tokens(pages: DataFrame) -> DataFrame:
    """host, token, text (a string, not a path), rank, depth, named, n, chars, v1 and v2 for each distinct token of a page.

    named is true for the path of an element that names set aside and that stands under none such.

    v1 and v2 hash the page and the token's count on it; their sums over a host's pages stand for the occurrence vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, sources = (c.to_pylist() for c in batch.columns)
            for a, b in slices([len(s or "") + 1 for s in sources], 4_000_000):
                out: list[tuple] = []
                for url, source in zip(urls[a:b], sources[a:b], strict=True):
                    host = host_of(url)
                    if host is None or not source:
                        continue
                    page, key = Page(source), xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"))
                    named = {e[0] for e in page.elements[1:] if e[4] & NAME and not page.elements[e[1]][4] & NAME}
                    found = [(path, False, *v, path in named) for path, v in page.masses(TAG).items()]
                    counts: dict[int, int] = {}
                    for i, t in page.blocks:
                        if not page.elements[i][4] & TAG:
                            k = string_token(page.elements[i][0], t)
                            counts[k] = counts.get(k, 0) + 1
                    found += [(k, True, n, 0, 0, 0, False) for k, n in counts.items()]
                    for token, text, n, rank, depth, chars, apart in found:
                        v = xxhash.xxh64_intdigest(f"{key}:{n}")
                        out.append((host, token, text, rank, depth, apart, n, chars, v >> 33, v & 0x7FFFFFFF))
                if out:
                    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "token", "text", "rank", "depth", "named", "n", "chars", "v1", "v2"])

    return pages.select("url", "html").mapInArrow(run, "host string, token long, text boolean, rank int, depth int, named boolean, n long, chars long, v1 long, v2 long")


def choose(summed: DataFrame, pages: int = 3, share: float = 0.5, repeats: float = 0.9) -> DataFrame:
    """host, root, template and repeated (arrays of paths and of string tokens) of each host with at least ``pages`` pages.

    ``summed`` has host, token, text, rank, depth, named, pages, n, chars, v1, v2. Classes are the tokens of a host with
    equal vectors. Of the paths in valid classes that pages have once and that hold half of the host's text, which are
    nested, the root is the deepest article, else the deepest main element, else the deepest of all. ``template`` has the
    paths of valid classes that names set aside. A string repeats if a valid class holds it on ``repeats`` of the pages.
    """
    size = summed.groupBy("host", "pages", "n", "v1", "v2").agg(F.count("*").alias("large"))
    whole = summed.where("token = 0 and not text").select("host", F.col("pages").alias("of"), F.col("chars").alias("total")).where(F.col("of") >= pages)
    valid = summed.join(size, ["host", "pages", "n", "v1", "v2"]).join(whole, "host").where((F.col("large") >= 2) & (F.col("pages") >= share * F.col("of")))
    slot = valid.where(~F.col("text") & (F.col("chars") > 0) & (F.col("rank") >= 0) & (F.col("n") == F.col("pages")) & (2 * F.col("chars") >= F.col("total")))
    order = F.struct("rank", "depth", (-F.col("token")).alias("neg"))
    roots = slot.groupBy("host").agg((-F.max(order)["neg"]).alias("root"))
    repeated = F.col("text") & (F.col("pages") >= repeats * F.col("of"))
    parts = valid.where(repeated | F.col("named")).groupBy("host").agg(F.sort_array(F.collect_list(F.when(F.col("named"), F.col("token")))).alias("template"), F.sort_array(F.collect_list(F.when(repeated, F.col("token")))).alias("repeated"))
    return roots.join(parts, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of ``pages`` (page_id, url, html); see the module's text.

    A null or empty html gives an empty text; a null url, or one without a host, is a page without a template. Markup
    that is cut off or unclosed is read as browsers do. Repeated rows get equal texts; an empty table gives an empty
    one; other columns are ignored. Runs a job that writes the templates to the shared folder: a few numbers a host,
    since only strings on nine tenths of a host's pages are kept. They are joined by host, and Spark broadcasts them
    only below its own size bound. Equal pages of a host count once for its template, so an article that is published
    again and again is not taken for template text.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    named = rows.withColumn("host", F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit("")))
    first = named.where("host is not null and html is not null").groupBy("host", F.xxhash64("html").alias("same")).agg(F.min("page_id").alias("page_id")).select("page_id").distinct()
    summed = tokens(rows.join(first, "page_id", "left_semi")).groupBy("host", "token", "text").agg(
        F.max("rank").alias("rank"), F.max("depth").alias("depth"), F.bool_or("named").alias("named"), F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("n", "chars", "v1", "v2")]
    )
    templates = written(choose(written(summed.where("pages >= 2 or token = 0"), "tokens")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, frozenset[int]] = {}
            held = lambda tokens: known.setdefault(key := tuple(tokens or ()), frozenset(key))
            out = [Page(source).text(root, held(template), held(repeated)) if source else "" for source, root, template, repeated in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = named.join(templates, "host", "left").select("page_id", "url", "html", "root", "template", "repeated")
    return joined.mapInArrow(run, "page_id long, url string, text string")

