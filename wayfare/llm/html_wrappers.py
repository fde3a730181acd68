"""Main text by wrappers: union-free regular expressions inferred per host and layout.

A page is a stream of tokens: starts and ends of elements and text slots. Runs of equal elements are folded into a
repeated group. The streams of a host are aligned one after the other; what stands in one stream only becomes an
optional group, so the result has neither alternatives nor copies of the pages: it is the wrapper of those pages.

Pages of one host may have several layouts, so each layout has a wrapper of its own. Pages with text below an article or
main element are one layout, whose slots of that kind hold the article. The others are told apart by the regions in which
they have text; over the different pages of such a layout each slot is measured, and the article is what stands in the
region with the most running text. Texts that nearly all of these pages repeat are left out there, one by one.

Pages are reduced to streams where they lie, and equal streams of a host are counted before the shuffle. A task aligns
about `ALIGNED` streams; the wrappers of such shares are aligned in the next round, until a layout has one, so neither a
host with a third of all pages nor one with very many different streams is a hot group. Every page is parsed once; its
stream and the texts that may belong to an article are written, and the rest is done from there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import let_workers_import, mapped, slices
from wayfare.llm.url_templates import address
from wayfare.session import written

ALIGNED = 64  # streams that are aligned at a time, about
COPIED = 0.9  # a text outside of article elements on this share of a layout's different pages belongs to the template
MIN_PAGES = 5  # different pages of a layout from which on a repeated text says something
TAGGED = 0  # the layout of pages with text below an article or main element

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br img input area nobr".split()
)
DROPPED = frozenset("nav footer aside form button dialog menu fieldset head".split())
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navigation navbar breadcrumb breadcrumbs footer header masthead comment comments reply replies discussion respond "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription share sharing social "
    "related recommended pagination pager widget login signup search form disclaimer toolbar skip".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())
ARTICLE = frozenset(["article", "main"])
RUNNING = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())  # parts of a region


class Page:
    """Elements and text blocks of a page, in order.

    `blocks` has (path, text, letters inside links); a path names the block elements from the root on.
    """

    def __init__(self, source: str | None) -> None:
        self.stream: list[str] = []
        self.blocks: list[tuple[str, str, int]] = []
        self._open: list[str] = []
        self._words: list[str] = []
        self._link = 0
        self._linked = 0
        if source:
            self._read(source)

    def _label(self, name: str, attributes: str) -> str:
        """The element's name; with its telling word if class, id or role say that it is no article."""
        if attributes and not attributes.isspace():
            for kind, a, b, c in _ATTRIBUTE.findall(attributes):
                words = set(re.split(r"[^a-z]+", html.unescape(a or b or c).lower()))
                if kind.lower() == "role" and words & {"main", "article"}:
                    return "main"
                if name not in ("html", "body", *ARTICLE):
                    found = words & NOT_ARTICLE
                    if found:
                        return f"{name}!{min(found)}"
        return f"{name}!{name}" if name in DROPPED else name

    def _flush(self) -> None:
        if self._words:
            text = _SPACE.sub(" ", html.unescape("".join(self._words))).strip(" ")
            if text:
                self.blocks.append(("/".join(self._open), text, self._linked))
                self.stream.append("#")
            self._words = []
        self._linked = 0

    def _close(self, at: int) -> None:
        self._flush()
        while len(self._open) > at:
            self.stream.append("</" + self._open.pop())

    def _within(self, names: frozenset[str]) -> int:
        """Where the innermost element of these names is, not looking out of a list, table or section; else -1."""
        for at in range(len(self._open) - 1, -1, -1):
            name = self._open[at].partition("!")[0]
            if name in names:
                return at
            if name in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                break
        return -1

    def _read(self, source: str) -> None:
        at, skip, skipped = 0, "", 0
        for found in _TAG.finditer(source):
            if skip:  # inside a script, a style or the like
                if not (found[2] and found[2].lower() == skip):
                    continue
                skipped += -1 if found[1] else 1
                if skipped:
                    continue
                skip, at = "", found.end()
                continue
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            name, closing = found[2].lower(), bool(found[1])
            if name in RAW:
                if not closing and not found[3].endswith("/"):
                    end = source.lower().find("</" + name, at) if name in ("script", "style", "title", "textarea") else at
                    if end >= 0 and re.search(rf"</{re.escape(name)}\b", source[end:], re.IGNORECASE):
                        skip, skipped = name, 1
                    elif name in ("script", "style"):
                        return self._close(0)
                continue
            if name in INLINE:
                if name == "a":
                    self._link = 0 if closing else 1
                elif name == "br":
                    self._words.append("\n")
                continue
            if closing:
                for k in range(len(self._open) - 1, -1, -1):
                    if self._open[k].partition("!")[0] == name:
                        self._close(k)
                        break
                else:
                    self._flush()
                continue
            if name in VOID:
                self._flush()
                continue
            k = self._within(CLOSED_BY_BLOCK)
            if k >= 0:
                self._close(k)
            if name in CLOSED_BY_SAME:
                k = self._within(frozenset(["dt", "dd"]) if name in ("dt", "dd") else frozenset([name]))
                if k >= 0:
                    self._close(k)
            self._flush()
            label = self._label(name, found[3])
            if not found[3].endswith("/") or name in ("p", "div", "section", "article", "main"):
                self._open.append(label)
                self.stream.append("<" + label)
        if not skip:
            self._text(source[at:])
        self._close(0)

    def _text(self, piece: str) -> None:
        self._words.append(piece)
        if self._link:
            self._linked += len(piece)


# A wrapper is a list of nodes: ("#",), ("e", label, nodes), ("?", nodes) optional, ("+", nodes) repeated.


def _tree(stream: list[str]) -> list:
    root: list = []
    stack = [root]
    for token in stream:
        if token == "#":
            stack[-1].append(["#"])
        elif token.startswith("</"):
            stack.pop()
        else:
            node = ["e", token[1:], []]
            stack[-1].append(node)
            stack.append(node[2])
    return _folded(root)


def _body(node: list) -> list:
    return node[1] if node[0] in "?+" else [node]


def _name(node: list) -> str:
    """What two nodes must share to be aligned."""
    inner = node
    while inner[0] in "?+":
        inner = inner[1][0]
    return inner[1] if inner[0] == "e" else "#"


def _folded(nodes: list) -> list:
    """Runs of elements with one name become a repeated group whose body is aligned from all of them."""
    out: list = []
    for node in nodes:
        if node[0] == "e":
            node = ["e", node[1], _folded(node[2])]
        if out and _name(out[-1]) == _name(node):
            out[-1] = ["+", [_joined(_body(out[-1])[0], _body(node)[0])]]
        else:
            out.append(node)
    return out


def _joined(a: list, b: list) -> list:
    """One node that fits what either fits; both have one name."""
    marks = {x[0] for x in (a, b)} & set("?+")
    while a[0] in "?+":
        a = a[1][0]
    while b[0] in "?+":
        b = b[1][0]
    inner = ["#"] if a[0] == "#" else ["e", a[1], aligned(a[2], b[2])]
    for mark in ("+", "?"):
        if mark in marks:
            inner = [mark, [inner]]
    return inner


def aligned(a: list, b: list) -> list:
    """The wrapper of two wrappers: common nodes are joined, the others become optional."""
    if a == b:
        return a
    left, right = [_name(x) for x in a], [_name(x) for x in b]
    out: list = []
    for _, i, k, j, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if left[i:k] == right[j:m]:
            out += [_joined(x, y) for x, y in zip(a[i:k], b[j:m])]
        else:
            out += [x if x[0] == "?" else ["?", [x]] for x in a[i:k] + b[j:m]]
    folded: list = []  # an optional node beside one of its name repeats it
    for node in out:
        if folded and _name(folded[-1]) == _name(node):
            joined = _joined(folded[-1], node)
            folded[-1] = joined if "+" in (joined[0], joined[1][0][0] if joined[0] == "?" else "") else ["+", [joined]]
        else:
            folded.append(node)
    return folded


def as_text(nodes: list) -> str:
    out = []
    for node in nodes:
        if node[0] == "#":
            out.append("#")
        elif node[0] == "e":
            out.append(f"<{node[1]}>{as_text(node[2])}</{node[1]}>")
        else:
            out.append(f"({as_text(node[1])}){node[0]}")
    return "".join(out)


_PIECE = re.compile(r"</([^>]+)>|<([^>]+)>|(#)|(\()|\)([?+])")


def from_text(text: str) -> list:
    root: list = []
    stack = [root]
    for end, start, slot, opened, mark in _PIECE.findall(text):
        if slot:
            stack[-1].append(["#"])
        elif start:
            node = ["e", start, []]
            stack[-1].append(node)
            stack.append(node[2])
        elif opened:
            group: list = ["(", []]
            stack[-1].append(group)
            stack.append(group[1])
        elif mark:
            stack.pop()
            stack[-1][-1][0] = mark
        else:
            stack.pop()
    return root


def slots(nodes: list, path: str = "") -> list[str]:
    """The paths of a wrapper's text slots, in order and each once."""
    out: list[str] = []
    for node in nodes:
        if node[0] == "#":
            out.append(path)
        elif node[0] == "e":
            out += slots(node[2], f"{path}/{node[1]}" if path else node[1])
        else:
            out += slots(node[1], path)
    return list(dict.fromkeys(out))


def _in_article(path: str) -> bool:
    names = path.split("/")
    first = next((k for k, x in enumerate(names) if x in ARTICLE), -1)
    return first >= 0 and not any("!" in x for x in names)


def region_of(path: str) -> str:
    """The innermost element around a text that is no part of running text itself."""
    names = path.split("/")
    while len(names) > 1 and names[-1] in RUNNING:
        names.pop()
    return "/".join(names)


def main_slots(wrapper: str, measured: dict[str, tuple[int, int]]) -> list[str]:
    """The slots of the article. `measured`: letters and letters in links of what the pages do not repeat."""
    paths = slots(from_text(wrapper))
    inside = [p for p in paths if _in_article(p)]
    if inside:
        return inside
    running = {p: measured[p][0] - 2 * measured[p][1] for p in paths if "!" not in p and p in measured}
    regions: dict[str, int] = {}
    for path, letters in running.items():  # ties go to the first name
        region = region_of(path)
        regions[region] = regions.get(region, 0) + max(0, letters)
    if not regions:
        return []
    best = min(regions, key=lambda r: (-regions[r], r))
    return [p for p, letters in running.items() if letters >= 0 and (p == best or p.startswith(best + "/"))]


def layout_of(blocks: list[tuple[str, str, int]]) -> tuple[int, list[tuple[str, str, int]]]:
    """The layout of a page, and the blocks among which its article is."""
    inside = [x for x in blocks if _in_article(x[0])]
    if inside:
        return TAGGED, inside
    open_blocks = [x for x in blocks if "!" not in x[0]]
    return hash_of("\n".join(sorted({region_of(x[0]) for x in open_blocks}))) or 1, open_blocks


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches, 256):
        out = []
        for source in batch["html"].tolist():
            page = Page(source)
            layout, blocks = layout_of(page.blocks)
            out.append((layout, as_text(_tree(page.stream)), *([x[k] for x in blocks] for k in range(3))))
        frame = pd.DataFrame(out, columns=["layout", "wrapper", "paths", "texts", "linked"])
        for name in ("page_id", "url", "host"):
            frame.insert(0, name, batch[name].array)
        frame["page_id"] = frame["page_id"].astype("Int64")
        yield frame


PARSED = (
    "page_id long, url string, host string, layout long, wrapper string, paths array<string>, texts array<string>, linked array<long>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """Each row of `pages` (page_id, url, html) with its host, layout, stream (as a wrapper) and blocks; written."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", address(F.col("url"))[0].alias("host"), "html")
    return written(mapped(rows, _parsed, PARSED), "parsed-pages")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8")) >> 1


def _align_all(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Streams or wrappers of one layout (and share) -> their wrapper; the commonest come first."""
    rows = rows.sort_values(["n", "wrapper"], ascending=[False, True])
    wrapper: list | None = None
    for text in rows["wrapper"].drop_duplicates():
        nodes = from_text(text)
        wrapper = nodes if wrapper is None else aligned(wrapper, nodes)
    out = rows[keys].head(1).reset_index(drop=True)
    return out.assign(wrapper=as_text(wrapper or []), n=int(rows["n"].sum()))


def _aligned_hosts(streams: DataFrame, size: int = ALIGNED, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """(*keys, wrapper, n): streams are aligned in shares of about `size`, then the shares' wrappers, round by round."""
    named = list(keys)
    streams = streams.select(*named, "wrapper", "n")
    schema = streams.schema
    while True:
        shares = streams.groupBy(*named).agg(F.ceil(F.count("*") / size).alias("shares")).filter("shares > 1")
        shares = written(shares, "shares")
        share = F.pmod(F.xxhash64("wrapper"), F.coalesce("shares", F.lit(1)))
        dealt = streams.join(shares, named, "left").withColumn("share", share).groupBy(*named, "share")
        streams = written(dealt.applyInPandas(lambda rows: _align_all(rows, named), schema), "wrappers")
        if shares.isEmpty():
            return streams


def _measured(pages: DataFrame) -> DataFrame:
    """(host, layout, slots, copied) of the layouts without article elements; equal pages count once.

    `slots` has letters and linked letters of each path, `copied` the hashes of the texts that nearly all pages repeat.
    Both are bounded by what stands on a page: a layout's paths are parts of its regions, and a copied text is on 90% of
    its pages.
    """
    key = ["host", "layout"]
    rows = pages.filter(F.col("layout") != TAGGED).withColumn("page", F.xxhash64("paths", "texts"))
    n_pages = rows.select(*key, "page").distinct().groupBy(*key).agg(F.count("*").alias("n_pages"))
    blocks = rows.select(*key, "page", F.explode(F.arrays_zip("paths", "texts", "linked")).alias("b")).select(
        *key, "page", F.col("b.paths").alias("path"), F.xxhash64("b.texts").alias("text"),
        F.char_length("b.texts").cast("long").alias("letters"), F.col("b.linked").alias("linked"),
    )
    blocks = blocks.groupBy(*key, "page", "path", "text").agg(F.max("letters").alias("letters"), F.max("linked").alias("linked"))
    texts = blocks.groupBy(*key, "path", "text").agg(
        F.count("*").alias("n"), F.sum("letters").alias("letters"), F.sum("linked").alias("linked")
    )
    texts = texts.join(written(n_pages, "layouts"), key)
    texts = texts.withColumn("copy", (F.col("n_pages") >= MIN_PAGES) & (F.col("n") >= COPIED * F.col("n_pages")))
    paths = texts.groupBy(*key, "path").agg(
        *[F.sum(F.when(~F.col("copy"), F.col(c)).otherwise(0)).alias(c) for c in ("letters", "linked")],
        F.collect_set(F.when(F.col("copy"), F.col("text"))).alias("copied"),
    )
    return paths.groupBy(*key).agg(
        F.collect_list(F.struct("path", "letters", "linked")).alias("slots"),
        F.array_distinct(F.flatten(F.collect_list("copied"))).alias("copied"),
    )


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, wrapper, n, article slots, copied texts) from `parsed` pages."""
    let_workers_import(pages.sparkSession)
    key = ["host", "layout"]
    streams = pages.groupBy(*key, "wrapper").agg(F.count("*").alias("n"))
    whole = _aligned_hosts(written(streams, "streams"), keys=("host", "layout"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{s["path"]: (s["letters"], s["linked"]) for s in (x if x is not None else [])} for x in batch["slots"]]
            out = batch.drop(columns="slots")
            out["article"] = [main_slots(w, m) for w, m in zip(batch["wrapper"], found)]
            yield out[["host", "layout", "wrapper", "n", "article", "copied"]]

    schema = "host string, layout long, wrapper string, n long, article array<string>, copied array<long>"
    joined = whole.join(written(_measured(pages), "measured-slots"), key, "left")
    return written(mapped(joined, choose, schema), "article-slots")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text (empty if none), n_chars.

    A null page is empty; a page without an address belongs to the empty host. Every page of a layout helped to make
    its wrapper, so each of its texts has a slot there. Repeated rows get equal results; an empty table gives no rows.
    Only page_id, url and html are read, so other columns cannot clash.
    """
    rows = parsed(pages)
    chosen = wrappers(rows).select("host", "layout", "article", "copied")
    # Wrappers are one row per layout; Spark broadcasts them if they are small enough and splits a hot host if not.
    joined = rows.join(chosen, ["host", "layout"], "left")
    copied = F.coalesce("copied", F.array().cast("array<long>"))
    blocks = F.filter(
        F.arrays_zip("paths", "texts"),
        lambda b: F.array_contains("article", b["paths"])
        & ((F.size(copied) == 0) | ~F.array_contains(copied, F.xxhash64(b["texts"]))),
    )
    text = F.concat_ws("\n", F.transform(blocks, lambda b: b["texts"]))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
