"""Main text of web pages by equivalence classes of tokens.

A page is a sequence of tokens: tags and words, each in the role that its path of open elements
gives it. Over the pages of a site (a host with ``SITE_PAGES`` pages and more; the pages of all
smaller hosts together are one more site) tokens with the same occurrence vector, so often on this
page, so often on that, form a class. A class is valid if its tokens stand in one order on its pages
(repeated as a whole), and always in the same gap of the class around it. The valid classes, nested,
are the template; the gaps are its slots. Words of the template are boilerplate, slots that are
mostly links are menus, and what the markup names as navigation, advert, form and the like is left
out; of the rest, the blocks in the article (else in the main element, else all) are the text.

Scale: occurrence vectors are never built. A vector is the sum over pages of a hash of (page,
count), so a site of any number of pages is one pre-aggregated sum a token. Only tokens on at least
``SHARE`` of a site's pages can be of the template; such a token has that share in at least one
task that reads pages, so tokens below the share in every task are never shuffled, and none is lost.
The html is read once; tags and blocks are staged. Templates are joined to pages by site: broadcast
below a counted size.

Contract: a row per page, repeated rows and null ids included; a null html is empty, a null url is
the host ''. Whole pages are read. Text between block elements is one block; its white space
(``br`` included) is one space, character references are decoded, empty blocks are left out.
Unclosed and stray tags are read as browsers do for paragraphs, lists and tables; a cut-off page is
read up to its end. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orthoflow.llm.common import SPACED, Words, list_array, mix, prepare, small, stage, string_buffer

#: pages that a host needs for a template of its own, and any template
SITE_PAGES = 8
#: share of a site's pages on which a token of the template stands, and on which a class keeps its order and place
SHARE, STEADY = 0.5, 0.9
#: html bytes of the pages that are worked on at once
BLOCK_BYTES = 8 << 20

# --- elements ------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: content that is no markup and no text of the page
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
CHROME = frozenset("head nav footer aside form menu dialog search button select noscript svg canvas audio video object template map datalist fieldset".split())
#: names in class, id and role that mark what is around an article
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs topbar masthead "
    "footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments respond replies disqus related recommended recommendations trending search pagination pager toolbar copyright "
    "complementary contentinfo banner form hidden".split()
)
#: whole names of the element that holds the article
ARTICLE_NAMES = frozenset("article article-body article-content articlebody entry-content post-content post-body story-body story-content".split())
MAIN_NAMES = frozenset("main main-content content-main".split())
#: what an opening element closes: elements at the top of the open ones
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "option": ("option",), "body": ("head",),
}

_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"""
    r"""|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*'|)|["'])*+(?:>|\Z)))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(maxsize=1 << 16)
def _role(parent: int, label: str) -> int:
    """Token of a label under a path."""
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "replace"), digest_size=8).digest(), "little")


@lru_cache(maxsize=1 << 14)
def _marks(name: str, attributes: str) -> tuple[str, bool, bool, int, bool]:
    """(label, names something around an article, is a header, level: 2 article 1 main 0 neither, is a
    link)."""
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    named = [found.get(k, "") for k in ("class", "id", "role", "itemprop")]
    words = {w for text in named for w in _NAME.findall(_CAMEL.sub(" ", text).lower())}
    whole = {w.lower() for text in named for w in text.split()}
    level = 2 if name == "article" or whole & ARTICLE_NAMES else 1 if name == "main" or whole & MAIN_NAMES else 0
    chrome = name in CHROME or (name not in ("html", "body", "main") and bool(words & CHROME_NAMES))
    if level == 2 and not words & {"comment", "comments", "sidebar", "related", "widget", "ad", "promo"}:
        chrome = False
    chrome = chrome or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    header = name == "header" or ("header" in words and not words & {"article", "entry", "post", "story", "content", "main"})
    return f"{name}.{found.get('class', '').lower()}", chrome, header, level, name == "a" and "href" in found


class Page:
    """Tags and blocks of a page, read in one pass: the tokens of the tags, before which block each tag
    stands, and of each block its text, level, characters inside links and path. Blocks inside of what
    the markup names as something around an article are left out."""

    __slots__ = ("tags", "tag_at", "texts", "levels", "links", "paths")

    def __init__(self, html: str):
        self.tags: list[int] = []
        self.tag_at: list[int] = []
        self.texts: list[str] = []
        self.levels: list[int] = []
        self.links: list[int] = []
        self.paths: list[int] = []
        stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # name, chrome, level, path
        parts: list[str] = []  # of the block at hand
        link = linked = 0  # height of the open elements when a link began; characters in links
        at, size = 0, len(html)
        tags, tag_at, texts, match, find = self.tags, self.tag_at, self.texts, _MARKUP.match, html.find

        def end_block() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                texts.append(text)
                self.links.append(min(linked, len(text)))
                self.levels.append(held[0])
                self.paths.append(held[1])
            linked = 0

        held = (0, 0)
        while at < size:
            begin = find("<", at)
            found = match(html, begin) if begin >= 0 else None
            while begin >= 0 and not found:  # a sign, not a tag
                begin = find("<", begin + 1)
                found = match(html, begin) if begin >= 0 else None
            if begin < 0:
                begin = size
            if begin > at and not stack[-1][1]:
                text = html[at:begin]
                if "&" in text:
                    text = html_module.unescape(text)
                if not parts:
                    held = stack[-1][2:]
                parts.append(text)
                if link:
                    linked += len(text.strip())
            if not found:
                break
            at = found.end()
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if found.group(1):  # an end tag
                if name == "a":
                    link = 0
                if name in BLOCK and parts:
                    end_block()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                if link > len(stack):
                    link = 0
                tags.append(_role(stack[-1][3], f"/{name}"))
                tag_at.append(len(texts))
                continue
            label, chrome, header, level, is_link = _marks(name, found.group(3))
            if name in BLOCK:
                if parts:
                    end_block()
                top = stack[-1][0]
                if top == "p" or (top == "head" and name != "noscript"):
                    stack.pop()
            for closed in _CLOSES.get(name, ()):
                if stack[-1][0] == closed:
                    stack.pop()
            if link > len(stack):
                link = 0
            _, chrome_before, level_before, path = stack[-1]
            token = _role(path, label)
            tags.append(token)
            tag_at.append(len(texts))
            chrome = chrome or (header and not level_before)  # an article's own header holds its title
            if name == "br" and parts:
                parts.append(" ")
            if is_link:
                link = len(stack)
            if name in RAW:
                end = _raw_end(name).search(html, at)
                at = end.start() if end else size
            elif name not in VOID and (name in BLOCK or chrome):
                stack.append((name, chrome or chrome_before, max(level, level_before), token))
        if parts:
            end_block()


@lru_cache(maxsize=None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])", re.I)


_PAGE_FIELDS = "tags array<bigint>, tag_at array<int>, texts array<string>, levels array<tinyint>, links array<int>, paths array<bigint>"


def _lists(rows: list[list], kind: pa.DataType, unsigned: bool = False) -> pa.Array:
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = [x for r in rows for x in r]
    values = pa.array(np.array(flat, np.uint64).view(np.int64)) if unsigned else pa.array(flat, kind)
    return list_array(values, lengths)


def page_columns(pages: list[Page]) -> list[pa.Array]:
    """The columns ``_PAGE_FIELDS`` of pages."""
    return [
        _lists([p.tags for p in pages], pa.int64(), True), _lists([p.tag_at for p in pages], pa.int32()), _lists([p.texts for p in pages], pa.string()),
        _lists([p.levels for p in pages], pa.int8()), _lists([p.links for p in pages], pa.int32()), _lists([p.paths for p in pages], pa.int64(), True),
    ]


class Tokens:
    """Tokens of a run of pages in order: token, its block (-1 for a tag), and where pages begin. Blocks
    are numbered over the run; ``first_block`` is where those of each page begin."""

    def __init__(self, tags: pa.ListArray, tag_at: pa.ListArray, texts: pa.ListArray, paths: pa.ListArray):
        rows = len(tags)
        each = lambda lists: np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))))
        flat = lambda lists: np.asarray(lists.flatten())
        first_tag, self.first_block = each(tags), each(texts)
        self.texts = texts.flatten()
        words = Words(*string_buffer(self.texts), SPACED, False)
        block_of_word = words.row_of()
        path = flat(paths).astype(np.int64).view(np.uint64)
        # a tag stands before the block of its number, a block's words behind the tags before it
        tag_block = flat(tag_at).astype(np.int64) + np.repeat(self.first_block[:-1], np.diff(first_tag))
        tag_place = np.arange(len(tag_block)) + words.first[tag_block]
        word_place = np.arange(len(block_of_word)) + np.searchsorted(tag_block, block_of_word, side="right")
        size = len(tag_place) + len(word_place)
        self.token, self.block = np.empty(size, np.int64), np.full(size, -1)
        # tags have even tokens, words odd ones
        self.token[tag_place] = flat(tags) & -2
        self.token[word_place] = mix(words.hashes() ^ mix(path)[block_of_word]).view(np.int64) | 1
        self.block[word_place] = block_of_word
        self.first = first_tag + words.first[self.first_block]
        self.page = np.repeat(np.arange(rows), np.diff(self.first))


# --- sites ---------------------------------------------------------------------------------


def with_site(pages: DataFrame) -> DataFrame:
    """page_id, url, html and site: the host where it has pages enough, else ''."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    hosts = stage(rows.groupBy("host").count().filter(F.col("count") >= SITE_PAGES).select(F.col("host").alias("site")), "html-hosts")
    return rows.join(small(hosts, 64), F.col("host") == F.col("site"), "left").select("page_id", "url", "html", F.coalesce("site", F.lit("")).alias("site"))


def _read_pages(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pages to their tags and blocks; at the end, in rows without a page, the tokens that stand on at
    least ``SHARE`` (words: ``STEADY``, as only steady words are of use) of a site's pages in this task.

    A token with that share over all tasks has it in one of them, so no other can be of a template.
    """
    sites: dict[str, int] = {}
    pages_of: list[int] = []
    counts = _Counts()
    for whole in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(whole.column("html"))).astype(np.int64))
        lo = 0
        while lo < whole.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES, side="right")))
            batch = whole.slice(lo, hi - lo)
            lo = hi
            columns = page_columns([Page(text) for text in batch.column("html").to_pylist()])
            tokens = Tokens(columns[0], columns[1], columns[2], columns[5])
            site = np.array([sites.setdefault(s, len(sites)) for s in batch.column("site").to_pylist()], np.int64)
            pages_of += [0] * (len(sites) - len(pages_of))
            for s, n in zip(*np.unique(site, return_counts=True), strict=True):
                pages_of[s] += int(n)
            (page, token), _, _ = _pairs(tokens.page, tokens.token)
            (number, token), _, many = _pairs(site[page], token)
            counts.add(number, token, many)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("site"), batch.column("page_key"), *columns, pa.nulls(len(batch), pa.list_(pa.int64()))], schema=schema)
    number, token, many = counts.total()
    often = many >= np.where(token & 1, STEADY, SHARE) * np.array(pages_of, np.float64)[number] if len(number) else np.zeros(0, bool)
    out = [{"site": name, "frequent": token[often & (number == i)].tolist()} for name, i in sites.items()]
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


class _Counts:
    """Pages per (site, token), summed as they come; distinct ones are held once."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = self.least = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > max(1 << 20, 2 * self.least):
            self.parts = [self.total()]
            self.held = self.least = len(self.parts[0][0])

    def total(self) -> tuple:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        *keys, many = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        keys, where, _ = _pairs(*keys)
        return (*keys, np.bincount(where, weights=many, minlength=len(keys[0])).astype(np.int64))


def read_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed pages with their sites, candidate tokens per site), from one pass over the html."""
    rows = with_site(pages).withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = f"page_id {kinds['page_id']}, url {kinds['url']}, site string, page_key bigint, {_PAGE_FIELDS}, frequent array<bigint>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    read = stage(rows.mapInArrow(lambda batches: _read_pages(batches, schema), ddl), "html-pages")
    tokens = read.filter("frequent is not null").select("site", F.explode("frequent").alias("token")).distinct()
    return read.filter("frequent is null").drop("frequent"), stage(tokens.groupBy("site").agg(F.collect_list("token").alias("tokens")), "html-frequent")


def _runs(batches: Iterator[pa.RecordBatch], *facts: str) -> Iterator[tuple[pa.RecordBatch, list[str], dict, Tokens]]:
    """Runs of parsed pages: (rows, their sites, what each site's columns ``facts`` say, tokens)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            batch = whole.slice(lo, 2048)
            sites = batch.column("site").to_pylist()
            known = {}
            for i, s in enumerate(sites):
                if s not in known:
                    known[s] = [batch.column(f)[i].as_py() for f in facts]
            yield batch, sites, known, Tokens(*(batch.column(c) for c in ("tags", "tag_at", "texts", "paths")))


def _numbered(sites: list[str]) -> tuple[list[str], np.ndarray]:
    names = list(dict.fromkeys(sites))
    number = {s: i for i, s in enumerate(names)}
    return names, np.array([number[s] for s in sites], np.int64)


def _pairs(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct rows as columns, row number of each input, counts)."""
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])
    number = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = number
    return [c[new] for c in sorted_], inverse, np.bincount(number, minlength=int(new.sum()))


def _lanes(page: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 31-bit hashes of (page, count): their sums over pages stand for an occurrence vector, and
    stay in the range of a long for 2^32 pages."""
    h = mix(page.view(np.uint64) + mix(count.astype(np.uint64)))
    return (h >> np.uint64(33)).astype(np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.int64)


_VECTORS = "site string, token long, pages long, total long, a long, b long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the occurrence vectors of candidate tokens."""
    for batch, sites, known, tokens in _runs(batches, "tokens"):
        names, site_of = _numbered(sites)
        key = np.asarray(batch.column("page_key"))
        lists = [np.array(known[name][0] or [], np.int64) for name in names]
        site_key = mix(np.arange(len(names), dtype=np.uint64))
        ours = np.concatenate(lists).view(np.uint64) ^ np.repeat(site_key, [len(x) for x in lists])
        wanted = np.isin(tokens.token.view(np.uint64) ^ site_key[site_of[tokens.page]], ours)
        (page, token), _, count = _pairs(tokens.page[wanted], tokens.token[wanted])
        a, b = _lanes(key[page], count)
        (site, token), where, pages = _pairs(site_of[page], token)
        sums = []
        for part in (count, a, b):
            total = np.zeros(len(site), np.int64)
            np.add.at(total, where, part)
            sums.append(pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(site)), pa.array(token), pa.array(pages.astype(np.int64)), *sums], ["site", "token", "pages", "total", "a", "b"])


# --- classes on a page ---------------------------------------------------------------------


class Classes:
    """Classes of a site: of each token its class and, once known, its rank in the class."""

    def __init__(self, classes: list[dict]):
        self.size = np.array([len(c["tokens"]) for c in classes], np.int64)
        self.ids = [c["cls"] for c in classes]
        self.steady = np.array([bool(c.get("steady")) for c in classes], bool)
        token = np.array([t for c in classes for t in c["tokens"]], np.int64)
        order = np.argsort(token, kind="stable")
        self.token = token[order]
        self.cls = np.repeat(np.arange(len(classes)), self.size)[order]
        self.rank = np.concatenate([np.arange(n) for n in self.size])[order] if len(classes) else np.empty(0, np.int64)

    def on(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, rank) of the tokens of a page; -1 for others."""
        if not len(self.token):
            return np.full(len(tokens), -1), np.full(len(tokens), -1)
        i = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        hit = self.token[i] == tokens
        return np.where(hit, self.cls[i], -1), np.where(hit, self.rank[i], -1)


def _spans(cls: np.ndarray, rank: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, places as one row per occurrence, ranks likewise) of the classes on a page."""
    places = np.flatnonzero(cls >= 0)
    places = places[np.argsort(cls[places], kind="stable")]
    kinds, begin = np.unique(cls[places], return_index=True)
    for kind, at in zip(kinds, np.split(places, begin[1:]), strict=False):  # without places: one empty part
        if len(at) % size[kind] == 0:
            yield int(kind), at.reshape(-1, size[kind]), rank[at].reshape(-1, size[kind])


def _slots(length: int, spans: list[tuple[int, np.ndarray]], skip: int = -1) -> np.ndarray:
    """Innermost (class, gap) around each place, as class * 2^32 + gap; -1 outside of all."""
    slot = np.full(length, -1, np.int64)
    todo = [(int(row[-1] - row[0]), kind, row) for kind, at in spans if kind != skip for row in at]
    for _, kind, row in sorted(todo, key=lambda t: -t[0]):
        gap = np.zeros(row[-1] - row[0], np.int64)
        gap[row[:-1] - row[0]] = 1
        slot[row[0] : row[-1]] = (kind << 32) + np.cumsum(gap) - 1
    return slot


_VOTES = "site string, cls long, ranks array<int>, parent long, pages long"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class on each page: the order of its tokens (null: none that holds for all its
    occurrences) and the gap of the class around it (-2: several, or spans that cross)."""
    for _, sites, known, tokens in _runs(batches, "classes"):
        made = {s: Classes(known[s][0] or []) for s in known}
        patterns: dict[tuple, int] = {}  # how often the tokens of classes follow each other like this
        for i, site in enumerate(sites):
            classes = made[site]
            if len(classes.ids):
                cls, rank = classes.on(tokens.token[tokens.first[i] : tokens.first[i + 1]])
                told = cls >= 0
                key = (site, cls[told].tobytes(), rank[told].tobytes())
                patterns[key] = patterns.get(key, 0) + 1
        votes: dict[tuple, int] = {}
        for (site, cls, rank), many in patterns.items():
            for vote in _page_votes(made[site], np.frombuffer(cls, np.int64), np.frombuffer(rank, np.int64)):
                votes[site, *vote] = votes.get((site, *vote), 0) + many
        if votes:
            rows = [{"site": s, "cls": c, "ranks": None if r is None else list(r), "parent": p, "pages": n} for (s, c, r, p), n in votes.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("site", pa.string()), ("cls", pa.int64()), ("ranks", pa.list_(pa.int32())), ("parent", pa.int64()), ("pages", pa.int64())]))


def _page_votes(classes: Classes, cls: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, tuple | None, int]]:
    """(class, order of its tokens, gap around it) from the tokens of classes on a page."""
    found = list(_spans(cls, rank, classes.size))
    broken = set(np.unique(cls).tolist()) - {k for k, _, _ in found}
    good = []
    for kind, at, ranks in found:
        if (ranks == ranks[0]).all() and len(np.unique(ranks[0])) == len(ranks[0]):
            good.append((kind, at, tuple(ranks[0].tolist())))
        else:
            broken.add(kind)
    around = _slots(len(cls), [(k, at) for k, at, _ in good])
    for kind, at, ranks in good:
        # the gap around an occurrence shows just before its first token and at its last
        before = np.where(at[:, 0] > 0, around[at[:, 0] - 1], -1)
        behind = around[at[:, -1]]
        parent = np.unique(np.concatenate((before, behind)))
        gap = int(parent[0]) if len(parent) == 1 else -2
        if gap >= 0:
            gap = _gap_key(classes.ids[gap >> 32], gap & 0xFFFFFFFF)
        yield classes.ids[kind], ranks, gap
    for kind in broken:
        yield classes.ids[kind], None, -2


def _gap_key(cls: int, gap: int) -> int:
    """One number for a gap of a class, not negative."""
    return _role(cls, str(gap)) >> 1


# --- blocks --------------------------------------------------------------------------------


def _layout(classes: Classes, cls: np.ndarray, rank: np.ndarray) -> tuple[list, np.ndarray]:
    """Of the tokens of classes on a page: the slot from each of them to the next (None outside of all), and
    whether it is of a steady class in its order."""
    spans = [(k, at) for k, at, ranks in _spans(cls, rank, classes.size) if (ranks == np.arange(classes.size[k])).all()]
    fixed = np.zeros(len(cls), bool)
    for kind, at in spans:
        if classes.steady[kind]:
            fixed[at.ravel()] = True
    slots = _slots(len(cls), spans).tolist()
    return [None if s < 0 else _gap_key(classes.ids[s >> 32], s & 0xFFFFFFFF) for s in slots], fixed


def _page_blocks(tokens: Tokens, i: int, classes: Classes, known: dict) -> list[tuple[int, int | None, bool]]:
    """(block, slot or None, all its words are of the template) of a page, in order. ``known`` keeps the
    layouts of pages alike."""
    blocks = range(int(tokens.first_block[i]), int(tokens.first_block[i + 1]))
    if not len(classes.ids) or not blocks:
        return [(b, None, False) for b in blocks]
    lo, hi = tokens.first[i], tokens.first[i + 1]
    block = tokens.block[lo:hi]
    cls, rank = classes.on(tokens.token[lo:hi])
    told = np.flatnonzero(cls >= 0)
    cls, rank = cls[told], rank[told]
    key = (cls.tobytes(), rank.tobytes())
    if key not in known:
        known[key] = _layout(classes, cls, rank)
    slots, fixed = known[key]
    words = np.flatnonzero(block >= 0)
    begin = np.searchsorted(block[words], np.arange(blocks.start, blocks.stop))  # every block has words
    other = np.ones(len(block), np.int64)
    other[told[fixed]] = 0
    own = np.add.reduceat(other[words], begin).tolist()
    last = (np.searchsorted(told, words[begin], side="right") - 1).tolist()  # the class token at or before a block
    return [(b, slots[at] if at >= 0 else None, not many) for b, at, many in zip(blocks, last, own, strict=True)]


_SLOTS = "site string, slot long, characters long, links long, pages long"


def _block_facts(batch: pa.RecordBatch, tokens: Tokens) -> tuple[list, list, list]:
    """Level, characters inside links and characters of each block."""
    return (*(batch.column(c).flatten().to_pylist() for c in ("levels", "links")), pc.utf8_length(tokens.texts).to_pylist())


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters and characters of links in each slot; slot null: on how many pages the template
    leaves some text that is its own."""
    for batch, sites, known, tokens in _runs(batches, "classes"):
        made = {s: (Classes(known[s][0] or []), {}) for s in known}
        _, links, sizes = _block_facts(batch, tokens)
        sums: dict[tuple, list[int]] = {}
        for i, site in enumerate(sites):
            fresh = False
            for block, slot, fixed in _page_blocks(tokens, i, *made[site]):
                fresh = fresh or not fixed
                if slot is not None:
                    here = sums.setdefault((site, slot), [0, 0, 0])
                    here[0] += sizes[block]
                    here[1] += links[block]
            if fresh:
                sums.setdefault((site, None), [0, 0, 0])[2] += 1
        rows = [{"site": s, "slot": k, "characters": a, "links": b, "pages": n} for (s, k), (a, b, n) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("site", pa.string()), *[(c, pa.int64()) for c in ("slot", "characters", "links", "pages")]]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page."""
    for batch, sites, known, tokens in _runs(batches, "classes", "menus", "varies"):
        made = {s: (Classes(known[s][0] or []), {}) for s in known}
        menus = {s: set(known[s][1] or []) for s in known}
        levels, links, sizes = _block_facts(batch, tokens)
        texts = tokens.texts.to_pylist()
        out = []
        for i, site in enumerate(sites):
            found = _page_blocks(tokens, i, *made[site])
            level = max((levels[b] for b, _, _ in found), default=0)
            lines = []
            for block, slot, fixed in found:
                dense = slot in menus[site] if slot is not None else 2 * links[block] >= sizes[block]
                if not (levels[block] < level or (fixed and known[site][2]) or (not level and dense)):
                    lines.append(texts[block])
            out.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


# --- the operator --------------------------------------------------------------------------


def site_templates(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """site, n (pages), classes: the valid classes of each site, their tokens in order; steady ones
    stand on nearly all pages of a site that has enough of them. Both tables are those of
    ``read_pages``."""
    counts = stage(pages.groupBy("site").agg(F.count(F.lit(1)).alias("n")), "html-sites")
    told = pages.select("site", "page_key", "tags", "tag_at", "texts", "paths")
    parts = _joined(told, frequent, 4096).mapInArrow(_vectors, _VECTORS)
    vectors = parts.groupBy("site", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "a", "b")]).join(counts, "site")
    share = F.when(F.col("token").bitwiseAND(F.lit(1).cast("bigint")) == 1, STEADY).otherwise(SHARE)
    vectors = vectors.filter((F.col("n") >= SITE_PAGES) & (F.col("pages") >= share * F.col("n")))
    classes = vectors.groupBy("site", "n", "pages", "total", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("tokens")).filter(F.size("tokens") > 1)
    classes = stage(classes.select("site", "n", "pages", F.col("tokens")[0].alias("cls"), "tokens"), "html-classes")
    by_site = stage(classes.groupBy("site").agg(F.collect_list(F.struct("cls", "tokens")).alias("classes")), "html-classes")
    votes = _joined(told.drop("page_key"), by_site, 8192).mapInArrow(_votes, _VOTES)
    votes = votes.groupBy("site", "cls", "ranks", "parent").agg(F.sum("pages").alias("pages"))
    best = F.max(F.struct("pages", "parent", "ranks"))
    held = votes.groupBy("site", "cls").agg(best.alias("best"), F.sum("pages").alias("all"))
    held = held.filter((F.col("best.pages") >= STEADY * F.col("all")) & F.col("best.ranks").isNotNull() & (F.col("best.parent") != -2))
    valid = classes.join(held.select("site", "cls", F.col("best.ranks").alias("ranks")), ["site", "cls"])
    ordered = F.transform("ranks", lambda r: F.element_at("tokens", r + 1))
    one = F.struct("cls", ordered.alias("tokens"), (F.col("pages") >= STEADY * F.col("n")).alias("steady"))
    return stage(counts.join(valid.groupBy("site").agg(F.collect_list(one).alias("classes")), "site", "left"), "html-templates")


def _joined(pages: DataFrame, facts: DataFrame, row_bytes: int) -> DataFrame:
    return pages.join(small(facts, row_bytes), "site", "left")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    prepare(pages.sparkSession)
    rows, frequent = read_pages(pages)
    templates = site_templates(rows, frequent)
    told = rows.select("page_id", "url", "site", "tags", "tag_at", "texts", "levels", "links", "paths")
    sums = _joined(told.drop("page_id", "url"), templates.select("site", "classes"), 8192).mapInArrow(_slot_sums, _SLOTS)
    sums = stage(sums.groupBy("site", "slot").agg(*[F.sum(c).alias(c) for c in ("characters", "links", "pages")]), "html-slots")
    menus = sums.filter("slot is not null and 2 * links >= characters").groupBy("site").agg(F.collect_list("slot").alias("menus"))
    varied = sums.filter("slot is null").select("site", F.col("pages").alias("fresh"))
    facts = templates.join(menus, "site", "left").join(varied, "site", "left")
    facts = facts.select("site", "classes", "menus", (F.coalesce("fresh", F.lit(0)) >= SHARE * F.col("n")).alias("varies"))
    facts = stage(facts, "html-facts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _joined(told, facts, 8192).mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def text_report(texts: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
