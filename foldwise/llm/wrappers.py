"""Main text of web pages by wrappers inferred from the pages of a host.

A page is a stream of tokens: the elements around its blocks of text (with class,
id and role), and a slot for each text, told apart by whether all of it is a
link. Streams of a host are aligned one after the other with what the host's
wrapper is so far. A wrapper is a union-free regular expression: tags, text
slots, optional groups and repeated groups. Where stream and wrapper differ, the
difference becomes an optional group; where a group is beside an equal one, a
repeated group.

Inference covers every page. Streams are folded in the map tasks (neighbouring
equal groups become one repeated group) and counted, so a host gives its distinct
folded streams only. They are merged in rounds, about ``FAN_IN`` to a group, until
a host has one wrapper: a host with a third of all pages is many small tasks.

A page's block is matched to its slot by the elements around it, which the
wrapper keeps. Three things follow from wrappers and slots:

* a repeated group that holds nothing but links is a menu;
* a text that nine in ten distinct contents of a host (two at least: one alone
  cannot be aligned) repeat at its slot belongs to the wrapper, not to the page,
  if the elements around it have a class, id or role: templates name their parts;
* an element whose class has a telling word among others (``related-work``) is
  left out only if its slots are menus or its text is the wrapper's.

The article are the blocks inside ``article`` or ``main`` if the page has text
there, else all that are neither menus nor text of the wrapper; and never those
inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments, told by tag, role, or a class or id made of such words only. Inside
``article`` and ``main`` the wrapper alone drops nothing. Outside, a text of the
wrapper stays if text of the page stands in the element around it (for ``body``:
directly in it), as a standing heading does, or if a page has nothing else.
Copies of a page count once.

The text of a block (paragraph, heading, list item, cell, ...) has white space
as single spaces; blocks are joined by an empty line. A null html is empty and
has empty text. Pages without a host in their url form a host of their own.
Broken markup is read as far as it goes: a tag without its end closes with its
parent, text outside tags counts. Rows are read one by one, so repeated rows
are only counted as pages of their host.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stored

# Streams that a task aligns with each other, about.
FAN_IN = 16
# Wrappers are broadcast up to so many characters in all, else joined by shuffle.
BROADCAST_CHARS = 32 << 20
# Elements and paths whose readings a worker keeps.
CACHED = 50_000
# A text of the wrapper: by so much of at least so many distinct contents of a host.
CONSTANT_SHARE, ALIGNED = 0.9, 2

# The sets of elements that HTML defines.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "td", "th", "tr", "tbody",
                       "thead", "tfoot", "summary", "figcaption"}
# An element that ends an open one of the same kind beside it, up to its container.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}),
             "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
             "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead"}),
             "option": ({"option"}, {"select"})}
_SKIPPED = frozenset(
    "nav aside footer form head button select input label menu dialog object audio video canvas "
    .split()) | frozenset(_RAW)
_SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar "
    "toolbar".split())
_SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer "
    "masthead topbar comment comments disqus replies respond notice notices cookie cookies "
    "consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "share sharing social related recommended widget toolbar pagination pager hidden".split())
_HEADERS = frozenset(("header", "pageheader", "siteheader"))
# Words that say where or how, not what: a class of these and telling words tells.
_NEUTRAL = frozenset(
    "area article articles bar block body bottom box btn button buttons center col column container "
    "content count feed fixed float footer form global group head header icon icons inner item items "
    "left link links list main media message module msg outer page panel post posts primary right row "
    "secondary section site slot sticky tag text thread title top unit wrap wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'])(class|id|role|hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
    r"(?=[\s\"'/]|$)", re.I | re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
# Slots: text, and text that is a link as a whole.
TEXT, LINK = "#", "@"
_SLOTS = (TEXT, LINK)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes): kind is ``<``, ``>`` or ``#``."""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            yield TEXT, page[at:], ""
            return
        if m.start() > at:
            yield TEXT, page[at:m.start()], ""
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            yield ">", tag, ""
            continue
        attrs = m["attrs"]
        yield "<", tag, attrs
        if tag in _VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW_END:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
            yield ">", tag, ""


@lru_cache(maxsize=CACHED)
def label(tag: str, attrs: str) -> str:
    """The tag with its class, id and role; digits in them don't tell pages apart."""
    parts = [tag]
    for name, value in _ATTRIBUTE.findall(attrs) if attrs.strip() else ():
        value = re.sub(r"\d+", "0", " ".join(value.strip("\"'").split()))
        parts.append(f"{name.lower()}={value}")
    return " ".join(parts)


@lru_cache(maxsize=CACHED)
def telling(label_: str, inside: bool) -> int:
    """2 if an element is no part of an article, 1 if a word of its class or id says so among
    others that don't, else 0; ``inside``: an article is around it."""
    tag, _, rest = label_.partition(" ")
    if tag in _SKIPPED or tag == "header" and not inside:
        return 2
    if tag in ("html", "body", "article", "main"):
        return 0  # their classes tell what the page has, not what they are
    most = 0
    for name, value in re.findall(r"(class|id|role|hidden)(?:=(.*?))?(?= class| id| role|"
                                  r" hidden| itemprop|$)", rest):
        if name == "hidden" or name == "role" and value.lower() in _SKIPPED_ROLES:
            return 2
        for word in value.split():
            parts = {p.lower() for p in _WORD.findall(word)}
            joined = re.sub(r"[^a-z]", "", word.lower())
            if joined in _SKIPPED_WORDS | _HEADERS:
                return 2
            if parts & _SKIPPED_WORDS:
                if not parts - _SKIPPED_WORDS - _NEUTRAL:
                    return 2
                most = 1
    return most


def _is_article(label_: str) -> bool:
    return (label_.split(" ", 1)[0] in ("article", "main") or "role=main" in label_
            or "itemprop=articleBody" in label_)


def tag_of(entry: str) -> str:
    return entry.split(" ", 1)[0]


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """(path, text, whether all of it is a link) of each block in page order; a block ends
    where a block tag stands."""
    stack: list[str] = []
    text: list[str] = []
    linked: list[bool] = []
    path: tuple[str, ...] = ()

    def flush() -> Iterator[tuple[tuple[str, ...], str, bool]]:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            yield path, joined, all(own for own, piece in zip(linked, text) if piece.strip())
        text.clear()
        linked.clear()

    for kind, name, attrs in tokens(page):
        if kind == TEXT:
            own = tuple(stack)
            if own != path and text and (_cut(own) != _cut(path)):
                yield from flush()
            if not text:
                path = own
            text.append(name)
            linked.append(_in_link(own))
            continue
        if kind == "<" and name == "br":
            text.append(" ")
            linked.append(False)
            continue
        if name in _BLOCKS:
            yield from flush()
        if kind == "<":
            if name in _VOID:
                continue
            if name in _CLOSES_P:
                # A paragraph ends before a block, with what is open inside it.
                for k in range(len(stack) - 1, -1, -1):
                    if tag_of(stack[k]) == "p":
                        del stack[k:]
                        break
                    if tag_of(stack[k]) in _BLOCKS:
                        break
            if name in _SIBLINGS:
                same, container = _SIBLINGS[name]
                for k in range(len(stack) - 1, -1, -1):
                    if tag_of(stack[k]) in same:
                        del stack[k:]
                        break
                    if tag_of(stack[k]) in container:
                        break
            stack.append(label(name, attrs))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if tag_of(stack[k]) == name:
                    del stack[k:]
                    break
    yield from flush()


@lru_cache(maxsize=CACHED)
def _in_link(path: tuple[str, ...]) -> bool:
    return "a" in map(tag_of, path)


@lru_cache(maxsize=CACHED)
def _cut(path: tuple[str, ...]) -> tuple[str, ...]:
    """The part of a path that a piece of text must share with its block: where it is skipped."""
    return tuple(p for p in path if p.split(" ", 1)[0] in _SKIPPED or " " in p)


# Wrappers: a list of items; an item is a token (text) or [sign, items], sign "?" or "+".

def folded(items: list) -> list:
    """Neighbouring equal groups become one repeated group, shortest groups first."""
    changed = True
    while changed:
        changed = False
        size = 0
        while 2 * (size := size + 1) <= len(items):
            out: list = []
            k = 0
            while k < len(items):
                group = items[k:k + size]
                n = 1
                while len(group) == size and items[k + n * size:k + (n + 1) * size] == group:
                    n += 1
                last = out[-1] if out else None
                if n > 1 and not _balanced(group):
                    n = 1
                if n > 1 and not (size == 1 and group[0] == TEXT):
                    inner = group[0][1] if size == 1 and isinstance(group[0], list) \
                        and group[0][0] == "+" else group
                    out.append(["+", inner])
                    k += n * size
                    changed = True
                elif n > 1:
                    out.append(TEXT)
                    k += n
                    changed = True
                elif isinstance(last, list) and last[0] == "+" and last[1] == group:
                    k += size
                    changed = True
                else:
                    out.append(items[k])
                    k += 1
            items = out
    return items


def _balanced(group: list) -> bool:
    """Whether every element of a group opens and ends in it."""
    depth = 0
    for item in group:
        if not isinstance(item, list):
            depth += (item[0] == "<") - (item[0] == ">")
            if depth < 0:
                return False
    return depth == 0


def aligned(a: list, b: list) -> list:
    """One wrapper for all that match a or b: a longest common subsequence, rest optional."""
    if a == b:
        return a
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = (rows[i + 1][j + 1] + 1 if _meets(a[i], b[j])
                          else max(rows[i + 1][j], rows[i][j + 1]))
    out: list = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and _meets(a[i], b[j]):
            out.append(_met(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        left: list = []
        right: list = []
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and _meets(a[i], b[j]):
                break
            if j >= len(b) or i < len(a) and rows[i + 1][j] >= rows[i][j + 1]:
                left.append(a[i])
                i += 1
            else:
                right.append(b[j])
                j += 1
        out += [_optional(x) for x in (left, right) if x]
    return folded(out)


def _optional(items: list) -> list:
    if len(items) == 1 and isinstance(items[0], list) and items[0][0] == "?":
        return items[0]
    return ["?", items]


def _meets(x: object, y: object) -> bool:
    """Whether two items are one: equal, slots, or groups around the same items."""
    return x == y or _body(x) == _body(y) or x in _SLOTS and y in _SLOTS


def _body(x: object) -> list:
    return x[1] if isinstance(x, list) else [x]


def _met(x: object, y: object) -> object:
    if x == y:
        return x
    if x in _SLOTS and y in _SLOTS:
        return TEXT
    signs = {v[0] if isinstance(v, list) else "" for v in (x, y)}
    body = _body(x)
    if "?" in signs:
        return ["?", [["+", body]] if "+" in signs else body]
    return ["+", body]


@lru_cache(maxsize=CACHED)
def address(path: tuple[str, ...]) -> tuple[str, ...]:
    """The elements around a block that tell its slot: block elements, and those with a class."""
    return tuple(p for p in path if " " in p or p in _BLOCKS)


def stream(page: str) -> list:
    """The folded stream of a page: elements around its blocks as they open and end, and slots."""
    out: list = []
    open_: tuple[str, ...] = ()
    for path, _, linked in blocks(page):
        path = address(path)
        same = 0
        while same < min(len(open_), len(path)) and open_[same] == path[same]:
            same += 1
        if out and path == open_ and path:
            same -= 1  # the next element of the same kind
        out += [f">{tag_of(p)}" for p in open_[same:][::-1]]
        out += [f"<{p}" for p in path[same:]]
        out.append(LINK if linked else TEXT)
        open_ = path
    return folded(out + [f">{tag_of(p)}" for p in open_[::-1]])


def menus(wrapper: list) -> set[tuple[str, ...]]:
    """The addresses of slots in repeated groups that hold nothing but links."""
    found: set[tuple[str, ...]] = set()
    other: set[tuple[str, ...]] = set()
    open_: list[str] = []

    def walk(items: list, repeated: bool) -> None:
        for item in items:
            if isinstance(item, list):
                inner = [t for t in _flat(item[1]) if t in _SLOTS]
                walk(item[1], repeated or item[0] == "+" and bool(inner) and set(inner) == {LINK})
            elif item[0] == "<":
                open_.append(item[1:])
            elif item[0] == ">":
                if open_:
                    open_.pop()
            else:
                (found if repeated else other).add(tuple(open_))

    walk(wrapper, False)
    return found - other


def _flat(items: list) -> Iterator[str]:
    for item in items:
        if isinstance(item, list):
            yield from _flat(item[1])
        else:
            yield item


def has_article(wrapper: list) -> bool:
    return any(t[0] == "<" and _is_article(t[1:]) for t in _flat(wrapper))


@dataclass(frozen=True)
class Block:
    """A block that may be of the article, and what its page tells about it."""

    path: str
    text: str
    # An article is around it; its class has a telling word among others; it is in a menu.
    inside: bool
    doubtful: bool
    menu: bool

    @property
    def mark(self) -> int:
        return _mark(self.path, self.text)

    @property
    def named(self) -> bool:
        """Whether an element inside the body has a class, id or role, as a template gives."""
        return any(" " in p and tag_of(p) not in ("html", "body") for p in self.path.split("/"))


def _placed(page: str, known: "Known") -> list[Block]:
    """The blocks of the article, and all that may be of one if the page has none."""
    out: list[Block] = []
    other: list[Block] = []
    for path, text, _ in blocks(page):
        inside, least = False, 0
        for entry in path:
            least = max(least, telling(entry, inside))
            if least == 2:
                break
            inside = inside or _is_article(entry)
        if least < 2:
            own = Block("/".join(p.replace("/", "|") for p in path), text, inside, least == 1,
                        address(path) in known.menus)
            (out if inside or not known.article else other).append(own)
    return out or other


def main_blocks(page: str, article: bool) -> list[tuple[str, str]]:
    """(path, text) of the blocks of the article, if nothing is known of other pages."""
    return [(b.path, b.text) for b in _placed(page, Known(article, frozenset()))]


def chosen(own: list[Block], constant: set[int]) -> list[str]:
    """The texts that are the page's; one of the wrapper beside them in its element stays."""
    gone = []
    for b in own:
        wrapper = b.mark in constant
        if b.inside or b.doubtful:
            gone.append(b.doubtful and (wrapper or b.menu))
        else:
            gone.append(wrapper or b.menu)
    # Elements with other text directly in them, and with such text at any depth.
    direct: set[str] = set()
    around: set[str] = set()
    for b, is_gone in zip(own, gone):
        if not is_gone:
            above = b.path.rpartition("/")[0]
            direct.add(above)
            while above and above not in around:
                around.add(above)
                above = above.rpartition("/")[0]
    out = []
    for b, is_gone in zip(own, gone):
        above = b.path.rpartition("/")[0]
        top = above.rpartition("/")[2].split(" ", 1)[0] in ("", "html", "body")
        stays = not b.menu and not b.doubtful and above in (direct if top else around)
        if not is_gone or stays:
            out.append(b.text)
    return out or [b.text for b in own]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://"
                                    r"(?:[^/?#@]*@)?([^/?#:]+)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and its wrapper (JSON) over all its pages."""
    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(stream(p.as_py() or "")) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())],
                                             names=["host", "stream"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for text in sorted(rows["stream"], key=lambda s: (len(s), s)):
            own = json.loads(text)
            wrapper = own if wrapper is None else aligned(wrapper, own)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "stream": [json.dumps(wrapper)]})

    left = stored(pages.select("host", "html").mapInArrow(streams, "host string, stream string")
                  .distinct(), "streams")
    while True:
        counts = left.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return left.select("host", F.col("stream").alias("wrapper"))
        # A host's streams in groups of about FAN_IN, one group at last.
        groups = F.ceil(F.col("n") / FAN_IN)
        dealt = left.join(counts, "host").withColumn(
            "bucket", F.pmod(F.xxhash64("stream"), groups))
        left = stored(dealt.groupBy("host", "bucket").applyInPandas(
            merged, "host string, stream string").distinct(), "streams")


def _mark(path: str, text: str) -> int:
    """A 64-bit hash of a block."""
    digest = hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


@dataclass(frozen=True)
class Known:
    """What a host's wrapper tells: whether it has an article, and where its menus are."""

    article: bool
    menus: frozenset[tuple[str, ...]]

    @staticmethod
    def of(wrapper: str) -> "Known":
        items = json.loads(wrapper) or []
        return Known(has_article(items), frozenset(menus(items)))


def _cut_up(batch: pa.RecordBatch, seen: dict[str, Known]) -> Iterator[list[Block]]:
    """The blocks of each page that may be of its article, by its host's wrapper."""
    for page, wrapper in zip(batch.column("html"), batch.column("wrapper")):
        text = wrapper.as_py()
        if text not in seen:
            seen.clear()
            seen[text] = Known.of(text)
        yield _placed(page.as_py(), seen[text])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Known] = {}
    for batch in batches:
        found, contents = [], []
        for own in _cut_up(batch, seen):
            found.append(sorted({b.mark for b in own if b.named and (not b.inside or b.doubtful)}))
            contents.append(_mark("", "\0".join(f"{b.path}\0{b.text}" for b in own)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(contents, pa.int64()),
             pa.array(found, pa.list_(pa.int64()))], names=["host", "content", "marks"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Known] = {}
    for batch in batches:
        out = ["\n\n".join(chosen(own, set(constant.as_py() or ())))
               for own, constant in zip(_cut_up(batch, seen), batch.column("constant"))]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("page_id", "url", "host")], pa.array(out, pa.string())],
            names=["page_id", "url", "host", "text"])


def _by_host(facts: DataFrame, chars: Column) -> DataFrame:
    size = facts.agg(F.sum(chars)).first()[0] or 0
    return F.broadcast(facts) if size <= BROADCAST_CHARS else facts


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, host and the main text of every page.

    Pages are read and cut up again in each pass; only tags' streams, marks and
    wrappers are shuffled or stored.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                         host(F.col("url")).alias("host"))
    found = stored(wrappers(pages), "wrappers")
    known = _by_host(found, F.length("wrapper"))
    marks = pages.select("host", "html").join(known, "host").mapInArrow(
        _marks, "host string, content bigint, marks array<bigint>").distinct()
    # A null mark counts the content itself.
    spread = marks.select("host", F.explode(F.concat(
        "marks", F.array(F.lit(None).cast("bigint")))).alias("mark"))
    counts = stored(spread.groupBy("host", "mark").agg(F.count("*").alias("n"))
                    .where(F.col("n") >= ALIGNED), "page-marks")
    total = counts.where(F.col("mark").isNull()).select("host", F.col("n").alias("pages"))
    constant = (counts.where(F.col("mark").isNotNull()).join(total, "host")
                .where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
                .groupBy("host").agg(F.collect_set("mark").alias("constant")))
    facts = stored(found.join(constant, "host", "left"), "host-facts")
    size = F.length("wrapper") + 8 * F.coalesce(F.size("constant"), F.lit(0))
    schema = "page_id {}, url string, host string, text string".format(
        pages.schema["page_id"].dataType.simpleString())
    return pages.join(_by_host(facts, size), "host").mapInArrow(_texts, schema)
