"""HTML extraction by equivalence classes of template tokens.

A page is read into tokens: the path of each element it opens (tag, class, id
and role, from the root) and each block of text with its path. For the pages of
a host the occurrence vector of a token is its number in each page. Tokens are
never brought together page by page: a vector is kept as the exclusive or of a
hash of (page, number), with the number of pages and of occurrences, which is
summed up on the map side, so a host of any size is cheap.

Tokens of equal vectors are an equivalence class. The class that is once in every
page is the template's frame. Another class that is frequent enough is valid when
its elements all lie below one frame element, and is nested there. Frame and
nested elements are the template's elements; what they leave open are its slots.

A slot's text is what varies: the text below its element without that of other
frame elements in it and without text that the frame itself has. Tag, class, id
and role of template elements only label slots: menus, adverts, comments and the
like are no main text, an article or main element is. Where no element of the
template is labelled as main, the slot with the most text outside links is, with
its siblings in the widest frame element around it that holds no slot of the
other kind; lists of links in there are left out. So words as `social` or
`related` say nothing about an element of one page, only about one that the
pages of a host repeat.

From the main slots come all blocks; from a slot that was found by its text alone
those that are not template text (the same block in all of MANY pages or more). Elements that can only be boilerplate (scripts,
forms, adverts by name, reader comments) are left out on every page. Pages of
hosts with fewer than SUPPORT pages, and pages without any slot of their host's
template, are read by their own elements alone.

Defined results: null and empty html give empty text; a page without a host
shares a template with the others without one; unclosed and nested tags are
closed as browsers do, roughly; repeated rows get the same text; other columns
pass through whatever their names, but text_col is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, map_arrow

#: A token is frequent if this share of the host's pages has it; so a page of n tokens brings n / FREQUENT at most.
FREQUENT = 0.3
#: From so many pages on a host has a template, and text that all of them have outside named main elements is part of it.
SUPPORT, MANY = 3, 8
SALTS = 64
LINK_SHARE = 0.5
#: An element further down is known by its own mark and its ancestor in this depth; its text is read like any other.
DEEP = 128
#: Templates of all hosts are broadcast up to this size; beyond it only those of hosts with over 1/1000 of the pages.
BROADCAST_BYTES = 32 << 20

# How elements behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td
    tfoot th thead tr ul video audio""".split()
)
SCOPE = set("article aside blockquote body dd div dt fieldset figure footer form header html li main nav section table td th ul ol dl".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = SCOPE | {"p"} | set().union(*CLOSES.values())
# Elements, roles and words that are never main text, wherever they are.
NEVER = set("nav footer aside form button select option menu dialog svg template object canvas head noscript textarea label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NEVER_WORDS = set(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb
    breadcrumbs sidebar footer cookie cookies consent gdpr notice notices comments commentlist disqus newsletter pagination pager""".split()
)
# Words that say so only of elements that a host's pages repeat, and of heads outside the main text.
LABEL_WORDS = set(
    """promotion banner comment reply replies respond share sharing social related recommended subscribe subscription signup
    login popup modal overlay widget toolbar masthead skip""".split()
)
HEADS = {"header", "heading", "topbar", "top"}
# Words that may stand beside one of NEVER_WORDS in a name; a name with any other word (notice-of-motion) says nothing.
BESIDE = set(
    """box slot bar area block wrap wrapper container unit section list inner outer site page main left right bottom sticky
    global message policy link links post article user info text title panel group row item mini big small""".split()
)
MAIN = {"article", "main"}
MAIN_WORDS = set("article content post entry story maincontent articlebody postcontent entrycontent".split())
CONTAINERS = set("div section ul ol dl span table td".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_DIGITS = re.compile(r"\d+")
_MARKS = str.maketrans("/=", "__")


@dataclass(slots=True)
class _Element:
    tag: str
    path: str
    never: bool
    main: bool
    link: bool
    block: str


@dataclass(slots=True)
class Block:
    path: str
    text: str
    never: bool
    main: bool
    linked: int


def _words(value: str) -> set[str]:
    return set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))


def _says_never(names: list[str]) -> bool:
    """Whether a class or an id can only name boilerplate: with a word that says so, and no word that may say otherwise."""
    for name in names:
        words = {w for w in _words(name) if not w.isdigit()} - {""}
        if words & NEVER_WORDS and words <= NEVER_WORDS | LABEL_WORDS | HEADS | BESIDE:
            return True
    return False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


class Page:
    """Elements and blocks of one page, in order."""

    def __init__(self, source: str):
        self.elements: Counter[str] = Counter()
        self._paths: dict[str, str] = {}
        self.blocks: list[Block] = []
        self._text: list[str] = []
        self._linked = 0
        root = _Element("", "", False, False, False, "")
        self._stack = [root]
        # Open elements by tag, and the places of those at which the closing of others stops: no step looks through all that are open.
        self._opened: dict[str, int] = {}
        self._stops: list[int] = []
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                top = self._stack[-1]
                self.blocks.append(Block(top.block, text, top.never, top.main, self._linked))
            self._text.clear()
            self._linked = 0

    def _pop(self, to: int) -> None:
        opened, stops, block = self._opened, self._stops, False
        for e in self._stack[to:]:
            opened[e.tag] -= 1
            block = block or e.tag in BLOCK
        if block:
            self._flush()
        while stops and stops[-1] >= to:
            stops.pop()
        del self._stack[to:]

    def _open(self, tag: str, raw: str) -> None:
        stack = self._stack
        if tag == "br":
            self._text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            for i in reversed(self._stops):
                if stack[i].tag == "p" or stack[i].tag in CLOSES.get(tag, ()):
                    self._pop(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        top = stack[-1]
        named = _attributes(raw) if raw and not raw.isspace() else {}
        mark = tag
        for key, sign in (("class", "."), ("id", "#"), ("role", "@")):
            if named.get(key):
                mark += sign + _DIGITS.sub("0", ".".join(sorted(named[key].split()))).translate(_MARKS)
        path = f"{(top if len(stack) <= DEEP else stack[DEEP]).path}/{mark}"
        path = self._paths.setdefault(path, path)
        self.elements[path] += 1
        if tag in VOID:
            return
        words = _words(f"{named.get('class', '')} {named.get('id', '')}") if named else set()
        frame = tag in ("html", "body", "main")
        is_main = not top.never and (tag in MAIN or named.get("role") == "main" or bool(words & MAIN_WORDS and tag in SCOPE))
        never = tag in NEVER or named.get("role", "").lower() in ROLES or "hidden" in named
        never = never or not frame and bool(words & NEVER_WORDS) and _says_never([*named.get("class", "").split(), named.get("id", "")])
        never = never or not top.main and not frame and not is_main and (tag == "header" or bool(words & HEADS))
        block = path if tag in BLOCK else top.block
        self._opened[tag] = self._opened.get(tag, 0) + 1
        if tag in STOPS:
            self._stops.append(len(stack))
        stack.append(_Element(tag, path, top.never or never, (top.main or is_main) and not never, top.link or tag == "a", block))

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        match = _TOKEN.match
        lowered = None
        while at < end:
            m = match(source, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag:
                tag = tag.lower()
                if m[1] or m[4]:
                    if not self._opened.get(tag):
                        continue
                    for i in range(len(self._stack) - 1, 0, -1):
                        if self._stack[i].tag == tag:
                            self._pop(i)
                            break
                    continue
                self._open(tag, m[3] if m[2] else m[6])
                if tag in RAW:
                    lowered = lowered or source.lower()
                    close = lowered.find(f"</{tag}", at) if len(lowered) == end else -1
                    if close < 0:
                        found = re.compile(f"</{tag}", re.I).search(source, at)
                        close = found.start() if found else end
                    self._opened[self._stack.pop().tag] -= 1
                    shut = source.find(">", close)
                    at = end if close == end or shut < 0 else shut + 1
                continue
            if m[0][:2] in ("<!", "<?"):
                if m[0].startswith("<![CDATA["):
                    self._text.append(m[0][9:].removesuffix("]]>"))
                continue
            text = html.unescape(m[0])
            self._text.append(text)
            if self._stack[-1].link:
                self._linked += len(text.strip())


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][-+.a-zA-Z0-9]*://([^/?#]*)", 1)), F.lit(""))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _text_token(path: str, text: str) -> str:
    return f"{path}={xxhash.xxh3_64_hexdigest(text)}"


def page_tokens(page: Page) -> dict[str, list[int]]:
    """Of each token its number in the page, its characters and those in links; of an element with all below it."""
    found = {"": [1, 0, 0]} | {path: [number, 0, 0] for path, number in page.elements.items()}
    own: dict[str, list[int]] = {}
    for block in page.blocks:
        size, path = len(block.text), block.path
        of_text = found.setdefault(_text_token(path, block.text), [0, 0, 0])
        of_text[0] += 1
        of_text[1] += size
        of_text[2] += block.linked
        of_path = own.setdefault(path, [0, 0])
        of_path[0] += size
        of_path[1] += block.linked
    for path, (size, linked) in own.items():
        while path:
            sums = found[path]
            sums[1] += size
            sums[2] += linked
            path = path.rpartition("/")[0]
    return found


_TOKENS = "host string, token string, vector long, pages long, number long, chars long, linked long"


def _vectors(pages: DataFrame) -> DataFrame:
    """(host, token) with the hashed occurrence vector and sums; the empty token is the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[int]] = {}
            for host, key, source in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for token, (number, chars, linked) in page_tokens(Page(source or "")).items():
                    row = found.setdefault((host, token), [0, 0, 0, 0, 0])
                    row[0] ^= xxhash.xxh3_64_intdigest(f"{key}:{number}")
                    for i, value in enumerate((1, number, chars, linked), 1):
                        row[i] += value
            rows = [(h, t, _signed(v[0]), *v[1:]) for (h, t), v in found.items()]
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.string(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "token", "vector", "pages", "number", "chars", "linked"])

    partial = map_arrow(pages, run, _TOKENS)
    return partial.groupBy("host", "token").agg(
        F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "number", "chars", "linked")]
    )


def _mark(path: str) -> tuple[str, set[str], str]:
    """Tag, words of class and id, and role of an element."""
    mark, _, role = path.rpartition("/")[2].partition("@")
    tag = re.split("[.#]", mark, maxsplit=1)[0]
    return tag, _words(mark[len(tag) :]), role.lower()


def _names(path: str) -> list[str]:
    """The classes and ids of an element."""
    return re.split("[.#]", path.rpartition("/")[2].partition("@")[0])[1:]


def _under(path: str, roots) -> bool:
    """Whether the path is one of the roots or below one."""
    while path:
        if path in roots:
            return True
        path = path.rpartition("/")[0]
    return False


def is_boilerplate(path: str, in_main: bool) -> bool:
    """What the label of a template element says; heads belong to the text inside an article."""
    tag, words, role = _mark(path)
    if tag in ("html", "body", "main"):
        return False
    if tag in NEVER or role in ROLES or words & NEVER_WORDS and _says_never(_names(path)) or tag in CONTAINERS and words & LABEL_WORDS:
        return True
    return not in_main and (tag == "header" or bool(words & HEADS))


@dataclass
class Template:
    """slots: elements of the main text; drops: elements inside them that are none; texts: text tokens of the frame."""

    slots: list[str]
    drops: list[str]
    texts: list[str]


def deduce(tokens: list[tuple[str, int, int, int, int, int]]) -> Template:
    """The template of a host from its frequent tokens: (token, vector, pages, number, chars, linked)."""
    whole = next((t for t in tokens if t[0] == ""), None)
    if whole is None or whole[2] < SUPPORT:
        return Template([], [], [])
    pages = whole[2]
    classes: dict[tuple[int, int, int], list[str]] = {}
    sums: dict[str, tuple[int, int]] = {}
    for token, vector, seen, number, chars, linked in tokens:
        if token:
            classes.setdefault((vector, seen, number), []).append(token)
            sums[token] = (chars, linked)
    frame = classes.pop((whole[1], pages, pages), [])
    frame_elements = {t for t in frame if "=" not in t}

    def home(path: str) -> str:
        while path and path not in frame_elements:
            path = path.rpartition("/")[0]
        return path

    elements = set(frame_elements)
    for members in classes.values():
        below = [t for t in members if "=" not in t]
        if len({home(t) for t in below}) == 1:
            elements.update(below)
    # What varies in each slot: the text below its element, less other frame elements there and the frame's own text.
    varies = {e: list(sums[e]) for e in frame_elements}
    for token in frame:
        path, is_text, _ = token.partition("=")
        up = home(path if is_text else path.rpartition("/")[0])
        if up:
            for i in (0, 1):
                varies[up][i] -= sums[token][i]
    main = {e for e in elements if _mark(e)[0] in MAIN or _mark(e)[2] == "main"}
    labelled = {e for e in elements if is_boilerplate(e, _under(e.rpartition("/")[0], main))}
    main = {e for e in main if not _under(e, labelled)}
    if not main:
        named = [e for e in elements if _mark(e)[1] & MAIN_WORDS and _mark(e)[0] in SCOPE and not _under(e, labelled)]
        best = max(named, key=lambda e: (sums[e][0] - sums[e][1], -len(e), e), default=None)
        main = {best} if best and sums[best][0] > sums[best][1] else set()
    if main:
        slots = sorted(e for e in main if not _under(e.rpartition("/")[0], main))
        links = set()
    else:
        full = [(v[0] - v[1], e) for e, v in varies.items() if v[0] > v[1] and v[1] <= LINK_SHARE * v[0] and not _under(e, labelled)]
        if not full:
            return Template([], [], [])
        slot = max(full)[1]
        while (up := home(slot.rpartition("/")[0])) and _mark(up)[0] not in ("html", "body"):
            if any(_under(e, {up}) for e in labelled):
                break
            slot = up
        slots = [slot]
        links = {e for e in elements if e != slot and _under(e, {slot}) and sums[e][0] and sums[e][1] > LINK_SHARE * sums[e][0] and _mark(e)[0] in BLOCK}
    drops = sorted(e for e in labelled | links if _under(e, set(slots)))
    # What an article says is no template, however many pages say it: only a slot that nothing names has the frame's text taken out.
    return Template(slots, drops, sorted(t for t in frame if "=" in t) if pages >= MANY and not main else [])


_TEMPLATE = "host string, all_pages long, bytes long, slots array<string>, drops array<string>, texts array<string>"


def templates(pages: DataFrame) -> DataFrame:
    """(host, all_pages, bytes, slots, drops, texts): one row a host, as large as the frequent tokens of its pages."""
    vectors = _vectors(pages)
    # Most tokens of a large host are texts of one page: they meet the host's size in SALTS parts, not in one task.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = vectors.filter("token = ''").select("host", F.col("pages").alias("all_pages"), salts)
    vectors = vectors.withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int"))
    frequent = vectors.join(sizes, ["host", "salt"]).filter(F.col("pages") >= FREQUENT * F.col("all_pages"))
    token = F.struct("token", "vector", "pages", "number", "chars", "linked")
    grouped = frequent.groupBy("host").agg(F.collect_list(token).alias("tokens"), F.max("all_pages").alias("all_pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduce(sorted(tuple(t.values()) for t in tokens)) for tokens in batch.column(1).to_pylist()]
            parts = [[f.slots for f in found], [f.drops for f in found], [f.texts for f in found]]
            sizes = [sum(map(len, f.slots + f.drops + f.texts)) for f in found]
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), *[pa.array(p, pa.list_(pa.string())) for p in parts]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TEMPLATE.split(", ")])

    return map_arrow(grouped, run, _TEMPLATE)


def main_text(source: str, template: Template) -> str:
    page = Page(source)
    blocks = [b for b in page.blocks if not b.never]
    slots, drops, texts = set(template.slots), set(template.drops), set(template.texts)
    found = [b for b in blocks if _under(b.path, slots) and not _under(b.path, drops)] if slots else []
    # A page that has nothing but the template's text keeps it.
    found = [b for b in found if _text_token(b.path, b.text) not in texts] or found
    return "\n\n".join(b.text for b in found or _by_own_elements(blocks))


def _by_own_elements(blocks: list[Block]) -> list[Block]:
    """Of a page without a template: its article or main elements, else the element with the most text outside links."""
    if any(b.main for b in blocks):
        return [b for b in blocks if b.main]
    sums: Counter[str] = Counter()
    for b in blocks:
        sums[b.path.rpartition("/")[0]] += len(b.text) - 2 * b.linked
    best = max(sums, key=lambda p: (sums[p], p), default="")
    return [b for b in blocks if not best or b.path.startswith(best + "/")]


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text of each."""
    kept = [c for c in pages.columns if c != text_col]
    plain = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).select(_host().alias("host"), key_of().alias("key"), "html")
    found = Workspace(pages.sparkSession, "html").stage(templates(plain), "templates")
    total, size = found.agg(F.coalesce(F.sum("all_pages"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(url_col).alias("url")).select("row", _host().alias("host"))
    parts = ["slots", "drops", "texts"]
    if size <= BROADCAST_BYTES:
        joined = row.join(F.broadcast(found), "host", "left").select("row", *parts)
    else:
        # A host with over 1/1000 of the pages would be a large group; there are fewer than 1000 of them.
        hot = F.col("all_pages") * 1000 > total
        met = row.join(F.broadcast(found.filter(hot)), "host", "left")
        rest = met.filter("all_pages is null").select("row", "host").join(found.filter(~hot), "host", "left")
        joined = met.filter("all_pages is not null").select("row", *parts).unionByName(rest.select("row", *parts))
    at = kept.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).flatten()
            told = [[x or [] for x in batch.column(i).to_pylist()] for i in (1, 2, 3)]
            texts = [main_text(source or "", Template(*parts)) for source, *parts in zip(rows[at].to_pylist(), *told)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(texts, pa.string())], names=[*kept, text_col])

    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(text_col, T.StringType())])
    return map_arrow(joined, run, schema)


def key_of():
    """Tells pages apart in occurrence vectors; equal rows count as one page twice."""
    return F.xxhash64("url", "html")
