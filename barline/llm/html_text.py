"""HTML extraction by nearest-URL page differencing.

Every page becomes a list of text lines (blocks), each with the slot of the page it stands in. Pages of
a host are ordered by URL path and each is paired with the neighbour whose path shares the longest
start. The longest common subsequence of the two lists is what the pages share, and shared lines are
deleted.

Two lines are the same if they stand in the same slot of the page's furniture (navigation, header,
footer, sidebar, advert, form, comments and the like) or, elsewhere outside an article or main element,
if they also read the same. Lines of an article or main element are the same if they read the same.
Two pages of a host often carry the same article or paragraph, which a plain difference would delete,
so one partner is no evidence there. The neighbours around are compared whose main text differs, from the
page's and from each other's, and such a line goes if the subsequences with a share of ``SHARE`` of
them, and with ``WITNESSES`` at least, hold it. Furniture that no partner shares (a host with one page,
a slot that only one of the two has) goes by the exact check behind, which knows the slot.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import importable, slices

# Elements and names that mark parts of a page.
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
SILENT = frozenset("noscript template svg math object canvas audio video head select datalist button".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar sidebars aside widget widgets comment comments reply replies discussion disqus respond cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager "
    "toolbar skip copyright".split()
)
# A class or id is furniture by its words: all of them furniture or neutral ("site-header", "comments-list"), or the first one of PREFIXES ("comment-body").
# What names a state of the page ("no-sidebar", "nav-open") or the header of a text ("article-header") is none.
NEUTRAL = frozenset(
    "site page global top bottom left right center primary secondary upper lower inner outer first last main sub mini small large mobile desktop sticky fixed area "
    "container wrapper wrap box bar block section region panel slot unit list item items link links button buttons icon icons text title form thread count zone "
    "post posts entry article articles story stories wp js css id the and of for to".split()
)
PREFIXES = frozenset(
    "ad ads advert adverts advertisement nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer cookie cookies gdpr comment comments disqus newsletter "
    "popup modal pagination pager".split()
)
STATES = frozenset("no not non with without has have layout open opened closed enabled disabled visible active collapsed expanded free".split())
OF_TEXT = frozenset("post entry article story".split())
FOREIGN = ("svg", "math")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("html body option caption summary legend tbody thead tfoot tr td th li dd dt".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot menu dir".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?P<within>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/]|$))", re.I)
SPACE = re.compile(r"\s+")

FURNITURE, OTHER, MAIN = 0, 1, 2
ROWS_PER_BUCKET = 250
MOST_BUCKETS = 20_000
PER_CUT = 8  # keys picked for each bucket; half of them lie between a cut and the end of the margin
AROUND = 8  # pages on each side that are held beside a page
DIFFERENT = 8  # most neighbours of differing main text that a page's main lines are compared with
WITNESSES = 2  # of these have to share a main line for it to go, and
SHARE = 0.75  # of those compared


def _named(value: str, heads: bool) -> bool:
    """Whether a class or id has a name that says furniture; ``heads`` if a header there belongs to the text below it."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
        said = FURNITURE_NAMES.intersection(words)
        if not said or not STATES.isdisjoint(words) or said == {"header"} and (heads or not OF_TEXT.isdisjoint(words)):
            continue
        if words[0] in PREFIXES or (FURNITURE_NAMES | NEUTRAL).issuperset(words):
            return True
    return False


def _is_furniture(tag: str, attrs: str, main: bool) -> bool:
    if tag in FURNITURE_TAGS and not (main and tag == "header"):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        value = unescape(value.strip("\"'")).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and not (name == "id" and tag in HEADINGS) and _named(value, main or tag in HEADINGS):
            return True
    return False


def lines(html: str) -> tuple[list[tuple[int, str, str]], int]:
    """``(kind, slot, text)`` of every block with text, in page order, and the highest kind of these.

    Markup that is never closed or closed twice is put up with; nothing is dropped but raw and silent
    elements, comments and markup. Furniture around the only main element with text, or around the only
    article if that is longer than the text outside, is a wrapper of the page and no furniture.
    """
    out, held = _lines(html, frozenset())
    has_main = any(kind == MAIN for kind, _, _ in out)
    around = {places: letters for (places, main), letters in held.items() if main}
    if not around and not has_main:
        outside = sum(len(text) for kind, _, text in out if kind == OTHER)
        around = {places: letters for (places, _), letters in held.items() if letters > outside}
    if around and ((), True) not in held:
        most = max(around, key=around.get)
        # Comments inside the wrapper of an article may be longer, and stay comments.
        places = next(most[:n] for n in range(1, len(most) + 1) if most[:n] in around)
        out, _ = _lines(html, frozenset(places))
    return out, max((OTHER, *(kind for kind, _, _ in out)))


def _lines(html: str, free: frozenset[int]) -> tuple[list[tuple[int, str, str]], Counter]:
    """The lines, and the letters of articles and main elements by the places of the furniture around them
    and whether it is a main element. Elements at the places ``free`` are no furniture."""
    out: list[tuple[int, str, str]] = []
    parts: list[str] = []
    # Tag, kind, silent, slot, places of the furniture around, and the innermost of article, main and furniture.
    stack: list[tuple[str, int, bool, str, tuple[int, ...], str]] = []
    page = ("", OTHER, False, "", (), "")
    held: Counter = Counter()
    at = 0

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                _, kind, _, slot, places, inside = stack[-1] if stack else page
                out.append((kind, slot, text))
                if inside in ("article", "main"):
                    held[places, inside == "main"] += len(text)

    def take(text: str) -> None:
        if stack and stack[-1][0] == "head" and not text.isspace():
            close(("head",), frozenset())
        if not (stack and stack[-1][2]):
            parts.append(text)

    def close(names: Sequence[str], until: frozenset[str]) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in names:
                del stack[n:]
                return
            if stack[n][0] in until:
                return

    next_at = 0
    while token := TOKEN.search(html, next_at):
        if token.start() > at:
            take(html[at : token.start()])
        at = next_at = token.end()
        if token["raw"] and token["within"].endswith("/") and any(entry[0] in FOREIGN for entry in stack):
            at = next_at = token.end("within") + 1
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if token["end"]:
            close((tag,), frozenset())
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in FOREIGN and token["attrs"].endswith("/"):
            continue
        if tag == "body" or (stack and stack[-1][0] == "head" and tag not in HEAD):
            close(("head",), frozenset())
        if tag in SIBLINGS:
            close(SIBLINGS[tag], HOLDERS)
        elif tag in CLOSES_P:
            close(("p",), BLOCKS - {"p"})
        _, kind, silent, slot, places, inside = stack[-1] if stack else page
        if token.start() not in free and _is_furniture(tag, token["attrs"], inside in ("article", "main")):
            kind, places, inside = FURNITURE, (*places, token.start()), "furniture"
        elif tag in ("article", "main"):
            kind, inside = FURNITURE if kind == FURNITURE else MAIN, "main" if inside == "main" else tag
        stack.append((tag, kind, silent or tag in SILENT, f"{slot}>{tag}", places, inside))
    if at < len(html):
        take(html[at:])
    flush()
    return out, held


# ---- what two pages share -----------------------------------------------------------------------------


def _row(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and every start of ``b``, by bit-parallel steps."""
    size = len(b)
    full = (1 << size) - 1
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``, in linear space."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    middle = [n for n in range(start, len(a) - end) if a[n] in both]
    other = [x for x in b[start : len(b) - end] if x in both]
    found = [middle[n] for n in _halves([a[n] for n in middle], other)]
    return [*range(start), *found, *range(len(a) - end, len(a))]


def _halves(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    half = len(a) // 2
    total = _row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]
    cut = int(total.argmax())
    return _halves(a[:half], b[:cut]) + [half + n for n in _halves(a[half:], b[cut:])]


def kept(kinds: Sequence[int], highest: int, texts: Sequence[str], gone: set[int]) -> str:
    """The text that is left of a page when the lines at ``gone`` are deleted.

    Of the lines outside the furniture, those in the articles and main elements are kept, or all if these
    have no text. Where the partner shares all of them it is a copy of the page, and none is deleted.
    """
    main = [n for n, kind in enumerate(kinds) if kind == highest]
    left = [n for n in main if n not in gone] or main
    return "\n\n".join(texts[n] for n in left)


# ---- pages side by side -------------------------------------------------------------------------------


def _place(url: str | None) -> str:
    """Host and path of a URL, without scheme, port, query and fragment; a null or odd one sorts as it is."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.rsplit("@", 1)[-1].split(":")[0].lower() + "\x01" + path.rstrip("/")


def _key(place: str, page: str) -> str:
    return place + "\x00" + page


_LINES = "page_id {id}, url string, bucket int, key string, copy boolean, highest int, kinds binary, marks binary, sizes binary, texts string"


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``.

    Pages are dealt into buckets of about ``ROWS_PER_BUCKET`` rows in the order of host, path and id; the
    pages within about half a bucket of a cut are seen by the bucket behind it too, as neighbours only. Null or empty html has
    empty text. Rows with a null or odd URL form a host of their own, repeated rows are each other's
    partner, and a page without a neighbour on its host loses only what the exact check knows.
    """
    importable(pages.sparkSession)
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    kind = dict(source.dtypes)["page_id"]
    ids = source.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url")
    count = ids.count()
    buckets = max(1, min(MOST_BUCKETS, count // ROWS_PER_BUCKET))
    # Cuts are keys picked by a hash, ``PER_CUT`` times as many as buckets, so that every ``PER_CUT``th splits evenly.
    step = max(1, count // (PER_CUT * buckets))
    picked = ids.where(F.pmod(F.xxhash64("page", "url"), F.lit(step)) == 0).distinct().collect() if buckets > 1 else []
    keys = sorted({_key(_place(r["url"]), r["page"]) for r in picked})
    cuts = keys[::PER_CUT][1:]

    def buckets_of(key: str) -> list[int]:
        """The page's own bucket, and those that see it from the other side of a cut."""
        own, at = bisect.bisect_right(cuts, key), bisect.bisect_right(keys, key)
        before = own > 0 and at <= own * PER_CUT + PER_CUT // 2
        behind = own < len(cuts) and at > (own + 1) * PER_CUT - PER_CUT // 2
        return [own, *[own - 1] * before, *[own + 1] * behind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                rows, out = [], [[] for _ in range(8)]
                pages_ = batch.column("page_id").to_pylist()
                for n, (page, url, html) in enumerate(zip(pages_, batch.column("url").to_pylist(), batch.column("html").to_pylist())):
                    found, highest = lines(html)
                    key = _key(_place(url), "" if page is None else str(page))
                    marks = np.array([_mark(*line) for line in found], np.uint64).tobytes()
                    sizes = np.array([len(t) for _, _, t in found], np.uint32).tobytes()
                    for copy, to in enumerate(buckets_of(key)):
                        rows.append(n)
                        texts = "" if copy else "\n".join(t for _, _, t in found)
                        for column, value in zip(out, (to, key, copy > 0, highest, bytes(k for k, _, _ in found), marks, sizes, texts)):
                            column.append(value)
                take = pa.array(rows, pa.int64())
                types = (pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").take(take), batch.column("url").take(take), *(pa.array(c, t) for c, t in zip(out, types))],
                    ["page_id", "url", "bucket", "key", "copy", "highest", "kinds", "marks", "sizes", "texts"],
                )

    dealt = source.mapInArrow(read, _LINES.format(id=kind)).repartition("bucket").sortWithinPartitions("bucket", "key", "copy")
    return dealt.mapInArrow(_difference, f"page_id {kind}, url string, text string")


def _mark(kind: int, slot: str, text: str) -> int:
    """What makes two lines the same."""
    if kind >= MAIN:
        return xxhash.xxh64_intdigest(text)
    return xxhash.xxh64_intdigest(f"{kind}{slot}" if kind == FURNITURE else f"{kind}{slot}\n{text}")


class _Page:
    """A row with its marks, those of its main text apart."""

    def __init__(self, row: dict):
        self.row, self.kinds = row, row["kinds"]
        self.host = row["bucket"], row["key"].partition("\x01")[0]
        marks, sizes = np.frombuffer(row["marks"], np.uint64).tolist(), np.frombuffer(row["sizes"], np.uint32).tolist()
        split = [[(n, m) for n, (k, m) in enumerate(zip(self.kinds, marks)) if (k >= MAIN) == main] for main in (False, True)]
        (self.around_at, self.around), (self.main_at, self.main) = [([n for n, _ in part], [m for _, m in part]) for part in split]
        self.size = dict(zip(self.main, (sizes[n] for n in self.main_at)))
        self.letters = sum(self.size.values())

    def near(self, other: _Page) -> int:
        return len(commonprefix([self.row["key"], other.row["key"]]))

    def differs(self, other: _Page) -> bool:
        """Whether they share under half of the lines or of the letters of the smaller main text."""
        both = self.size.keys() & other.size.keys()
        return 2 * len(both) < min(len(self.size), len(other.size)) or 2 * sum(self.size[m] for m in both) < min(self.letters, other.letters)


def _repeated(page: _Page, around: Sequence[_Page]) -> set[int]:
    """Places of the main lines that neighbours of differing main text share, the nearest first."""
    held: dict[int, int] = {}
    seen: list[_Page] = []
    for other in around:
        if other.main and all(other.differs(p) for p in (page, *seen)):
            seen.append(other)
            for n in shared(page.main, other.main):
                held[n] = held.get(n, 0) + 1
            if len(seen) == DIFFERENT:
                break
    return {page.main_at[n] for n, times in held.items() if times >= max(WITNESSES, SHARE * len(seen))}


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows beside their neighbours: ``AROUND`` pages behind and ahead are held at a time."""

    kind: list[pa.DataType] = []

    def rows() -> Iterator[_Page]:
        for whole in batches:
            kind[:] = [whole.schema.field("page_id").type]
            for batch in slices(whole, 64):
                yield from map(_Page, batch.to_pylist())

    def text(page: _Page, before: Sequence[_Page], after: Sequence[_Page]) -> str:
        """``before`` and ``after`` have the nearest page first."""
        if not page.row["texts"]:
            return ""
        sides = [(-page.near(p), n, side, p) for side, pages in enumerate((after, before)) for n, p in enumerate(pages) if p.host == page.host]
        around = [p for *_, p in sorted(sides, key=lambda s: s[:3])]
        gone = {n for n, k in enumerate(page.kinds) if k == FURNITURE}  # the exact check
        if around:
            gone |= {page.around_at[n] for n in shared(page.around, around[0].around)} | _repeated(page, around)
        return kept(page.kinds, page.row["highest"], page.row["texts"].split("\n"), gone)

    done: list[tuple] = []
    held: deque[_Page] = deque()
    at = 0  # place of the next page to write in ``held``
    for page in _with_end(rows()):
        if page is not None:
            held.append(page)
        while at < len(held) and (page is None or len(held) - at > AROUND):
            own, pages = held[at], list(held)
            if not own.row["copy"]:
                done.append((own.row["page_id"], own.row["url"], text(own, pages[:at][::-1], pages[at + 1 :])))
            at += 1
            if at > AROUND:
                held.popleft()
                at -= 1
            if len(done) == 256:
                yield _batch(done, kind[0])
                done = []
    if done:
        yield _batch(done, kind[0])


def _with_end(rows: Iterator[_Page]) -> Iterator[_Page | None]:
    yield from rows
    yield None


def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, urls, texts = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])
