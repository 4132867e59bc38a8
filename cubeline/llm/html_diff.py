"""Main text of web pages by differencing each page with the page of the nearest URL.

Pages are put in order of host and URL path.  A page's partner is, of its neighbours there on
the same host, the one whose path shares the longer prefix (the earlier on ties); pages with
the same html are no neighbours of each other, the next one before or after them is.  Both pages
are cut into lines, one for each block; the lines are aligned by longest common subsequence,
and a line that the partner shares goes.

Differencing alone can't tell a page's article from a copy of it next door, nor an advert that
only one page carries (README, with figures).  So markup corrects it in two ways: a shared
line inside `article` or `main` stays, and a line that is not shared goes if it is inside an
element that names itself menu, header, footer, sidebar, notice, advert, form, comments, script
or style.  `n_lines`, `n_shared`, `n_differenced` and `n_by_markup` tell, for each page, how many lines
it has, how many of them the partner shares, and how many went by differencing and by markup.

Whole pages are read; character references are decoded; white space within a block becomes one
space; blocks are joined by one newline.  Comments, unclosed and nested paragraphs and
truncated pages are handled as they stand.  Null html is empty and gives an empty text.  A page
without partner keeps its lines.  A null URL is a host of its own kind ("").  Repeated rows and
other copies are never partners, and a host with nothing but copies of one page has none.
Columns other than the id, the URL and the html stay out of the result.

Alignment takes memory in proportion to the lines (Hirschberg's division over rows of bits).

The order is dealt in ranges with both edge neighbours and, where copies go on over an edge, the
nearest page there that is no copy, so each page meets its partner in one
shuffle of the html, and a host with a third of all pages spreads over as many ranges as its
share asks for.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeline.llm.common import long_key, ordered_buckets, ranges_for

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_GONE = frozenset("script style noscript template iframe textarea title head nav header footer aside form button select option menu dialog svg canvas object audio video map datalist fieldset".split())
_MAIN = frozenset(("article", "main"))
#: Parts of class, id and role names that say what an element is.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies complementary disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay popup promo promotion promoted related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget alert".split()
)
#: Opening one of these ends an open p.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

Line = tuple[str, int]  # text, kind
FREE, KEPT, GONE = 0, 1, 2


def _kind(name: str, attrs: str) -> int:
    if name in _GONE:
        return GONE
    if attrs:
        if _HIDDEN.search(attrs):
            return GONE
        if name not in ("html", "body"):
            for m in _ATTR.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                # an article may be of class "has-comments"; one of class "comment" is a comment
                if any(p.lower() in _NAMES for p in (value.split() if name in _MAIN else _NAME.findall(value))):
                    return GONE
    return KEPT if name in _MAIN else FREE


def lines(page: str) -> list[Line]:
    """The blocks of a page, each with what the markup says of it."""
    out: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # names on the stack
    kind, at, low = FREE, 0, None

    def flush():
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if s:
                out.append((s, kind))

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            text.append(" ")
            continue
        if name not in _INLINE:
            flush()
        if m[1]:  # closing
            if opened[name]:
                if _kind_at(stack, name) != kind:
                    flush()
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                kind = stack[-1][1] if stack else FREE
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    opened.subtract(n for n, _ in stack[k:])
                    del stack[k:]
                    kind = stack[-1][1] if stack else FREE
                    break
                if stack[k][0] not in _INLINE:
                    break
        if m[3].endswith("/") and name not in _INLINE and name not in _ENDS_P:
            continue
        own = _kind(name, m[3])
        inner = GONE if GONE in (own, kind) else KEPT if KEPT in (own, kind) else FREE
        if inner != kind:
            flush()
        if name in _RAW:
            low = page.lower() if low is None else low
            end = low.find("</" + name, at)
            end = len(page) if end < 0 else end
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        stack.append((name, inner))
        opened[name] += 1
        kind = inner
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def _kind_at(stack: list[tuple[str, int]], name: str) -> int:
    """The kind that holds once the innermost `name` is closed."""
    k = len(stack) - 1
    while stack[k][0] != name:
        k -= 1
    return stack[k - 1][1] if k else FREE


#: Cells of an alignment that are worked out with all rows kept; larger ones are divided.
_CELLS = 1 << 24
#: Bits of the masks that are remembered within one pass.
_MASKS = 1 << 26


def shared(a: list[str], b: list[str]) -> set[int]:
    """Numbers of the lines of a in a longest common subsequence with b."""
    both = set(a) & set(b)
    name: dict[str, int] = {}
    ia = [i for i, x in enumerate(a) if x in both]
    x = [name.setdefault(a[i], len(name)) for i in ia]
    y = [name[t] for t in b if t in both]
    out: set[int] = set()
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            out.add(ia[i0])
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.add(ia[i1])
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0) * (j1 - j0) <= _CELLS:
            out.update(ia[i0 + k] for k in _aligned(x[i0:i1], y[j0:j1]))
        elif i1 - i0 == 1:
            if x[i0] in y[j0:j1]:
                out.add(ia[i0])
        else:  # where the two halves of a part b
            mid = (i0 + i1) // 2
            head = _lengths(x[i0:mid], y[j0:j1])
            tail = _lengths(x[mid:i1][::-1], y[j0:j1][::-1])[::-1]
            cut = j0 + int(np.argmax(head + tail))
            todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a: bit j is 0 where a longest common subsequence with b grows at j."""
    places: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    full, v = (1 << len(b)) - 1, (1 << len(b)) - 1
    masks: dict[int, int] = {}
    for x in a:
        m = masks.get(x)
        if m is None:
            at = places.get(x, ())
            if len(at) < 9:
                m = sum(1 << j for j in at)
            else:
                bits = np.zeros(len(b), np.uint8)
                bits[at] = 1
                m = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if (len(masks) + 1) * len(b) > _MASKS:
                masks.clear()
            masks[x] = m
        u = v & m
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a with each prefix of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[int], b: list[int]) -> list[int]:
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out


def decided(own: list[Line], partner: list[Line] | None) -> tuple[str, int, int, int, int]:
    """(text, lines, shared lines, lines that went by differencing, lines that went by markup)."""
    same = shared([t for t, _ in own], [t for t, _ in partner]) if partner else set()
    kept, differenced, marked = [], 0, 0
    for n, (t, k) in enumerate(own):
        if n in same and k != KEPT:
            differenced += 1
        elif k == GONE:
            marked += 1
        else:
            kept.append(t)
    return "\n".join(kept), len(own), len(same), differenced, marked


def main_text(own: list[Line], partner: list[Line] | None) -> str:
    """The lines that stay."""
    return decided(own, partner)[0]


def place(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, as they sort: lower-case host without port, path without a page's ending or a trailing slash."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r"(\.html?|/)$", "")
    return host, F.when(path == "", "/").otherwise(path)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def nearest(host: str, path: str, around: list[tuple[str, str, str]]) -> int | None:
    """Which of the neighbours (host, path, html) is the partner; copies of the page are not among them."""
    best = None
    for k, (h, p, _) in enumerate(around):
        if h == host:
            score = (_common(path, p), -k)
            if best is None or score > best[0]:
                best = (score, k)
    return None if best is None else best[1]


#: Characters of texts that leave in one batch.
_TOGETHER = 8 << 20


_OUT = [("page_id", "long"), ("url", "string"), ("text", "string"), ("n_chars", "long"), ("n_lines", "long"), ("n_shared", "long"), ("n_differenced", "long"), ("n_by_markup", "long")]
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _run(batches):
    """Neighbouring rows of one host and html are a run; the rows at its two sides are the neighbours of them all."""
    rows, held = [], 0
    bucket = before = None
    run: list[tuple[int, int | None, str | None, str]] = []  # side, page_id, url, path
    host = page = own = None

    def lazily(page):
        kept = []
        return lambda: kept[0] if kept else (kept.append(lines(page)), kept[0])[1]

    def batch():
        nonlocal rows, held
        cols, rows, held = list(zip(*rows, strict=True)), [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(cols, _OUT, strict=True)], [n for n, _ in _OUT])

    def solve(nxt):
        nonlocal held
        around = [x for x in (before, nxt) if x is not None]
        made: dict[int | None, tuple] = {}
        for side, i, u, p in run:
            if side == 0:
                k = nearest(host, p, [x[:3] for x in around])
                if k not in made:
                    made[k] = decided(own(), None if k is None else around[k][3]())
                text, *counts = made[k]
                rows.append((i, u, text, len(text), *counts))
                held += len(text) + len(u or "")
                if held > _TOGETHER:
                    yield batch()

    for b in batches:
        # the rows after a bucket have side 1, those before it -1
        for bk, side, i, u, new, h, p in zip(*(b.column(c).to_pylist() for c in ("_bucket", "_side", "page_id", "url", "html", "_host", "_path")), strict=True):
            if bk != bucket:
                yield from solve(None)
                bucket, before, run, host, page = bk, None, [], h, None
            if (h, new) != (host, page):
                mine = lazily(new)
                if run:
                    yield from solve((h, p, new, mine))
                    before = (host, run[-1][3], page, own)
                run, host, page, own = [], h, new, mine
            run.append((side, i, u, p))
    yield from solve(None)
    if rows:
        yield batch()


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, and the counts of lines for each page."""
    host, path = place(F.col("url"))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    base = base.withColumns({"_host": host, "_path": path})
    key = F.concat_ws("\x00", F.concat("_host", F.lit("\x01"), "_path"), long_key(F.col("page_id")), F.md5(F.concat_ws("\x00", "url", "html").cast("binary")))
    mark = F.md5(F.concat_ws("\x00", "_host", "html").cast("binary"))
    n = ranges_for(pages)
    dealt = ordered_buckets(base, key, n, before=True, after=True, mark=mark)
    return dealt.select("_bucket", "_side", "page_id", "url", "html", "_host", "_path").mapInArrow(_run, ", ".join(map(" ".join, _OUT)))
