import random
import re
import time
import tracemalloc
from html.parser import HTMLParser
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from cubeline.llm import html_diff as H


def place(url):
    """Host and path by the standard library."""
    try:
        u = urlsplit((url or "").strip())
        host, path = (u.hostname or "").lower(), u.path
    except ValueError:
        host, path = "", ""
    return host, re.sub(r"(\.html?|/)$", "", path) or "/"


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdefg") for _ in range(rng.randint(0, 14))]
        s = [a[i] for i in sorted(H.shared(a, b))]
        rest = iter(b)
        assert all(x in rest for x in s) and len(s) == lcs(a, b)


def test_large_alignments(monkeypatch):
    """Divided alignments are longest too, and long pages take memory in proportion to their lines."""
    rng = random.Random(2)
    monkeypatch.setattr(H, "_CELLS", 6)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        s = [a[i] for i in sorted(H.shared(a, b))]
        rest = iter(b)
        assert all(x in rest for x in s) and len(s) == lcs(a, b)
    monkeypatch.undo()
    n = 100_000
    a = [f"line {k}" for k in range(n)]
    b = [f"line {k if k % 10 else -k}" for k in range(n)]
    tracemalloc.start()
    began = time.time()
    assert len(H.shared(a, b)) == n - n // 10 + 1
    assert len(H.shared(["x"] * n + ["y"], ["z"] + ["x"] * n)) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and time.time() - began < 120


def test_many_tags():
    began = time.time()
    assert H.lines("</x>" * 50_000 + "<p>end") == [("end", 0)]
    assert H.lines("<div>" * 30_000 + "deep" + "</i>" * 30_000) == [("deep", 0)]
    assert len(H.lines("<p>a" * 50_000)) == 50_000
    assert time.time() - began < 20


class Blocks(HTMLParser):
    """Lines of simple pages, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.kinds, self.out, self.text = ["free"], [], ""

    def flush(self):
        t = " ".join(self.text.split())
        self.out += [(t, self.kinds[-1])] if t else []
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "i", "a"):
            return
        self.flush()
        named = tag in ("nav", "footer", "aside", "form") or any(w in ("ad", "menu", "comments") for _, v in attrs for w in (v or "").split())
        self.kinds.append("gone" if named or self.kinds[-1] == "gone" else "kept" if tag in ("article", "main") else self.kinds[-1])

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a"):
            self.flush()
            self.kinds.pop()

    def handle_data(self, data):
        self.text += data


def parsed(page):
    p = Blocks()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def by_hand(page, partner):
    """Any longest common subsequence is right; without repeated lines there is one set of lines only when lines keep their order."""
    own, other = parsed(page), [t for t, _ in parsed(partner)] if partner is not None else []
    same = [t for t, _ in own if t in other]  # lines of these pages come in one order and once
    return "\n".join(t for t, k in own if k == "kept" or (k == "free" and t not in same))


def simple_page(rng, k):
    top, end = ([f"Shared {j}" for j in js if rng.random() < 0.7] for js in ((0, 1, 2), (3, 4, 5)))
    body = [f"Own {k}.{j} &amp; <b>more</b>" for j in range(rng.randint(0, 4))]
    parts = [f"<div>{t}</div>" for t in top]
    parts.append(rng.choice(("<nav>{}</nav>", '<div class="menu x">{}</div>', "<section>{}</section>")).format(f"<div><a href='/'>Menu {rng.randint(0, 2)}</a></div>"))
    parts.append(rng.choice(("<article>{}</article>", "<div>{}</div>", "<main>{}</main>")).format("".join(f"<p>{t}</p>" for t in body)))
    parts += [f"<div>{t}</div>" for t in end] + [rng.choice(('<div class="ad">Buy {}</div>', "<footer>About {}</footer>", "<div>Line {}</div>")).format(k)]
    return "<html><body>" + "".join(parts) + "</body></html>"


def test_extract_against_an_independent_version(spark):
    rng = random.Random(11)
    rows = [(k, f"https://h{k % 5}.example.com/{rng.choice('ab')}/{rng.randint(1, 60)}.html", simple_page(rng, k)) for k in range(150)]
    order = sorted(rows, key=lambda r: (*place(r[1]), r[0]))
    want = {}
    for n, (i, u, h) in enumerate(order):
        host, path = place(u)
        best = None
        for side in (order[:n][::-1], order[n + 1 :]):
            for _, v, g in side[:1]:
                q = place(v)
                if q[0] == host and g != h:
                    common = next((c for c in range(min(len(q[1]), len(path))) if q[1][c] != path[c]), min(len(q[1]), len(path)))
                    if best is None or common > best[0]:
                        best = (common, g)
        want[i] = by_hand(h, best and best[1])
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_lines == (len(r.text.split("\n")) if r.text else 0) + r.n_differenced + r.n_by_markup and r.n_shared >= r.n_differenced for r in got.values())
    assert sum(r.n_differenced for r in got.values()) > 300


def test_differencing_on_bare_pages(spark):
    """Pages of the table with their markup made plain and a template for each host: the alignment is what finds the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rows, truth = [], {}
    for r in pages:
        article = [t for t, k in H.lines(r.html) if k == H.KEPT]
        host, _ = place(r.url)
        rng = random.Random(host)
        menu = [f"{host} {w}" for w in ("Home", "News", "About", "Contact")]
        foot = [f"Copyright {host}", "Terms of use", f"Advert {r.page_id % 3} of {host}"]
        rows.append((r.page_id, r.url, "".join(f"<div>{t.replace('&', '&amp;').replace('<', '&lt;')}</div>" for t in [*menu, *article, *foot])))
        truth[r.page_id] = article
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(len(set(r.text.split("\n")) & set(truth[i])) for i, r in got.items())
    kept, asked = sum(len(r.text.split("\n")) for r in got.values()), sum(len(set(t)) for t in truth.values())
    assert sum(r.n_differenced for r in got.values()) > 5 * len(rows) and sum(r.n_by_markup for r in got.values()) == 0
    assert right / asked > 0.97 and right / kept > 0.8
    assert right / sum(r.n_lines for r in got.values()) < right / kept - 0.2  # without differencing


def test_lines():
    page = (
        '<!DOCTYPE html><title>T</title><style>p{}</style><script>var t="</p>";</script><body><nav><a href=x>menu</a></nav><!-- ad <p>x</p> -->'
        '<div class="ad">buy</div><div id=cookie-notice>cookies</div><article class="post has-comments"><h1>Head &amp; more</h1>'
        "<p><b>One\n two&nbsp;three.<br><p>F<i>ou</i>r &lt;5&gt;</p><form>name<input></form><ul><li>a<li>b</ul><p hidden>no</p></article>"
        '<section class="comments"><article class="comment">first!</article></section><footer>&copy; us</footer>'
    )
    assert H.main_text(H.lines(page), None) == "Head & more\nOne two three.\nFour <5>\na\nb"
    assert H.lines("") == [] and H.lines("<") == [("<", 0)]
    assert H.main_text(H.lines("plain text < 5"), None).startswith("plain text")
    assert H.main_text(H.lines("<article><p>cut off <b>he"), None) == "cut off he"


def test_differencing_decides_where_markup_is_silent():
    a = "<div>Site</div><div>Home | About</div><div>Story one.</div><div>More of it.</div><div>Imprint</div>"
    b = a.replace("Story one.", "Story two.").replace("More of it.", "Else.")
    assert H.main_text(H.lines(a), H.lines(b)) == "Story one.\nMore of it."
    # an article is kept even from a copy of the page
    c = "<div>Site</div><article><p>Story.</p></article>"
    assert H.main_text(H.lines(c), H.lines(c)) == "Story."


def test_differencing_decides_beside_an_article():
    a = '<div>Site</div><article><h1>Teaser</h1></article><div>The body one.</div><div>Goes on.</div><div class="ad">Buy</div><div>Imprint</div>'
    b = a.replace("Teaser", "Other").replace("The body one.", "The body two.").replace("Goes on.", "Ends.")
    assert H.main_text(H.lines(a), H.lines(b)) == "Teaser\nThe body one.\nGoes on."


def page(k):
    return f"<div>Shared top</div><div>Line {k}</div><div>Only {k * 7}</div><div>Shared end</div>"


def test_pairs_against_plain_order(spark):
    rng = random.Random(3)
    rows = []
    for k in range(80):
        host = "big.example.com" if k % 3 else f"h{k % 7}.example.org"
        rows.append((k, f"https://{host.upper() if k % 5 == 0 else host}/{rng.choice('abc')}/{rng.randint(1, 40)}{rng.choice(('', '/', '.html', '?q=1', '#top'))}", page(k)))
    rows += [(200, None, "<p>no url</p>"), (201, "https://big.example.com/a/1", None), (202, "no scheme/path", "<p>x</p>")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    spots = df.select("url", *[c.alias(n) for c, n in zip(H.place(F.col("url")), ("h", "p"))]).collect()
    assert all((r.h, r.p) == place(r.url) for r in spots)
    order = sorted(rows, key=lambda r: (*place(r[1]), r[0]))
    want = []
    for n, (i, u, h) in enumerate(order):
        host, path = place(u)
        around = [(*place(order[m][1]), order[m][2] or "") for m in (n - 1, n + 1) if 0 <= m < len(order)]
        k = H.nearest(host, path, around)
        t = H.main_text(H.lines(h or ""), None if k is None else H.lines(around[k][2]))
        want.append((i, u, t, len(t)))
    got = [tuple(r)[:4] for r in H.extract(df).collect()]
    assert sorted(got) == sorted(want)
    assert sum("Shared" in t for i, u, t, _ in got if "big" in (u or "").lower()) <= 2  # those next to the page without html


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a/x", "<article>A</article>")] * 3 + [(None, "http://a/x", "<p>b</p>")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text) for r in H.extract(df).collect())
    assert got == [("1", "A")] * 3 + [("None", "b")]
    assert H.extract(df.limit(0)).count() == 0


def test_copies_are_no_partners(spark):
    """Runs of copies, without article markup, over many ranges: the partner is the nearest page on the host with another html."""
    rng = random.Random(5)
    rows = [(1000 + k // 2, f"http://a.org/m/{k // 2:03d}", page(1)) for k in range(160)]  # each row twice
    rows += [(1, "http://a.org/b", page(2)), (2, "http://a.org/m/040x", page(3)), (3, "http://a.org/z", page(4))]
    rows += [(10 + k, "http://copies.org/x", page(5)) for k in range(60)] + [(90, "http://d.org/1", page(5)), (91, "http://d.org/2", page(6))]
    rng.shuffle(rows)
    order = sorted(rows, key=lambda r: (*place(r[1]), r[0]))
    want = []
    for n, (i, u, h) in enumerate(order):
        host, path = place(u)
        other = [[(*place(v), g) for _, v, g in side if place(v)[0] == host and g != h][:1] for side in (order[:n][::-1], order[n + 1 :])]
        around = [x for side in other for x in side]
        k = H.nearest(host, path, around)
        t = H.main_text(H.lines(h), None if k is None else H.lines(around[k][2]))
        want.append((i, u, t, len(t)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [tuple(r)[:4] for r in H.extract(df).collect()]
    assert sorted(got) == sorted(want)
    assert all(t.startswith("Line ") for i, u, t, _ in got if "copies" not in u) and all("Shared top" in t for i, u, t, _ in got if "copies" in u)
