"""Verdicts of the operators against brute force and against their SQL."""

import math
import random
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html, queries, urls


# ------------------------------------------------------------ SQL
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    df = (queries.queries() | queries.parts())[name](spark, d)
    rel = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(map(tuple, rel.fetchall()))
    assert Counter(map(tuple, df.select(*names).collect())) == want and want


@pytest.mark.parametrize("name", ["op2_quality", "op10_substring", "tiff_payloads", "lm_base"])
def test_sql_on_awkward_texts(spark, tmp_path, name):
    r = random.Random(3)
    line = " ".join(f"w{i}" for i in range(70))
    texts = [None, "", " \n\t ", "one", "é ß\x0b字", "# $ %|<>\n\na\na \n a", " ".join(["so", "on"] * 90), line + " x " + line, line, line + "\n" + " ".join(r.choice("ab") for _ in range(120)), "word " * 300, " ".join(f"v{i % 37}" for i in range(400))]
    rows = [(i if i != 3 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(8, line, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = (queries.queries() | queries.parts())[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = Counter(map(tuple, con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()))
    assert Counter(map(tuple, df.collect())) == want


# ------------------------------------------------------------ 5
def _above(limit, a, b):
    """By the midpoint rule in the angle, over a fine grid."""
    x = (np.arange(400_000) + 0.5) * (math.pi / 2 / 400_000)
    f = (2 * a - 1) * np.log(np.sin(x)) + (2 * b - 1) * np.log(np.cos(x))
    f = np.exp(f - f.max())
    return f[np.sin(x) ** 2 > limit].sum() / f.sum()


@pytest.mark.parametrize("a, b, limit", [(0.5, 0.5, 0.3), (1, 1, 0.25), (5.2, 20.8, 0.26), (1500, 4500, 0.255), (0.6, 30, 0.02), (40, 0.5, 0.99), (9, 2, 0.0), (2, 9, 1.0)])
def test_beta_tail(spark, a, b, limit):
    got = spark.range(1).select(urls.above(F.lit(float(limit)), F.lit(float(a)), F.lit(float(b)))).first()[0]
    assert abs(got - _above(limit, a, b)) < 1e-3


def _levels(host):
    parts = host.split(".")
    n = 3 if ".".join(parts[-2:]) == "co.uk" else 2
    return ".".join(parts[-n:]), ".".join(parts[-(n - 1):])


def _brute(pages, labels, probability=0.75):
    """Blocked hosts, from the definitions alone."""
    seen = {}
    for p, bad in labels:
        seen[p] = max(seen.get(p, 0), bad)
    counts = {level: Counter() for level in ("host", "domain", "suffix")}
    bads = {level: Counter() for level in counts}
    for p, h in pages:
        d, s = _levels(h)
        for level, k in (("host", h), ("domain", d), ("suffix", s)):
            counts[level][k] += p in seen
            bads[level][k] += seen.get(p, 0)

    def strong(level):
        n, x = [(c, bads[level][k]) for k, c in counts[level].items() if c], 0
        total, bad = sum(c for c, _ in n), sum(b for _, b in n)
        if len(n) < 2 or not 0 < bad < total:
            return 100.0
        p = bad / total
        x = sum(c * (b / c - p) ** 2 for c, b in n) / (p * (1 - p))
        room = total - sum(c * c for c, _ in n) / total - (len(n) - 1)
        if room <= 0:
            return 100.0
        rho = (x - (len(n) - 1) + math.sqrt(2 * (len(n) - 1))) / room
        return min(max(1 / min(max(rho, 1e-4), 1.0) - 1, 2.0), 1e4)

    m = {level: strong(level) for level in counts}
    usual = (sum(bads["host"].values()) + 1) / (sum(counts["host"].values()) + 10)
    post = lambda level, k, up: (bads[level][k] + m[level] * up) / (counts[level][k] + m[level])
    out = set()
    for h in counts["host"]:
        d, s = _levels(h)
        up = post("domain", d, post("suffix", s, usual))
        a = max(bads["host"][h] + m["host"] * up, 0.5)
        b = max(counts["host"][h] - bads["host"][h] + m["host"] * (1 - up), 0.5)
        if _above(usual, a, b) >= probability:
            out.add(h)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reputation_is_what_the_definitions_say(spark, seed):
    r = random.Random(seed)
    rates = {f"h{i}.d{i % 4}.{'co.uk' if i % 3 else 'net'}": r.choice([0.05, 0.1, 0.5, 0.9]) for i in range(18)}
    pages, labels = [], []
    for h, rate in rates.items():
        for _ in range(r.choice([1, 3, 10, 40])):
            pages.append((len(pages), h))
            if r.random() < 0.6:
                labels.append((pages[-1][0], int(r.random() < rate)))
    labels += labels[:5]
    table = spark.createDataFrame([(i, f"http://{h}/x", 1) for i, h in pages], "page_id long, url string, verdict int")
    known = spark.createDataFrame([(p, 1 - b, 0) for p, b in labels], "doc_id long, quality int, toxic int")
    got = urls.judge(table, known, []).collect()
    assert {x["host"] for x in got if x["verdict"] == "block"} == _brute(pages, labels) and len(got) == len(pages)
    assert 0 < sum(x["verdict"] == "block" for x in got) < len(got)


@pytest.mark.parametrize("bad", [0, 1])
def test_one_label_blocks_no_other_host(spark, bad):
    table = spark.createDataFrame([(i, f"http://h{i}.d{i % 5}.com/") for i in range(50)] * 2, "page_id long, url string")
    got = urls.judge(table, spark.createDataFrame([(0, 1, bad)], "doc_id long, quality int, toxic int"), []).collect()
    assert len(got) == 100 and {x["host"] for x in got if x["verdict"] == "block"} <= {"h0.d0.com"}


# ------------------------------------------------------------ 4
def test_stretches_by_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        w = [r.choice([0, 0, 0, 1, 5, 60]) for _ in range(r.randrange(14))]
        k, surge = r.randrange(1, 5), r.choice([1, 6, 60])
        got = html.stretches(w, k, surge)
        high = [sum(w[min(i, max(0, len(w) - k)) :][:k]) for i in range(len(w))]
        want = []
        for i, h in enumerate(high):
            if h and (not i or not high[i - 1]):
                end = next((j for j in range(i, len(w)) if not high[j]), len(w))
                if max(high[i:end]) >= surge:
                    want.append((i, end))
        assert got == want


TEXT = "A sentence that goes on for long enough to be one of the main text of a page, as it were."
MENU = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(6))


@pytest.mark.parametrize("page, want", [
    # in marked content the distribution decides: a menu of links is a dive, single links are not
    (f"<article><h1>Head</h1><ul>{MENU}</ul><p>{TEXT}</p><p>see <a>this</a></p><p><a>and that</a></p></article>", f"Head\n\n{TEXT}\n\nsee this\n\nand that"),
    (f"<article><p>{TEXT}</p><ul>{MENU}</ul></article>", TEXT),
    (f"<main><p><a>By an author</a></p><p>{TEXT}</p></main>", f"By an author\n\n{TEXT}"),
    # without marks: lists of links and short lines beyond a dive are left out, headings before the text stay
    (f"<div><ul>{MENU}</ul></div><div><h2>Head</h2><p>{TEXT}</p><p>end</p></div><ul>{MENU}</ul><p>small print</p>", f"Head\n\n{TEXT}\n\nend"),
    (f"<p>Site</p><nav>x</nav><p>{TEXT}</p><footer>f</footer><p>c</p>", TEXT),
    ("<ul><li><a>one</a><li><a>two</a></ul>", "one\n\ntwo"), ("<article><p> </p></article>", ""), (f"<p>{'x' * 100_000}</p>", "x" * 100_000),
])
def test_the_distribution_decides(page, want):
    assert html.main_text(page) == want


def test_extract_takes_awkward_tables(spark):
    table = spark.createDataFrame([(1, "u", f"<p>{TEXT}</p>", "t")] * 2 + [(None, "u", None, None)], "page_id long, url string, html string, text string")
    got = Counter(map(tuple, html.extract(table).collect()))
    assert got == Counter({(1, "u", TEXT, len(TEXT)): 2, (None, "u", "", 0): 1})
    assert html.extract(table.where("false")).count() == 0


@pytest.mark.parametrize("page, want", [
    # an element between the lines of another leaves one line empty, so that short blocks before it stay
    (f"<h1>Head</h1><p>short one</p><p>short two</p><aside><p>an aside</p></aside><p>{TEXT}</p>", ["Head", "short one", "short two", TEXT]),
    # paragraphs that are links do not part an article
    ("<article><p>intro</p>" + "".join(f"<p><a href=/{i}>link {i}</a></p>" for i in range(4)) + "<p>end</p></article>", ["intro", "link 0", "link 1", "link 2", "link 3", "end"]),
    # names count whole, if all that they say is beside the text
    (f"<article><p>{TEXT}</p><section class='share-price'><p>12 euro</p></section><div class=related-work><p>They did</p><p>that</p></div><div class='share-box'><p>share</p></div></article>", [TEXT, "12 euro", "They did", "that"]),
    (f"<article><header><h1>Lead</h1><p>lead text</p></header><p>{TEXT}</p><footer>by x</footer></article>", ["Lead", "lead text", TEXT]),
    # short sections between long ones, and what lies between lines
    (f"<div id=a><section><h2>A</h2><p>{TEXT}</p></section><section><h2>B</h2><p>x</p></section><section><h2>C</h2><p>{TEXT}</p></section></div><div><p>fine print</p><p>x</p></div>", ["A", TEXT, "B", "x", "C", TEXT]),
    (f"<p>{TEXT}</p><div><p>a</p><div><p>b</p><p>c</p></div></div><p>{TEXT}</p>", [TEXT, "a", "b", "c", TEXT]),
])
def test_blocks_between_rise_and_dive_stay(page, want):
    assert html.blocks(page) == want


def test_the_distribution_finds_most_articles_without_names_and_marks():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    alone = [html.blocks(h, marks=False, names=False) == html.blocks(h) for (h,) in rows]
    assert sum(alone) >= 0.93 * len(alone)
    assert all(html.blocks(h, **how) == html.blocks(h) for (h,) in rows[:200] for how in ({"marks": False}, {"names": False}))


@pytest.mark.parametrize("page", ["<b>" * 10_000 + "<p>x" * 10_000, "<b><p>" + "<i>" * 20_000 + "</b>" * 20_000, "<div>" * 20_000 + "x", "<div><p>a" * 8_000, "<table><tr><td>x" * 5_000])
def test_deep_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html.main_text(page)
    once = time.process_time() - began
    html.main_text(page * 2)
    assert time.process_time() - began < 6 * max(once, 0.1)


class _Naive(HTMLParser):
    """Well-formed pages as nested lists: (name, beside, items) with (text, weight, item) lines."""

    def __init__(self):
        super().__init__()
        self.stack, self.text = [("", False, [])], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.text.append(("", True))
        elif tag in ("p", "li"):
            self.text = []
        elif tag != "ul":
            self.stack.append((tag, tag in ("nav", "aside", "footer"), []))
            self.stack[-2][2].append(self.stack[-1])

    def handle_data(self, data):
        link = bool(self.text) and self.text[-1] == ("", True)
        self.text.append((data, link))

    def handle_endtag(self, tag):
        if tag == "a":
            self.text.append(("", False))
        elif tag in ("p", "li"):
            whole = " ".join("".join(t for t, _ in self.text).split())
            if whole:
                self.stack[-1][2].append((whole, len(" ".join("".join(t for t, link in self.text if not link).split())), tag == "li"))
        elif tag != "ul":
            name, beside, items = self.stack.pop()
            if name in ("div", "section") and len(items) < 2 and not any(isinstance(x[2], list) for x in items):
                self.stack[-1][2][-1:] = items


def _naive(page):
    """Main text from the definition: heights of all windows of each element's lines, again for every question."""
    p = _Naive()
    p.feed(page)
    root = p.stack[0]
    is_box = lambda x: isinstance(x[2], list)
    seen = []

    def collect(box, inside):
        if not box[1]:
            seen.append((box, inside or box[0] in ("article", "main")))
            for x in box[2]:
                if is_box(x):
                    collect(x, inside or box[0] in ("article", "main"))

    collect(root, False)
    main = [b for b, inside in seen if inside]
    marked = any(not is_box(x) for b in main for x in b[2])
    boxes = main if marked else [b for b, _ in seen]

    def rows(box):
        return [(i, 0 if is_box(x) else x[1]) for i, x in enumerate(box[2]) for _ in range(3 if is_box(x) and x[0] in ("nav", "footer", "header") else 1)]

    def heights(box):
        w = [v for _, v in rows(box)]
        return [sum(w[min(k, max(0, len(w) - 3)) :][:3]) for k in range(len(w))]

    top = max((max(heights(b), default=0) for b in boxes), default=0)
    need = 1 if marked else max(1, -(-3 * top // 10))
    keep = {}

    def take(box, adopted):
        if not any(box is b for b in boxes):
            return
        r, h = rows(box), heights(box)
        if not top:
            keep[id(box)] = {i for i, x in enumerate(box[2]) if not is_box(x)}
        mine, floor, found, k = set(), 1 if adopted else need, [], 0
        link = lambda q: not is_box(box[2][r[q][0]]) and not r[q][1]
        while k < len(r) and top:
            if not h[k]:
                k += 1
                continue
            e = k
            while e < len(r) and h[e]:
                e += 1
            if max(h[k:e]) >= floor:
                a = k
                while a and link(a) and link(a - 1):
                    a += 1
                if found and (marked or adopted) and mine:
                    mine |= {r[q][0] for q in range(found[-1], a) if link(q) and not box[2][r[q][0]][2]}
                own = [r[q][0] for q in range(a, e) if not is_box(box[2][r[q][0]])]
                mine |= set(own)
                mine |= {i for i in range(own[0], own[-1]) if is_box(box[2][i])} if own else set()
                found.append(e)
            k = e
        if top:
            keep[id(box)] = {i for i in mine if not is_box(box[2][i])}
        inner = [i for i, x in enumerate(box[2]) if is_box(x) and any(x is b for b in boxes)]
        high = [i for i in inner if max(heights(box[2][i]), default=0) >= need]
        for i in inner:
            before, after = [j for j in high if j < i], [j for j in high if j >= i]
            flanked = bool(before) and bool([j for j in high if j > i]) and box[2][before[-1]][0] == box[2][after[0]][0] == box[2][i][0]
            take(box[2][i], max(heights(box[2][i]), default=0) > 0 and (adopted or i in mine or flanked))

    for b in [root] if not marked else [b for b in main if b[0] in ("article", "main") and not any(any(y is b for y in _below(c)) for c in main)]:
        take(b, False)
    out = []

    def write(box):
        for i, x in enumerate(box[2]):
            if is_box(x):
                write(x)
            elif i in keep.get(id(box), ()):
                out.append(x[0])

    write(root)
    return out


def _below(box):
    return [y for x in box[2] if isinstance(x[2], list) for y in (x, *_below(x))]


def test_blocks_equal_a_naive_extractor():
    r = random.Random(11)

    def some(depth):
        out = []
        for _ in range(r.randrange(1, 6)):
            kind = r.random()
            words = " ".join("word" for _ in range(r.choice([1, 2, 8, 30])))
            if kind < 0.45 or depth > 3:
                out.append(f"<p>{words}</p>")
            elif kind < 0.55:
                out.append(f"<p><a href=x>{words}</a></p>")
            elif kind < 0.65:
                out.append("<ul>" + "".join(r.choice(["<li><a>link</a></li>", "<li>item</li>"]) for _ in range(r.randrange(1, 6))) + "</ul>")
            else:
                tag = r.choice(["div", "div", "section", "section", "nav", "aside", "footer", "article"] if depth else ["div", "section", "nav", "aside", "footer"])
                out.append(f"<{tag}>{some(depth + 1)}</{tag}>")
        return "".join(out)

    for _ in range(1500):
        page = some(r.randrange(2))
        assert html.blocks(page) == _naive(page), page
