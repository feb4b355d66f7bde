"""Each operator against brute force, and on the awkward inputs that all of them must take."""

import gzip
import hashlib
import itertools
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import bpe, confirm, gru, html, lm, packing, quality, queries, simhash, substring, tiff, urls, warc

R = random.Random(7)
VOCAB = ["".join(R.choice("abcdeéß") for _ in range(R.randrange(1, 7))) for _ in range(60)]
LONG = [R.choice(VOCAB) for _ in range(130)]


def _texts():
    out = [None, "", "  \n ", "one", "one", "a b", "x" * 50_000, " ".join(["w"] * 400)]
    for i in range(60):
        words = [R.choice(VOCAB) for _ in range(R.randrange(1, 200))]
        if i % 3 == 0:
            at, n = R.randrange(len(words) + 1), R.randrange(30, 130)
            words[at:at] = LONG[:n]
        if i % 7 == 0:
            words += words[: len(words) // 2]
        out.append(R.choice([" ", "\n", "  "]).join(words))
    return out + out[20:26]


TEXTS = _texts()
ROWS = [(i if i != 9 else None, t) for i, t in enumerate(TEXTS)] + [(12, TEXTS[12])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, b"y") for r in ROWS], "doc_id long, text string, _id string, _b long, ids binary").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return (t or "").encode().split()


# ------------------------------------------------------------ 1
def _fp(t):
    w = words(t.lower() if t and t.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(docs, empty):
    fps = [_fp(t) for _, t in ROWS]
    comp = list(range(len(ROWS)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i, j in itertools.combinations(range(len(ROWS)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            comp[find(j)] = find(i)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(ROWS):
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(d, least[find(i)])
    want = Counter((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(ROWS))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.select("doc_id").collect()} == {x for _, _, x in want} and one.count() == len({x for _, _, x in want})


def _shingles(t, size):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) > size else {b" ".join(w)}


def _components(n, near):
    comp = list(range(n))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i, j in itertools.combinations(range(n), 2):
        if near(i, j):
            comp[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def _edited(rng, n, words=120, most=6):
    base = [[rng.choice(VOCAB) for _ in range(words)] for _ in range(4)]
    out = []
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_one_large_group(spark, seed):
    """All texts in one candidate group: several classes, chains and many rounds of pivots."""
    texts = sorted({*_edited(random.Random(seed), 60), *(t for t in TEXTS if t)})
    sets = [_shingles(t, 5) for t in texts]
    want = _components(len(texts), lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    rows = [(seed, f"{i:04d}", len(s), confirm.shingle_set(t.encode(), 5).tolist()) for i, (t, s) in enumerate(zip(texts, sets))]
    table = spark.createDataFrame(rows + rows[:3], "_group long, _h string, _n long, _s array<long>")
    got = dict(confirm.classes(table, most_shingles=0 if seed == 1 else confirm.GROUP_SHINGLES).collect())
    first = {}
    for i in range(len(texts)):
        assert first.setdefault(got[f"{i:04d}"], want[i]) == want[i]
    assert len(got) == len(texts) and len(first) == len(set(want)) > 1
    assert all(confirm.shingle_set(t.encode(), 5).size == len(s) for t, s in zip(texts, sets))


def test_confirmed_near_duplicates(spark, docs, empty):
    texts = TEXTS + _edited(random.Random(3), 40, 60, 4)
    texts += [t.replace("a", "A") for t in texts[-3:]] + ["one two", "One two"]
    rows = [(None if i == 9 else i, t, i) for i, t in enumerate(texts)] + [(12, texts[12], 0)]
    fps = [simhash.fingerprint((t or "").encode(), 2) for _, t, _ in rows]
    near = _components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 6)
    sets = [_shingles(t, 5) for _, t, _ in rows]
    comp = _components(len(rows), lambda i, j: near[i] == near[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert len(set(comp)) > len(set(near))
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    table = spark.createDataFrame(rows, "doc_id long, text string, _h long")
    got = simhash.near_duplicates(table, shingle=2, max_diff=6, confirm=(5, 80))
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == Counter((d, least[c]) for (d, _, _), c in zip(rows, comp))
    one = simhash.keep_one(table, shingle=2, max_diff=6, confirm=(5, 80))
    assert one.columns == table.columns and Counter(r["doc_id"] for r in one.collect()) == Counter(set(least.values()))
    assert simhash.keep_one(empty, shingle=2, max_diff=6, confirm=(5, 80)).count() == 0


@pytest.mark.parametrize("confirm", [None, (5, 80)])
def test_keep_one_keeps_a_row_of_each_component(spark, confirm):
    """Null ids and one id with several texts are told apart by the text."""
    r = random.Random(5)
    a, b, c, d, e, f = (" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(6))
    rows = [(None, a, 0), (None, a, 1), (None, b, 2), (None, c, 3), (1, c, 4), (2, d, 5), (2, e, 6), (2, e, 7), (3, e, 8), (4, f, 9), (4, f.upper(), 10), (None, None, 11), (None, "", 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _h long").repartition(3)
    got = [(x["doc_id"], (x["text"] or "").lower()) for x in simhash.keep_one(table, shingle=2, max_diff=2, confirm=confirm).collect()]
    assert Counter(got) == Counter([(None, a), (None, b), (1, c), (2, d), (2, e), (4, f), (None, "")])


def test_near_duplicates_beyond_the_fingerprints(spark):
    """Block additions, removals and word edits: all pairs at 0.8 and more link, as by brute force."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    line = [word() for _ in range(12)]
    texts = ["", " ", "one", "One", *(" ".join(line + [word() for _ in range(n)]) for n in (3, 3, 40, 41, 42, 43, 44, 45, 46))]
    for i in range(60):
        base = [word() for _ in range(r.randrange(20, 300))] + line * (i % 2)
        more = int(len(base) * r.uniform(0.1, 0.24))
        texts += [" ".join(base), " ".join(base + [word() for _ in range(more)]), " ".join(base[int(more * 0.8) :])]
    rows = [(None if i == 9 else i, t) for i, t in enumerate(texts)]
    sets = [_shingles(t, 5) for t in texts]
    alike = lambda i, j: texts[i] == texts[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    comp = _components(len(rows), alike)
    fps = [simhash.fingerprint(t.encode(), 2) for t in texts]
    near = _components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 10)
    assert any(alike(i, j) and near[i] != near[j] for i, j in itertools.combinations(range(len(rows)), 2))
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(table, shingle=2, max_diff=10, confirm=(5, 80), lossless=True)
    assert Counter((x["doc_id"], x["component_id"]) for x in got.collect()) == Counter((d, least[c]) for (d, _), c in zip(rows, comp))


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_gray_index_finds_what_brute_force_finds(k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = np.unique(np.array([b ^ sum(np.uint64(1) << np.uint64(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) if True else b for b in np.repeat(base, 40)], dtype=np.uint64))
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    label = index.components(k)
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= k
    want = np.arange(len(codes))
    while True:
        new = np.where(near, want[None, :], len(codes)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (label == want).all()
    rank = simhash.gray_rank(np.arange(64, dtype=np.uint64) ^ (np.arange(64, dtype=np.uint64) >> np.uint64(1)))
    assert (rank == np.arange(64)).all()


# ------------------------------------------------------------ 2
def test_quality(docs, empty):
    def base(t):
        w = words(t)
        n, hit = len(w), set()
        seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
        for i in range(n - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in (t or "").split("\n") if words(x)]
        return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n

    got = quality.quality(docs).collect()
    assert Counter((r[0], *r[1:7]) for r in got) == Counter((d, *base(t)) for d, t in ROWS)
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in got)


def test_quality_limits_bind_below_the_base_rule():
    """Planted in different words: a passage twice, two words in a row over and over, and short repeats that do no harm."""
    word = [f"w{i}" for i in range(200)]
    planted = [word + word[10:35], word[:56] + ["so", "on"] * 8, word + word[:9] + word[20:29] + word[40:49], word]
    texts = [" ".join(w).encode() for w in planted]
    got = dict(zip((c.split()[0] for c in quality.COLUMNS.split(", ")), (x.tolist() for x in quality.judge(texts))))
    assert got["base_failed"] == [False] * 4 and got["kept"] == [False, False, True, True]
    assert got["covered_words"] == [50, 0, 0, 0] and got["longest_repeat"] == [25, 14, 9, 0]
    assert quality.judge(texts, quality.Limits(max_longest_percent=100))[6].tolist() == [False, True, True, True]
    assert quality.judge(texts, quality.Limits(max_covered=1.0))[6].tolist() == [True, False, True, True]


def test_quality_rules_hold_little_memory(spark, monkeypatch):
    """A text goes to the worker once, and a batch of 4 MB is judged in parts."""
    texts = [" ".join(f"w{(i * 131 + k * 7919) % 50021}" for k in range(500)) for i in range(1200)] + [None, "", "so on " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    caught = []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *rest: caught.append((self, f)) or real(self, f, *rest))
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, "TEXT").collect()) == list(range(1200))
    (sent, run), = caught
    table = sent.toArrow().combine_chunks()
    size = sum(len(t or "") for t in texts)
    assert size > 4e6 and table.nbytes < 1.2 * size
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter(table.to_batches()))) == 1200
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("seed", range(6))
def test_longest_repeats(seed):
    r = random.Random(seed)
    seqs = [[r.choice("ab") if seed % 2 else r.choice("abcdefgh") for _ in range(r.randrange(0, 90))] * r.choice([1, 2]) for _ in range(6)]
    array, _ = quality.repeats([" ".join(s).encode() for s in seqs])
    want, at = [], 0
    for s in seqs:
        for i in range(len(s)):
            best = max((next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), 0) for j in range(len(s)) if j != i), default=0)
            want.append(best if best >= 8 else 0)
    assert array.longest_at().tolist() == want
    spans = set()
    for seq, n, starts in array.intervals(8):
        assert len({tuple(sum(seqs, [])[p : p + n]) for p in starts}) == 1
        spans.update(itertools.chain.from_iterable(range(p, p + n) for p in starts))
    assert spans == set(np.flatnonzero(array.covered(8)).tolist())


# ------------------------------------------------------------ 3
def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x\ny", "<title>T é</title><p>Hi <a href='/q'>you</a></p>", 0), (2, None, None, 0), (None, "u", "", 0)], "page_id long, url string, html string, record int")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 6 and warc.derivatives(pages.where("false")).count() == 0
    blob = b"".join(bytes(r["record"]) for r in rows)
    got = list(warc.parse(gzip.compress(blob)))
    assert len(got) == 6 and not any(e for _, _, e in got)
    by = {h["WARC-Record-ID"]: (h, b) for h, b, _ in got}
    for h, b in by.values():
        assert h["WARC-Block-Digest"] == warc.digest(b) and h["WARC-Refers-To"].startswith("<urn:uuid:")
        if h["WARC-Type"] == "metadata":
            assert by[h["WARC-Concurrent-To"]][0]["WARC-Type"] == "conversion"
    first = [r for r in rows if r["page_id"] == 1]
    assert b"Hi you" in bytes(first[1]["record"]) and b"title: T \xc3\xa9" in bytes(first[0]["record"]) and first[0]["refers_to"] == first[1]["refers_to"]
    assert [e for _, _, e in warc.parse(bytes(first[1]["record"])[:-6])] == ["block cut off"]
    files_ = spark.createDataFrame([(1, blob), (2, None), (3, b"junk")], "id long, data binary")
    assert Counter((r["id"], r["error"]) for r in warc.records(files_, "id", "data").collect()) == Counter({(1, None): 6, (3, "no WARC header"): 1})


# ------------------------------------------------------------ 4
PAGE = "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a>Menu</a></li></ul></nav><div class=ad>Buy</div><div id='cookie-notice'>ok</div>%s<footer>foot</footer></body></html>"


@pytest.mark.parametrize("page, want", [
    (PAGE % "<article><header class='x'></header><h1>A &amp; B</h1><p><b>One<br><p>two\n three &lt;i&gt;&#233;</p><script>var a='</p>'</script><!-- x --><aside>s</aside><p>x</p><section class='comments'><p>troll</p></section></article>", "A & B\n\nOne\n\ntwo three <i>é\n\nx"),
    (PAGE % ("<div><h2>Head line of this page</h2><p>" + "long text " * 20 + "</p><p>short</p><form>f<input></form></div>"), "Head line of this page\n\n" + ("long text " * 20).strip() + "\n\nshort"),
    (None, ""), ("", ""), ("just words", "just words"), ("<article><p>cut <b", "cut"), ("<p>a < b</p>", "a < b"), ("<nav>never closed<article>gone?</article>", ""),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<article><p class=notice>ad<p>One<p>two</article>", "One\n\ntwo"),
    ("<article><ul><li>a<li class=ad>buy<ul><li>this<li>that</ul><li>b</ul><p>c</article>", "a\n\nb\n\nc"),
    ("<main><table><tr><td class=ad>buy<td>a<tr class=ad><td>buy<tr><td>b</table><p>c</main>", "a\n\nb\n\nc"),
    ("<main><table><tr class=ad><td>buy<table><tr><td>this</table>that<tbody><tr><td>a</table></main>", "a"),
    ("<main><dl><dt>a<dd class=ad>buy<p>this<dt>b<dd>c</dl></main>", "a\n\nb\n\nc"),
    ("<main><div><p class=ad>buy <b>this</div>a</main>", "a"), ("<main><p class=ad>buy<h2>a</h2>b</main>", "a\n\nb"),
    ("<main><section><div class=ad>buy</section><p>a</main>", "a"), ("<main><div class=ad>buy</section></span>this<div>that</div></div>a</main>", "a"),
    ("<html><head><meta charset=x><title>t</title><body><p>a", "a"), ("<head><title>t</title><p>a<p>b", "a\n\nb"), ("<head><title>t</title>a", "a"),
    ("<body id=main class=ad><p>a</body>b", "a"),
])
def test_main_text_with_implied_end_tags(page, want):
    assert html.main_text(page) == want


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html.extract(pages).collect()), key=str) == sorted([(1, "u", "é", 1), (None, None, "", 0)], key=str)


# ------------------------------------------------------------ 5
def test_urls(spark):
    cases = {"http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "https://a.example.org/en/12?q": ("a.example.org", "/en/12", "example.org/en/1", "block"), "x://b.org/?": ("b.org", "/", "org/", "allow"), "http://b.org": ("b.org", "", None, None), "http://c.com/fr/x": ("c.com", "/fr/x", "com/fr/", "allow"), "http://notorg/": ("notorg", "/", None, None), "http://c.com/de/#a": ("c.com", "/de/", "com/de/", "block"), "nothing": ("", "", None, None), None: ("", "", None, None)}
    many = [(100 + i, f"http://bad{i % 3}.net/{i}") for i in range(60)] + [(200 + i, f"http://good{i % 3}.net/{i}") for i in range(60)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in [*enumerate(cases), *many]], "page_id long, url string, host int")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(None, 0, 1), (200, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels, queries.RULES).collect()}
    assert len(got) == len(cases) + 120
    for i, (h, p, rule, verdict) in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, p, rule)
        assert verdict in (None, got[i]["verdict"])
    assert {got[100 + i]["verdict"] for i in range(60)} == {"block"} and {got[200 + i]["verdict"] for i in range(60)} == {"allow"}
    assert {r["verdict"] for r in urls.judge(pages, labels.where("false"), []).collect()} == {"allow"} and urls.judge(pages.where("false"), labels, queries.RULES).count() == 0


# ------------------------------------------------------------ 6
def test_lm_base_and_ranking(docs, empty):
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    rows = lm.score(docs, train).collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    low = lambda t: [bytes(w).lower() for w in words(t)] + [b""]
    c = Counter(w for d, t in ROWS if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 6)) for d, t in ROWS)
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows) and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert lm.score(empty, train).count() == 0


def test_gru_gradient_and_carried_state():
    rng = np.random.default_rng(0)
    counts = np.array([9.0, 5, 4, 3, 2, 1])
    first = gru.classes(counts, 3)
    w = gru.start(counts, first, 4)
    texts = [np.r_[rng.integers(0, 5, k), 5] for k in (0, 3, 40, 9)]
    a, b = gru.score(w, first, texts, 5, n_lanes=2, width=3), gru.score(w, first, texts, 5, n_lanes=9, width=64)
    assert np.allclose(a, b, atol=1e-4)
    # probabilities of all continuations add up to one
    one = [gru.score(w, first, [np.array([1, u])], 5)[0] - gru.score(w, first, [np.array([1])], 5)[0] for u in range(6)]
    assert abs(sum(10**x for x in one) - 1) < 1e-5
    many = [np.r_[np.arange(20) % 5, 5] for _ in range(200)]
    better, memory = w, None
    for _ in range(20):
        better, memory = gru.train(better, first, many, 5, memory, n_lanes=8)
    assert gru.score(better, first, many[:1], 5)[0] > 0.3 * gru.score(w, first, many[:1], 5)[0]


# ------------------------------------------------------------ 7, 8
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_equals_the_library(docs, empty, library):
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha(library.decode(ids(t), skip_special_tokens=False).encode())) for d, t in ROWS)
    assert Counter(map(tuple, bpe.digests(docs, queries.vocabulary()).collect())) == want
    back = bpe.decode(bpe.encode(docs, queries.vocabulary()), queries.vocabulary())
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t in ROWS)
    assert bpe.digests(empty, queries.vocabulary()).count() == 0


def test_bpe_odd_characters(library):
    c = bpe.codec(queries.vocabulary())
    r = random.Random(3)
    parts = ["a", "the", "'ll", " ", "  ", "\n", "\t", "é", "字", "1", "٣", "²", "-", "😀", "\x1c", "\x1f", "\x85", "\xa0", "\u180e", "\u200b", "\u3000", "<|endoftext|>", "\x00", "\u0378", "e\u0301", "zzzz", "\U00031350"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert np.frombuffer(c.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        some = [r.randrange(50257) for _ in range(6)]
        assert c.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False).encode()


def test_packing(docs, empty, library):
    rows = packing.pack(docs, queries.vocabulary()).collect()
    ids = {(d, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in ROWS}
    pieces, sequences = Counter(), defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for d, t in ROWS:
        x = ids[d, t]
        for at in range(0, len(x), 1024):
            want[(d, at, len(x[at : at + 1024]), zlib.crc32(x[at : at + 1024].tobytes()), len(x))] += 1
    assert pieces == want
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    assert packing.pack(empty, queries.vocabulary()).count() == 0


def test_plan_uses_every_piece_once():
    r = random.Random(1)
    h = {r.randrange(1, 1025): r.randrange(1, 300) for _ in range(300)}
    got = Counter()
    for n, lengths in packing.plan(h, 1024):
        assert sum(lengths) <= 1024
        got.update({k: n * c for k, c in Counter(lengths).items()})
    assert got == h


# ------------------------------------------------------------ 9
def test_tiff_round_trips():
    r = random.Random(2)
    for _ in range(25):
        d = bytes(r.choice(b"ab ") if r.random() < 0.9 else r.randrange(256) for _ in range(r.randrange(9000)))
        assert tiff.un_lzw(tiff.lzw(d)) == d and tiff.unpack_bits(tiff.pack_bits(d)) == d
        high, wide, deep = r.randrange(1, 40), r.randrange(1, 40), r.choice([1, 3])
        image = np.frombuffer(os.urandom(high * wide * deep), np.uint8).reshape(high, wide, deep)
        for how, p, tile in itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (None, (16, 16))):
            pages = list(tiff.read(tiff.write([image, image[:1]], how, p, 7, tile)))
            assert [x.data for x in pages] == [image.tobytes(), image[:1].tobytes()]


def test_tiff_faults(spark):
    good = tiff.store(b"x" * 500)
    files_ = spark.createDataFrame([(1, good), (2, None), (3, b"II"), (4, good[:-30]), (5, good)], "id long, data binary")
    rows = tiff.explode(files_, "id", "data").collect()
    assert {r["id"]: r["error"] is None for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_stored_digests(docs, empty):
    for r in tiff.stored_digests(docs).collect():
        t = next(t or "" for d, t in ROWS if d == r["doc_id"]).encode()
        p = t + b" " * (-len(t) % 192 if t else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(tiff.store(t)).hexdigest()
    assert tiff.stored_digests(empty).count() == 0


# ------------------------------------------------------------ 10
def test_substring_dedup(docs, empty):
    first = {}
    for d, t in ROWS:
        w = words(t)
        for i in range(len(w) - 49 if d is not None else 0):
            k = tuple(w[i : i + 50])
            first[k] = min(d, first.get(k, d))
    want = Counter()
    for d, t in ROWS:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        left = b" ".join(x for x, k in zip(w, keep) if k)
        want[d, len(w), keep.count(False), hashlib.sha256(left).hexdigest()] += 1
    assert sum(n for _, _, n, _ in want) > 0
    assert Counter(map(tuple, substring.digests(docs).collect())) == want
    assert substring.digests(empty).count() == 0
    out = substring.dedup(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest()) for r in out.collect()) == Counter({(d, s): n for (d, _, _, s), n in want.items()})
    assert Counter((r["doc_id"], r["text"] is None) for r in out.collect()) == Counter((d, t is None) for d, t in ROWS)


@pytest.mark.parametrize("size", [3, 5, 8])
def test_fm_index_finds_all_places(size):
    r = random.Random(size)
    texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(size, 30))] for _ in range(25)]
    owner = np.array([r.randrange(100) for _ in texts])
    windows = np.array([len(t) - size + 1 for t in texts])
    got = substring.FMIndex(texts, owner, size).matches(windows).tolist()
    want = [min(o for o, u in zip(owner.tolist(), texts) if any(u[j : j + size] == t[i : i + size] for j in range(len(u)))) for t in texts for i in range(len(t) - size + 1)]
    assert got == want


# ------------------------------------------------------------ all
def test_pipeline_stages(spark, docs, library):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, plain, "")
        assert out.columns == plain.columns, name
        before, after = Counter(r[0] for r in plain.collect()), Counter(r[0] for r in out.collect())
        assert not after - before, name
        plain = spark.createDataFrame(out.collect(), plain.schema)
    assert plain.count() and corpus_pipeline.STAGES[-1][1](spark, plain, "").count() >= plain.count()


def test_queries_are_named_for_their_operators():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 14))


def test_training_reuses_one_tape(monkeypatch):
    """A pass over many windows, fewer lanes at its end, takes memory for steps once and comes to what fresh memory gives."""
    import numpy as np

    from graphloom.llm import gru

    r = np.random.default_rng(3)
    counts = np.sort(r.integers(1, 500, 60))[::-1].astype(float)
    first = gru.classes(counts, 6)
    texts = [np.r_[r.integers(0, 60, n), 7] for n in r.integers(1, 90, 40)]
    made, tape = [], gru._Tape
    monkeypatch.setattr(gru, "_Tape", lambda *a: made.append(a) or tape(*a))
    w, _ = gru.train(gru.start(counts, first, 8), first, texts, 7, n_lanes=16)
    assert made == [(16, 16, 8)]
    views = tape.views
    monkeypatch.setattr(tape, "views", lambda self, *a: [np.full_like(x, np.nan) for x in views(self, *a)])
    again, _ = gru.train(gru.start(counts, first, 8), first, texts, 7, n_lanes=16)
    assert all(np.array_equal(w[k], again[k]) and np.isfinite(w[k]).all() for k in w)


def test_scoring_takes_few_windows_for_long_texts(monkeypatch):
    """A long text goes on in windows of as many places as those of all lanes, and scores as in narrow ones."""
    import numpy as np

    from graphloom.llm import gru

    r = np.random.default_rng(4)
    counts = np.sort(r.integers(1, 500, 40))[::-1].astype(float)
    first = gru.classes(counts, 5)
    w = gru.start(counts, first, 8)
    texts = [np.r_[np.where(u == 7, 6, u), 7] for u in (r.integers(0, 40, n) for n in [5000, 900, *r.integers(0, 60, 300)])]
    narrow = np.concatenate([gru.score(w, first, [t], 7, n_lanes=1, width=32) for t in texts])
    calls, forward = [], gru._forward
    monkeypatch.setattr(gru, "_forward", lambda w, units, *a: calls.append(units.shape) or forward(w, units, *a))
    assert np.allclose(gru.score(w, first, texts, 7, n_lanes=64, width=32), narrow, rtol=1e-5)
    assert len(calls) < 30 and max(a * b for a, b in calls) <= 64 * 32
    # every place lies in one window, whatever rows allow
    for rows in (0, 50, 2048, 10**6):
        got = [(units[real], text[real]) for units, text in gru.windows(texts, 16, 8, 7, rows) for real in [text >= 0]]
        which, units = np.concatenate([t for _, t in got]), np.concatenate([u for u, _ in got])
        assert all(np.array_equal(np.sort(units[which == i]), np.sort(t)) for i, t in enumerate(texts))


def test_gradients_of_units_are_summed_whole():
    """Sums by unit are those of numpy's slow way: units with one row, with few and with more than are added at once."""
    import numpy as np

    from graphloom.llm import gru

    r = np.random.default_rng(5)
    for numbers, below in ((np.r_[np.zeros(500, int), r.integers(0, 70, 900), 99], 100), (np.array([3]), 4), (np.full(24, 2), 3), (np.full(25, 2), 3), (np.full(1, 70_000), 70_001)):
        rows = r.normal(size=(len(numbers), 6)).astype(np.float32)
        want = np.zeros((below, 6))
        np.add.at(want, numbers, rows)
        found, got = gru._sums(rows, numbers, below)
        assert sorted(found.tolist()) == sorted(set(numbers.tolist())) and np.allclose(got, want[found], atol=1e-4)
