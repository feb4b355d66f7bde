"""Personal data, the prefix trie of conversations and periodic runs, against brute force and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from graphloom.llm import oracles, private, runs, trie

R = random.Random(5)


def same_as_sql(df, sql, views):
    con = duckdb.connect()
    for name, frame in views.items():
        con.register(name, frame.toArrow())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(map(tuple, rel.fetchall()))
    assert Counter(map(tuple, df.select(*names).collect())) == want and want


# ------------------------------------------------------------ 11
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x for i, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def _spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _holds(k, m[0])]


PIECES = ["a@b.c", "_d@e.f", ".@x.yz", "é", "@", "..", "1.2.3.4", "256.1.1.1", "5.6", "4111111111111111", "4111-1111 1111 1111", "+1 (136) 555-7479", "+49 30 1234567", " ", "\n", "x", "+", "00001.002.3.255", "12345678901234567890123", "字", "-", "@@a.b", "a%b@c-d.e.", "(", "0"]


def test_patterns_equal_leftmost_matches(spark):
    texts = [None, "", "x" * 10_000, "9" * 50_000, "a@b.c " * 3000, "1 " * 5000 + "+" + "1 " * 4000, "a@b" * 30_000, ".a@b.c" * 500] + ["".join(R.choice(PIECES) for _ in range(R.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = private.base(df, "doc_id", "text", 20).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(s) for s in r["spans"]] == _spans(texts[r["id"]])


@pytest.fixture(scope="module")
def letters(spark):
    """A name beside an address in eight different texts, once alone; another in copies of one text only."""
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "st", "mm", "lo")]
    texts = [" ".join(R.choice(words) for _ in range(60)) for _ in range(400)]
    for i in range(8):
        w = texts[i].split()
        w[30:30] = ["Zephyrine,", "wrote", "to", "Anna.Q@mail.example.com", "é"]
        texts[i] = " ".join(w)
    texts[20] += " (Zephyrine) zephyrine."
    texts[30:35] = [texts[29] + " Quux said bob@x.example.org again"] * 5
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts + [None, "", texts[3]])]
    return spark.createDataFrame(rows, "doc_id long, text string, key string")


def test_disclosing_terms(spark, letters):
    got = private.personal_data(letters)
    same_as_sql(got, oracles.personal(), {"documents": letters})
    n = {r["doc_id"]: r["n_term"] for r in got.collect()}
    assert all(n[i] == 2 for i in range(8)) and n[20] == 2 and sum(x > 0 for x in n.values()) == 10  # and the repeated text
    strict = private.personal_data(letters, model=private.Disclosure(support=20))
    assert strict.where("n_term > 0").count() == 0
    assert private.personal_data(letters.where("false")).count() == 0
    with pytest.raises(ValueError):
        private.personal_data(letters.withColumnRenamed("doc_id", "spans"), "spans")


def test_entities_without_words_beside_them(spark, letters, monkeypatch):
    """Texts that are an entity alone, beside terms that disclose another; also where nothing is small enough to be sent."""
    alone = spark.createDataFrame([(1000, "alone@x.org", "x"), (1001, "!! 10.1.2.3 ,,", "x"), (1002, "+49 30 1234567", "x")], letters.schema)
    docs = letters.unionByName(alone)
    got = private.personal_data(docs)
    same_as_sql(got, oracles.personal(), {"documents": docs})
    assert got.where("n_term > 0").count() == 10
    monkeypatch.setattr(private, "SENT", 0)
    same_as_sql(private.personal_data(docs), oracles.personal(), {"documents": docs})


def test_sanitised(spark, letters):
    taxonomy = spark.createDataFrame([("zephyrine", "a person"), ("wrote", "zephyrine")], "term string, general string")
    out = private.sanitised(letters, taxonomy=taxonomy)
    assert out.columns == letters.columns and out.count() == letters.count()
    before, after = ({r["doc_id"]: r["text"] for r in df.where("doc_id IS NOT NULL").collect()} for df in (letters, out))
    for i, text in before.items():
        want = text
        if i < 9 or i == 402:
            want = text.replace("Zephyrine", "a person").replace("wrote", "[removed]").replace("Anna.Q@mail.example.com", "[email]")
        elif i == 20:
            want = text.replace("Zephyrine", "a person").replace("zephyrine", "a person")
        elif text:
            want = text.replace("bob@x.example.org", "[email]")
        assert after[i] == want
    mixed = [("é 字 1.2.3.4 x +49 30 1.2.3.456",), ("a@1.2.3.4\n",), (None,), ("",)]
    got = private.sanitised(spark.createDataFrame(mixed, "text string").withColumn("doc_id", private.F.lit(1))).collect()
    assert [r["text"] for r in got] == ["é 字 [ip] x [phone]", "[email]\n", None, ""]


def test_running_sums(spark):
    r = random.Random(1)
    lists = [[], [5], [r.randrange(9) for _ in range(256)], [r.randrange(9) for _ in range(257)], [r.randrange(9) for _ in range(5000)]]
    df = spark.createDataFrame([(x,) for x in lists], "a array<bigint>")
    for got, a in zip(df.select(private.running(private.F.col("a"))).collect(), lists):
        assert got[0] == [sum(a[: i + 1]) for i in range(len(a))]


# ------------------------------------------------------------ 12
def _trie(rows, group=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    base = lambda c: own.get(c - (c % group if c >= 0 else -(-c % group)), [])
    full = {c: base(c)[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(set)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    n_words = lambda p: len(p[-1][1].encode().split()) if p else 0
    out = Counter()
    for p in members:
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p))))
        out[(min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), sum(not kids[q] for q in below), sum((len(members[q]) - 1) * n_words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def _talks(seed, n=70):
    r = random.Random(seed)
    say = ["a", "b c", "é x\x0by", "", None, " z  z "]
    rows = []
    for c in r.sample(range(-30, 3000), n // 2) + r.sample(range(60), n // 2):
        rows += [(c, r.choice([t, t, None, 0]), r.choice(["user", "bot", None]), r.choice(say)) for t in range(r.randrange(1, 7))]
    for c in range(4000, 4030):  # copies
        rows += [(c, t, "user", f"t{t}") for t in range(5)]
    return rows + rows[:3] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_trie(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(trie, "BLOCK", 2)
        monkeypatch.setattr(trie, "ID_RANGE", 7)
    rows = _talks(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS c", "1 AS d", "2 AS words").repartition(3)
    got = trie.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == _trie(rows)
    same_as_sql(got, oracles.trie(), {"conversations": df.select("conv_id", "turn", "role", "text")})
    assert trie.conversation_trie(df.where("false")).count() == 0


# ------------------------------------------------------------ 13
def _runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2]))


def _lists(r):
    out = []
    for _ in range(r.randrange(1, 5)):
        n, kind = r.randrange(120), r.randrange(3)
        if kind == 0:
            w = [r.choice([b"a", b"b"]) for _ in range(n)]
        elif kind == 1:
            w = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, 9))] * 120)[:n]
            for _ in range(r.randrange(3) if w else 0):
                w[r.randrange(len(w))] = r.choice([b"a", b"b", b"z"])
        else:
            w = [str(r.randrange(30)).encode() for _ in range(n)]
            w += w[:20] * 4
        out.append(w)
    return out


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        lists = _lists(r)
        for limits in ((6, 4), (2, 2), (5, 3)):
            assert runs.document_runs(lists, *limits) == [_runs(w, *limits) for w in lists]
    assert runs.document_runs([]) == [] and runs.document_runs([[], [b"a"]]) == [[], []]
    assert runs.least_overlap(6, 4) == 5
    assert runs.document_runs([[b"a"] * 30_000, [b"x", b"y", b"z"] * 9000]) == [[(0, 30_000, 1)], [(0, 27_000, 3)]]


def test_wrong_hashes_are_drawn_anew(monkeypatch):
    first = runs.Extensions.agree
    monkeypatch.setattr(runs.Extensions, "agree", lambda self, i, p, t: first(self, i, p, t) | (self.seed == 1))
    init = runs.Extensions.__init__

    def seeded(self, y, seed):
        init(self, y, seed)
        self.seed = seed

    monkeypatch.setattr(runs.Extensions, "__init__", seeded)
    w = [b"a", b"b"] * 8 + [b"c"] + [b"a", b"b"] * 9
    assert runs.document_runs([w]) == [_runs(w)]


def test_run_digests(spark):
    r = random.Random(4)
    texts = [b" ".join(w).decode() for _ in range(60) for w in _lists(r)]
    rows = [(i if i != 9 else None, t, 1) for i, t in enumerate([None, "", " \n\t ", "one", "é é é é é é é", "w " * 20_000] + texts)] + [(12, texts[3], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int").repartition(3)
    got = runs.run_digests(df, planted=True)
    want = Counter()
    for i, t, _ in rows:
        w = runs.rewritten((t or "").encode().split(), i)
        found = _runs(w) if len(w) < 5000 else [(0, 20_000, 1)]
        best = sorted(found, key=lambda x: (-x[1], x[0], x[2]))[:1]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        s, n, p = best[0] if best else (None, None, None)
        want[(i, len(found), s, n, p, 1000 * n // p if p else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())] += 1
    assert Counter(map(tuple, got.collect())) == want
    small = df.where("length(text) < 5000 OR text IS NULL")
    same_as_sql(runs.run_digests(small, planted=True), oracles.runs(), {"documents": small.select("doc_id", "text")})
    whole = {r["doc_id"]: r for r in runs.collapsed(df).collect()}
    assert whole[4]["text"] == "é" and whole[4]["runs"][0].length == 7 and whole[0]["text"] == "" and whole[0]["runs"] == []
    assert runs.run_digests(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.run_digests(df, "n_runs")


def test_planted_period():
    w = [str(i).encode() for i in range(100)]
    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    g = zlib.crc32(str(hit).encode()) // 10
    a = g % 100
    p = 1 + (100 - a) // (3 + g % 8)
    assert runs.rewritten(w, hit) == [w[i] if i < a else w[a + (i - a) % p] for i in range(100)]
    assert runs.rewritten(w, None) == w and runs.rewritten([], hit) == []
