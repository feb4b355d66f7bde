import csv
import io
import json
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions.text import indel_ratio, normalize_text
from graphloom.operators import graph as G
from graphloom.operators import refine, resolve
from graphloom.plans import catalogue
from graphloom.sinks import export
from graphloom.sources import files, providers
from graphloom.streaming.inbox import follow

NODE = "graph_ord long, node_ord long, orig_id string, label string, type string, properties map<string,string>, description string"
EDGE = "graph_ord long, edge_ord long, source string, target string, type string, label string, properties map<string,string>, evidence string"


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_merge_and_prune(spark):
    n, e = frames(spark, [(0, 0, "a", " Acme ", "Org", {"x": "1", "y": "1"}, ""), (0, 1, "b", "Bob", "Person", {}, ""), (1, 0, "q", "acme", "org", {"x": None}, "firm"), (1, 1, "q2", "Acme", "Place", {}, ""), (1, 2, None, "", None, {}, None)], [(0, 0, "b", "a", "WORKS_AT", "", {}, "one"), (0, 1, "b", "zz", "X", "", {}, ""), (1, 0, "q", "q", "SELF", "", {}, ""), (1, 1, "q2", "q", None, None, {}, None)])
    nodes, edges = resolve.merge(n, e, 90)
    rows = {r["id"]: r for r in nodes.collect()}
    assert [(r["label"], r["type"]) for _, r in sorted(rows.items())] == [("Acme", "Org"), ("Bob", "Person"), ("Acme", "Place"), ("", "Nodo")]
    assert rows["n1"]["properties"] == {"x": None, "y": "1"} and rows["n1"]["description"] == "firm"
    kept = resolve.prune(nodes, edges).collect()
    assert {(r["source"], r["target"], r["type"]) for r in kept} == {("n2", "n1", "WORKS_AT"), ("n3", "n1", "RELAZIONATO_A")}
    s = G.stats(nodes, resolve.prune(nodes, edges)).first()
    assert (s["nodes"], s["edges"], s["isolated"], s["node_types"]["Org"]) == (4, 2, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_merge_is_the_sequential_one(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 25))) for _ in range(40)]
    for w in words[:25]:
        w = list(w)
        w[r.randrange(len(w))] = r.choice("abcd")
        words.append("".join(w))
    r.shuffle(words)
    heads, expect = [], {}
    for w in words:
        k = normalize_text(w)
        if k not in expect:
            expect[k] = next((h for h in heads if indel_ratio(h, k) >= 85), k)
            if expect[k] == k:
                heads.append(k)
    n, _ = frames(spark, [(0, i, str(i), w, "T", {}, "") for i, w in enumerate(words)], [])
    assert {x["norm"]: x["rep"] for x in resolve.entities(n, 85).collect()} == expect


def test_fuzzy_merge_takes_words_of_all_lengths(spark, tmp_path):
    """The query on a small table is the sequential merge over all words; short words have partners too."""
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(n)) for n in (*range(1, 24), 32, 45, 5, 5, 6, 9, 10, 11)]
    for w in words[:]:
        at = r.randrange(len(w))
        words += [w[:at] + r.choice("xy") + w[at:], w[:at] + r.choice("xy") + w[at + 1 :]]
    r.shuffle(words)
    texts = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    heads = []
    rep = {}
    for w in words:
        k = normalize_text(w)
        if k not in rep:
            rep[k] = next((h for h in heads if indel_ratio(h, k) >= 90), k)
            if rep[k] == k:
                heads.append(k)
    got = catalogue.queries()["fuzzy_merge"](spark, str(tmp_path)).collect()
    assert sorted(x["rep"] for x in got) == sorted(heads) and any(len(k) < 12 and rep[k] != k for k in rep)


def test_fuzzy_merge_combines_equal_words_first(spark, tmp_path, monkeypatch):
    """Equal words reach the entities once, with their first place."""
    texts = ["beta alpha beta  Beta", None, "alpha gamma beta", ""]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    given, entities = [], resolve.entities
    monkeypatch.setattr(resolve, "entities", lambda nodes, *a: given.append(nodes) or entities(nodes, *a))
    got = {(r["rep"], r["label"]) for r in catalogue.queries()["fuzzy_merge"](spark, str(tmp_path)).collect()}
    assert got == {("beta", "beta"), ("alpha", "alpha"), ("gamma", "gamma"), ("", "")}
    assert sorted((r["label"], r["graph_ord"], r["node_ord"]) for r in given[0].collect()) == [("", 3, 0), ("Beta", 0, 3), ("alpha", 0, 1), ("beta", 0, 0), ("gamma", 2, 1)]


def test_fuzzy_merge_reads_the_texts_once_and_looks_for_no_components(spark, tmp_path, monkeypatch):
    """Texts are read for the entities alone; few open pairs are decided without their components."""
    texts = ["alphabetical alphabetican order", None, " beta\x0bgamma\u00a0x\t", "alphabeticam beta"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(resolve, "components", lambda edges: pytest.fail("components of a few pairs"))
    got = catalogue.queries()["fuzzy_merge"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("alphabetical", "alphabetical"), ("order", "order"), ("", ""), ("beta", "beta"), ("gamma x", "gamma\u00a0x")}
    assert "documents.parquet" not in got._jdf.queryExecution().toString()


def test_first_words_are_those_of_spark(spark, monkeypatch):
    """Each word where it stands first, also of texts with the same number, in slices of any size."""
    rows = [(2, " a b\x1cc  a "), (1, "b a"), (2, "x y z b"), (None, "q\na\r\x0b\x0cq"), (5, None), (3, ""), (1, "z\u2003y a \u00e9\u00e9"), (7, " ")]
    t = spark.createDataFrame(rows, "doc_ord long, text string").coalesce(1)
    at = F.min(F.struct("doc_ord", "pos"))
    want = {tuple(r) for r in t.select("doc_ord", F.posexplode(F.split("text", r"\s+")).alias("pos", "label")).groupBy("label").agg(at.alias("at")).select("label", "at.*").collect()}
    batch = t.toArrow().combine_chunks().to_batches()
    for size in (4, 1 << 24):
        monkeypatch.setattr(catalogue, "WORDS_AT_ONCE", size)
        found = [r for b in catalogue._first_words(iter(batch)) for r in b.to_pylist()]
        got = spark.createDataFrame([(r["doc_ord"], r["pos"], r["label"]) for r in found], "doc_ord long, pos int, label string").groupBy("label").agg(at.alias("at")).select("label", "at.*")
        assert {tuple(r) for r in got.collect()} == want
    assert len(found) == len(want)


def test_blocks_of_longer_labels_are_few(spark):
    """What is left of a label by leaving characters out makes a block only where it can be a label; all pairs are found."""
    r = random.Random(3)
    labels = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in range(11, 15) for _ in range(50)]
    labels += [w[:3] + w[5:] for w in labels[50:60]]
    rows = spark.createDataFrame([(i, 1, w) for i, w in enumerate(labels)], "_id long, _s long, norm string")
    table = resolve._table(rows, 90)
    whole = sum(len(b) for b in resolve._blocks(iter(rows.toArrow().to_batches()), 90, True, table))
    assert whole < 20 * len(labels) < 60 * len(labels) < sum(len(b) for b in resolve._blocks(iter(rows.toArrow().to_batches()), 90, True))
    got = resolve.similar_pairs(spark.createDataFrame([("s", w, i) for i, w in enumerate(labels)], "scope string, norm string, ord long"), 90)
    assert {(x["norm"], x["other"]) for x in got.collect()} == {(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :] if indel_ratio(a, b) >= 90}


def test_labels_with_an_end_in_common_are_no_candidates(spark):
    """Of addresses with one ending only the similar ones meet; pieces of the ending would make all pairs of two lengths."""
    r = random.Random(8)
    labels = list(dict.fromkeys("".join(r.choice("abcdefghijklmnop") for _ in range(n)) + f"{r.randrange(100):02}mail{r.randrange(10)}examplecom" for n in range(3, 9) for _ in range(40)))
    labels += [w[:2] + w[4:] for w in labels[-5:]] + ["x" + w[2:] for w in labels[-20:-10]]
    rows = spark.createDataFrame([(i, 1, w) for i, w in enumerate(labels)], "_id long, _s long, norm string")
    table = resolve._table(rows, 90)
    # a block joins all that are in it
    sides = [{}, {}]
    for longer, side in enumerate(sides):
        for b in resolve._blocks(iter(rows.toArrow().to_batches()), 90, bool(longer), table):
            for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                side.setdefault(k, set()).add(i)
    met = {(min(i, j), max(i, j)) for k, x in sides[0].items() for i in x for j in sides[1].get(k, ()) if i != j}
    want = {(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels)) if indel_ratio(labels[i], labels[j]) >= 90}
    assert met == want and len(want) >= 15


@pytest.mark.parametrize("most", [0, 9, 20, 1000])
def test_entities_of_chains_and_of_dense_pairs(spark, most):
    """Rounds, components in one task each and all in one task come to the sequential result."""
    r = random.Random(most)
    chains = [[(k * 100 + i, k * 100 + i + 1) for i in range(n)] for k, n in enumerate([8] * 12 + [14])]
    dense = {tuple(sorted(r.sample(range(5000, 5040), 2))) for _ in range(150)}
    pairs = sorted({*dense, *(p for c in chains for p in c)}, key=lambda p: p[::-1])
    near = {}
    for u, v in pairs:
        near.setdefault(v, []).append(u)
    want = {}
    for v in sorted(near):
        want |= {v: min(heads)} if (heads := [u for u in near[v] if u not in want]) else {}
    assert {tuple(x) for x in resolve._heads(spark.createDataFrame(pairs, "u long, v long"), most).collect()} == set(want.items())


@pytest.mark.parametrize("threshold", [70, 90])
def test_similar_pairs_are_all_pairs_of_their_ratio(spark, threshold):
    """Labels of all lengths and scripts, with edits of each; scopes stay apart."""
    r = random.Random(threshold)
    labels = ["", "aa", "aaaaaaaaaaa"] + ["".join(r.choice("ab\u00e9\U0001f600") for _ in range(n)) for n in (*range(1, 16), 20, 33, 60, 130)]
    for w in labels[3:]:
        for _ in range(2):
            at = r.randrange(len(w))
            labels.append(w[:at] + r.choice(["", "x", "\u00e9b"]) + w[at + r.randrange(2) :])
    labels = list(dict.fromkeys(labels))
    rows = [(f"s{i % 2}" if i % 5 == 0 else "s", w, i) for i, w in enumerate(labels)]
    got = resolve.similar_pairs(spark.createDataFrame(rows, "scope string, norm string, ord long"), threshold).collect()
    want = {(s, a, i, b, j) for s, a, i in rows for t, b, j in rows if s == t and i < j and a and b and indel_ratio(a, b) >= threshold}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_two_levels(spark):
    n, e = frames(spark, [(g, i, f"{g}{i}", w, "T", {}, "") for g, ws in enumerate([["Alpha", "Beta"], ["Alpha"], ["Beta"]]) for i, w in enumerate(ws)], [(0, 0, "00", "01", "R", "", {}, "")])
    nodes, edges = resolve.merge_two_levels(n.withColumn("doc_ord", F.col("graph_ord")), e.withColumn("doc_ord", F.col("graph_ord")), 101)
    assert sorted(r["label"] for r in nodes.collect()) == ["Alpha", "Beta"] and edges.count() == 1


def test_refine(spark):
    n = spark.createDataFrame([(1, "n1", "A", "T", {}, ""), (2, "n2", "B", "T", {}, "")], "ord long, id string, label string, type string, properties map<string,string>, description string")
    e = spark.createDataFrame([(0, 0, "n1", "n2", "RELATED_TO", "", {"a": "1"}, ""), (0, 1, "n2", "n1", "OWNS", "owns", {}, "")], EDGE)
    better = refine.enrich(n, e, lambda q: '[{"_idx": 0, "type": "lives in", "label": "x", "properties": {"a": "2"}}, {"_idx": 99, "type": "BAD"}]')
    got = {r["edge_ord"]: r for r in better.collect()}
    assert got[0]["type"] == "LIVES_IN" and got[0]["properties"] == {"a": "2"} and got[1]["type"] == "OWNS"
    assert [r["type"] for r in refine.verify(n, e, lambda q: '[{"idx": 0, "valid": false, "reason": ""}]').collect()] == ["OWNS"]
    assert refine.verify(n, e, lambda q: "").count() == 2


def test_chat_retries():
    naps, calls = [], []

    def post(path, body):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("down")
        return {"choices": [{"message": {"content": "hi"}}]}

    assert providers.Chat(Config(), naps.append, post)("x") == "hi" and naps == [2, 4]
    naps.clear()
    assert providers.Chat(Config(), naps.append, lambda p, b: {"choices": []})("x") == "" and naps == [2, 4]
    assert providers.Chat(Config(), post=lambda p, b: {"data": [{"id": "m"}]}).discover() == "m"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    (tmp_path / "b.csv").write_text("n,città\n1,2\n3\n")
    (tmp_path / "c.jsonl").write_text("\n".join(['{"i": %d}' % i for i in range(120)] + ["bad"]))
    (tmp_path / "d.json").write_text('{"é": 1}')
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    got = {r["name"]: r["text"] for r in files.texts(files.read_files(spark, [str(tmp_path)])).collect()}
    assert got["a.txt"] == "ok �" and "1 righe" not in got["b.csv"] and "2 righe, 2 colonne" in got["b.csv"] and "| 3 |" in got["b.csv"]
    assert len(json.loads(got["c.jsonl"])) == 100 and got["d.json"] == '{\n  "é": 1\n}'
    assert got["e.docx"] == "## Top\n\nbody\n\n[TABELLA 1]\n| x |"


def test_merge_files_reports_what_is_no_graph(spark, tmp_path):
    from graphloom import merge_files

    for i, body in enumerate(['{"nodes": [{"id": 1, "label": "A", "type": "T", "properties": {"k": [1]}}], "edges": []}', "[1]", '{"nodes": [{"id": "x", "label": "a", "type": "t"}, {"id": "y", "label": "B"}], "edges": [{"source": "x", "target": "y"}]}', "{"]):
        (tmp_path / f"{i}.json").write_text(body)
    nodes, edges, bad = merge_files(spark, [str(tmp_path)])
    assert nodes.count() == 2 and edges.count() == 1 and bad.count() == 2
    out = export.graph_json(nodes, catalogue.ordered(edges))
    assert out["nodes"][0]["properties"] == {"k": [1]}


def test_sinks_read_back(spark, tmp_path):
    odd = "it's </script> \"a\" & <b> \\ \n end"
    n = spark.createDataFrame([(1, "n1", odd, "T y", {"p": odd}, odd), (2, "n2", "B", "U", {}, "")], "ord long, id string, label string, type string, properties map<string,string>, description string")
    e = spark.createDataFrame([(0, "n1", "n2", "REL", odd, {}, odd)], "ord long, source string, target string, type string, label string, properties map<string,string>, evidence string")
    done = export.export_all(n, e, str(tmp_path / "a.b"), ["json", "html", "graphml", "neo4j", "turtle", "cypher", "nope"])
    assert done["nope"].startswith("unknown") and not any(v.startswith("failed") for v in done.values()), done
    assert json.loads((tmp_path / "a.b.json").read_text())["nodes"][0]["label"] == odd
    root = ElementTree.parse(tmp_path / "a.b.graphml").getroot()
    assert root[-1][0][0].text == odd and len(root[-1]) == 3
    with (tmp_path / "a.b_nodes.csv").open(newline="") as f:
        raw = f.read()
    rows = list(csv.reader(raw.splitlines(keepends=True)))
    want = io.StringIO()
    csv.writer(want).writerows(rows)
    assert rows[0][0] == ":ID" and rows[1][1] == odd and rows[2][:2] == ["n2", "B"] and raw == want.getvalue() and raw.count("\r\n") == 3
    assert not [p.name for p in tmp_path.iterdir() if ".parts-" in p.name or ".new-" in p.name or p.name.endswith(".crc")]
    page = (tmp_path / "a.b.html").read_text()
    assert page.count("</script>") == 2 and "2 nodes, 1 edges, 2 types" in page
    assert "\\'" in (tmp_path / "a.b.cypher").read_text() and len((tmp_path / "a.b.ttl").read_text().splitlines()) == 6


def test_palette_wraps(spark):
    n = spark.createDataFrame([(i, f"n{i}", "x", f"t{i}", {}, "") for i in range(16)], "ord long, id string, label string, type string, properties map<string,string>, description string")
    c = {r["type"]: r["color"] for r in G.type_colors(n).collect()}
    assert c["t0"] == c["t15"] and len(set(c.values())) == 15


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Hello " * 100)
    (tmp_path / "in/b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in/c.docx").write_bytes(b"no archive")
    log = tmp_path / "log"

    class Flaky:
        name, error = "flaky", ""

        def __init__(self, up):
            self.up, self.log = up, str(log)

        def __call__(self, request):
            with open(self.log, "a") as f:
                f.write("x\n")
            if "Hello" in request and len(request) % 2 and not self.up:
                self.error = "down"
                return ""
            return '{"nodes": [{"id": "1", "label": "H"}], "edges": []}'

    config = Config(chunk_size=151, chunk_overlap=20)

    def go(up):
        log.write_text("")
        q = follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), Flaky(up), config)
        assert q.awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["name"], r["chunk_idx"] if r["chunk_idx"] is not None else -1, r["status"]) for r in rows), len(log.read_text().split())

    first, n = go(False)
    assert first == [("b.csv", 0, "ok"), ("c.docx", -1, "no_text")] and n > 2
    again, down = go(False)
    assert again == first and down == n - 1  # only what failed
    third, up = go(True)
    chunks = [x for x in third if x[0] == "a.txt"]
    assert [i for _, i, _ in chunks] == list(range(n - 1)) and {s for _, _, s in chunks} == {"ok"} and up == down
    assert go(True) == (third, 0)
    (tmp_path / "in/d.txt").write_text("more")
    fourth, n = go(True)
    assert n == 1 and set(fourth) - set(third) == {("d.txt", 0, "ok")}
    docs = {r["name"]: r["doc_ord"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert docs["a.txt"] < docs["b.csv"] < docs["c.docx"] < docs["d.txt"]


def test_command_line(spark, tmp_path, capsys):
    from graphloom.cli import main

    (tmp_path / "g.json").write_text('{"nodes": [{"id": "1", "label": "A"}, {"id": "2", "label": "B"}], "edges": [{"source": "1", "target": "2", "type": "R"}]}')
    assert main([str(tmp_path / "g.json"), "--merge-jsons", "--stats", "-o", str(tmp_path / "x.y"), "--export", "cypher"]) == 0
    assert (tmp_path / "x.y.html").exists() and (tmp_path / "x.y.cypher").exists()
    assert main([str(tmp_path / "g.json"), "--dry-run"]) == 0


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "documents", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    df = catalogue.queries()[name](spark, d)
    cols = sorted(df.columns)
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    assert sorted(names) == cols and want
    assert sorted(map(str, (tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect()))) == sorted(map(str, want))
