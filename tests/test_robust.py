"""Runs that go on: stored answers, faulty inputs, missing paths; and what a run counts."""

import json
import warnings
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom import Config, get_config, merge_files, process_files, set_config
from graphloom.cli import main
from graphloom.functions import chunking, jsonrepair, text
from graphloom.operators import graph as G
from graphloom.operators import refine, resolve
from graphloom.operators.components import components
from graphloom.operators.metrics import RunMetrics
from graphloom.progress import answered, stored
from graphloom.sinks import export
from graphloom.sources import files, providers

GRAPH = '{"nodes": [{"id": "1", "label": "Acme", "type": "Org"}, {"id": "2", "label": "Bob", "type": "Person"}], "edges": [{"source": "2", "target": "1", "type": "RELATED_TO"}, {"source": "2", "target": "2", "type": "SELF"}]}'


def asked(log, refuse=""):
    """A provider that writes down what it was asked, as tasks have no other way to tell; a local class goes to tasks by value."""

    class Asked:
        error = ""

        def __call__(self, request, log=str(log), answer=GRAPH):
            with open(log, "a") as f:
                f.write("x\n")
            if refuse and refuse in request:
                self.error = "the endpoint is down"
                return ""
            return answer

    return Asked()


def times(log):
    return len(log.read_text().splitlines())


# ------------------------------------------------------------ resume
def test_a_later_run_asks_only_for_what_is_missing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first text")
    (tmp_path / "in/b.txt").write_text("second text")
    config = Config(answers_dir=str(tmp_path / "answers"), fuzzy_threshold=101)
    go = lambda provider, c=config, **how: process_files(spark, [str(tmp_path / "in")], provider, c, enriched=False, **how)[0].count()
    one = asked(tmp_path / "1", refuse="second")
    assert go(one) == 2 and times(tmp_path / "1") == 2
    failed = stored(spark, f"{config.answers_dir}/chunks").where("status = 'no_answer'").collect()
    assert [r["error"] for r in failed] == ["the endpoint is down"]
    two = asked(tmp_path / "2")
    assert go(two) == 2 and times(tmp_path / "2") == 1  # the failed one alone
    three = asked(tmp_path / "3")
    (tmp_path / "in/0.txt").write_text("another, which comes before the others")
    (tmp_path / "in/b.txt").write_text("second text, changed")
    assert go(three) == 2 and times(tmp_path / "3") == 2
    other = asked(tmp_path / "4")
    assert go(other, Config(answers_dir=config.answers_dir, temperature=0.9)) == 2 and times(tmp_path / "4") == 3
    again = asked(tmp_path / "5")
    assert go(again, resume=False) == 2 and times(tmp_path / "5") == 3


def test_answers_count_for_their_provider_and_prompt_alone(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a text")
    config = Config(answers_dir=str(tmp_path / "answers"), fuzzy_threshold=101)

    class Other:
        name = "another model"

        def __call__(self, request):
            return '{"nodes": [{"id": "1", "label": "Other"}], "edges": []}'

    go = lambda provider, c=config: sorted(r["label"] for r in process_files(spark, [str(tmp_path / "a.txt")], provider, c, enriched=False)[0].collect())
    assert go(asked(tmp_path / "1")) == ["Acme", "Bob"] and go(Other()) == ["Other"] and go(asked(tmp_path / "2")) == ["Acme", "Bob"]
    assert not (tmp_path / "2").exists()
    assert config.answers_hash("a", "b") != config.answers_hash("a", "c") != config.answers_hash("ab", "")
    assert providers.provider_name(providers.Chat(Config(model="m"))) != providers.provider_name(providers.Chat(Config(model="n")))
    # a file that was broken is passed over with a warning, and what stood in it is asked for again
    part = next((tmp_path / "answers/chunks").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(b"PAR1 broken")
    with pytest.warns(UserWarning, match="1 files of answers"):
        assert go(asked(tmp_path / "3")) == ["Acme", "Bob"] and go(Other()) == ["Other"]


def refiner(log, down=""):
    """Answers chunks, enrichment and verification, and writes down which it was asked for."""

    class Refiner:
        name, error = "refiner", ""

        def __call__(self, request, log=str(log), down=down):
            kind = "enrich" if request.startswith(refine.ENRICH) else "verify" if request.startswith(refine.VERIFY) else "chunk"
            with open(log, "a") as f:
                f.write(kind + "\n")
            if kind == down:
                self.error = "down"
                return ""
            if kind == "chunk":
                word = request.rsplit(None, 1)[-1]
                return json.dumps({"nodes": [{"id": str(i), "label": f"{word}{i}"} for i in range(4)], "edges": [{"source": "0", "target": str(i), "type": "RELATED_TO", "evidence": f"e{i}"} for i in (1, 2, 3)]})
            items = json.loads(request.split("\n", 1)[1])
            if kind == "enrich":
                return json.dumps([{"_idx": x["pos"], "type": f"has {x['evidence']}", "label": "has"} for x in items])
            return json.dumps([{"idx": x["pos"], "valid": x["evidence"] != "e2", "reason": ""} for x in items])

    return Refiner()


def test_each_batch_of_edges_is_asked_about_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for w in ("Rome", "Oslo"):
        (tmp_path / f"in/{w}.txt").write_text(w)
    config = Config(answers_dir=str(tmp_path / "answers"), fuzzy_threshold=101, verify_batch=2)
    go = lambda provider, c=config, **how: process_files(spark, [str(tmp_path / "in")], provider, c, verified=True, **how)
    log = lambda n: sorted((tmp_path / n).read_text().split()) if (tmp_path / n).exists() else []
    for n, c in (("1", config), ("kept for the run", Config(fuzzy_threshold=101, verify_batch=2))):
        nodes, edges = go(refiner(tmp_path / n), c)
        assert edges.count() == 4 and {r["type"] for r in edges.collect()} == {"HAS_E1", "HAS_E3"}
        for k in range(3):
            export.export_all(nodes, edges.withColumn("ord", F.monotonically_increasing_id()), str(tmp_path / f"out{k}"), ["jsonl"])
        assert log(n) == ["chunk"] * 2 + ["enrich"] * 2 + ["verify"] * 4
    # a second run asks nothing; one with another document only about that one's edges
    assert go(refiner(tmp_path / "2"))[1].count() == 4 and log("2") == []
    (tmp_path / "in/Bonn.txt").write_text("Bonn")
    assert go(refiner(tmp_path / "3"))[1].count() == 6 and log("3") == ["chunk", "enrich", "verify", "verify"]
    # other settings, and no resuming, ask again
    hot = Config(answers_dir=config.answers_dir, fuzzy_threshold=101, verify_batch=2, temperature=0.9)
    assert go(refiner(tmp_path / "4"), hot)[1].count() == 6 and len(log("4")) == 3 + 3 + 6
    assert go(refiner(tmp_path / "5"), resume=False)[1].count() == 6 and len(log("5")) == 3 + 3 + 6


def test_an_outage_of_refinement_is_made_good_by_the_next_run(spark, tmp_path):
    (tmp_path / "Rome.txt").write_text("Rome")
    config = Config(answers_dir=str(tmp_path / "answers"), fuzzy_threshold=101)
    go = lambda provider: {r["type"] for r in process_files(spark, [str(tmp_path / "Rome.txt")], provider, config, verified=True)[1].collect()}
    assert go(refiner(tmp_path / "1", down="enrich")) == {"RELATED_TO"}
    kept = stored(spark, f"{config.answers_dir}/edges", refine.REPLIES).where("status = 'no_answer'").collect()
    assert {(r["item"], r["error"]) for r in kept} == {(None, "down")}
    assert go(refiner(tmp_path / "2")) == {"HAS_E1", "HAS_E3"} and (tmp_path / "2").read_text().split() == ["enrich", "verify"]


def test_replies_say_what_they_name():
    assert refine._items([{"_idx": 2, "a": 1}, {"a": 2}, {"_idx": None, "a": 3}, 5, {"_idx": True}], "_idx", True) == {2: {"_idx": None, "a": 3}, 1: {"a": 2}}
    assert refine._items({"edges": [{"idx": 1}, {"x": 1}]}, "idx", False) == {1: {"idx": 1}}
    assert refine._items("no", "_idx", True) == refine._items({"edges": 3}, "_idx", True) == {}


def test_requests_in_flight_are_bounded_and_in_order():
    import threading
    import time

    lock, now, most = threading.Lock(), [0], [0]

    class Slow:
        error = ""

        def __call__(self, text):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.2 if text == "0" else 0.01)
            with lock:
                now[0] -= 1
            self.error = f"e{text}"
            return f"a{text}"

    began = time.time()
    assert list(providers.in_flight(Slow(), map(str, range(40)), 8)) == [(f"a{i}", f"e{i}") for i in range(40)]
    assert most[0] == 8 and time.time() - began < 0.6
    assert list(providers.in_flight(Slow(), ["x"], 1)) == [("ax", "ex")]


def test_workers_bound_requests(spark):
    t = spark.range(10)
    tasks = spark.sparkContext.defaultParallelism
    assert [(providers.window(t, w)[0].rdd.getNumPartitions(), providers.window(t, w)[1]) for w in (1, 3, 4 * tasks)] == [(1, 1), (min(3, tasks), 1), (tasks, 4)]


def test_answers_come_in_the_order_of_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, i, f"t{i % 3}") for i in (2, 0, 1, 3)] + [("e", 1, 0, "t0")], "name string, doc_ord long, chunk_idx int, text string")
    got = answered(chunks, lambda q: '{"nodes": [], "edges": []}', str(tmp_path / "a"), "x")
    assert sorted((r["doc_ord"], r["chunk_idx"], r["status"]) for r in got.collect()) == [(0, 0, "ok"), (0, 1, "ok"), (0, 2, "ok"), (0, 3, "ok"), (1, 0, "ok")]
    assert stored(spark, str(tmp_path / "none")).count() == 0
    assert answered(chunks.where("false"), lambda q: "", str(tmp_path / "b"), "x").count() == 0


def test_metrics_count_a_run(spark, tmp_path):
    (tmp_path / "a.txt").write_text("some text")
    (tmp_path / "b.txt").write_text("no answer")
    metrics, enrich, verify, graph = RunMetrics(), refine.ENRICH, refine.VERIFY, GRAPH

    def provider(q):
        if q.startswith(enrich):
            return '[{"_idx": 0, "type": "works at", "label": "works", "properties": {"since": 2000, "odd": [1], "no": null}}]'
        if q.startswith(verify):
            return '[{"idx": 0, "valid": false}]'
        return "" if "no answer" in q else graph

    nodes, edges = process_files(spark, [str(tmp_path)], provider, Config(), verified=True, metrics=metrics)
    assert nodes.count() == 2 and edges.count() == 0
    got = metrics.values()
    assert (got["chunks"], got["failed"], got["edges_enriched"], got["edges_invalid"]) == (2, 1, 1, 1), got
    _, edges = process_files(spark, [str(tmp_path)], provider, Config())
    row = edges.select("type", F.to_json("properties").alias("p")).first()
    assert row["type"] == "WORKS_AT" and json.loads(row["p"]) == {"since": 2000, "odd": [1], "no": None}


# ------------------------------------------------------------ inputs
def test_missing_paths_are_told_and_the_rest_goes_on(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "sub/deep/c.md", "sub/deep/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    read = lambda *paths: [r["path"].rsplit(f"{tmp_path.name}/", 1)[1] for r in files.read_files(spark, [f"{tmp_path}/{p}" for p in paths]).orderBy("doc_ord").collect()]
    with pytest.warns(UserWarning, match="nothing.txt"):
        assert read("nothing.txt", "a.txt", "*.zzz") == ["a.txt"]
    with pytest.warns(UserWarning):
        assert read("nothing") == []
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert read("a.txt", "*.txt", "a.txt") == ["a.txt"]
        assert read("sub", "sub/b.txt", "sub/*.txt", "a.txt") == ["a.txt", "sub/b.txt", "sub/deep/c.md", "sub/deep/d.txt"]
        assert read("**/*.txt") == ["a.txt", "sub/b.txt", "sub/deep/d.txt"]
        assert read("**/deep/*", "a.txt", "sub/**/?.md") == ["a.txt", "sub/deep/c.md", "sub/deep/d.txt"]
    got = files.read_files(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/sub"])
    assert [r["doc_ord"] for r in got.orderBy("path").collect()] == [1, 2, 3, 4]


HOSTILE = {
    "deep.json": b"[" * 200_000, "deep.jsonl": b"[" * 200_000 + b'\n{"a": 1}\n', "long.csv": b"a,b\n" + b"x" * 300_000 + b",1\n", "bytes.csv": b"a\0b,\xff\n", "quote.csv": b'a,"b\n',
    "broken.pdf": b"%PDF-1.4 junk", "broken.docx": b"PK\x03\x04junk", "text.docx": b"no archive", "x.zzz": b"\xff\xfe", "empty.json": b"", "ok.txt": b"fine \xff",
}


def test_hostile_files_have_rows_of_their_own(spark, tmp_path):
    for name, data in HOSTILE.items():
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r for r in files.texts(files.read_files(spark, [str(tmp_path)])).collect()}
    assert set(got) == set(HOSTILE) - {"empty.json"}  # files of no bytes have no row
    assert got["ok.txt"]["text"] == "fine �" and got["deep.json"]["text"] == "[" * 200_000 and json.loads(got["deep.jsonl"]["text"]) == [{"a": 1}]
    assert "x" * 300_000 in got["long.csv"]["text"] and not got["long.csv"]["error"]
    for name in ("broken.pdf", "broken.docx", "text.docx", "x.zzz"):
        assert got[name]["error"] or got[name]["text"]


def test_one_bad_graph_file_leaves_the_others(spark, tmp_path):
    for i, data in enumerate([GRAPH.encode(), b'{"nodes": [{"id": "1", "label": "caf\xe9"}], "edges": []}', b"\xff\xfe\x00", b"[" * 100_000, b" ", b'{"nodes": 7}', b"null"]):
        (tmp_path / f"{i}.json").write_bytes(data)
    nodes, edges, bad = merge_files(spark, [str(tmp_path)])
    assert sorted(r["label"] for r in nodes.collect()) == ["Acme", "Bob", "caf�"] and edges.count() == 1
    assert sorted(r["path"][-6:] for r in bad.collect()) == ["2.json", "3.json", "4.json", "6.json"]


@pytest.mark.parametrize("raw, status", [("[" * 200_000, "failed"), ('{"a":' * 100_000, "failed"), ("{" * 100_000 + '"' * 100_000, "failed"), ('{"a": "' + "\\u0041" * 50_000, "repaired"), ('He said "hi {" {"label": "A"}', "salvaged"), ('{"a": "open, {"label": "x"}', "salvaged")])
def test_hostile_json_ends_soon(raw, status):
    value, got = jsonrepair.as_text(*jsonrepair.parse(raw))
    assert got == status and (value is None) == (status == "failed")


# ------------------------------------------------------------ settings
def test_settings_of_the_session():
    assert get_config() == Config.from_env()
    set_config(Config(chunk_size=77, chunk_overlap=7))
    try:
        assert get_config().chunk_size == 77
    finally:
        set_config(None)
    with pytest.raises(ValueError):
        Config(use_token_chunking=True)
    assert Config().answers_hash() != Config(model="m").answers_hash() == Config(model="m", workers=4).answers_hash()


def test_token_chunks_of_a_tokenizer_file(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(["[UNK]", *"abcdefgh"])}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    docs = spark.createDataFrame([(0, "a b c d e f g"), (1, None), (2, " ")], "doc_ord long, text string")
    config = Config(use_token_chunking=True, tokenizer_file=str(tmp_path / "t.json"), max_tokens=3, chunk_overlap=4)
    got = [(r["doc_ord"], r["chunk_idx"], r["text"]) for r in chunking.chunks_by(docs, config).collect()]
    assert got == [(0, 0, "a b c"), (0, 1, "c d e"), (0, 2, "e f g"), (0, 3, "g")]
    assert [r["text"] for r in chunking.chunks_by(docs, Config(chunk_size=6, chunk_overlap=0)).collect()] == ["a b c", "d e f", "g"]


def test_the_endpoint_is_asked_for_its_model_once():
    calls = []

    def post(path, body):
        calls.append((path, body and body["model"]))
        return {"data": [{"id": "m1"}]} if path == "/models" else {"choices": [{"message": {"content": "hi"}}]}

    chat = providers.Chat(Config(), post=post).resolved()
    assert chat("x") == chat("y") == "hi" and calls == [("/models", None), ("/chat/completions", "m1"), ("/chat/completions", "m1")]
    assert providers.Chat(Config(model="own"), post=post).resolved().config.model == "own"
    with pytest.raises(RuntimeError):
        providers.Chat(Config(), post=lambda p, b: {"data": []}).resolved()


def test_command_line_says_what_is_wrong(spark, tmp_path, capsys):
    assert main([str(tmp_path / "none.json"), "--merge-jsons"]) == 1 and "none.json" in capsys.readouterr().err
    assert main([str(tmp_path / "none.txt"), "--dry-run"]) == 1
    assert main([str(tmp_path), "--chunk-size", "5", "--chunk-overlap", "9"]) == 1
    (tmp_path / "a.txt").write_text("text")
    assert main([str(tmp_path / "a.txt"), "--url", "http://127.0.0.1:9"]) == 1 and "no model" in capsys.readouterr().err


# ------------------------------------------------------------ merging
def test_large_components_are_decided_in_rounds(spark):
    import random

    r = random.Random(9)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(4, 12))) for _ in range(60)]
    order, want, heads = [], {}, []
    for w in words:
        if w not in want:
            want[w] = next((h for h in heads if text.indel_ratio(h, w) >= 75), w)
            order.append(w)
            if want[w] == w:
                heads.append(w)
    labels = spark.createDataFrame([("T", w, i) for i, w in enumerate(order)], "scope string, norm string, ord long")
    pairs = resolve.similar_pairs(labels, 75)
    for most in (0, 5, 50_000):
        assert {x["norm"]: x["rep"] for x in resolve.representatives(labels, pairs, most).collect()} == want


def test_components(spark):
    import random

    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {x["node"]: x["root"] for x in got.collect()} == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ratios_together_and_alone():
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abé字😀") for _ in range(r.randrange(90)))
    a, b = [word() for _ in range(1500)] + ["", "a" * 64, "a" * 65], [word() for _ in range(1500)] + ["", "a" * 64, "a" * 65]
    assert text.indel_ratios(a, b).tolist() == [text.indel_ratio(x, y) for x, y in zip(a, b)]
    assert text.indel_ratios([], []).tolist() == []


# ------------------------------------------------------------ sinks
def test_sinks_written_by_tasks(spark, tmp_path):
    n = spark.createDataFrame([(i, f"n{i}", f"l{i}", "T", {"k": str(i)}, "") for i in range(1, 41)], "ord long, id string, label string, type string, properties map<string,string>, description string")
    e = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", "R", "", {}, "") for i in range(1, 40)], "ord long, source string, target string, type string, label string, properties map<string,string>, evidence string")
    done = export.export_all(n, e, str(tmp_path / "g"), ["parquet", "JSONL", "cypher", "graphml"], one_file=False)
    assert not any(v.startswith(("failed", "unknown")) for v in done.values()), done
    assert spark.read.parquet(str(tmp_path / "g_nodes.parquet")).count() == 40 and spark.read.json(str(tmp_path / "g_edges.jsonl")).count() == 39
    lines = [x for p in sorted((tmp_path / "g.cypher").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 80 and lines[0].startswith("// graph of ") and lines[1].startswith("MERGE (:`T` {id: 'n1'") and lines[-1].startswith("MATCH (a {id: 'n39'})")


def test_one_file_is_whole_or_not_there(spark, tmp_path):
    n = spark.range(1, 20_001).selectExpr("id AS ord", "concat('n', id) AS id", "concat('l & <', id, '>') AS label", "'T' AS type", "map('k', string(id)) AS properties", "'' AS description").repartition(7)
    e = spark.range(20_000).selectExpr("id AS ord", "concat('n', id % 100 + 1) AS source", "concat('n', id + 1) AS target", "'R' AS type", "'' AS label", "map('a', 'b') AS properties", "'' AS evidence").repartition(5)
    done = export.export_all(n, e, str(tmp_path / "g"), ["json", "graphml", "csv"])
    assert not any(v.startswith(("failed", "unknown")) for v in done.values()), done
    whole = json.loads((tmp_path / "g.json").read_text())
    assert [x["id"] for x in whole["nodes"]] == [f"n{i}" for i in range(1, 20_001)] and len(whole["edges"]) == 20_000 and whole["edges"][5] == {"source": "n6", "target": "n6", "type": "R", "label": "", "properties": {"a": "b"}, "evidence": ""}
    from xml.etree import ElementTree

    graph = ElementTree.parse(tmp_path / "g.graphml").getroot()[-1]
    assert len(graph) == 40_000 and graph[0].get("id") == "n1" and graph[20_000].get("id") == "e0"
    before = (tmp_path / "g.graphml").read_bytes()
    broken = n.withColumn("label", F.when(F.col("ord") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    assert export.export_all(broken, e, str(tmp_path / "g"), ["graphml"])["graphml"].startswith("failed")
    assert export.export_all(broken, e, str(tmp_path / "h"), ["graphml"])["graphml"].startswith("failed")
    assert (tmp_path / "g.graphml").read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == ["g.graphml", "g.json", "g_nodes.csv", "g_relationships.csv"]
    empty = export.export_all(n.where("false"), e.where("false"), str(tmp_path / "z"), ["json"])
    assert json.loads((tmp_path / "z.json").read_text()) == {"nodes": [], "edges": []}, empty


def test_viewer_has_its_tools(spark):
    from datetime import datetime

    n = spark.createDataFrame([(1, "n1", "A", "T", {}, ""), (2, "n2", "B", "U", {}, "")], "ord long, id string, label string, type string, properties map<string,string>, description string")
    e = spark.createDataFrame([(0, "n1", "n2", "R", "", {}, "x")], "ord long, source string, target string, type string, label string, properties map<string,string>, evidence string")
    page = export.viewer(n, e, "t", at=datetime(2024, 5, 6, 7, 8))
    for part in ("2024-05-06 07:08", "2 nodes, 1 edges, 2 types", "CREATE (:`T` {id: 'n1', name: 'A'});", "ontouchmove", "clipboard", "function fit"):
        assert part in page, part
    assert [r["type"] for r in G.legend(n).collect()] == ["T", "U"]


def test_contracts_are_checked(spark):
    from graphloom.operators import contracts

    n = spark.createDataFrame([("n1", "A", "Person", {}), ("n2", " ", "Thing", {str(i): "" for i in range(6)}), ("n3", None, None, None)], "id string, label string, type string, properties map<string,string>")
    assert [r["faults"] for r in contracts.node_faults(n).orderBy("id").collect()] == [[], ["label", "type", "properties"], ["label", "type"]]
    e = spark.createDataFrame([(0, "WORKS_AT", "works at", "he does"), (1, "works at", "one two three four five six", " "), (2, None, None, None)], "ord long, type string, label string, evidence string")
    assert [r["faults"] for r in contracts.edge_faults(e).orderBy("ord").collect()] == [[], ["type", "label", "evidence"], ["type", "evidence"]]
