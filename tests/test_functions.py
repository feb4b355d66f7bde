import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.functions import chunking, jsonrepair, text
from graphloom.operators import resolve
from graphloom.operators.resolve import segments


def test_config_reads_the_environment_and_checks_overlap(tmp_path):
    env = tmp_path / ".env"
    env.write_text("GRAPHLOOM_CHUNK_OVERLAP=7\n# x\nGRAPHLOOM_CHUNK_SIZE='99'\n")
    c = Config.from_env({"GRAPHLOOM_CHUNK_SIZE": "50"}, dotenv=str(env), workers=3, model=None)
    assert (c.chunk_size, c.chunk_overlap, c.workers, c.model) == (50, 7, 3, "")
    with pytest.raises(ValueError):
        Config(chunk_size=10, chunk_overlap=10)


@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.data())
@settings(max_examples=300, deadline=None)
def test_chunks_end_and_cover_all(t, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = chunking.split_chars(t, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in got)
    at = 0
    for c in got:  # every chunk stands in the text, in order
        at = t.index(c, max(0, at - size))
    assert "".join(t.split()) == "" or got
    assert sum(len(c.replace(" ", "").replace("\n", "")) for c in got) >= len("".join(t.split()))


def test_chunk_cases_that_must_end():
    for t in ("title\n\n" + "x" * 13_000, "y" * 3000 + "\n\n" + "z" * 8000):
        got = chunking.split_chars(t, 6000, 500)
        assert got and set("".join(got)) >= set(t) - {"\n"}
    assert chunking.split_chars("A" * 60 + "\n\n" + "B" * 60, 100, 10)[0] == "A" * 60
    assert chunking.split_chars("  \n", 100, 20) == []


@pytest.mark.parametrize("label, out", [("  Acme-Corp!", "acmecorp"), ("Città", "citta"), ("straße", "strae"), ("ﬁn ½", "fin 12"), ("東京", "東京"), (None, ""), ("", ""), ("a  b\tc", "a b c")])
def test_normalize(spark, label, out):
    assert text.normalize_text(label) == out
    df = spark.createDataFrame([(label,)], "label string")
    assert df.select(text.normalize_label(F.col("label"))).first()[0] == out


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
@settings(max_examples=300, deadline=None)
def test_indel_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(row[j], prev[j + 1])
    assert text.indel_ratio(a, b) == (200 * row[-1] // (len(a) + len(b)) if a or b else 100)


def test_segments_cover_a_label():
    for n in range(1, 60):
        assert [a for a, _ in segments(n, 90)][0] == 0 and sum(k for _, k in segments(n, 90)) == n


@pytest.mark.parametrize("raw, value, status", [('{"a": 1}', {"a": 1}, "ok"), ('```json\n{"a": [1,],}\n```', {"a": [1]}, "repaired"), ("{a: 'it', b: None} // x", {"a": "it", "b": None}, "repaired"), ('{"u": "http://x/,]"', {"u": "http://x/,]"}, "repaired"), ("no", None, "failed"), ("", None, "failed"), (None, None, "failed"), ("[1, 2", [1, 2], "repaired")])
def test_json_repair(raw, value, status):
    assert jsonrepair.parse(raw) == (value, status)


def test_salvage_keeps_ids():
    got, status = jsonrepair.parse('{"nodes": [{"id": "q7", "label": "A"} oops : {"id": "q8", "label": "B"}], {"source": "q7", "target": "q8"}')
    assert status == "salvaged" and [n["id"] for n in got["nodes"]] == ["q7", "q8"] and got["edges"][0]["target"] == "q8"


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8))
@settings(max_examples=200, deadline=None)
def test_json_that_is_right_stays(v):
    assert jsonrepair.parse(json.dumps(v)) == (v, "ok")
    assert jsonrepair._Reader(json.dumps(v)).value() == v


def test_escapes(spark):
    df = spark.createDataFrame([("a&<>\"'\\\n",)], "t string")
    got = df.select(text.xml_escape(F.col("t")), text.quoted(F.col("t"), "'"), text.safe_id(F.lit("a b-ç")), text.suffix(F.lit("/x/y.tar.GZ")), text.stem(F.lit("/x/y.b.txt"))).first()
    assert list(got) == ["a&amp;&lt;&gt;&quot;&apos;\\\n", "a&<>\"\\'\\\\\\n", "a_b-ç", ".gz", "y.b"]


def test_token_chunks():
    words = chunking.split_tokens("a b c d e", 2, 1, str.split, " ".join)
    assert words == ["a b", "b c", "c d", "d e", "e"]
    random.seed(0)


def test_chunks_are_those_of_the_rule():
    """The rule said plainly: the last empty line of a window, else its last line break, if the next window then starts later."""
    r = random.Random(5)
    for _ in range(3000):
        t, size = "".join(r.choice("ab \n\n") for _ in range(r.randrange(60))), r.randrange(1, 12)
        overlap = r.randrange(size)
        want, at = [], 0
        while at < len(t):
            window = range(at, at + size)
            if at + size >= len(t):
                want.append(t[at:])
                break
            places = [i for i in window if i + 1 in window and t[i : i + 2] == "\n\n"] or [i for i in window if t[i] == "\n"]
            to = places[-1] if places and places[-1] - overlap > at else at + size
            want.append(t[at:to])
            at = to - overlap
        assert chunking.split_chars(t, size, overlap) == [x.strip() for x in want if x.strip()]


def test_strip_takes_white_space_of_all_scripts(spark):
    from graphloom.functions.text import strip

    texts = ["\tAcme\n", "\xa0 a b　\x85", "", None, "\x1c\x1f", "​x", "  y "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [(t or "").strip() for t in texts]
    nodes = spark.createDataFrame([(0, i, str(i), label, kind, {}, "") for i, (label, kind) in enumerate([("\tAcme\n", "Org"), ("acme", "\xa0Org "), ("Bob", "\n")])], "graph_ord long, node_ord long, orig_id string, label string, type string, properties map<string,string>, description string")
    edges = spark.createDataFrame([(0, 0, "0", "2", " \towns ", "", {}, ""), (0, 1, "1", "2", "owns", "", {}, "")], "graph_ord long, edge_ord long, source string, target string, type string, label string, properties map<string,string>, evidence string")
    n, e = resolve.merge(nodes, edges, 101)
    assert [(r["label"], r["type"]) for r in n.orderBy("ord").collect()] == [("Acme", "Org"), ("Bob", "Nodo")]
    assert [r["type"] for r in resolve.prune(n, e).collect()] == ["owns"]


def test_functions_in_sql(spark):
    from graphloom import sql

    sql.register(spark)
    rows = [(1, "a\n" * 40, "x"), (2, None, "y"), (3, " ", "z"), (4, "b" * 70, None)]
    spark.createDataFrame(rows, "doc_ord long, text string, lang string").createOrReplaceTempView("sql_docs")
    got = sorted(tuple(r) for r in spark.sql("SELECT doc_ord, lang, chunk_idx, text FROM chunks(TABLE(sql_docs), 30, 5)").collect())
    assert got == sorted((n, lang, i, c) for n, t, lang in rows if t for i, c in enumerate(chunking.split_chars(t, 30, 5))) and got
    assert spark.sql("SELECT count(*) FROM chunks(TABLE(SELECT 'q' AS text))").first()[0] == 1
    one = spark.sql("SELECT normalize_label(' \u00c9t\u00e9! '), fuzzy_ratio('abc', 'abd'), repair_json('{a: 1,}').json").first()
    assert tuple(one) == ("ete", 66, '{"a": 1}')
    for bad in ("SELECT * FROM chunks(TABLE(SELECT 1 AS x))", "SELECT * FROM chunks(TABLE(sql_docs), 5, 5)"):
        with pytest.raises(Exception, match="chunks needs|overlap"):
            spark.sql(bad).collect()
