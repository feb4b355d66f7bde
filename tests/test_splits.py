"""Files in small splits against a sequential reader."""

import csv
import io
import json
import random

import pytest

from graphloom.functions import chunking, pieces
from graphloom.sources import files, splits


@pytest.fixture
def small(spark):
    """Splits of some 40 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _sequential(data, delimiter=","):
    return list(csv.reader(io.StringIO(data.decode("utf-8", "replace")), delimiter=delimiter))


def test_open_after_is_what_a_reader_does():
    r = random.Random(3)
    for _ in range(4000):
        line = "".join(r.choice('""",ab ') for _ in range(r.randrange(9)))
        for before in ("", '"x\n'):
            # a reader that is within quotes takes the next line into the same row
            rows = list(csv.reader(io.StringIO(f"{before}{line}\nmark\n")))
            assert splits.open_after(line, bool(before)) == (rows[-1] != ["mark"]), (line, before)


def test_rows_over_splits(small, tmp_path):
    r = random.Random(5)
    made = {}
    cell = lambda: r.choice(["a", "b c", "", "é字", 'say ""hi""', "x,y", "line\nbreak", "l\n\n\n" * r.randrange(12), "z" * r.randrange(90)])
    for k in range(4):
        rows = []
        for _ in range(r.randrange(1, 60)):
            cells = [f'"{c}"' if any(x in c for x in '",\n') or r.random() < 0.2 else c for c in (cell() for _ in range(r.randrange(1, 5)))]
            rows.append(",".join(cells) + r.choice(["\n", "\n", "\r\n"]))
        made[f"{k}.csv"] = "".join(rows).encode()
    made["open.csv"] = b'a,b\n"never closed\n' + b"x\n" * 60
    made["odd.csv"] = b'a"b,c\nq"",r"s\n"t"u,v\n\n\n\xff\xfe,\x80\nlast'
    made["one.csv"] = b'"' + b"line\n" * 100 + b'",end\n'
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    rows = splits.read_table(small, [str(tmp_path / "*.csv")])
    for x in rows.collect():
        assert x["error"] is None
        got.setdefault(x["path"].rsplit("/", 1)[1], {})[x["row_ord"]] = x["cells"]
    for name, data in made.items():
        want = _sequential(data)
        assert [got[name][i] for i in range(len(want))] == want and len(got[name]) == len(want), name
    # as text: what the reader of whole files makes of them
    lines = {}
    for x in splits.pipe_lines(rows).orderBy("line_ord").collect():
        lines.setdefault(x["path"].rsplit("/", 1)[1], []).append(x["line"])
    for name, data in made.items():
        assert "\n".join(lines[name]) == files.pipe_table(data)


def test_rows_that_cannot_be_read_have_an_error(small, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b'a\tb\nc\rd\te\nf\t"g\th"\n')
    got = sorted((x["row_ord"], x["cells"], x["error"]) for x in splits.read_table(small, [str(tmp_path / "a.tsv")], "\t").collect())
    assert [(n, c) for n, c, _ in got] == [(0, ["a", "b"]), (1, None), (2, ["f", "g\th"])] and got[1][2].startswith("Error: new-line")


def test_states_compose(small, tmp_path):
    """Every split's state is that of one reader that goes through the file."""
    r = random.Random(9)
    data = "\n".join("".join(r.choice('"",ab') for _ in range(r.randrange(12))) for _ in range(400)).encode()
    (tmp_path / "s.csv").write_bytes(data)
    read = splits.lines(small, [str(tmp_path / "s.csv")])
    got = {x["block"]: (x["open"], x["row_ord"]) for x in splits.split_states(read).collect()}
    assert len(got) > 20
    row, open_ = 0, False
    for line in data.decode().split("\n"):
        open_ = splits.open_after(line, open_)
        row += not open_
    assert got[0] == (False, 0) and {o for o, _ in got.values()} == {True, False}
    numbers = [got[b][1] for b in sorted(got)]
    assert numbers == sorted(numbers) and numbers[-1] <= row


def test_first_json_lines(small, tmp_path):
    good = [{"k": i, "s": "é" * (i % 30)} for i in range(150)]
    text = "".join(json.dumps(x, ensure_ascii=False) + "\n" + ("{broken\n" if i % 7 == 0 else "\n") for i, x in enumerate(good))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("[1]\nno\n")
    got = splits.first_json(small, [str(tmp_path)]).collect()
    by = lambda n: [json.loads(x["json"]) for x in sorted((x for x in got if x["path"].endswith(n)), key=lambda x: x["pos"])]
    assert by("a.jsonl") == good[:100] == json.loads(files.json_lines(text.encode())) and by("b.jsonl") == [[1]]


# ------------------------------------------------------------ texts in pieces
def _text(r, n):
    return "".join(r.choice(["a", "b c ", "é", "\n", "\n\n", "word " * r.randrange(12), "\n" * r.randrange(5)]) for _ in range(n))


def test_functions_of_pieces_are_those_of_the_rule():
    r = random.Random(2)
    for _ in range(400):
        size = r.randrange(2, 40)
        overlap, text = r.randrange(size), _text(r, r.randrange(60))
        starts = [a for a, _ in chunking.spans(text, size, overlap)]
        n = r.randrange(1, max(2, len(text)))
        got, ahead = pieces.crossing(text[:n], text[n : n + size], size, overlap) if text[:n] else [], text[n : n + size]
        if not text[:n]:
            continue
        behind = next((a - n for a in starts if a >= n), pieces.OVER)
        assert got[0] == behind, (text, size, overlap, n)


def test_chunks_of_pieces_are_those_of_whole_texts(spark):
    r = random.Random(8)
    rows = [(i, _text(r, r.choice([0, 3, 40, 400]))) for i in range(25)] + [(100, None), (101, " \n "), (102, "x" * 3000), (103, "\n" * 300), (104, "y" * 50)]
    docs = spark.createDataFrame(rows, "doc_ord long, text string").repartition(3)
    for size, overlap, length in ((50, 10, 50), (50, 49, 75), (30, 0, 1000)):
        want = {tuple(x) for x in chunking.chunks(docs, size, overlap).collect()}
        got = [tuple(x) for x in pieces.chunk_pieces(pieces.pieces(docs, length=length), size, overlap).collect()]
        assert set(got) == want and len(got) == len(want)
    with pytest.raises(Exception, match="is not the last"):
        pieces.chunk_pieces(pieces.pieces(docs, length=20), 50, 10).count()


def test_pieces_of_files(small, tmp_path):
    r = random.Random(4)
    made = {f"{i}.txt": _text(r, 60) + end for i, end in enumerate(["", "\n", "x", "\n\n"])} | {"one.txt": "é" * 400, "crlf.txt": "a\r\nb\r\n" * 30}
    for name, text in made.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    table = pieces.file_pieces(small, [str(tmp_path)], 64)
    for x in table.collect():
        got.setdefault(x["path"].rsplit("/", 1)[1], {})[x["piece"]] = x["text"]
    for name, text in made.items():
        assert "".join(got[name][i] for i in sorted(got[name])) == text, name
        assert [len(got[name][i]) for i in sorted(got[name])][:-1] == [64] * (len(got[name]) - 1)
    chunked = pieces.chunk_pieces(table, 60, 10, "path").collect()
    for name, text in made.items():
        own = [x["text"] for x in sorted((x for x in chunked if x["path"].endswith("/" + name)), key=lambda x: x["chunk_idx"])]
        assert own == chunking.split_chars(text, 60, 10)
