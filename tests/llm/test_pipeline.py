"""The pipeline from end to end, and operators on hot keys and clashing names, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, html, lm, packing, quality, queries, simhash, substring, tiff, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _table(spark, path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return {i: t for i, t in texts}


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _good(t):
    w = _words(t)
    n = len(w)

    def covered(size):
        seen, hit = Counter(tuple(w[i : i + size]) for i in range(n - size + 1)), set()
        for i in range(n - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                hit.update(range(i, i + size))
        return len(hit)

    longest = next((k for k in range(n - 1, 0, -1) if covered(k)), 0)
    return n >= 20 and 100 * covered(8) <= 30 * n and covered(16) <= 0.15 * n and longest <= 500 and 100 * (longest if longest >= 8 else 0) <= 15 * n


def _dedup(docs):
    low = {i: _words(t.lower()) for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in low.items()}
    root = {i: i for i in docs}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in docs:
        for j in docs:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: docs[i] for i in docs if find(i) == i}


def _passages(docs, size=50):
    first = {}
    for i, t in docs.items():
        w = _words(t)
        for k in range(len(w) - size + 1):
            first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = {}
    for i, t in docs.items():
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        w, gone = _words(t), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        text, at = "", 0
        for k, (a, b) in enumerate(spans):
            if k not in gone:
                text += t[at:b]
            at = b
        out[i] = text + t[at:]
    return out


def test_run_is_the_brute_force_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(21)
    word = lambda: r.choice(["a", "the", "of"]) if r.random() < 0.2 else f"w{r.randrange(3000)}"
    passage = [word() for _ in range(70)]
    texts = [None, "", "too short", " ".join(["so", "on"] * 60)]
    for i in range(26):
        w = [word() for _ in range(r.randrange(30, 400))]
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage
        if i % 9 == 4:
            w += w[5:45]
        sep = r.choice([" ", "\n", "  "])
        texts.append(sep.join(w))
        if i % 4 == 1:  # an exact copy, one with other case, one with a few words changed, one with a block more
            texts += [sep.join(w), sep.join(w).upper() if i % 8 == 1 else sep.join(w), sep.join(w[: len(w) // 2] + ["new"] + w[len(w) // 2 :]), sep.join(w + [word() for _ in range(len(w) // 8)])]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = _table(spark, tmp_path, [(7 * i + 1, t) for i, t in zip(order, texts)])
    good = {i: t for i, t in docs.items() if _good(t)}
    one = _dedup(good)
    left = _passages(one)
    assert len(docs) > len(good) > len(one) and any(left[i] != one[i] for i in one)
    t = Tokenizer.from_file(queries.vocabulary())
    want = Counter()
    for i, text in left.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)] += 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in rows) == want
    sequences = defaultdict(list)
    for x in rows:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    _table(spark, tmp_path, [(1, None), (2, "short")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_common_line_loses_no_window(spark):
    """One common line with ever different neighbours."""
    r = random.Random(8)
    line = [f"line{i}" for i in range(14)]
    block = [f"b{r.randrange(50)}" for _ in range(60)]
    texts = []
    for i in range(40):
        w = [f"x{r.randrange(400)}" for _ in range(60)] + line + [f"y{r.randrange(400)}" for _ in range(60)]
        if i % 3 == 0:
            w[70:70] = block[: r.randrange(45, 60)] + line + block
        if i % 5 == 4:
            w = texts[-2].split()[: r.randrange(60, 130)] + line + w
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        want[i] = len(gone)
    assert {x["doc_id"]: x["n_removed"] for x in substring.digests(docs).collect()} == want
    assert sum(want.values()) > 0


def _by_name(spark, name):
    return spark.createDataFrame([(1, "some text")], f"{name} long, text string")


@pytest.mark.parametrize("call, name", [
    (lambda t: quality.quality(t, "n_words"), "n_words"), (lambda t: bpe.digests(t, queries.vocabulary(), "n_tokens"), "n_tokens"), (lambda t: packing.pack(t, queries.vocabulary(), "start"), "start"),
    (lambda t: tiff.stored_digests(t, "n_bytes"), "n_bytes"), (lambda t: substring.digests(t, "n_words"), "n_words"), (lambda t: simhash.near_duplicates(t, "fingerprint"), "fingerprint"),
    (lambda t: lm.score(t, F.lit(True), "score"), "score"), (lambda t: html.extract(t, "n_chars", "text", "text"), "n_chars"), (lambda t: warc.derivatives(t, "record", "text", "text"), "record"),
    (lambda t: urls.judge(t, t, [], "verdict", "text"), "verdict"),
])
def test_an_id_named_like_an_output_is_refused(spark, call, name):
    with pytest.raises(ValueError, match=name):
        call(_by_name(spark, name))
