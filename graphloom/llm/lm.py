"""Scores of whole documents under a gated recurrent language model trained on the corpus.

1. Token counts of all training texts, combined per task before the shuffle.
2. The commonest words are model units of their own; all others share units by
   their last two bytes.  Given its unit such a word has its share of the unit's
   counts, so every word has a probability, seen or not.
3. Training covers all training texts: a start model is fitted on at most
   ``Settings.start_texts`` texts, every task then makes a pass over its own texts
   from there, and the results are averaged by tokens in a tree of tasks.
4. Scoring reads each text once, state carried to its end.  Words beyond the
   dictionary (bounded by ``Settings.dictionary``) get their counts by a join on
   their hash, per text.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .components import kept
from .words import only, refuse, slices, with_bytes

SEED = 42
END = b""  # no word is empty


@dataclass(frozen=True)
class Settings:
    """``words`` and ``shared``: units for single words and by last bytes; ``dictionary``: words sent to every task."""

    words: int = 896
    shared: int = 128  # a power of two
    classes: int = 24
    hidden: int = 16
    dictionary: int = 120_000
    start_texts: int = 1_500
    #: Training texts are cut into parts of so many words, so that lanes end together.
    part: int = 1_024
    fan_in: int = 16


def _shared(word: bytes, s: Settings) -> int:
    return xxhash.xxh64_intdigest(word[-2:], SEED) & (s.shared - 1)


class _Codes(dict):
    """Dictionary words have fixed codes; other words get the next free ones."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.fixed, self.rare, self.bytes = len(words), [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.fixed + len(self.rare)
        self.rare.append(word)
        self.bytes += len(word)
        return code

    def trim(self, most: int = 200_000, most_bytes: int = 32 << 20) -> bool:
        """Whether other words were forgotten, as there were too many, or of too many bytes."""
        full = len(self.rare) > most or self.bytes > most_bytes
        if full:
            for w in self.rare:
                del self[w]
            self.rare, self.bytes = [], 0
        return full


@dataclass
class Vocabulary:
    """What every task gets: the dictionary with counts, and unit numbers and totals."""

    words: list[bytes]
    counts: np.ndarray
    unit: np.ndarray  # of dictionary words
    shared_unit: np.ndarray  # by shared number
    shared_total: np.ndarray  # tokens and kinds and 1, by shared number
    single: np.ndarray  # whether a dictionary word has a unit of its own
    unit_counts: np.ndarray
    first: np.ndarray
    total: int
    kinds: int
    settings: Settings

    @property
    def end(self) -> int:
        return int(self.unit[self.words.index(END)])


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(``w`` binary, ``c`` long): how often each lower-cased (A-Z) word and the end come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            w, c = list(seen), list(seen.values())
            for i in range(0, len(w), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 50_000], pa.binary()), pa.array(c[i : i + 50_000], pa.int64())], names=["w", "c"])
            seen.clear()

        seen: Counter = Counter()
        read = 0  # bytes of text, of which no more can be in new words
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                seen.update(t.lower().split())
                read += len(t)
            seen[END] += b.num_rows
            if len(seen) > 600_000 or read > 128 << 20:
                yield from out()
                read = 0
        yield from out()

    return with_bytes(docs, text_col).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def vocabulary(known: DataFrame, s: Settings) -> Vocabulary:
    """From word counts; collects ``s.dictionary`` words and ``s.shared`` totals."""
    number = F.xxhash64(F.substring("w", -2, 2)).bitwiseAND(F.lit(s.shared - 1))
    sums = known.where(F.length("w") > 0).groupBy(number.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    # the dictionary: all words above a count that leaves at most ``s.dictionary`` of them
    step = F.floor(F.log2("c") * 64).cast("int")
    left, least = s.dictionary, None
    for r in known.where(F.length("w") > 0).groupBy(step.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect():
        left -= r["n"]
        if left < 0:
            break
        least = r["k"]
    chosen = known.where((F.length("w") > 0) & (step >= least)).collect() if least is not None else []
    top = sorted(chosen, key=lambda r: (-r["c"], bytes(r["w"])))
    end = known.where(F.length("w") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, c = [END, *(bytes(r["w"]) for r in top)], np.array([end, *(r["c"] for r in top)], np.int64)
    single = np.arange(len(words)) <= s.words
    tokens, kinds = np.zeros(s.shared, np.int64), np.zeros(s.shared, np.int64)
    for r in sums:
        tokens[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    total, n_kinds = int(tokens.sum() + end), int(kinds.sum() + (end > 0))
    group = np.array([_shared(w, s) for w in words], np.int64)
    np.subtract.at(tokens, group[1:][single[1:]], c[1:][single[1:]])
    np.subtract.at(kinds, group[1:][single[1:]], 1)
    own = int(single.sum())
    unit_counts = np.r_[c[single], tokens].astype(np.float64)
    order = np.argsort(-unit_counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    unit = np.where(single, place[np.minimum(np.arange(len(words)), own - 1)], place[own + group])
    return Vocabulary(words, c, unit, place[own:], (tokens + kinds + 1).astype(np.float64), single, unit_counts[order], gru.classes(unit_counts[order], s.classes), total, n_kinds, s)


class _Reader:
    """Texts as codes and units."""

    def __init__(self, v: Vocabulary):
        self.v, self.codes = v, _Codes(v.words)
        self.groups = np.array([_shared(w, v.settings) for w in v.words], np.int64)
        self.hashes = np.zeros(0, np.int64)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts end to end, the end token after each, and their lengths."""
        if self.codes.trim():
            self.groups, self.hashes = self.groups[: self.codes.fixed], self.hashes[:0]
        get = self.codes.__getitem__
        # text by text: a text's words are looked up while they are in the processor's cache
        parts = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in ([*t.lower().split(), END] for t in texts)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate([np.zeros(0, np.int64), *parts]), lengths

    def units(self, codes: np.ndarray) -> np.ndarray:
        v = self.v
        new = self.codes.rare[len(self.groups) - self.codes.fixed :]
        self.groups = np.r_[self.groups, np.fromiter((_shared(w, v.settings) for w in new), np.int64, len(new))]
        return np.r_[v.unit, v.shared_unit[self.groups[self.codes.fixed :]]][codes]

    def rare_hashes(self, codes: np.ndarray) -> np.ndarray:
        """Spark's ``xxhash64`` of words beyond the dictionary, by their codes."""
        new = self.codes.rare[len(self.hashes) :]
        self.hashes = np.r_[self.hashes, np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new)).view(np.int64)]
        return self.hashes[codes - self.codes.fixed]


def _dump(w: gru.Weights) -> bytes:
    return pickle.dumps(w)


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mean = 0, None
    for b in batches:
        for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = pickle.loads(raw)
            total += n
            mean = w if mean is None else {k: x + (w[k] - x) * np.float32(n / total) for k, x in mean.items()}
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([_dump(mean)], pa.binary())], names=["n", "w"])


def fit(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> gru.Weights:
    """Weights trained on all rows of ``docs``; one model of fixed size comes to the driver."""
    s, end = v.settings, v.end

    def cut(codes: np.ndarray, lengths: np.ndarray, reader: _Reader) -> list[np.ndarray]:
        units = reader.units(codes)
        return [u[i : i + s.part] for u in np.split(units, np.cumsum(lengths)[:-1]) for i in range(0, len(u), s.part)]

    w = gru.start(v.unit_counts, v.first, s.hidden)
    ordered = only(docs, _i=id_col, _t=text_col).withColumn("_o", F.xxhash64("_i", "_t"))
    # the texts of the smallest hashes: first the hashes alone, so that tasks send no texts that are not taken
    lowest = [r["_o"] for r in ordered.select("_o").orderBy("_o").limit(s.start_texts).collect()]
    some = with_bytes(ordered.where(F.col("_o") <= lowest[-1]).groupBy("_o").agg(F.first("_t").alias("_t")), "_t", "_o").orderBy("_o").collect() if lowest else []
    memory = None
    if some:
        reader = _Reader(v)
        w, memory = gru.train(w, v.first, cut(*reader.read([bytes(r["_b"]) for r in some]), reader), end)
    sent = docs.sparkSession.sparkContext.broadcast((v, w, memory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w, memory = sent.value
        memory = memory and {k: x.copy() for k, x in memory.items()}
        reader, n = _Reader(v), 0
        for b in slices(batches, most_bytes=8 << 20):
            codes, lengths = reader.read(b.column(0).to_pylist())
            w, memory = gru.train(w, v.first, cut(codes, lengths, reader), end, memory, n_lanes=1024)
            n += len(codes)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([_dump(w)], pa.binary())], names=["part", "n", "w"])

    models = kept(with_bytes(docs, text_col).mapInArrow(run, "part int, n long, w binary"))
    left = models.count()
    while left > 1:
        left = math.ceil(left / s.fan_in)
        models = models.repartition(left).select("n", "w").mapInArrow(_mean, "n long, w binary")
    got = models.select("w").first()
    return pickle.loads(got["w"]) if got else w


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from rows where ``training`` is true (null counts as false).
    ``base_score`` is the add-one unigram score.  Null and blank texts are the end
    token alone.  Repeated rows are scored one by one.  Without training rows every
    token is unknown and both scores are those of a uniform guess.
    """
    refuse((id_col,), ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    is_train = F.coalesce(training, F.lit(False))
    known = kept(counts(docs.where(is_train), text_col))
    v = vocabulary(known, settings)
    w = fit(docs.where(is_train), v, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((v, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = sent.value
        reader, row = _Reader(v), TaskContext.get().partitionId() << 36
        fixed, whole = len(v.words), math.log10(v.total + v.kinds + 1)
        share = np.log10(v.shared_total)
        plus = np.log10(v.counts + 1.0)
        for b in slices(batches, most_bytes=8 << 20):
            codes, lengths = reader.read(b.column("_b").to_pylist())
            units = reader.units(codes)
            model = gru.score(w, v.first, np.split(units, np.cumsum(lengths)[:-1]), v.end, n_lanes=1024)
            text = np.repeat(np.arange(len(lengths)), lengths)
            total = lambda x: np.bincount(text, weights=x, minlength=len(lengths))
            in_dict = codes < fixed
            short = np.where(in_dict, codes, 0)
            # words without a unit of their own: their share of the unit's counts
            group = reader.groups[codes]
            mixed = ~(in_dict & v.single[short])
            own = np.where(in_dict, plus[short], 0.0)
            model += total(np.where(mixed, own - share[group], 0.0))
            base = total(own) - lengths * whole
            seen = total(in_dict & (v.counts[short] > 0)).astype(np.int64)
            rare = reader.rare_hashes(codes[~in_dict])
            edges = np.r_[0, np.cumsum(total(~in_dict).astype(np.int64))].astype(np.int32)
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), b.column("_id"), b.column("_held"), pa.array(lengths), pa.array(seen), pa.array(base), pa.array(model), pa.ListArray.from_arrays(pa.array(edges), pa.array(rare))], names=["_row", "_id", "_held", "n_tokens", "_seen", "_base", "_model", "_rare"])
            row += n

    source = with_bytes(docs.select(F.col(f"`{id_col}`").alias("_id"), (~is_train).alias("_held"), F.col(f"`{text_col}`").alias("_t")), "_t", "_id", "_held")
    kind = source.schema["_id"].dataType.simpleString()
    done = kept(source.mapInArrow(run, f"_row long, _id {kind}, _held boolean, n_tokens long, _seen long, _base double, _model double, _rare array<long>"))
    hashed = known.where(F.length("w") > 0).select(F.xxhash64("w").alias("_h"), "c")
    rare = done.select("_row", F.explode("_rare").alias("_h")).join(hashed, "_h")
    rare = rare.groupBy("_row").agg(F.count("*").alias("_n"), F.sum(F.log10(F.col("c") + 1.0)).alias("_sum"))
    joined = done.drop("_rare").join(rare, "_row", "left")
    extra = F.coalesce("_sum", F.lit(0.0))
    return joined.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", (F.col("_seen") + F.coalesce("_n", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("_base") + extra).alias("base_score"), (F.col("_model") + extra).alias("score"))
