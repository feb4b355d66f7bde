"""Byte-level BPE by speculation and verification, and the inverse.

A text is cut where no token can reach across (before a space or around other
white space); each distinct piece is encoded once and remembered.  New pieces of
a whole slice go together: greedy longest match proposes tokens for each, one
vectorised check tests every adjacent pair of all proposals at once, and only
pieces with a failing pair are merged exactly, rule by rule.

Why pairs suffice: merging works on a sequence of tokens only where two of them
meet, so a proposal is what merging would give exactly if, at every boundary,
no merge across it would have come before the merges that built its two sides.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import refuse, slices

#: Pieces that a worker remembers, and bytes of these and their ids; on reaching either it starts afresh.
MEMORY, MEMORY_BYTES = 600_000, 64 << 20
NEVER = np.int64(1) << 40
#: Pieces of more bytes are merged one by one.
LONG = 48

#: White space of the tokenizer's ``\s``: Unicode White_Space.  ``re`` adds 0x1C-0x1F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CUT = re.compile(r" ?\S+|\s+(?!\S)|\s")
CUT_EXACT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
UNLIKE = re.compile("[\x1c-\x1f]")
#: Up to here the Unicode versions of all libraries agree on letters and digits.
LAST = 0x24F
SETTLED = re.compile(f"[^\x00-{chr(LAST)}]")


def _class(kind: str) -> str:
    """Characters up to LAST of a general category, for a pattern."""
    return "".join(chr(n) for n in range(LAST + 1) if unicodedata.category(chr(n))[0] == kind)


#: Pre-tokens of texts with no other characters.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^\s{_class('L')}{_class('N')}]+|\s+(?!\S)|\s+")


def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.path, self._native = path, None
        self.byte_of = {c: b for b, c in byte_chars().items()}
        self.vocab = {self._raw(t): i for t, i in model["vocab"].items()}
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens with stripping or normalising are not supported")
            self.special[t["content"]] = t["id"]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for t, i in [*self.vocab.items(), *((c.encode(), i) for c, i in self.special.items())]:
            table[i] = t
        self.bytes_of = table
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.longest = max(map(len, self.vocab))
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        #: By id: the rank of the merge that makes the token, and its two parts.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self._raw(a), self._raw(b)
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (i, j) not in self.merges:
                self.merges[i, j] = (r, k)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys = np.array([i << 20 | j for i, j in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.single_of = np.array(self.single, np.int64)
        self.made_by = np.zeros(len(model["merges"]), np.int64)
        for r, k in self.merges.values():
            self.made_by[r] = k
        nodes: dict[int, int] = {}
        tokens = [-1]
        for t, k in self.vocab.items():
            at = 0
            for b in t:
                if (key := at << 8 | b) not in nodes:
                    nodes[key] = len(tokens)
                    tokens.append(-1)
                at = nodes[key]
            tokens[at] = k
        keys, values = np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes, self.trie_token = keys[order], values[order], np.array(tokens, np.int64)
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _raw(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token)

    # ------------------------------------------------------------ pieces
    def split(self, part: str) -> list[bytes]:
        """Pre-tokens of a part without inner white space."""
        if SETTLED.search(part) is None and UNLIKE.search(part) is None:
            return [p.encode() for p in PIECES.findall(part)]
        if self._native is None:
            from tokenizers import Tokenizer

            self._native = Tokenizer.from_file(self.path).pre_tokenizer
        return [self._raw(p) for p, _ in self._native.pre_tokenize_str(part)]

    def propose(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for all pieces in step: (ids, number of ids of each piece).

        Every live piece walks a trie of the vocabulary a byte at a time; where it
        ends, the longest token seen is emitted and the walk starts anew behind it.
        """
        text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size)
        who, at = np.arange(len(pieces)), end - size
        end = end.copy()
        node, token, to = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), at.copy()
        owners, found = [], []
        while len(who):
            inside = at < end
            key = node << 8 | text[np.minimum(at, len(text) - 1)]
            i = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            step = inside & (self.trie_keys[i] == key)
            node, at = np.where(step, self.trie_nodes[i], 0), np.where(step, at + 1, to)
            ends_here = step & (self.trie_token[node] >= 0)
            out = ~step
            if out.any():
                owners.append(who[out])
                found.append(token[out])
            token, to = np.where(ends_here, self.trie_token[node], token), np.where(ends_here, at, to)
            live = step | (to < end)
            if not live.all():
                who, at, end, node, token, to = (x[live] for x in (who, at, end, node, token, to))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(found)[order] if found else owner), np.bincount(owner, minlength=len(pieces))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between tokens a[i] and b[i] alone.

        Undoes the merges of both sides from the last to the first.  At each stage
        the parts that meet at the boundary may not have a merge that comes before
        the merge undone last; at equal rank the left one comes first.
        """
        ok = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        while len(live):
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def merge(self, piece: bytes) -> list[int]:
        """Exact merging of one piece of any length: the lowest rank first, the leftmost of equals."""
        ids = [self.single[b] for b in piece]
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := (ids[x], ids[after[x]])) in merges:
                    heappush(heap, (merges[p][0], x, *p))
        return [i for i in ids if i >= 0]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Exact merging of many short pieces of one length, a merge of each at a time; ids as bytes."""
        n = len(pieces[0])
        ids = self.single_of[np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)]
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), NEVER)
            over = least == NEVER
            raw, width = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(row[over].tolist()):
                out[i] = raw[k * width : (k + 1) * width]
            go = ~over
            if not go.any():
                return out
            row, ids, ranks, best, least = row[go], ids[go], ranks[go], best[go], least[go]
            at, width = np.arange(len(row)), ids.shape[1]
            ids[at, best] = self.made_by[least]
            ids = ids[np.arange(width) != (best + 1)[:, None]].reshape(len(row), width - 1)
            ranks = ranks[np.arange(width - 1) != best[:, None]].reshape(len(row), width - 2)
            has = best > 0
            ranks[at[has], best[has] - 1] = self.pair_rank(ids[at[has], best[has] - 1], ids[at[has], best[has]])
            has = best < width - 2
            ranks[at[has], best[has]] = self.pair_rank(ids[at[has], best[has]], ids[at[has], best[has] + 1])

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes new pieces and remembers them."""
        new = list(pieces)
        made = self.encode_pieces(new)
        self.memo.update(zip(new, made))
        self.held += sum(map(len, new)) + sum(map(len, made))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces: proposed, verified, and merged exactly where the check fails."""
        raw = [x.encode("utf-8", "surrogateescape") for x in pieces]
        ids, sizes = self.propose(raw)
        owner = np.repeat(np.arange(len(raw)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.unique(owner[inner[~self.compatible(ids[inner], ids[inner + 1])]])
        flat, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        by_size: dict[int, list[int]] = {}
        for i in failed.tolist():
            by_size.setdefault(len(raw[i]), []).append(i)
        for size, which in by_size.items():
            if size > LONG:
                for i in which:
                    out[i] = np.array(self.merge(raw[i]), "<u4").tobytes()
            for k in range(0, len(which) if size <= LONG else 0, 1 << 13):
                for i, got in zip(which[k : k + (1 << 13)], self.merge_all([raw[i] for i in which[k : k + (1 << 13)]])):
                    out[i] = got
        self.checked, self.failed = getattr(self, "checked", 0) + len(raw), getattr(self, "failed", 0) + len(failed)
        return out

    # ------------------------------------------------------------ texts
    def pieces_of(self, text: str) -> list[str]:
        """Pre-tokens of a text; where libraries' Unicode versions differ, those of the parts between white space that have such characters."""
        odd = UNLIKE.search(text)
        if odd is None and SETTLED.search(text) is None:
            return PIECES.findall(text)
        out: list[str] = []
        for part in (CUT_EXACT if odd else CUT).findall(text):
            if SETTLED.search(part) or UNLIKE.search(part):
                out += [x.decode("utf-8", "surrogateescape") for x in self.split(part)]
            else:
                out += PIECES.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMORY or self.held > MEMORY_BYTES:
            self.memo.clear()
            self.held = 0
        any_mark = list(self.special)
        mark = re.compile("|".join(map(re.escape, sorted(any_mark, key=len, reverse=True)))) if any_mark else None
        work: list[list] = []  # of each text: pieces, and ids of special tokens between
        for t in texts:
            runs: list = []
            at = 0
            for m in mark.finditer(t) if any(c in t for c in any_mark) else ():
                runs += [self.pieces_of(t[at : m.start()]), self.special[m[0]]]
                at = m.end()
            runs.append(self.pieces_of(t[at:] if at else t))
            work.append(runs)
        new = set().union(*(r for runs in work for r in runs if not isinstance(r, int))).difference(self.memo)
        if new:
            self.learn(new)
        get = self.memo.__getitem__
        return [b"".join(r.to_bytes(4, "little") if isinstance(r, int) else b"".join(map(get, r)) for r in runs) for runs in work]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        i = np.frombuffer(ids, "<u4")
        if not len(i):
            return b""
        n = self.sizes[i]
        ends = np.cumsum(n)
        raw = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[i] - (ends - n), n)].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec per file and worker process."""
    return Codec(path)


def texts_of(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_b"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``ids`` binary) of every row: the text's token ids, little-endian unsigned 32-bit.

    Null texts count as empty and have no ids; rows are handled one by one, so
    repeated rows and null ids pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode(b.column(1).to_pylist()), pa.binary())], names=[id_col, "ids"])

    source = texts_of(docs, text_col, id_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, ``text``) from a column of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x).decode() for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    source = encoded.select(f"`{id_col}`", F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("_b"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``n_tokens`` and the SHA-256 of the ids and of the text decoded from them, in one pass.

    Null texts count as empty and have no tokens; repeated rows and null ids pass through; an empty table gives an empty
    result; other columns are not read.
    """
    refuse((id_col,), ["n_tokens", "ids_sha256", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            ids = c.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(c.decode(x)) for x in ids), pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = texts_of(docs, text_col, id_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
