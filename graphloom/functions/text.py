"""Scalar functions on labels, types and ids."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER_LATIN = 0x2FFF


@lru_cache(1)
def _folding() -> tuple[str, str, str]:
    """From Unicode's compatibility decompositions: characters with one ASCII base, those bases, and characters with several."""
    one, base, several = [], [], []
    for n in range(0x80, UPPER_LATIN):
        ascii_ = "".join(c for c in unicodedata.normalize("NFKD", chr(n)) if ord(c) < 128)
        if len(ascii_) == 1:
            one.append(chr(n))
            base.append(ascii_)
        elif ascii_:
            several.append(chr(n))
    return "".join(one), "".join(base), "".join(several)


def normalize_text(label: str | None, keep_scripts: bool = True) -> str:
    """Lower-cased ASCII skeleton of a label; a label without one keeps its own script if ``keep_scripts``."""
    text = (label or "").strip().lower()
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if ord(c) < 128)
    out = " ".join(re.sub(r"[^\w\s]", "", bare).split())
    if not out and keep_scripts:
        out = " ".join(re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", text).casefold()).split())
    return out


@F.pandas_udf(T.StringType())
def _normalize_udf(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: None if x is None else normalize_text(x))


#: White space of all scripts.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without white space of any script at its ends; null is empty."""
    return F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))


def normalize_label(label: Column) -> Column:
    """``normalize_text`` as a column.

    Latin text is folded by built-in functions; only labels with characters that
    fold to several letters or to none reach Python, the others as nulls.
    """
    one, base, several = _folding()
    text = F.lower(strip(label))
    folded = F.regexp_replace(F.translate(text, one, base), r"[^\x00-\x7F]", "")
    folded = F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\w\s]", ""), r"\s+", " "))
    # what is left of the text without the characters that fold to one letter is plain or odd
    odd = F.length(F.translate(text, several, "")) < F.length(text)
    beyond = text.rlike("[\\x{2FFF}-\\x{10FFFF}]")
    ascii_ = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(~ascii_ & (odd | beyond | ((folded == "") & (text != ""))), _normalize_udf(F.when(~ascii_ & (odd | beyond | ((folded == "") & (text != ""))), label))).otherwise(folded)


def indel_ratio(a: str, b: str) -> int:
    """100 * 2 * longest common subsequence / total length, as a whole number; bit-parallel."""
    total = len(a) + len(b)
    if not total:
        return 100
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200 * (len(a) - row.bit_count()) // total


#: Characters of the shorter label up to which pairs are compared together, in one machine word each.
WORD_BITS = 64


def _code_points(labels: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(labels), width), fill, np.uint32)
    flat = np.frombuffer("".join(labels).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, labels), np.int64, len(labels))
    out[np.arange(width) < size[:, None]] = flat
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``indel_ratio`` of many pairs: the same bit-parallel rows, for all pairs of like length at once."""
    out = np.empty(len(a), np.int32)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    short, long_ = (np.fromiter((len(p[i]) for p in pairs), np.int64, len(pairs)) for i in (0, 1))
    for i in np.flatnonzero(short > WORD_BITS).tolist():
        out[i] = indel_ratio(*pairs[i])
    todo = np.flatnonzero(short <= WORD_BITS)
    todo = todo[np.argsort(long_[todo], kind="stable")]
    for at in range(0, len(todo), 4096):
        who = todo[at : at + 4096]
        n, m = short[who], long_[who]
        # neither filling occurs in a text, and they differ
        x = _code_points([pairs[i][0] for i in who.tolist()], int(n.max()), 0xFFFFFFFF)
        y = _code_points([pairs[i][1] for i in who.tolist()], int(m.max()), 0xFFFFFFFE)
        bit = np.left_shift(np.uint64(1), np.arange(x.shape[1], dtype=np.uint64))
        full = np.where(n == WORD_BITS, ~np.uint64(0), np.left_shift(np.uint64(1), np.minimum(n, WORD_BITS - 1).astype(np.uint64)) - np.uint64(1))
        row = full.copy()
        for j in range(y.shape[1]):
            hit = row & np.where(x == y[:, j : j + 1], bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            row = (row + hit | row - hit) & full
        common, total = n - np.bitwise_count(row).astype(np.int64), n + m
        out[who] = np.where(total > 0, 200 * common // np.maximum(total, 1), 100)
    return out


@F.pandas_udf(T.IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios(a.tolist(), b.tolist()))


def relation_type(name: Column) -> Column:
    return F.regexp_replace(F.upper(strip(name)), " ", "_")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def quoted(text: Column, quote: str) -> Column:
    """Escapes for string literals of Cypher and Turtle: backslash, quote, line ends and tabs."""
    for a, b in (("\\", "\\\\"), (quote, "\\" + quote), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\-]", "_")


def pipe_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))
