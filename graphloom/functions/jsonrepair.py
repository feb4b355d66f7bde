"""Tolerant JSON: what a model meant, from what it wrote.

One lenient reader walks the text once and knows at every character whether it is
in a string, so repairs never touch string contents: comments and trailing commas
are skipped, bare and single-quoted words are strings, None/True/False are
literals, and what is open at the end is closed.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = re.compile(r"^\s*```[\w-]*\s*\n?|\n?\s*```\s*$")
BARE = re.compile(r"[^\s,:\[\]{}\"']+")
HEX = re.compile(r"[0-9a-fA-F]{4}")
PART = re.compile(r"\"(?:[^\"\\]|\\.)*\"|[{}]", re.S)
WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _paired(chars: list[str]) -> str:
    """Joins escaped surrogates to the characters they stand for; one alone becomes U+FFFD."""
    text = "".join(chars)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.cut = text, 0, False

    def skip(self, also: str = "") -> None:
        t = self.text
        while self.at < len(t):
            if t[self.at].isspace() or t[self.at] in also:
                self.at += 1
            elif t.startswith("//", self.at):
                self.at = (t.find("\n", self.at) + 1) or len(t)
            elif t.startswith("/*", self.at):
                self.at = (t.find("*/", self.at) + 2) if t.find("*/", self.at) >= 0 else len(t)
            else:
                return

    def string(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return _paired(out)
            if c == "\\" and self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                if c == "u" and HEX.match(self.text, self.at):
                    c = chr(int(self.text[self.at : self.at + 4], 16))
                    self.at += 4
                else:
                    c = ESCAPES.get(c, c)
            out.append(c)
        self.cut = True
        return _paired(out)

    def value(self, depth: int = 0):
        self.skip()
        if self.at >= len(self.text) or depth > 200:
            raise ValueError("nothing here")
        c = self.text[self.at]
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in "\"'":
            return self.string()
        m = BARE.match(self.text, self.at)
        if not m:
            raise ValueError(f"unexpected {c!r}")
        self.at = m.end()
        word = m[0]
        if word.lower() in WORDS:
            return WORDS[word.lower()]
        try:
            return json.loads(word)
        except ValueError:
            return word

    def object(self, depth: int) -> dict:
        self.at += 1
        out: dict = {}
        while True:
            self.skip(",")
            if self.at >= len(self.text):
                return out
            if self.text[self.at] == "}":
                self.at += 1
                return out
            if self.text[self.at] == "]":
                return out
            key = self.value(depth + 1)
            self.skip()
            if self.at >= len(self.text) or self.text[self.at] != ":":
                if self.at >= len(self.text):
                    return out
                raise ValueError("no colon")
            self.at += 1
            self.skip()
            if self.at >= len(self.text):
                return out
            out[str(key)] = self.value(depth + 1)

    def array(self, depth: int) -> list:
        self.at += 1
        out: list = []
        while True:
            self.skip(",")
            if self.at >= len(self.text):
                return out
            if self.text[self.at] == "]":
                self.at += 1
                return out
            if self.text[self.at] == "}":
                return out
            out.append(self.value(depth + 1))


def objects(text: str) -> list[tuple[int, int]]:
    """(from, to) of the complete brace pairs of a text, found in one pass that heeds strings and one that does not.

    In the first a quotation mark without a second one is no string.
    """
    found, open_ = [], []
    at = text.find("{")
    while at >= 0:
        # strings are heeded only inside of braces
        m = PART.search(text, at) if open_ else None
        at = m.start() if m else text.find("{", at) if not open_ else -1
        if at < 0:
            break
        end = at + 1
        if text[at] == "{":
            open_.append(at)
        elif text[at] == "}":
            found.append((open_.pop(), end))
        else:
            end = m.end()
        at = end
    open_ = []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            found.append((open_.pop(), m.end()))
    return sorted(set(found))


def salvage(text: str) -> dict | None:
    """Nodes and edges from whatever complete objects stand in the text; ids stay."""
    nodes, edges, done = [], [], 0
    for at, end in objects(text):
        if at < done:
            continue  # within an object that was taken
        try:
            got = _Reader(text[at:end]).value()
        except ValueError:
            continue
        if isinstance(got, dict) and "source" in got and "target" in got:
            edges.append(got)
        elif isinstance(got, dict) and "label" in got and "nodes" not in got:
            nodes.append(got)
        else:
            continue
        done = end
    return {"nodes": nodes, "edges": edges} if nodes or edges else None


def parse(raw: str | None) -> tuple[object, str]:
    """(value, status): ok, repaired, salvaged or failed."""
    if raw is None or not raw.strip():
        return None, "failed"
    try:
        return json.loads(raw), "ok"
    except (ValueError, RecursionError):
        pass
    text = FENCE.sub("", raw)
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start >= 0:
        try:
            reader = _Reader(text[start:])
            got = reader.value()
            if got or not text[start + reader.at :].strip():
                return got, "repaired"
        except ValueError:
            pass
    got = salvage(text)
    return (got, "salvaged") if got else (None, "failed")


def as_text(value: object, status: str) -> tuple[str | None, str]:
    """A parsed value as JSON; what is nested too deeply to be written has failed."""
    try:
        return (None if status == "failed" else json.dumps(value, ensure_ascii=False)), status
    except RecursionError:
        return None, "failed"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("status", T.StringType())]))
def repair_json(raw: pd.Series) -> pd.DataFrame:
    got = [as_text(*parse(x)) for x in raw]
    return pd.DataFrame({"json": [v for v, _ in got], "status": [s for _, s in got]})
