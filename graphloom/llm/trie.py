"""Prefix trie of conversations by smallest-member ownership, in joins, windows and two group-bys.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and
it is owned by the smallest of them.  Along a conversation's path the smallest member never falls, so what a
conversation owns is a suffix of its path, told by the depth where it begins and the tokens before that.
A sum over a subtree is then a sum over the members of its top: a conversation adds
the tokens of its turns from there on (every occurrence), less those of the nodes that it owns from there on (each
node once), and a flag for a leaf that it owns.  One group-by of prefixes adds these up.

A prefix is known by the exclusive or of 128-bit hashes of its (depth, turn) pairs, so running values give all keys of a
path and that of the node above.  Windows run over blocks of at most 1,024 depths, whose sums are carried on by
a window over blocks, so a very long conversation is spread over tasks (turns of one number meet in one block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import kept

BLOCK = 1024
#: Conversations whose ids fall in one range of so many are listed together before they meet at their node.
ID_RANGE = 1024
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, digest, words): the turns of each conversation numbered from 1 by turn, null first; ties by the SHA-256 of role and text.

    Null role and text are empty, repeated rows are turns of their own, and rows without a conversation's id belong to none.
    """
    col = lambda c: F.col(f"`{c}`")
    role, text = (F.coalesce(col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    block = F.coalesce(F.floor(col(turn_col) / BLOCK), F.lit(-(1 << 62)))
    rows = conversations.where(col(conv_col).isNotNull()).select(col(conv_col).cast("long").alias("c"), col(turn_col).alias("turn"), block.alias("block"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "digest")).cast("long"))
    later = _before(rows.groupBy("c", "block").agg(F.count("*").alias("n")), {"n": F.sum("n")})
    return rows.join(later, ["c", "block"], "left").select("c", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "digest", "words")


def _before(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What the blocks before each (c, block) sum up to; first blocks are left out."""
    w = Window.partitionBy("c").orderBy("block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("c", "block", *[value.over(past).alias(name) for name, value in sums.items()], F.row_number().over(w).alias("_k")).where("_k > 1").drop("_k")


def grafted(own: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: (c, d, digest, words) turns and (c, len) conversations.

    With h the CRC-32 of the decimal id modulo ``heads``, the first h turns are replaced by those of conversation c - c % ``group``
    (all if it has fewer, none if there is none); a conversation may be left without turns.
    """
    h = F.crc32(F.col("c").cast("string")) % heads
    convs = own.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    has = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(has, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    first = own.where((F.col("pos") < heads) & (F.col("c") % group == 0)).select(F.col("c").alias("base"), "pos", "digest", "words")
    begins = convs.select("c", "base", "head").join(first, "base").where("pos <= head").select("c", F.col("pos").alias("d"), "digest", "words")
    rest = own.join(convs.select("c", "h", "head"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "digest", "words")
    return begins.unionByName(rest), convs.select("c", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def paths(rows: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, before, words): the key of each turn's prefix and of the one above, and the tokens before the turn."""
    own = [F.xxhash64(F.lit(i), "d", "digest") for i in (1, 2)]
    rows = rows.select("c", "d", F.floor(F.col("d") / BLOCK).alias("block"), own[0].alias("x1"), own[1].alias("x2"), "words")
    w = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"k1": F.bit_xor("x1").over(w), "k2": F.bit_xor("x2").over(w), "upto": F.sum("words").over(w)})
    blocks = rows.groupBy("c", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("words").alias("bw"))
    past = _before(blocks, {"b1": F.bit_xor("b1"), "b2": F.bit_xor("b2"), "bw": F.sum("bw")})
    none = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.join(past, ["c", "block"], "left").select("c", "d", "x1", "x2", F.col("k1").bitwiseXOR(none("b1")).alias("k1"), F.col("k2").bitwiseXOR(none("b2")).alias("k2"), (F.col("upto") + none("bw") - F.col("words")).alias("before"), "words")
    return rows.select("c", "d", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "before", "words")


def prefix_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of (c, d, digest, words) ``rows`` of conversations (c, len): a row per node.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).  Depths of a conversation are 1, 2, 3 and so on.
    Without a conversation there is no root and the result is empty.
    """
    zero = F.lit(0).cast("long")
    roots = convs.select("c", zero.alias("d"), *[zero.alias(k) for k in ("k1", "k2", "p1", "p2", "before", "words")], "len")
    # an occurrence: a conversation at a node of its path
    at = kept(paths(rows).join(convs, "c").unionByName(roots))
    nodes = at.groupBy("k1", "k2", "d").agg(F.min("c").alias("owner"), F.max("len").alias("deepest"), F.min("before").alias("before"))
    leaf = (F.col("deepest") == F.col("d")).cast("long")
    owned = nodes.groupBy(F.col("owner").alias("c")).agg(F.min("d").alias("from_depth"), F.min("before").alias("from_tokens"), F.max(leaf).alias("leaf"))
    whole = at.where("d = len").select("c", "k1", "k2", (F.col("before") + F.col("words")).alias("total"))
    each = whole.select("c", "total").join(owned, "c", "left").select("c", "total", F.coalesce("from_depth", F.lit(1 << 62)).alias("from_depth"), F.coalesce("from_tokens", "total").alias("from_tokens"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    mark = at.join(each, "c")
    occurring = F.col("total") - F.col("before")
    of_owned = F.col("total") - F.greatest("before", "from_tokens")
    child = (F.col("d") < F.col("len")) & (F.col("d") + 1 >= F.col("from_depth"))
    summed = mark.groupBy("k1", "k2", "d").agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), (F.sum(occurring) - F.sum(of_owned)).alias("saved_tokens"),
        F.max(F.col("from_depth") == F.col("d")).alias("begins"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    table = kept(summed.join(ends(whole), ["k1", "k2"], "left"))
    # below the beginning of an owned suffix the node above has the same owner
    above = table.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    begins = table.where("begins AND d > 0").join(above, ["p1", "p2", "d"])
    others = table.where("NOT begins OR d = 0").withColumn("parent_conv_id", F.when(F.col("d") > 0, F.col("conv_id")))
    out = ["conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return begins.select(*out).unionByName(others.select(*out))


def ends(whole: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ascending ids, joined by commas, of those that end at a node.

    Ids are listed in ranges first; a node's ranges then come to one task in order, and run through its hash one by one.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = whole.groupBy("k1", "k2", F.floor(F.col("c") / ID_RANGE).alias("part")).agg(listed.alias("ids"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k1, k2) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield _rows(done)
        if key:
            yield _rows([(*key, state.hexdigest())])

    ordered = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids")
    return ordered.mapInArrow(work, "k1 bigint, k2 bigint, ends_sha256 string")


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), r)) for r in done], pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, heads: int = 4) -> DataFrame:
    """The prefix trie of ``conversations`` with grafted beginnings: see ``turns``, ``grafted`` and ``prefix_nodes``; other columns are not looked at."""
    own = kept(turns(conversations, conv_col, turn_col, role_col, text_col))
    return prefix_nodes(*grafted(own, group, heads))
