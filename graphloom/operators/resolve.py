"""Entity resolution: which nodes are the same, and what the merged node looks like.

Nodes are the same if type and normalised label agree, or if the label is similar
enough to an earlier entity's of the same type.  Since exact matches come first,
labels are made distinct first.  Over distinct labels in order of first sight the
entities are the lexicographically first maximal independent set of the
similarity graph: a label is an entity if no earlier neighbour is one, and else
belongs to its earliest neighbour that is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fuzzy_ratio, normalize_label, strip
from ..schema import DEFAULT_EDGE_TYPE, DEFAULT_NODE_TYPE
from .components import components
from .materialize import materialize
from .numbering import numbered


#: Ways to leave characters out of the shorter and of the longer label of a pair up to which all are tried.
VARIANTS, TRIED = 2_000, 30_000
#: Length of the shorter label from which what is left of the longer one is looked up in the table of labels before it makes a block.
LONG = 15


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Labels and types without white space at their ends and with defaults, and the keys ``type_key`` and ``norm``."""
    kind = strip(F.col("type"))
    out = nodes.withColumns({"label": strip(F.col("label")), "type": F.when(kind == "", DEFAULT_NODE_TYPE).otherwise(kind), "description": F.coalesce("description", F.lit(""))})
    return out.withColumns({"type_key": F.lower("type"), "norm": normalize_label(F.col("label"))})


def partner_lengths(n: int, threshold: int) -> tuple[int, int]:
    """Longest partner of a label of ``n`` characters, and the most single-character edits to it."""
    longest = n * (200 - threshold) // threshold
    return longest, (n + longest) * (100 - threshold) // 100


def segments(n: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of pieces of a label so many that one is untouched in any partner not shorter."""
    k = min(n, partner_lengths(n, threshold)[1] + 1)
    edges = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def deletions(n: int, m: int, threshold: int) -> tuple[int, int] | None:
    """Characters to leave out of labels of ``n`` <= ``m`` characters so that partners become equal; None: too many ways."""
    edits = (n + m) * (100 - threshold) // 100
    less = (edits - (m - n)) // 2
    more = less + m - n
    known = not less or n >= LONG
    return (less, more) if math.comb(n, less) <= VARIANTS and math.comb(m, more) <= (TRIED if known else VARIANTS) else None


#: An odd multiplier of hashes of strings, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: Keys that are made at once.
AT_ONCE = 1 << 20


def _powers(x: int, n: int) -> np.ndarray:
    """``x`` to the powers from 0 to ``n``, modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _sums(labels: list[str], m: int) -> np.ndarray:
    """Of labels of ``m`` characters, the hash of the first 0, 1, ... m: sums of characters times powers of STEP."""
    chars = np.frombuffer("".join(labels).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(labels), m)
    out = np.zeros((len(labels), m + 1), np.uint64)
    np.cumsum(_mixed(chars.astype(np.uint64) + np.uint64(1)) * _powers(STEP, m)[:m], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


@lru_cache(8)
def _ways(m: int, leave: int) -> np.ndarray:
    """The ways to leave ``leave`` of ``m`` characters out."""
    return np.array(list(combinations(range(m), leave)), np.int64).reshape(math.comb(m, leave), leave)


def _variants(sums: np.ndarray, leave: int) -> np.ndarray:
    """Hashes of each label without any ``leave`` of its characters, (labels, ways)."""
    m = sums.shape[1] - 1
    gone = _ways(m, leave)
    begin, out = np.zeros(len(gone), np.int64), np.zeros((len(sums), len(gone)), np.uint64)
    for j, back in enumerate(_powers(BACK, leave)):
        end = gone[:, j] if j < leave else np.full(len(gone), m)
        # what lies behind j characters that were left out moves j places to the front
        out += (sums[:, end] - sums[:, begin]) * back
        begin = end + 1
    return out


def _keys(m: int, threshold: int, longer: bool) -> tuple[list[tuple[int, int, int, bool]], list[tuple[int, int, int, int]]]:
    """What blocks labels of ``m`` characters as the shorter or the longer of a pair.

    (n, m, characters left out, whether the table has what is left of the shorter one) of pairs of lengths, and (n, number, length, start) of pieces.
    """
    by_variants, by_pieces = [], []
    if not longer:
        pairs = [(m, x) for x in range(m, partner_lengths(m, threshold)[0] + 1)] if m else []
    else:
        pairs = [(x, m) for x in range(max(1, math.ceil(m * threshold / (200 - threshold))), m + 1)]
    by_segments = set()
    for pair in pairs:
        leave = deletions(*pair, threshold)
        if leave is None:
            by_segments.add(pair[0])
        elif any(leave):  # else only equal labels are partners
            by_variants.append((*pair, leave[longer], not leave[0] or pair[0] >= LONG))
    for n in sorted(by_segments):
        shift = partner_lengths(n, threshold)[1] if longer else 0
        for j, (a, k) in enumerate(segments(n, threshold)):
            by_pieces += [(n, j, k, p) for p in range(max(0, a - shift), min(m - k, a + shift) + 1)]
    return by_variants, by_pieces


#: The most bits of the table of hashes (32 MB), and its bits for each label.
TABLE_BITS, BITS_EACH = 1 << 28, 64


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a table of ``bits``, a power of two."""
    return tuple((x & np.uint64(bits - 1)).astype(np.int64) for x in (_mixed(hashes), _mixed(hashes + np.uint64(1))))


def _known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the table may have these hashes: none that it has is denied."""
    one, two = _places(hashes, 8 * len(table))
    at = np.flatnonzero(table[one >> 3] >> (one & 7).astype(np.uint8) & 1)
    out = np.zeros(len(hashes), bool)
    out[at] = (table[two[at] >> 3] >> (two[at] & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _hashes(labels: list[str], scope: np.ndarray, m: int, threshold: int, longer: bool, table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``labels``, block keys): equal keys for equal blocks.  Blocks that share a key by chance only add candidates.

    The lowest bit of a key tells blocks that both labels of a pair are in as the shorter and as the longer one.
    """
    by_variants, by_pieces = _keys(m, threshold, longer)
    ways = max([math.comb(m, k) for *_, k, _ in by_variants] + [min(len(by_pieces), AT_ONCE), 1])
    rows = max(1, AT_ONCE // max(ways, m + 1))
    low = np.uint64(1)
    for at in range(0, len(labels), rows) if by_variants or by_pieces else []:
        sums, own = _sums(labels[at : at + rows], m), scope[at : at + rows]
        made: dict[int, np.ndarray] = {}
        for n, o, k, known in by_variants:
            if k not in made:
                made[k] = _variants(sums, k)
            found = made[k]
            if longer and known and table is not None:
                # what is left has to be left of a shorter label, too
                row, col = np.divmod(np.flatnonzero(_known(table, (found ^ own[:, None]).ravel())), found.shape[1])
                found = found[row, col]
            else:
                found = np.sort(found, axis=1)
                fresh = np.ones(found.shape, bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                row, col = np.nonzero(fresh)
                found = found[row, col]
            keys = _mixed(found + _mixed(np.uint64([n << 32 | o]))[0]) ^ own[row]
            yield at + row, keys | low if n == o else keys & ~low
        back = _powers(BACK, m)
        for i in range(0, len(by_pieces), AT_ONCE // rows):
            n, j, k, p = np.array(by_pieces[i : i + AT_ONCE // rows], np.int64).T
            found = (sums[:, p + k] - sums[:, p]) * back[p]
            # the upper bit tells pieces from variants
            keys = _mixed(found + _mixed((n << 32 | j).astype(np.uint64) | np.uint64(1 << 63))) ^ own[:, None]
            yield at + np.repeat(np.arange(len(sums)), len(p)), keys.ravel() & ~low


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], int]]:
    """(ids, scopes, labels, length) of the labels of a length in (id, scope as a number, label)."""
    for b in batches:
        ids, scope = (b.column(i).to_numpy() for i in (0, 1))
        labels = b.column(2).to_pylist()
        lengths = np.fromiter(map(len, labels), np.int64, len(labels))
        order = np.argsort(lengths, kind="stable")
        for who in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            yield ids[who], scope[who].view(np.uint64), [labels[i] for i in who.tolist()], int(lengths[who[0]])


def _blocks(batches: Iterator[pa.RecordBatch], threshold: int, longer: bool, table=None) -> Iterator[pa.RecordBatch]:
    """(id, block) of (id, scope as a number, label); ``table``: a broadcast table of labels."""
    for ids, scope, labels, m in _by_length(batches):
        for row, key in _hashes(labels, scope, m, threshold, longer, table and table.value):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(key.view(np.int64))], names=["id", "block"])


def _table(rows: DataFrame, threshold: int):
    """A broadcast table of bits that the hashes of labels set, and of what is left of long ones; its size has a bound, beyond which it denies less."""
    spark = rows.sparkSession
    bits = min(TABLE_BITS, 1 << max(15, (BITS_EACH * rows.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, scope, labels, m in _by_length(batches):
            leaves = {0} | {k for *_, k, known in _keys(m, threshold, False)[0] if known}
            rows = max(1, AT_ONCE // max(math.comb(m, k) for k in leaves))
            for at in range(0, len(labels), rows):
                sums = _sums(labels[at : at + rows], m)
                for k in leaves:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(np.unique(_variants(sums, k) ^ scope[at : at + rows, None]), bits)) + 1)], names=["at"])

    found = rows.mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for k, part in found.collect():
        table[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    return spark.sparkContext.broadcast(table)


def placed(labels: DataFrame, *more: str) -> DataFrame:
    """(scope, norm, ord) and ``more`` with ``_id``, the number in order of first sight."""
    return numbered(labels.select("scope", "norm", F.col("ord").alias("_ord"), *more), ["_ord", "scope", "norm"]).withColumnsRenamed({"ord": "_id", "_ord": "ord"})


def _similar(base: DataFrame, threshold: int) -> DataFrame:
    """(u, v) with u < v: numbers of ``placed`` labels of a scope with a ratio of at least ``threshold``.

    Blocks are lossless.  Short partners become equal if a few characters are left out of
    each, so an equi-join on what is left finds these pairs and no others.  Where the shorter
    one stays whole or is long, what is left of the longer one is only kept if a table says that
    a shorter one may leave it.  Of labels longer than that,
    few edits leave one segment whole, at most that many characters away, so an equi-join on
    segments finds every pair.  Blocks are joined as numbers, of label numbers alone.
    """
    rows = base.select("_id", F.xxhash64("scope").alias("_s"), "norm")
    table = _table(rows, threshold)
    index = rows.mapInArrow(lambda it: _blocks(it, threshold, False), "id long, block long")
    probes = rows.mapInArrow(lambda it: _blocks(it, threshold, True, table), "id long, block long").withColumnRenamed("id", "other")
    pairs = index.join(probes, "block").where("id < other OR id > other AND block & 1 = 0").select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
    one, two = (base.select(F.col("_id").alias(x), F.col("scope").alias(f"_s{x}"), F.col("norm").alias(f"_n{x}")) for x in "uv")
    return pairs.join(one, "u").join(two, "v").where("_su = _sv").where(fuzzy_ratio("_nu", "_nv") >= threshold).select("u", "v")


def similar_pairs(labels: DataFrame, threshold: int) -> DataFrame:
    """(scope, norm, ord, other, other_ord) with ord < other_ord and a ratio of at least ``threshold``."""
    base = placed(labels)
    ends = base.select(F.col("_id").alias("v"), F.col("norm").alias("other"), F.col("ord").alias("other_ord"))
    return _similar(base, threshold).join(base.withColumnRenamed("_id", "u"), "u").join(ends, "v").select("scope", "norm", "ord", "other", "other_ord")


#: Labels of a component, or pairs in all, up to which one task decides them.
COMPONENT = 50_000


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entities among the earlier labels of whole components: (root, v, u), in this order."""
    root, lost, earlier = None, set(), set()
    for b in batches:
        for component, v, u in zip(*(c.to_pylist() for c in b.columns)):
            if component != root:
                yield pa.RecordBatch.from_arrays([pa.array(list(earlier - lost), pa.int64())], names=["u"])
                root, lost, earlier = component, set(), set()
            earlier.add(u)
            if u not in lost:
                lost.add(v)
    yield pa.RecordBatch.from_arrays([pa.array(list(earlier - lost), pa.int64())], names=["u"])


def _decided(pairs: DataFrame) -> DataFrame:
    """Entities (u) of (root, u, v)."""
    return materialize(pairs.sortWithinPartitions("root", "v", "u").select("root", "v", "u").mapInArrow(_decide, "u long"))


def _heads(pairs: DataFrame, most: int) -> DataFrame:
    """(v, rep): the number of the entity of each label that is none, by pairs (u, v) of similar ones with u < v.

    A round over all tasks makes labels without an earlier neighbour entities and takes them and their neighbours out.  Rounds leave few pairs as
    a rule; up to ``most`` are decided one after the other.  Once a round takes out less than half, components are looked for, and those of up to
    ``most`` labels are decided within one task each; larger ones go on in rounds.
    """
    pairs = materialize(pairs)
    _tidy(pairs.sparkSession)
    heads, open_, before, apart = [], pairs, None, False
    while (n := open_.count()) > most:
        if before and 2 * n > before and not apart:
            apart = True
            roots = components(open_)
            large = materialize(roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root"))
            of_roots = materialize(open_.join(roots.withColumnRenamed("node", "u"), "u"))
            heads.append(_decided(of_roots.join(large, "root", "left_anti").repartition("root")))
            open_ = materialize(of_roots.join(large, "root", "left_semi").select("u", "v"))
            continue
        # of these all earlier neighbours are decided, and none is an entity
        fresh = materialize(open_.select("u").distinct().join(open_.select(F.col("v").alias("u")).distinct(), "u", "left_anti"))
        lost = materialize(open_.join(fresh, "u", "left_semi").select("v").distinct())
        heads.append(fresh)
        before, open_ = n, materialize(open_.join(lost, "v", "left_anti").join(lost.withColumnRenamed("v", "u"), "u", "left_anti").select("u", "v"))
    if n:
        heads.append(_decided(open_.withColumn("root", F.lit(0)).coalesce(1)))
    # the earliest neighbour that is an entity
    known = reduce(DataFrame.unionByName, heads) if heads else pairs.select("u").limit(0)
    return pairs.join(known, "u", "left_semi").groupBy("v").agg(F.min("u").alias("rep"))


def _named(base: DataFrame, heads: DataFrame) -> DataFrame:
    """(scope, norm, rep) of ``placed`` labels."""
    names = heads.join(base.select(F.col("_id").alias("rep"), F.col("norm").alias("_rep")), "rep").select(F.col("v").alias("_id"), "_rep")
    return base.join(names, "_id", "left").select("scope", "norm", F.coalesce("_rep", "norm").alias("rep"))


def representatives(labels: DataFrame, pairs: DataFrame, most: int = COMPONENT) -> DataFrame:
    """(scope, norm, rep): the entity of each label, by ``similar_pairs``; ``most``: see ``_heads``."""
    base = placed(labels)
    u, v = (base.select("scope", F.col("norm").alias(c), F.col("_id").alias(x)) for c, x in (("norm", "u"), ("other", "v")))
    return _named(base, _heads(pairs.join(u, ["scope", "norm"]).join(v, ["scope", "other"]).select("u", "v"), most))


def _tidy(spark: SparkSession) -> None:
    """Files of shuffles that nothing needs any more go when the driver collects its garbage, which may be too late for disks."""
    spark.sparkContext._jvm.System.gc()


def entities(nodes: DataFrame, threshold: int = 90, scope: list[str] | None = None, first: bool = False) -> DataFrame:
    """``nodes`` with ``type_key``, ``norm`` and ``rep``, the normalised label of the entity.

    ``scope`` columns keep entities apart (the document, at the first of two
    levels).  A threshold over 100 merges exact matches only.  With ``first`` only
    (scope, rep, label) of the first node of each entity.
    """
    cleaned = clean_nodes(nodes)
    if threshold > 100 and not first:
        return cleaned.withColumn("rep", F.col("norm"))
    where = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in scope or []], F.col("type_key"))
    cleaned = cleaned.withColumn("scope", where)
    ord_ = (F.col("_first.graph_ord").cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)") + F.col("_first.node_ord")).cast("decimal(38,0)")
    more = ["label"] if first else []
    labels = materialize(cleaned.groupBy("scope", "norm").agg(F.min(F.struct("graph_ord", "node_ord", *more)).alias("_first")).select("scope", "norm", ord_.alias("ord"), *[f"_first.{c}" for c in more]))
    if threshold > 100:
        return labels.select("scope", F.col("norm").alias("rep"), "label")
    base = placed(labels, *more)
    del labels
    _tidy(nodes.sparkSession)
    heads = _heads(_similar(base, threshold), COMPONENT)
    if first:
        # an entity is its earliest label
        return base.join(heads.select(F.col("v").alias("_id")), "_id", "left_anti").select("scope", F.col("norm").alias("rep"), "label")
    return cleaned.join(_named(base, heads), ["scope", "norm"]).drop("scope")


def merge_nodes(resolved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per entity: first label, type and description, properties with the last value of each key, and ``first``.

    ``resolved`` is read once: its rows are counted per entity and property key before entities are put together.  Of
    each node one row, with a null key, holds label, type and description; the others hold a property each.
    """
    keys = [*(keys or []), "type_key", "rep"]
    at = F.struct("graph_ord", "node_ord")
    entries = F.map_entries("properties")
    head = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast(resolved.schema["properties"].dataType.valueType).alias("value"))
    flat = resolved.select(*keys, at.alias("_at"), "label", "type", "description", F.explode(F.concat(F.array(head), F.coalesce(entries, F.slice(F.array(head), 1, 0)))).alias("_e"))
    own = lambda c: F.when(F.col("_e.key").isNull(), c)
    flat = flat.select(*keys, "_at", own(F.struct("label", "type")).alias("_head"), own(F.when(F.col("description") != "", F.struct("_at", "description"))).alias("_told"), F.col("_e.key").alias("_k"), F.col("_e.value").alias("_v"))
    some = flat.groupBy(*keys, "_k").agg(F.min("_at").alias("_first"), F.min_by("_head", "_at").alias("_head"), F.min("_told").alias("_told"), F.max_by("_v", "_at").alias("_v"))
    whole = some.groupBy(*keys).agg(F.min("_first").alias("first"), F.max("_head").alias("_head"), F.min("_told").alias("_told"), F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v"))).alias("_props"))
    return whole.select(*keys, "first", F.col("_head.label").alias("label"), F.col("_head.type").alias("type"), F.coalesce("_told.description", F.lit("")).alias("description"), F.map_from_entries("_props").alias("properties"))


def merge(nodes: DataFrame, edges: DataFrame, threshold: int = 90) -> tuple[DataFrame, DataFrame]:
    """Merged (nodes, edges) of partial graphs.

    nodes: graph_ord, node_ord, orig_id, label, type, properties, description;
    edges: graph_ord, edge_ord, source, target, type, label, properties, evidence.
    Ids are n1, n2, ... in order of first sight; of nodes with the same id in a
    graph the last counts; edges without both ends are left out.
    """
    # read for the entities, their numbers and the ids
    resolved = materialize(entities(nodes, threshold))
    first = resolved.groupBy("type_key", "rep").agg(F.min(F.struct("graph_ord", "node_ord")).alias("_first"))
    number = numbered(first, ["_first"]).select("type_key", "rep", "ord", F.concat(F.lit("n"), F.col("ord")).alias("id"))
    merged = merge_nodes(resolved).join(number, ["type_key", "rep"])
    ids = resolved.where("orig_id IS NOT NULL").groupBy("graph_ord", "orig_id").agg(F.max_by(F.struct("type_key", "rep"), "node_ord").alias("_e")).select("graph_ord", "orig_id", "_e.*").join(number, ["type_key", "rep"]).select("graph_ord", "orig_id", "id")
    return merged.select("ord", "id", "label", "type", "properties", "description"), remap(edges, ids)


def edge_type() -> Column:
    """An edge's type without white space at its ends, or the default."""
    kind = strip(F.col("type"))
    return F.when(kind == "", DEFAULT_EDGE_TYPE).otherwise(kind)


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with global ends and defaults; ids: graph_ord, orig_id, id."""
    s = ids.select("graph_ord", F.col("orig_id").alias("source"), F.col("id").alias("_s"))
    t = ids.select("graph_ord", F.col("orig_id").alias("target"), F.col("id").alias("_t"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return edges.join(s, ["graph_ord", "source"]).join(t, ["graph_ord", "target"]).select("graph_ord", "edge_ord", F.col("_s").alias("source"), F.col("_t").alias("target"), edge_type().alias("type"), text("label").alias("label"), "properties", text("evidence").alias("evidence"))


def prune(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known, different nodes; of equal (source, target, type) the first."""
    ids = nodes.select(F.col("id").alias("source"))
    return first_of_equals(edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi").select(edges.columns))


def first_of_equals(edges: DataFrame) -> DataFrame:
    """Edges between different nodes; of equal (source, target, type) the first.  Equal ones are combined before the shuffle."""
    keys = ["source", "target", "type"]
    rest = [c for c in edges.columns if c not in keys]
    first = edges.where("source <> target").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("graph_ord", "edge_ord")).alias("_e"))
    return first.select(*keys, "_e.*").select(edges.columns)


def merge_two_levels(nodes: DataFrame, edges: DataFrame, threshold: int = 90, doc_col: str = "doc_ord", metrics=None) -> tuple[DataFrame, DataFrame]:
    """Within each document first, then across documents; both levels prune.  ``metrics`` counts the edges of the second."""
    scoped = materialize(entities(nodes, threshold, [doc_col]))
    inner = merge_nodes(scoped, [doc_col])
    order = Window.partitionBy(doc_col).orderBy("first")
    inner = materialize(inner.withColumn("node_ord", F.row_number().over(order)).withColumn("orig_id", F.concat(F.lit("n"), F.col("node_ord"))))
    ids = scoped.where("orig_id IS NOT NULL").groupBy(doc_col, "graph_ord", "orig_id").agg(F.max_by(F.struct("type_key", "rep"), "node_ord").alias("_e")).select(doc_col, "graph_ord", "orig_id", "_e.*").join(inner.select(doc_col, "type_key", "rep", F.col("orig_id").alias("id")), [doc_col, "type_key", "rep"]).select(doc_col, "graph_ord", "orig_id", "id")
    s = ids.withColumnsRenamed({"orig_id": "source", "id": "_s"})
    t = ids.withColumnsRenamed({"orig_id": "target", "id": "_t"})
    local = edges.join(s, [doc_col, "graph_ord", "source"]).join(t, [doc_col, "graph_ord", "target"]).drop("source", "target").withColumnsRenamed({"_s": "source", "_t": "target"}).withColumn("type", edge_type())
    # within a document a window sorts once, where combining first would sort twice
    first = Window.partitionBy(doc_col, "source", "target", "type").orderBy("graph_ord", "edge_ord")
    local = local.where("source <> target").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    local = local.withColumn("edge_ord", F.row_number().over(Window.partitionBy(doc_col).orderBy("graph_ord", "edge_ord"))).withColumn("graph_ord", F.col(doc_col))
    outer = inner.select(F.col(doc_col).alias("graph_ord"), "node_ord", "orig_id", "label", "type", "properties", "description")
    merged, joined = merge(outer, local, threshold)
    # both ends are known
    if not metrics:
        return merged, first_of_equals(joined)
    return merged, metrics.after_pruning(first_of_equals(metrics.before_pruning(joined)))
