"""Personal data by patterns, and terms that disclose them by co-occurrence, in DataFrame operations only.

What the patterns find are the protected entities.  How much a term t tells of an entity e is estimated from
the whole corpus: e carries IC(e) = log2(N / w) bits, where w of all N words lie within ``window`` words of it, and
t gives away PMI(e; t) = IC(e) - log2(n / m) of them if m of its n occurrences lie there.  A term that gives away
``disclosure`` of the bits or more is found wherever it stands, also in texts without the entity: it is
replaced by a more general term that does not disclose, if a taxonomy has one, and is removed otherwise.

Copies are no evidence.  The surroundings of each occurrence of an entity are sketched by the least and greatest MD5
of their word pairs; a term counts only if it was seen beside the entity in ``support`` different surroundings at least by either
sketch, and if these are no fewer than half of its occurrences there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import kept
from .words import refuse

KINDS = ("email", "ip", "card", "phone")
# A match begins where a run of its characters does, or where the one before it ended; so no text is scanned twice over.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?()[]{}\"|*#"
#: Rows and elements of their arrays or maps of a table that is sent to all tasks; larger ones are joined by a shuffle.
SENT = 100_000
STEP = 256


@dataclass(frozen=True)
class Disclosure:
    """``disclosure``: share of an entity's bits from which on a term is held back; ``window``: words on either side; ``support``: different surroundings."""

    disclosure: float = 0.9
    window: int = 20
    support: int = 3


def running(lengths: Column) -> Column:
    """Sums up to each element of an array, in time n * 256 for n elements and n**2 / 256**2 for its blocks."""
    empty = F.array().cast("array<bigint>")
    upto = lambda a: F.aggregate(a, empty, lambda out, x: F.concat(out, F.array(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)) + x)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda b: upto(F.slice(lengths, b * STEP + 1, F.lit(STEP))))
    whole = F.flatten(F.zip_with(parts, upto(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))), lambda p, end: F.transform(p, lambda x: x + end - F.get(p, F.size(p) - 1))))
    return F.when(F.size(lengths) > 0, whole).otherwise(empty)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, i: total + F.when(i % 2 == 1, digit(i)).otherwise(twice(digit(i)))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(match))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def value(kind: str, match: Column) -> Column:
    """What occurrences of one entity have in common."""
    return F.translate(match, UPPER, LOWER) if kind == "email" else match if kind == "ip" else digits(match)


def normal(text: Column) -> Column:
    """A-Z in lower case, without the punctuation of MARKS; white space stays."""
    return F.translate(text, UPPER + MARKS, LOWER)


def terms(text: Column) -> Column:
    return F.filter(F.split(normal(text), SPACE), lambda w: w != "")


def cut(text: Column, pattern: str, matches: Column) -> Column:
    """(m, end, left, right) of each match: itself, where it ends, the texts up to its neighbours."""
    gaps = F.split(text, pattern, -1)
    ends = running(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("long")))
    return F.arrays_zip(matches.alias("m"), ends.alias("end"), F.slice(gaps, F.lit(1), F.size(matches)).alias("left"), F.slice(gaps, F.lit(2), F.size(matches)).alias("right"))


def base(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, key, words, spans, seen): spans by the patterns as (kind, start, end), and the entities with the words beside them.

    ``key`` tells texts apart; equal texts have equal spans.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    matches = {k: F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS}
    matches["email"] = F.when(F.col("text").contains("@"), matches["email"]).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({f"_{k}": m for k, m in matches.items()})
    # only texts with a match that holds are cut
    none = F.array().cast("array<struct<m: string, end: bigint, left: string, right: string>>")
    for k in KINDS:
        held = F.filter(cut(F.col("text"), PATTERNS[k], F.col(f"_{k}")), lambda x: valid(k, x["m"]))
        rows = rows.withColumn(f"_{k}", F.when(F.exists(f"_{k}", lambda m: valid(k, m)), held).otherwise(none))
    beside = lambda x: F.concat(F.reverse(F.slice(F.reverse(terms(x["left"])), 1, window)), F.slice(terms(x["right"]), 1, window))
    spans, seen = [], []
    for k in KINDS:
        spans.append(F.transform(f"_{k}", lambda x: F.struct(F.lit(k).alias("kind"), (x["end"] - F.length(x["m"])).alias("start"), x["end"].alias("end"))))
        seen.append(F.transform(f"_{k}", lambda x: F.struct(F.concat(F.lit(f"{k}:"), value(k, x["m"])).alias("entity"), beside(x).alias("beside"))))
    return rows.select("id", F.sha2("text", 256).alias("key"), F.size(terms(F.col("text"))).cast("long").alias("words"), F.concat(*spans).alias("spans"), F.concat(*seen).alias("seen"))


def sent(df: DataFrame, *lists: str) -> DataFrame:
    """``df`` for all tasks if it is small; the elements of ``lists`` count as rows do."""
    n = df.agg(F.coalesce(F.sum(sum((F.size(c) for c in lists), F.lit(1))), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= SENT else df


def revealing(docs: DataFrame, found: DataFrame, text_col: str = "text", model: Disclosure = Disclosure()) -> DataFrame:
    """(term, share): terms that give away ``disclosure`` of the bits of an entity or more, and the largest share.

    ``found``: ``base`` of ``docs``.  Terms have three characters or more, none of them a digit or @.
    """
    near = found.select(F.explode("seen").alias("x")).select("x.entity", "x.beside")
    n = F.size("beside") - 1
    pairs = F.when(n > 0, F.zip_with(F.slice("beside", F.lit(1), n), F.slice("beside", F.lit(2), n), lambda a, b: F.md5(F.concat_ws(" ", a, b))))
    sketch = lambda pick: F.coalesce(pick(pairs), F.lit(""))
    near = kept(near.select("entity", "beside", sketch(F.array_min).alias("least"), sketch(F.array_max).alias("greatest")))
    # an entity that stands alone in its text has no words beside it, and no term
    bits = near.groupBy("entity").agg(F.sum(F.size("beside")).alias("w")).where("w > 0").crossJoin(F.broadcast(found.agg(F.sum("words").alias("all"))))  # one row
    bits = bits.select("entity", F.greatest(F.log2(F.col("all") / F.col("w")), F.lit(0.0)).alias("bits"))
    met = near.select("entity", "least", "greatest", F.explode("beside").alias("term")).where(F.col("term").rlike("^[^0-9@]{3,}$"))
    met = met.groupBy("entity", "term").agg(F.count("*").alias("m"), F.least(F.countDistinct("least"), F.countDistinct("greatest")).alias("evidence"))
    met = kept(met.where((F.col("evidence") >= model.support) & (2 * F.col("evidence") >= F.col("m"))))
    wanted, every = met.select("term").distinct(), docs.select(F.explode(F.split(normal(F.col(f"`{text_col}`")), SPACE)).alias("term"))
    if met.count() <= SENT:
        n = every.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    else:
        n = every.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term", "left_semi")
    share = (F.col("bits") - F.log2(F.greatest("n", "m") / F.col("m"))) / F.col("bits")
    told = met.join(n, "term").join(bits.where("bits > 0"), "entity").select("term", share.alias("share")).where(F.col("share") >= model.disclosure)
    return told.groupBy("term").agg(F.max("share").alias("share"))


def term_spans(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    """(key, more array of (kind, start, end, label)) of the texts that hold a term of ``labels`` (term, label)."""
    text = F.col(f"`{text_col}`")
    texts = docs.where(text.isNotNull()).select(F.sha2(text, 256).alias("key"), text.alias("text"))
    held = texts.select("key", F.explode(F.array_distinct(F.split(normal(F.col("text")), SPACE))).alias("term"))
    held = kept(held.join(sent(labels), "term").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "label"))).alias("labels")))
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    rows = texts.join(sent(held, "labels"), "key").withColumn("w", words)
    ends = running(F.zip_with("w", F.slice(gaps, F.lit(1), F.size("w")), lambda m, g: (F.length(m) + F.length(g)).cast("long")))
    rows = rows.select("key", "labels", F.filter(F.arrays_zip(F.col("w").alias("w"), ends.alias("end")), lambda x: F.array_contains(F.map_keys("labels"), normal(x["w"]))).alias("hits"))
    # a word's span is without the punctuation at its ends
    core = lambda x: F.struct(F.lit("term").alias("kind"), (x["end"] - F.length(F.ltrim(x["w"], F.lit(MARKS)))).alias("start"), (x["end"] - F.length(x["w"]) + F.length(F.rtrim(x["w"], F.lit(MARKS)))).alias("end"), F.element_at(F.col("labels"), normal(x["w"])).alias("label"))
    return rows.select("key", F.transform("hits", core).alias("more")).groupBy("key").agg(F.first("more").alias("more"))


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Disclosure = Disclosure(), taxonomy: DataFrame | None = None) -> DataFrame:
    """(id, key, base, spans) of every row; ``spans``: (kind, start, end, label) of the patterns' kinds and of ``term``, by kind and start.

    ``label`` stands in a span's place.  It is [kind], or for a term the ``general`` that ``taxonomy`` (term, general) gives it, unless that
    discloses as well, or else [removed].
    """
    if not 0 < model.disclosure <= 1 or model.window < 1 or model.support < 1:
        raise ValueError("disclosure must lie in (0, 1], window and support must be positive")
    found = kept(base(docs, id_col, text_col, model.window))
    known = kept(revealing(docs, found, text_col, model))
    general = known.select("term", F.lit("[removed]").alias("label"))
    if taxonomy is not None:
        safe = taxonomy.select("term", "general").join(known.select(F.col("term").alias("general")), "general", "left_anti").groupBy("term").agg(F.min("general").alias("general"))
        general = known.join(safe, "term", "left").select("term", F.coalesce("general", F.lit("[removed]")).alias("label"))
    labelled = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"], F.concat(F.lit("["), s["kind"], F.lit("]")).alias("label")))
    rows = found.select("id", "key", F.col("spans").alias("base"))
    if known.isEmpty():  # no text holds a term
        return rows.withColumn("spans", labelled)
    more = kept(term_spans(docs, general, text_col))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, label: string>>")
    return rows.join(sent(more, "more"), "key", "left").select("id", "key", "base", F.concat(labelled, F.coalesce("more", none)).alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Disclosure = Disclosure()) -> DataFrame:
    """(``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of every row.

    ``spans``: kind:start:end by kind (email, ip, card, phone, term) and start, joined by commas, in code points.
    Null texts are empty and have no span; repeated rows and null ids are treated row by row; an empty table gives an empty
    result.  Other columns are not looked at.
    """
    refuse((id_col,), [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rows = all_spans(docs, id_col, text_col, model)
    return rows.select(F.col("id").alias(id_col), *[count("base", k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), count("spans", "term"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Disclosure = Disclosure(), taxonomy: DataFrame | None = None) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in the text column: see ``all_spans`` for what stands in their place.

    Overlapping spans are replaced by the label of the first.  Null texts stay null; other columns stay as they are.
    """
    names = docs.columns
    spans = all_spans(docs, id_col, text_col, model, taxonomy).where(F.size("spans") > 0).groupBy(F.col("key").alias("_key")).agg(F.first("spans").alias("_spans"))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    empty = F.array().cast("array<struct<start: bigint, end: bigint, label: string>>")
    last = lambda out: F.get(out, F.size(out) - 1)
    longer = lambda out, s: F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end"), last(out)["label"].alias("label"))))
    merged = F.aggregate(ordered, empty, lambda out, s: F.when((F.size(out) > 0) & (s["start"] < last(out)["end"]), longer(out, s)).otherwise(F.concat(out, F.array(s))))
    rows = docs.withColumn("_key", F.sha2(F.col(f"`{text_col}`"), 256)).join(spans, "_key", "left").withColumn("_spans", merged)
    # four bytes a code point, so that pieces are found at once
    wide, byte = F.encode(F.col(f"`{text_col}`"), "UTF-32"), lambda n: (4 * n).cast("int")
    piece = lambda a, b: F.decode(F.substring(wide, byte(a) + 1, byte(b - a)), "UTF-32")
    zero = F.lit(0).cast("bigint")
    parts = F.transform("_spans", lambda s, i: F.concat(piece(F.when(i > 0, F.get("_spans", i - 1)["end"]).otherwise(zero), s["start"]), s["label"]))
    text = F.concat(F.array_join(parts, ""), piece(last(F.col("_spans"))["end"], F.length(F.col(f"`{text_col}`")).cast("bigint")))
    return rows.withColumn(text_col, F.when(F.size("_spans") > 0, text).otherwise(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in names])
