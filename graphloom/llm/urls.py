"""URL rules, and host reputation by empirical Bayes, in DataFrame operations only.

Labelled page outcomes are counted per host.  The prior of each level is a beta
distribution around the level above: suffixes shrink to the overall rate,
registered domains to their suffix, hosts to their domain.  How strongly is
estimated from the counts of each level by the method of moments for beta-binomial
data, at the upper end of the estimate's standard error, so that few groups do not
shrink everything away by chance.  A page without a rule is blocked if its host's share of
bad pages is above the usual one with a given posterior probability, which is the same as a
posterior bound above it.  A host without labels of its own has the wide prior of its domain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import kept
from .words import refuse

#: Bounds of a prior's a + b, and what it is at a level whose counts show nothing of it.
WEAKEST, STRONGEST, UNKNOWN = 2.0, 1e4, 100.0
#: Steps of Simpson's rule on each side, and standard deviations that it covers.
STEPS, REACH = 64, 8.0
#: (verdict, host, path)
Rules = list[tuple[str, str, str]]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """``probability``: that the host's share of bad pages is above ``ratio`` times the overall rate, from which on it is blocked.

    0.75 means odds of three to one.  ``pseudo_bad`` of ``pseudo_pages`` are added to the overall counts, so
    that it is no certainty where there are few labels.
    """

    probability: float = 0.75
    ratio: float = 1.0
    pseudo_bad: float = 1.0
    pseudo_pages: float = 10.0
    #: Registered domains take one label more below these suffixes.
    two_label_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def host(url: Column) -> Column:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(host_: Column, model: Reputation) -> Column:
    two = F.substring_index(host_, ".", -2)
    return F.when(two.isin(*model.two_label_suffixes), two).otherwise(F.substring_index(host_, ".", -1))


def domain(host_: Column, model: Reputation) -> Column:
    return F.when(F.substring_index(host_, ".", -2).isin(*model.two_label_suffixes), F.substring_index(host_, ".", -3)).otherwise(F.substring_index(host_, ".", -2))


def matching_rule(host_: Column, path_: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == rule_host) | host_.endswith("." + rule_host)) & path_.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def strength(n: float, bad: float, groups: int, nn: float, q: float) -> float:
    """a + b of a level's beta prior.

    ``n``, ``bad``: labels and bad ones of all ``groups``; ``nn``: sum of squared labels; ``q``: sum of squared bad ones by labels.
    """
    p = bad / n if n else 0.0
    if groups < 2 or not 0 < p < 1:
        return UNKNOWN
    spread = (q - n * p * p) / (p * (1 - p))
    room = n - nn / n - (groups - 1)
    if room <= 0:
        return UNKNOWN
    rho = (spread - (groups - 1) + math.sqrt(2 * (groups - 1))) / room
    return min(max(1 / min(max(rho, 1e-4), 1.0) - 1, WEAKEST), STRONGEST)


def above(limit: Column, a: Column, b: Column) -> Column:
    """Probability that a beta variable with parameters ``a``, ``b`` of 1/2 and more exceeds ``limit``.

    With t = sin(x) ** 2 the density has no poles; it is integrated on both sides of the limit
    by Simpson's rule, over the part within REACH standard deviations of the mean; errors are below 0.001.
    """
    middle, width = F.asin(F.sqrt(a / (a + b))), REACH / (2 * F.sqrt(a + b))
    low, high = F.greatest(middle - width, F.lit(1e-9)), F.least(middle + width, F.lit(math.pi / 2 - 1e-9))
    cut = F.least(F.greatest(F.asin(F.sqrt(F.least(F.greatest(limit, F.lit(0.0)), F.lit(1.0)))), low), high)
    weights = F.array(*[F.struct(F.lit(i / STEPS).alias("u"), F.lit(float(1 if i in (0, STEPS) else 4 if i % 2 else 2)).alias("w")) for i in range(STEPS + 1)])
    log_f = lambda x: (2 * a - 1) * F.log(F.sin(x)) + (2 * b - 1) * F.log(F.cos(x))
    top = log_f(middle)
    part = lambda x, y: (y - x) * F.aggregate(weights, F.lit(0.0), lambda total, i: total + i["w"] * F.exp(log_f(x + (y - x) * i["u"]) - top))
    return part(cut, high) / (part(low, cut) + part(cut, high))


def reputation(pages: DataFrame, outcomes: DataFrame, model: Reputation = Reputation()) -> DataFrame:
    """(host, n, bad, worse, bad_host) of every host of ``pages`` (page, host): labels, bad ones, the probability of more than usual, the verdict.

    ``outcomes``: (page, bad 0/1).  Counts are kept in the shared folder, a row per host; all levels come from them.
    """
    seen = outcomes.where("page IS NOT NULL AND bad IS NOT NULL").groupBy("page").agg(F.max("bad").alias("bad"))
    hosts = pages.join(seen, "page", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = kept(hosts.select("host", domain(F.col("host"), model).alias("domain"), suffix(F.col("host"), model).alias("suffix"), "n", "bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    each = [df.where("n > 0").select(F.lit(level).alias("level"), "n", "bad") for level, df in (("host", hosts), ("domain", domains), ("suffix", suffixes))]
    sums = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("level").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("groups"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"))
    # three rows
    of = {r["level"]: (float(r["n"]), float(r["bad"]), r["groups"], r["nn"], r["q"]) for r in sums.collect()}
    m = {level: strength(*of.get(level, (0.0, 0.0, 0, 0.0, 0.0))) for level in ("host", "domain", "suffix")}
    n, bad = of.get("host", (0.0, 0.0))[:2]
    usual = (bad + model.pseudo_bad) / (n + model.pseudo_pages)
    mean = lambda level, up: (F.col("bad") + m[level] * up) / (F.col("n") + m[level])
    suffixes = suffixes.select("suffix", mean("suffix", F.lit(usual)).alias("_up"))
    domains = domains.join(suffixes, "suffix").select("domain", mean("domain", F.col("_up")).alias("_up"))
    hosts = hosts.join(domains, "domain").select("host", "n", "bad", "_up")
    a, b = F.col("bad") + m["host"] * F.col("_up"), F.col("n") - F.col("bad") + m["host"] * (1 - F.col("_up"))
    out = hosts.select("host", "n", "bad", above(F.lit(model.ratio * usual), F.greatest(a, F.lit(0.5)), F.greatest(b, F.lit(0.5))).alias("worse"))
    return out.withColumn("bad_host", F.col("worse") >= model.probability)


def judge(pages: DataFrame, labels: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", model: Reputation = Reputation()) -> DataFrame:
    """(``id_col``, host, path, rule, verdict, worse) of every row.

    ``labels`` has (``label_id``, quality, toxic) for some pages: bad is quality 0 or
    toxic 1, null values count as good, and an id labelled more than once is bad if
    any of its labels is.  Pages whose url is null or has no ``://`` share the empty
    host.  ``worse``: probability that the host is worse than usual.  Without any label nothing is blocked but
    by rules, and one label blocks no other host.  Repeated rows and null ids are judged row by row; an empty table gives an empty result.
    """
    if not 0.5 < model.probability < 1 or model.ratio <= 0:
        raise ValueError("probability must lie above 1/2 and below 1, ratio above 0")
    refuse((id_col,), ["host", "path", "rule", "verdict", "worse"])
    url = F.col(f"`{url_col}`")
    cut = pages.select(F.col(f"`{id_col}`").alias("page"), host(url).alias("host"), path(url).alias("path"))
    bad = ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("long")
    known = reputation(cut.select("page", "host"), labels.select(F.col(f"`{label_id}`").alias("page"), bad.alias("bad")), model)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_host"), "block").otherwise("allow")
    return cut.join(known.select("host", "worse", "bad_host"), "host", "left").select(F.col("page").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "worse")
