"""URL filtering by host rules and by association rules mined from labelled URLs.

A URL's host and path decide by the longest fitting host rule.  Where none
fits, mined rules do: FP-growth finds token combinations of labelled URLs whose
support and confidence for "block" are high, and a rule fires on every URL that
has all its tokens.  What can't change a verdict isn't mined: tokens that always
stand together are one item; a token that is a rule by itself fires wherever a
combination with it does; and no combination has more support than its tokens,
so those of less than the least are left out.  URLs without a label count as not blocked there, so that a
rule's confidence is a lower bound.  Rules are found by an inverted index that holds each rule
once, under its rarest token.

A null URL, or one without ``://``, has an empty host and path, fits no host
rule and has no tokens: it is allowed.  Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import lookup, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The host rules of the task.
RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))


def after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_rule(rules: Sequence[HostRule], host: Column, path: Column, value: str) -> Column:
    """The ``name`` or ``verdict`` of the longest rule that fits; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: host labels, path parts without numbers, extension, query names, fragment."""
    rest = after_scheme(url)
    tail = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    last = F.regexp_extract(path(url), r"\.([A-Za-z]{1,5})$", 1)
    word = lambda prefix: lambda x: F.concat(F.lit(prefix), x)
    full = lambda x: x != ""
    hosts = F.transform(F.filter(F.split(host(url), r"[.\-:]"), full), word("host:"))
    paths = F.transform(F.filter(F.split(F.lower(path(url)), r"[/._\-]"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), word("path:"))
    names = F.transform(F.filter(F.transform(F.split(tail, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), full), word("query:"))
    extra = F.filter(F.array(F.when(last != "", F.concat(F.lit("ext:"), F.lower(last))), F.when(rest.contains("#"), F.lit("fragment"))), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(hosts, paths, names, extra)))


@dataclass
class UrlRules:
    """Mined rules: (key, antecedent, confidence, support) of items, each under its rarest item ``key``; ``items`` has the item of each token that stands in a rule (token, item)."""

    index: DataFrame
    items: DataFrame

    @classmethod
    def fit(cls, labelled: DataFrame, min_support: float, min_confidence: float) -> UrlRules:
        """``labelled`` has url and verdict (block, allow or null).

        At most 1/min_support tokens of one URL position are frequent, which
        bounds what is counted.  The number of combinations is that of items that
        are frequent together, aren't rules by themselves and don't always stand
        together; only this is exponential.
        """
        pages = labelled.select(tokens(F.col("url")).alias("tokens"), (F.coalesce(F.col("verdict"), F.lit("")) == "block").cast("long").alias("blocked"))
        sets = written(pages.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked")), "labelled-sets")
        total = sets.agg(F.sum("n")).first()[0] or 0
        least = math.ceil(min_support * total)
        # tokens of one item are in the same token sets: as many, and with equal sums of the sets' hashes
        seen = F.xxhash64("tokens")
        part = lambda by: F.sum(F.shiftrightunsigned(seen, by).bitwiseAND(F.lit(0xFFFFFFFF)))
        each = sets.select("n", "blocked", seen.alias("_"), F.explode("tokens").alias("token"), "tokens").groupBy("token").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), part(0).alias("low"), part(32).alias("high"), F.count(F.lit(1)).alias("sets"))
        frequent = each.where(F.col("blocked") >= F.lit(max(least, 1)))
        items = frequent.groupBy("n", "blocked", "low", "high", "sets").agg(F.min("token").alias("item"), F.collect_list("token").alias("members"))
        items = written(items.select("item", "members", "n", "blocked", (F.col("blocked") / F.col("n") >= min_confidence).alias("alone")), "items")
        members = items.select(F.explode("members").alias("token"), "item", "alone")
        held = written(sets.select("tokens", "n").join(mapped(sets.select("tokens"), members.where("not alone")), "tokens", "left"), "item-sets")
        # FP-growth counts baskets: one for every page, also where many pages share a token set
        label = F.when(F.col("blocked") > 0, F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
        baskets = lookup(pages, held, "tokens", "n").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), label).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select("antecedent", "confidence", "support")
        rarest = rules.select("*", F.explode("antecedent").alias("item")).join(items, "item").groupBy("antecedent").agg(F.min(F.struct("n", "item"))["item"].alias("key"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
        single = items.where("alone").select(F.col("item").alias("key"), F.array("item").alias("antecedent"), (F.col("blocked") / F.col("n")).alias("confidence"), (F.col("blocked") / F.lit(max(total, 1))).alias("support"))
        return cls(single.unionByName(rarest.select("key", "antecedent", "confidence", "support")), members.select("token", "item"))

    def match(self, token_sets: DataFrame) -> DataFrame:
        """Of distinct token sets (``tokens``), those on which a rule fires: tokens, confidence (of the surest rule that was mined)."""
        held = mapped(token_sets, self.items)
        posted = held.select("tokens", "items", F.explode("items").alias("key")).join(self.index, "key")
        fires = posted.where(F.size(F.array_except("antecedent", "items")) == 0)
        return fires.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def mapped(token_sets: DataFrame, items: DataFrame) -> DataFrame:
    """Token sets with the items of their tokens: tokens, items; without sets that have none."""
    return token_sets.select("tokens", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))


def judge(pages: DataFrame, rules: Sequence[HostRule] = RULES, min_support: float = 0.01, min_confidence: float = 0.7, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict, confidence (of the mined rule that blocks).

    URLs on which a host rule decides carry its verdict as their label; the
    mined rules carry that judgement to URLs on which none does.
    """
    url = F.col("url")
    ours = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host(url), "path": path(url)})
    ours = ours.withColumns({"rule": host_rule(rules, F.col("host"), F.col("path"), "name"), "verdict": host_rule(rules, F.col("host"), F.col("path"), "verdict")})
    decided, open_ = ours.where(F.col("rule").isNotNull()), ours.where(F.col("rule").isNull()).withColumn("tokens", tokens(url))
    sets = written(open_.groupBy("tokens").agg(F.count(F.lit(1)).alias("rows")), "token-sets")
    mined = UrlRules.fit(ours.select("url", "verdict"), min_support, min_confidence).match(sets.select("tokens"))
    # many pages may share a token set, the empty one for example
    by_method = lookup(open_, written(sets.join(mined, "tokens", "left"), "fired"), "tokens", "rows").select("page_id", "host", "path", "rule", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow").alias("verdict"), "confidence")
    by_rule = decided.select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("confidence"))
    return by_rule.unionByName(by_method)
