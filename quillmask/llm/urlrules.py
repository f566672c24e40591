"""URL filters: a list of rules, and association rules mined from labelled URLs where the list says nothing.

A URL's host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; its path is what follows up
to `?`, `#` or the end. A listed rule (host, path, verdict) fits its host and all subdomains where the path starts with the
rule's; the longest that fits wins.

Other URLs are judged by what labelled URLs have in common. A URL's tokens are the labels of its host and the segments of
its path, runs of digits as one 0. Spark's FP-growth mines the sets of tokens and label that `support` of the labelled URLs
have. A set of at most `most_tokens` tokens is a rule for a label if `confidence` of the URLs with these tokens have that
label, and no smaller set of them is as sure of it. Rules match by an inverted index, from a token to the rules that
ask for it: a rule fires where all of its tokens were met, and the surest one decides (then the one of most URLs, then block
before allow). A URL without a rule is allowed.

Sizes: tokens that occur in the same labelled URLs are one to the miner (the first by name), so that a long path that
many URLs share doesn't make all of its subsets. Frequent tokens are at most (mean tokens of a URL) / support and rules at
most (mean number of sets of `most_tokens` tokens of a URL) / support, whatever the number of URLs: tokens and rules are
held by the driver and sent to the tasks. Nothing is shuffled but counts, so a host with most of the rows is no hot key.

Defined results: null URLs and those without `://` have an empty host and path, no tokens, and are allowed; so is every URL
that no listed rule fits where no labels are given; repeated URLs and ids are judged row by row; labels of the same URL count
each; very long URLs are judged whole; an empty table gives an empty table. Added columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cascade import let

SUPPORT, CONFIDENCE, MOST_TOKENS = 0.01, 0.9, 3
ALLOW, BLOCK = "allow", "block"
#: How a label is written as an item; tokens begin with `h:` or `p:`.
LABEL = "="


@dataclass(frozen=True)
class Listed:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class Mined:
    """of: labelled URLs with all tokens; right: those of them with the verdict."""

    tokens: tuple[str, ...]
    verdict: str
    of: int
    right: int

    def order(self) -> tuple:
        return -self.right / self.of, -self.right, self.verdict != BLOCK, len(self.tokens), self.tokens


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parted(url: Column) -> Column:
    """Struct of host and path."""

    def of(rest: Column) -> Column:
        return let(F.regexp_extract(rest, "^[^/?#]*", 0), lambda host: F.struct(F.translate(host, UPPER, LOWER).alias("host"), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0).alias("path")))

    def after(u: Column) -> Column:
        at = F.instr(u, "://")
        return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))

    return let(F.coalesce(url, F.lit("")), lambda u: let(after(u), of))


def listed_rule(host: Column, path: Column, rules: list[Listed]) -> Column:
    """Struct of rule (host and path) and verdict of the longest listed rule that fits; null without one. The list is a parameter, which the driver holds."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        chain = chain.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return chain


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, in order."""
    named = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    segments = F.split(F.regexp_replace(path, "[0-9]+", "0"), "/")
    return F.array_sort(F.array_distinct(F.concat(named(F.split(host, r"\."), "h:"), named(segments, "p:"))))


def frequent_tokens(baskets: DataFrame, least: int) -> list[str]:
    """Tokens that `least` baskets have, one for all that the same baskets have. baskets: tokens, label."""
    numbered = baskets.select(F.explode("tokens").alias("token"), F.xxhash64("tokens", "label").alias("a"), F.hash("label", "tokens").cast("bigint").alias("b"))
    # equal baskets have equal hashes, so a sum over baskets tells sets of baskets apart
    found = numbered.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") % (1 << 24)).alias("s"), F.bit_xor("a").alias("x"), F.sum("b").alias("t")).filter(F.col("n") >= least)
    return sorted(r["token"] for r in found.groupBy("n", "s", "x", "t").agg(F.min("token").alias("token")).select("token").collect())


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most_tokens: int = MOST_TOKENS) -> list[Mined]:
    """The rules, surest first. labelled: tokens and label (allow or block); other labels and nulls don't count."""
    baskets = labelled.filter(F.col("label").isin(ALLOW, BLOCK)).select("tokens", "label")
    n = baskets.count()
    least = max(1, -(-int(round(n * support * 1_000_000)) // 1_000_000))
    often = frequent_tokens(baskets, least) if n else []
    if not often:
        return []
    kept = F.array_intersect("tokens", F.array(*map(F.lit, often)))
    items = baskets.select(F.concat(kept, F.array(F.concat(F.lit(LABEL), F.col("label")))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=least / n * (1 - 1e-12), minConfidence=1.0).fit(items).freqItemsets
    few = F.size(F.filter("items", lambda x: ~F.startswith(x, F.lit(LABEL))))
    counts = {tuple(sorted(r["items"])): r["freq"] for r in sets.filter((few > 0) & (few <= most_tokens)).collect()}
    return pruned(counts, confidence)


def pruned(counts: dict[tuple[str, ...], int], confidence: float) -> list[Mined]:
    """Rules of enough confidence that no rule for a part of their tokens is as sure as. counts: URLs by sorted items."""
    rules: dict[tuple[str, tuple[str, ...]], Mined] = {}
    for items, right in counts.items():
        if items[0].startswith(LABEL):  # labels come before tokens
            rule = Mined(items[1:], items[0][len(LABEL) :], counts[items[1:]], right)
            rules[rule.verdict, rule.tokens] = rule
    needed = []
    for (verdict, names), r in rules.items():
        fewer = (rules.get((verdict, part)) for k in range(1, len(names)) for part in combinations(names, k))
        if r.right >= confidence * r.of and not any(s and s.right * r.of >= r.right * s.of for s in fewer):
            needed.append(r)
    return sorted(needed, key=Mined.order)


class Index:
    """Rules by token."""

    def __init__(self, rules: list[Mined]):
        self.rules = rules
        self.by_token: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for t in r.tokens:
                self.by_token.setdefault(t, []).append(i)

    def best(self, found: list[str]) -> int | None:
        """The first rule all of whose tokens are among `found`, which are distinct."""
        met: dict[int, int] = {}
        for t in found:
            for i in self.by_token.get(t, ()):
                met[i] = met.get(i, 0) + 1
        return min((i for i, n in met.items() if n == len(self.rules[i].tokens)), default=None)


def mined_rule(found: Column, rules: list[Mined]) -> Column:
    """Place in `rules` of the rule that decides; null without one."""

    @F.arrow_udf("int")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(rules)
        for batch in batches:
            yield pa.array(map(index.best, batch.to_pylist()), pa.int32())

    return judge(found)


def judged(pages: DataFrame, listed: list[Listed], labelled: DataFrame | None = None, url: str = "url", **options) -> DataFrame:
    """Adds host, path, rule (of the list), mined (struct of tokens, confidence and support of the rule that decides where the list
    doesn't) and verdict. labelled: url and label; by default, the verdicts of the list are the labels of the URLs that it fits."""
    own = pages.withColumn("__p", parted(F.col(url))).withColumns({"host": F.col("__p")["host"], "path": F.col("__p")["path"]}).drop("__p")
    own = own.withColumn("__listed", listed_rule(F.col("host"), F.col("path"), listed))
    if labelled is None:
        known = own.filter("__listed is not null").select(tokens(F.col("host"), F.col("path")).alias("tokens"), F.col("__listed")["verdict"].alias("label"))
    else:
        known = labelled.select(parted(F.col("url")).alias("p"), "label").select(tokens(F.col("p")["host"], F.col("p")["path"]).alias("tokens"), "label")
    rules = mined(known, **options)
    out = own.withColumn("rule", F.col("__listed")["rule"])
    kind = "array<struct<tokens:array<string>,confidence:double,support:bigint,verdict:string>>"
    # URLs that the list decides ask for no tokens
    asked = F.when(F.col("__listed").isNull(), tokens(F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    at = mined_rule(asked, rules) if rules else F.lit(None).cast("int")
    texts = F.array(*(F.struct(F.array(*map(F.lit, r.tokens)), F.lit(r.right / r.of), F.lit(r.right), F.lit(r.verdict)) for r in rules)).cast(kind)
    out = out.withColumn("__at", at).withColumn("__mined", F.get(texts, F.col("__at")))
    verdict = F.coalesce(F.col("__listed")["verdict"], F.col("__mined")["verdict"], F.lit(ALLOW))
    reason = F.when(F.col("__mined").isNotNull(), F.struct(F.col("__mined")["tokens"].alias("tokens"), F.col("__mined")["confidence"].alias("confidence"), F.col("__mined")["support"].alias("support")))
    return out.withColumns({"mined": reason, "verdict": verdict}).drop("__listed", "__at", "__mined")
