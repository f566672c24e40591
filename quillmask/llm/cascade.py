"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Words are runs of characters other than the six ASCII white spaces. Each rule's cost (seconds) and selectivity (share
of rows that it rejects, of those that the base rules let through where these come first) are estimated on a bounded
sample; rules then run in the order of rejection per cost, and a row that one rule rejects isn't put to the next. The
order changes what is computed, never the verdict. A cost is the time of a job over copies of the sample less that
of the same job without the rule, the least of two runs each, so that what a job costs in itself isn't counted.

`judged` gives all measures, so they are made first and the base rules with them. `accepted` gives the rows that no rule
rejects: there the base rules have their place in the order too, and a measure is made only when a rule asks for it.

Defined results: a null or empty text has no words, so the base rules reject it; very long texts are measured whole;
repeated rows get the same verdict; an empty table gives an empty table and the rules' own order; added columns replace
columns of the same name, other columns stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's words and symbols.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rows of the sample on which rules are timed, about.
SAMPLE_ROWS = 1_000
#: Copies of it in each timed job.
COPIES = 2
#: Words that a text has at least.
LEAST_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def of(ws: Column) -> Column:
        hashed = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))

        def same(a: Column, b: Column) -> Column:
            equal = a["h"] == b["h"]
            for k in range(3):
                equal = equal & (F.get(ws, a["i"] + k) == F.get(ws, b["i"] + k))
            return F.coalesce(equal, F.lit(False))

        def count(s: Column) -> Column:
            marked = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j + 1)) | ((j > 0) & same(x, F.get(s, F.greatest(j - 1, F.lit(0))))), x["i"]))
            starts = F.filter(marked, lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return let(F.sort_array(hashed), count)

    def some(ws: Column) -> Column:
        """Most texts repeat no window, which their hashes show at once."""
        hashes = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(of(ws)))

    return let(words, lambda ws: F.when(F.size(ws) >= 3, some(ws)).otherwise(F.lit(0)))


def repeated_lines(text: Column) -> Column:
    return let(F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES)) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def lazily(text: Column, words: Column, chars: Column) -> dict[str, Column]:
    """The measures as expressions; words and chars are values that the row has."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": chars,
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": repeated_lines(text).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
    }


def with_words(text: Column, body: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """`body` of a text (null: empty) and its measures as expressions."""
    whole = F.coalesce(text, F.lit(""))
    return let(whole, lambda t: let(word_list(t), lambda ws: let(F.length(without(t, SPACES)).cast("long"), lambda n: body(t, lazily(t, ws, n)))))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    return with_words(text, lambda t, m: F.struct(*(value.alias(name) for name, value in m.items())))


def base_failed(m: Column, least_words: int = LEAST_WORDS) -> Column:
    return (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the text (never null) and its measures."""

    name: str
    rejects: Callable[[Column, Column | dict[str, Column]], Column]


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What prose doesn't do; each bound leaves a wide margin to it.
RULES = (
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("repeated_lines", lambda t, m: (m["n_dup_lines"] >= 5) & (2 * m["n_dup_lines"] > F.length(t) - F.length(without(t, "\n")) + 1)),
    Rule("capitals", lambda t, m: 10 * (F.length(t) - F.length(without(t, LETTERS))) > 3 * m["word_chars"]),
    Rule("exclamations", lambda t, m: 4 * (F.length(t) - F.length(without(t, "!"))) > m["n_words"]),
    Rule("digits", lambda t, m: 5 * (F.length(t) - F.length(without(t, "0123456789"))) > m["word_chars"]),
    Rule("letters", lambda t, m: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) * 10 < 6 * m["word_chars"]),
    Rule("bullets", lambda t, m: 10 * F.size(F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*[-*•][ \t]"), F.lit(0))) > 9 * (F.length(t) - F.length(without(t, "\n")) + 1)),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def timed(sample: DataFrame, rejected: Column) -> tuple[float, float]:
    """Seconds of a job over COPIES of the sample, the lesser of two, and the share that is rejected."""
    copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    least, share = float("inf"), 0.0
    for _ in range(2):
        began = time.perf_counter()
        share = copies.agg(F.avg(rejected.cast("double")).alias("share")).first()["share"]
        least = min(least, time.perf_counter() - began)
    return least, share or 0.0


def estimates(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, seed: int = 7, least_words: int | None = LEAST_WORDS) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample of about `rows` rows, best rejection per cost first. With least_words,
    measures are ready and rows that the base rules reject don't count; without, each rule makes what it needs."""
    n = docs.count()
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    if n > rows:
        sample = sample.sample(fraction=rows / n, seed=seed)
    if least_words is not None:
        sample = sample.select("t", measures(F.col("t")).alias("m")).filter(~base_failed(F.col("m"), least_words))
        put = lambda rule: rule(F.col("t"), F.col("m"))
    else:
        put = lambda rule: with_words(F.col("t"), rule)
    sample = sample.persist()
    try:
        sample.count()
        alone, _ = timed(sample, put(lambda t, m: m["n_words"] + m["word_chars"] < 0))
        took = [Estimate(r.name, max(seconds - alone, 1e-3), share) for r in rules for seconds, share in (timed(sample, put(r.rejects)),)]
    finally:
        sample.unpersist()
    return sorted(took, key=lambda e: -e.rejected / e.seconds)


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds the five measures, base_failed, rejected_by (the first rule of the order that rejects the row) and kept."""
    order = order if order is not None else [e.name for e in estimates(docs, text, rules, least_words=least_words)]
    by_name = {r.name: r for r in rules}
    whole = F.coalesce(F.col(text), F.lit(""))

    def verdict(m: Column) -> Column:
        failed = base_failed(m, least_words)
        chain = F.when(failed, F.lit("base"))
        for name in order:
            chain = chain.when(by_name[name].rejects(whole, m), F.lit(name))
        return F.struct(m.alias("m"), failed.alias("failed"), chain.alias("by"))

    out = docs.withColumn("__judged", let(measures(F.col(text)), verdict))
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        out = out.withColumn(name, F.col("__judged")["m"][name])
    return out.withColumn("base_failed", F.col("__judged")["failed"]).withColumn("rejected_by", F.col("__judged")["by"]).withColumn("kept", F.col("__judged")["by"].isNull()).drop("__judged")


def accepted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows that neither the base rules nor the others reject."""
    base = (Rule("few_words", lambda t, m: m["n_words"] < least_words), Rule("repetition", lambda t, m: 100 * m["n_repeat_words"] > 50 * m["n_words"]))
    rules = (*base, *rules)
    by_name = {r.name: r for r in rules}
    order = order if order is not None else [e.name for e in estimates(docs, text, rules, least_words=None)]

    def kept(t: Column, m: dict[str, Column]) -> Column:
        chain = F.when(F.lit(False), F.lit(False))
        for name in order:
            chain = chain.when(by_name[name].rejects(t, m), F.lit(False))
        return chain.otherwise(F.lit(True))

    return docs.filter(with_words(F.col(text), kept))
