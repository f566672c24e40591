"""Rule lists as tables, so that rules are kept and changed in SQL.

A rules table has a row per rule: name, pii_type, pattern (of Java's syntax), confidence, method, capture (the group that
is the value, which ends where the match ends: what must follow is a look-ahead), validator and finder (names out of VALIDATORS and FINDERS), prefilter and ord, by which rules are ordered.
The rules are read once, by the driver, and stand as literals in the plan; MOST_RULES bounds their number, and more are an
error. Detection is that of `detect_with_rules`: built-in expressions, no Python on executors.

    INSERT INTO rules VALUES ('badge', 'BADGE', 'B-([0-9]{4})', 0.9, 'regex', 1, NULL, 'B-', NULL, 20)
    rule_tables.create_view(spark, 'lines', 'rules', 'detections')
    SELECT rule, count(*) FROM detections WHERE confidence >= 0.8 GROUP BY rule

A view keeps the rules of the time when it was made, as a prepared statement would; make it again after a change.

Defined results: null method, capture and confidence count as 'regex', 0 and 1.0; empty prefilters as none. A null or
repeated name, a null type or pattern, a confidence outside 0 to 1, a pattern that doesn't compile or lacks the group, and
unknown names of functions raise ValueError that names the rule. A table without rules detects nothing. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import valid_national_id, valid_phone
from ..functions.emails import email_matches
from .lines import single_lines
from .rules import Rule, detect_with_rules

MOST_RULES = 1000
VALIDATORS = {"phone": valid_phone, "national_id": valid_national_id}
FINDERS = {"email": email_matches}
SCHEMA = "name string, pii_type string, pattern string, confidence double, method string, capture int, validator string, prefilter string, finder string, ord int"


def _name_of(known: dict, function) -> str | None:
    if function is None:
        return None
    for name, f in known.items():
        if f is function:
            return name
    raise ValueError(f"no name for {function}")


def to_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The rows of rules, for instance to be saved as a table; validators and finders must have names."""
    rows = [(r.name, r.pii_type, r.pattern, r.confidence, r.method, r.group, _name_of(VALIDATORS, r.validator), r.prefilter, _name_of(FINDERS, r.finder), i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, SCHEMA)


def _rule(row: Row) -> Rule:
    if not row["name"] or not row["pii_type"] or not row["pattern"]:
        raise ValueError(f"rule {row['name']!r}: name, pii_type and pattern are needed")
    confidence = 1.0 if row["confidence"] is None else row["confidence"]
    if not 0 <= confidence <= 1:
        raise ValueError(f"rule {row['name']!r}: confidence {confidence}")
    for column, known in (("validator", VALIDATORS), ("finder", FINDERS)):
        if row[column] and row[column] not in known:
            raise ValueError(f"rule {row['name']!r}: no {column} {row[column]!r}")
    return Rule(row["name"], row["pii_type"], row["pattern"], confidence, row["method"] or "regex", row["capture"] or 0, VALIDATORS.get(row["validator"]), row["prefilter"] or None, FINDERS.get(row["finder"]))


def _check_patterns(spark: SparkSession, rules: tuple[Rule, ...]) -> None:
    """Has the engine that will run the patterns compile them and look up their groups: all at once, and one by one to
    name the rule at fault. The empty alternative matches any text, so that a missing group is noticed."""
    probe = F.col("id").cast("string")

    def compiled(some: tuple[Rule, ...]) -> None:
        tests = [F.regexp_extract_all(probe, F.lit(f"(?:{r.pattern})|"), F.lit(r.group)) for r in some]
        tests += [F.regexp_extract_all(probe, F.lit(r.prefilter), F.lit(0)) for r in some if r.prefilter]
        spark.range(1).select(*(t.alias(f"t{i}") for i, t in enumerate(tests))).collect()

    try:
        compiled(rules)
    except PySparkException:
        for rule in rules:
            try:
                compiled((rule,))
            except PySparkException as error:
                raise ValueError(f"rule {rule.name!r}: its pattern, group or prefilter isn't valid: {str(error).splitlines()[0]}") from error
        raise


def from_table(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table, checked."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = table.select(*columns).orderBy("ord", "name").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rules = tuple(_rule(r) for r in rows)
    names = [r.name for r in rules]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"rules named twice: {twice}")
    if rules:
        _check_patterns(table.sparkSession, rules)
    return rules


def detect_by_table(lines: DataFrame, table: DataFrame, phase: int = 0) -> DataFrame:
    """Detections of a table's rules."""
    rules = from_table(table)
    if not rules:
        return detect_with_rules(lines.limit(0), (Rule("none", "NONE", "(?!)", 0.0),), phase)
    return detect_with_rules(lines, rules, phase)


def create_view(spark: SparkSession, lines: str, rules: str, view: str) -> None:
    """Makes a view of the detections on a table of lines (or plain documents: doc_id, text) by a table of rules."""
    source = spark.table(lines)
    found = source if "segments" in source.columns else single_lines(source, "doc_id", "text")
    detect_by_table(found, spark.table(rules)).createOrReplaceTempView(view)
