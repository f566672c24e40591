"""Detection rules as expressions over lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_entity, exact_round, let, rounded_box, valid_national_id, valid_phone
from ..functions.emails import email_matches
from .lines import span_box, span_style


@dataclass(frozen=True)
class Rule:
    """`group` is what the pattern captures as the value; a captured group ends where the match ends. Lines that don't
    match the cheaper `prefilter` aren't put to the pattern. `finder`, if given, finds the pattern's matches in another way."""

    name: str
    pii_type: str
    pattern: str
    confidence: float
    method: str = "regex"
    group: int = 0
    validator: Callable[[Column], Column] | None = None
    prefilter: str | None = None
    finder: Callable[[Column], Column] | None = None


# Letter classes, patterns, names and confidences of the rules.
_L = "A-Za-zÇĞİÖŞÜçğıöşü"
_U = "A-ZÇĞİÖŞÜ"
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?<!\d)(?:\+?90[\s.\-/]*)?(?:0?[\s.\-/]*)?(?:\(?[2-5]\d{2}\)?[\s.\-/]*)\d{3}[\s.\-/]*\d{2}[\s.\-/]*\d{2}(?!\d)"
NATIONAL_ID = r"(?U)(?<!\d)[1-9]\d{10}(?!\d)"
IBAN = r"(?iU)\bTR\d{2}(?:[\s\-]?\d{4}){5}[\s\-]?\d{2}\b"
STUDENT_ID = r"(?iU)\b(?:index|student\s*(?:id|no\.?|number)|öğrenci\s*(?:no\.?|numarası|numarasi)|okul\s*no\.?|school\s*no\.?|album\s*no\.?|matriculation\s*no\.?)\s*[:#\-–]?\s*([A-Z0-9İ][A-Z0-9İ\-/]{3,24})\b"
PERSON = rf"(?iU)\b(?:full\s*name|name\s*surname|name|ad\s*soyad|ad[ıi]?\s*soyad[ıi]?|isim\s*soyisim|isim)\s*[:\-–]\s*([{_U}][{_L}'’\-]+(?:\s+[{_U}][{_L}'’\-]+){{1,3}})"
ORGANIZATION = rf"(?iU)\b(?:organization|organisation|company|institution|university|school|kurum|şirket|sirket|üniversite|universite)\s*[:\-–]\s*([{_U}][{_L}0-9 &'’.,\-]{{2,80}})"
ORGANIZATION_SUFFIX = rf"(?U)\b([{_U}][{_L}0-9 &'’.,\-]{{2,70}}\s+(?:A\.Ş\.|AS|AŞ|Ltd\.?|LLC|Inc\.?|University|Üniversitesi|Universitesi|College|Bankası|Bank))\b"
SIGNATURE = r"(?iU)\b(signature|signed\s*by|imza|ıslak\s*imza|islak\s*imza)\b"
HANDWRITING = r"(?iU)\b(handwriting|handwritten|el\s*yazısı|el\s*yazisi)\b"
REGEX_RULES = (
    Rule("email", "EMAIL", EMAIL, 0.99, prefilter="@", finder=email_matches),
    Rule("phone", "PHONE", PHONE, 0.92, validator=valid_phone, prefilter=r"(?U)[2-5]\d\d"),
    Rule("turkish_tc_id", "TURKISH_ID", NATIONAL_ID, 0.98, validator=valid_national_id, prefilter=r"(?U)\d{11}"),
    Rule("iban_tr", "IBAN", IBAN, 0.97, prefilter=r"(?iU)TR\d\d"),
    Rule("student_index_context", "STUDENT_ID", STUDENT_ID, 0.88, group=1),
)
HEURISTIC_RULES = (
    Rule("person_label", "PERSON", PERSON, 0.76, "label_heuristic", 1, prefilter=r"[:\-–]"),
    Rule("organization_label", "ORGANIZATION", ORGANIZATION, 0.73, "label_heuristic", 1, prefilter=r"[:\-–]"),
    Rule("organization_suffix", "ORGANIZATION", ORGANIZATION_SUFFIX, 0.70, "suffix_heuristic", 1, prefilter=r"(?U)\s(?:A\.Ş\.|AS|AŞ|L|Inc|Univ|Üniv|Coll|Bank)"),
)
FIELD_RULES = (
    Rule("signature_keyword", "SIGNATURE", SIGNATURE, 0.66, "field_heuristic"),
    Rule("handwriting_keyword", "HANDWRITING_FIELD", HANDWRITING, 0.62, "field_heuristic"),
)


#: Characters that no text may hold (Unicode noncharacters), put around matches; in a text they are read as U+FFFD.
OPEN, INNER, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def unmarked(text: Column) -> Column:
    return F.when(text.contains(OPEN) | text.contains(INNER) | text.contains(CLOSE), F.translate(text, OPEN + INNER + CLOSE, "\ufffd" * 3)).otherwise(text)


def marked(plain: Column, pattern: str, group: int) -> Column:
    """A text without marks, with its matches put between marks by one pass of the pattern."""
    return F.regexp_replace(plain, F.lit(pattern), F.lit(f"{OPEN}$0" + (f"{INNER}${group}" if group else "") + CLOSE))


def matches(text: Column, pattern: str, group: int) -> Column:
    """Array of struct(raw, start, end) of what the group captures, by one pass of the pattern: matches are put between
    marks, and the text is cut there. Starts follow from a running sum over what lies between."""
    return marked_spans(marked(text, pattern, group), group)


def bordered_matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern of three groups, of which the second is the value and the others are what borders it. A border is part of the match, so
    that two values need a border each: of two with one character between them, the first is found."""
    return marked_spans(F.regexp_replace(unmarked(text), F.lit(pattern), F.lit(f"$1{OPEN}$2{CLOSE}$3")), 0)


def marked_spans(replaced: Column, group: int) -> Column:
    """Array of struct(raw, start, end) of the matches that stand between marks."""
    kind = "struct<at:int,found:array<struct<raw:string,start:int,end:int>>>"

    def add(state: Column, part: Column) -> Column:
        # part: the match, the mark and the group, the mark and what follows
        return let(
            F.split(part, f"[{INNER}{CLOSE}]", -1),
            lambda x: let(
                state["at"] + F.length(x[0]),
                lambda end: F.struct((end + F.length(x[2 if group else 1])).alias("at"), F.concat(state["found"], F.array(F.struct(x[1 if group else 0].alias("raw"), (end - F.length(x[1 if group else 0])).alias("start"), end.alias("end")))).alias("found")).cast(kind),
            ),
        )

    def spans(parts: Column) -> Column:
        # most lines have a single match, which needs no running sum
        return F.when(F.size(parts) == 2, let(F.split(parts[1], f"[{INNER}{CLOSE}]", -1), lambda x: let(F.length(parts[0]) + F.length(x[0]), lambda end: alone(x, end)))).otherwise(summed(parts))

    def alone(x: Column, end: Column) -> Column:
        raw = x[1 if group else 0]
        return F.array(F.struct(raw.alias("raw"), (end - F.length(raw)).alias("start"), end.alias("end")))

    def summed(parts: Column) -> Column:
        first = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<struct<raw:string,start:int,end:int>>").alias("found")).cast(kind)
        return F.aggregate(F.slice(parts, 2, F.size(parts)), first, add, lambda s: s["found"])

    return let(F.split(replaced, OPEN, -1), spans)


def by_rule(rules: tuple[Rule, ...], value: Callable[[Rule], Column], no: str = "rule_no") -> Column:
    """A rule's value, of literals: looked up, as long chains of cases make methods that are too long to be compiled."""
    return F.get(F.array(*(value(rule) for rule in rules)), F.col(no))


def is_valid(rules: tuple[Rule, ...]) -> Column:
    out = F.when(F.col("value") == "", False)
    for i, rule in enumerate(rules):
        if rule.validator:
            out = out.when(F.col("rule_no") == i, rule.validator(F.col("value")))
    return out.otherwise(True)


#: Lines shorter than this are put to the e-mail's pattern itself: its matches are the same, and what a line may cost is bounded.
SHORT = 256


def marked_lines(lines: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each line and rule with matches: the line with its matches between marks, or as it is where the rule's finder looks for them."""
    text, plain = F.col("text"), F.col("plain")

    def of(no: int, rule: Rule) -> Column:
        found, by_finder = marked(plain, rule.pattern, rule.group), F.lit(False)
        if rule.finder:
            by_finder = F.length(text) >= SHORT if rule.finder is email_matches and rule.pattern == EMAIL else F.lit(True)
            found = F.when(by_finder, text).otherwise(found)
        if rule.prefilter:
            found = F.when(text.rlike(rule.prefilter), found)
        return F.struct(F.lit(no).alias("rule_no"), found.alias("marked"), by_finder.alias("by_finder"))

    rows = lines.select("doc_id", "page", "line_no", "segments", "text", unmarked(text).alias("plain"))
    rows = rows.select("doc_id", "page", "line_no", "segments", F.inline(F.array(*(of(no, rule) for no, rule in enumerate(rules)))))
    return rows.filter(F.col("marked").isNotNull() & (F.col("by_finder") | F.col("marked").contains(OPEN)))


def hit_spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of marked_lines() with a row per hit: match_no, raw, start, end. Most have a single match, whose place is found without a
    higher-order function, as those are interpreted; they stand in a branch for the others."""
    text, grouped = F.col("marked"), [i for i, r in enumerate(rules) if r.group]
    rows = rows.withColumn("before", F.substring_index(text, OPEN, 1))
    rows = rows.withColumn("rest", F.substr(text, F.length("before") + 2)).withColumn("body", F.substring_index("rest", CLOSE, 1))
    found = F.when(F.col("rule_no").isin(grouped), marked_spans(text, 1)).otherwise(marked_spans(text, 0)) if grouped else marked_spans(text, 0)
    for i, rule in enumerate(rules):
        if rule.finder:
            found = F.when(F.col("by_finder") & (F.col("rule_no") == i), rule.finder(text)).otherwise(found)
    many = F.col("by_finder") | F.col("rest").contains(OPEN)
    # the body is the match, or the match, a mark and the group
    raw = F.substring_index("body", INNER, -1)
    end = F.length("before") + F.length(F.substring_index("body", INNER, 1))
    one = F.struct(raw.alias("raw"), (end - F.length(raw)).alias("start"), end.alias("end"))
    rows = rows.withColumn("several", F.when(many, found)).drop("marked", "by_finder")
    # not a bare column: of one, a filter by size would be made and pushed below, with a copy of the spans
    rows = rows.select("*", F.posexplode(F.coalesce("several", F.array(one))).alias("match_no", "m"))
    return rows.select("doc_id", "page", "line_no", "segments", "rule_no", "match_no", "m.raw", "m.start", "m.end")


def hits(lines: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Lines with a row per hit: value (cleaned), hit_box (rounded: to two places) and style. Lines without a hit cost no more than
    prefilters. The rules stand in a generator, so that each is evaluated once: a column of hits would be copied
    into every filter that is pushed below it."""
    rows = hit_spans(marked_lines(lines, rules), rules)
    start, end = F.col("start"), F.col("end")
    rows = rows.withColumns({"v": clean_entity(F.col("raw")), "b": span_box(F.col("segments"), start, end), "style": span_style(F.col("segments"), start, end)}).drop("segments", "raw")
    rows = rows.select("*", F.inline(F.array(F.struct(F.col("v").alias("value"), F.col("b").alias("hit_box"), rounded_box(F.col("b")).alias("rounded"))))).drop("v", "b")
    return rows.filter(is_valid(rules)).filter("hit_box is not null")


COLUMNS = ("doc_id", "page", "type", "original_text", "box", "confidence", "method", "rule", "font", "size", "color", "label_box", "ord")


def detections(rows: DataFrame, *, pii_type: Column, confidence: Column, method: Column, rule: Column, phase: int | Column, box_: Column, style: Column | None, label: Column | None = None, within: Column | None = None) -> DataFrame:
    """Rows as detections: boxes and sizes to two places, confidences to three; ord is the order of emission. What is given is rounded, but for style's size."""
    nothing = F.lit(None)
    return rows.select(
        "doc_id",
        "page",
        pii_type.alias("type"),
        F.col("value").alias("original_text"),
        box_.alias("box"),
        confidence.alias("confidence"),
        method.alias("method"),
        rule.alias("rule"),
        (style["font"] if style is not None else nothing.cast("string")).alias("font"),
        (exact_round(style["size"], 2) if style is not None else nothing.cast("double")).alias("size"),
        (style["color"] if style is not None else nothing.cast("int")).alias("color"),
        (label if label is not None else nothing.cast("struct<x0:double,y0:double,x1:double,y1:double>")).alias("label_box"),
        F.struct(F.lit(phase).alias("phase"), F.col("line_no").cast("int").alias("line_no"), (F.col("rule_no") if within is None else within).cast("int").alias("rule_no"), F.col("match_no").cast("int").alias("match_no")).alias("ord"),
    )


def detect_with_rules(lines: DataFrame, rules: tuple[Rule, ...], phase: int = 0) -> DataFrame:
    """Detections of a list of rules."""
    return detections(
        hits(lines, rules), pii_type=by_rule(rules, lambda r: F.lit(r.pii_type)), confidence=by_rule(rules, lambda r: exact_round(F.lit(r.confidence), 3)), method=by_rule(rules, lambda r: F.lit(r.method)),
        rule=by_rule(rules, lambda r: F.lit(r.name)), phase=phase, box_=F.col("rounded"), style=F.col("style"),
    )
