"""Signature and handwriting fields, images near them, and named entities of an optional model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import box, clean_entity, exact_round, iou, rounded_box, strip_space
from .lines import span_box, span_style
from .rules import COLUMNS, FIELD_RULES, HEURISTIC_RULES, REGEX_RULES, by_rule, detections, hits

ALL_RULES = REGEX_RULES + HEURISTIC_RULES + FIELD_RULES


def field_box(label: Column, width: Column, height: Column, handwriting: Column) -> Column:
    """The area to fill beside a label, or under one that ends in the right part of the page."""
    # Page size where it is missing, margins and sizes of the area.
    w = F.when(width != 0, width.cast("double")).otherwise(F.lit(595.0))
    h = F.when(height != 0, height.cast("double")).otherwise(F.lit(842.0))
    beside = label["x1"] < w * 0.70
    x0 = F.when(beside, label["x1"] + 6).otherwise(label["x0"])
    y0 = F.when(beside, F.greatest(F.lit(0.0), label["y0"] - 8)).otherwise(label["y1"] + 4)
    x1 = F.least(w - 24, F.when(beside, label["x1"] + 220).otherwise(label["x0"] + 240))
    y1 = F.least(h - 24, F.when(beside, label["y1"] + 36).otherwise(label["y1"] + 56))
    return box(x0, y0, x1, F.when(handwriting, F.least(h - 24, y1 + 20)).otherwise(y1))


def detect_fields(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Signature and handwriting keywords: the detection is the area to fill, its label_box the keyword. pages: doc_id, page, width, height."""
    rows = hits(lines, FIELD_RULES).join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    area = field_box(F.col("hit_box"), F.col("width"), F.col("height"), F.col("rule_no") == 1)
    return detections(
        rows, pii_type=by_rule(FIELD_RULES, lambda r: F.lit(r.pii_type)), confidence=by_rule(FIELD_RULES, lambda r: exact_round(F.lit(r.confidence), 3)), method=F.lit("field_heuristic"),
        rule=by_rule(FIELD_RULES, lambda r: F.lit(r.name)), phase=2, box_=rounded_box(area), style=None, label=F.col("rounded"),
    )


def detect_text(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Detections of all rules, fields included, in one pass over the lines."""
    rows = hits(lines, ALL_RULES).join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    first = len(ALL_RULES) - len(FIELD_RULES)
    field, no = F.col("rule_no") >= first, F.col("rule_no")
    phase = F.when(no < len(REGEX_RULES), 0).when(~field, 1).otherwise(2)
    within = no - F.when(no < len(REGEX_RULES), 0).when(~field, len(REGEX_RULES)).otherwise(first)
    area = field_box(F.col("hit_box"), F.col("width"), F.col("height"), no == len(ALL_RULES) - 1)
    rows = rows.withColumn("area", F.when(field, area)).withColumn("label", F.when(field, F.col("rounded"))).withColumn("style", F.when(~field, F.col("style")))
    pick = lambda value: by_rule(ALL_RULES, value)
    found = detections(
        rows, pii_type=pick(lambda r: F.lit(r.pii_type)), confidence=pick(lambda r: exact_round(F.lit(r.confidence), 3)), method=pick(lambda r: F.lit(r.method)), rule=pick(lambda r: F.lit(r.name)),
        phase=phase, box_=F.when(field, rounded_box(F.col("area"))).otherwise(F.col("rounded")), style=F.col("style"), label=F.col("label"), within=within,
    )
    return found


def near_signature(image: Column, field: Column) -> Column:
    """Whether an image overlaps a signature field, or is beside it."""
    # Overlap, and distances in points.
    level = F.abs((image["y0"] + image["y1"]) / 2 - (field["y0"] + field["y1"]) / 2) < 80
    beside = (image["x0"] <= field["x1"] + 60) & (image["x1"] >= field["x0"] - 60)
    return (iou(image, field) > 0.05) | (level & beside)


def detect_images(images: DataFrame, found: DataFrame) -> DataFrame:
    """Images near a signature: a semi-join on the page with the distance as its condition. images: doc_id, page, image_no, box."""
    fields = found.filter("type = 'SIGNATURE'").select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("box").alias("field"))
    i = images.filter("box is not null")
    marked = i.join(fields, (i["doc_id"] == fields["d"]) & (i["page"] == fields["p"]) & near_signature(i["box"], fields["field"]), "left_semi")
    rows = marked.select("doc_id", "page", F.lit("<image>").alias("value"), F.col("box").alias("image"), F.lit(0).alias("line_no"), F.lit(0).alias("rule_no"), F.col("image_no").alias("match_no"))
    return detections(rows, pii_type=F.lit("SIGNATURE_IMAGE"), confidence=exact_round(F.lit(0.70), 3), method=F.lit("image_bbox_heuristic"), rule=F.lit("image_near_signature_label"), phase=4, box_=rounded_box(F.col("image")), style=None)


def add_images(found: DataFrame, images: DataFrame) -> DataFrame:
    """Detections, and those of images near their signature fields. A page's detections meet in one row, so they are made
    once and stay where their lines are: no shuffle of theirs, if the lines were grouped by page."""
    kind = next(f.dataType.simpleString() for f in found.select(F.struct(*COLUMNS[2:]).alias("d")).schema)
    pictures = images.filter("box is not null").groupBy("doc_id", "page").agg(F.collect_list(F.struct("image_no", "box")).alias("pictures"))
    pages = found.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*COLUMNS[2:])).alias("all")).join(pictures, ["doc_id", "page"], "left")
    marked = F.filter("pictures", lambda i: F.exists("all", lambda d: (d["type"] == "SIGNATURE") & near_signature(i["box"], d["box"])))
    values = {
        "type": F.lit("SIGNATURE_IMAGE"), "original_text": F.lit("<image>"), "confidence": exact_round(F.lit(0.70), 3), "method": F.lit("image_bbox_heuristic"), "rule": F.lit("image_near_signature_label"),
    }

    def detection(i: Column) -> Column:
        own = values | {"box": rounded_box(i["box"]), "ord": F.struct(F.lit(4).alias("phase"), F.lit(0).alias("line_no"), F.lit(0).alias("rule_no"), i["image_no"].cast("int").alias("match_no"))}
        return F.struct(*(own.get(c, F.lit(None)).alias(c) for c in COLUMNS[2:])).cast(kind)

    return pages.select("doc_id", "page", F.inline(F.concat("all", F.coalesce(F.transform(marked, detection), F.array().cast(f"array<{kind}>")))))


# Labels of entity models and their types.
LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION"}


# Entity models that are tried when none is named, first found first.
MODELS = ("tr_core_news_trf", "tr_core_news_lg", "tr_core_news_sm", "en_core_web_trf", "en_core_web_lg", "en_core_web_sm", "pl_core_news_lg", "pl_core_news_sm")


def find_model(name: str | None = None, wanted: bool = True) -> tuple[Callable | None, str]:
    """A loader for detect_entities() and the status that a result file has: disabled, enabled, or why there is no model. The model must be on the workers too."""
    if not wanted:
        return None, "disabled"
    try:
        import spacy
    except ImportError:
        return None, "unavailable: spaCy is not installed"
    reasons = []
    for candidate in (name,) if name else MODELS:
        try:
            spacy.load(candidate)
        except Exception as exc:
            reasons.append(f"{candidate}: {exc}")
            continue

        def load(found: str = candidate) -> Callable[[str], list[tuple[str, int, int]]]:
            import spacy

            model = spacy.load(found)
            return lambda text: [(e.label_, e.start_char, e.end_char) for e in model(text).ents]

        return load, "enabled"
    return None, "unavailable: " + "; ".join(reasons)


def label_type(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, kind in LABELS.items():
        out = out.when(F.upper(label) == name, F.lit(kind))
    return out


def detect_entities(lines: DataFrame, load: Callable[[], Callable[[str], list[tuple[str, int, int]]]]) -> DataFrame:
    """Entities of a model. `load` runs once on each worker and returns a function that gives (label, start, end) of a line."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"label": a, "start": b, "end": c} for a, b, c in model(x or "")] for x in batch.to_pylist()], kind)

    entities = F.arrow_udf(find, "array<struct<label:string,start:int,end:int>>")
    rows = lines.filter(F.length(strip_space(F.col("text"))) > 0).select("doc_id", "page", "line_no", "text", "segments", F.posexplode(entities("text")).alias("match_no", "e"))
    rows = rows.select("*", F.col("e.start").alias("start"), F.col("e.end").alias("end"), label_type(F.col("e.label")).alias("kind"))
    rows = rows.withColumn("value", clean_entity(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))).filter("kind is not null and length(value) >= 2")
    rows = rows.withColumn("hit_box", span_box(F.col("segments"), F.col("start"), F.col("end"))).filter("hit_box is not null").withColumn("rule_no", F.lit(0))
    style = span_style(F.col("segments"), F.col("start"), F.col("end"))
    return detections(rows, pii_type=F.col("kind"), confidence=exact_round(F.lit(0.82), 3), method=F.lit("spacy_ner"), rule=F.concat(F.lit("spacy_"), F.lower(F.col("e.label"))), phase=3, box_=rounded_box(F.col("hit_box")), style=style)
