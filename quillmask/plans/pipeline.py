"""The whole job: lines, detections, replacements, anonymisation map, redaction plan."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import dedup, fields, lines, plan
from ..operators import fakes as fake


@dataclass(frozen=True)
class Layout:
    """blocks: doc_id, page, block_no, text, box, font, size, color. images: doc_id, page, image_no, box. pages: doc_id, page, width, height."""

    blocks: DataFrame
    images: DataFrame
    pages: DataFrame


def raw_detections(layout: Layout, model: Callable | None = None) -> DataFrame:
    """All detectors' rows, before repeats are removed."""
    found_lines = lines.group_lines(layout.blocks)
    found = fields.detect_text(found_lines, layout.pages)
    if model is not None:
        found = found.unionByName(fields.detect_entities(found_lines, model))
    return fields.add_images(found, layout.images)


def detect_pii(layout: Layout, min_confidence: float = 0.0, model: Callable | None = None, by_text: bool = True) -> DataFrame:
    return dedup.at_least(dedup.deduplicate(raw_detections(layout, model), by_text), min_confidence)


def build_replacements(found: DataFrame, run_key: str | None = "", scope: str = "doc", strict: bool = False, known: DataFrame | None = None) -> DataFrame:
    """run_key: '' draws one for this call; None uses no salt. known: values of an earlier call, to be used again."""
    return fake.replacements(found, dedup.order_key(), secrets.token_hex(8) if run_key == "" else run_key, scope, strict, known)


def run_pipeline(layout: Layout, run_key: str | None = "", min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, anonymisation map and redaction plan."""
    found = detect_pii(layout, min_confidence)
    mapped = plan.anonymization_map(build_replacements(found, run_key), None, dedup.order_key())
    return found, mapped, plan.redaction_plan(mapped, layout.pages)
