"""Settings of a run. The numbers are fixed values of the data model."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    min_iterations: int = 2
    max_iterations: int = 8
    bbox_inflate_points: float = 5.0
    logo_dedupe_iou: float = 0.4
    render_dpi: int = 200
    vision_dpi: int = 150
    reviewer_text_chars: int = 60_000
    min_word_height_points: float = 3.0
    background_area_ratio: float = 0.35
    background_words: int = 8
    logo_min_confidence: float = 0.0
    template_min_pages: int = 3
    template_iou: float = 0.6
    template_max_area_ratio: float = 0.25
    supplemental_min_words: int = 1
    banner_height_points: float = 22.0
    supplemental_tag: str = "SUPPLEMENTAL - non-redacted text from page {page}"
    fusion_iou: float = 0.5
    logo_keywords: tuple[str, ...] = ("logo", "brand", "emblem", "trademark", "insignia", "watermark")
    bbox_pad_points: float = 1.0
    degenerate_words_per_row: int = 25
    front_pages: int = 2
    back_pages: int = 1
    evidence_chars: int = 8_000
    pii_chunk_chars: int = 5_000
    stall_limit: int = 2
    reason_chars: int = 120


DEFAULT = Settings()
REDACTED = "[REDACTED]"
MISS_TYPES = ("PII", "MNPI", "Logo", "Consistency", "Structure", "Other")
WORD_TOOLS = ("redact_all_matching_terms", "apply_redactions")
REGION_TOOLS = ("redact_visual_regions", "redact_bbox")


def read_env_file(start: Path) -> dict[str, str]:
    """Assignments of the nearest ``.env`` from ``start`` upwards; none if there is no such file."""
    for folder in (start, *start.parents):
        path = folder / ".env"
        if path.is_file():
            rows = (line.partition("=") for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
            return {k.strip(): v.strip().strip("\"'") for k, _, v in rows}
    return {}


def settings(env: dict[str, str] | None = None) -> Settings:
    """The defaults, with the iteration cap of REDACTION_MAX_ITERATIONS: not under the minimum, the default if it is no number."""
    raw = (os.environ if env is None else env).get("REDACTION_MAX_ITERATIONS")
    try:
        most = max(DEFAULT.min_iterations, int(raw)) if raw is not None else DEFAULT.max_iterations
    except ValueError:
        most = DEFAULT.max_iterations
    return Settings(max_iterations=most)
