"""Settings of the comparison engine. The values are fixed by the compared results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults; pass an own instance to the operators to change them."""

    max_upload_size: int = 10 * 1024 * 1024
    allowed_extensions: tuple[str, ...] = field(default=(".pdf", ".png", ".jpg", ".jpeg", ".txt", ".doc", ".docx"))
    similarity_threshold: float = 0.85
    context_similarity: float = 0.7
    context_window: int = 2
    minor_above: float = 0.95
    rewording_above: float = 0.85
    max_sentence_length: int = 500
    min_sentence_length: int = 3
    paragraph_gap: int = 2
    ocr_warning_at: float = 0.7
    preview_length: int = 500


DEFAULTS = Settings()
