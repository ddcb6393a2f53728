"""Fixed values and settings of the boundary heuristics."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

# Patterns, keywords and phrases that decide results.
DATES = (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}-\d{1,2}-\d{2,4}\b", r"\b\w+ \d{1,2}, \d{4}\b")
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
KEYWORDS = ("MEMORANDUM", "INVOICE", "CONTRACT", "AGREEMENT", "LETTER", "REPORT", "NOTICE", "CERTIFICATE", "STATEMENT", "RECEIPT", "FORM", "APPLICATION")
TUNED_KEYWORDS = ("MEMORANDUM", "INVOICE", "CONTRACT", "AGREEMENT", "REQUEST FOR INFORMATION", "RFI", "SUBMITTAL", "APPLICATION FOR PAYMENT", "PURCHASE ORDER", "QUOTATION", "PROPOSAL")
PAGE_NUMBERS = (r"Page \d+ of \d+", r"Page \d+$", r"^\d+$")
PAGE_FRACTION = r"\d+/\d+$"
#: Patterns of page numbers whose matches cut no run of digits.
WHOLE_NUMBERS = (*PAGE_NUMBERS, PAGE_FRACTION)
EMAIL_HEADERS = (r"^From:\s*.*\nTo:\s*.*\nSubject:\s*", r"^From:\s*.*\nSent:\s*.*\nTo:\s*")
EMAIL_DATED = r"^From:\s*.*\nDate:\s*.*\nTo:\s*"
#: What every match of a pattern holds, whatever the case of its letters: a text without it is not searched.
NEEDED = {DATES[0]: "/", DATES[1]: "-", DATES[2]: ", ", ISO_DATE: "-"} | dict.fromkeys((*EMAIL_HEADERS, EMAIL_DATED), ":")
EMAIL_FIELDS = ("From:", "To:", "Subject:", "Date:", "Sent:", "CC:", "BCC:")
PHRASES = ("Sincerely", "Very truly yours", "Respectfully", "Best regards", "Thank you", "Regards", "Respectfully submitted", "Yours truly")
DOCUMENT_TYPES = {
    "Invoice": (r"invoice\s*#?\s*\d+", r"bill\s*to", r"total\s*amount", r"invoice\s*date", r"payment\s*due"),
    "Email": (r"from:\s*\S+@\S+", r"to:\s*\S+@\S+", r"subject:", r"date:\s*\w+", r"sent:\s*\w+"),
    "Letter": (r"dear\s+\w+", r"sincerely", r"regards", r"yours\s+truly", r"to\s+whom\s+it\s+may\s+concern"),
    "Plans": (r"drawing\s*#?\s*\d+", r"scale:\s*\d+", r"project:", r"architect:", r"engineer:"),
    "Contract": (r"agreement", r"whereas", r"party\s+of\s+the\s+first", r"terms\s+and\s+conditions", r"signature"),
    "Report": (r"executive\s+summary", r"table\s+of\s+contents", r"conclusion", r"recommendations", r"findings"),
}
IDENTIFIERS = {
    "Invoice": (r"invoice\s*#?\s*(\d+)", r"inv\s*#?\s*(\d+)"),
    "Contract": (r"contract\s*#?\s*([\w\-]+)", r"agreement\s*#?\s*([\w\-]+)"),
    "Plans": (r"drawing\s*#?\s*([\w\-]+)", r"sheet\s*#?\s*([\w\-]+)"),
    "Report": (r"report\s*#?\s*([\w\-]+)", r"document\s*#?\s*([\w\-]+)"),
}
TEXT_LIMIT, TOP, BOTTOM, EMAIL_TOP, TERMINAL_BOTTOM = 5000, 3, 3, 8, 10
SIGNALS = ("date_pattern", "document_keywords", "page_numbering", "email_header", "terminal_phrases", "header_footer_change", "whitespace_end", "whitespace_start")


@dataclass(frozen=True)
class HeuristicConfig:
    """Weights by pattern (absent: disabled), and thresholds."""

    weights: dict[str, float] = field(default_factory=lambda: {"date_pattern": 0.7, "document_keywords": 0.8, "page_numbering": 0.9, "email_header": 0.95, "terminal_phrases": 0.6, "whitespace_ratio": 0.5, "header_footer_change": 0.7})
    dates: tuple[str, ...] = DATES
    keywords: tuple[str, ...] = KEYWORDS
    page_numbers: tuple[str, ...] = PAGE_NUMBERS
    email_headers: tuple[str, ...] = EMAIL_HEADERS
    phrases: tuple[str, ...] = PHRASES
    blank_end: float = 0.6
    blank_start: float = 0.3
    minimum: float = 0.3
    ensemble: float = 0.5

    def weight(self, signal: str) -> float | None:
        return self.weights.get("whitespace_ratio" if signal.startswith("whitespace") else signal)


def optimized() -> HeuristicConfig:
    return HeuristicConfig(
        {"email_header": 1.0, "page_numbering": 0.95, "document_keywords": 0.6, "terminal_phrases": 0.4, "date_pattern": 0.3, "whitespace_ratio": 0.3},
        dates=(*DATES, ISO_DATE), keywords=TUNED_KEYWORDS, page_numbers=(*PAGE_NUMBERS, PAGE_FRACTION), email_headers=(*EMAIL_HEADERS, EMAIL_DATED), blank_end=0.7, minimum=0.4, ensemble=0.6,
    )


def fast_screen() -> HeuristicConfig:
    base = optimized()
    return replace(base, weights=base.weights | {"header_footer_change": 0.2}, minimum=0.3, ensemble=0.4)


def high_precision() -> HeuristicConfig:
    return HeuristicConfig({"email_header": 1.0, "page_numbering": 1.0}, page_numbers=PAGE_NUMBERS[:2], minimum=0.6, ensemble=0.8)


PRESETS = {"default": HeuristicConfig, "optimized": optimized, "fast_screen": fast_screen, "high_precision": high_precision}


@dataclass(frozen=True)
class ModelConfig:
    """Settings of the model-backed detector; `layered` takes overrides over environment over file over defaults."""

    model: str = "gemma3:latest"
    bottom_lines: int = 15
    top_lines: int = 15
    boundary_high: float = 0.95
    boundary_medium: float = 0.85
    same_high: float = 0.85
    same_medium: float = 0.75
    same_low: float = 0.65
    cache_days: int = 30
    cache_keep: float = 0.7

    @classmethod
    def layered(cls, file: dict | None = None, prefix: str = "PACKETLENS_", **overrides) -> ModelConfig:
        env = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        out = cls(**{**(file or {}), **env, **{k: v for k, v in overrides.items() if v is not None}})
        if wrong := out.violations():
            raise ValueError(wrong)
        return out

    def violations(self) -> dict[str, str]:
        found = {k: "must be between 0 and 1" for k in ("boundary_high", "boundary_medium", "same_high", "same_medium", "same_low", "cache_keep") if not 0 <= getattr(self, k) <= 1}
        return found | {k: "must be positive" for k in ("bottom_lines", "top_lines", "cache_days") if getattr(self, k) < 1}
