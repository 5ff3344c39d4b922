"""Settings of a run, read from JSON and held to their ranges."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

#: settings of fetching and of machine tuning: held to their ranges so that settings files can be shared with a
#: crawler, without effect on tables (Spark schedules, retries and parallelises)
FETCHING = {
    "concurrency": (1, 1000), "timeout": (1, 300), "rate_limit_per_second": (1e-9, 1000), "max_parallel_requests": (1, None), "max_retries_per_domain": (0, 10),
    "domain_retry_backoff": (0, None), "min_delay_between_requests": (0, None), "max_delay_between_requests": (0, None), "gc_interval": (0, None),
}


@dataclass(frozen=True)
class Config:
    """``keywords``, ``suffixes``, ``page_suffixes``, ``guesses``, ``categories`` and ``disposable`` are line files."""

    pages: str = ""
    domains: str = ""
    output: str = "output"
    keywords: str = ""
    suffixes: str = ""
    page_suffixes: str = ""
    guesses: str = ""
    categories: str = ""
    disposable: str = ""
    mx: str = ""
    images: str = ""
    compat: bool = False
    unknown_mx_passes: bool = True
    files_a_batch: int = 1
    compact_seconds: int = 300
    ocr: bool = False
    ocr_seconds: int = 30
    image_bytes: int = 5 << 20
    images_a_page: int = 20

    def __post_init__(self):
        checks = {
            "output must not be empty": bool(self.output),
            "files_a_batch must be 1 to 1000": 1 <= self.files_a_batch <= 1000,
            "compact_seconds must be at least 1": self.compact_seconds >= 1,
            "image_bytes must not be negative": not self.ocr or self.image_bytes >= 0,
            "ocr_seconds must be at least 1": not self.ocr or self.ocr_seconds >= 1,
            "images_a_page must be 0 to 1000": 0 <= self.images_a_page <= 1000,
        }
        if failed := [k for k, good in checks.items() if not good]:
            raise ValueError("; ".join(failed))


def check_fetching(values: dict) -> None:
    """Ranges of the settings in ``FETCHING``, where they are given."""
    failed = []
    for name, (least, most) in FETCHING.items():
        x = values.get(name)
        if x is not None and (isinstance(x, bool) or not isinstance(x, (int, float)) or x < least or (most is not None and x > most)):
            failed.append(f"{name} must be {least:g} or more" if most is None else f"{name} must be {least:g} to {most:g}")
    if values.get("max_delay_between_requests", 0) < values.get("min_delay_between_requests", 0) and "max_delay_between_requests" in values:
        failed.append("max_delay_between_requests must not be below min_delay_between_requests")
    if failed:
        raise ValueError("; ".join(failed))


def load(path: str, **changes) -> Config:
    """Settings of a JSON file with ``changes`` (not None) over them; unknown names are errors."""
    known = {f.name for f in fields(Config)}
    values = json.loads(Path(path).read_text()) | {k: v for k, v in changes.items() if v is not None}
    if odd := sorted(set(values) - known - set(FETCHING)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    check_fetching(values)
    values["output"] = output_folder(values.get("output", "output"))
    return Config(**{k: v for k, v in values.items() if k in known})


def output_folder(path: str) -> str:
    """A folder to write to: the path itself, or where it names a text file, that file's folder."""
    if not path.endswith(".txt"):
        return path
    return os.path.dirname(path) or "output"
