"""Text of images by an external recogniser, where one is installed; without one there are no rows."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterbox.functions.ocr_text import image_text_emails

#: fixed values: places where the recogniser is looked for besides the search path
PLACES = ("/usr/bin/tesseract", "/usr/local/bin/tesseract", "C:\\Program Files\\Tesseract-OCR\\tesseract.exe", "C:\\Program Files (x86)\\Tesseract-OCR\\tesseract.exe")


def find_recogniser(name: str = "tesseract", places: tuple[str, ...] = PLACES) -> str | None:
    return shutil.which(name) or next((p for p in places if os.path.isfile(p)), None)


def recognise(image: bytes, binary: str, seconds: int = 30, language: str = "eng") -> str | None:
    """The text of a PNG or JPEG, handed over on standard input; None on failure or after ``seconds``.

    Where the language is not installed it is tried again without one.
    """

    def run(*more: str):
        return subprocess.run([binary, "stdin", "stdout", *more], input=image, capture_output=True, timeout=seconds)

    try:
        got = run("-l", language)
        if got.returncode and b"lang" in got.stderr.lower():
            got = run()
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout.decode("utf-8", "replace") if got.returncode == 0 else None


def read_text(images: DataFrame, binary: str | None = None, seconds: int = 30) -> DataFrame:
    """path, text of ``images`` (path, content). Executors look for the recogniser unless ``binary`` names it.

    An image without content, or that gives no text, has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = binary or find_recogniser()
        if tool is None:
            return
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content and (text := recognise(content, tool, seconds)):
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "text": pa.array([text], pa.string())})

    return images.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "path string, text string")


def image_emails(images: DataFrame, binary: str | None = None, seconds: int = 30) -> DataFrame:
    """path, email of every image: distinct lower-cased addresses in its text."""
    text = read_text(images, binary, seconds)
    return text.select("path", F.explode(image_text_emails(F.col("text"))).alias("email"))
