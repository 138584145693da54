"""Reading words from rasters through a pluggable engine, one a Python worker."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import imaging
from gridloom.functions.text import normalize_text

Reading = tuple[str, float, float, float, float, float]


class Engine(Protocol):
    """Reads a picture: text, left, top, width, height and confidence from 0 to 100 of each word."""

    def read(self, image: np.ndarray, languages: tuple[str, ...]) -> Iterable[Reading]: ...

    def languages(self) -> set[str]: ...


class BlobEngine:
    """A deterministic stand-in: every dark blob is a word of as many letters as it is wide."""

    def read(self, image: np.ndarray, languages: tuple[str, ...]) -> Iterable[Reading]:
        boxes = imaging.component_boxes(*imaging.label_components(imaging.to_gray(image) < 128))
        for x0, y0, x1, y1, area in boxes.tolist():
            yield "x" * max(1, (x1 - x0) // 6), x0, y0, x1 - x0, y1 - y0, 100.0 * area / max(1, (x1 - x0) * (y1 - y0))

    def languages(self) -> set[str]:
        return {"any"}


_FACTORIES: dict[str, Callable[[], Engine]] = {"blobs": BlobEngine}
_ENGINES: dict[str, Engine] = {}


def register_engine(name: str, factory: Callable[[], Engine]) -> None:
    _FACTORIES[name] = factory


def engine(name: str) -> Engine:
    """The engine of this worker, made when first asked for."""
    if name not in _ENGINES:
        _ENGINES[name] = _FACTORIES[name]()
    return _ENGINES[name]


def locate_command(configured: str | None = None, variable: str = "TESSERACT_CMD", name: str = "tesseract", bundled: Iterable[Path] = ()) -> Path | None:
    """The first command that exists: configured, named in the environment, bundled, on the path."""
    candidates = [configured, os.environ.get(variable), *bundled, shutil.which(name)]
    return next((Path(c) for c in candidates if c and Path(c).is_file()), None)


def missing_languages(available: set[str], wanted: Iterable[str]) -> list[str]:
    return sorted(set(wanted) - available)


def ocr_words(rasters: DataFrame, engine_name: str = "blobs", languages: tuple[str, ...] = ("any",), threshold: float = 0.35, profile: str | None = None) -> DataFrame:
    """Words of every page picture with enough confidence, in pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = engine(engine_name)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)
                image = imaging.preprocess(image, profile) if profile else image
                for k, (text, x, y, w, h, sure) in enumerate(reader.read(image, languages)):
                    rows.append((r.source_file, r.page_number, k, text, float(x), float(y), float(x + w), float(y + h), max(0.0, sure / 100)))
            yield pd.DataFrame(rows, columns=["source_file", "page_number", "word_id", "text", "x0", "y0", "x1", "y1", "confidence"])

    found = rasters.mapInPandas(
        run, "source_file string, page_number bigint, word_id bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
    )
    kept = found.withColumn("text", normalize_text(F.col("text"))).where((F.col("text") != "") & (F.col("confidence") >= threshold))
    return kept.withColumns({"source": F.lit("ocr"), "coord_space": F.lit("pixels")})
