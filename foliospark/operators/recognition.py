"""The plug-in for text recognition, and what follows from it: render, recognise, put the text layer in.

A backend is any object with ``recognize(rgb, languages, dpi) -> (text, zones)``; it is made once a
worker by ``make``, so a model is loaded once.  None comes with this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.codecs import bzz, container, layers, raster


class Recognizer(Protocol):
    def recognize(self, rgb: np.ndarray, languages: str, dpi: int) -> tuple[str, list[dict]]: ...


#: Recognisers that users know by name; they need programs or models that are not part of this package.
NAMED = ("tesseract", "onnx", "candle")


def backend(name: str) -> Recognizer:
    """A recogniser by name; a defined error, since none comes with this package (give ``recognize`` one of your own)."""
    if name in NAMED:
        raise ValueError(f"recogniser {name} is not available here")
    raise ValueError(f"unknown recogniser {name}; known are {', '.join(NAMED)}")


def recognize_document(data: bytes, own: Recognizer, languages: str, dpi: int) -> bytes:
    """A document with the text that a recogniser finds on its pages."""
    for i, page in enumerate(container.read(data).pages):
        text, zones = own.recognize(raster.render(page), languages, dpi)
        data = container.put_layer(data, i, "TXT", bzz.encode(layers.write_text(text, zones, page.info["height"])))
    return data


def greedy_decode(scores: np.ndarray, alphabet: str, blank: int = 0) -> str:
    """Best symbol of each step, without repeats and blanks; symbol i > 0 is alphabet[i - 1]."""
    best = scores.argmax(axis=1)
    keep = (best != blank) & (np.diff(best, prepend=-1) != 0)
    return "".join(alphabet[i - 1] if blank == 0 else alphabet[i] for i in best[keep])


def bounding_box(zones: list[dict]) -> tuple[int, int, int, int]:
    if not zones:
        return 0, 0, 0, 0
    x, y = min(z["x"] for z in zones), min(z["y"] for z in zones)
    return x, y, max(z["x"] + z["w"] for z in zones) - x, max(z["y"] + z["h"] for z in zones) - y


def recognize(files: DataFrame, make: Callable[[], Recognizer], languages: str = "eng", dpi: int = 300) -> DataFrame:
    """path, content of each document with recognised text layers; ``error`` where a page failed (the document stays as it is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            paths, contents, errors = [], [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error = None
                try:
                    data = recognize_document(data, own, languages, dpi)
                except (ValueError, IndexError) as e:
                    error = str(e)[:300]
                paths.append(path)
                contents.append(data)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")
