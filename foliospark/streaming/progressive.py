"""Progressive refinement as a stateful stream.

Chunks of wavelet layers arrive as rows (doc_id, page_index, ordinal, data).  The state of a page is
its decoder after the chunks so far and the chunks that wait for an earlier one; each chunk that can be applied gives a frame."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.codecs.iw44 import Wavelet
from foliospark.codecs.raster import write_png

OUT = "doc_id long, page_index int, ordinal int, width int, height int, png binary, error string"
STATE = "image binary, next int, waiting binary"


def refine(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    image, nxt, waiting = Wavelet(), 0, {}
    if state.exists:
        saved = state.get
        image, nxt, waiting = pickle.loads(saved[0]), saved[1], pickle.loads(saved[2])
    out = []
    for f in frames:
        waiting |= {int(r.ordinal): bytes(r.data) for r in f.itertuples() if r.ordinal >= nxt}
    while nxt in waiting:
        row = [key[0], key[1], nxt, None, None, None, None]
        try:
            image.chunk(waiting.pop(nxt))
            row[3:6] = [image.width, image.height, write_png(image.rgb())]
        except ValueError as e:
            row[6] = str(e)
        out.append(row)
        nxt += 1
    state.update((pickle.dumps(image), nxt, pickle.dumps(waiting)))
    yield pd.DataFrame(out, columns=["doc_id", "page_index", "ordinal", "width", "height", "png", "error"])


def refinements(chunks: DataFrame) -> DataFrame:
    """A streaming DataFrame of frames; chunks may arrive in any order."""
    return chunks.groupBy("doc_id", "page_index").applyInPandasWithState(refine, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
