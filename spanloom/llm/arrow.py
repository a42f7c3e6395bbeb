"""Arrow batches of texts, a bounded part at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts that a task holds as Python objects at once.
TEXTS = 512


def parts(batches: Iterable[pa.RecordBatch], rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what is made of them stays small however large they come."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
