"""Content hashes that other stores of the same data use.

FNV-1a multiplies and xors byte by byte in 64 wrapping bits, which no SQL function
does. It is computed over whole Arrow string buffers: one numpy step takes the
next byte of every text of a batch that has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASIS, _PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def fnv1a(texts: pa.Array) -> np.ndarray:
    """64-bit FNV-1a of the UTF-8 bytes of every text; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    at, left = offsets[:-1][order].copy(), -size[order]
    h = np.full(len(order), _BASIS)
    # how many texts have a byte at each place: a prefix of the order
    for n in np.searchsorted(left, -np.arange(int(size.max(initial=0))), "left").tolist():
        h[:n] = (h[:n] ^ data[at[:n]]) * _PRIME
        at[:n] += 1
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_hex(text: Column) -> Column:
    """FNV-1a as 16 hexadecimal digits; null for null."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(fnv1a(texts).view(np.int64), pa.int64())

    return F.when(text.isNotNull(), F.lower(F.lpad(F.hex(run(text)), 16, "0")))
