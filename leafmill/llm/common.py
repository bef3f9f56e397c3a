"""What the operators share: table access, cutting lineage, hold-out rows and byte-level text helpers.

The helpers work on a whole Arrow batch of texts at once: one ``uint8`` array with all UTF-8 bytes and one
array of document offsets. Word and window identities are 64-bit polynomial fingerprints, which NumPy forms
from prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.storage import stored

#: Texts are handed to NumPy in runs of about this many bytes, which bounds a worker's memory.
RUN_BYTES = 1 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps reuse it, and lost executors cost nothing."""
    return stored(df, name, codec)


def free_prefix(columns: list[str], prefix: str) -> str:
    """``prefix``, lengthened until no column's name starts with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, so such rows are never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n)), F.lit(-1).cast("bigint"))


# --- byte-level helpers -------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First bytes of a code point (everything but UTF-8 continuation bytes).
LEAD = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15
#: Weights of prefix sums start anew after this many bytes, so that the tables of powers don't grow with a text.
TURN = 1 << 22
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow))
        _pow, _inv = (
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
            for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))
        )
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads a fingerprint over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[0] = 0, from which :func:`spans_hash` takes the fingerprint of any span of ``buf``."""
    n = len(buf)
    power, _ = _powers(min(n, TURN) + 1)
    out = np.empty(n + 1, np.uint64)
    out[0] = 0
    for a in range(0, n, TURN):
        terms = buf[a : a + TURN].astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(terms)]
        part = out[a + 1 : a + 1 + len(terms)]
        np.cumsum(terms, out=part)
        part += out[a]
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(min(len(sums), TURN + 1))
    if len(sums) <= TURN + 1:
        return mix((sums[end] - sums[start]) * inverse[start])
    power, _ = _powers(TURN + 1)
    h, weight, at = np.zeros(len(start), np.uint64), np.ones(len(start), np.uint64), np.asarray(start)
    while True:  # as often as the longest span meets a new turn
        stop = np.minimum(end, (at // TURN + 1) * TURN)
        h += (sums[stop] - sums[at]) * inverse[at % TURN] * weight
        if (stop >= end).all():
            return mix(h)
        weight *= power[stop - at]
        at = stop


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each n consecutive items of ``h`` (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the len(texts) + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(batch: pa.RecordBatch, column: str = "text", most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; one longer text makes a slice of its own."""
    _, off = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spans_of(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of true bytes, none of which crosses documents."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(solid))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all words (runs without ASCII white space)."""
    return spans_of(~SPACE[buf], off)


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    got = np.bincount(doc, weights, n)
    return got if weights is None or weights.dtype.kind == "f" else got.astype(np.int64)


def sums_by_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
