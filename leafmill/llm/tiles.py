"""Pairs of documents that share a shingle, compared inside tasks, so that only pairs that may be linked become rows.

The documents that share a shingle are dealt into blocks of about ``BLOCK`` by a hash, and pairs of blocks are tiles, one
group of rows each, so no task holds more than two blocks of a shingle that very many documents hold. A row carries an
odd sketch of the document's shingle set: each shingle flips one of m bits. Two sketches differ in no more bits than the
sets differ in shingles, and linked sets differ in at most a seventh of their sizes' sum, so a pair with more is no link,
for certain. m grows with the set up to 16384 bits; of sets above 8192 shingles a part chosen by hash is sketched, and
the bound gets a margin of six deviations. A set near the end of its level carries the next level's sketch as well, so
any two sets close enough in size meet on one level.

Defined cases: an empty table of places gives no pairs; of two rows with one document nothing is formed; rows that
repeat make the same pair again, which the caller's distinct removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mix

BLOCK = 512
#: A set of level v has at most 64 * 2^v shingles; above level ``TOP`` sketches stay at 16384 bits and sets are thinned.
TOP = 7


def level_of(n: int) -> int:
    return max(0, (n - 1) >> 6).bit_length()


def sketch_bytes(level: int) -> int:
    return 16 << min(level, TOP)


def odd_sketch(shingles: np.ndarray, level: int) -> bytes:
    """The sketch of distinct shingles at a level."""
    v = mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))
    if level > TOP:
        v = v[(v >> np.uint64(40)) & np.uint64((1 << (level - TOP)) - 1) == 0]
    m = 8 * sketch_bytes(level)
    odd = np.bincount((v & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _emit_sketches(need: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            off = lists.offsets.to_numpy()
            flat = np.asarray(lists.values).view(np.uint64)
            levels, out = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                v = level_of(b - a)
                s = odd_sketch(flat[a:b], v)
                if (b - a) * 100 > (64 << v) * need:  # a partner may lie on the next level
                    s += odd_sketch(flat[a:b], v + 1)
                levels.append(v)
                out.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int32()), pa.array(levels, pa.int32()), pa.array(out, pa.binary())], ["doc_id", "n", "level", "sketch"])

    return emit


def sketches(sets: DataFrame, need: int) -> DataFrame:
    """doc_id, n, level, sketch of ``sets`` (doc_id, shingles: distinct)."""
    return sets.select("doc_id", "shingles").mapInArrow(_emit_sketches(need), "doc_id bigint, n int, level int, sketch binary")


def tiled(places: DataFrame) -> DataFrame:
    """``places`` (doc_id, g, other, held, rest) with tile_x, tile_y and block: every two rows of a shingle of which one is
    ``other`` meet in a tile. held: rows of the shingle, rest: how many of them are ``other``."""
    small = F.col("held") <= BLOCK
    others = F.when(small, 1).otherwise(F.greatest(F.ceil(F.col("rest") / BLOCK), F.lit(1))).cast("int")
    large = F.when(small, 0).otherwise(F.ceil((F.col("held") - F.col("rest")) / BLOCK)).cast("int")
    draw = F.xxhash64("doc_id", F.lit("tile"))
    rows = places.withColumn("others", others).withColumn("blocks", others + large)
    own = F.pmod(draw, F.col("others")).cast("int")
    far = (F.col("others") + F.pmod(draw, F.greatest(F.col("blocks") - F.col("others"), F.lit(1)))).cast("int")
    rows = rows.withColumn("block", F.when(small, 0).when(F.col("other"), own).otherwise(far))
    # tiles (x, y) with x <= y, where x is a block of others: a row of block x meets all later ones, one of block y all earlier
    met = F.transform(F.sequence(F.lit(0), F.when(F.col("block") < F.col("others"), F.col("blocks")).otherwise(F.col("others")) - 1), lambda k: F.struct(F.least(k, "block").alias("x"), F.greatest(k, "block").alias("y")))
    rows = rows.withColumn("tile", F.explode(met))
    return rows.select("g", F.col("tile.x").alias("tile_x"), F.col("tile.y").alias("tile_y"), "block", "doc_id", "component", "n", "left", "level", "sketch")


def _planes(level: np.ndarray, sketch: list[bytes], v: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of level ``v`` as rows of words, and each document's row."""
    size, at, held = sketch_bytes(v), np.full(len(level), -1), []
    for i in np.flatnonzero((level == v) | (level == v - 1)).tolist():
        s = sketch[i][:size] if level[i] == v else sketch[i][sketch_bytes(v - 1) :]
        if s:
            at[i] = len(held)
            held.append(s)
    return np.frombuffer(b"".join(held), np.uint64).reshape(-1, size // 8), at


def _within(both: np.ndarray, differ: np.ndarray, v: int, need: int) -> np.ndarray:
    """Whether sketches of level ``v`` that differ in so many bits leave a link possible; both: sum of the set sizes."""
    most = both * (100 - need) / (100 + need)
    if v > TOP:
        most = most / (1 << (v - TOP))
        most += 6 * np.sqrt(most) + 6
    return differ <= most


def _compare(batch: pa.RecordBatch, group: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a batch of whole tiles that may be linked."""
    col = {c: batch.column(c).to_numpy() for c in ("tile_x", "tile_y", "block", "doc_id", "component", "n", "left", "level")}
    sketch, planes = batch.column("sketch").to_pylist(), {}
    n, left, level, inner = col["n"].astype(np.int64), col["left"].astype(np.int64), col["level"], col["tile_x"] == col["tile_y"]
    found, k = [], 1
    while True:
        x = np.flatnonzero(group[k:] == group[:-k])
        if not len(x):
            break
        y = x + k
        both = n[x] + n[y]
        fits = (col["component"][x] != col["component"][y]) & (inner[x] | (col["block"][x] != col["block"][y]))
        fits &= np.minimum(left[x], left[y]) * (100 + need) >= both * need
        fits &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * need
        x, y, both = x[fits], y[fits], both[fits]
        top = np.maximum(level[x], level[y])
        for v in np.unique(top).tolist():
            if v not in planes:
                planes[v] = _planes(level, sketch, v)
            words, at = planes[v]
            here = np.flatnonzero(top == v)
            differ = np.bitwise_count(words[at[x[here]]] ^ words[at[y[here]]]).sum(axis=1, dtype=np.int64)
            here = here[_within(both[here], differ, v, need)]
            found.append((x[here], y[here]))
        k += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _emit_pairs(need: int):
    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        group = np.zeros(batch.num_rows, np.int64)
        for c in ("g", "tile_x", "tile_y"):
            v = batch.column(c).to_numpy()
            group[1:] |= v[1:] != v[:-1]
        x, y = _compare(batch, np.cumsum(group), need)
        ids = batch.column("doc_id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[x], ids[y])), pa.array(np.minimum(ids[x], ids[y]))], ["a", "b"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the rows of the last tile, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1] for c in ("g", "tile_x", "tile_y")]
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(("g", "tile_x", "tile_y"), last):
                same &= batch.column(c).to_numpy() == v.as_py()
            start = batch.num_rows - int(same.sum())
            if start or (kept and [kept[0].column(c)[0] for c in ("g", "tile_x", "tile_y")] != last):
                whole = pa.Table.from_batches([*kept, batch.slice(0, start)]).combine_chunks().to_batches()
                kept = []
                if whole:
                    yield pairs(whole[0])
            kept.append(batch.slice(start))
        if kept:
            yield pairs(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return emit


def tile_pairs(places: DataFrame, sketched: DataFrame, need: int) -> DataFrame:
    """Distinct pairs (a, b), a > b, of different components that share a shingle of ``places`` (doc_id, component, n, g,
    left, other, held, rest) and that no bound excludes; at least one of them is ``other`` there."""
    rows = tiled(places.join(sketched, ["doc_id", "n"]))
    keys = ["g", "tile_x", "tile_y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_emit_pairs(need), "a bigint, b bigint").distinct()


def _emit_possible(need: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                level = [batch.column(c).to_numpy() for c in ("level_a", "level_b")]
                sketch = [batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b")]
                n = [batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")]
                keep = np.minimum(*n) * 100 >= np.maximum(*n) * need
                top = np.where(keep, np.maximum(*level), -1)
                for v in np.unique(top[keep]).tolist():
                    here = np.flatnonzero(top == v)
                    (x, i), (y, j) = (_planes(a, s, v) for a, s in zip(level, sketch))
                    differ = np.bitwise_count(x[i[here]] ^ y[j[here]]).sum(axis=1, dtype=np.int64)
                    keep[here] = _within(n[0][here] + n[1][here], differ, v, need)
                rows = np.flatnonzero(keep)
                yield batch.select(["a", "b"]).take(pa.array(rows))

    return emit


def possible_pairs(pairs: DataFrame, sketched: DataFrame, need: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches don't exclude a link, so that whole sets are sent for few others."""
    for side in ("a", "b"):
        pairs = pairs.join(sketched.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "level", "sketch"))), side)
    return pairs.mapInArrow(_emit_possible(need), "a bigint, b bigint").distinct()
