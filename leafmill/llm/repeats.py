"""Removal of repeated 400-byte strings by winnowing with exact refinement, in place of prefix doubling.

Like prefix doubling it goes on in rounds of growing length, in which Spark groups (rank so far, new rank), and strings
with a rank of their own leave. Unlike it, no rank is formed from two earlier ones: a rank is a 64-bit fingerprint of
the bytes, as only equality matters. And ranking every byte position would move many bytes for each input byte, so the
rounds run over synchronised positions, which equal strings share by construction, and reach single bytes only where
needed:

* Round 1, length 32. A position is an *anchor* if it is the leftmost minimum (by fingerprint) among the 32-byte
  strings of some 400-byte window; every window has exactly one. Equal windows have equal anchors at the same place,
  so windows whose anchor rank is unique are unique. The windows of one anchor start in one interval.
* Round 2, up to 768. Anchors of one rank are reranked by the pair (rank, all bytes that their windows cover). Equal
  ones repeat as a whole. If no other rank of that anchor class is left, that is all.
* Round 3, length 385. What is left is cut into aligned blocks of 16 windows: ranked by the 385 bytes that all windows
  of the block share (unique: none repeats) and then by the 415 bytes they cover (repeated: all repeat).
* Round 4, length 400. Blocks that are still open are ranked window by window.

In each round one member of every repeated rank goes on with the open ones, since those may equal a part of it.
Ranks are counted with map-side combining; groups are never collected, so copies in any number cost the same per row.

Defined cases: null text is empty; repeated rows and repeated ids are texts of their own (told apart by id and text
fingerprint); texts under 400 bytes are never touched; texts are read whole, one that is longer than a run in a run of
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import buffers, cut, mix, prefix_sums, runs, spans_hash, table

LENGTH, SEED, BLOCK = 400, 32, 16

ANCHORS = "row bigint, at int, low int, high int, cls bigint, rank bigint"


def row_key() -> Column:
    """Tells texts apart even if ids repeat; equal rows share it, and then all they hold is repeated anyway."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(sums: np.ndarray, length: int = LENGTH, seed: int = SEED, most: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Places of one text's anchors, the least and the largest distance from a window's start, and the rank of each.

    At most ``most`` windows are looked at together, which bounds the memory that a long text takes.
    """
    found: list[tuple[np.ndarray, ...]] = []
    windows = len(sums) - length
    for a in range(0, windows, most):
        at = np.arange(a, min(a + most, windows) + length - seed)
        h = spans_hash(sums, at, at + seed)
        # leftmost minimum: 33 bits of the fingerprint, then the place
        place = (_sliding_min((h >> np.uint64(31)) << np.uint64(31) | at.astype(np.uint64), length - seed + 1) & np.uint64((1 << 31) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        found.append((place[first], a + first, a + last, h[place[first] - a]))
    where, first, last, rank = (np.concatenate(c) for c in zip(*found))
    # an anchor whose windows lie on both sides of a cut is one
    new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    last = last[np.concatenate([new[1:], [len(where)]]) - 1]
    return where[new], where[new] - last, where[new] - first[new], rank[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in runs(whole):
            buf, off = buffers(batch.column("text"))
            rows = batch.column("row").to_numpy()
            out: list[tuple] = []
            for d in np.flatnonzero(np.diff(off) >= LENGTH):
                sums = prefix_sums(buf[off[d] : off[d + 1]])
                at, low, high, h = anchors(sums)
                rank = mix(spans_hash(sums, at - high, at - low + LENGTH) ^ ((low * 512 + high).astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
                out.append((np.full(len(at), rows[d]), at, low, high, h, rank))
            if out:
                r, at, low, high, h, rank = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(r), *(pa.array(c.astype(np.int32)) for c in (at, low, high)), _signed(h), _signed(rank)], ["row", "at", "low", "high", "cls", "rank"])


def _crowded(units: DataFrame, rank: str, name: str) -> DataFrame:
    """Ranks that two or more units share. As a table of its own, so that a join with it can split a hot rank."""
    return cut(units.groupBy(rank).agg(F.count("*").alias("n")).filter("n > 1").select(rank), f"{name}-{rank}")


def rerank(units: DataFrame, member: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """One round over ``units`` (cls: the rank so far, rank: the new one, and the ``member`` columns).

    Returns the units whose new rank is repeated, and those that go on: in every class that holds a unit with a rank of
    its own, these units and one of each repeated rank. Units that are alone in their class are unique and leave.
    """
    crowded = _crowded(units, "cls", name)
    units = cut(units.join(crowded, "cls", "left_semi"), f"{name}-units")
    ranks = cut(units.groupBy("cls", "rank").agg(F.count("*").alias("n"), F.min(F.struct(*member)).alias("one")), f"{name}-ranks")
    # a table of its own, so that the join can split a class of very many ranks
    open_ = cut(ranks.filter("n = 1").select("cls").distinct(), f"{name}-open")
    going = ranks.join(open_, "cls", "left_semi").select("cls", "one.*")
    return units.join(ranks.filter("n > 1").select("cls", "rank"), ["cls", "rank"], "left_semi"), going


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the windows of each open anchor cover."""
    for whole in batches:
        for batch in runs(whole):
            out: list[tuple] = []
            for row, text, places in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                raw = text.encode()
                out += [(row, p["at"], p["low"], p["high"], p["cls"], raw[p["at"] - p["high"] : p["at"] - p["low"] + LENGTH]) for p in places]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["row", "at", "low", "high", "seed", "bytes"])


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligned blocks of windows, by distance from the anchor, with the ranks of what they share and what they cover."""
    for whole in batches:
        for batch in runs(whole, "bytes"):
            buf, off = buffers(batch.column("bytes"))
            sums = prefix_sums(buf)
            row, at, low, high, seed = (batch.column(c).to_numpy() for c in ("row", "at", "low", "high", "seed"))
            n = high // BLOCK - low // BLOCK + 1
            k = np.repeat(np.arange(len(n)), n)
            b = low[k] // BLOCK + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            near, far = np.maximum(b * BLOCK, low[k]), np.minimum(b * BLOCK + BLOCK - 1, high[k])
            zero = off[:-1][k] + high[k]  # where the anchor lies in the buffer
            salt = mix(seed[k].view(np.uint64) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
            cls = mix(spans_hash(sums, zero - b * BLOCK, zero - b * BLOCK - BLOCK + 1 + LENGTH) ^ salt)
            rank = mix(spans_hash(sums, zero - far, zero - near + LENGTH) ^ mix((near * 512 + far).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(row[k]), *(pa.array(c.astype(np.int32)) for c in (at[k], near, far)), _signed(cls), _signed(rank)], ["row", "at", "low", "high", "cls", "rank"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the blocks that are still open, ranked by all its bytes."""
    for whole in batches:
        for batch in runs(whole, "bytes"):
            buf, off = buffers(batch.column("bytes"))
            sums = prefix_sums(buf)
            row, at, high, near, far, cls = (batch.column(c).to_numpy() for c in ("row", "at", "high", "near", "far", "cls"))
            n = far - near + 1
            k = np.repeat(np.arange(len(n)), n)
            o = near[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            start = off[:-1][k] + high[k] - o
            rank = mix(spans_hash(sums, start, start + LENGTH) ^ mix(cls[k].view(np.uint64) ^ o.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(row[k]), *(pa.array(c.astype(np.int32)) for c in (at[k], o, o)), _signed(rank)], ["row", "at", "low", "high", "rank"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row, start, end: byte spans of ``docs`` (doc_id, text) that repeated strings cover; they may overlap."""
    member = ["row", "at", "low", "high"]
    texts = docs.filter(F.octet_length("text") >= LENGTH).select(row_key().alias("row"), "text")
    units = cut(texts.mapInArrow(_emit_anchors, ANCHORS), "anchors")
    whole, going = rerank(units, member, "anchors")
    places = going.groupBy("row").agg(F.collect_list(F.struct("at", "low", "high", "cls")).alias("places"))
    contexts = cut(texts.join(places.hint("shuffle_hash"), "row").mapInArrow(_emit_contexts, "row bigint, at int, low int, high int, seed bigint, bytes binary"), "contexts")
    blocks, going = rerank(cut(contexts.mapInArrow(_emit_blocks, ANCHORS), "blocks"), member, "blocks")
    going = going.select("row", "at", F.col("low").alias("near"), F.col("high").alias("far"), "cls")
    windows = contexts.join(going, ["row", "at"]).mapInArrow(_emit_windows, "row bigint, at int, low int, high int, rank bigint")
    windows = cut(windows, "windows")
    single = windows.join(_crowded(windows, "rank", "windows"), "rank", "left_semi")
    found = whole.select(*member).unionByName(blocks.select(*member)).unionByName(single.select(*member))
    return found.select("row", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + LENGTH).alias("end"))


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = (text.as_py() or "").encode()
            cover = merged([(s["start"], s["end"]) for s in spans or []])
            digest, at = hashlib.sha256(), 0
            for s, e in cover:
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            rows.append((len(raw), sum(e - s for s, e in cover), len(cover), digest.hexdigest()))
        cols = list(zip(*rows)) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: its bytes, how many repeated strings cover, in how many runs, and the digest of what is left."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spans = repeated_spans(docs).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    keyed = docs.withColumn("row", row_key()).join(spans.hint("shuffle_hash"), "row", "left")
    return keyed.select("doc_id", "text", "spans").mapInArrow(_remove, REMOVED)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
