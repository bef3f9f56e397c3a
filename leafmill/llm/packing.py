"""Best-fit packing of tokenised documents into sequences of at most 4096 ids.

Documents are tokenised once; pieces (a document, or 4096-id cuts of a longer one) get lengths of 1 to 4096. Best-fit
decreasing then needs only how many pieces have each length, a table of at most 4096 rows: pieces of one length are
alike, so the driver places them together. Open bins are counted by remaining capacity, and a segment tree over the
capacities finds the tightest bin that still fits in logarithmic time. The result is a list of runs (length, first
ordinal, first bin, pieces per bin, first offset) whose size depends on the capacity, not on the corpus. Executors
number the pieces of each length in parallel, by hash bucket with prefix sums of the buckets' counts, so a length that
a third of all pieces share is no hot key, and look their run up.

Defined cases: a null or empty text is the single id 1; repeated rows are packed once each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import LOWER, RUN_BYTES, SPACE, buffers, cut, prefix_sums, runs, spans_hash, table, word_spans

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Units that a worker remembers before it starts anew; results don't depend on it.
CACHE = 1_500_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_KIND = np.select([SPACE, _LETTER, (_B >= 48) & (_B <= 57)], [0, 1, 2], 3).astype(np.uint8)
_ODD = 4


class Encoder:
    """Ids of whole texts by remembered units.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks. A chunk of
    plain characters (ASCII without apostrophe, Latin-1 letters) falls into runs of letters, single digits and runs of
    other characters, found for a whole batch at once; any other chunk is one unit and goes through the full tokenizer.
    Each distinct unit is encoded once a worker; later batches look its fingerprint up.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, "<u4")

    def units(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, document and oddness of all units, and the bytes to encode (lower case where plain)."""
        kind, low = _KIND[buf], LOWER[buf]
        wide = np.flatnonzero(buf >= 128)
        if len(wide):
            lead = wide[buf[wide] == 0xC3]
            lead = lead[lead + 1 < len(buf)]
            second = buf[lead + 1]
            plain = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            lead, second = lead[plain], second[plain]
            kind[wide] = _ODD
            kind[lead] = kind[lead + 1] = 1
            low[lead + 1] = second + (second <= 0x9E) * np.uint8(0x20)
        kind[buf == 39] = _ODD
        if len(buf) > 1:
            kind[:-1][(buf[:-1] == 60) & (buf[1:] == 124)] = _ODD
        start, end, doc = word_spans(buf, off)
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        odd = odd[end] > odd[start]
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[start[odd]] = 1
        inside[end[odd]] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        kind[inside] = _ODD
        first = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins, ends = np.concatenate([[True], first]), np.concatenate([first, [True]])
        begins[start] = True
        ends[end - 1] = True
        filled = kind > 0
        s, e = np.flatnonzero(begins & filled), np.flatnonzero(ends & filled) + 1
        return s, e, doc[np.searchsorted(start, s, side="right") - 1], kind[s] == _ODD, np.where(inside, buf, low)

    def encode(self, raw: bytes, odd: bool) -> list[int]:
        if odd:
            return self.full.encode(raw.decode(), add_special_tokens=False).ids
        return [t.id for t in self.full.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]

    def ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch and the offsets of each document's."""
        n = len(off) - 1
        if not len(buf):
            return np.empty(0, "<u4"), np.zeros(n + 1, np.int64)
        start, end, doc, odd, source = self.units(buf, off)
        h = spans_hash(prefix_sums(source), start, end) ^ odd.astype(np.uint64)
        unit, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        k = np.searchsorted(self.keys, unit)
        known = np.zeros(len(unit), bool)
        known[k < len(self.keys)] = self.keys[k[k < len(self.keys)]] == unit[k < len(self.keys)]
        new = np.flatnonzero(~known)
        if len(new):
            raw, f = source.tobytes(), first[new]
            coded = [self.encode(raw[a:b], o) for a, b, o in zip(start[f].tolist(), end[f].tolist(), odd[f].tolist())]
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            at = len(self.pool) + np.concatenate([[0], np.cumsum(size)])[:-1]
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(coded), "<u4", int(size.sum()))])
            place = k[new]
            self.keys, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.keys, unit[new]), (self.at, at), (self.size, size)))
            k = np.searchsorted(self.keys, unit)
        k = k[back]
        size = self.size[k]
        stop = np.cumsum(size)
        out = self.pool[np.repeat(self.at[k] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        return out, np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(n + 1))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenised(path: str | None, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function (doc_id, text) -> pieces with the checksum of their ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for batch in runs(whole, most=2 * RUN_BYTES):
                yield pa.RecordBatch.from_pydict(_pieces(batch, own, capacity))

    return pieces


def _pieces(batch: pa.RecordBatch, own: Encoder, capacity: int) -> dict:
    ids, upto = own.ids(*buffers(batch.column("text")))
    tail = np.array([END_ID], "<u4").tobytes()
    rows: list[tuple[int, int, int, int]] = []
    place: list[int] = []
    for d in range(batch.num_rows):
        got = ids[upto[d] : upto[d + 1]].tobytes() + tail
        for k, s in enumerate(range(0, len(got) // 4, capacity)):
            part = got[4 * s : 4 * (s + capacity)]
            rows.append((k, s, len(part) // 4, zlib.crc32(part)))
            place.append(d)
    out = np.array(rows, np.int64).reshape(-1, 4)
    return {
        "doc_id": batch.column("doc_id").take(pa.array(place, pa.int64())),
        "piece": pa.array(out[:, 0], pa.int32()),
        "start": pa.array(out[:, 1]),
        "length": pa.array(out[:, 2]),
        "ids_crc32": pa.array(out[:, 3]),
    }


class CapacityTree:
    """Which remaining capacities have open bins, and the smallest such capacity from a given one on."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, r: int, there: bool) -> None:
        i = r + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int:
        """-1 if no open bin has that much left."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over (length: count). Rows: length, first ordinal, first bin, pieces per bin, first offset."""
    tree = CapacityTree(capacity)
    open_: dict[int, list[list[int]]] = {}
    found: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(r: int, a: int, b: int) -> None:
        if r and a < b:
            open_.setdefault(r, []).append([a, b])
            tree.set(r, True)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            r = tree.tightest(length)
            if r < 0:  # no bin fits: as many new ones as the rest needs
                r, each = capacity, capacity // length
                a, bins = bins, bins + -(-(total - done) // each)
                b = bins
            else:
                each = r // length  # best fit goes on filling the bin that it has just made tighter
                a, b = open_[r].pop()
                if not open_[r]:
                    tree.set(r, False)
            full = min(b - a, (total - done) // each)
            found.append((length, done, a, each, capacity - r))
            done += full * each
            put(r - each * length, a, a + full)
            a += full
            if a < b and done < total:  # the last bin takes what is left
                put(r - (total - done) * length, a, a + 1)
                done, a = total, a + 1
            put(r, a, b)
    return np.array(found, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with sequence_id and offset; see the module's text."""
    spark = docs.sparkSession
    pieces = cut(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tokenised(path, capacity), PIECES), "pieces")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    plan = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("own", F.row_number().over(own) - 1).join(bases, ["bucket", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("ordinal"))
    return numbered.mapInArrow(_placer(plan), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def _placer(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            k = np.searchsorted(by, (length << 48) + ordinal, side="right") - 1
            run, step = plan[k], ordinal - plan[k, 1]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(run[:, 2] + step // run[:, 3]), pa.array(run[:, 4] + step % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
