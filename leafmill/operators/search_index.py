"""Search through a stored index of three-character grams instead of all texts.

:func:`build` writes, for paragraphs (doc_id, para_idx, text and any other columns), two tables below a folder: the
paragraphs, numbered in segments of 8,192 as they come, and the postings (gram, segment, numbers of the paragraphs that
hold it) sorted by gram within files, from which a search also counts how often the grams of its pattern occur. Nothing is
shuffled for it: a task numbers what it reads, and another makes the postings of what it wrote, a few MB of texts at a
time. A search derives from a literal or regex which grams every match must hold, as a tree of "and" and "or", combines the
postings of the rarest ones into a bit for each paragraph of a segment and searches only the paragraphs that remain. The
bits go to the paragraphs (128 words for 8,192 of them), not the paragraphs to the bits. The result is always that of a
search of all paragraphs; a pattern of which no gram is mandatory is searched in all of them.

Grams are of printable ASCII characters without regard to case, so an index serves both kinds of search; a pattern without
three such characters in a row has no mandatory gram. Of a conjunction four grams at most are asked for, the rarest ones:
fewer conditions leave more candidates, never fewer matches. Null texts match nothing; null ids are ids like others.
Paragraphs that are added twice are there twice. What is added counts from when its name stands in the settings, after
both tables; a job that ends before that leaves rows that nothing reads, and can be run again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.operators import search
from leafmill.sources.docx import sliced

_ASKED, _MOST_GRAMS = 4, 60
#: Paragraphs of a segment, as a power of two, and the bytes of text that a task looks at at once.
_SEGMENT, _BYTES = 13, 2 << 20
#: The characters outside ASCII that the JVM takes for ASCII letters where case doesn't count.
_FOLDS = {"K": "k", "ſ": "s", "İ": "i", "ı": "i"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text, as (gram, place of the text), sorted; a gram is its three bytes as a number."""
    for c, plain in _FOLDS.items():
        texts = pc.replace_substring(texts, c, plain)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(ends[0]), int(ends[-1])) if len(texts) else (0, 0)
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first:last]]
    ends = ends - first
    found = [np.empty(0, np.int64)]
    for at in range(0, max(len(data) - 2, 0), _BYTES):
        b = data[at : at + _BYTES + 2].astype(np.int64)
        printable = (b >= 32) & (b <= 126)
        at_b = np.flatnonzero(printable[:-2] & printable[1:-1] & printable[2:])
        text = np.searchsorted(ends, at_b + at, side="right") - 1
        inside = at_b + at + 3 <= ends[text + 1]
        at_b, text = at_b[inside], text[inside]
        found.append(np.unique(((b[at_b] << 16 | b[at_b + 1] << 8 | b[at_b + 2]) << 32) | text))
    keys = found[-1] if len(found) <= 2 else np.unique(np.concatenate(found))
    return keys >> 32, keys & 0xFFFFFFFF


# --- what a match must hold ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Need:
    """A gram, or all or any of other needs. None stands for no condition."""

    kind: str
    gram: str = ""
    parts: tuple[Need, ...] = ()

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts))

    def holds(self, found) -> object:
        """``found`` says of a gram whether it is there, as a bool or a Column."""
        if self.kind == "gram":
            return found(self.gram)
        got = [p.holds(found) for p in self.parts]
        out = got[0]
        for g in got[1:]:
            out = (out & g) if self.kind == "all" else (out | g)
        return out

    def rarest(self, counts: dict[str, int], most: int) -> Need:
        """With at most ``most`` parts in each conjunction: any subset of what is mandatory is mandatory."""
        if self.kind == "gram":
            return self
        parts = tuple(dict.fromkeys(p.rarest(counts, most) for p in self.parts))
        if self.kind == "all":
            parts = tuple(sorted(parts, key=lambda p: (max(counts.get(g, 0) for g in p.grams()), sorted(p.grams())))[:most])
        return parts[0] if len(parts) == 1 else Need(self.kind, parts=parts)


def _all(parts: Iterable[Need | None]) -> Need | None:
    known = tuple(dict.fromkeys(p for p in parts if p))
    return None if not known else known[0] if len(known) == 1 else Need("all", parts=known)


def _any(parts: Iterable[Need | None]) -> Need | None:
    known = tuple(dict.fromkeys(parts))
    return None if None in known or not known else known[0] if len(known) == 1 else Need("any", parts=known)


def literal_need(text: str) -> Need | None:
    """What a literal must hold: the grams of its runs of printable ASCII."""
    runs = re.findall("[ -~]{3,}", "".join(c.lower() if c in _UPPER else _FOLDS.get(c, c) for c in text))
    return _all(Need("gram", r[i : i + 3]) for r in runs for i in range(len(r) - 2))


class _Unknown(Exception):
    """A form of which nothing is concluded."""


class _Pattern:
    """Reads a regex only as far as its mandatory literals go; whatever is not plainly understood ends in _Unknown."""

    _TIMES = re.compile(r"(?:([*+?])|\{(\d+)(?:,\d*)?\})[+?]?")

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def need(self) -> Need | None:
        got = self.choice()
        if self.at < len(self.p):
            raise _Unknown
        return got

    def choice(self) -> Need | None:
        branches = [self.sequence()]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            branches.append(self.sequence())
        return _any(branches)

    def sequence(self) -> Need | None:
        parts, run = [], ""
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            literal, inner = self.atom()
            times = self._TIMES.match(self.p, self.at)
            self.at = times.end() if times else self.at
            optional = bool(times) and (times[1] in ("*", "?") if times[1] else int(times[2]) == 0)
            if literal is None or optional:
                parts.append(literal_need(run))
                run = ""
                if not optional:
                    parts.append(inner)
            elif times:  # once or more: it ends what stands before and begins what follows
                parts.append(literal_need(run + literal))
                run = literal
            else:
                run += literal
        return _all([*parts, literal_need(run)])

    def atom(self) -> tuple[str | None, Need | None]:
        """A literal character, or what a group must hold."""
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            return None, self.group()
        if c == "[":
            return None, self.char_class()
        if c == "\\":
            return self.escape(), None
        if c in "*+?{":
            raise _Unknown
        return (None if c in ".^$" else c), None

    def group(self) -> Need | None:
        head = re.compile(r"\?(?:(<?[=!])|:|>|<[A-Za-z]\w*>|([imsu]+)([:)]))|(?!\?)").match(self.p, self.at)
        if head is None:
            raise _Unknown
        self.at = head.end()
        if head[3] == ")":
            return None
        got = self.choice()
        if self.p[self.at : self.at + 1] != ")":
            raise _Unknown
        self.at += 1
        return None if head[1] else got

    def char_class(self) -> None:
        """Skipped; classes inside classes and intersections are not understood."""
        m = re.compile(r"\^?(?:[^\[\]\\&]|&(?!&)|\\[^QEcpPxukN0])(?:[^\[\]\\&]|&(?!&)|\\[^QEcxukN0])*\]").match(self.p, self.at)
        if m is None:
            raise _Unknown
        self.at = m.end()

    def escape(self) -> str | None:
        m = re.compile(r"[wWdDsSbBAzZGhHvVRntrf]|[pP](?:\{\w+\}|[A-Z])|[1-9]|[^A-Za-z0-9]", re.S).match(self.p, self.at)
        if m is None:
            raise _Unknown
        self.at = m.end()
        return None if m[0][0].isascii() and m[0][0].isalnum() else m[0]


def regex_need(pattern: str) -> Need | None:
    """What every match of a regex must hold, None if nothing is known to be mandatory."""
    try:
        return _Pattern(pattern).need()
    except (_Unknown, RecursionError):
        return None


# --- tables --------------------------------------------------------------------------------------------------


def _bucket(gram: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(n)).cast("int")


def _packed(numbers: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of ascending numbers below 16,384, each list as steps of one byte or two, seven bits in each."""
    steps = np.diff(numbers, prepend=0)
    steps[starts] = numbers[starts]
    wide = steps > 127
    ends = np.cumsum(1 + wide)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = np.where(wide, steps >> 7, steps)
    out[ends[wide] - 2] = steps[wide] & 127 | 128
    offsets = np.append(np.append(0, ends)[starts], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    starts = np.flatnonzero(np.append(True, b[:-1] < 128))
    steps = b[starts] & 127
    wide = b[starts] > 127
    steps[wide] |= b[starts[wide] + 1] << 7
    return np.cumsum(steps)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, segment, gram, n, numbers of batches of part, segment, number, text."""
    for batch in sliced(batches, "text", 1 << _SEGMENT, _BYTES):
        parts, segments, numbers = (batch.column(c).to_numpy() for c in ("part", "segment", "number"))
        cuts = np.flatnonzero(np.append(True, (np.diff(segments) != 0) | (np.diff(parts) != 0) | (np.diff(numbers) <= 0)))
        for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            code, text = grams(batch.column("text").slice(at, end - at))
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            three = (code[starts, None] >> np.array([16, 8, 0])).astype(np.uint8)
            gram = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.arange(0, 3 * len(starts) + 1, 3, np.int32)), pa.py_buffer(three.tobytes())])
            n = np.diff(np.append(starts, len(code)))
            same = lambda x, kind: pa.array(np.full(len(starts), x), kind)
            columns = [same(parts[at], pa.int32()), same(segments[at], pa.int64()), gram, pa.array(n, pa.int32()), _packed(numbers[at:end][text].astype(np.int64), starts)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "gram", "n", "numbers"])


def build(paragraphs: DataFrame, folder: str, parts: int = 64, buckets: int = 64) -> SearchIndex:
    """A new index of at most ``parts`` folders of paragraphs and ``buckets`` folders of grams; both should grow with the corpus."""
    spark = paragraphs.sparkSession
    columns = paragraphs.select("doc_id", "para_idx", *(c for c in paragraphs.columns if c not in ("doc_id", "para_idx"))).schema.json()
    spark.createDataFrame([(parts, buckets, columns, None)], _SETTINGS).write.mode("error").parquet(f"{folder}/settings")
    index = SearchIndex(spark, folder)
    index.add(paragraphs)
    return index


_SETTINGS = "parts int, buckets int, columns string, added string"


class SearchIndex:
    """An index that was built before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.parts, self.buckets, columns = self._settings().filter("added is null").first()[:3]
        numbered = StructType.fromJson(json.loads(columns)).add("_segment", "long").add("_number", "integer").add("added", "string").add("part", "integer")
        posted = StructType().add("part", "integer").add("segment", "long").add("gram", "string").add("n", "integer").add("numbers", "binary")
        self._schemas = {"texts": numbered, "postings": posted.add("added", "string").add("bucket", "integer")}

    def _settings(self) -> DataFrame:
        return self.spark.read.schema(_SETTINGS).parquet(f"{self.folder}/settings")

    def _table(self, name: str) -> DataFrame:
        """What has been added whole by now."""
        whole = [r[0] for r in self._settings().filter("added is not null").select("added").collect()]
        return self._rows(name).filter(F.col("added").isin(whole))

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.folder}/{name}")

    def add(self, paragraphs: DataFrame) -> None:
        """Adds paragraphs, as their tasks come: a few very large tasks are better dealt anew before."""
        name, place = uuid.uuid4().hex, F.monotonically_increasing_id()
        numbered = paragraphs.withColumn("_segment", F.shiftright(place, _SEGMENT)).withColumn("_number", (place % (1 << _SEGMENT)).cast("int"))
        dealt = numbered.withColumn("added", F.lit(name)).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(self.parts)))
        dealt.write.mode("append").partitionBy("added", "part").parquet(f"{self.folder}/texts", compression="zstd")
        mine = self._rows("texts").filter(F.col("added") == name).select("part", F.col("_segment").alias("segment"), F.col("_number").alias("number"), "text")
        posted = mine.mapInArrow(_postings, "part int, segment bigint, gram string, n int, numbers binary")
        laid = posted.withColumn("added", F.lit(name)).withColumn("bucket", _bucket(F.col("gram"), self.buckets)).sortWithinPartitions("added", "bucket", "gram", "segment")
        laid.write.mode("append").partitionBy("added", "bucket").parquet(f"{self.folder}/postings", compression="zstd")
        self.spark.createDataFrame([(self.parts, self.buckets, None, name)], _SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.folder}/settings")

    def _posted(self, asked: Iterable[str]) -> DataFrame:
        """The postings of some grams, read from their folders only."""
        asked = sorted(asked)
        folders = self.spark.createDataFrame([(g,) for g in asked], "g string").select(_bucket(F.col("g"), self.buckets)).distinct().collect()
        return self._table("postings").filter(F.col("bucket").isin([r[0] for r in folders]) & F.col("gram").isin(asked))

    def need(self, find: str, regex: bool = False) -> Need | None:
        """The grams that a search asks for, the rarest ones. The driver sees the counts of the pattern's own grams."""
        need = regex_need(find) if regex else literal_need(find)
        if need is None:
            return None
        asked = need.grams()
        counts = {r["gram"]: r["n"] for r in self._posted(asked).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        for most in (_ASKED, 1):
            got = need.rarest(counts, most)
            if len(got.grams()) <= _MOST_GRAMS:
                return got
        return None

    def candidates(self, find: str, regex: bool = False) -> DataFrame:
        """The paragraphs that may match, with all their columns."""
        texts, need = self._table("texts"), self.need(find, regex)
        own = ("added", "part", "_segment", "_number")
        if need is None:
            return texts.drop(*own)

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A bit for each paragraph of a segment that may match; segments without one are left out."""
            for batch in batches:
                kept, words = [], []
                for i, lists in enumerate(batch.column("lists").to_pylist()):
                    held = {g: np.zeros(1 << _SEGMENT, bool) for g in need.grams()}
                    for x in lists:
                        held[x["gram"]][_unpacked(x["numbers"])] = True
                    bits = need.holds(held.__getitem__)
                    if bits.any():
                        kept.append(i)
                        words.append(np.packbits(bits, bitorder="little").view("<i8"))
                columns = [batch.column(c).take(pa.array(kept, pa.int32())) for c in ("added", "part", "segment")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.list_(pa.int64()))], ["added", "part", "_segment", "words"])

        lists = self._posted(need.grams()).groupBy("added", "part", "segment").agg(F.collect_list(F.struct("gram", "numbers")).alias("lists"))
        bits = lists.mapInArrow(marked, "added string, part int, _segment bigint, words array<bigint>")
        word = F.get("words", F.shiftright("_number", 6))
        # the bits of all segments are a byte for eight paragraphs, so a task can have them whole; without the hint all texts are shuffled
        return texts.join(F.broadcast(bits), ["added", "part", "_segment"]).filter(F.getbit(word, F.col("_number") % 64) == 1).drop(*own, "words")

    def matches_of(self, find: str, regex: bool = False, headings_only: bool = False) -> DataFrame:
        """As :func:`search.matches_of` over all paragraphs."""
        return search.matches_of(self.candidates(find, regex), find, regex, headings_only)

    def preview(self, find: str, regex: bool = False, samples: int = 8) -> DataFrame:
        """As :func:`search.preview` over all paragraphs."""
        return search.preview(self.candidates(find, regex), find, regex, samples)
