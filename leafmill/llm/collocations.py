"""Phrase collocations from sorted count streams, after the layout of external estimation of language models.

Every word of a piece starts a window of up to ``ORDER`` words. Windows, counted within each batch, form one stream of
(language, words) with counts, which a range sort brings into prefix order. There the windows that share their first k
words stand together, so one pass over the sorted stream gives the counts of all phrases of 1 to ``ORDER`` words at once:
a run for each length stays open, and what a partition's first and last runs hold is completed by a sum over the few
partitions that share them. No phrase is looked up in a table. A word, pair or line that a third of all texts hold is one
row a batch, and its windows are dealt over as many ranges as they fill.

In the stream, a word is a code of two or three bytes from a code book of at most ``CODES`` words, or else it is spelled
out. The book is taken from about ``SAMPLE`` documents; it only shortens the stream (no code is the beginning of another,
so windows with the same first words still stand together) and has no part in any result. So do the bounds of the
ranges, which come from the windows of some of these documents and only even out the partitions.

The phrases that occur often enough are the count stream of everything that follows. A phrase's cuts are brought into
prefix order for the counts of their left parts and into suffix order for those of their right parts, and phrases into
the order of the parts of longer ones for extension counts; each is a merge join of two sorted streams. All sums and
comparisons are exact: products are decimals of 38 digits.

Defined cases: a null or empty text has no words; a null language is ``und``, together with texts of that name; ties in
rank are broken as stated down to the phrase, which is unique in a language; rows that repeat a text or an id all count;
texts are read whole, whatever their length; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import LOWER, buffers, cut, runs, spans_of, table

ORDER, LEAST, COVERED, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
BATCH_BYTES, STREAM_ROWS, SHARDS = 3 << 20, 1 << 18, 64
SAMPLE, CODES, SHORT, DRAWN = 20_000, 1 << 18, 1 << 14, 64

_B = np.arange(256)
_BREAK = np.isin(_B, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_BREAK & (_B != 0x20) & (_B != 0x09)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts in lower case, the document of each, and where a piece begins."""
    low = LOWER[buf]
    start, end, doc = spans_of(_WORD[low], off)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[low])])
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
    upto = np.concatenate([[0], np.cumsum(end - start)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(upto), pa.py_buffer(low[_WORD[low]])]), doc, new


class Book:
    """Codes of the most frequent words; a code is told by its first byte, a spelled word ends with a space."""

    def __init__(self, found: list[bytes]):
        self.found, self.array = found, pa.array(found, pa.large_binary())

    def code(self, i: int) -> bytes:
        return (0x8000 + i).to_bytes(2) if i < SHORT else (0xC00000 + i - SHORT).to_bytes(3)

    def tokens(self, distinct: pa.Array) -> list[bytes]:
        known = pc.index_in(distinct, self.array).to_pylist()
        return [b"\x01" + w + b" " if i is None else self.code(i) for w, i in zip(distinct.to_pylist(), known)]

    def word(self, token: bytes) -> bytes:
        if token[0] == 1:
            return token[1:-1]
        return self.found[int.from_bytes(token) - 0x8000 if len(token) == 2 else int.from_bytes(token) - 0xC00000 + SHORT]


def token_ends(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the tokens of all rows end."""
    spaces = np.append(np.flatnonzero(buf == 0x20), len(buf))
    mark = np.zeros(len(buf) + 1, bool)
    at, stop = off[:-1], off[1:]
    while True:
        more = at < stop
        at, stop = at[more], stop[more]
        if not len(at):
            return np.flatnonzero(mark)
        lead = buf[at]
        at = np.where(lead >= 0xC0, at + 3, np.where(lead >= 0x80, at + 2, spaces[np.searchsorted(spaces, at)] + 1))
        mark[at] = True


def windows(buf: np.ndarray, off: np.ndarray, langs: pa.Array, book: Book, order: int = ORDER) -> pa.Array:
    """The window that each word of the texts starts: the tokens of its language and of the words."""
    found, doc, new = words(buf, off)
    if not len(found):
        return pa.array([], pa.large_binary())
    coded, spoken = found.dictionary_encode(), langs.cast(pa.large_binary()).dictionary_encode()
    tokens, heads = book.tokens(coded.dictionary), book.tokens(spoken.dictionary)
    pool = np.frombuffer(b"".join(tokens + heads), np.uint8)
    size = np.fromiter(map(len, tokens + heads), np.int64, len(tokens) + len(heads))
    place = np.concatenate([[0], np.cumsum(size)])[:-1]
    word = coded.indices.to_numpy()
    at = np.concatenate([[0], np.cumsum(size[word])])
    line = pool[np.repeat(place[word] - at[:-1], size[word]) + np.arange(at[-1])]
    piece_end = np.append(np.flatnonzero(new)[1:], len(found))[np.cumsum(new) - 1]
    stop = at[np.minimum(np.arange(len(found)) + order, piece_end)]
    head = len(tokens) + spoken.indices.to_numpy()[doc]
    n, m = size[head], stop - at[:-1]
    upto = np.concatenate([[0], np.cumsum(n + m)])
    data = np.empty(upto[-1], np.uint8)
    for source, begin, where, count in ((pool, place[head], upto[:-1], n), (line, at[:-1], upto[:-1] + n, m)):
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        data[np.repeat(where, count) + step] = source[np.repeat(begin, count) + step]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(m), [None, pa.py_buffer(upto), pa.py_buffer(data)])


def _count_windows(book: Book, bounds: list[bytes]):
    """Windows (k) with their counts in a batch (c) and the range that each is in (p)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, most=BATCH_BYTES):
                got = pc.value_counts(windows(*buffers(batch.column("text")), batch.column("lang"), book))
                got = got.take(pc.sort_indices(got.field(0)))
                keys = got.field(0)
                at, upto = 0, [0]
                for b in bounds:
                    at = bisect_left(range(len(keys)), b, at, key=lambda i: keys[i].as_py())
                    upto.append(at)
                part = np.repeat(np.arange(len(upto), dtype=np.int32), np.diff([*upto, len(keys)]))
                for a in range(0, len(keys), STREAM_ROWS):
                    some = got.slice(a, STREAM_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(part[a : a + STREAM_ROWS]), some.field(0).cast(pa.binary()), some.field(1)], ["p", "k", "c"])

    return count


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in runs(whole, most=BATCH_BYTES):
            found, doc, _ = words(*buffers(batch.column("text")))
            langs = batch.column("lang").cast(pa.large_binary()).take(pa.array(doc))
            got = pc.value_counts(pa.chunked_array([found, langs]))
            for a in range(0, len(got), STREAM_ROWS):
                some = got.slice(a, STREAM_ROWS)
                yield pa.RecordBatch.from_arrays([some.field(0).cast(pa.binary()), some.field(1)], ["k", "c"])


def _some(docs: DataFrame, share: float) -> DataFrame:
    return docs if share >= 1 else docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def code_book(docs: DataFrame, share: float, codes: int = CODES) -> Book:
    """The most frequent words (and languages) of a ``share`` of the ``docs`` (lang, text)."""
    often = _some(docs, share).mapInArrow(_count_words, "k binary, c bigint").groupBy("k").agg(F.sum("c").alias("c")).filter("c > 1")
    return Book([bytes(r["k"]) for r in often.orderBy(F.desc("c"), "k").limit(codes).select("k").collect()])  # `codes` at most


def range_bounds(docs: DataFrame, share: float, book: Book, n: int) -> list[bytes]:
    """n - 1 windows that cut the stream into ranges of about the same size, by ``DRAWN`` windows a range."""
    drawn = _some(docs, share).mapInArrow(_count_windows(book, []), "p int, k binary, c bigint").orderBy(F.xxhash64("k"), "k").limit(DRAWN * n)
    keys = sorted(bytes(r["k"]) for r in drawn.select("k").collect())
    return [keys[len(keys) * i // n] for i in range(1, n)] if keys else []


class Runs:
    """Counts of the prefixes of each length in a sorted stream of windows (k, c), of which a run for each length stays open."""

    def __init__(self, depths: int, least: int):
        self.depths, self.least, self.started = range(depths), least, False
        self.key: list[bytes | None] = [None] * depths
        self.count, self.edge = [0] * depths, [False] * depths  # edge: the run began with the stream
        self.out: list[tuple[bytes, int, int]] = []

    def close(self, d: int, last: bool = False) -> None:
        """Ends a run. What may go on in another partition is told however small, and so are the languages' totals."""
        if self.key[d] is not None and (d == 0 or last or self.edge[d] or self.count[d] >= self.least):
            self.out.append((self.key[d], d, self.count[d]))

    def add(self, rows: pa.Table) -> None:
        keys = rows.column("k").combine_chunks().cast(pa.large_binary())
        c = rows.column("c").to_numpy()
        buf, off = buffers(keys)
        ends = token_ends(buf, off)  # of all words; the language is the first of a row
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(np.ascontiguousarray(buf))])
        code = parts.dictionary_encode().indices.to_numpy()
        upto = np.searchsorted(ends, off, side="right")
        first, held = upto[:-1], np.diff(upto)
        raw, new = buf.tobytes(), np.zeros(len(c), bool)
        new[0] = True
        for d in self.depths:
            at = np.minimum(first + d, len(code) - 1)
            word = np.where(held > d, code[at], -1)
            new[1:] |= word[1:] != word[:-1]
            starts = np.flatnonzero(new)
            total, whole, a, b = np.add.reduceat(c, starts), held[starts] > d, off[starts], ends[at[starts]]
            head = raw[a[0] : b[0]] if whole[0] else None
            if head is not None and head == self.key[d]:
                self.count[d] += int(total[0])
            else:
                self.close(d)
                self.key[d], self.count[d], self.edge[d] = head, int(total[0]), not self.started
            if len(starts) > 1:
                self.close(d)
                pick = np.flatnonzero(whole & ((total >= self.least) | (d == 0)))
                pick = pick[(pick > 0) & (pick < len(starts) - 1)]
                self.out += [(raw[i:j], d, n) for i, j, n in zip(a[pick].tolist(), b[pick].tolist(), total[pick].tolist())]
                self.key[d], self.count[d], self.edge[d] = (raw[a[-1] : b[-1]] if whole[-1] else None), int(total[-1]), False
        self.started = True

    def take(self, book: Book) -> pa.RecordBatch:
        """The closed runs: words with a space after each, d, c."""
        k, d, c = zip(*self.out) if self.out else ((), (), ())
        self.out = []
        raw = b"".join(k)
        off = np.concatenate([[0], np.cumsum([len(x) for x in k], dtype=np.int64)]).astype(np.int64)
        ends = token_ends(np.frombuffer(raw, np.uint8), off)
        said = [book.word(raw[i:j]) + b" " for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
        upto = np.searchsorted(ends, off, side="right").tolist()
        text = [b"".join(said[i:j]) for i, j in zip(upto, upto[1:])]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.binary()).cast(pa.string()), pa.array(d, pa.int32()), pa.array(c, pa.int64())], ["k", "d", "c"])


def _count_prefixes(least: int, book: Book):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = Runs(ORDER + 1, least), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= STREAM_ROWS:
                own.add(pa.Table.from_batches(held))
                held, n = [], 0
                yield own.take(book)
        if held:
            own.add(pa.Table.from_batches(held))
        for d in own.depths:
            own.close(d, last=True)
        yield own.take(book)

    return count


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, m (its number of words), f: phrases of up to ``ORDER`` words that occur ``least`` times, and each
    language's number of words (m = 0)."""
    lang = F.url_encode(F.coalesce("lang", F.lit("und")))  # without spaces, so it can stand as a window's first word
    docs = docs.select(lang.alias("lang"), "text")
    share, n = SAMPLE / max(1, docs.count()), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    book = code_book(docs, share)
    stream = docs.mapInArrow(_count_windows(book, range_bounds(docs, share / 8, book, n)), "p int, k binary, c bigint")
    stream = stream.repartitionById(n, "p").select("k", "c").sortWithinPartitions("k")
    counted = stream.mapInArrow(_count_prefixes(least, book), "k string, d int, c bigint").groupBy("k", "d").agg(F.sum("c").alias("f"))
    head = F.substring_index("k", " ", 1)
    phrase = F.expr("substring(k, instr(k, ' ') + 1, length(k) - instr(k, ' ') - 1)")
    return counted.filter((F.col("d") == 0) | (F.col("f") >= least)).select(F.url_decode(head).alias("lang"), phrase.alias("phrase"), F.col("d").alias("m"), "f")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _words(c: str, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(F.col(c), " "), start, n), " ")


def lowest_cuts(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, at its lowest-scoring cut."""
    parts = counts.filter("m > 0").select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = counts.filter("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - m)")})
    for side, name in (("left", "l"), ("rest", "r")):  # prefix order, then suffix order
        met = (F.col("lang") == F.col("part_lang")) & (F.col(side) == F.col("part"))
        cuts = cuts.join(parts.hint("merge"), met).withColumnRenamed("part_f", name).drop("part_lang", "part", side)
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(19,0)) * CAST(f AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase", F.col("f").alias("a")).agg(best).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def extensions(counts: DataFrame) -> DataFrame:
    """part_lang, part, longer: the largest count of a longer phrase that holds the part."""
    lengths = F.sequence(F.lit(2), F.col("m") - 1)
    parts = counts.filter("m > 2").withColumn("n", F.explode(lengths)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n") + 1)))
    return parts.select(F.col("lang").alias("part_lang"), _words("phrase", F.col("i"), F.col("n")).alias("part"), "f").groupBy("part_lang", "part").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    counts = cut(phrase_counts(docs, least), "phrases")
    longer = extensions(counts).hint("merge")
    found = lowest_cuts(counts).join(longer, (F.col("lang") == F.col("part_lang")) & (F.col("phrase") == F.col("part")), "left")
    stays = F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * _exact("longer") < F.lit(covered).cast("decimal(3,0)") * _exact("a"))
    found = found.filter(stays).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each shard first, so that one task sees a language's best `SHARDS` x `top` rows at most
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    found = found.withColumn("shard", shard).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("m = 0").select(F.col("lang").alias("total_lang"), F.col("f").alias("n"))
    found = found.join(totals, F.col("lang") == F.col("total_lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest(range(1, {ORDER + 1})) AS m))),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, c.k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(ws[i:i + q - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, ws, f, q, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM f WHERE m > 2)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::INTEGER AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer e ON e.lang = b.lang AND e.phrase = b.phrase
WHERE e.f IS NULL OR 100::HUGEINT * e.f < {COVERED} * a
QUALIFY rank <= {TOP}
"""
