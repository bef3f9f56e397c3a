"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (plain, weighted, and after undoing digit and symbol spellings), how
near its hits are to second-person words, densities of second-person words, capitals, exclamation and question marks,
other punctuation, digits, letters joined by foreign characters, stretched letters, and length. The lexicon is part of
the fit: at most ``LEXICON`` words that are much more frequent in toxic training texts than in others. The fit takes
about ``FIT_ROWS`` labelled training rows, chosen by a hash of the id, one text an id; executors reduce them to word
counts and features before the driver sees them. All of them grow the trees; the calibration uses margins from trees
that left the row's fold out. Both bounds are parameters of :func:`fit`.

Defined cases: a null or empty text is scored by its (zero) features; without two labels to learn from, as with an
empty table, every score is 0; several labels of one id are averaged and rounded up at a half; of several texts of one
id the one with the smallest hash is learned from, and every row is scored; equal texts get equal scores; texts are
read whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.boosting import Boosted, isotonic
from leafmill.llm.common import LEAD, LOWER, SPACE, buffers, crc_mod, cut, mix, per_doc, prefix_sums, runs, spans_hash, spans_of, sums_by_doc, table

FIT_ROWS = 12_000
LEXICON = 1000  # words and stems at most
FOLDS = 3
NEAR, STEM = 5, 4

#: Second-person words.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú tus usted ustedes vosotros vuestra vuestro".split()

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_ALPHA = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_ALNUM = _ALPHA | _DIGIT
_MARK = (_B > 32) & (_B < 127) & ~_ALNUM
_LEET = LOWER.copy()
for _from, _to in zip(b"013457@$!|", b"oieastasii"):
    _LEET[_from] = _to
_LEET_ALPHA = (((_LEET >= 97) & (_LEET <= 122)) | (_B >= 128))[_B]

FEATURES = 18


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    raw = [w.encode("utf-8", "surrogateescape") for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sums = prefix_sums(np.frombuffer(b"".join(raw), np.uint8))
    stem = np.array([len(r) == STEM + 1 and r.endswith(b"*") for r in raw])
    return np.where(stem, stem_hash(sums, off[:-1]), spans_hash(sums, off[:-1], off[1:]))


class Lexicon:
    """Weights of words and of stems (the first STEM bytes of longer words; spelled with a final ``*``)."""

    def __init__(self, words: list[str], weights: list[float]):
        h = _hashes(words)
        order = np.argsort(h)
        self.hash, self.weight = h[order], np.array(weights, np.float64)[order]
        self.you = np.sort(_hashes(SECOND_PERSON))

    def _of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(h))
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[k] == h, self.weight[k], 0.0)

    def weights(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Weight of each word, by itself or by its stem, 0 for those outside."""
        return np.maximum(self._of(spans_hash(sums, start, end)), np.where(end - start > STEM, self._of(stem_hash(sums, start)), 0.0))

    def second(self, h: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.you, h), len(self.you) - 1)
        return self.you[k] == h


def stem_hash(sums: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Another fingerprint than a word's, so that a stem is never taken for the word that is spelled like it."""
    return mix(spans_hash(sums, start, np.minimum(start + STEM, len(sums) - 1)) ^ np.uint64(0x5851F42D4C957F2D))


def features(buf: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(off) - 1
    low = LOWER[buf]
    start, end, doc = spans_of(_ALNUM[buf], off)
    sums = prefix_sums(low)
    h = spans_hash(sums, start, end)
    weight, you = lexicon.weights(sums, start, end), lexicon.second(h)
    hit = weight > 0
    # words within NEAR of a second-person word of the same document
    at = np.flatnonzero(you)
    near = np.zeros(len(h), bool)
    for d in range(-NEAR, NEAR + 1) if len(at) else ():
        t = at + d
        ok = (t >= 0) & (t < len(h))
        t = t[ok][doc[np.clip(t[ok], 0, len(h) - 1)] == doc[at[ok]]]
        near[t] = True
    loud = (sums_between(_UPPER[buf], start, end) == end - start) & (end - start > 1)
    leet = _LEET[buf]
    ls, le, ld = spans_of(_LEET_ALPHA[buf], off)
    odd = sums_between(_DIGIT[buf] | _MARK[buf], ls, le) > 0  # only spellings that needed undoing
    masked = (lexicon.weights(prefix_sums(leet), ls, le) > 0) & odd
    # a foreign character between two letters, and a letter three times in a row
    inner = np.zeros(len(buf), bool)
    stretched = np.zeros(len(buf), bool)
    if len(buf) > 2:
        inner[1:-1] = _ALPHA[buf[:-2]] & ~_ALPHA[buf[1:-1]] & ~SPACE[buf[1:-1]] & (buf[1:-1] != 39) & (buf[1:-1] != 45) & _ALPHA[buf[2:]]
        stretched[2:] = _ALPHA[buf[2:]] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
        # never across documents
        first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
        inner[first] = inner[last] = stretched[first] = stretched[np.minimum(first + 1, last)] = False
    words = np.maximum(1, per_doc(doc, n))
    chars = np.maximum(1, sums_by_doc(LEAD[buf] & ~SPACE[buf], off))
    hits = per_doc(doc[hit], n)
    distinct = np.unique(doc[hit].astype(np.uint64) << np.uint64(32) | (h[hit] & np.uint64(0xFFFFFFFF)))
    kinds = per_doc((distinct >> np.uint64(32)).astype(np.int64), n)
    return np.stack(
        [
            hits / words,
            hits.astype(float),
            kinds.astype(float),
            per_doc(doc, n, weight) / words,
            per_doc(doc, n, weight),
            per_doc(doc[hit & near], n) / words,
            per_doc(doc[hit & near], n) / np.maximum(1, hits),
            per_doc(doc[you], n) / words,
            per_doc(ld[masked], n) / words,
            sums_by_doc(inner, off) / words,
            sums_by_doc(stretched, off) / words,
            sums_by_doc(_UPPER[buf], off) / chars,
            per_doc(doc[loud], n) / words,
            sums_by_doc(buf == 33, off) / words,
            sums_by_doc(buf == 63, off) / words,
            sums_by_doc(_MARK[buf], off) / chars,
            sums_by_doc(_DIGIT[buf], off) / chars,
            np.log1p(per_doc(doc, n)),
        ],
        axis=1,
    )


def sums_between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[end] - total[start]


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """doc_id, text, y of about ``most`` labelled training rows (all, if fewer), chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.floor(F.avg("y") + 0.5).cast("int").alias("y")).filter(train)
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(draw < F.lit(min(1.0, most / max(1, n))))  # about `most` small rows
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text an id, so that rows that repeat an id don't break the bound
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and stem of a batch, as hexadecimal bytes, in how many texts of either label it occurs."""
    for whole in batches:
        for batch in runs(whole):
            buf, off = buffers(batch.column("text"))
            low = LOWER[buf]
            start, end, doc = spans_of(_ALNUM[buf], off)
            sums, raw, y = prefix_sums(low), low.tobytes(), batch.column("y").to_numpy()
            long = end - start > STEM
            for h, s, e, d, star in (
                (spans_hash(sums, start, end), start, end, doc, b""),
                (stem_hash(sums, start[long]), start[long], start[long] + STEM, doc[long], b"*"),
            ):
                _, first = np.unique(np.stack([h, d.astype(np.uint64)]), axis=1, return_index=True) if len(h) else (None, np.empty(0, np.int64))
                word, at, back = np.unique(h[first], return_index=True, return_inverse=True)
                toxic = np.bincount(back, y[d[first]], len(word)).astype(np.int64)
                total = np.bincount(back, minlength=len(word))
                spell = [(raw[a:b] + star).hex() for a, b in zip(s[first[at]].tolist(), e[first[at]].tolist())]
                yield pa.RecordBatch.from_pydict({"word": pa.array(spell, pa.string()), "t": pa.array(toxic), "c": pa.array(total - toxic)})


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted, places: np.ndarray, values: np.ndarray):
        self.lexicon, self.trees, self.places, self.values = lexicon, trees, places, values

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(features(buf, off, self.lexicon)), self.places, self.values)


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> Lexicon:
    n_toxic, n = rows.agg(F.sum("y"), F.count("*")).first()
    n_clean = n - n_toxic
    counts = rows.select("text", "y").mapInArrow(_word_counts, "word string, t bigint, c bigint").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    words = counts.withColumn("w", odds).filter((F.col("t") >= max(3, 0.004 * n_toxic)) & (F.col("w") > 1.2))
    got = words.orderBy(F.desc("w"), "word").limit(most).collect()
    return Lexicon([bytes.fromhex(r["word"]).decode("utf-8", "surrogateescape") for r in got], [r["w"] for r in got])


def fit(docs: DataFrame, labels: DataFrame, train: Column, most: int = FIT_ROWS, words: int = LEXICON) -> Model | None:
    rows = cut(labelled(docs, labels, "toxic", train, most), "toxic-sample")
    if rows.select("y").distinct().count() < 2:
        return None
    lexicon = learn_lexicon(rows, words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole):
                x = features(*buffers(batch.column("text")), lexicon)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = rows.mapInArrow(emit, "doc_id bigint, y int, x array<double>").collect()  # bounded by FIT_ROWS
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    fold = np.array([zlib.crc32(f"fold {r['doc_id']}".encode()) % FOLDS for r in got])
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        fits = Boosted().fit(x[rest], y[rest]) if len(set(y[rest])) == 2 else Boosted().fit(x, y)
        margin[~rest] = fits.margin(x[~rest])
    return Model(lexicon, Boosted().fit(x, y), *isotonic(margin, y))


def _score(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole):
                s = model.scores(*buffers(batch.column("text"))) if model else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return score


def score_texts(docs: DataFrame, model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id bigint, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    out = score_texts(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
