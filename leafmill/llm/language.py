"""Language identification by string kernels.

The kernel of two texts is the number of distinct n-grams of 1 to ``N`` letters that both hold, divided by the root of
the product of how many each holds (blended spectrum, presence). Letters are their lower-case code points, of any script;
runs of everything else are one gap symbol. An n-gram is named by a hash of ``BITS`` bits, which bounds the matrices
whatever the scripts; of a text's 3,000 n-grams about 17 share a name with another of them. A Nyström map over landmark texts turns the kernel into
features, kernel ridge regression against one 0/1 target per language gives the weights, and both fold into a single
matrix, so a batch is scored by two matrix products: presence x landmarks, kernel x weights.

The fit takes about ``PER_LANGUAGE`` different texts a language, chosen by a hash of the text, of which ``LANDMARKS``
are landmarks. With so many languages that these would be over ``TEXTS`` texts or ``ALL_LANDMARKS`` landmarks in all,
each language gets its even share of them (at least one landmark); none is left out. Executors reduce each text to its
n-gram names before the driver sees it.

Defined cases: a null text or one without a letter gets ``und`` and score 0; null languages are not learned from; with
no language to learn, as in an empty table, every document gets ``und``; of languages with equal scores the first in
code point order is named; rows that repeat a text and language are learned once and predicted each; texts are read
whole, however long; rows without an id are learned from and predicted like others; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from leafmill.llm.common import crc_mod, cut, mix, table

N, BITS = 3, 18
#: Code points of a text that are named at a time, which bounds memory by the text alone.
PART = 1 << 20
PER_LANGUAGE, LANDMARKS = 400, 32
TEXTS, ALL_LANDMARKS = 40_000, 1024
RIDGE = 1e-3
BATCH = 256

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, the code point of its lower-case form if it is a letter, else 0."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out
    return _letters


def _names(code: np.ndarray) -> np.ndarray:
    return mix(code) >> np.uint64(64 - BITS)


class Spectrum:
    """The n-gram names of texts."""

    def __init__(self):
        self.fold = letters()
        self.seen = np.zeros(1 << BITS, bool)

    def presence(self, text: str) -> np.ndarray:
        """Sorted names of the n-grams of 1..N symbols that occur; empty if the text has no letter. A code point fits into
        21 bits, so N of them are one number; shorter n-grams are told apart by a length where a first letter would be."""
        s = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not s.any():
            return np.empty(0, np.int64)
        s = np.concatenate([[0], s, [0]]).astype(np.uint64)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = s[keep]
        self.seen[:] = False
        for a in range(0, len(s), PART):
            part = s[a : a + PART + N - 1]
            for n in range(1, N + 1):
                code = np.full(max(0, len(part) - n + 1), np.uint64(n % N))
                for k in range(n):
                    code = (code << np.uint64(21)) | part[k : k + len(code)]
                self.seen[_names(code)] = True
        return np.flatnonzero(self.seen)


def sample(docs: DataFrame, train: Column, most: int = PER_LANGUAGE, texts: int = TEXTS) -> DataFrame:
    """lang, h, text: about ``most`` different training texts of each language (all, if fewer), chosen by a hash of the
    text, and about ``texts`` in all. Repeated texts of a language are one row, so no copy enters the bound twice."""
    pool = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text", F.lit("sample")).alias("h"), "text")
    counts = cut(pool.groupBy(F.col("lang").alias("l0")).agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    each = min(float(most), texts / max(1, counts.count()))
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = pool.join(counts, F.col("lang") == F.col("l0")).filter(draw < F.lit(each) / F.col("n"))
    return picked.groupBy("lang", "h").agg(F.min("text").alias("text"))


class Model:
    def __init__(self, columns: np.ndarray, marks: np.ndarray, sizes: np.ndarray, weights: np.ndarray, langs: list[str]):
        self.columns, self.marks, self.sizes, self.weights, self.langs = columns, marks, sizes, weights, langs

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        x = np.zeros((len(grams), self.marks.shape[0]), np.float32)
        for i, g in enumerate(grams):
            c = self.columns[g]
            x[i, c[c >= 0]] = 1
        size = np.array([max(1, len(g)) for g in grams], np.float64)
        return (x @ self.marks).astype(np.float64) / np.sqrt(size[:, None] * self.sizes)

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.kernel(grams) @ self.weights, 0, 1)

    def possible(self, grams: list[np.ndarray]) -> np.ndarray:
        """Largest kernel with a landmark of middling size that texts of so many n-grams can have; short ones have little."""
        return np.sqrt(np.minimum(1, np.array([len(g) for g in grams]) / np.median(self.sizes)))


def fit(docs: DataFrame, train: Column) -> Model | None:
    """Nyström kernel ridge regression on the bounded sample; None if there is nothing to learn from."""
    rows = cut(sample(docs.select("doc_id", "text", "lang"), train), "language-sample")
    got = rows.mapInArrow(_presence, "h bigint, lang string, grams array<int>").filter("size(grams) > 0").collect()  # bounded by the sample
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["h"]))
    langs = sorted({r["lang"] for r in got})
    most = max(1, min(LANDMARKS, ALL_LANDMARKS // len(langs)))
    grams = [np.array(r["grams"], np.int64) for r in got]
    taken: Counter = Counter()
    first = []
    for i, r in enumerate(got):
        if taken[r["lang"]] < most:
            taken[r["lang"]] += 1
            first.append(i)
    vocabulary = np.unique(np.concatenate([grams[i] for i in first]))
    columns = np.full(1 << BITS, -1, np.int32)
    columns[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary), len(first)), np.float32)
    for j, i in enumerate(first):
        marks[columns[grams[i]], j] = 1
    model = Model(columns, marks, np.array([len(grams[i]) for i in first], np.float64), np.zeros((len(first), len(langs))), langs)
    k = np.concatenate([model.kernel(grams[a : a + BATCH]) for a in range(0, len(grams), BATCH)])
    values, vectors = np.linalg.eigh(k[first] + 1e-8 * np.eye(len(first)))
    nystroem = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = k @ nystroem
    y = np.array([[r["lang"] == a for a in langs] for r in got], np.float64)
    ridge = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    model.weights = nystroem @ ridge
    return model


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spectrum = Spectrum()
    for batch in batches:
        grams = [spectrum.presence(t).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "lang": batch.column("lang"), "grams": pa.array(grams, pa.list_(pa.int32()))})


def _predict(model: Model | None, names: tuple[str, str, str], texts: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the language, its score and the score's share of what the length allows as three last columns; needs a
    ``text`` column. Without ``texts`` the last column before these, the text, is left out."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum() if model else None
        kept = slice(None) if texts else slice(0, -1)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                lang, score, share = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                if spectrum:
                    grams, at = [], []
                    for i, t in enumerate(batch.column("text")):
                        g = spectrum.presence(t.as_py() or "")
                        if len(g):
                            grams.append(g)
                            at.append(i)
                    if grams:
                        s = model.scores(grams)
                        best = s.argmax(axis=1)
                        score[at] = s[np.arange(len(at)), best]
                        share[at] = score[at] / model.possible(grams)
                        for i, b in zip(at, best):
                            lang[i] = model.langs[b]
                yield pa.RecordBatch.from_arrays([*batch.columns[kept], pa.array(lang, pa.string()), pa.array(score), pa.array(share)], [*batch.schema.names[kept], *names])

    return predict


def identified(docs: DataFrame, train: Column, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with three further columns of the given ``names``: the predicted language, its score and share, learned
    from the rows that ``train`` names."""
    model = fit(docs, train)
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), DoubleType())))])
    return docs.mapInArrow(_predict(model, names), schema)


def identify(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``."""
    names = ("lang_pred", "score", "share")
    model = fit(docs, train)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_predict(model, names, False), "doc_id bigint, lang_pred string, score double, share double")
    return rows.select("doc_id", "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
