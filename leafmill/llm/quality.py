"""Quality scores by Bradley-Terry ranking.

A document's strength is a weighted sum of its features, each a rate or length cut into the sample's quantile steps. The
weights are learned from preference pairs (a good and a bad training document): logistic loss on the difference of their
features. The cut-off is a quantile of the sample's strengths, the one that parts good from bad best; scores are a
logistic curve of the strength that passes 0.3 there, so a document is predicted good from that quantile on.

The fit takes about ``FIT_ROWS`` labelled training rows, chosen by a hash of the id, one text an id, and ``PAIRS``
pairs of them; executors reduce texts to features before the driver sees them.

Defined cases: a null or empty text is scored by its (zero) features; without both labels, as with an empty table,
every score is 0; several labels of one id are averaged and rounded up at a half; of several texts of one id the one
with the smallest hash is learned from, and every row is scored; equal texts get equal scores; texts are read whole,
however long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.boosting import logistic
from leafmill.llm.common import LOWER, buffers, crc_mod, mix, per_doc, prefix_sums, runs, spans_hash, sums_by_doc, table, word_spans
from leafmill.llm.rules import count_measures
from leafmill.llm.toxicity import labelled, score_texts

FIT_ROWS, PAIRS, STEPS = 12_000, 60_000, 8
PASSES = 0.3

_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_STOP = np.isin(_B, list(b".!?"))


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    m = count_measures(buf, off)
    low = LOWER[buf]
    start, end, doc = word_spans(low, off)
    h = spans_hash(prefix_sums(low), start, end)
    key = mix(h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    _, first = np.unique(key, return_index=True)
    words, chars, lines = (np.maximum(1, m[c]) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(m["n_words"]),
            m["word_chars"] / words,
            m["n_symbols"] / words,
            m["n_marks"] / words,
            m["n_uppers"] / chars,
            m["n_dup_lines"] / lines,
            m["n_repeat_words"] / words,
            per_doc(doc[first], n) / np.sqrt(words),
            sums_by_doc(_DIGIT[buf], off) / chars,
            sums_by_doc(_STOP[buf], off) / words,
            sums_by_doc(buf == 124, off) / words,
            sums_by_doc(buf == 33, off) / words,
            words / lines,
            per_doc(doc[end - start == 1], n) / words,
            per_doc(doc[end - start > 14], n) / words,
            sums_by_doc(buf >= 128, off) / chars,
        ],
        axis=1,
    )


class Model:
    def __init__(self, edges: list[np.ndarray], weights: np.ndarray):
        self.edges, self.weights, self.slope, self.cut = edges, weights, 1.0, 0.0

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Cumulative quantile steps: column k of a feature is 1 above its k-th edge."""
        return np.concatenate([(x[:, [j]] > e).astype(float) for j, e in enumerate(self.edges)], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) @ self.weights

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(features(buf, off)) - self.cut) + np.log(PASSES / (1 - PASSES))
        return np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 0, 1)


def rank(x: np.ndarray, y: np.ndarray) -> Model:
    """Weights from preference pairs, slope and cut from the strengths of the sample."""
    # edges from both classes alike, or a rare class would share one step
    edges = []
    for j in range(x.shape[1]):
        each = [np.quantile(x[y == v, j], np.linspace(0, 1, STEPS + 1)[:-1], method="lower") for v in (0, 1)]
        edges.append(np.unique(np.concatenate(each)))
    model = Model(edges, np.zeros(sum(map(len, edges))))
    s = model.steps(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    a, b = draw.choice(good, PAIRS), draw.choice(bad, PAIRS)
    model.weights = logistic(s[a] - s[b], np.ones(PAIRS), ridge=20.0)
    strength = s @ model.weights
    order = np.sort(strength)
    quantiles = np.unique(order[(np.linspace(0, 1, 401)[1:-1] * len(order)).astype(int)])
    kept = [((strength >= q) & (y == 1)).sum() / len(good) + ((strength < q) & (y == 0)).sum() / len(bad) for q in quantiles]
    at = int(np.argmax(kept))
    # halfway into the gap below the quantile
    under = order[order < quantiles[at]]
    model.cut = float((quantiles[at] + under[-1]) / 2) if len(under) else float(quantiles[at])
    model.slope = max(0.1, float(logistic(np.stack([strength - model.cut, np.ones(len(s))], axis=1), y, ridge=1.0)[0]))
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column, most: int = FIT_ROWS) -> Model | None:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole):
                x = features(*buffers(batch.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    rows = labelled(docs, labels, "quality", train, most)
    got = rows.select("doc_id", "y", "text").mapInArrow(emit, "doc_id bigint, y int, x array<double>").collect()  # bounded by FIT_ROWS
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    return rank(x, y) if len(set(y)) == 2 else None


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = score_texts(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= PASSES).cast("int").alias("predicted"))
