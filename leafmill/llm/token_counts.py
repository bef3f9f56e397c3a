"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only.

A task cuts its rows into batches of about ``BATCH_BYTES`` of text, whatever their number, so long and short documents
cost a worker alike. Texts are split at safe boundaries: between two characters that no entry of the vocabulary holds
next to each other. Byte-pair merges only ever join neighbours into an entry of the vocabulary, so none crosses such a
boundary, and both sides are encoded as they would be together.

A space after another character is such a boundary, so a text falls into units of a word with the spaces before it; a
batch's distinct units are encoded together, each once. The library puts a space before whatever it is given, which stands for a unit's own first space. A unit over ``PIECE`` characters is split further, at any safe
boundary: a later part starts with the character before its boundary, and the tokens of that character alone are taken
off again. A stretch without a safe boundary stays in one part.

Defined cases: a null or empty text has no token and no byte; ties do not arise, each row is counted by itself, so
repeated rows (and rows without an id) give repeated results; a very long text is split as above, its count is that of
the whole; strings that name special tokens are ordinary text, as the library's default has it; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import buffers, runs, table

LIMIT = 4096
VOCABULARY = "piece_bpe_32k.model"
BATCH_BYTES, PIECE = 8 << 20, 1 << 10
#: Fixed value: the character that stands for a space in the vocabulary.
SPACE_MARK = "▁"


class Counter:
    """Lengths of whole texts in tokens of one vocabulary file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = range(self.model.get_piece_size())
        entries = [self.model.id_to_piece(i) for i in n if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.joined = {a + b for e in entries for a, b in zip(e, e[1:])}
        # a space may be met as itself or as its mark
        self.joined |= {p.replace(SPACE_MARK, " ") for p in self.joined} | {p[0] + " " for p in self.joined if p[1] == SPACE_MARK} | {" " + p[1] for p in self.joined if p[0] == SPACE_MARK}
        spaced = {p[0] for p in self.joined if p[1] == " "}
        if spaced - {" ", SPACE_MARK}:
            raise ValueError(f"{path} has entries with a space inside")

    def parts(self, text: str, most: int) -> tuple[list[str], list[str]]:
        """The parts to encode, and the characters whose tokens are counted twice then."""
        out, extra, a, n = [], [], 0, len(text)
        while n - a > most:
            b = a + most
            while b < n and text[b - 1 : b + 1] in self.joined:
                b += 1
            if b == n:
                break
            out.append(text[max(0, a - 1) : b])
            extra.append(text[b - 1])
            a = b
        out.append(text[max(0, a - 1) :])
        return out, extra

    def encoded(self, texts: list[str], most: int) -> np.ndarray:
        """Tokens of each of ``texts``, encoded with a space before it."""
        whole, extra, last = [], [], []
        if max(map(len, texts), default=0) <= most:
            return np.fromiter(map(len, self.model.encode(texts, num_threads=1)), np.int64, len(texts))
        for t in texts:
            out, twice = self.parts(t, most)
            whole += out
            extra += twice
            last.append((len(whole), len(extra)))
        plus, minus = (np.concatenate([[0], np.cumsum([len(x) for x in self.model.encode(p, num_threads=1)])]) for p in (whole, extra))
        upto = np.array([(0, 0), *last], np.int64)
        return (np.diff(plus[upto[:, 0]]) - np.diff(minus[upto[:, 1]])).astype(np.int64)

    def lengths(self, buf: np.ndarray, off: np.ndarray, most: int = PIECE) -> np.ndarray:
        """Tokens of each text of a batch, given by its bytes and offsets."""
        total = np.zeros(len(off) - 1, np.int64)
        if not len(buf):
            return total
        # a space begins a unit if no space, nor what may be the last byte of its mark, stands before it
        begins = np.zeros(len(buf), bool)
        begins[1:] = (buf[1:] == 0x20) & (buf[:-1] != 0x20) & (buf[:-1] != 0x81)
        first = off[:-1][off[1:] > off[:-1]]
        begins[first] = True
        start = np.flatnonzero(begins)
        units = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(buf))), pa.py_buffer(np.ascontiguousarray(buf)))
        coded = units.dictionary_encode()
        texts = [u[1:] if u[0] == " " else u for u in coded.dictionary.to_pylist()]
        size = self.encoded(texts, most)
        if "" in texts:
            size[texts.index("")] = 1  # a space alone is its mark
        n = size[coded.indices.to_numpy()]
        led = np.searchsorted(start, first[buf[first] == 0x20])  # texts that begin with a space of their own
        if len(led):
            n[led] = self.encoded(units.take(pa.array(led)).to_pylist(), most)
        upto = np.concatenate([[0], np.cumsum(n)])
        return np.diff(upto[np.searchsorted(start, off)])


_counters: dict[str, Counter] = {}


def counter(path: str | None) -> Counter:
    """The worker's counter, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counting(path: str | None, batch_bytes: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for whole in batches:
            for batch in runs(whole, most=batch_bytes):
                buf, off = buffers(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(own.lengths(buf, off, piece))], ["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text); ``path`` is a vocabulary file of the
    sentencepiece library, by default that of ``VOCABULARY``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = rows.mapInArrow(counting(path, batch_bytes, piece), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
