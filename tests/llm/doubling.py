"""Plain prefix doubling over every byte position: what ``leafmill.llm.repeats`` is measured and tested against.

Positions start with a rank of their first 50 bytes. Each round joins a position's rank with the one as far on as the
ranked length, so that lengths go 50, 100, 200, 400, and positions whose rank is their own leave. Equal pairs get an
equal name by grouping, which needs no order and so costs less than sorting them.

``python tests/llm/doubling.py FOLDER`` prints the shuffle and the CPU time of a run over ``FOLDER/documents.parquet``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import buffers, cut, prefix_sums, runs, spans_hash

FIRST, LENGTH = 50, 400


def repeated_positions(docs: DataFrame) -> DataFrame:
    """doc_id, at: where a ``LENGTH``-byte string starts that starts elsewhere too. Ids must be unique."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole):
                buf, off = buffers(batch.column("text"))
                ids = batch.column("doc_id").to_numpy()
                for d in np.flatnonzero(np.diff(off) >= LENGTH):
                    sums = prefix_sums(buf[off[d] : off[d + 1]])
                    at = np.arange(len(sums) - FIRST)
                    rank = spans_hash(sums, at, at + FIRST)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[d])), pa.array(at.astype(np.int32)), pa.array(rank.view(np.int64))], ["doc_id", "at", "rank"])

    now, width = cut(docs.select("doc_id", "text").mapInArrow(seeds, "doc_id bigint, at int, rank bigint"), "doubling"), FIRST
    while True:
        crowded = now.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank")
        now = cut(now.join(crowded, "rank", "left_semi"), "doubling")
        if width == LENGTH:
            return now.select("doc_id", "at")
        later = now.select("doc_id", (F.col("at") - width).alias("at"), F.col("rank").alias("next"))
        now = cut(now.join(later, ["doc_id", "at"]).select("doc_id", "at", F.xxhash64("rank", "next").alias("rank")), "doubling")
        width *= 2


def removed(positions: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_spans: the bytes that the strings at ``positions`` cover, and their maximal runs."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, places in zip(batch.column("doc_id").to_pylist(), batch.column("places").to_pylist()):
                at = np.sort(places)
                gaps = np.diff(at)
                rows.append((doc, int(LENGTH + np.minimum(gaps, LENGTH).sum()), int(1 + (gaps > LENGTH).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_removed", "n_spans"])

    places = positions.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    return places.mapInArrow(cover, "doc_id bigint, n_removed bigint, n_spans bigint")


def main(folder: str) -> None:
    import json
    import tempfile
    import time

    from pyspark.sql import SparkSession

    log = tempfile.mkdtemp(prefix="spark-doubling-")
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}", "spark.eventLog.compress": "false", "spark.sql.shuffle.partitions": "32", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.local.dir": log}
    builder = SparkSession.builder.master("local[8]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(32)
    began = time.time()
    found = removed(repeated_positions(docs)).agg(F.count("*"), F.sum("n_removed")).first()
    took = time.time() - began
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    spark.stop()
    shuffled = cpu = 0
    for path in Path(log).rglob("*"):
        if path.is_file() and ("events" in path.name or path.name.startswith("local-")):
            for line in path.open():
                if '"SparkListenerTaskEnd"' in line:
                    m = json.loads(line).get("Task Metrics") or {}
                    shuffled += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    cpu += m.get("Executor CPU Time", 0) / 1e9
    on_disk = sum(p.stat().st_size for p in [Path(f"{folder}/documents.parquet")] if p.is_file()) or sum(p.stat().st_size for p in Path(f"{folder}/documents.parquet").glob("*.parquet"))
    print(json.dumps({"documents": found[0], "removed": found[1], "text_mb": round(size / 1e6, 1), "parquet_mb": round(on_disk / 1e6, 1), "shuffle_mb": round(shuffled / 1e6, 1), "jvm_cpu_s": round(cpu), "seconds": round(took)}))


if __name__ == "__main__":
    main(sys.argv[1])
