"""Arriving package files: whatever the order and however often the stream starts, the newest versions remain."""

import os
import random

from pyspark.sql import functions as F

from leafmill.sources import docx
from leafmill.streaming import packages


def package(text):
    return docx.new_package([f"<w:r><w:t>{line}</w:t></w:r>" for line in text.split("\n")])


def test_files_end_as_the_batch_does(spark, tmp_path):
    r, newest = random.Random(8), {}
    places = [str(tmp_path / x) for x in ("in", "out", "state")]
    versions = [(f"d{d}.docx", t) for d in range(12) for t in r.sample(range(1000, 1040), 4)]
    r.shuffle(versions)
    for i, (name, t) in enumerate([*versions, *versions[:10]]):  # some arrive twice
        folder = tmp_path / "in" / f"drop{i:03d}"
        folder.mkdir(parents=True)
        (folder / name).write_bytes(package(f"{name} at {t}\nend"))
        (folder / "notes.txt").write_text("no package")
        os.utime(folder / name, (1_700_000_000 + t, 1_700_000_000 + t))
        newest[name] = max(newest.get(name, 0), t)
        if i in (9, 30, len(versions) + 9):  # stop and start again
            stream = packages.measured(packages.newest(packages.arriving_files(spark, places[0], 7), "1 hour"))
            packages.start(stream, places[1], places[2]).awaitTermination()
    told = spark.read.parquet(places[1])
    got = {x["doc_id"]: (x["texts"][0], x["paragraphs"]) for x in packages.latest(told).collect()}
    assert got == {name: (f"{name} at {t}", 2) for name, t in newest.items()}
    assert told.count() == told.select("doc_id", "digest").distinct().count() < len(versions)  # nothing twice, older ones not at all


def rows(spark, tmp_path, name, values):
    some = spark.createDataFrame([(d, t, bytearray(c)) for d, t, c in values], "doc_id string, t bigint, content binary")
    some.select("doc_id", F.timestamp_seconds("t").alias("modified"), "content").coalesce(1).write.parquet(str(tmp_path / "in" / name))


def run(spark, tmp_path, delay="1 hour"):
    stream = spark.readStream.schema("doc_id string, modified timestamp, content binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    packages.start(packages.newest(stream, delay), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    return sorted((x["doc_id"], bytes(x["content"])) for x in packages.latest(out).collect()), out.count()


def test_ties_nulls_and_the_watermark(spark, tmp_path):
    hour = 3600
    rows(spark, tmp_path, "a", [("x", hour, b"1"), ("x", hour, b"2"), (None, hour, b"n"), ("y", 50 * hour, b"y")])
    first, n = run(spark, tmp_path)
    tie = max([b"1", b"2"], key=lambda b: __import__("hashlib").sha256(b).hexdigest())
    assert first == [("x", tie), ("y", b"y")] and n == 2
    # the state of x went when the watermark passed; what is older than the watermark is dropped, what is newer counts
    rows(spark, tmp_path, "b", [("x", 2 * hour, b"late"), ("y", 50 * hour, b"y"), ("z", 178_300, b"z")])
    assert run(spark, tmp_path) == ([("x", tie), ("y", b"y"), ("z", b"z")], 3)
    rows(spark, tmp_path, "c", [("x", 60 * hour, b"new"), ("y", 50 * hour, b"y")])
    got, n = run(spark, tmp_path)
    assert got == [("x", b"new"), ("y", b"y"), ("z", b"z")] and n == 4


def test_documents_of_one_bucket_share_state(spark, tmp_path):
    """the state holds a list a bucket, whatever the number of documents, and forgets what the watermark has passed."""
    hour, newest = 3600, {}
    for name, hours in (("a", [3, 9, 1]), ("b", [40]), ("c", [41, 5])):
        values = [(f"d{d}", h * hour + d, f"{d} {h}".encode()) for h in hours for d in range(40) if (d + h) % 5 or h < 40]
        rows(spark, tmp_path, name, values)
        stream = spark.readStream.schema("doc_id string, modified timestamp, content binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        packages.start(packages.newest(stream, "10 hours", buckets=3), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        for d, t, c in values:
            newest[d] = max(newest.get(d, (0, b"")), (t, c))
        told = spark.read.parquet(str(tmp_path / "out"))
        assert {x["doc_id"]: bytes(x["content"]) for x in packages.latest(told).collect()} == {d: c for d, (t, c) in newest.items()}
        assert told.count() == told.select("doc_id", "digest").distinct().count()
    assert spark.read.format("statestore").option("stateVarName", "told").load(str(tmp_path / "state")).select("key").distinct().count() <= 3


def test_batches_of_the_query_do_not_grow_with_files(spark, sf_dir, tmp_path, monkeypatch):
    from leafmill.plans import source_queries

    monkeypatch.setattr(source_queries, "shared_folder", lambda _: str(tmp_path))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert source_queries.st01_packages(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert 3 <= sum(p.name.isdigit() for p in tmp_path.glob("packages-*/state/commits/*")) <= 6


def test_texts_alone_are_those_of_the_paragraphs(spark):
    numbered = docx.new_package(["<w:r><w:t>n</w:t></w:r>"], {docx.NUMBERING: b"<broken"})
    table = '<w:r><w:t>a</w:t><w:br/><w:t/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p></w:tc></w:tr></w:tbl><w:p>'
    some = spark.createDataFrame([(i, c) for i, c in enumerate([package("x\n\ny"), docx.new_package([table, "<w:pPr/>"]), numbered, b"junk", None])], "doc_id int, content binary")
    full = {x["doc_id"]: [p["text"] for p in x["paras"]] for x in docx.parsed(some).collect()}
    assert {x["doc_id"]: x["texts"] for x in docx.texts(some).collect()} == full and full[1] == ["a\n", "link", "", ""]
