"""The data source of packages: round trips, pruning, commits, killed tasks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.sources import docx, docx_format


@pytest.fixture(scope="module")
def session(spark):
    docx_format.register(spark)
    return spark


def package(text, **extra):
    return docx.new_package([f"<w:r><w:t>{line}</w:t></w:r>" for line in text.split("\n")], extra)


def packages(spark, texts, parts=3):
    rows = [(k, None if v is None else bytearray(v if isinstance(v, bytes) else package(v))) for k, v in texts]
    return spark.createDataFrame(rows, "name string, content binary").repartition(parts)


def visible(folder):
    return sorted(f for _, _, files in os.walk(folder) for f in files)


def texts(spark, folder, **options):
    got = spark.read.format("docx").options(**options).load(str(folder)).orderBy("path", "para_idx")
    return sorted((r["name"], r["para_idx"], r["text"], r["error"]) for r in got.collect())


def test_round_trip(session, tmp_path):
    want = {f"d{i}.docx": f"one {i}\ntwo" for i in range(40)}
    place = str(tmp_path / "out")
    made = {k: package(v) for k, v in want.items()}
    packages(session, made.items()).withColumn("more", F.lit(1)).write.format("docx").mode("append").save(place)
    assert texts(session, place) == sorted((k, i, t, None) for k, v in want.items() for i, t in enumerate(v.split("\n")))
    files = session.read.format("docx").option("rows", "files").load("file://" + place)
    assert {r["name"]: bytes(r["content"]) for r in files.collect()} == made
    assert all(r["size"] == len(r["content"]) for r in files.collect())
    nodes = session.read.format("docx").option("rows", "nodes").load(place).filter("name = 'd3.docx'")
    assert [(r["node_idx"], r["para_idx"], r["text"]) for r in nodes.orderBy("node_idx").collect()] == [(0, 0, "one 3"), (1, 1, "two")]


def test_append_overwrite_and_repeated_names(session, tmp_path):
    place = str(tmp_path)
    for mode, rows in (("append", [("a.docx", "1"), ("a.docx", "2")]), ("append", [("a.docx", "3")])):
        packages(session, rows, 1).write.format("docx").mode(mode).save(place)
    assert [t for _, _, t, _ in texts(session, place)] == ["1", "2", "3"]
    packages(session, [("b.docx", "4")]).write.format("docx").mode("overwrite").save(place)
    assert texts(session, place) == [("b.docx", 0, "4", None)] and visible(place) == ["b.docx"]
    packages(session, []).write.format("docx").mode("overwrite").save(place)
    assert texts(session, place) == [] and visible(place) == []


@pytest.mark.parametrize("bad", [("../x.docx", "t"), ("a/b.docx", "t"), (None, "t"), ("x.txt", "t"), ("_x.docx", "t"), ("x.docx", None)])
def test_a_failed_job_leaves_nothing(session, tmp_path, bad):
    packages(session, [("old.docx", "kept")]).write.format("docx").mode("append").save(str(tmp_path))
    rows = packages(session, [(f"n{i}.docx", "new") for i in range(50)] + [bad], 4)
    with pytest.raises(Exception, match="no name and content"):
        rows.write.format("docx").mode("overwrite").save(str(tmp_path))
    assert visible(tmp_path) == ["old.docx"] and not [x for x in os.listdir(tmp_path) if x.startswith("_")]


def test_lost_and_repeated_tasks_leave_no_file(session, tmp_path):
    """Attempts that the job doesn't count: one that ended unheard, one cut off in the middle, one still at work."""
    import pyarrow as pa

    writer = docx_format.Writer(str(tmp_path), False)
    batch = lambda *names: pa.record_batch([pa.array(names), pa.array([b"x"] * len(names), pa.binary())], ["name", "content"])
    writer.begin()
    writer.write(iter([batch("a.docx", "b.docx")]))

    def torn():
        yield batch("a.docx")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(torn())
    assert docx_format.listed(str(tmp_path)) == []
    good = [writer.write(iter([batch("a.docx", "b.docx")])), writer.write(iter([])), None]
    writer.commit(good)
    assert visible(tmp_path) == ["a.docx", "b.docx"] and len(docx_format.listed(str(tmp_path))) == 2
    with pytest.raises(OSError):  # it outlives the job
        writer.write(iter([batch("late.docx")]))
    assert visible(tmp_path) == ["a.docx", "b.docx"]


def test_errors_are_rows(session, tmp_path):
    import io
    import zipfile

    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.xml", "<x/>")
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr(docx.PART, "<a><b></a>")
    for name, data in {"junk.docx": b"no zip", "torn.docx": package("t")[:-30], "empty.docx": empty.getvalue(), "bad.DOCX": bad.getvalue(), "none.docx": b"", "good.docx": package("t"), "note.txt": b"n", ".hidden.docx": package("h")}.items():
        (tmp_path / name).write_bytes(data)
    got = {n: (t, e) for n, _, t, e in texts(session, tmp_path)}
    assert got == {"junk.docx": (None, "not-a-package"), "torn.docx": (None, "not-a-package"), "empty.docx": (None, "no-document-part"), "bad.DOCX": (None, "bad-xml"), "none.docx": (None, "not-a-package"), "good.docx": ("t", None)}


def test_plans_by_size_and_conditions(session, tmp_path):
    files = [docx_format.Found(f"/x/{i}.docx", s, None) for i, s in enumerate([5, 100, 40, 30, 20, 5])]
    assert [[f.size for f in p.files] for p in docx_format.planned(files, 64, 2)] == [[100], [40], [30, 20, 5], [5]]
    packages(session, [(f"d{i}.docx", "t " * i * 50) for i in range(30)]).write.format("docx").mode("append").save(str(tmp_path))
    read = session.read.format("docx").option("openBytes", 1 << 20).option("partitionBytes", 4 << 20).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 10
    some = read.filter("name in ('d3.docx', 'd4.docx', 'zz.docx') and para_idx = 0")
    assert some.rdd.getNumPartitions() == 1 and sorted(r["name"] for r in some.collect()) == ["d3.docx", "d4.docx"]
    assert {r["name"] for r in read.filter("name like 'd1%' and text is not null").collect()} == {f"d{i}.docx" for i in (1, *range(10, 20))}
    assert read.filter("size < 10").count() == 0
    most = read.filter(~F.col("name").endswith("7.docx") & (F.col("name") != "d1.docx"))
    assert most.rdd.getNumPartitions() == 9 and {r["name"] for r in most.collect()} == {f"d{i}.docx" for i in range(30) if i not in (1, 7, 17, 27)}


def test_only_the_needed_entry_is_read(tmp_path):
    """A picture of a megabyte between directory and document part is passed over."""
    import random

    picture = random.Random(1).randbytes(1 << 20)
    (tmp_path / "a.docx").write_bytes(package("t", **{"word/media/a.png": picture}))

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n=-1):
            got = self.f.read(n)
            self.n += len(got)
            return got

        def __getattr__(self, name):
            return getattr(self.f, name)

    with open(tmp_path / "a.docx", "rb") as f:
        counting = Counting(f)
        assert docx_format._package_rows(counting, "paragraphs")[0]["text"] == "t" and counting.n < 100_000


def test_streams_read_each_commit_once(session, tmp_path):
    place, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = session.readStream.format("docx").load(place).select("name", "text")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in session.read.parquet(out).collect())

    os.makedirs(place)
    want = []
    for i in range(3):  # each start finds one or two more commits
        for k in range(1 + i % 2):
            packages(session, [(f"{i}{k}{j}.docx", f"{i} {k} {j}") for j in range(5)]).write.format("docx").mode("append").save(place)
            want += [(f"{i}{k}{j}.docx", f"{i} {k} {j}") for j in range(5)]
        assert run() == sorted(want)
    assert run() == sorted(want)


def many(folder, jobs=2, tasks=2, each=1300):
    """Files as jobs of several tasks write them."""
    import pyarrow as pa

    for j in range(jobs):
        writer = docx_format.Writer(str(folder), False)
        writer.begin()
        names = lambda t: [f"d{j}-{t}-{i}.docx" for i in range(each)]  # noqa: E731, B023
        writer.commit([writer.write(iter([pa.record_batch([pa.array(names(t)), pa.array([b"x" * (i % 7) for i in range(each)], pa.binary())], ["name", "content"])])) for t in range(tasks)])


def test_a_plan_names_folders_not_files(tmp_path):
    """what the driver keeps and sends grows with tasks, not with files, and all files are read, each once."""
    import pickle

    many(tmp_path / "in")
    place = str(tmp_path / "in")
    assert max(len(files) for _, _, files in os.walk(place)) == 512
    every = sorted(docx_format.listed(place), key=lambda f: f.path)
    assert len(every) == 5200 == len({f.name for f in every})
    for opening, tests in ((1 << 20, []), (1 << 17, []), (1 << 10, [lambda f: not f.name.endswith("7.docx"), lambda f: f.size > 2])):
        reader = docx_format.Reader(place, "files", 128 << 20, opening)
        reader.tests = tests
        parts = reader.partitions()
        wanted = [f for f in every if all(t(f) for t in tests)]
        assert len(pickle.dumps(parts)) < 8 * len(every) and not any(p.files for p in parts)
        assert all(sum(s.n for s in p.spans) * opening <= 128 << 20 for p in parts)
        assert sorted((r[0], r[2], r[5]) for p in parts for r in reader.read(p)) == sorted((f.path, f.size, b"x" * f.size) for f in wanted)


def test_large_folders_of_others_and_lost_files(tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}.docx").write_bytes(b"x")
    (tmp_path / "few").mkdir()
    for i in range(5):
        (tmp_path / "few" / f"{i}.docx").write_bytes(b"y")
    reader = docx_format.Reader(str(tmp_path), "files", 100, 9)
    parts = reader.partitions()
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(f.path for f in docx_format.listed(str(tmp_path))) and len(docx_format.listed(str(tmp_path))) == 1505
    (tmp_path / "few" / "3.docx").unlink()
    with pytest.raises(FileNotFoundError, match="had 5 packages"):
        [r for p in parts for r in reader.read(p)]
