"""The snippet store against a plain dictionary, with compactions and half-written sets between."""

import random

from leafmill.operators import templates
from leafmill.sources import snippet_store as store

SNIPPETS = "name string, body string, updated_at bigint"


def test_random_histories(spark, tmp_path):
    r = random.Random(6)
    place, rows = str(tmp_path / "library"), []
    assert store.load(spark, place).count() == 0 and store.compact(spark, place) == 0
    for step in range(8):
        t = lambda: r.choice([None, *range(5)])
        names = [r.choice(["a", "b-1", "c_2", "!d"]) for _ in range(3)]
        if r.random() < 0.4:
            gone = [(n, t()) for n in names]
            store.remove(spark.createDataFrame(gone, "name string, updated_at bigint"), place)
            rows += [(n.lstrip("!"), u, True, None) for n, u in gone]
        else:
            new = [(n, f"body {step}{r.randrange(3)}", t()) for n in names]
            store.put(spark.createDataFrame([*new, ("1 bad", "x", 9), ("e", " ", 9)], SNIPPETS), place)
            rows += [(n.lstrip("!"), u, False, b) for n, b, u in new]
        if step % 3 == 2:
            assert store.compact(spark, place) >= 2 and len(store.change_sets(spark, place)) == 1
        want = {}
        for n, u, gone, body in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), not x[2], x[3] or "")):
            want.setdefault(n, None if gone else (n, body, u))
        assert sorted(map(tuple, store.load(spark, place).collect())) == sorted(v for v in want.values() if v)


def test_dead_writers_and_dead_compactions(spark, tmp_path):
    place = str(tmp_path / "library")
    store.put(spark.createDataFrame([("a", "one", 1), ("b", "two", 1)], SNIPPETS), place)
    (tmp_path / "library" / "set-torn").mkdir()
    (tmp_path / "library" / "set-torn" / "part-0.parquet").write_bytes(b"half")
    store.remove(spark.createDataFrame([("b", 2)], "name string, updated_at bigint"), place)
    # a compaction that dies before it removes anything leaves its rows twice, which changes nothing
    store._add(store.newest(store._rows(spark, store.change_sets(spark, place))), place)
    assert [tuple(x) for x in store.load(spark, place).collect()] == [("a", "one", 1)]
    assert store.compact(spark, place, forget_before=3) == 3
    assert spark.read.parquet(store.change_sets(spark, place)[0]).count() == 1


def test_json_round_trip(spark):
    rows = [(1, "b", 'q"\n', 2), (1, "a", "x", None), (2, "c", "y", 3)]
    library = spark.createDataFrame(rows, "owner int, " + SNIPPETS)
    lists = store.json_lists(library, "owner")
    assert lists.filter("owner = 2").first()["json"] == '[{"name":"c","body":"y","updatedAt":3}]'
    assert sorted(map(tuple, templates.read_library(lists).collect()), key=str) == sorted((r[1:] for r in rows), key=str)
