"""Near-duplicates of pages assembled from shared blocks, and the tiles and sketches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import near_dup, tiles


def block_pages(size, blocks=60, taken=48, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(size):
        picked = np.sort(rng.choice(blocks, taken, replace=False))
        rows.append((i, " ".join(f"b{k}w{j}" for k in picked for j in range(25))))
    return rows


def linked(rows):
    """Links of all pairs by their shingle sets."""
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(sets)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                out.add((b, a))
    return out


def components_of(ids, links):
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for b, a in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_block_pages(spark, monkeypatch):
    """No two pages but the planted ones are linked, though all are about 0.6 alike; few pairs ever become rows."""
    rows = block_pages(240)
    rows += [(1000 + i, text.rsplit(" ", 40)[0]) for i, text in rows[::40]]
    counts = []
    confirm = near_dup._confirmed
    monkeypatch.setattr(near_dup, "_confirmed", lambda pairs, sets, name: (counts.append(pairs.count()), confirm(pairs, sets, name))[1])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of([i for i, _ in rows], linked(rows))
    assert sum(counts) <= 6 * len(rows)


def test_sketches_lose_no_link():
    """Sketches of linked sets never differ in more bits than the bound, on each level and across two."""
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 65, 90, 500, 3000, 8192, 9000, 20000, 70000):
        for ratio in (1.0, 0.88, 0.76):
            pool = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
            small = int(np.ceil(n * ratio))
            a, b = pool[:n], pool[:small]
            if ratio == 1.0:  # equal sizes, as far apart as links may be
                apart = n // 7
                b = np.concatenate([pool[apart:n], pool[n : n + apart]])
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 75 * (len(a) + len(b) - both)
            v = max(tiles.level_of(len(a)), tiles.level_of(len(b)))
            x, y = (np.frombuffer(tiles.odd_sketch(s, v), np.uint64) for s in (a, b))
            differ = np.array([np.bitwise_count(x ^ y).sum(dtype=np.int64)])
            assert tiles._within(np.array([len(a) + len(b)]), differ, v, 75).all()
            if tiles.level_of(len(b)) < v:  # the smaller one carries this level too
                assert len(b) * 100 > (64 << tiles.level_of(len(b))) * 75


def test_tiles_meet_every_pair_once(spark, monkeypatch):
    """One very common shingle in blocks of 20: all pairs of different components with one of them ``other``."""
    monkeypatch.setattr(tiles, "BLOCK", 20)
    rows = [(i, 7, i % 3 != 0, 240, 160, i if i % 3 else -1) for i in range(240)] + [(i, 8, True, 15, 15, i) for i in range(15)]
    places = spark.createDataFrame(rows, "doc_id bigint, g bigint, other boolean, held bigint, rest bigint, component bigint")
    places = places.select("*", F.lit(9).alias("n"), F.lit(9).alias("left"), F.lit(0).alias("level"), F.lit(b"12345678").alias("sketch"))
    met = tiles.tiled(places)
    assert met.groupBy("g", "tile_x", "tile_y").count().agg(F.max("count")).first()[0] <= 80
    x, y = met.alias("x"), met.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("g", "tile_x", "tile_y")]
    apart = (F.col("x.tile_x") == F.col("x.tile_y")) | (F.col("x.block") != F.col("y.block"))
    pairs = x.join(y, on).filter((F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & apart)
    got = sorted((r[0], r[1], r[2]) for r in pairs.select("x.g", "x.doc_id", "y.doc_id").collect())
    want = [(7, a, b) for a in range(240) for b in range(a) if a % 3 or b % 3] + [(8, a, b) for a in range(15) for b in range(a)]
    assert got == sorted(want)


def test_batches_cut_tiles_anywhere():
    """The comparison gives the same pairs however the sorted rows are cut into batches."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 150 + i % 40], rng.integers(0, 1 << 63, 10 + i % 30, dtype=np.uint64)])) for i in range(60)]
    col = {
        "g": [i // 20 for i in range(60)], "tile_x": [0] * 60, "tile_y": [0] * 60, "block": [0] * 60, "doc_id": list(range(60)), "component": list(range(60)),
        "n": [len(s) for s in sets], "left": [len(s) for s in sets], "level": [tiles.level_of(len(s)) for s in sets],
        "sketch": [tiles.odd_sketch(s, tiles.level_of(len(s))) + tiles.odd_sketch(s, tiles.level_of(len(s)) + 1) for s in sets],
    }
    whole = pa.RecordBatch.from_pydict(col)
    results = []
    for step in (60, 1, 7, 20, 33):
        out = [b for b in tiles._emit_pairs(75)(iter([whole.slice(a, step) for a in range(0, 60, step)]))]
        results.append(sorted((a, b) for r in out for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist())))
    assert results[0] and all(r == results[0] for r in results)
    for a in range(60):
        for b in range(a // 20 * 20, a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both < 75 * (len(sets[a]) + len(sets[b]) - both) or (a, b) in results[0]
