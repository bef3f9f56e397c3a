"""Nearest neighbours of vectors whose components and products leave the usual range, against plain sums of doubles."""

import math
import random

from leafmill.llm.nearest import nearest


def plain(rows, k, every):
    ok = [(i, v) for i, v in rows if v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = []
            for i, b in ok:
                if i != q and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    found.append((s == s, -s if s == s else 0.0, i, s))
            out += [(q, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(found)[:k])]
    return sorted(out)


def check(spark, rows, k=3, every=10, tile=8):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, k, every, tile).collect())
    assert str(got) == str(plain(rows, k, every))


def test_large_and_small_components(spark):
    check(spark, [(20, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1.0, 1.0]), (3, [5.0, 1.0])], 2)
    check(spark, [(10, [1.0, 1.0]), (1, [1e200, 2.0]), (2, [1.0, 1.0]), (3, [5.0, 1.0])], 2)
    check(spark, [(10, [1e300, 1e300]), (1, [1e300, -1e300]), (2, [1e300, 1e300]), (3, [-1e300, 0.0]), (4, [1.0, 0.0])], 4)


def test_mixed_magnitudes(spark):
    r = random.Random(2)
    powers = [0, 0, 200, -200, 307, -307, 150, -160, -320]
    rows = [(i, [r.choice([-1, 1]) * r.random() * 10.0 ** r.choice(powers) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [x * 10.0 ** r.choice(powers) for x in (1.0, -0.5, 0.25, 0.0)]) for i in range(40)]
    rows += [(300, [5e-324] * 4), (301, [0.0] * 4), (302, None), (303, [1.0, None, 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (310, [1.0]), (311, [2.0])]
    check(spark, rows)
    check(spark, [(i, [x * 1e-170 for x in v] if v and len(v) == 4 and None not in v else v) for i, v in rows])
