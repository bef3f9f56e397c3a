"""The manifest, token counts and collocations on small tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import pyarrow as pa
import pytest

from leafmill.llm import collocations, merkle, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, leaf string, n int, k string, tree string, f int, phrase string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns named like those that the operators use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", "z", 2, "w") for r in rows], SCHEMA)


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row, text):
    doc_id, _, lang, source = row
    values = (doc_id, source, lang, len(row[1] or ""), text)
    return hexed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(leaves):
    """Root, and for each leaf the digests left and right of it on every level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append((run[: k % 3], run[k % 3 + 1 :]))
        at = [k // 3 for k in at]
        level = [hexed(*level[j : j + 3]) for j in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    first = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    order = sorted(rows, key=lambda r: (first(r[3]), first(r[0]), digest(r, r[1])))
    groups = [list(g) for _, g in groupby(order, key=lambda r: r[3])]
    trees = [grown([digest(r, r[1]) for r in g]) for g in groups]
    root, tops = grown([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(g, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = digest(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            for left, right in path + top:
                now = hexed(*left, now, *right)
            proof = hexed(*(h for left, right in path + top for h in left + right))
            out.append((r[0], digest(r, r[1]), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


LINES = ["a\nb", "", None, "no feed", "ünï\n\n", "x" * 300_000 + "\n"]


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_manifest(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rows = [(i, LINES[i % 6], [None, "en"][i % 2], "hot") for i in range(41)]
    rows += [(100 + i, LINES[i % 5], "de", s) for i, s in enumerate([None, None, "a", "ß", "b", "b", "b", "b"])]
    rows += [(7, "again", "en", "hot"), (7, "a\nb", "en", "hot"), (7, "a\nb", "en", "hot"), (None, "a\nb", None, "hot"), (None, None, None, None)]
    got = merkle.manifest(documents(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {True, False} == {r[-1] for r in want}


def test_manifest_small(spark):
    lone = [(5, "a\nb", "en", "s")]
    assert [tuple(r) for r in merkle.manifest(documents(spark, lone)).collect()] == plain_manifest(lone)
    assert merkle.manifest(documents(spark, [])).collect() == []


def test_manifest_of_other_changes(spark):
    from pyspark.sql import functions as F

    rows = [(i, "text", "en", "s") for i in range(9)]
    got = merkle.manifest(documents(spark, rows), F.when(F.col("doc_id") == 4, F.lit("else")).otherwise(F.col("text"))).collect()
    assert sorted(r["doc_id"] for r in got if not r["verified"]) == [4]


def test_range_places(spark):
    """Many partitions share a source, many sources a partition."""
    from pyspark.sql import functions as F

    rows = [(i, "t", "en", f"s{i % 30:02d}" if i % 2 else "hot") for i in range(600)]
    leaves = documents(spark, rows).select("doc_id", "source", F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("leaf"), F.lit(None).cast("binary").alias("start"))
    want, trees = [], sorted({r[3] for r in rows})
    for t, s in enumerate(trees):
        ids = sorted(r[0] for r in rows if r[3] == s)
        want += [(t, p, len(ids), d) for p, d in enumerate(ids)]
    assert sorted(map(tuple, merkle.placed(leaves).select("tree", "pos", "n", "doc_id").collect())) == sorted(want)


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(None)


def test_token_counts_of_the_table(spark, sf_dir, counter):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = token_counts.op12_token_counts(spark, sf_dir).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(counter.model.encode(texts[r["doc_id"]]))
        assert tuple(r) == (r["doc_id"], len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_token_counts_cases(spark, counter):
    texts = [None, "", " ", "  ", "x ", " x", "▁", "▁ y", "a▁▁ b", "<s> </s><unk>", "\n\n a", "a" * 5000, "漢字" * 3000, "word " * 900_000, "x" * 3000 + " y"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(1, "again", None, None), (1, "again", None, None), (None, "no id", None, None)]
    want = sorted(((r[0], len((r[1] or "").encode()), len(counter.model.encode(r[1] or ""))) for r in rows), key=str)
    for piece in (1, 7, 1024):
        got = token_counts.token_counts(documents(spark, rows), batch_bytes=64, piece=piece)
        assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == want
    assert token_counts.token_counts(documents(spark, [])).collect() == []


def test_split_texts_keep_their_counts(counter):
    from leafmill.llm.common import buffers

    r = random.Random(3)
    letters = " \n▁a bé漢字<s></s>_\t\x00é́😀qXz.,  "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 200))) for _ in range(1500)]
    want = [len(x) for x in counter.model.encode(texts)]
    for piece in (1, 2, 5, 1000):
        assert counter.lengths(*buffers(pa.array(texts)), piece).tolist() == want


def plain_collocations(rows, least, covered, top):
    f, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    k = (lang, tuple(ws[i : i + m]))
                    f[k] = f.get(k, 0) + 1
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = (lang, w[i : i + m])
                longer[k] = max(longer.get(k, 0), a)
    out = {}
    for (lang, w), a in often.items():
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        if 100 * longer.get((lang, w), 0) < covered * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, w.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, w, x, y) in enumerate(sorted(found)[:top]))


def random_texts(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "a", "of", "xé", "ÉX", "漢", "\x01b", "a\x01", "-", "b"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", ";", "\r\n", " ! ", "\x0b"]
    rows = [(i, "".join(r.choice(words) + r.choice(ends[: r.choice([3, 10])]) for _ in range(r.randrange(0, 60))), r.choice(["en", "de", None, "und", "x y\n"]), None) for i in range(n)]
    return [*rows, (None, None, "en", None), (1, "", "de", None), (1, "the a of the a of", "de", None), (1, "the a of the a of", "de", None), (2, "a b " * 20_000, "long", None)]


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7)])
def test_collocations(spark, least, top):
    rows = random_texts(300, least)
    got = collocations.collocations(documents(spark, rows), least, 80, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, 80, top)
    assert collocations.collocations(documents(spark, [])).collect() == []


@pytest.mark.parametrize("known", [[], [b"en", b"a", b"bb"]])
def test_runs_go_on_over_batches(known, monkeypatch):
    """However the sorted stream is cut into partitions and batches, and whatever is coded, the sums agree."""
    monkeypatch.setattr(collocations, "SHORT", 2)
    book, r = collocations.Book(known), random.Random(5)
    coded = lambda ws: b"".join(book.tokens(pa.array([w.encode() for w in ws], pa.large_binary())))
    rows = Counter(tuple(["en", *(r.choice("ab") * r.randrange(1, 3) for _ in range(r.randrange(1, 5)))]) for _ in range(500))
    want = Counter()
    for ws, c in rows.items():
        for d in range(len(ws)):
            want["".join(w + " " for w in ws[: d + 1]), d] += c
    want = {k: c for k, c in want.items() if k[1] == 0 or c >= 30}
    rows = {coded(ws): c for ws, c in rows.items()}
    keys = sorted(rows)
    for _ in range(20):
        cuts = sorted(r.sample(range(1, len(keys)), 12))
        got, own = Counter(), collocations.Runs(5, 30)
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
            own.add(pa.table({"k": pa.array(keys[a:b], pa.binary()), "c": pa.array([rows[k] for k in keys[a:b]], pa.int64())}))
            if i % 4 == 3 or b == len(keys):
                for d in own.depths:
                    own.close(d, last=True)
                for x in own.take(book).to_pylist():
                    got[x["k"], x["d"]] += x["c"]
                own = collocations.Runs(5, 30)
        assert {k: c for k, c in got.items() if k[1] == 0 or c >= 30} == want
