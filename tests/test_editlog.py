"""Edit logs against a plain replay that rewrites a list of paragraphs step by step."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.operators import editlog

PARAS = f"doc_id string, para_idx int, text string, list_level int, part string, nodes {editlog.NODES}"
LOG = "doc_id string, seq int, op string, params map<string,string>, items array<struct<index:int,text:string>>, values map<string,string>"
WS = "[\t-\r    -     　﻿]"


def clean(t):
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", t)


def plain_nodes(text):
    out = []
    for i, line in enumerate(clean(text).split("\n")):
        out += [(None, None)] * (i > 0) + [(line, None)] * (line != "")
    return out


def whole(nodes):
    return "".join("\n" if t is None else t for t, _ in nodes)


def title(t):
    out, word = "", False
    for c in t:
        letter, mark = c.isalpha(), c in "́̈"
        out += c.lower() if letter and word else c.upper() if letter else c
        word = letter or (mark and word)
    return out


def plain(paras, log):
    """paras: list of (level, part, nodes); returns them and (seq, op, n, error) of each edit."""
    paras, told = [list(p) for p in paras], []
    for i, (seq, op, p, items, values) in enumerate(log):
        op, n, error, p = {"split": "splitParagraph", "merge": "mergeParagraph"}.get(op or "replace", op or "replace"), 0, None, p or {}
        inside = [x for x in paras if p.get("scope") != "body" or x[1] == "body"]

        def sub(pattern, new, skip=0, most=None):
            done = seen = 0
            for x in inside:
                for j, (t, style) in enumerate(x[2]):
                    if not t:
                        continue
                    out, at = "", 0
                    for m in re.finditer(pattern, t):
                        seen += 1
                        use = seen > skip and (most is None or done < most)
                        done += use
                        out += t[at : m.start()] + (new if use else m[0])
                        at = m.end()
                    if out + t[at:] != t:
                        x[2][j] = (clean(out + t[at:]), style)
            return done

        def change(f):
            n = 0
            for x in inside:
                t = whole(x[2])
                if t and f(t) != t:
                    x[2], n = plain_nodes(f(t)), n + 1
            return n

        strip = lambda t: re.sub(f"^{WS}+|{WS}+\\Z", "", t)
        if op == "replace":
            last = i == len(log) - 1
            if not p.get("find"):
                error = "empty-find"
            else:
                try:
                    pattern = re.compile(p["find"], re.ASCII) if p.get("regex") == "true" else re.compile(re.escape(p["find"]))
                    n = sub(pattern, p.get("replace", ""), int(p.get("skip", 0)) if last else 0, int(p["max"]) if last and "max" in p else None)
                except re.error:
                    error = "bad-regex"
        elif op == "case":
            n = change({"upper": str.upper, "lower": str.lower}.get(p.get("mode"), title))
        elif op == "trim":
            n = change({"collapse": lambda t: strip(re.sub(f"{WS}+", " ", t)), "hard": lambda t: strip(re.sub("[   ]", " ", t))}.get(p.get("mode"), strip))
        elif op == "affix":
            n = change(lambda t: p.get("prefix", "") + t + p.get("suffix", ""))
        elif op == "placeholderFill":
            for name, v in values.items():
                if v:
                    n += sub(r"\{\{" + WS + "*" + re.escape(name) + WS + r"*\}\}", clean(v))
        elif op == "snippetExpand":
            for name in sorted(values, key=lambda x: (-len(x), x)):
                n += sub("!" + re.escape(name) + "(?![A-Za-z0-9_])", clean(values[name]))
        elif op == "paragraphBatch":
            for at, text in items:
                if 0 <= at < len(paras) and whole(paras[at][2]) != clean(text):
                    paras[at][2], n = plain_nodes(text), n + 1
        else:
            at = int(p["index"])
            if op == "splitParagraph" and 0 <= at < len(paras):
                paras[at][2] = plain_nodes(p["before"])
                paras.insert(at + 1, [*paras[at][:2], plain_nodes(p["after"])])
                n = 1
            elif op == "mergeParagraph" and 0 < at < len(paras):
                paras[at - 1][2], n = plain_nodes(whole(paras[at - 1][2]) + whole(paras[at][2])), 1
                del paras[at]
            elif op == "listLevel" and 0 <= at < len(paras) and (paras[at][0] if paras[at][0] is not None else -1) >= 0:
                new = min(8, max(0, paras[at][0] + int(p["delta"])))
                n, paras[at][0] = int(new != paras[at][0]), new
        told.append((seq, op, n, error))
    return paras, told


def random_edit(r):
    word = lambda: "".join(r.choice(["a", "B", "é", "é", " ", " ", "\n", "!s", "!sn", "{{ x }}", "{{y}}", "$1", "\\", "\x01", "ß"]) for _ in range(r.randrange(0, 6)))
    at, scope = str(r.randrange(-1, 6)), {} if r.random() < 0.5 else {"scope": r.choice(["all", "body"])}
    return r.choice(
        [
            lambda: (r.choice([None, "replace"]), {"find": r.choice(["a", "e", " ", "!s", "", "$"]), "replace": word(), "skip": str(r.randrange(3)), "max": str(r.randrange(3)), **scope}, None, None),
            lambda: ("replace", {"find": r.choice(["[ab]+", "(", "x*", r"\w", "a|B"]), "regex": "true", "replace": word(), **scope}, None, None),
            lambda: ("case", {"mode": r.choice(["upper", "lower", "title"]), **scope}, None, None),
            lambda: ("trim", {"mode": r.choice(["ends", "collapse", "hard"]), **scope}, None, None),
            lambda: ("affix", {"prefix": "<" + word(), "suffix": word(), **scope}, None, None),
            lambda: ("paragraphBatch", {}, [(r.randrange(-1, 6), word()) for _ in range(3)], None),
            lambda: ("placeholderFill", scope, None, {"x": word() + "{{y}}", "y": word(), "a.b": "z", "q": ""}),
            lambda: ("snippetExpand", scope, None, {"s": word(), "sn": word() + "!s", "longer": "x"}),
            lambda: (r.choice(["split", "splitParagraph"]), {"index": at, "before": word(), "after": word()}, None, None),
            lambda: (r.choice(["merge", "mergeParagraph"]), {"index": at}, None, None),
            lambda: ("listLevel", {"index": at, "delta": str(r.choice([-9, -1, 1, 20]))}, None, None),
        ]
    )(), word


def test_random_logs(spark):
    r, docs = random.Random(11), {}
    for d in range(150):
        word = random_edit(r)[1]
        nodes = lambda: [x for i in range(r.randrange(0, 4)) for x in [(None, None)] * (i > 0 and r.random() < 0.3) + [(word() or "t", r.choice([None, "bold"]))]]
        paras = [(r.choice([None, -1, 0, 8]), r.choice(["body", "other"]), nodes()) for _ in range(r.randrange(0, 5))]
        docs[f"d{d}"] = (paras, [(i, *random_edit(r)[0]) for i in range(r.randrange(0, 9))])
    p = spark.createDataFrame([(d, i, whole(x[2]), *x) for d, (paras, _) in docs.items() for i, x in enumerate(paras)], PARAS)
    log = spark.createDataFrame([(d, *e) for d, (_, edits) in docs.items() for e in edits], LOG)
    run = editlog.run_log(p, log).cache()
    got, told = {}, {}
    for x in editlog.edited(run).orderBy("para_idx").collect():
        got.setdefault(x["doc_id"], []).append((x["para_idx"], x["text"], x["list_level"], x["part"], [tuple(n) for n in x["nodes"]], x["n_changes"]))
    for x in editlog.report(run).orderBy("seq").collect():
        told.setdefault(x["doc_id"], []).append(tuple(x)[1:])
    for d, (paras, edits) in docs.items():
        if paras:
            want, report = plain(paras, edits)
            n = sum(e[2] for e in report)
            assert got.get(d, []) == [(i, whole(x[2]), x[0], x[1], x[2], n) for i, x in enumerate(want)], (d, edits)
            assert told.get(d, []) == report
    run.unpersist()


@pytest.mark.parametrize(
    "op, params, items, values, error",
    [
        ("paint", {}, None, None, "unknown-op"),
        ("replace", {}, None, None, "empty-find"),
        ("replace", {"find": "(", "regex": "TRUE"}, None, None, "bad-regex"),
        ("replace", {"find": "(", "regex": "false"}, None, None, None),
        ("replace", {"find": "a", "max": "many"}, None, None, "bad-number"),
        ("affix", {}, None, None, "empty-affix"),
        ("splitParagraph", {"index": "one"}, None, None, "bad-number"),
        ("listLevel", {"index": "0"}, None, None, "bad-number"),
        ("case", {"scope": "page"}, None, None, "bad-scope"),
        ("paragraphBatch", None, None, None, "no-items"),
        ("placeholderFill", {}, None, None, "no-values"),
    ],
)
def test_errors_change_nothing(spark, op, params, items, values, error):
    p = spark.createDataFrame([("a", 0, "a(")], "doc_id string, para_idx int, text string")
    run = editlog.run_log(p, spark.createDataFrame([("a", 0, op, params, items, values), (None, 0, op, params, items, values), ("gone", 0, op, params, items, values)], LOG))
    assert [r["error"] for r in editlog.report(run).collect()] == [error]
    assert [r["text"] for r in editlog.edited(run).collect()] == ["a(" if error else "a"]


def test_dynamic_bodies_and_empty_tables(spark):
    p = spark.createDataFrame([("a", 0, "!d !d"), ("b", 0, None)], "doc_id string, para_idx int, text string")
    log = spark.createDataFrame([("a", 0, "snippetExpand", {}, None, {"d": "on {date}{cursor}"})], LOG)
    run = editlog.run_log(p, log, as_of=datetime(2026, 6, 30, 14, 5), lang="en")
    assert {r["text"] for r in editlog.edited(run).collect()} == {"on Jun 30, 2026 on Jun 30, 2026", ""}
    assert editlog.run_log(p.limit(0), log).count() == 0
    assert editlog.edited(editlog.run_log(p, log.limit(0))).filter(F.col("n_changes") == 0).count() == 2
