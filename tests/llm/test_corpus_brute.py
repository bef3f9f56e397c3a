"""The learned operators against plain versions: loops over words and bytes, sets of n-grams, the full ridge formula."""

import math
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import boosting, common, language, quality, repeats, toxicity
from leafmill.llm.common import buffers, crc_mod

TEXTS = [
    "",
    "One plain line.",
    "You IDIOT! you stupid st00pid 1diot, are you? NO WAY",
    "soooo i-d-i-o-t i.d.i.o.t\nyour  tail!!\n\nyour  tail!!",
    "été à la plage; größe 12 345 | a | b * # c",
    "a b c d e f g h a b c d e f g h i",
    "B",
    "!dot",
    " ".join(f"averyveryverylongword{i}" for i in range(40)) + " you idiot",
]


def batch(texts):
    import pyarrow as pa

    return buffers(pa.array(texts, pa.string()))


# --- language ---------------------------------------------------------------------------------------------------


def symbols(text):
    out = [0]
    for c in text:
        v = 0
        if language.unicodedata.category(c)[0] == "L":
            v = ord(c.lower()) if len(c.lower()) == 1 else ord(c)
        if v or out[-1]:
            out.append(v)
    return [*out, 0] if out[-1] else out


def name(gram):
    """splitmix64's finaliser of the letters at 21 bits each, by whole numbers."""
    h = len(gram) % 3
    for v in gram:
        h = h << 21 | v
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> shift) * factor % 2**64
    return (h ^ h >> 31) >> 64 - language.BITS


def grams(text):
    s = symbols(text)
    return {name(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_languages_of_rare_scripts(spark):
    """Twenty invented languages of four scripts beside each other; each is told from the others of its script."""
    rng = np.random.default_rng(11)
    scripts = {"latin": (0x61, 26, 8), "cyrillic": (0x430, 32, 6), "greek": (0x3B1, 17, 4), "georgian": (0x10D0, 33, 2)}
    rows = []
    for script, (first, n, languages) in scripts.items():
        for k in range(languages):
            words = ["".join(chr(first + c) for c in rng.integers(0, n, rng.integers(3, 9))) for _ in range(200)]
            rows += [(len(rows) + i, " ".join(rng.choice(words, 40)), f"{script}{k}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, F.col("doc_id") % 2 == 0).collect()}
    for lang in {r[2] for r in rows}:
        held = [got[i] == lang for i, _, a in rows if a == lang and i % 2]
        assert sum(held) >= 0.97 * len(held), lang


def test_language_is_the_ridge_formula(spark):
    """Kernel by intersecting sets of n-grams, weights by the normal equations of ridge regression on the landmarks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    train = crc_mod("doc_id", 4) != 2
    sample = sorted(language.sample(docs, train).collect(), key=lambda r: (r["lang"], r["h"]))
    sets = [grams(r["text"]) for r in sample]
    langs = sorted({r["lang"] for r in sample})
    marks = [i for a in langs for i in [i for i, r in enumerate(sample) if r["lang"] == a][: language.LANDMARKS]]

    def kernel(rows):
        return np.array([[len(x & sets[m]) / math.sqrt(len(x) * len(sets[m])) for m in marks] for x in rows])

    k = kernel(sets)
    y = np.array([[float(r["lang"] == a) for a in langs] for r in sample])
    weights = np.linalg.solve(k.T @ k + language.RIDGE * len(sample) * (k[marks] + 1e-8 * np.eye(len(marks))), k.T @ y)
    rows = [r for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    want = np.clip(kernel([grams(r["text"]) for r in rows]) @ weights, 0, 1)
    got = {r["doc_id"]: r for r in language.identify(docs, train).collect()}
    for r, s in zip(rows, want):
        assert abs(got[r["doc_id"]]["score"] - s.max()) < 1e-4
        assert s[langs.index(got[r["doc_id"]]["lang_pred"])] > s.max() - 1e-4


# --- toxicity ---------------------------------------------------------------------------------------------------

LEXICON = {"idiot": 2.0, "stup*": 1.5}


def weight(word):
    return max(LEXICON.get(word, 0), LEXICON.get(word[:4] + "*", 0) if len(word.encode()) > 4 else 0)


def alpha(b):
    return chr(b).isascii() and chr(b).isalpha() or b >= 128


def spans(raw, inside):
    out, at = [], None
    for i, b in enumerate([*raw, 32]):
        if i < len(raw) and inside(b):
            at = i if at is None else at
        elif at is not None:
            out.append((at, i))
            at = None
    return out


def toxic_features(text):
    raw = text.encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    digit, upper = (lambda b: 48 <= b <= 57), (lambda b: 65 <= b <= 90)
    mark = lambda b: 32 < b < 127 and not alpha(b) and not digit(b)
    words = spans(raw, lambda b: alpha(b) or digit(b))
    spelled = [low[s:e].decode(errors="replace") for s, e in words]
    hits = [i for i, w in enumerate(spelled) if weight(w)]
    you = [i for i, w in enumerate(spelled) if w in toxicity.SECOND_PERSON]
    near = [i for i in hits if any(abs(i - j) <= 5 for j in you)]
    leet = {ord(a): ord(b) for a, b in zip("013457@$!|", "oieastasii")}
    undo = bytes(leet.get(b, b) for b in low)
    masked = [(s, e) for s, e in spans(raw, lambda b: alpha(b) or b in leet) if any(digit(b) or mark(b) for b in raw[s:e]) and weight(undo[s:e].decode(errors="replace"))]
    inner = sum(alpha(raw[i - 1]) and alpha(raw[i + 1]) and not alpha(raw[i]) and raw[i] not in b" \t\n\x0b\x0c\r'-" for i in range(1, len(raw) - 1))
    stretched = sum(alpha(raw[i]) and low[i] == low[i - 1] == low[i - 2] for i in range(2, len(raw)))
    loud = sum(e - s > 1 and all(map(upper, raw[s:e])) for s, e in words)
    n, chars = max(1, len(words)), max(1, sum(c not in " \t\n\x0b\x0c\r" for c in text))
    total = sum(weight(w) for w in spelled)
    return [
        len(hits) / n, len(hits), len({spelled[i] for i in hits}), total / n, total, len(near) / n, len(near) / max(1, len(hits)), len(you) / n, len(masked) / n,
        inner / n, stretched / n, sum(map(upper, raw)) / chars, loud / n, raw.count(b"!") / n, raw.count(b"?") / n, sum(map(mark, raw)) / chars, sum(map(digit, raw)) / chars, math.log1p(len(words)),
    ]


def test_toxic_features_by_loops():
    got = toxicity.features(*batch(TEXTS), toxicity.Lexicon(list(LEXICON), list(LEXICON.values())))
    assert np.allclose(got, [toxic_features(t) for t in TEXTS], atol=1e-12)


def test_first_tree_by_loops():
    """Every split of the first tree is the best of all, its leaves are Newton steps, and margins follow the nodes."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (150, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 4) | (rng.random(150) < 0.1)).astype(float)
    b = boosting.Boosted(trees=1, depth=2, bins=16).fit(x, y)
    p = y.mean()

    def gain(rows, j, edge):
        def part(r):
            return sum(y[i] - p for i in r) ** 2 / (len(r) * p * (1 - p) + b.smooth)

        left = [i for i in rows if x[i, j] <= edge]
        return part(left) + part([i for i in rows if x[i, j] > edge]) - part(rows)

    node = {0: list(range(150))}
    for k in range(3):
        j = int(b.feature[0, k])
        edges = [list(e) for e in b.edges]
        cut = b.cut[0, k]
        best = max([1e-9, *(gain(node[k], f, e) for f in range(3) for e in edges[f])])
        chosen = gain(node[k], j, edges[j][cut]) if cut < len(edges[j]) else 0.0
        assert chosen >= best - 1e-9 or best == 1e-9
        right = [i for i in node[k] if cut < len(edges[j]) and x[i, j] > edges[j][cut]]
        node[2 * k + 2] = right
        node[2 * k + 1] = [i for i in node[k] if i not in set(right)]
    margin = b.margin(x)
    for leaf in range(3, 7):
        step = b.rate * sum(y[i] - p for i in node[leaf]) / (len(node[leaf]) * p * (1 - p) + b.smooth)
        assert all(abs(margin[i] - b.start - step) < 1e-9 for i in node[leaf])


def test_isotonic_by_minima_of_maxima():
    rng = np.random.default_rng(4)
    x, y = rng.random(60), (rng.random(60) < 0.4).astype(float)
    places, values = boosting.isotonic(x, y)
    s = y[np.argsort(x)]
    want = [max(min(s[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert (np.diff(places) > 0).all() and (np.diff(values) >= 0).all()
    assert sorted({round(v, 9) for v in want}) == sorted({round(v, 9) for v in values})


# --- quality ----------------------------------------------------------------------------------------------------


def quality_features(text):
    raw, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    seen, again = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n, chars, low = max(1, len(words)), max(1, sum(map(len, words))), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(c in "#*$%&|<>" for c in text) / n, sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / n,
        sum("A" <= c <= "Z" for c in text) / chars, again / len(lines), len(covered) / n, len(set(low)) / math.sqrt(n), sum("0" <= c <= "9" for c in text) / chars,
        sum(c in ".!?" for c in text) / n, text.count("|") / n, text.count("!") / n, n / len(lines), sum(len(w.encode()) == 1 for w in words) / n, sum(len(w.encode()) > 14 for w in words) / n, sum(b >= 128 for b in raw) / chars,
    ]


def test_quality_features_by_loops():
    assert np.allclose(quality.features(*batch(TEXTS)), [quality_features(t) for t in TEXTS], atol=1e-12)


def test_quality_weights_minimise_the_pairs_loss(monkeypatch):
    """Where the loss is least its gradient, added up pair by pair, vanishes; and no other quantile parts better."""
    monkeypatch.setattr(quality, "PAIRS", 2000)
    rng = np.random.default_rng(6)
    y = (rng.random(200) < 0.5).astype(float)
    x = rng.normal(size=(200, 3)) + y[:, None] * [1.0, 0.3, 0.0]
    model = quality.rank(x, y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    a, b = draw.choice(good, 2000), draw.choice(bad, 2000)
    steps = [[float(x[i, j] > e) for j in range(3) for e in model.edges[j]] for i in range(200)]
    gradient = [-20.0 * w for w in model.weights]
    for i, j in zip(a, b):
        difference = [p - q for p, q in zip(steps[i], steps[j])]
        p = 1 / (1 + math.exp(-sum(w * d for w, d in zip(model.weights, difference))))
        gradient = [g + (1 - p) * d for g, d in zip(gradient, difference)]
    assert max(map(abs, gradient)) < 1e-3
    strength = model.strength(x)

    def parted(cut):
        return (strength[good] >= cut).mean() + (strength[bad] < cut).mean()

    assert parted(model.cut) >= max(parted(q) for q in np.quantile(strength, np.linspace(0, 1, 401)[1:-1], method="lower")) - 0.01


@pytest.mark.parametrize("part", [toxicity, quality])
def test_equal_texts_score_alike(part, spark):
    """Values on the awkward rows: empty texts share one score, so do ties and repeated rows."""
    docs = cases.awkward(spark)
    model = part.fit(docs, cases.labels(spark), F.lit(True))
    by = {}
    for r, t in zip(sorted(toxicity.score_texts(docs, model).collect(), key=lambda r: r["doc_id"] or 0), sorted(cases.ROWS, key=lambda r: r[0] or 0)):
        by.setdefault(t[1] or "", set()).add(round(r["score"], 12))
    assert all(len(s) == 1 for s in by.values())
    assert by["tie"] and len(by) == len({t[1] or "" for t in cases.ROWS})


def test_fingerprints_of_a_text_longer_than_a_turn(monkeypatch):
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 4, 5000).astype(np.uint8)
    start = rng.integers(0, 5001, 900)
    end = np.minimum(start + rng.choice([0, 1, 40, 400, 3000], 900), 5000)
    whole = common.spans_hash(common.prefix_sums(buf), start, end)
    for turn in (64, 100, 1000, 4999, 5000):
        monkeypatch.setattr(common, "TURN", turn)
        assert (common.spans_hash(common.prefix_sums(buf), start, end) == whole).all()
    raw = buf.tobytes()
    texts = [raw[a:b] for a, b in zip(start, end)]
    assert len(set(whole.tolist())) == len(set(texts)) == len(set(zip(whole.tolist(), texts)))


@pytest.mark.parametrize("n", [400, 401, 800, 4000])
def test_anchors_do_not_depend_on_slices(n):
    sums = common.prefix_sums(np.random.default_rng(n).integers(0, 3, n).astype(np.uint8))
    whole = repeats.anchors(sums)
    # every window has exactly one anchor
    where, low, high, _ = whole
    assert sorted(s for w, a, b in zip(where, low, high) for s in range(w - b, w - a + 1)) == list(range(n - 399))
    for most in (1, 7, 100, 399, n - 399):
        assert all((a == b).all() for a, b in zip(repeats.anchors(sums, most=most), whole))
