"""MinHash near-duplicates with tensored banding.

Words are lower-cased (A-Z), shingles are five words. Documents with equal shingle sets are one class from the start;
everything below runs on one document of each class. Two collections of ``HALVES`` half-keys of ``ROWS`` minhashes each
(2 * 12 * 2 = 48 minhashes) stand for 144 tables: the key of table (i, j) joins half-key i of the first collection with
half-key j of the second. A pair of similarity 0.75 shares a table with probability (1 - (1 - 0.75^2)^12)^2 > 0.9999.
Half-keys that nobody shares are dropped before the pairs are formed, so most documents make no key at all.

In a bucket every document is paired with the bucket's hub, its first member by a hash of the ids, never all with all.
So the documents of a large group share a few hubs over all tables. Four bits of each minhash travel along: of 48, a
pair of similarity 0.75 has 36.8 alike on average (deviation 2.9), and a pair with fewer than ``ALIKE`` is not tried
with its hub. Pairs are confirmed on the full shingle sets. First each document's most frequent hub is tried, which
settles groups of copies of any size; then only pairs that still join two components. These steps are linear in the
number of bucket rows, but leave pairs of which neither is a hub and those that ``ALIKE`` kept out. So the documents of
buckets that still hold several components, and only they, are joined exactly (:func:`rare_places`, :func:`leafmill.llm.tiles.tile_pairs`): a pair that shares a
bucket is in one component or is found there, in groups of any size. Components come from alternating large-star and
small-star steps.

The exact join orders shingles from rare to frequent, those that a single component holds before all others, as no link
rests on them. The first shingle that two linked documents share leaves each at least the overlap that their sizes ask
for, so it lies in the first quarter of the larger one and in the first seventh of the smaller one. Documents of a
template differ by more than that, so the template's own shingles are in no such seventh and form no pair. Shingles that
the very same documents hold count as one. Where more than ``CROWD`` documents hold a shingle, each first meets ``DRAWS``
documents of the component with most of them, which joins fragments of large groups by pairs linear in the rows. What is left is compared inside tasks, block by
block, on sketches of the sets; only pairs that a sketch can't exclude become rows and are confirmed.

Defined cases: documents without words have an empty set, are linked with nothing and kept; a null ``doc_id`` takes no
part (component null, kept); repeated rows are one document, and so are repeated ids, whose set is the larger one's;
of equal documents the smallest id is kept; texts are read whole, one that is longer than a run in a run of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import LOWER, buffers, cut, mix, prefix_sums, runs, spans_hash, table, windows_hash, word_spans
from leafmill.llm.tiles import possible_pairs, sketches, tile_pairs

SHINGLE, HALVES, ROWS = 5, 12, 2
NEED = 75  # percent
ALIKE, CROWD, DRAWS = 24, 16, 8

SETS = "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, halves array<bigint>, s0 bigint, s1 bigint, s2 bigint"


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents, sorted by document, and the offsets of each document's."""
    low = LOWER[buf]
    start, end, doc = word_spans(low, off)
    words = spans_hash(prefix_sums(low), start, end)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    inside = np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :])
    h, d = windows_hash(words, size)[inside], doc[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = [windows_hash(words[a : a + c], c)[0] for a, c in zip(first.tolist(), count[short].tolist())]
        h, d = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n + 1))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def half_keys(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document with a shingle, the 2 * HALVES half-keys of ROWS minhashes, and four bits of each minhash
    packed into three words."""
    filled = np.flatnonzero(np.diff(cuts))
    out, bits = np.empty((len(filled), 2 * HALVES), np.uint64), np.zeros((len(filled), 3), np.uint64)
    seeds = _seeds(2 * HALVES * ROWS)
    for i in range(2 * HALVES):
        key = np.full(len(filled), np.uint64(i + 1))
        for r in range(ROWS):
            k = i * ROWS + r
            v = (h ^ (h >> np.uint64(29))) * seeds[k]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD1342543DE82EF95)
            least = mix(np.minimum.reduceat(v, cuts[:-1][filled]))
            key = mix(key ^ least)
            bits[:, k // 16] |= (least & np.uint64(15)) << np.uint64(4 * (k % 16))
        out[:, i] = key
    return out, bits


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in runs(whole):
            h, cuts = shingle_sets(*buffers(batch.column("text")))
            n = np.diff(cuts)
            filled = np.flatnonzero(n)
            prints, keys = np.zeros((2, len(n)), np.uint64), np.zeros((0, 2 * HALVES), np.uint64)
            bits = np.zeros((len(n), 3), np.uint64)
            if len(filled):
                for i, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    prints[i, filled] = np.add.reduceat(mix(h ^ np.uint64(c)), cuts[:-1][filled])
                keys, bits[filled] = half_keys(h, cuts)
            key_cuts = np.concatenate([[0], np.cumsum((n > 0) * 2 * HALVES)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    *(pa.array(p.view(np.int64)) for p in prints),
                    pa.ListArray.from_arrays(pa.array(key_cuts), pa.array(keys.reshape(-1).view(np.int64))),
                    *(pa.array(np.ascontiguousarray(bits[:, j]).view(np.int64)) for j in range(3)),
                ],
                ["doc_id", "n_shingles", "print_a", "print_b", "halves", "s0", "s1", "s2"],
            )


def _emit_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in runs(whole):
            h, cuts = shingle_sets(*buffers(batch.column("text")))
            arrays = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays], ["doc_id", "shingles"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for all nodes of ``edges`` (a, b), by large-star and small-star steps.

    Each step only takes minima over neighbours and joins them back, so a hub with any number of links is split.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    while True:
        # done when all are stars: no node has two smaller neighbours, or both a smaller and a larger one
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        # large star: every larger neighbour of a node goes to the least node around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        now = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        # small star: every smaller neighbour, and the node itself, goes to the least one
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        moved = now.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
    return cut(met.filter(F.lit(100) * F.col("both") >= F.lit(NEED) * F.col("either")).select("a", "b"), name)


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` with the component of ``column``."""
    return rows.join(labels.select(F.col("node").alias(column), F.col("component").alias(f"{column}_component")), column)


def absorbed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the components that ``links`` (a, b) connect have become one.

    Only the links between different components go through :func:`components`, so later rounds cost little.
    """
    between = _labelled(_labelled(links, labels, "a"), labels, "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return cut(labels.join(moved, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")


def _hubs(keys: DataFrame) -> DataFrame:
    """One member of each bucket of two or more: key, hub, and its hub_ columns.

    Buckets rank their members alike, so a document of a large group meets the same few hubs in all of its tables.
    """
    held = [F.col(c).alias(f"hub_{c}") for c in ("n", "s0", "s1", "s2")]
    found = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("doc_id").alias("o"), F.col("doc_id").alias("hub"), *held)).alias("m"))
    return found.filter("c > 1").select("key", "m.*").drop("o")


def _alike() -> Column:
    """Whether a bucket row and a hub can be similar enough: sizes, and how many of the minhashes' bits agree."""
    n, m = F.col("n"), F.col("hub_n")
    fits = (F.col("doc_id") != F.col("hub")) & (F.least(n, m) * 100 >= F.greatest(n, m) * NEED)
    differ = []
    for s in ("s0", "s1", "s2"):
        x = F.col(s).bitwiseXOR(F.col(f"hub_{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return fits & (F.lit(48) - differ[0] - differ[1] - differ[2] >= ALIKE)


def _full_sets(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """doc_id, shingles of the documents of ``pairs`` alone."""
    return _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name)


def _sets_of(docs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """doc_id, shingles of the documents of ``nodes`` (doc_id, each once)."""
    return cut(docs.join(nodes.hint("shuffle_hash"), "doc_id").mapInArrow(_emit_shingles, "doc_id bigint, shingles array<bigint>"), name)


def _several(members: DataFrame) -> DataFrame:
    """The rows of buckets whose members are of several components."""
    several = members.groupBy("key").agg(F.min("doc_id_component").alias("x"), F.max("doc_id_component").alias("y")).filter("x != y").select("key")
    return cut(members.join(cut(several, "several-keys"), "key", "left_semi"), "several")


def rare_places(sets: DataFrame) -> DataFrame:
    """doc_id, component, n, g, left, short: the shingles of ``sets`` (doc_id, component, shingles) at which a link between
    two components can begin. left: how many shingles of the document such a link can still rest on; short: whether
    that is enough for a partner that is no smaller. Of shingles that the very same documents hold only the first counts."""
    rows = sets.select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    # sums of 32 bits over the holders: shingles of the same documents agree in both and lie side by side in the order
    marks = [F.sum(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(i)), 32)).alias(f"m{i}") for i in range(3)]
    held = rows.groupBy("g").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"), *marks)
    of = F.struct("c", "m0", "m1", "m2").alias("of")
    ordered = rows.join(held.filter("x != y").select("g", of), "g").groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_set(F.struct("of", "g"))).alias("s"))
    firsts = F.transform("s", lambda e, i: F.struct(e["g"].alias("g"), ((i == 0) | (F.get("s", i - 1)["of"] != e["of"])).alias("first")))
    places = ordered.select("doc_id", "component", "n", F.size("s").alias("size"), F.posexplode(firsts).alias("i", "e")).filter("e.first")
    places = places.select("doc_id", "component", "n", F.col("e.g").alias("g"), (F.col("size") - F.col("i")).alias("left")).filter(F.col("left") * 100 >= F.col("n") * NEED)
    return cut(places.withColumn("short", F.col("left") * (100 + NEED) >= F.col("n") * (2 * NEED)), "places")


def _shared_places(places: DataFrame) -> DataFrame:
    """Places whose shingle several components hold, with how many hold it (held), whether the document is of another
    component than most of them (other), how many are (rest), and documents of that component, drawn by shingle (hubs)."""
    drawn = F.array(*(F.min_by(F.struct("doc_id", "n", "left"), F.xxhash64("doc_id", "g", F.lit(i))) for i in range(DRAWS)))
    counts = places.groupBy("g", "component").agg(F.count("*").alias("c"), F.max("short").alias("short"), drawn.alias("hubs"))
    large = counts.groupBy("g").agg(F.max(F.struct("c", "component", "hubs")).alias("m"), F.max("short").alias("short"), F.count("*").alias("k"), F.sum("c").alias("held"))
    # a table of its own, so that the join can split a shingle that very many documents hold
    large = cut(large.filter("short and k > 1").select("g", "held", (F.col("held") - F.col("m.c")).alias("rest"), F.col("m.component").alias("large"), "m.hubs"), "shared-shingles")
    return cut(places.join(large, "g").withColumn("other", F.col("component") != F.col("large")).drop("large"), "rare")


def rare_hub_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) that join a document to the hubs of a shingle that more than ``CROWD`` documents hold."""
    met = shared.filter(F.col("other") & (F.col("held") > CROWD)).withColumn("hub", F.explode("hubs"))
    met = met.filter(F.least("left", "hub.left") * (100 + NEED) >= (F.col("n") + F.col("hub.n")) * NEED)
    return met.select(F.greatest("doc_id", "hub.doc_id").alias("a"), F.least("doc_id", "hub.doc_id").alias("b")).distinct()


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (doc_id, n_shingles, rep: smallest id with the same set) and the component of each rep."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = cut(docs.mapInArrow(_emit_sets, SETS), "sets")
    known = sets.select("doc_id", "n_shingles", "print_a", "print_b").filter("doc_id is not null and n_shingles > 0")
    # tables of their own, so that the join can split a class of very many copies
    same = cut(known.groupBy("n_shingles", "print_a", "print_b").agg(F.min("doc_id").alias("rep")), "same")
    classes = cut(known.join(same, ["n_shingles", "print_a", "print_b"]).select("doc_id", "n_shingles", "rep"), "classes")
    reps = cut(classes.filter("doc_id = rep").select("doc_id").distinct(), "reps")
    # half-keys that two classes share
    own = ["n", "s0", "s1", "s2"]
    half = sets.filter("n_shingles > 0").join(reps, "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), *own[1:], F.posexplode("halves").alias("i", "half"))
    half = cut(half, "halves")
    shared = cut(half.groupBy("i", "half").agg(F.count("*").alias("c")).filter("c > 1").select("i", "half"), "shared")
    held = half.join(shared, ["i", "half"], "left_semi").groupBy("doc_id", *own).agg(F.collect_set(F.struct("i", "half")).alias("h"))
    first, second = F.filter("h", lambda x: x["i"] < HALVES), F.filter("h", lambda x: x["i"] >= HALVES)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["i"], x["half"], y["i"], y["half"]))))
    keys = cut(held.select("doc_id", *own, F.explode(keys).alias("key")), "tables")
    hub = cut(_hubs(keys), "hubs")
    pairs = keys.join(hub, (keys["key"] == hub["key"]) & _alike()).groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("c"))
    pairs = cut(pairs, "pairs")
    best = pairs.groupBy("a").agg(F.max(F.struct("c", F.col("b"))).alias("m")).select("a", "m.b")
    whole = _full_sets(docs, pairs, "sets-hubs")
    labels = absorbed(reps.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")), _confirmed(best, whole, "links-best"))
    # pairs that would still join two components
    rest = _labelled(_labelled(pairs.select("a", "b"), labels, "a"), labels, "b").filter("a_component != b_component").select("a", "b")
    rest = possible_pairs(rest.join(best, ["a", "b"], "left_anti"), cut(sketches(whole, NEED), "sketches-hubs"), NEED)
    labels = absorbed(labels, _confirmed(cut(rest, "rest-pairs"), whole, "links-rest"))
    # every pair of components that a bucket still holds
    members = _labelled(keys.join(hub.select("key"), "key", "left_semi").select("key", "doc_id"), labels, "doc_id")
    nodes = cut(_several(members).select("doc_id", F.col("doc_id_component").alias("component")).distinct(), "unmet")
    whole = _sets_of(docs, nodes.select("doc_id"), "sets-unmet")
    tried = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    places = rare_places(whole.join(nodes, "doc_id"))
    shared = _shared_places(places)
    # first a few partners a row, which join what is left of large groups, so that the rest forms few pairs
    drawn = cut(rare_hub_pairs(shared).join(tried, ["a", "b"], "left_anti"), "drawn-pairs")
    sketched = cut(sketches(whole, NEED), "sketches")
    labels = absorbed(labels, _confirmed(cut(possible_pairs(drawn, sketched, NEED), "near-drawn"), whole, "links-drawn"))
    places = _labelled(places.drop("component"), labels, "doc_id").withColumnRenamed("doc_id_component", "component")
    exact = cut(tile_pairs(_shared_places(places).drop("hubs"), sketched, NEED).join(tried.unionByName(drawn), ["a", "b"], "left_anti"), "exact-pairs")
    return classes, absorbed(labels, _confirmed(exact, whole, "links-exact"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    classes, labels = linked_classes(docs)
    linked = _labelled(classes, labels, "rep")
    found = linked.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("rep_component").alias("component_id"))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("bigint").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
