"""A Merkle manifest of a table of documents, and the climb of every leaf to its root by a recursive query.

A leaf is the digest of a row's columns. Per source, leaves in order of the id form a tree whose nodes take three
consecutive ones; what remains are the sources' subroots, which form one more tree up to the root. Both kinds of tree are
built alike: nodes are grouped into blocks of ``3 ** STRIDE``, whose ``STRIDE`` levels are formed in one aggregation. A
block never depends on how many leaves its source has, so a source with a third of all rows is no hot key.

The levels are stored as node rows with a link to the block above (tree, step, pos) and, for each level up to it, the
siblings to the left and right. The recursive query starts with a row for each leaf and joins it, step by step, to the
node that its link names: it appends the siblings met and folds the digest, which began as that of the tampered
document. A leaf of n rows needs about log3(n) / ``STRIDE`` steps. Nodes near a root meet very many leaves; these
joins rest on Spark's splitting of skewed partitions. Every step moves the digest and link of a leaf and the siblings
that it has just met, never the proof so far; a leaf's few steps are put together once at the end.

Leaves get their places by a range sort and counts by (source, partition), so neither a source nor the list of sources
passes one task.

Defined cases: null columns are ``-``; a null source is a source of its own and the first; a null id comes first in its
source and is not tampered with; rows that share an id are ordered by their digest; wholly equal rows are leaves of their
own; a lone source's subroot is the root; a proof without siblings is the digest of the empty text; texts are read whole,
whatever their length; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, table

FANOUT, STRIDE = 3, 6
TOP = -1  # the tree of subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: list[Column]) -> Column:
    """Hex digest of the columns, each with its length in bytes."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns)), 256)


def without_feeds(doc_id: Column, text: Column) -> Column:
    """The tampered text: of ids with an even crc32 the line feeds are gone."""
    hit = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (doc_id, source, leaf, start) with tree (place of the source), pos (place in it) and n (its size)."""
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    spread = leaves.withColumn("any", F.monotonically_increasing_id())  # only equal rows are told apart by it
    spread = spread.repartitionByRange(*order, "any").sortWithinPartitions(*order)
    spread = cut(spread.drop("any").withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("at", 33).alias("part")
    runs = cut(spread.groupBy("source", part).agg(F.count("*").alias("c"), F.min("at").alias("first")), "merkle-runs")
    by_source = Window.partitionBy("source")
    runs = runs.withColumn("base", F.coalesce(F.sum("c").over(by_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("n", F.sum("c").over(by_source)).withColumn("origin", F.min("first").over(by_source))
    # sources stand in the order of their first rows: number them within a partition, after those of earlier ones
    heads = cut(runs.filter("first = origin").select("part", "origin"), "merkle-sources")
    counts = heads.groupBy("part").agg(F.count("*").alias("c"))  # one row a partition
    bases = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = heads.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("origin")) - 1).join(bases, "part")
    trees = numbered.select("origin", (F.col("own") + F.col("base")).cast("bigint").alias("tree"))
    runs = cut(runs.join(trees, "origin").select(F.col("source").alias("run_source"), F.col("part").alias("run_part"), "first", "base", "n", "tree"), "merkle-places")
    same = (part == F.col("run_part")) & F.col("source").eqNullSafe(F.col("run_source"))
    return spread.join(runs, same).select("tree", (F.col("at") - F.col("first") + F.col("base")).alias("pos"), "n", "doc_id", "leaf", "start")


def blocks(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """tree, n, block, kids and the levels l0.. of each block of ``rows`` (tree, pos, n, leaf, and ``keep``)."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "leaf", *keep)))
    size = FANOUT**STRIDE
    out = rows.groupBy("tree", "n", F.expr(f"pos div {size}").alias("block")).agg(kids.alias("kids"))
    out = out.withColumn("l0", F.transform("kids", lambda k: _hex(k["leaf"])))
    for j in range(STRIDE):
        below = f"l{j}"
        nodes = F.expr(f"transform(sequence(0, CAST((size({below}) - 1) div {FANOUT} AS INT)), i -> sha2(array_join(slice({below}, i * {FANOUT} + 1, {FANOUT}), ''), 256))")
        out = out.withColumn(f"l{j + 1}", F.when((F.col("n") > size) | (F.size(below) > 1), nodes).otherwise(F.col(below)))
    return out


def nodes_of(found: DataFrame, step: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Node rows of ``blocks``: tree, step, pos, leaf, ``keep``, the link (to_tree, to_step, to_pos) and the siblings of
    each level up to it, as digests one after the other."""
    size = FANOUT**STRIDE
    goes_on = F.col("n") > size

    def path(i: Column) -> Column:
        levels = []
        for j in range(STRIDE):
            at, level = F.floor(i / F.lit(FANOUT**j)).cast("int"), F.col(f"l{j}")
            k = at % FANOUT
            left, right = F.slice(level, at - k + 1, k), F.slice(level, at + 2, F.lit(FANOUT - 1) - k)
            sides = F.struct(F.unhex(F.array_join(left, "")).alias("l"), F.unhex(F.array_join(right, "")).alias("r"))
            levels.append(F.when(goes_on | (F.size(level) > 1), sides))
        return F.filter(F.array(*levels), lambda x: x.isNotNull())

    rows = F.transform("kids", lambda kid, i: F.struct(kid["pos"].alias("pos"), kid["leaf"].alias("leaf"), *(kid[c].alias(c) for c in keep), path(i).alias("path")))
    out = found.select("tree", "n", "block", F.inline(rows))
    top = F.col("tree") == TOP
    link = {
        "to_tree": F.when(goes_on, F.col("tree")).when(~top, F.lit(TOP)),
        "to_step": F.when(goes_on, F.lit(step + 1)).when(~top, F.lit(0)),
        "to_pos": F.when(goes_on, F.col("block")).when(~top, F.col("tree")),
    }
    types = {"to_tree": "bigint", "to_step": "int", "to_pos": "bigint"}
    return out.select("tree", F.lit(step).alias("step"), "pos", "leaf", *keep, "path", *(c.cast(types[n]).alias(n) for n, c in link.items()))


def _above(found: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """What a step hands on: nodes of trees that go on, and what remains of the others."""
    last = F.unhex(F.element_at(f"l{STRIDE}", 1)).alias("leaf")
    on = found.filter(F.col("n") > size).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(size)).cast("bigint").alias("n"), last)
    return on, found.filter(F.col("n") <= size).select("tree", last)


def built(leaves: DataFrame, name: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node rows of step 0, those of further steps, and what remains of each tree (tree, leaf)."""
    size = FANOUT**STRIDE
    found = cut(blocks(leaves, keep), f"merkle-{name}-0")
    first, upper, ends, step = nodes_of(found, 0, keep), None, None, 0
    while True:
        on, done = _above(found, size)
        ends = done if ends is None else ends.unionByName(done)
        if on.isEmpty():
            break
        step += 1
        found = cut(blocks(on), f"merkle-{name}-{step}")
        more = nodes_of(found, step)
        upper = more if upper is None else upper.unionByName(more)
    return first, first.drop(*keep).limit(0) if upper is None else upper, ends


#: The climb; ``fold`` and ``met`` work on the path of one node row. Rows without a link have reached the root.
CLIMB = """
WITH RECURSIVE climb (own_tree, own_pos, nth, digest, met, to_tree, to_step, to_pos, subroot) AS (
  SELECT tree, pos, 0, {fold0}, {met0}, to_tree, to_step, to_pos, CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT c.own_tree, c.own_pos, c.nth + 1, {fold}, {met}, n.to_tree, n.to_step, n.to_pos,
         CASE WHEN n.tree = -1 AND n.step = 0 THEN n.leaf END
  FROM climb c JOIN {nodes} n ON c.to_tree = n.tree AND c.to_step = n.step AND c.to_pos = n.pos
)
SELECT own_tree, own_pos, nth, digest, met, to_tree IS NULL AS ended, subroot FROM climb
"""


def _fold(digest: str, path: str) -> str:
    return f"aggregate({path}, {digest}, (d, x) -> unhex(sha2(concat(lower(hex(x.l)), lower(hex(d)), lower(hex(x.r))), 256)))"


def _met(path: str) -> str:
    return f"aggregate({path}, CAST(X'' AS BINARY), (m, x) -> concat(m, x.l, x.r))"


def climbed(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the recursive query: one for each leaf (own_tree, own_pos) and step."""
    spark = leaves.sparkSession
    names = {"leaves": leaves, "nodes": nodes}
    text = CLIMB.format(fold0=_fold("start", "path"), met0=_met("path"), fold=_fold("c.digest", "n.path"), met=_met("n.path"), leaves="{leaves}", nodes="{nodes}")
    limits = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before = {k: spark.conf.get(k, None) for k in limits}
    try:  # the limits guard against endless recursion, which links upwards rule out; the rows are as many as leaves x steps
        for k in limits:
            spark.conf.set(k, "-1")
        return cut(spark.sql(text, **names), "merkle-climb")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    ``tampered`` is the text to verify against the manifest of the given ones, by default :func:`without_feeds`."""
    cols = [F.col(c) for c in FIELDS]
    changed = without_feeds(F.col("doc_id"), F.col("text")) if tampered is None else tampered
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.unhex(leaf_digest(cols)).alias("leaf"), F.unhex(leaf_digest([*cols[:-1], changed])).alias("start"))
    own = ("doc_id", "start")
    first, upper, subroots = built(placed(leaves), "source", own)
    first = cut(first, "merkle-nodes-0")
    subroots = cut(subroots, "merkle-subroots")
    n = subroots.count()
    top_first, top_upper, root = built(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("bigint").alias("n"), "leaf"), "top")
    nodes = cut(upper.unionByName(top_first).unionByName(top_upper), "merkle-nodes")
    steps = climbed(first, nodes)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "met", "digest", "subroot")))
    whole = steps.groupBy("own_tree", "own_pos").agg(ordered.alias("s"))
    proof = F.sha2(F.array_join(F.transform("s", lambda x: _hex(x["met"])), ""), 256)
    ended = F.element_at("s", -1)
    whole = whole.select("own_tree", "own_pos", proof.alias("proof_sha256"), _hex(ended["digest"]).alias("folded_root"), _hex(F.element_at(F.filter("s", lambda x: x["subroot"].isNotNull()), 1)["subroot"]).alias("subroot"))
    top = root.first()  # one row, or none of an empty table
    ids = first.select(F.col("tree").alias("own_tree"), F.col("pos").alias("own_pos"), "doc_id", _hex(F.col("leaf")).alias("leaf"))
    out = ids.join(whole, ["own_tree", "own_pos"]).withColumn("root", F.lit(None if top is None else bytes(top["leaf"]).hex()).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_DIGEST = "sha256(" + " || ".join(_FIELD.format(c=c) for c in FIELDS[:-1]) + " || " + _FIELD.format(c="{text}") + ")"
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda d, i: xor(d >> 1, 3988292384::UBIGINT * (d & 1::UBIGINT)))), 4294967295::UBIGINT) % 2 = 0, FALSE) AS hit
  FROM documents),
d AS (
  SELECT doc_id, source, {_DIGEST.format(text="text")} AS leaf, {_DIGEST.format(text="replace(text, chr(10), CASE WHEN hit THEN '' ELSE chr(10) END)")} AS start FROM crc),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
tree AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subs AS (SELECT tree, h FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT tree, level, pos, h, n FROM tree WHERE n > 1 UNION ALL SELECT -1, level, pos, h, n FROM top WHERE n > 1),
kin AS (SELECT tree, level, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM nodes GROUP BY ALL),
height AS (SELECT tree, max(level) AS top FROM tree GROUP BY tree),
climb AS (
  SELECT l.tree AS own, l.pos AS own_pos, l.tree, 0 AS level, l.pos, l.start AS h, '' AS met, 0 AS nth FROM l
  UNION ALL
  SELECT own, own_pos, tree, level, pos, h, met, nth FROM (
    SELECT c.own, c.own_pos, c.tree, c.level + 1 AS level, c.pos // 3 AS pos,
           sha256(array_to_string(k.hs[1:c.pos % 3], '') || c.h || array_to_string(k.hs[c.pos % 3 + 2:], '')) AS h,
           c.met || array_to_string(k.hs[1:c.pos % 3], '') || array_to_string(k.hs[c.pos % 3 + 2:], '') AS met, c.nth + 1 AS nth
    FROM climb c JOIN kin k ON k.tree = c.tree AND k.level = c.level AND k.up = c.pos // 3
    UNION ALL
    SELECT c.own, c.own_pos, -1, 0, c.own, c.h, c.met, c.nth + 1 FROM climb c JOIN height t ON t.tree = c.tree AND t.top = c.level)),
ended AS (SELECT own, own_pos, max_by(h, nth) AS folded_root, max_by(met, nth) AS met FROM climb GROUP BY own, own_pos)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(e.met) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM l JOIN ended e ON e.own = l.tree AND e.own_pos = l.pos JOIN subs s ON s.tree = l.tree JOIN (SELECT h FROM top WHERE n = 1) r ON true
"""
