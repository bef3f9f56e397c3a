"""Packages written and read back, routing, naming, libraries and arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions import runs as R
from leafmill.functions import text as T
from leafmill.operators import templates
from leafmill.plans.base import P_SQL, paras, query, table
from leafmill.plans.lint_queries import ALL_HITS
from leafmill.sources import docx, docx_format, snippet_store
from leafmill.storage import shared_folder
from leafmill.streaming import ingest
from leafmill.streaming import packages as arriving


def packages(spark, sf_dir):
    """A package of every document: its paragraphs, every third one a list item."""
    p = paras(spark, sf_dir)
    level = F.when(F.col("para_idx") % 3 == 1, F.concat(F.lit('<w:pPr><w:numPr><w:ilvl w:val="'), (F.col("para_idx") % 9).cast("string"), F.lit('"/><w:numId w:val="7"/></w:numPr></w:pPr>'))).otherwise("")
    return docx.built(p.select("doc_id", "para_idx", F.concat(level, R.runs_xml(R.text_runs(T.sanitize_xml(F.col("text"))))).alias("xml")))


@query("s01_docx_paragraphs", f"WITH {P_SQL} SELECT doc_id, para_idx, text, CASE WHEN para_idx % 3 = 1 THEN 7 END AS num_id, CASE WHEN para_idx % 3 = 1 THEN para_idx % 9 ELSE -1 END AS list_level, 'body' AS part FROM p")
def s01(spark, sf_dir):
    """Also S4: list membership and level."""
    return docx.paragraphs(docx.parsed(packages(spark, sf_dir))).select("doc_id", "para_idx", "text", "num_id", "list_level", "part")


@query("s02_docx_text_nodes", f"WITH {P_SQL} SELECT doc_id, para_idx AS node_idx, para_idx, text FROM p")
def s02(spark, sf_dir):
    return docx.text_nodes(docx.parsed(packages(spark, sf_dir)))


@query("s05_routing", "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN 'docx' WHEN doc_id % 4 = 1 THEN 'pdf' ELSE 'unsupported' END AS file_type, source || '-' || doc_id || CASE doc_id % 4 WHEN 0 THEN '_edited.docx' WHEN 1 THEN '.pdf_edited.docx' WHEN 2 THEN '.txt_edited.docx' ELSE '_edited.docx' END AS saved FROM documents")
def s05(spark, sf_dir):
    """Routing by name, and the name under which an edited file is saved."""
    d = F.col("doc_id")
    name = F.concat("source", F.lit("-"), d.cast("string"), F.when(d % 4 == 0, ".docx").when(d % 4 == 1, ".pdf").when(d % 4 == 2, ".txt").otherwise(".DOCX"))
    good, other = docx.routed(table(spark, sf_dir, "documents").select("doc_id", name.alias("path")))
    return good.unionByName(other).select("doc_id", "file_type", T.output_name(F.col("path")).alias("saved"))


@query("s07_patched_docx", f"WITH {P_SQL} SELECT doc_id, para_idx, CASE WHEN para_idx % 2 = 0 THEN '<' || para_idx || '> ' || lower(text) ELSE text END AS text, CASE WHEN para_idx % 3 = 1 THEN para_idx % 9 ELSE -1 END AS list_level FROM p")
def s07(spark, sf_dir):
    """Every other paragraph rewritten inside the packages, which are then read again; list properties stay."""
    new = F.concat(F.lit("<"), F.col("para_idx").cast("string"), F.lit("> "), F.lower("text"))
    changes = paras(spark, sf_dir).filter("para_idx % 2 = 0").select("doc_id", "para_idx", R.runs_xml(R.text_runs(new)).alias("xml"))
    return docx.paragraphs(docx.parsed(docx.patched(packages(spark, sf_dir), changes))).select("doc_id", "para_idx", "text", "list_level")


#: A document part as another writer makes it: its own prefix, unused declarations, comments, instructions, both quotes.
_HEAD = f"""<?xml version='1.0' encoding="UTF-8"?>\r\n<!-- kept --><?app keep?><d:document xmlns:d='{docx.W}' xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14='http://schemas.microsoft.com/office/word/2010/wordml' xmlns:un="urn:unused" mc:Ignorable="w14" ><d:body>"""
_PROPS, _TAIL = "<d:pPr ><d:jc d:val='left'/></d:pPr>", "<d:sectPr  /></d:body >\n</d:document><!--end-->"


def foreign(spark, sf_dir):
    """A package of every document that our own writer did not make: entries of text, put together by Spark."""
    p = paras(spark, sf_dir).withColumn("text", T.sanitize_xml(F.col("text")))
    at = F.col("para_idx").cast("string")
    body = F.concat(F.lit("<d:p w14:paraId='"), at, F.lit(f"'>{_PROPS}<!-- "), at, F.lit(" --><d:r><d:t xml:space='preserve'>"), T.escape_html(F.col("text")), F.lit("</d:t></d:r></d:p>\n"))
    body = F.when(F.col("text") == "", "<d:p />").otherwise(body)
    listed = p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", body.alias("x")))), lambda x: x["x"]), "").alias("body"))
    part = F.struct(F.lit(docx.PART).alias("name"), F.concat(F.lit(_HEAD), "body", F.lit(_TAIL)).alias("data"))
    other = F.struct(F.lit("custom/item.xml").alias("name"), F.concat(F.lit("<x a='"), F.col("doc_id").cast("string"), F.lit("'/>")).alias("data"))
    return docx.zipped(listed.select("doc_id", F.inline(F.array(part, other))))


def _quoted(x: str) -> str:
    """A SQL literal."""
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


_NEW = f"""{_quoted(f'<w:r xmlns:w="{docx.W}"><w:t>[')} || para_idx || ']</w:t></w:r></d:p>'"""
_OPEN = f"""{_quoted("<d:p w14:paraId='")} || para_idx || {_quoted("'>" + _PROPS)}"""


@query(
    "s07_byte_exact",
    f"""WITH {P_SQL}, x AS (
  SELECT doc_id, para_idx, CASE
    WHEN para_idx % 2 = 0 AND text = '' THEN '<d:p>' || {_NEW}
    WHEN para_idx % 2 = 0 THEN {_OPEN} || {_NEW} || chr(10)
    WHEN text = '' THEN '<d:p />'
    ELSE {_OPEN} || '<!-- ' || para_idx || {_quoted(" --><d:r><d:t xml:space='preserve'>")} || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</d:t></d:r></d:p>' || chr(10) END AS s FROM p),
d AS (SELECT doc_id, count(*) FILTER (para_idx % 2 = 0) AS n, {_quoted(_HEAD)} || string_agg(s, '' ORDER BY para_idx) || {_quoted(_TAIL)} AS part FROM x GROUP BY doc_id)
SELECT doc_id, n AS n_changed, name, CASE name WHEN '{docx.PART}' THEN sha256(part) ELSE sha256({_quoted("<x a='")} || doc_id || {_quoted("'/>")}) END AS sha256 FROM d, (VALUES ('{docx.PART}'), ('custom/item.xml')) v(name)""",
)
def s07_exact(spark, sf_dir):
    """Every other paragraph of another writer's packages rewritten: digests of all entries, byte for byte."""
    new = F.concat(F.lit("<w:r><w:t>["), F.col("para_idx").cast("string"), F.lit("]</w:t></w:r>"))
    changes = paras(spark, sf_dir).filter("para_idx % 2 = 0").select("doc_id", "para_idx", new.alias("xml"))
    done = docx.patched(foreign(spark, sf_dir), changes)
    return docx.entries(done.filter("error is null"), ("n_changed",)).select("doc_id", "n_changed", "name", F.sha2("data", 256).alias("sha256"))


@query("s01_foreign_packages", f"WITH {P_SQL} SELECT doc_id, para_idx, text, len(text) > 0 AS has_run FROM p")
def s01_foreign(spark, sf_dir):
    """Paragraphs of packages that another writer made."""
    got = docx.paragraphs(docx.parsed(foreign(spark, sf_dir)))
    return got.select("doc_id", "para_idx", "text", (F.size("runs") > 0).alias("has_run"))


def named(spark, sf_dir):
    """The packages of all documents under file names."""
    return packages(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), "content", "doc_id")


def _number():
    return F.regexp_extract("name", "[0-9]+", 0).cast("bigint").alias("doc_id")


@query("s01_docx_format", f"WITH {P_SQL} SELECT doc_id, para_idx, text, CASE WHEN para_idx % 3 = 1 THEN para_idx % 9 ELSE -1 END AS list_level FROM p WHERE doc_id % 10 <> 7")
def s01_format(spark, sf_dir):
    """Packages of all documents written and read as a data source in two commits; those whose names end in 7 are told
    apart by name before any task is planned."""
    docx_format.register(spark)
    place, files = f"{shared_folder(spark)}/format-{uuid.uuid4().hex}", named(spark, sf_dir)
    for odd in (0, 1):
        files.filter(F.col("doc_id") % 2 == odd).write.format("docx").mode("append").save(place)
    read = spark.read.format("docx").load(place).filter(~F.col("name").endswith("7.docx") & F.col("error").isNull())
    return read.select(_number(), "para_idx", "text", "list_level")


@query("st01_docx_format", f"WITH {P_SQL} SELECT doc_id, count(*) AS paragraphs, sum(len(text))::BIGINT AS chars FROM p GROUP BY doc_id")
def st01_format(spark, sf_dir):
    """A stream of the data source: each commit of packages is read once, though the stream stops and starts again."""
    docx_format.register(spark)
    place, files = f"{shared_folder(spark)}/format-{uuid.uuid4().hex}", named(spark, sf_dir)
    for third in range(3):
        files.filter(F.col("doc_id") % 3 == third).write.format("docx").mode("append").save(f"{place}/in")
        if third:
            rows = spark.readStream.format("docx").load(f"{place}/in").select(_number(), F.length("text").alias("n"))
            rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("chars"))


@query("s11_snippet_library", "SELECT 'c' || c_custkey AS name, c_name AS body, c_custkey AS updated_at FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 5 <> 0")
def s11(spark, sf_dir):
    """JSON lists; broken ones, invalid names and empty bodies give nothing."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    item = F.to_json(F.struct(F.concat(F.lit("!c"), k.cast("string")).alias("name"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("body"), k.alias("updatedAt")))
    raw = c.select(F.when(k % 4 == 3, item).otherwise(F.concat(F.lit("["), item, F.lit(',{"name":"1 x","body":"b"}]'))).alias("json"))
    return templates.read_library(raw)


@query("st01_arriving_documents", f"{ALL_HITS}, n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id) SELECT d.doc_id, count(*)::INTEGER AS paragraphs, (sum(len(text)) + count(*) - 1)::INTEGER AS chars, coalesce(any_value(n.n), 0)::INTEGER AS n_hits FROM d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id")
def st01(spark, sf_dir):
    """The same measures on a stream: what lies in the folder has arrived, results are appended and read back."""
    from leafmill.plans.base import defects

    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), "\n")
    docs = defects(spark, sf_dir).groupBy("doc_id").agg(texts.alias("text"))
    docs.write.parquet(f"{place}/in")
    q = ingest.start(ingest.measured(ingest.arriving(spark, f"{place}/in", docs.schema)), f"{place}/out", f"{place}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{place}/out").select("doc_id", "paragraphs", "chars", "n_hits")


@query(
    "st01_arriving_packages",
    f"""WITH {P_SQL}, n AS (SELECT doc_id, CASE WHEN (doc_id * 7 + 5) % 11 > (doc_id * 7) % 11 THEN 1 ELSE 0 END AS v, max(para_idx) + 1 AS n, sum(len(text)) AS c FROM p GROUP BY doc_id)
SELECT doc_id, 'version ' || v AS head, (CASE WHEN v = 1 THEN n + 1 ELSE 2 END)::INTEGER AS paragraphs, (9 + CASE WHEN v = 1 THEN c ELSE 3 END)::INTEGER AS chars FROM n""",
)
def st01_packages(spark, sf_dir):
    """Two versions of every document as packages, one of them twice, arriving out of order in several batches; the
    newest of each is read, the stream is stopped once and started again."""
    place = f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"
    p = paras(spark, sf_dir).select("doc_id", "para_idx", "text")
    docs = p.select("doc_id").distinct()
    version = F.struct("doc_id", F.col("v"))
    head = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"), F.lit(-1).alias("para_idx"), F.lit(None).cast("string").alias("text"))
    old = docs.select("doc_id", F.lit(0).alias("v"), F.lit(0).alias("para_idx"), F.lit("old").alias("text"))
    rows = p.select("doc_id", F.lit(1).alias("v"), "para_idx", "text").unionByName(old).unionByName(head.withColumn("text", F.concat(F.lit("version "), F.col("v").cast("string"))))
    built = docx.built(rows.select(version.alias("doc_id"), "para_idx", R.runs_xml(R.text_runs(T.sanitize_xml(F.col("text")))).alias("xml"))).select("doc_id.*", "content")
    hours = (F.col("doc_id") * 7 + F.col("v") * 5) % 11
    at = F.timestamp_seconds(F.lit(1_767_225_600) + hours * 3600)
    again = F.explode(F.when(F.col("v") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    arrivals = built.select("doc_id", at.alias("modified"), "content", "v", again)
    # built once: the second copies are read from the first folder; as many files as the session has partitions, a third a batch
    files = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    arrivals.repartition(files, F.xxhash64("doc_id", "v", "again")).write.parquet(f"{place}/in/a")
    for more in (False, True):  # the second start finds the same folder and nothing new but one more copy of all old versions
        if more:
            spark.read.parquet(f"{place}/in/a").filter("v = 0 and again = 0").coalesce(max(2, files // 3)).select("doc_id", "modified", "content").write.parquet(f"{place}/in/b")
        stream = spark.readStream.schema("doc_id bigint, modified timestamp, content binary").option("maxFilesPerTrigger", -(-files // 3)).option("recursiveFileLookup", "true").parquet(f"{place}/in")
        arriving.start(arriving.measured(arriving.newest(stream, "30 days")), f"{place}/out", f"{place}/state").awaitTermination()
    found = arriving.latest(spark.read.parquet(f"{place}/out"))
    return found.select("doc_id", F.col("texts")[0].alias("head"), "paragraphs", "chars")


@query(
    "s11_snippet_store",
    """WITH c AS (SELECT 'c' || c_custkey AS name, c_name, c_custkey AS k FROM customer),
v AS (SELECT name, c_name AS body, k AS at_, false AS gone FROM c UNION ALL SELECT name, 'B ' || c_name, k + k % 2, false FROM c WHERE k % 3 = 0
  UNION ALL SELECT name, NULL, k, true FROM c WHERE k % 5 = 0 UNION ALL SELECT name, 'late', k - 1, false FROM c WHERE k % 7 = 0)
SELECT name, body, at_ AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_ DESC, gone DESC, body) AS n FROM v) WHERE n = 1 AND NOT gone""",
)
def s11_store(spark, sf_dir):
    """Two writers' upserts and deletions, a compaction between them and a late older body; what is left is loaded."""
    place, k = f"{shared_folder(spark)}/snippets-{uuid.uuid4().hex}", F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("!c"), k.cast("string")))
    snippet_store.put(c.select("name", F.col("c_name").alias("body"), k.alias("updated_at")), place)
    snippet_store.put(c.filter(k % 3 == 0).select("name", F.concat(F.lit("B "), "c_name").alias("body"), (k + k % 2).alias("updated_at")), place)
    snippet_store.compact(spark, place)
    snippet_store.remove(c.filter(k % 5 == 0).select("name", k.alias("updated_at")), place)
    snippet_store.put(c.filter(k % 7 == 0).select("name", F.lit("late").alias("body"), (k - 1).alias("updated_at")), place)
    return snippet_store.load(spark, place)
