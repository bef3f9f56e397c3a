"""Registration of queries beside the SQL that states the same result, and their shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.patterns import WS
from leafmill.operators.paragraphs import from_texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, para_idx, text of all documents."""
    return from_texts(table(spark, sf_dir, "documents"))


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs with typography defects that follow from their numbers; both engines build the same ones."""
    t, k = F.col("text"), (F.col("doc_id") + F.col("para_idx")) % 6
    bad = (
        F.when(k == 0, F.replace(t, F.lit(" "), F.lit("  ")))
        .when(k == 1, F.replace(t, F.lit(","), F.lit(" ,")))
        .when(k == 2, F.concat(t, F.lit("..")))
        .when(k == 3, F.concat(F.lit('"'), t, F.lit('" x i.')))
        .when(k == 4, F.lower(t))
        .otherwise(F.concat(F.lit(" "), t, F.lit(chr(160))))
    )
    return paras(spark, sf_dir).withColumn("text", bad)


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template paragraph per customer: doc_id, para_idx, text."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Dear {{c_name}} of {{ c_mktsegment }}, !closing !sig"), F.when(F.col("c_custkey") % 2 == 0, "-more").otherwise(" {{c_name}}"), F.lit(" !n"), F.col("c_nationkey").cast("string"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("para_idx"), text.alias("text"), "c_name", "c_mktsegment", "c_nationkey")


#: The same inputs in SQL, to stand behind WITH.
P_SQL = """
p AS (
  SELECT doc_id, lang, (i - 1)::INTEGER AS para_idx, t AS text
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
D_SQL = (
    P_SQL
    + """,
d AS (
  SELECT doc_id, lang, para_idx, CASE (doc_id + para_idx) % 6
    WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, ',', ' ,') WHEN 2 THEN text || '..'
    WHEN 3 THEN '"' || text || '" x i.' WHEN 4 THEN lower(text) ELSE ' ' || text || chr(160) END AS text
  FROM p)"""
)
T_SQL = """
t AS (
  SELECT c_custkey AS doc_id, 0 AS para_idx, c_name, c_mktsegment, c_nationkey,
         'Dear {{c_name}} of {{ c_mktsegment }}, !closing !sig' || CASE WHEN c_custkey % 2 = 0 THEN '-more' ELSE ' {{c_name}}' END || ' !n' || c_nationkey AS text
  FROM customer)"""
WS_SQL = WS


def upper_sql(x: str) -> str:
    """Upper case with the sharp s as SS."""
    return f"replace(upper({x}), 'ẞ', 'SS')"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def hits_sql(source: str, pattern: str, columns: str = "doc_id, para_idx", keys: str = "doc_id, para_idx") -> str:
    """columns, ord, s (start), m (match) of every match of a pattern in ``source``.text."""
    return f"""(
  SELECT {columns}, (i - 1)::INTEGER AS ord, m,
         (sum(len(g)) OVER w + coalesce(sum(len(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS s
  FROM (SELECT {columns}, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
        FROM (SELECT {columns}, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM {source}) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY {keys} ORDER BY i))"""
