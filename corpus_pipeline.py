"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import crc_mod, cut, free_prefix, table
from leafmill.llm.language import identified
from leafmill.llm.mixing import mix_rows
from leafmill.llm.near_dup import near_duplicates
from leafmill.llm.packing import pack
from leafmill.llm.secrets import redact

#: A document goes if no language claims it by at least this much. The score of a short text is small in any language,
#: so it stays also if its score is this share of what its length allows.
LEAST_LANGUAGE_SCORE = 0.3
LEAST_LANGUAGE_SHARE = 0.9


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or that no language claims, go.

    Each row is judged by its own whole text: repeated rows share their fate, rows without an id are treated like
    others, and an empty table stays empty. With no language to learn from no document can be claimed, and all go.
    """
    own = free_prefix(docs.columns, "_lang_")
    pred, score, share = names = (f"{own}pred", f"{own}score", f"{own}share")
    found = identified(docs, crc_mod("doc_id", 4) != 2, names)
    claimed = (F.col(score) >= LEAST_LANGUAGE_SCORE) | (F.col(share) >= LEAST_LANGUAGE_SHARE)
    return found.filter((F.col(pred) != "und") & claimed).drop(*names)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Documents without words are in no group and stay. An id is one document: of rows that share one, the row with the
    smallest hash of the text stays (then of all columns), whichever order they come in. Rows without an id take no
    part and stay. An empty table stays empty.
    """
    own = free_prefix(docs.columns, "_kept_")
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias(f"{own}id")).distinct()
    known = docs.filter(docs["doc_id"].isNotNull())
    known = known.join(kept.hint("shuffle_hash"), known["doc_id"] == F.col(f"{own}id"), "left_semi")
    plain = [c for c, t in docs.dtypes if "map<" not in t and t != "variant"]  # which can be hashed
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*plain)))
    one = known.groupBy(F.col("doc_id").alias(f"{own}id")).agg(first.alias(f"{own}row")).select(f"{own}row.*")
    return one.unionByName(docs.filter(docs["doc_id"].isNull()))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in every whole text; every row stays, null and empty texts as they are."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; those without words once. Null is a source
    of its own, and rows that repeat id and text stand or fall together."""
    return mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's whole text; a null or empty text is the end token alone, repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_dup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language scores, redaction and tokens have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
