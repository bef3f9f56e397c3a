"""Template fields, snippet libraries and mail merge."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import tokens
from leafmill.functions.patterns import ends_trimmed
from leafmill.storage import stored


def token_rows(paragraphs: DataFrame, hits: Column) -> DataFrame:
    """doc_id, para_idx, kind, name, token, start, end."""
    return paragraphs.select("doc_id", "para_idx", F.explode(hits).alias("h")).select("doc_id", "para_idx", "h.*")


def _summary(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("doc_id", "name").orderBy("para_idx", "start")
    sample = F.when(F.col("k") <= most, F.struct("para_idx", "start", "token"))
    return rows.withColumn("k", F.row_number().over(order)).groupBy("doc_id", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(sample)).alias("samples"))


def field_summary(paragraphs: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, name, n, samples of the placeholders, at most ``most`` samples each."""
    return _summary(token_rows(paragraphs, tokens.placeholder_hits(F.col("text"))), most)


def trigger_summary(paragraphs: DataFrame, library: DataFrame, most: int = 4) -> DataFrame:
    """The same of snippet triggers, with has_definition."""
    found = _summary(token_rows(paragraphs, tokens.trigger_hits(F.col("text"))), most)
    known = library.select("name").distinct().withColumn("has_definition", F.lit(True))
    return found.join(known, "name", "left").withColumn("has_definition", F.coalesce("has_definition", F.lit(False)))


def undefined_triggers(paragraphs: DataFrame, library: DataFrame) -> DataFrame:
    rows = token_rows(paragraphs, tokens.trigger_hits(F.col("text")))
    return rows.join(library.select("name"), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def valid_library(snippets: DataFrame) -> DataFrame:
    """Normalised names; rows without a valid name or a body go."""
    clean = snippets.withColumn("name", tokens.snippet_name(F.col("name")))
    return clean.filter((F.col("name") != "") & F.col("body").isNotNull() & (ends_trimmed(F.col("body")) != ""))


def read_library(raw: DataFrame, column: str = "json") -> DataFrame:
    """Snippets of JSON lists of {name, body, updatedAt}; anything that is no list gives none."""
    items = F.from_json(column, "array<struct<name:string,body:string,updatedAt:bigint>>")
    rows = raw.filter(ends_trimmed(F.col(column)).startswith("[")).select(F.explode(items).alias("s"))
    return valid_library(rows.select("s.name", "s.body", F.col("s.updatedAt").alias("updated_at")))


def upsert(library: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each name; of equally new ones a new row, then the first body. Rows without a time are oldest.

    An aggregate that combines before the shuffle, so a name with very many versions is no hot key.
    """
    both = library.select("*", F.lit(0).alias("_new")).unionByName(valid_library(new).select("*", F.lit(1).alias("_new")))
    order = F.struct(F.col("updated_at").isNull(), -F.col("updated_at"), -F.col("_new"), "body")
    newest = F.min_by(F.struct(*library.columns), order)
    return both.groupBy("name").agg(newest.alias("_row")).select("_row.*")


def delete(library: DataFrame, names: DataFrame) -> DataFrame:
    return library.join(names.select(tokens.snippet_name(F.col("name")).alias("name")), "name", "left_anti")


def expand_map(paragraphs: DataFrame, library: DataFrame) -> DataFrame:
    """doc_id and the map of its triggers' bodies, as far as they are defined; of a repeated name the newest body counts,
    of equally new ones the first."""
    used = token_rows(paragraphs, tokens.trigger_hits(F.col("text"))).select("doc_id", "name").distinct()
    age = F.struct(F.col("updated_at").isNull(), -F.col("updated_at"), "body") if "updated_at" in library.columns else F.col("body")
    bodies = library.groupBy("name").agg(F.min_by("body", age).alias("body"))
    return used.join(bodies, "name").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "body")))).alias("bodies"))


def value_map(values: DataFrame) -> DataFrame:
    """record_id and its trimmed, non-empty values as a map; of a repeated name the last by ``seq`` counts, without such a
    column the greatest. Values go to their record once, where both groupings take place."""
    kept = values.withColumn("value", ends_trimmed(F.col("value"))).filter((F.col("value") != "") & F.col("name").isNotNull())
    last = F.max_by("value", F.struct("seq", "value")) if "seq" in values.columns else F.max("value")
    one = kept.repartition("record_id").groupBy("record_id", "name").agg(last.alias("value"))
    return one.groupBy("record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("vals"))


def mail_merge(template: DataFrame, records: DataFrame, on: str = "template_id", values: str = "vals") -> DataFrame:
    """Each record's copy of its template's paragraphs, filled: adds new_text and n_filled."""
    merged = template.join(records, on).withColumn("_f", tokens.fill(F.col("text"), F.col(values)))
    return merged.withColumn("new_text", F.col("_f.text")).withColumn("n_filled", F.col("_f.n")).drop("_f")


def expand_and_fill(text: Column, bodies: Column, values: Column, as_of: datetime | None = None, lang: str = "pl") -> Column:
    """Snippets first, then the placeholders that they bring in: struct (text, n_expanded, n_filled)."""
    if as_of is not None:
        bodies = F.transform_values(bodies, lambda k, v: tokens.resolve_body(v, as_of, lang))
    grown = tokens.expand(text, bodies)
    full = tokens.fill(grown["text"], values)
    return F.struct(full["text"].alias("text"), grown["n"].alias("n_expanded"), full["n"].alias("n_filled"))


def ranked_names(names: DataFrame, collation: str = "pl") -> DataFrame:
    """place (from 1), name of different ``names`` in a language's order, without bringing them into one task.

    Names are range-partitioned, numbered in each part, and the counts of the parts before are added (one row a part).
    """
    ordered = F.collate(F.col("name"), collation)
    parts = stored(names.select("name").repartitionByRange(ordered, "name").withColumn("part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part").join(sizes.select(F.col("part").alias("p"), "n"), F.col("p") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(ordered, "name"))
    return parts.withColumn("own", own).join(before, "part").select((F.col("own") + F.col("before")).cast("int").alias("place"), "name")


def by_collation(library: DataFrame, collation: str = "pl") -> DataFrame:
    return library.orderBy(F.collate(F.col("name"), collation), "name")
