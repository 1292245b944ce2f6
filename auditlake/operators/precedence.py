"""Joins that try several keys, the most specific first: one exchange carries all levels, and a level that answers with more than one is refused rather than passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import shared_share
from auditlake.operators.cohorts import telling_tokens
from auditlake.sources.tables import settled


def _levels(rows: DataFrame, of: str, keys: list[Column]) -> DataFrame:
    """A row for each level of each row that has a key there: of, level, key."""
    at = F.array(*(F.struct(F.lit(i).alias("level"), k.cast("string").alias("key")) for i, k in enumerate(keys)))
    return rows.select(F.col(of), F.explode(F.filter(at, lambda x: F.coalesce(x["key"], F.lit("")) != "")).alias("x")).select(of, "x.*")


def by_precedence(asked: DataFrame, known: DataFrame, id: str, value: str, keys: list[tuple[Column, Column]]) -> DataFrame:
    """What the known rows have for each asked one: id, level (from 0), value and status: found, ambiguous (the first level with a hit has several different values) or unmatched. keys: for each level, the most specific first, the key of an asked row and that of a known one; a null or blank key is none.

    Asked ids are each one row. All levels meet in one join, in which a key is told by its level as well.
    """
    left = _levels(asked, id, [a for a, _ in keys])
    # many known rows may say the same of a key: they are one before they meet
    right = _levels(known.withColumnRenamed(value, "_value") if value != "_value" else known, "_value", [b for _, b in keys]).groupBy("level", "key").agg(F.min("_value").alias("least"), F.max("_value").alias("most"))
    met = left.join(right, ["level", "key"]).groupBy(id).agg(F.min(F.struct("level", "least", "most")).alias("best"))
    out = asked.select(id).join(met, id, "left")
    several = F.col("best.least") != F.col("best.most")
    status = F.when(F.col("best").isNull(), "unmatched").when(several, "ambiguous").otherwise("found")
    return out.select(id, F.col("best.level").alias("level"), F.when(~several, F.col("best.least")).alias(value), status.alias("status"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def names_column(want: Column, have: Column) -> Column:
    """Whether a label's column is that of a cell, both in plain form: its path, its last part, or either within the other; a blank one names none."""
    return (want != "") & (F.contains(have, want) | F.contains(want, have) | (want == F.trim(F.element_at(F.split(have, " / "), -1))))


def origins(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Where each cell's value comes from by the labels of its table: cells (cell, table_id, path, row) with value_source, level (row, column or table; null without a label) and conflict, whether labels of its whole column name several sources.

    labels: table_id, column_path, row, value_source, pos. A label of the row in the column wins, then one of the whole column, then one of the whole table, each the first by pos. Only different wordings of paths and labels meet, each pair once for a table; cells and labels that share them are looked up.
    """
    said = labels.withColumn("_want", _plain(F.col("column_path")))
    held = cells.withColumn("_have", _plain(F.col("path")))
    first = F.min(F.struct("pos", "column_path", "row", "value_source"))
    source = F.col("value_source")
    of_row = said.where("row is not null and _want <> ''").groupBy("table_id", "_want", "row").agg(first.alias("first"))
    of_whole = said.where("row is null and _want <> ''").groupBy("table_id", "_want").agg(first.alias("first"), F.min(source).alias("least"), F.max(source).alias("most"), F.bool_or(source.isNull()).alias("blank"))
    of_table = said.where(F.coalesce("column_path", F.lit("")) == "").groupBy("table_id").agg(first["value_source"].alias("_of_table"))
    wordings = said.where("_want <> ''").select("table_id", "_want").distinct()
    named = settled(held.select("table_id", "_have").distinct().join(wordings, "table_id").where(names_column(F.col("_want"), F.col("_have"))))
    rows = named.join(of_row, ["table_id", "_want"]).groupBy("table_id", "_have", "row").agg(F.min("first")["value_source"].alias("_of_row"))
    several = F.coalesce(F.min("least") != F.max("most"), F.lit(False)) | (F.bool_or("blank") & F.min("least").isNotNull())
    whole = named.join(of_whole, ["table_id", "_want"]).groupBy("table_id", "_have").agg(F.min("first")["value_source"].alias("_of_column"), several.alias("_conflict"))
    met = held.join(rows, ["table_id", "_have", "row"], "left").join(whole, ["table_id", "_have"], "left").join(of_table, "table_id", "left")
    level = F.when(F.col("_of_row").isNotNull(), "row").when(F.col("_of_column").isNotNull(), "column").when(F.col("_of_table").isNotNull(), "table")
    return met.select(*cells.columns, F.coalesce("_of_row", "_of_column", "_of_table").alias("value_source"), level.alias("level"), F.coalesce("_conflict", F.lit(False)).alias("conflict"))


def singular_tokens(label: Column) -> Column:
    """Telling words of a label, plurals of over three letters without their s."""
    return F.array_distinct(F.transform(telling_tokens(label), lambda t: F.when(F.endswith(t, F.lit("s")) & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)))


def cohort_mapping(review: DataFrame, source: DataFrame) -> DataFrame:
    """Which label of a source each cohort of a review is: study, key, label and how (best, or left for the last pair). review: study, key, variants; source: study, label (each once).

    Pairs are taken in the order of their likeness, each cohort and each label once; a cohort that is equally like two labels is not told by likeness. Where both sides are equally many and one of each is left, these are a pair. A study's cohorts are as few as a table has columns: all its pairs are taken in one pass over them in order.
    """
    tokens = review.select("study", "key", F.explode_outer("variants").alias("v")).select("study", "key", singular_tokens(F.coalesce("v", F.lit(""))).alias("t"))
    labels = source.select("study", "label", singular_tokens(F.col("label")).alias("s"))
    scored = tokens.join(labels, "study").groupBy("study", "key", "label").agg(F.max(shared_share(F.col("t"), F.col("s"))).alias("score")).where("score > 0")
    alone = F.count("*").over(Window.partitionBy("study", "key", "score")) == 1
    ranked = scored.withColumn("alone", alone).where("alone").groupBy("study").agg(F.sort_array(F.collect_list(F.struct("score", "key", "label")), asc=False).alias("pairs"))
    pair = "array<struct<key:string,label:string>>"
    free = lambda taken, p: ~F.exists(taken, lambda x: (x["key"] == p["key"]) | (x["label"] == p["label"]))
    taken = F.aggregate("pairs", F.array().cast(pair), lambda held, p: F.when(free(held, p), F.concat(held, F.array(F.struct(p["key"].alias("key"), p["label"].alias("label"))))).otherwise(held))
    sides = review.groupBy("study").agg(F.array_sort(F.collect_set("key")).alias("keys")).join(source.groupBy("study").agg(F.array_sort(F.collect_set("label")).alias("labels")), "study")
    held = sides.join(ranked.select("study", taken.alias("taken")), "study", "left").withColumn("taken", F.coalesce("taken", F.array().cast(pair)))
    rest = {"left_keys": F.array_except("keys", F.col("taken.key")), "left_labels": F.array_except("labels", F.col("taken.label"))}
    held = held.withColumns(rest)
    last = (F.size("keys") == F.size("labels")) & (F.size("left_keys") == 1) & (F.size("left_labels") == 1)
    told = F.transform("taken", lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), F.lit("best").alias("how")))
    end = F.array(F.struct(F.get("left_keys", F.lit(0)).alias("key"), F.get("left_labels", F.lit(0)).alias("label"), F.lit("left").alias("how")))
    return held.select("study", F.explode(F.when(last, F.concat(told, end)).otherwise(told)).alias("x")).select("study", "x.*")
