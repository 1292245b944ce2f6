"""Contracts, recorded answers and records of search services, as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import normal_doi, normal_pmid
from auditlake.operators.knowledge import merge
from auditlake.sources.tables import read_knowledge

#: Axes of a population and the values that each may have (fixed values).
BASES, SETS = ["allocated", "treated", "analysed"], ["itt", "mitt", "per_protocol", "evaluable", "safety"]
AXES = {"population_basis": BASES, "analysis_set": SETS}


def _json(spark: SparkSession, path: str) -> dict:
    """A contract's file, which is read on the driver; it is a page long."""
    [row] = spark.read.option("wholetext", True).text(path).collect()
    return json.loads(row.value.lstrip("﻿"))


def read_phrases(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """Phrases of each value of each axis of a population contract; a value that isn't known is refused. Keys that begin with _ are remarks."""
    body = _json(spark, path)
    held = {axis: {v: p for v, p in body.get(axis, {}).items() if not v.startswith("_")} for axis in AXES}
    unknown = [f"{axis}: {v}" for axis, values in held.items() for v in values if v not in AXES[axis]]
    if unknown:
        raise ValueError(f"values that are not known: {', '.join(unknown)}")
    return held | {"randomisation_stated": {"true": body.get("randomisation_stated", [])}}


def read_aliases(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Keys and wordings of cohorts; keys that begin with _ and entries that are no lists are left out."""
    return {k: [str(v) for v in vs] for k, vs in _json(spark, path).items() if not k.startswith("_") and isinstance(vs, list)}


def read_tolerances(spark: SparkSession, path: str) -> DataFrame:
    """Bands by field type from a JSON object, `*` for all others."""
    return spark.createDataFrame([(k, float(v)) for k, v in _json(spark, path).items()], "field_type string, rel double")


def declared_scope(text: Column) -> Column:
    """A population stated as basis or basis/analysis set, as a struct with null for what isn't stated; words that aren't known are an error when the row is read."""
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    basis, held = F.split_part(said, F.lit("/"), F.lit(1)), F.split_part(said, F.lit("/"), F.lit(2))
    check = lambda x, known, what: F.when(x == "", None).when(x.isin(known), x).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not known: "), x)).cast("string"))
    return F.struct(check(basis, BASES, "population basis").alias("basis"), check(held, SETS, "analysis set").alias("analysis_set"))


def read_runtime_knowledge(spark: SparkSession, seed: str, slices: list[str]) -> DataFrame:
    """The seed with every slice merged on it, in the order of their names."""
    fields = ["unit_equivalences", "plausible_range", "scope"]
    held = read_knowledge(spark, seed)
    for path in sorted(slices, key=lambda p: p.rsplit("/", 1)[-1].lower()):
        held = merge(held, read_knowledge(spark, path), fields).select("field_type", "synonyms", *fields, "status")
    return held


def write_knowledge(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, one object for each field type."""
    entries.write.mode("overwrite").json(path)


def replayed(asked: DataFrame, recorded: DataFrame, key: list[str], cache_only: bool = True) -> DataFrame:
    """asked with the answer that was recorded for the same question (a hash over the key columns by name), the last one where there are several; a question that no answer is recorded for is an error in a run from the cache only, else null."""
    name = lambda rows: rows.withColumn("_q", F.sha2(F.to_json(F.struct(*sorted(key))), 256))
    answers = name(recorded).groupBy("_q").agg(F.max_by("answer", "at").alias("answer"))
    out = name(asked).join(answers, "_q", "left").drop("_q")
    if not cache_only:
        return out
    return out.withColumn("answer", F.coalesce("answer", F.raise_error(F.lit("no answer is recorded for a question")).cast(answers.schema["answer"].dataType)))


GOLD = ["document_id", "table_id", "row_id", "column_id", "raw_value", "normalized_value", "blank_kind", "source_locator"]


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Annotated cells of JSON lines, with `fault`: a missing identity, a value where the cell is blank, none where it isn't, or a cell that is annotated twice; null where it is sound."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in GOLD)).json(path)
    place = ["document_id", "table_id", "row_id", "column_id"]
    twice = rows.groupBy(*place).count().where("count > 1").select(*place, F.lit(True).alias("_twice"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    nameless = empty("source_locator")
    for c in place:
        nameless = nameless | empty(c)
    value = F.col("blank_kind") == "value"
    fault = F.when(nameless, "no identity").when(~value & (~empty("raw_value") | ~empty("normalized_value")), "value in a blank").when(value & empty("raw_value"), "no value").when(F.col("_twice"), "annotated twice")
    return rows.join(twice, place, "left").withColumn("fault", fault).drop("_twice")


OPENALEX = "struct<open_access:struct<is_oa:boolean,oa_url:string>,primary_location:struct<pdf_url:string,source:struct<display_name:string>>,locations:array<struct<is_oa:boolean,pdf_url:string>>,abstract_inverted_index:map<string,array<int>>,doi:string,title:string,display_name:string,publication_year:int,authorships:array<struct<author:struct<display_name:string>>>,ids:struct<pmid:string,pmcid:string>>"
CROSSREF = "struct<DOI:string,title:array<string>,`container-title`:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,`alternative-id`:array<string>>"


def pdf_url(work: Column) -> Column:
    """The open PDF of a record: its open address, then that of its first place, then of any open place; empty where there is none."""
    place = F.get(F.filter(work["locations"], lambda x: x["is_oa"] & (F.coalesce(x["pdf_url"], F.lit("")) != "")), F.lit(0))
    return F.coalesce(F.when(work["open_access"]["is_oa"], F.nullif(work["open_access"]["oa_url"], F.lit(""))), F.nullif(work["primary_location"]["pdf_url"], F.lit("")), place["pdf_url"], F.lit(""))


def indexed_abstract(work: Column) -> Column:
    """The abstract of a record that holds it as places of words; empty where it holds none."""
    entries = F.map_entries(work["abstract_inverted_index"])
    places = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(""))


def openalex_candidates(rows: DataFrame, column: str = "record") -> DataFrame:
    """Candidates of records in JSON, with the open PDF and the abstract; unreadable ones are left out."""
    w = F.col("_w")
    held = rows.withColumn("_w", F.from_json(column, OPENALEX)).where("_w is not null")
    authors = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda a: F.coalesce(a, F.lit("")) != "")
    return held.select(*[c for c in rows.columns if c != column], normal_doi(w["doi"]).alias("doi"), F.coalesce(w["title"], w["display_name"], F.lit("")).alias("title"), authors.alias("authors"), w["publication_year"].alias("year"), F.coalesce(w["primary_location"]["source"]["display_name"], F.lit("")).alias("journal"), normal_pmid(F.substring_index(w["ids"]["pmid"], "/", -1)).alias("pmid"), pdf_url(w).alias("pdf_url"), indexed_abstract(w).alias("abstract"))


def crossref_candidates(rows: DataFrame, column: str = "record") -> DataFrame:
    w = F.col("_w")
    held = rows.withColumn("_w", F.from_json(column, CROSSREF)).where("_w is not null")
    authors = F.transform(w["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    year = F.get(F.get(F.coalesce(w["issued"]["date-parts"], w["published"]["date-parts"]), F.lit(0)), F.lit(0))
    pmid = F.get(F.filter(F.transform(w["alternative-id"], normal_pmid), lambda p: p != ""), F.lit(0))
    first = lambda c: F.coalesce(F.get(w[c], F.lit(0)), F.lit(""))
    return held.select(*[c for c in rows.columns if c != column], normal_doi(w["DOI"]).alias("doi"), first("title").alias("title"), authors.alias("authors"), F.nullif(year, F.lit(0)).alias("year"), first("container-title").alias("journal"), F.coalesce(pmid, F.lit("")).alias("pmid"))


def fallback_text(title: Column, authors: Column, journal: Column, year: Column) -> Column:
    """What stands for a paper whose text no source has: what is known of it, and that there is no text."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), line("Authors", F.array_join(authors, ", ")), line("Journal", journal), line("Year", year.cast("string")), F.lit("\n[Full text not available. Only title and metadata provided.]"))
