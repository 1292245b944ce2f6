"""Forest plots as tables: their count columns, checksums against printed totals, and long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.tables import column_paths, row_labels

#: First words of labels of printed totals (fixed values).
SUMMARY = ["total", "subtotal", "heterogeneity", "test for"]


def _header(h: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(h, F.lit("")))), r"\s+", " ")


def count_field(header: Column) -> Column:
    """What a column of counts counts, events or people; null for other columns."""
    h = _header(header)
    return F.when((h == "events") | F.endswith(h, F.lit(" events")), "events").when((h == "total") | F.endswith(h, F.lit(" total")), "subgroup_n")


def is_summary(label: Column) -> Column:
    words = F.concat(F.array_join(F.regexp_extract_all(_header(label), F.lit("([a-z0-9_]+|[^a-z0-9_ ]+)")), " "), F.lit(" "))
    return F.exists(F.array(*map(F.lit, SUMMARY)), lambda first: F.startswith(words, F.concat(first, F.lit(" "))))


def whole_number(cell: Column) -> Column:
    return F.when(F.trim(cell).rlike(r"^-?\d+$"), F.trim(cell).try_cast("long"))


def kind_note(label: Column, kind: Column) -> Column:
    """What is odd about a row that is declared a study or a summary; null where nothing is."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(is_summary(label) & (k == "study"), "looks like a summary").when(~is_summary(label) & (k == "summary"), "looks like a study")


def has_grid(text: Column) -> Column:
    """Whether any line names a study with its year and at least two whole numbers behind it. A line is read by its words: the year begins one, and the word before it, or before `et al`, ends as a name or an initial does."""

    def grid(words: Column) -> Column:
        def names(i: Column) -> Column:
            before = F.get(words, i - 1)
            also = before.isin("al", "al.") & (F.get(words, i - 2) == "et") & (i > 2)
            name = F.when(also, F.get(words, i - 3)).otherwise(before)
            return (i > 0) & name.rlike("(?<![a-z0-9])[a-z][a-z'.-]*$")

        year = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.rlike("^(19|20)[0-9]{2}([^0-9]|$)") & names(i), i)), lambda i: i.isNotNull()))
        numbers = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("^[0-9]+$"), i)), lambda i: i > year)
        return F.coalesce(F.size(numbers) >= 2, F.lit(False))

    return F.exists(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\r?\n"), lambda line: F.get(F.transform(F.array(F.split(F.trim(line), r"\s+")), grid), F.lit(0)))


def count_cells(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells of a body in columns of counts, with the column's path, its field, the row's printed label and whether that is a summary."""
    paths = column_paths(cells, table).withColumn("field_type", count_field(F.col("path"))).where("field_type is not null")
    body = cells.where("not head")
    printed = body.where("c = 0").select(*table, "r", F.trim("text").alias("printed"))
    return body.join(paths, [*table, "c"]).join(printed, [*table, "r"], "left").withColumn("summary", is_summary(F.col("printed")))


def checksums(cells: DataFrame, table: list[str]) -> DataFrame:
    """For each column of counts the sum of its study rows and its state: missing if no study row has a number, failed if the sum is none of the numbers printed in any summary row, unchecked without summary rows, else verified."""
    body = cells.where("not head")
    label = body.where("c = 0").select(*table, "r", is_summary(F.col("text")).alias("summary"))
    printed = body.join(label.where("summary").drop("summary"), [*table, "r"]).groupBy(*table).agg(F.collect_set(whole_number(F.col("text"))).alias("printed"))
    n = whole_number(F.col("text"))
    sums = count_cells(cells, table).groupBy(*table, "c", "path", "field_type").agg(F.sum(F.when(~F.col("summary"), n)).alias("column_sum"), F.count(F.when(~F.col("summary"), n)).alias("numbers"))
    out = sums.join(printed, table, "left")
    state = F.when(F.col("numbers") == 0, "missing").when(F.col("printed").isNull(), "unchecked").when(F.array_contains("printed", F.col("column_sum")), "verified").otherwise("failed")
    return out.select(*table, "c", "path", "field_type", "column_sum", state.alias("state"))


def quarantined(cells: DataFrame, table: list[str]) -> DataFrame:
    """The cells with those of study rows in columns that failed left blank."""
    failed = checksums(cells, table).where("state = 'failed'").select(*table, "c", F.lit(True).alias("failed"))
    label = cells.where("not head and c = 0").select(*table, "r", F.lit(False).alias("head"), is_summary(F.col("text")).alias("summary"))
    out = cells.join(failed, [*table, "c"], "left").join(label, [*table, "head", "r"], "left")
    return out.withColumn("text", F.when(F.col("failed") & ~F.col("head") & ~F.coalesce("summary", F.lit(False)), "").otherwise(F.col("text"))).select(*cells.columns)


def long_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """A row for each count of a study: the study, the column's path, the field and the text. Summary rows, rows without a study and columns whose checksum failed have none."""
    failed = checksums(cells, table).where("state = 'failed'").select(*table, "c")
    rows = count_cells(cells, table).where("not summary").join(failed, [*table, "c"], "left_anti")
    return rows.join(row_labels(cells, table).where("label <> ''").select(*table, "r", F.col("label").alias("study")), [*table, "r"]).select(*table, "r", "study", "path", "field_type", F.col("text").alias("value"))
