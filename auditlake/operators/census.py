"""How many groups a passage says there are, and whether the counts offered for adding are just those groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import contains_normally
from auditlake.operators.cohorts import telling_tokens

#: Numbers as words, plural names of sets of people, and the words that may stand between (fixed values).
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
GROUPS = ["groups", "arms", "cohorts", "regimens"]
QUALIFIERS = ["treatment", "study", "parallel", "randomised", "randomized", "assigned", "trial", "intervention", "active"]


def positive_integer(value: Column) -> Column:
    """A text that is one whole number above zero, as a JSON answer may write it (`3` or `3.0`, but no sign, no word, no leading zero); else null."""
    text = F.trim(value)
    return F.when(text.rlike("^[1-9][0-9]*([.]0+)?$"), F.split_part(text, F.lit("."), F.lit(1)).try_cast("long"))


def plain_tokens(text: Column) -> Column:
    """Words in lower case; signs separate them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")


def states_groups(quote: Column, n: Column) -> Column:
    """Whether a passage says that there are n groups: the number, in digits or as a word, right before a plural name of groups, with at most one word of a closed list between. A number that names a group, counts visits or is a dose says nothing of groups."""
    words = plain_tokens(quote)
    said = F.array_compact(F.array(n.cast("string"), F.get(F.array(*map(F.lit, NUMBERS)), (n - 1).cast("int"))))
    listed = lambda i, names: F.coalesce(F.get(words, i).isin(*names), F.lit(False))
    counts = F.transform(words, lambda w, i: F.array_contains(said, w) & (listed(i + 1, GROUPS) | (listed(i + 1, QUALIFIERS) & listed(i + 2, GROUPS))))
    return (n > 0) & F.exists(counts, lambda x: x)


def label_keys(labels: Column) -> Column:
    """Labels as sets: the telling words of each in order."""
    return F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.array_join(F.array_sort(telling_tokens(x)), " "))))


def census(rows: DataFrame) -> DataFrame:
    """rows (quote, declared: how many groups are said to be, or null; labels: which, or none; counted: labels of the counts that are offered) with census: why they may not be added, null where nothing stands in the way or nothing is declared.

    The number must be read in the passage, in the grammar of counting groups, and be that of the counts; the labels must be named there and be the same sets of words as those of the counts, no more and no fewer.
    """
    none = F.array().cast("array<string>")
    labels, counted, declared = F.filter(F.coalesce("labels", none), lambda x: F.trim(x) != ""), F.coalesce("counted", none), F.col("declared")
    unnamed = F.exists(labels, lambda x: ~contains_normally(F.col("quote"), x))
    some = F.size(labels) > 0
    why = (
        F.when(declared.isNull() & ~some, None).when(F.size(plain_tokens(F.col("quote"))) == 0, "no passage").when(declared.isNotNull() & ~states_groups(F.col("quote"), declared), "the passage doesn't count the groups")
        .when(declared != F.size(counted), "other number of counts").when(some & unnamed, "the passage doesn't name a group").when(some & (label_keys(labels) != label_keys(counted)), "other groups are counted").when(some & (declared != F.size(labels)), "other number of names")
    )
    return rows.withColumn("census", why)
