"""Which study a label names: joins on blocks that no match escapes, then the full rule, then a unique answer or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import folded, letter
from auditlake.operators.ordered import numbered
from auditlake.sources.tables import spread

#: Words that say nothing about an identity, and the form of a year.
STOPWORDS = ("et", "al", "and", "the")
YEAR = r"(?:19|20)\d{2}"
#: A year by itself, and one that letters touch; digits of a longer number are no year.
APART, TOUCHED = f"(?<![A-Za-z0-9]){YEAR}(?![A-Za-z0-9])", f"(?<![0-9]){YEAR}(?![0-9])"


def year_of(text: Column) -> Column:
    """The first year that stands by itself, else the first that letters touch; null without one."""
    first = lambda form: F.nullif(F.regexp_extract(text, f"({form})", 1), F.lit(""))
    return F.coalesce(first(APART), first(TOUCHED))


def label_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(folded(text)), F.lit("([a-z0-9]+)"))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOPWORDS) & ~F.rlike(t, F.lit(f"^{YEAR}$"))))


def collapsed(text: Column) -> Column:
    """The letters and digits of a label without its years; those that letters touch stay where others stand by themselves."""
    low = F.lower(folded(text))
    bare = F.when(low.rlike(APART), F.regexp_replace(low, APART, "")).otherwise(F.regexp_replace(low, TOUCHED, ""))
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def identities_match(query: str, candidate: str) -> Column:
    """The same paper, by prepared columns of two aliases: label, year, tokens, letters."""
    q, c = (lambda x: F.col(f"{query}.{x}")), (lambda x: F.col(f"{candidate}.{x}"))
    covered = F.forall(q("tokens"), lambda t: F.array_contains(c("tokens"), t) | ((F.length(t) >= 3) & F.exists(c("tokens"), lambda k: F.startswith(k, t))))
    by_tokens = (F.size(q("tokens")) > 0) & (F.size(c("tokens")) > 0) & covered
    by_letters = (q("letters") != "") & (c("letters") != "") & (F.startswith(c("letters"), q("letters")) | F.startswith(q("letters"), c("letters")))
    same = F.lower(q("label")) == F.lower(c("label"))
    return same | (~F.coalesce(q("year") != c("year"), F.lit(False)) & (by_tokens | by_letters))


def prepared(rows: DataFrame, key: str, label: str) -> DataFrame:
    text = F.regexp_replace(F.trim(F.col(label)), r"\s+", " ")
    rows = rows.select(F.col(key).alias("key"), text.alias("label")).where("label <> ''")
    return rows.withColumns({"year": year_of(F.col("label")), "tokens": label_tokens(F.col("label")), "letters": collapsed(F.col("label"))})


def _prefixes(kind: str, text: Column, least: int) -> Column:
    """Hashes of all beginnings of a word or label, from the least length on."""
    made = F.transform(F.sequence(F.lit(least), F.greatest(F.length(text), F.lit(least))), lambda i: F.xxhash64(F.lit(kind), F.substring(text, F.lit(1), i)))
    return F.when(F.length(text) >= least, made)


def best_identity(queries: DataFrame, candidates: DataFrame, key: str, label: str) -> DataFrame:
    """query, candidate and reason for each query: an exact label wins; else the only match; else the only one that holds each of its words; else none.

    A pair that matches meets in a block: equal labels; the query's longest word, with which some word of the candidate
    must begin; or the letters of one, with which those of the other begin. Blocks are hashes, and the rule decides.
    """
    q, c = (prepared(spread(rows, key), key, label) for rows in (queries, candidates))
    whole = lambda kind, text: F.when(text != "", F.array(F.xxhash64(F.lit(kind), text)))
    none, letters = F.array().cast("array<bigint>"), F.col("letters")
    joined = lambda *parts: F.concat(*(F.coalesce(p, none) for p in parts))
    longest = F.element_at(F.array_sort(F.transform("tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"]
    q_blocks = joined(whole("=", F.lower("label")), F.when(F.size("tokens") > 0, whole("w", longest)), whole("l", letters), _prefixes("r", letters, 1))
    c_words = F.flatten(F.transform("tokens", lambda t: F.when(F.length(t) < 3, F.array(F.xxhash64(F.lit("w"), t))).otherwise(_prefixes("w", t, 3))))
    c_blocks = joined(whole("=", F.lower("label")), c_words, _prefixes("l", letters, 1), whole("r", letters))
    # a row has some dozens of blocks, of which Spark's estimate of sizes knows nothing: told from it, it would broadcast them all
    blocks = lambda rows, made: rows.withColumn("block", F.explode(F.array_distinct(made))).hint("merge")
    met = blocks(q, q_blocks).alias("q").join(blocks(c, c_blocks).alias("c"), F.col("q.block") == F.col("c.block")).where(identities_match("q", "c"))
    exact = F.lower("q.label") == F.lower("c.label")
    holds = (F.size("q.tokens") > 0) & (F.size(F.array_except("q.tokens", "c.tokens")) == 0)
    pairs = met.groupBy(F.col("q.key").alias("query"), F.col("c.key").alias("candidate")).agg(F.bool_or(exact).alias("exact"), F.bool_or(holds).alias("holds"))
    told = pairs.groupBy("query").agg(
        F.min(F.when(F.col("exact"), F.col("candidate"))).alias("same"), F.count("*").alias("n"), F.min("candidate").alias("only"),
        F.count_if("holds").alias("n_holds"), F.min(F.when(F.col("holds"), F.col("candidate"))).alias("holder"),
    )
    best = F.when(F.col("same").isNotNull(), F.col("same")).when(F.col("n") == 1, F.col("only")).when(F.col("n_holds") == 1, F.col("holder"))
    reason = F.when(F.col("same").isNotNull(), "exact").when(F.col("n") == 1, "only").when(F.col("n_holds") == 1, "only_holder").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return queries.select(F.col(key).alias("query")).join(told, "query", "left").select("query", best.alias("candidate"), reason.alias("reason"))


#: Particles that belong to the surname behind them (fixed values).
PARTICLES = ["van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "el", "al", "la", "le", "bin", "ibn", "mac", "mc", "st"]


def surname(citation: Column) -> Column:
    """The surname that a citation begins with, particles included, as one word of ASCII letters."""
    words = F.transform(F.regexp_extract_all(folded(F.coalesce(citation, F.lit(""))), F.lit("([A-Za-z][A-Za-z'-]*)")), F.lower)
    # words up to the first that is no particle; boilerplate ends the name
    state = lambda said, done: F.struct(said.alias("said"), done.alias("done"))
    step = lambda acc, w: F.when(acc["done"], acc).when(w.isin(*STOPWORDS), state(acc["said"], F.lit(True))).otherwise(state(F.concat(acc["said"], w), ~w.isin(PARTICLES)))
    found = F.aggregate(words, state(F.lit(""), F.lit(False)), step, lambda acc: acc["said"])
    return F.regexp_replace(found, "[^a-z0-9]", "")


def study_base(citation: Column) -> Column:
    """A citation as a short name: surname and year, else its letters."""
    short = F.concat_ws("_", F.nullif(surname(citation), F.lit("")), year_of(F.coalesce(citation, F.lit(""))))
    letters_ = F.btrim(F.regexp_replace(F.lower(folded(F.coalesce(citation, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(letters_, F.lit("")), F.lit("study"))


def study_slugs(rows: DataFrame, citation: str, order: list[str]) -> DataFrame:
    """rows with slug: the short name of a citation, of which the second in order is told by _b, the third by _c and so on to _z; later ones keep the bare name."""
    held = rows.withColumn("_base", study_base(F.col(citation)))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    letters_ = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), nth, F.lit(1))
    return held.withColumn("slug", F.when((nth == 1) | (nth > 26), F.col("_base")).otherwise(F.concat("_base", F.lit("_"), letters_))).drop("_base")


def slug_parts(slug: Column) -> Column:
    """Surname and year of a short name."""
    low = F.lower(F.trim(folded(F.coalesce(slug, F.lit("")))))
    return F.struct(F.regexp_replace(F.regexp_replace(low, r"_(19|20)\d{2}.*$", ""), "[^a-z0-9]", "").alias("surname"), F.coalesce(year_of(low), F.lit("")).alias("year"))


def row_key(label: Column, year: Column) -> Column:
    """A row's own words, with the year of another column where they have none."""
    said = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    other = F.coalesce(year_of(F.coalesce(year, F.lit(""))), F.lit(""))
    return F.coalesce(F.nullif(F.when((other != "") & year_of(said).isNull(), F.trim(F.concat(said, F.lit(" "), other))).otherwise(said), F.lit("")), F.lit("study"))


def relabelled(claims: DataFrame, studies: DataFrame, study: str = "study_id", label: str = "label") -> DataFrame:
    """claims with the id of the study that their own names (study and a label); those that name none or several keep theirs. And `resolved`."""
    asked = claims.select(F.col(study).alias("key"), F.col(study).alias("label")).where("key is not null").distinct()
    found = best_identity(asked, studies.select(F.col(study).alias("key"), F.concat_ws(" ", study, label).alias("label")), "key", "label")
    both = claims.join(found.select(F.col("query").alias(study), F.col("candidate").alias("_to")), study, "left")
    return both.withColumns({"resolved": F.col("_to").isNotNull(), study: F.coalesce("_to", study)}).drop("_to")


def uncited(claims: DataFrame, studies: DataFrame, study: str = "study_id") -> DataFrame:
    """Studies that claims name and the list doesn't hold, with the number of their claims."""
    return claims.join(studies.select(study).distinct(), study, "left_anti").groupBy(study).agg(F.count("*").alias("claims"))


def claim_ids(rows: DataFrame, part: str, study: str, order: str) -> DataFrame:
    """rows with claim_id: within a part, studies are lettered by their first row, and the rows of a study numbered, with two digits at least. A study is of one part."""
    first = rows.groupBy(part, study).agg(F.min(order).alias("_first"))
    lettered = numbered(first, [part], "_first", "_place").select(study, letter(F.col("_place") - 1).alias("_letter"))
    number = F.row_number().over(Window.partitionBy(study).orderBy(order))
    shown = F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    return rows.join(lettered, study).withColumn("claim_id", F.concat("_letter", F.lit("_"), shown)).drop("_letter")
