"""Parts of papers: where sections begin, which of them hold data, and the windows that are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import bound

#: Words of headings of sections that hold data, and of those that don't (fixed values).
KEPT = ["methods?", "materials", "procedures?", "experimental", "patients?", "participants", "subjects", "study population", "results?", "findings?", "outcomes?", "characteristics", "baseline", "data extraction", "tables?", "figures?"]
DROPPED = ["introduction", "background", "discussion", "conclusions?", "references", "bibliography", "acknowledge?ments", "funding", "author contribution", "conflict of interest", "declarations?", "competing interests?", "supplementary", "appendix", "ethics statement"]
#: Characters below which a text is taken whole, and that a filtered one must have; characters of windows (fixed values).
SHORT, ENOUGH, FRONT, RESULTS, CAPTURE = 3000, 1500, 4000, 45_000, 20_000
_BLANK = " \n\t"
_NUMBERED = r"[ \t]*(?:\d+(?:\.\d+)*\.?[ \t]*)?"


def _any(words: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def holds_data(title: Column) -> Column:
    return title.rlike(_any(KEPT)) & ~title.rlike(_any(DROPPED))


def marked_sections(docs: DataFrame) -> DataFrame:
    """Sections of texts with `## ` headings: doc_id, pos, title and body; what stands before the first is section 0, without a title."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?m)^## ")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    titled = F.col("pos") > 0
    return rows.select("doc_id", "pos", F.when(titled, F.trim(F.split_part("part", F.lit("\n"), F.lit(1)))).alias("title"), F.when(titled, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")).alias("body"))


def _by_mark(parts: Column) -> Column:
    """The parts between marks that hold data, the first always, under their headings."""
    body = lambda part, line: F.rtrim(F.substring(part, F.length(line) + 2, F.length(part)), F.lit(_BLANK))
    under = lambda part, line, title: F.when(holds_data(title), F.concat(F.lit("## "), title, F.lit("\n"), body(part, line)))
    titled = lambda part: bound(F.substring_index(part, "\n", 1), lambda line: bound(F.trim(line), lambda title: under(part, line, title)))
    # those without data are null, which a join passes over
    return F.trim(F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, F.rtrim(part, F.lit(_BLANK))).otherwise(titled(part))), "\n\n"))


def _by_line(text: Column) -> Column:
    """The parts under headings of their own line that hold data; null where there are fewer than three headings."""
    heading = r"(?m)^(?=\s*(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][A-Za-z][A-Za-z0-9 \-&/,]{1,70}\s*:?\s*$)"
    line = lambda part: F.trim(F.regexp_extract(part, r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?([A-Z][^\n:]*)", 1))
    parts = F.transform(F.split(text, heading), lambda part: F.struct(line(part).alias("title"), part.alias("part")))
    headed = F.filter(parts, lambda x: (F.length(x["title"]) >= 4) & (F.size(F.split(x["title"], r"\s+")) <= 8))
    kept = lambda found: F.transform(F.filter(found, lambda x: holds_data(x["title"])), lambda x: F.rtrim(x["part"], F.lit(_BLANK)))
    return bound(headed, lambda found: F.when(F.size(found) >= 3, F.trim(F.array_join(kept(found), "\n\n"))))


def core_text(text: Column) -> Column:
    """text without sections that hold no data, and filtered, whether any went. Short texts stay whole, and so do those of which too little would be left. Texts with `## ` headings keep what stands before them; in others a heading is a short line that begins with a capital and says nothing else, and there must be three."""
    chosen = lambda said: bound(F.split(said, r"(?m)^## "), lambda parts: F.when(F.size(parts) > 1, _by_mark(parts)).otherwise(_by_line(said)))
    good = lambda kept: F.coalesce(F.length(kept) >= ENOUGH, F.lit(False))
    told = lambda said, kept: F.struct(F.when(good(kept), kept).otherwise(said).alias("text"), good(kept).alias("filtered"))
    return bound(F.coalesce(text, F.lit("")), lambda said: bound(F.when(F.length(said) >= SHORT, chosen(said)), lambda kept: told(said, kept)))


def core_sections(docs: DataFrame) -> DataFrame:
    """doc_id, text and filtered, as core_text() gives them for each row."""
    return docs.select("doc_id", core_text(F.col("text")).alias("core")).select("doc_id", "core.*")


def _from(text: Column, heading: Column) -> Column:
    return F.substring(text, heading, F.length(text))


def _until_after(text: Column) -> Column:
    """Up to the heading of a discussion or reference list that stands past the first characters."""
    at = lambda said: F.regexp_instr(F.substring(said, F.lit(42), F.length(said)), F.lit(rf"(?im)^{_NUMBERED}(?:discussion|references|bibliography)\b"))
    return bound(text, lambda said: bound(at(said), lambda x: F.when(x > 0, F.substring(said, F.lit(1), x + 40)).otherwise(said)))


def without_references(text: Column, tail: int = 200) -> Column:
    """The text up to the last heading of a reference list, unless that stands in its first characters."""
    left = lambda said, parts: F.length(said) - F.length(F.element_at(parts, -1))
    cut = lambda said, parts: bound(left(said, parts), lambda n: F.when((F.size(parts) > 1) & (n > tail), F.substring(said, F.lit(1), n)).otherwise(said))
    return bound(text, lambda said: bound(F.split(said, r"(?im)^(?=[ \t]*(?:references|bibliography|reference list)\b)"), lambda parts: cut(said, parts)))


def windows(text: Column) -> Column:
    """What is read of a paper: front (up to the introduction), results (from their heading to the discussion) and capture (from the methods or results on); where a heading is missing, the text without its references. Each heading is looked for once in a window."""
    at = lambda said, pattern: F.regexp_instr(said, F.lit(pattern))
    intro = lambda said: at(said, rf"(?im)^\s*{_NUMBERED}introduction\b")
    results = lambda said: at(said, rf"(?im)^{_NUMBERED}results?\b(?!\s*:)[ \t]*(?=\r?\n|$)")
    start = lambda said: bound(at(said, rf"(?im)^\s*{_NUMBERED}methods?\b"), lambda x: F.when(x > 0, x).otherwise(results(said)))
    of = lambda use: bound(F.coalesce(text, F.lit("")), use)
    window = lambda heading, most: of(lambda said: bound(heading(said), lambda x: F.substring(F.when(x > 0, _until_after(_from(said, x))).otherwise(without_references(said)), 1, most)))
    front = of(lambda said: bound(intro(said), lambda x: F.substring(F.when(x > 0, F.substring(said, F.lit(1), x - 1)).otherwise(F.substring(said, 1, 8000)), 1, FRONT)))
    return F.struct(front.alias("front"), window(results, RESULTS).alias("results"), window(start, CAPTURE).alias("capture"))


def clipped(text: Column, words: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, max(0, words)), " ") if words > 0 else F.lit("")


def missed_forest(window: Column, kinds: Column) -> Column:
    """A text that speaks of a forest plot where none was listed."""
    return F.contains(F.lower(F.coalesce(window, F.lit(""))), F.lit("forest")) & ~F.coalesce(F.array_contains(kinds, "forest_plot"), F.lit(False))
