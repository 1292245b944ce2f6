"""Numbers in reported cells.

A cell is read in steps, each a projection of its own: its tokens, their classes as one string with a
character for each token (its shape), and what the shape says. Forms are looked for in the shape, and
the numbers are taken from the tokens at the places where it matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of an absent value (fixed values).
MISSING = ["", "-", "—", "na", "n/a", "nr", "nd", "ne", "none", "null", "not reported", "not applicable", "not available", "not stated", "not reached", "unknown"]
NUMBER = r"-?\d+(?:\.\d+)?"
EPSILON = 1e-9


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(MISSING)


def plain_commas(text: Column) -> Column:
    """Groups of three digits after a non-zero lead lose their commas; any other comma between digits is a decimal point.

    Numbers with commas are cut out whole, and each is judged as a whole: the longest run of groups of three is one number, and what follows it is a decimal.
    """
    run = r"[0-9]+(?:,[0-9]+)+"
    found = F.regexp_extract_all(text, F.lit(f"({run})"))
    # the digits up to the end of the last group of three
    groups = lambda n: F.regexp_extract(n, r"[1-9][0-9]{0,2}(?:,[0-9]{3})+", 0)
    lead = lambda n: F.call_function("substring_index", n, groups(n), F.lit(1))
    rest = lambda n: F.substring(n, F.length(lead(n)) + F.length(groups(n)) + 1, F.length(n))
    points = lambda n: F.replace(n, F.lit(","), F.lit("."))
    plain = F.transform(found, lambda n: F.when(groups(n) == "", points(n)).otherwise(F.concat(points(lead(n)), F.replace(groups(n), F.lit(","), F.lit("")), points(rest(n)))))
    between = F.split(text, run)
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(between, plain, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), ""))


#: Tokens of a cell: numbers, whose sign isn't a dash behind another number; signs; words; anything else.
TOKEN = r"((?<![0-9.%]\s{0,3})-[0-9]+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?|[<>]=|[A-Za-z]+(?:[.][A-Za-z]+)*[.]?|\S)"


def _class(token: Column) -> Column:
    """i: whole number, n: other number, o: sign of a bound, d: dash, t: to, s: spread, c: confidence interval, w: other word; signs stand for themselves."""
    word = F.lower(F.replace(token, F.lit("."), F.lit("")))
    return (
        F.when(token.rlike("^[0-9]+$"), "i").when(token.rlike("^-?[0-9]"), "n").when(token.rlike("^[<>≤≥]"), "o").when(token.isin("-", "–", "—"), "d").when(token == "±", "s")
        .when(word == "to", "t").when(word == "ci", "c").when(word == "confidence", "C").when(word == "interval", "I").when(token.rlike("^[A-Za-z]"), "w")
        .when(token.isin("/", "%", "(", ")", "[", "]", ","), token).otherwise("x")
    )


#: Forms in order of precedence, as they stand in a shape. The number of bounds of an interval are the third last and the last of what matches.
EVENTS, INTERVAL, BOUND, SHARE, SPREAD, REACH = "(?<!/)i/i(?!/)", r"[(\[][^)\]]*?(?:c|CI)[^)]*?[in][td,][in]", "^[^ino]*o[in]", "^[in]%$", "[in]s[in]", r"[(][in]d[in][)]"


def with_cells(rows: DataFrame, **cells: Column) -> DataFrame:
    """rows with a struct for each named cell: form, primary, spread and its kind, lower and upper, operator, ci_lower, ci_upper and ci_level, events and total, pct. The first form that fits decides; what a form doesn't state is null."""
    names = list(cells)
    of = lambda prefix: {f"_{prefix}_{n}": n for n in names}
    signs = lambda c: F.replace(F.replace(c, F.lit("+/-"), F.lit("±")), F.lit("+-"), F.lit("±"))
    rows = rows.withColumns({f"_text_{n}": signs(plain_commas(F.trim(c))) for n, c in cells.items()})
    rows = rows.withColumns({k: F.regexp_extract_all(F.col(f"_text_{n}"), F.lit(TOKEN)) for k, n in of("tokens").items()})
    rows = rows.withColumns({k: F.array_join(F.transform(f"_tokens_{n}", _class), "") for k, n in of("shape").items()})
    rows = rows.withColumns({k: _form(F.col(f"_shape_{n}"), F.col(f"_text_{n}")) for k, n in of("form").items()})
    rows = rows.withColumns({k: _matched(F.col(f"_shape_{n}"), F.col(f"_form_{n}")) for k, n in of("at").items()})
    rows = rows.withColumns({n: _stated(*(F.col(f"_{p}_{n}") for p in ("text", "tokens", "shape", "form", "at"))) for n in names})
    return rows.drop(*(f"_{p}_{n}" for p in ("text", "tokens", "shape", "form", "at") for n in names))


def _form(shape: Column, text: Column) -> Column:
    # a sign that a letter or digit touches bounds nothing
    free = text.rlike(r"(?:^|[^A-Za-z0-9])(?:[<>]=?|[≤≥])\s*[\d.]")
    return (
        F.when(shape.isNull() | ~shape.rlike("[in]"), "none").when(shape.rlike(EVENTS), "events").when(shape.rlike(INTERVAL), "interval").when(shape.rlike(BOUND) & free, "bound")
        .when(shape.rlike(SHARE), "percentage").when(shape.rlike(SPREAD), "spread").when(shape.rlike(REACH), "reach").otherwise("plain")
    )


def _matched(shape: Column, form: Column) -> Column:
    """First and last token of what the form matched, and the token of an interval's level."""
    pattern = F.when(form == "events", EVENTS).when(form == "interval", INTERVAL).when(form == "bound", BOUND).when(form == "spread", SPREAD).when(form == "reach", REACH)
    start, size = F.regexp_instr(shape, pattern), F.length(F.regexp_substr(shape, pattern))
    level = F.regexp_instr(F.regexp_substr(shape, pattern), F.lit("[in]%(?:c|CI)"))
    return F.struct(start.alias("first"), (start + size - 1).alias("last"), F.when(level > 0, start + level - 1).alias("level"))


def _stated(text: Column, tokens: Column, shape: Column, form: Column, at: Column) -> Column:
    number = lambda i: F.try_element_at(tokens, F.nullif(i, F.lit(0))).try_cast("double")
    only = lambda kind, column: F.when(form == kind, column)
    primary = number(F.regexp_instr(shape, F.lit("[in]")))
    share = number(F.regexp_instr(shape, F.lit("[in]%")))
    first, last = at["first"], at["last"]
    one, other = number(last - 2), number(last)
    low, high = number(first + 1), number(first + 3)
    sign = F.element_at(tokens, F.nullif(last - 1, F.lit(0)))
    return F.struct(
        F.when(form == "events", number(first)).when(form == "bound", number(last)).otherwise(primary).alias("primary"),
        F.when(form == "spread", other).when(form == "reach", F.abs(high - low) / 2).alias("spread"),
        F.when(form == "spread", "sd").when(form == "reach", F.when(text.rlike("(?i)iqr|median"), "iqr").otherwise("range")).alias("spread_kind"),
        F.when(form == "spread", primary - other).when(form == "reach", low).alias("lower"),
        F.when(form == "spread", primary + other).when(form == "reach", high).alias("upper"),
        only("bound", F.replace(F.replace(sign, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))).alias("operator"),
        only("interval", F.least(one, other)).alias("ci_lower"),
        only("interval", F.greatest(one, other)).alias("ci_upper"),
        only("interval", number(at["level"])).alias("ci_level"),
        only("events", number(first).cast("long")).alias("events"),
        only("events", number(last).cast("long")).alias("total"),
        F.when(form.isin("events", "percentage"), share).alias("pct"),
        form.alias("form"),
    )


def components(cell: Column) -> Column:
    """Which parts besides a leading number a cell states, by name."""
    parts = {
        "operator": cell["operator"], "ci": cell["ci_lower"], "ci_level": cell["ci_level"], "events": cell["events"], "pct": cell["pct"],
        "sd": F.when(cell["spread_kind"] == "sd", cell["spread"]),
    }
    return F.array_compact(F.array(*(F.when(c.isNotNull(), n) for n, c in parts.items())))


def decimal_places(value: Column) -> Column:
    """Digits behind the decimal sign of each number in a text."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"([-+]?\d+(?:[.,]\d+)?)"))
    return F.transform(found, lambda n: F.length(F.regexp_extract(n, r"[.,](\d+)$", 1)))


def coarser(precise: Column, rough: Column, precise_text: Column, rough_text: Column) -> Column:
    """Whether a parsed cell says the same as another with fewer decimals: every stated number, a mean and a standard deviation, agrees once rounded as the rough one is, and one of them has fewer places."""
    some, places = decimal_places(precise_text), decimal_places(rough_text)
    both_sd = (precise["spread_kind"] == "sd") & (rough["spread_kind"] == "sd") & precise["spread"].isNotNull() & rough["spread"].isNotNull()
    pairs = F.when(F.coalesce(both_sd, F.lit(False)), F.array(F.struct(precise["primary"].alias("a"), rough["primary"].alias("b")), F.struct(precise["spread"].alias("a"), rough["spread"].alias("b")))).otherwise(F.array(F.struct(precise["primary"].alias("a"), rough["primary"].alias("b"))))
    indexed = F.transform(pairs, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.try_element_at(some, i + 1).alias("more"), F.try_element_at(places, i + 1).alias("few")))
    # to the even neighbour, on the numbers as they are printed
    same = F.forall(indexed, lambda x: _rounded(x["a"], x["few"]) == _rounded(x["b"], x["few"]))
    enough = (F.size(some) >= F.size(pairs)) & (F.size(places) >= F.size(pairs)) & precise["primary"].isNotNull() & rough["primary"].isNotNull()
    return F.coalesce(enough & same & F.exists(indexed, lambda x: x["few"] < x["more"]), F.lit(False))


def _rounded(value: Column, places: Column) -> Column:
    scaled = value * F.pow(F.lit(10.0), places)
    low = F.floor(scaled)
    rest = scaled - low
    return F.when(F.abs(rest - 0.5) < EPSILON, low + low % 2).when(rest > 0.5, low + 1).otherwise(low)


def implied_pct(cell: Column) -> Column:
    return 100.0 * cell["events"] / F.nullif(cell["total"], F.lit(0))


def self_consistent(cell: Column, tolerance: float) -> Column:
    """A stated percentage agrees with the one that its counts imply; true where either is missing."""
    implied = implied_pct(cell)
    return F.coalesce(F.abs(implied - cell["pct"]) <= F.greatest(F.abs(cell["pct"]), F.lit(EPSILON)) * tolerance, F.lit(True))


def crosses(low: Column, high: Column, null: Column) -> Column:
    return null.between(F.least(low, high), F.greatest(low, high))


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(EPSILON))
