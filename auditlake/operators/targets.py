"""Which of a paper's arms or comparisons a request is about: labels assigned all at once, values held against the labels they stand by.

Assignments are found by a table over subsets of labels, row by row, that keeps the best two of each
subset; so a tie shows, and no permutation is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import bound, flat, matches, quoted, shared_share
from auditlake.operators.cohorts import affinity, slug, telling_tokens
from auditlake.sources.tables import settled

#: Least affinity of a pair that is kept and of either side of a comparison, the least by which the best must lead, characters by which the nearest reading must lead, and arms of a side that are still assigned (fixed values).
LEAST, SIDE, LEAD, GAP, ARMS = 0.34, 0.5, 0.08, 4, 7
#: Cases of arms and labels that are broadcast.
CASES = 1 << 14
#: How far apart a label and a value are of which one isn't there (fixed value).
NOWHERE = 10**6
MATCHING = "array<struct<total:double,cols:array<int>>>"


def best_two(weights: Column, cols: Column, partial: bool) -> Column:
    """The two heaviest ways to give rows different columns, each with its total and the column of each row (-1: none): of weights, rows of one number for each of `cols` columns (seven at most), null where a pair may not be. Where partial, rows may go without; else each row must have a column."""
    both = lambda found: F.slice(F.sort_array(found, asc=False), F.lit(1), F.lit(2))
    none = F.array().cast(MATCHING)
    bit = lambda j: F.call_function("shiftleft", F.lit(1), j)
    masks = F.sequence(F.lit(0), bit(cols) - 1)
    start = F.transform(masks, lambda mask: F.when(mask == 0, F.array(F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("cols"))).cast(MATCHING)).otherwise(none))
    grown = lambda held, j, weight: F.transform(held, lambda x: F.struct((x["total"] + weight).alias("total"), F.concat(x["cols"], F.array(j)).alias("cols")))

    def step(table: Column, row: Column) -> Column:
        def of(mask: Column) -> Column:
            open_to = F.filter(F.sequence(F.lit(0), cols - 1), lambda j: (mask.bitwiseAND(bit(j)) != 0) & F.get(row, j).isNotNull())
            ways = F.flatten(F.transform(open_to, lambda j: grown(F.get(table, mask - bit(j)), j, F.get(row, j))))
            return both(F.concat(ways, grown(F.get(table, mask), F.lit(-1), F.lit(0.0))) if partial else ways)

        return F.transform(masks, of)

    return F.when(cols > 0, both(F.flatten(F.aggregate(weights, start, step)))).otherwise(none)


def assigned(sides: DataFrame, least: float = LEAST, lead: float = LEAD, stated: DataFrame | None = None) -> DataFrame:
    """sides (ours: arms and their labels in order, each once; theirs: labels in order, each once; null: none) with reason and pairs (arm, label), as assign_arms() says. Studies that state the same on both sides are one case, which is worked out once. stated: rows with all cases of sides, where these are made with less work."""
    cases = (sides if stated is None else stated).where("ours is not null and theirs is not null").select("ours", "theirs").distinct()
    few = (F.size("arms") <= ARMS) & (F.size("labels") <= ARMS)
    held = cases.withColumns({"arms": F.array_distinct(F.filter("ours.arm", lambda a: a.isNotNull())), "labels": F.col("theirs")})
    held = held.withColumn("mine", F.when(few, F.transform("ours", lambda o: F.struct(o["arm"].alias("arm"), telling_tokens(o["label"]).alias("words")))))
    held = held.withColumn("words", F.when(few, F.transform("labels", telling_tokens)))
    # an arm's best label counts
    best = lambda a, p: F.array_max(F.transform(F.filter("mine", lambda o: o["arm"] == a), lambda o: shared_share(o["words"], p)))
    weight = lambda a, p: F.get(F.filter(F.array(best(a, p)), lambda x: x >= least), F.lit(0))
    held = held.withColumn("weights", F.when(few, F.transform("arms", lambda a: F.transform("words", lambda p: weight(a, p)))))
    held = held.withColumn("found", F.when(few, best_two(F.col("weights"), F.size("labels"), partial=True)))
    first, second = F.get("found", F.lit(0)), F.get("found", F.lit(1))
    empty = ~F.exists(first["cols"], lambda c: c >= 0)
    rival = F.exists(second["cols"], lambda c: c >= 0) & (first["total"] - second["total"] < lead)
    reason = F.when(~few, "too many arms").when(empty, "no likeness").when(F.coalesce(rival, F.lit(False)), "ambiguous")
    held = held.withColumns({"_reason": reason, "cols": first["cols"]})
    pairs = F.filter(F.transform("arms", lambda a, i: F.struct(a.alias("arm"), F.when(F.get("cols", i) >= 0, F.get("labels", F.get("cols", i))).alias("label"))), lambda x: x["label"].isNotNull())
    told = settled(held.select("ours", "theirs", "_reason", F.when(F.col("_reason").isNull(), pairs).alias("pairs")))
    lone = F.when(F.col("ours").isNull() != F.col("theirs").isNull(), "nothing to assign")
    told = F.broadcast(told) if told.count() <= CASES else told
    return sides.join(told, ["ours", "theirs"], "left").withColumn("reason", F.coalesce("_reason", lone)).drop("_reason")


def assign_arms(review: DataFrame, paper: DataFrame, least: float = LEAST, lead: float = LEAD) -> DataFrame:
    """One paper arm for each arm of a review, all at once. review: study, arm (key), label; paper: study, label.

    Of all one-to-one assignments the one with the largest sum of affinities counts, over its pairs of at least `least`; a study where another one comes within `lead` is refused, as is one with more than seven arms on a side, none on one, or no likeness. Rows study, arm, label, reason: a row for each pair, or one with the reason.
    """
    # a label that is said twice is one, and so is an arm
    ours = review.groupBy("study").agg(F.array_sort(F.collect_set(F.struct("arm", "label"))).alias("ours"))
    theirs = paper.groupBy("study").agg(F.array_sort(F.collect_set("label")).alias("theirs"))
    held = assigned(ours.join(theirs, "study", "full"), least, lead)
    none = F.struct(F.lit(None).cast(review.schema["arm"].dataType).alias("arm"), F.lit(None).cast(paper.schema["label"].dataType).alias("label"))
    return held.select("study", F.explode(F.when(F.col("reason").isNull(), F.col("pairs")).otherwise(F.array(none))).alias("x"), "reason").select("study", "x.arm", "x.label", "reason")


def label_pattern(label: Column) -> Column:
    """What a label is looked for by in flat text: its telling words in their order with at most three signs between, no letter, digit or hyphen touching; null without a telling word."""
    said = F.filter(F.regexp_extract_all(flat(label), F.lit("([a-z0-9]+)")), lambda w: F.array_contains(telling_tokens(label), w))
    return F.when(F.size(said) > 0, F.concat(F.lit("(?<![a-z0-9-])"), F.array_join(F.transform(said, quoted), "[^a-z0-9]{0,3}"), F.lit("(?![a-z0-9-])")))


def masked_spans(text: Column, labels: Column) -> Column:
    """Where each of the labels stands in a flat text (a list of start and end for each): those of the most telling words take their places first, and shorter ones aren't seen inside them."""
    order = F.array_sort(F.transform(labels, lambda label, i: F.struct((-F.size(telling_tokens(label))).alias("n"), i.alias("i"), label_pattern(label).alias("pattern"))))
    spans_type = "array<struct<i:int,spans:array<struct<start:int,end:int>>>>"
    begin = F.struct(text.alias("text"), F.array().cast(spans_type).alias("out"))

    def take(held: Column, label: Column) -> Column:
        def with_found(found: Column) -> Column:
            spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
            # each place is overwritten by as many signs that no label has
            blank = F.aggregate(found, held["text"], lambda t, m: F.concat(F.substring(t, F.lit(1), m["start"]), F.repeat(F.lit("\x00"), m["end"] - m["start"]), F.substring(t, m["end"] + 1, F.length(t))))
            return F.struct(blank.alias("text"), F.concat(held["out"], F.array(F.struct(label["i"].alias("i"), spans.alias("spans"))).cast(spans_type)).alias("out"))

        return bound(F.when(label["pattern"].isNotNull(), matches(held["text"], label["pattern"])).otherwise(F.array().cast("array<struct<start:int,end:int,said:string>>")), with_found)

    return F.array_sort(F.aggregate(order, begin, take)["out"])["spans"]


def anchor(value: Column) -> Column:
    """The first number of a value as it is printed; empty without one."""
    return F.coalesce(F.regexp_substr(value, F.lit("-?[0-9]+(?:[.][0-9]+)?")), F.lit(""))


def value_places(text: Column, value: Column) -> Column:
    """Where a value's number stands in a flat text, as a number of its own."""
    number = anchor(value)
    return F.when(number == "", F.array().cast("array<int>")).otherwise(matches(text, F.concat(F.lit("(?<![0-9.])"), quoted(number), F.lit("(?![0-9])")))["start"])


def apart(spans: Column, places: Column) -> Column:
    """How far the nearest of some places is from the nearest of some spans; 0 inside one."""
    gap = lambda s, p: F.when((s["start"] <= p) & (p <= s["end"]), 0).otherwise(F.least(F.abs(p - s["start"]), F.abs(p - s["end"])))
    return F.coalesce(F.array_min(F.flatten(F.transform(spans, lambda s: F.transform(places, lambda p: gap(s, p))))), F.lit(NOWHERE))


def by_their_labels(rows: DataFrame, text: str, claims: str) -> DataFrame:
    """rows with locality: ok, other (another reading keeps values nearer to their labels) or close (two readings are as near within GAP characters). claims: an array of label and value, seven at most (more: null).

    Of all ways to give the labels the values, the one of the least total distance must be the claimed one. Labels or values that the text doesn't have are left out; fewer than two of them can't be confused.
    """
    known = F.filter(claims, lambda c: (F.coalesce(c["label"], F.lit("")) != "") & (anchor(c["value"]) != ""))
    held = rows.withColumns({"_flat": flat(F.col(text)), "_claims": known})
    held = held.withColumn("_spans", masked_spans(F.col("_flat"), F.col("_claims.label")))
    held = held.withColumn("_places", F.transform("_claims", lambda c: value_places(F.col("_flat"), c["value"])))
    both = F.filter(F.arrays_zip(F.col("_spans").alias("s"), F.col("_places").alias("p")), lambda x: (F.size(x["s"]) > 0) & (F.size(x["p"]) > 0))
    held = held.withColumn("_both", both)
    n = F.size("_both")
    # the heaviest way of negative distances is the nearest one
    held = held.withColumn("_cost", F.when(n.between(2, ARMS), F.transform("_both", lambda x: F.transform("_both", lambda y: -apart(x["s"], y["p"]).cast("double")))))
    held = held.withColumn("_best", F.when(F.col("_cost").isNotNull(), best_two(F.col("_cost"), n, partial=False)))
    mine = F.aggregate(F.transform("_cost", lambda row, i: F.get(row, i)), F.lit(0.0), lambda a, x: a + x)
    first, second = F.get("_best", F.lit(0))["total"], F.get("_best", F.lit(1))["total"]
    verdict = F.when(n < 2, "ok").when(n > ARMS, None).when(mine < first, "other").when(first - second < GAP, "close").otherwise("ok")
    return held.withColumn("locality", verdict).drop("_flat", "_claims", "_spans", "_places", "_both", "_cost", "_best")


def resolve_arms(requests: DataFrame, review: DataFrame, arms: DataFrame) -> DataFrame:
    """Which arm of its paper a request (id, study, target, quote) is about, and what that arm reported. review: study, arm, label; arms: study, pos, label, value, unit, quote, of one field.

    id, status, paper_label, value, unit, quote and rivals (values of the other arms): ok; not_reported where the paper names no arm, none that matches or no value for it; unsupported where the review has no label for the target; ambiguous where the labels can't be assigned; inconsistent where the quote (the request's, else the arm's) has another value nearer to the arm.
    """
    named = review.where("trim(label) <> ''")
    known = requests.select("study").distinct()
    assigned = assign_arms(named.join(known, "study", "left_semi"), arms.join(known, "study", "left_semi").select("study", "label"))
    mapping = assigned.groupBy("study").agg(F.max("reason").alias("why"), F.map_from_entries(F.collect_list(F.when(F.col("reason").isNull(), F.struct("arm", "label")))).alias("mapping"))
    listed = arms.groupBy("study").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "value", "unit", "quote"))).alias("arms"))
    labels = named.select("study", F.col("arm").alias("target"), F.lit(True).alias("known")).distinct()
    held = requests.join(listed, "study", "left").join(mapping, "study", "left").join(labels, ["study", "target"], "left")
    held = held.withColumn("paper_label", F.try_element_at("mapping", F.col("target")))
    held = held.withColumn("mine", F.get(F.filter("arms", lambda a: a["label"] == F.col("paper_label")), F.lit(0)))
    said = F.transform(F.filter("arms", lambda a: F.coalesce(a["value"], F.lit("")) != ""), lambda a: F.struct(a["label"].alias("label"), a["value"].alias("value")))
    held = held.withColumns({"said": F.coalesce(said, F.array().cast("array<struct<label:string,value:string>>")), "where": F.coalesce(F.nullif(F.col("quote"), F.lit("")), F.col("mine.quote"), F.lit(""))})
    held = by_their_labels(held, "where", "said")
    status = (
        F.when(F.col("arms").isNull(), "not_reported").when(F.col("known").isNull(), "unsupported").when(F.col("why").isNotNull(), "ambiguous").when(F.col("paper_label").isNull(), "not_reported")
        .when(F.col("mine.value").isNull(), "not_reported").when(F.coalesce(F.col("locality"), F.lit("close")) != "ok", "inconsistent").otherwise("ok")
    )
    held = held.withColumn("status", status)
    ok = F.col("status") == "ok"
    rivals = F.transform(F.filter("arms", lambda a: (a["pos"] != F.col("mine.pos")) & (F.coalesce(a["value"], F.lit("")) != "")), lambda a: a["value"])
    return held.select("id", "status", F.when(F.col("status").isin("ok", "inconsistent") | F.col("mine").isNotNull() & (F.col("status") == "not_reported"), F.col("paper_label")).alias("paper_label"), *(F.when(ok, F.col(f"mine.{c}")).alias(c) for c in ("value", "unit", "quote")), F.when(ok, rivals).alias("rivals"))


def side_score(side: Column, label: Column, other: Column) -> Column:
    """How well a side of a comparison fits an arm's label; half as well where the label has the words that only the other side brings."""
    brought = F.array_except(telling_tokens(other), telling_tokens(side))
    taken = (F.size(brought) > 0) & (F.size(F.array_except(brought, telling_tokens(label))) == 0)
    score = affinity(side, label)
    return F.when(taken, score / 2).otherwise(score)


def resolve_sides(requests: DataFrame, review: DataFrame, lead: float = LEAD) -> DataFrame:
    """The review's labels for both sides of a comparison, found together: requests (id, study, left, right) with left_label and right_label, or why not (too few arms, too many arms, no two arms, no likeness, ambiguous). A side that is an arm's key is that arm."""
    arms = review.where("trim(label) <> ''").groupBy("study").agg(F.array_sort(F.collect_list(F.struct("arm", "label"))).alias("arms"))
    held = requests.join(arms, "study", "left")
    n = F.coalesce(F.size("arms"), F.lit(0))
    few = n.between(2, ARMS)
    keyed = lambda side: F.get(F.filter("arms", lambda a: slug(a["arm"].cast("string")) == slug(F.col(side))), F.lit(0))["label"]
    held = held.withColumns({"left_pin": F.when(few, keyed("left")), "right_pin": F.when(few, keyed("right"))})
    labels = lambda pin: F.when(few, F.filter("arms", lambda a: F.col(pin).isNull() | (a["label"] == F.col(pin))))
    scored = lambda side, other, pin: F.transform(labels(pin), lambda a: F.struct(a["arm"].alias("arm"), a["label"].alias("label"), side_score(F.col(side), a["label"], F.col(other)).alias("score")))
    held = held.withColumns({"lefts": scored("left", "right", "left_pin"), "rights": scored("right", "left", "right_pin")})
    pair = lambda x, y: F.struct((x["score"] + y["score"]).alias("score"), x["label"].alias("left"), y["label"].alias("right"), (x["arm"] != y["arm"]).alias("two"))
    pairs = F.filter(F.flatten(F.transform("lefts", lambda x: F.transform("rights", lambda y: pair(x, y)))), lambda p: p["two"])
    held = held.withColumn("pairs", F.slice(F.sort_array(pairs, asc=False), 1, 2))
    best, second = F.get("pairs", F.lit(0)), F.get("pairs", F.lit(1))
    why = (
        F.when(n < 2, "too few arms").when(n > ARMS, "too many arms").when(F.size("pairs") == 0, "no two arms").when(best["score"] <= 0, "no likeness")
        .when(F.coalesce(best["score"] - second["score"] < lead, F.lit(False)), "ambiguous")
    )
    held = held.withColumns({"why": why, "best": best})
    return held.select(*requests.columns, *(F.when(F.col("why").isNull(), F.col(f"best.{s}")).alias(f"{s}_label") for s in ("left", "right")), "why")


def resolve_comparisons(requests: DataFrame, review: DataFrame, comparisons: DataFrame, lead: float = LEAD) -> DataFrame:
    """Which comparison of its paper a request (id, study, left, right) is about, in its direction. comparisons: study, pos, left_label, right_label, value.

    id, status, paper_label, value and rivals: ok; not_reported where the paper has none, none that fits (SIDE on either side) or no value for it; unsupported where the sides aren't two arms of the review; direction_inverted where the other direction fits better, as its number is another one; ambiguous where two fit within `lead`.
    """
    listed = comparisons.groupBy("study").agg(F.array_sort(F.collect_list(F.struct("pos", "left_label", "right_label", "value"))).alias("all"))
    held = resolve_sides(requests, review).join(listed, "study", "left")
    held = held.withColumns({f"{s}_words": telling_tokens(F.col(f"{s}_label")) for s in ("left", "right")})

    def score(left: Column, right: Column, c: Column) -> Column:
        a, b = shared_share(left, telling_tokens(c["left_label"])), shared_share(right, telling_tokens(c["right_label"]))
        return F.when(F.least(a, b) < SIDE, 0.0).otherwise(a + b)

    ranked = lambda left, right: F.sort_array(F.transform("all", lambda c: F.struct(score(F.col(left), F.col(right), c).alias("score"), (-c["pos"]).alias("first"), c["left_label"].alias("l"), c["right_label"].alias("r"), c["value"].alias("value"))), asc=False)
    held = held.withColumns({"direct": ranked("left_words", "right_words"), "turned": ranked("right_words", "left_words")})
    best, second, turned = F.get("direct", F.lit(0)), F.coalesce(F.get("direct", F.lit(1))["score"], F.lit(0.0)), F.get("turned", F.lit(0))["score"]
    status = (
        F.when(F.col("all").isNull(), "not_reported").when(F.col("why").isNotNull(), "unsupported").when((best["score"] <= 0) & (turned > 0), "direction_inverted").when(best["score"] <= 0, "not_reported")
        .when(best["score"] - second < lead, "ambiguous").when(turned > best["score"], "direction_inverted").when(best["value"].isNull(), "not_reported").otherwise("ok")
    )
    held = held.withColumns({"status": status, "best": best})
    ok = F.col("status") == "ok"
    rivals = F.transform(F.filter("all", lambda c: (c["pos"] != -F.col("best.first")) & (F.coalesce(c["value"], F.lit("")) != "")), lambda c: c["value"])
    return held.select("id", "status", F.when(ok, F.concat_ws(" vs ", "best.l", "best.r")).alias("paper_label"), F.when(ok, F.col("best.value")).alias("value"), F.when(ok, rivals).alias("rivals"))
