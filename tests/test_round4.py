"""What larger tables brought to light: rows that are made many of and broadcast, tables of claims that are laid down twice."""

from auditlake.operators import identity, lookup
from auditlake.plans import lookup as plans
from auditlake.plans import review


def test_blocks_of_labels_are_never_broadcast(spark, sf):
    # a table of 60,000 rows in 276 kB has 2.5 million blocks, which the driver can't hold
    lines = review.study_relabel(spark, sf)._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not any("Broadcast" in line and "block" in line for line in lines)
    assert any("SortMergeJoin" in line and "block" in line for line in lines)
    names = spark.createDataFrame([(1, "Berg 2001"), (2, "Berg and Lund 2001"), (3, "Moe 1999")], "key int, label string")
    asked = spark.createDataFrame([(10, "berg 2001"), (11, "Lund 2001"), (12, "Berg"), (13, "Moe 2001")], "key int, label string")
    got = {r.query: (r.candidate, r.reason) for r in identity.best_identity(asked, names, "key", "label").collect()}
    assert got == {10: (1, "exact"), 11: (2, "only"), 12: (None, "ambiguous"), 13: (None, "none")}


def test_claims_are_laid_down_once_and_without_what_they_say(spark, sf, monkeypatch):
    laid, settle, cleaned = [], lookup.settled, []
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)

    def settled(df):
        laid.append(set(df.columns))
        cleaned.append(spark.conf.get(name, None))
        return settle(df)

    monkeypatch.setattr(lookup, "settled", settled)
    plans.source_cells(spark, sf)
    assert not any("claim" in x and x & {"names", "variants", "group", "matched"} for x in laid)
    assert sum({"claim", "fields"} <= x and "col" not in x for x in laid) == 1
    # queries take their shuffle files with them, and the session is as it was
    assert set(cleaned) == {"true"} and spark.conf.get(name, None) == before
