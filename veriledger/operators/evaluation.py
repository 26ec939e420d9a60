"""Independent evaluators. They share no code with the signals that they judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.errors import GroundingEvaluationError, TopologyEvaluationError
from veriledger.functions.scalars import ratio
from veriledger.sources.corpus import read_corpus

TOLERANCE = 1e-9


#: Devices of an account up to which its combinations of devices are counted.
MOST_COMBINED = 5


def device_overlap(account_devices: DataFrame, accounts: DataFrame, *, most_combined: int = MOST_COMBINED) -> DataFrame:
    """(account_id, shared_device_account_count), without pairs of accounts where accounts have few devices.

    How many accounts hold every device of a combination is counted for all combinations of an account's devices; it meets those of its odd combinations less those of its even ones.
    Accounts with more than most_combined devices meet their partners one by one, and are added to those of the others.
    """
    known = account_devices.where("account_id IS NOT NULL AND device_id IS NOT NULL").select("account_id", "device_id")
    owned = known.groupBy("account_id").agg(F.sort_array(F.collect_set("device_id")).alias("own"))
    few, many = owned.where(F.size("own") <= most_combined), owned.where(F.size("own") > most_combined)
    # the bits of `held` say which devices are in a combination
    combined = few.withColumn("held", F.explode(F.sequence(F.lit(1), F.expr("CAST(shiftleft(1, size(own)) - 1 AS INT)"))))
    combined = combined.select("account_id", F.expr("filter(own, (d, i) -> (shiftright(held, i) & 1) = 1)").alias("combination"), F.expr("IF(bit_count(held) % 2 = 1, 1, -1)").alias("sign"))
    holders = combined.groupBy("combination").agg(F.count("*").alias("holders"))
    counted = combined.join(holders, "combination").groupBy("account_id").agg((F.sum(F.col("sign") * F.col("holders")) - 1).alias("n"))
    of_many = many.select("account_id", F.explode("own").alias("device_id"))
    met = of_many.join(known.withColumnRenamed("account_id", "partner"), "device_id").where("partner <> account_id").select("account_id", "partner").distinct()
    # a partner with many devices has a row of its own for the same pair
    both = met.union(met.join(few.select(F.col("account_id").alias("partner")), "partner", "left_semi").select("partner", "account_id"))
    met_by = both.groupBy("account_id").agg(F.count("*").alias("n"))
    n = counted.union(met_by).groupBy("account_id").agg(F.sum("n").alias("n"))
    return accounts.select("account_id").join(n, "account_id", "left").select("account_id", F.coalesce("n", F.lit(0).cast("long")).alias("shared_device_account_count"))


def clustering_by_probe(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, local_clustering_coefficient): of all pairs of neighbours, how many have an edge in either direction."""
    ends = transfers.select(F.col("src").alias("v"), F.col("dst").alias("w")).where("v <> w")
    near = ends.union(ends.select("w", "v")).toDF("v", "w").distinct()
    pairs = near.join(near.select("v", F.col("w").alias("x")), "v").where("w < x")
    asked = pairs.withColumn("linked", F.lit(1))
    there = ends.select(F.least("v", "w").alias("w"), F.greatest("v", "w").alias("x")).distinct()
    linked = asked.join(there, ["w", "x"], "left_semi").groupBy("v").agg(F.count("*").alias("linked"))
    total = near.groupBy("v").agg(F.count("*").alias("k"))
    rate = total.join(linked, "v", "left").select(F.col("v").alias("account_id"), ratio(F.coalesce("linked", F.lit(0)) * 2.0, F.col("k") * (F.col("k") - 1), 0.0).alias("c"))
    return accounts.select("account_id").join(rate, "account_id", "left").select("account_id", F.coalesce("c", F.lit(0.0)).alias("local_clustering_coefficient"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, tn, fn, total, precision and recall (1 when nothing counts), f1 (0 when both are), accuracy (1 on no rows)."""
    t, p = F.coalesce(F.expr(truth), F.lit(False)), F.coalesce(F.expr(predicted), F.lit(False))
    counts = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    rated = counts.withColumn("total", F.expr("tp + fp + tn + fn")).withColumn("precision", ratio(F.col("tp"), F.expr("tp + fp"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.expr("tp + fn"), 1.0))
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.expr("precision + recall"), 0.0)).withColumn("accuracy", ratio(F.expr("tp + tn"), F.col("total"), 1.0))


def discrepancies(measured: DataFrame, ledger) -> DataFrame:
    """(account_id, metric, reported, recomputed) where a signal and its independent recount differ."""
    again = clustering_by_probe(ledger.transfers, ledger.accounts).join(device_overlap(ledger.account_devices, ledger.accounts), "account_id")
    again = again.toDF("account_id", "c2", "d2")
    both = measured.select("account_id", "local_clustering_coefficient", "shared_device_account_count").join(again, "account_id")
    value = lambda c: F.col(c).cast("double")
    pairs = F.array(*[
        F.when(F.abs(value(a) - value(b)) > limit, F.struct(F.lit(a).alias("metric"), value(a).alias("reported"), value(b).alias("recomputed")))
        for a, b, limit in (("local_clustering_coefficient", "c2", TOLERANCE), ("shared_device_account_count", "d2", 0.0))
    ])
    return both.select("account_id", F.inline(F.array_compact(pairs)))


def topology_report(decided: DataFrame, ledger) -> tuple[DataFrame, DataFrame]:
    """(one row of confusion counts, rates and the largest errors; the discrepancies). Truth: accounts of type LAYERING.

    Raises if nothing was decided or an account is unknown to the ledger.
    """
    if decided.isEmpty():
        raise TopologyEvaluationError("no decisions to evaluate")
    if not decided.join(ledger.accounts, "account_id", "left_anti").isEmpty():
        raise TopologyEvaluationError("a decision names an account that the ledger lacks")
    truth = decided.join(ledger.accounts.select("account_id", "account_type"), "account_id")
    found = discrepancies(decided, ledger)
    errors = found.withColumn("error", F.abs(F.col("reported") - F.col("recomputed"))).agg(
        F.coalesce(F.max(F.when(F.col("metric") == "local_clustering_coefficient", F.col("error"))), F.lit(0.0)).alias("max_clustering_error"),
        F.coalesce(F.max(F.when(F.col("metric") == "shared_device_account_count", F.col("error"))), F.lit(0.0)).alias("max_device_error"),
        (F.count("*") == 0).alias("has_zero_degradation"),
    )
    return confusion(truth, "account_type = 'LAYERING'", "verdict = 'FLAGGED'").join(errors), found


def grounding_details(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """cited (with citation_id, text) and status: verified, text_mismatch or citation_id_not_in_corpus.

    corpus: citation_id, text, ordinal; of a repeated citation_id the last counts.
    """
    last = corpus.groupBy("citation_id").agg(F.max_by("text", "ordinal").alias("_text"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "citation_id_not_in_corpus").when(F.col("text").eqNullSafe(F.col("_text")), "verified").otherwise("text_mismatch")
    return cited.join(last, "citation_id", "left").withColumn("status", status).drop("_text", "_known")


def grounding_report(details: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: total, verified, hallucinated, precision (1 when nothing is cited), distinct ids verified and the corpus's share covered."""
    ok = F.col("status") == "verified"
    counts = details.agg(
        F.count("*").alias("total_citations"), F.count_if(ok).alias("verified_citations"), F.count_if(~ok).alias("hallucinated_citations"), F.count_distinct(F.when(ok, F.col("citation_id"))).alias("distinct_verified"),
    )
    size = corpus.agg(F.count_distinct("citation_id").alias("corpus_citations"))
    return counts.join(size).select(
        "*", ratio(F.col("verified_citations"), F.col("total_citations"), 1.0).alias("precision"), ratio(F.col("distinct_verified"), F.col("corpus_citations"), 0.0).alias("coverage"),
        (F.col("hallucinated_citations") == 0).alias("is_fully_grounded"),
    )


def evaluate_grounding(grounded: DataFrame, corpus: DataFrame) -> DataFrame:
    """The report of retrieval results (account_id, provisions with citation_id and text); raises if there are no results."""
    if grounded.isEmpty():
        raise GroundingEvaluationError("no retrieval results to evaluate")
    cited = grounded.select("account_id", F.inline("provisions"))
    return grounding_report(grounding_details(cited, corpus), corpus)


def evaluate_grounding_of(grounded: DataFrame, folder: str) -> DataFrame:
    """evaluate_grounding() against the provision files as they are now, read again and apart from any index."""
    return evaluate_grounding(grounded, read_corpus(grounded.sparkSession, folder).provisions)


def classify_outcomes(cases: DataFrame, defined: tuple[str, ...]) -> DataFrame:
    """cases (case_id, exception_type, expected_outcome) with outcome (typed_error, untyped_error, no_error) and is_known_gap."""
    outcome = F.when(F.col("exception_type").isNull(), "no_error").when(F.col("exception_type").isin(*defined), "typed_error").otherwise("untyped_error")
    return cases.withColumn("outcome", outcome).withColumn("is_known_gap", F.col("outcome") != F.col("expected_outcome"))
