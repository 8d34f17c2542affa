"""Checks on written answers: grounding, rubric scores, request metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that reach for an unvalidated capability, and phrases that state the boundary.
TRIGGERS = (
    "real damage", "real hole", "real tear", "actual damage", "in production", "in the field", "deploy", "trust it",
    "accuracy on real", "catch a hole", "miss a hole", "find damage", "real net damage", "would it detect", "real net",
    "real fish farm", "different site", "another site", "different farm", "another farm", "our nets", "our site", "our farm",
    "different fish farm", "other sites", "different camera", "different rov", "different season", "new site",
)
CAVEATS = (
    "synthetic", "not measured", "not been measured", "unvalidated", "not validated", "no real damage", "undamaged", "proxy",
    "cannot claim", "has not been evaluated", "real labelled damage", "real labeled damage",
)
ARTIFACT_ROOTS = ("reports/results/", "data/processed/")


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    """Whether any of some literal phrases occurs, whatever the case."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def cited_artifacts(text: Column, roots: Sequence[str] = ARTIFACT_ROOTS) -> Column:
    """Distinct artifact paths named in a text, cleaned of surrounding punctuation."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[`,.()\[\]'\"]+|[`,.()\[\]'\"]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.exists(F.array(*[F.lit(r) for r in roots]), lambda r: F.contains(w, r))))


def check_grounding(
    answers: DataFrame, triggers: Sequence[str] = TRIGGERS, caveats: Sequence[str] = CAVEATS
) -> DataFrame:
    """Adds whether the question touches an unvalidated capability, the answer states the boundary, and the caveat is missing."""
    return answers.withColumns({
        "touches_unvalidated": mentions(F.col("question"), triggers), "states_boundary": mentions(F.col("answer"), caveats),
    }).withColumn("missing_caveat", F.col("touches_unvalidated") & ~F.col("states_boundary"))


def score_answers(answers: DataFrame, rubric: DataFrame, missing_markers: Sequence[str], caveats: Sequence[str] = CAVEATS) -> DataFrame:
    """One row per answer: the outcome of every check that applies (NULL otherwise), failures and verdict.

    ``answers``: ``id, answer, tools_used``. ``rubric``: ``id, must_caveat, must_use_tool,
    must_cite_artifact, must_admit_missing, must_mention, must_mention_any, must_not_mention``.
    Answers without a rubric entry do not appear; saved answers are scored the same way again.
    """
    joined = answers.join(rubric, "id")
    low = F.lower("answer")
    has = lambda p: F.contains(low, F.lower(p))
    checks = {
        "states_boundary": F.when(F.col("must_caveat"), mentions(F.col("answer"), caveats)),
        "used_tool": F.when(F.col("must_use_tool"), F.size("tools_used") > 0),
        "cited_artifact": F.when(F.col("must_cite_artifact"), F.size(cited_artifacts(F.col("answer"))) > 0),
        "admitted_missing": F.when(F.col("must_admit_missing"), mentions(F.col("answer"), missing_markers)),
        "mentions_all": F.when(F.size("must_mention") > 0, F.forall("must_mention", has)),
        "mentions_any": F.when(F.size("must_mention_any") > 0, F.exists("must_mention_any", has)),
        "avoids_all": F.when(F.size("must_not_mention") > 0, ~F.exists("must_not_mention", has)),
    }
    scored = joined.withColumns(checks)
    failed = F.filter(F.array(*[F.when(~F.col(c), c) for c in checks]), lambda c: c.isNotNull())
    return scored.withColumn("failed_checks", failed).withColumn("passed", F.size("failed_checks") == 0)


def rubric_rates(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("passed").alias("passed"), share("passed").alias("pass_rate"),
        share("states_boundary").alias("boundary_disclosure_rate"), share("used_tool").alias("tool_grounding_rate"))


def request_metrics(requests: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Requests, errors and mean latency per key; batch or streaming."""
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("error").cast("bigint")).alias("errors"),
        F.round(F.avg("latency_ms"), 2).alias("latency_ms_avg"))


def inference_counts(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("method").isNotNull()).groupBy("method").agg(F.count(F.lit(1)).alias("inferences"))
