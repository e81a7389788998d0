"""Scorecards, their aggregation, comparison with a baseline under guardrails, and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("boundary_f1_20ms", "boundary_f1_50ms", "micro_ipus_per_min", "switches_per_min")
# fixed values of the guardrails
DROP, EASY_FACTOR, SUSPICIOUS_FACTOR, FLOOR, MOVED = -0.01, 1.25, 1.5, 1e-9, 1e-9


def by_tier(scorecard: DataFrame, metrics: tuple[str, ...] = METRICS, ok_only: bool = False) -> DataFrame:
    """tier (null: all), n and the mean of each metric; failed items count as 0 unless ok_only."""
    rows = scorecard.where("status = 'ok'") if ok_only else scorecard
    return rows.rollup("tier").agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics))


def with_failures(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per item of manifest(id, tier); items without a row failed, with zeros."""
    return manifest.join(rows, "id", "left").select("id", F.coalesce("tier", F.lit("unknown")).alias("tier"), F.when(F.col(METRICS[0]).isNull(), "failed").otherwise("ok").alias("status"), *(F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in rows.columns if m != "id"))


def latest(scorecard: DataFrame, order: Column) -> DataFrame:
    """The ok rows, the last per id by order."""
    ok = scorecard.where(F.coalesce("status", F.lit("ok")) == "ok")
    return ok.withColumn("ev__n", F.row_number().over(W.partitionBy("id").orderBy(order.desc()))).where("ev__n = 1").drop("ev__n")


def deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Items in both: id, tier and per metric baseline, current and delta."""
    b = baseline.select("id", F.col("tier").alias("b_tier"), *(F.coalesce(F.col(m), F.lit(0.0)).alias(f"{m}_baseline") for m in METRICS))
    c = current.select("id", F.col("tier").alias("c_tier"), *(F.coalesce(F.col(m), F.lit(0.0)).alias(f"{m}_current") for m in METRICS))
    both = b.join(c, "id").withColumn("tier", F.coalesce("c_tier", "b_tier", F.lit("unknown")))
    return both.select("id", "tier", *(x for m in METRICS for x in (F.col(f"{m}_baseline"), F.col(f"{m}_current"), (F.col(f"{m}_current") - F.col(f"{m}_baseline")).alias(f"{m}_delta"))))


def findings(delta: DataFrame, params_changed: bool) -> DataFrame:
    """id, kind ("failure" or "warning"), rule, of what the guardrails say; id is null for the corpus as a whole."""
    grew = lambda m, by: F.col(f"{m}_current") > F.greatest(F.col(f"{m}_baseline"), F.lit(FLOOR)) * F.lit(by)
    easy, hard = F.col("tier") == "easy", F.col("tier") == "hard"
    rules = [
        ("failure", "boundary_f1_20ms drop", easy & (F.col("boundary_f1_20ms_delta") < DROP)),
        ("failure", "boundary_f1_50ms drop", easy & (F.col("boundary_f1_50ms_delta") < DROP)),
        ("failure", "switches_per_min increase", easy & grew("switches_per_min", EASY_FACTOR)),
        ("failure", "micro_ipus_per_min increase", easy & grew("micro_ipus_per_min", EASY_FACTOR)),
        ("warning", "suspicious improvement", hard & (F.col("boundary_f1_20ms_delta") > 0) & (grew("switches_per_min", SUSPICIOUS_FACTOR) | grew("micro_ipus_per_min", SUSPICIOUS_FACTOR))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"))) for kind, rule, test in rules]))
    out = delta.select("id", F.explode(found).alias("f")).select("id", "f.kind", "f.rule")
    if not params_changed:
        moved = F.greatest(*[F.max(F.abs(F.col(f"{m}_delta"))) for m in METRICS])
        out = out.unionByName(delta.agg(moved.alias("m")).where(F.col("m") > MOVED).select(F.lit(None).cast(delta.schema["id"].dataType).alias("id"), F.lit("failure").alias("kind"), F.lit("UNEXPLAINED").alias("rule")))
    return out


def delta_summary(delta: DataFrame) -> DataFrame:
    """Mean deltas per tier; null is all."""
    return delta.rollup("tier").agg(F.count("*").alias("n"), *(F.avg(f"{m}_delta").alias(f"{m}_delta") for m in METRICS))


def changed_params(baseline: dict, current: dict) -> dict[str, tuple]:
    return {k: (baseline.get(k), current.get(k)) for k in sorted({*baseline, *current}) if baseline.get(k) != current.get(k)}


def board_row(candidate: int, delta: DataFrame, digits: int | None = None) -> DataFrame:
    """A candidate's row of the leaderboard, from its deltas; a tier without items counts as no change."""
    fine = lambda c: c if digits is None else F.round(c, digits) + F.lit(0.0)
    mean = lambda tier, m: F.coalesce(F.avg(F.when(F.col("tier") == tier, F.col(f"{m}_delta"))), F.lit(0.0))
    return delta.agg(F.lit(candidate).alias("candidate"), fine(mean("hard", "micro_ipus_per_min")).alias("hard_micro_ipus_per_min_delta"), fine(mean("easy", "boundary_f1_20ms")).alias("easy_boundary_f1_20ms_delta"), fine(F.avg("switches_per_min_delta")).alias("switches_per_min_delta"))


def leaderboard(candidates: DataFrame) -> DataFrame:
    """candidates(candidate, hard_micro_ipus_per_min_delta, easy_boundary_f1_20ms_delta, switches_per_min_delta) with place,
    from 1: by the first, the size of the second, the third, then candidate. A candidate is one run of a grid, so few."""
    order = W.orderBy("hard_micro_ipus_per_min_delta", F.abs(F.col("easy_boundary_f1_20ms_delta")), "switches_per_min_delta", "candidate")
    return candidates.withColumn("place", F.row_number().over(order))


def suite(manifest: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Items of manifest(id, tier), all or those whose id, or tier in lower case, is wanted, in order of tier and id."""
    if wanted:
        low = [w.strip().lower() for w in wanted]
        manifest = manifest.where(F.col("id").cast("string").isin(*wanted) | F.lower("tier").isin(*low))
    return manifest.orderBy("tier", F.col("id").cast("string"))


#: Items (id, tier, scenario) of the suites that have a name.
SUITES = {"week1": (("synthetic_leakage", "synthetic", "leakage_stress"),)}


def named_suite(spark: SparkSession, name: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    items = SUITES.get(name.strip().lower())
    if items is None:
        raise ValueError(f"unknown suite {name!r}")
    return suite(spark.createDataFrame(list(items), "id string, tier string, scenario string"), wanted)
