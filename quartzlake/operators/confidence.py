"""Data confidence: twelve components, a weighted score, readiness flags, and the full-day scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.config import DEFAULT, Thresholds

# The components with their weights (100 in sum), and what a status is worth.
WEIGHTS = {
    "price_availability": 15, "price_source_validation": 10, "volume_availability": 10, "history_sufficiency": 8, "kap_check": 8, "news_check": 6,
    "corporate_check": 7, "restriction_check": 7, "symbol_verification": 8, "data_freshness": 8, "anomaly_count": 8, "critical_fields": 5,
}
COEFFICIENTS = {"OK": 1.0, "UNVERIFIED": 0.5, "STALE": 0.5, "MISSING": 0.0, "FAILED": 0.0}
MISSING_CAP, CRITICAL_CAP = 99, 60
# Spellings of check results.
DONE, PENDING, ERROR = ("COMPLETED", "OK", "DONE"), ("PENDING", "IN_PROGRESS", "INCOMPLETE", "PARTIAL"), ("ERROR", "FAILED")
SOURCE_OK, SOURCE_PENDING, SOURCE_BAD = ("VALIDATED", "OK", "MATCH", "WITHIN_TOLERANCE"), ("PENDING", "NOT_RUN", "INCOMPLETE", "SKIPPED"), ("DIVERGED", "MISMATCH", "OUT_OF_TOLERANCE", "FAILED", "ERROR")
# Readiness conditions and the columns that hold them.
CONDITIONS = {
    "SYMBOL_NOT_VERIFIED": "symbol_verified", "NOT_XK100_MEMBER": "xk100_member", "VALID_PRICE_MISSING": "has_valid_price", "VALID_VOLUME_MISSING": "has_valid_volume",
    "LAST_TRADE_DATE_MISSING": "has_last_trade_date", "KAP_CHECK_NOT_OK": "kap_check_ok", "NEWS_CHECK_NOT_OK": "news_check_ok", "CORPORATE_CHECK_NOT_OK": "corporate_check_ok",
    "RESTRICTION_CHECK_NOT_OK": "restriction_check_ok", "SOURCE_VALIDATION_NOT_OK": "source_validation_ok", "SUFFICIENCY_LABEL_MISSING": "sufficiency_label_present",
}


def _check(status: Column, failed_if: Column | None = None) -> Column:
    s = F.upper(F.trim(status))
    done = F.lit("OK") if failed_if is None else F.when(failed_if, "FAILED").otherwise("OK")
    return F.when(s.isNull() | (s == ""), "MISSING").when(s.isin(*DONE), done).when(s.isin(*PENDING), "UNVERIFIED").when(s.isin(*ERROR), "FAILED").otherwise("UNVERIFIED")


def component_statuses(as_of, limits: Thresholds = DEFAULT) -> dict[str, Column]:
    """Status column of each component over the component inputs."""
    c, label, source = F.col, F.col("sufficiency_label"), F.upper(F.trim("source_validation"))
    age = F.date_diff(F.lit(as_of).cast("date"), "last_data_date")
    return {
        "price_availability": F.when(c("last_price").isNull(), "MISSING").when(c("last_price") <= 0, "FAILED").otherwise("OK"),
        "price_source_validation": F.when(source.isNull(), "MISSING").when(source.isin(*SOURCE_OK), "OK").when(source.isin(*SOURCE_PENDING), "UNVERIFIED").when(source.isin(*SOURCE_BAD), "FAILED").otherwise("UNVERIFIED"),
        "volume_availability": F.when(c("volume").isNull(), "MISSING").when(c("volume") < 0, "FAILED").when(c("volume") == 0, "UNVERIFIED").otherwise("OK"),
        "history_sufficiency": F.when(label.isNull() | (label == "PRICE_DATA_MISSING"), "MISSING").when(label == "SUFFICIENT_DATA", "OK").when(label == "INSUFFICIENT_FOR_TECHNICAL", "FAILED").otherwise("UNVERIFIED"),
        "kap_check": F.when(~c("kap_required"), "NOT_APPLICABLE").otherwise(_check(c("kap_status"))),
        "news_check": _check(c("news_status")),
        "corporate_check": _check(c("corporate_status")),
        "restriction_check": _check(c("restriction_status"), c("trading_halt_active")),
        "symbol_verification": F.when(c("verification_status").isNull(), "MISSING").when(c("verification_status") == "VERIFIED", "OK").when(c("verification_status") == "SYMBOL_VERIFICATION_PENDING", "UNVERIFIED").otherwise("FAILED"),
        "data_freshness": F.when(age.isNull(), "MISSING").when(age > limits.stale_data_days, "STALE").otherwise("OK"),
        "anomaly_count": F.when(c("anomaly_count").isNull(), "MISSING").when((c("anomaly_count") < 0) | (c("anomaly_count") >= limits.anomaly_limit), "FAILED").otherwise("OK"),
        "critical_fields": F.when(c("critical_missing").isNull(), "MISSING").when(F.size("critical_missing") == 0, "OK").otherwise("FAILED"),
    }


def evaluate(inputs: DataFrame, as_of, limits: Thresholds = DEFAULT) -> DataFrame:
    """inputs with `components`, an array of (name, status) in fixed order."""
    return inputs.withColumn("components", F.array(*[F.struct(F.lit(n).alias("name"), s.alias("status")) for n, s in component_statuses(as_of, limits).items()]))


def names_with(status: str) -> Column:
    return F.transform(F.filter("components", lambda x: x["status"] == status), lambda x: x["name"])


def confidence(weights: dict[str, float] = WEIGHTS) -> Column:
    """0 to 100: weighted mean over the components that apply, half-even, at most 99 with a missing and 60 with a critical one."""
    validate_weights(weights)
    weight = F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, float(w))])
    worth = F.create_map(*[F.lit(x) for kv in COEFFICIENTS.items() for x in kv])
    active = F.filter("components", lambda x: x["status"] != "NOT_APPLICABLE")
    total = F.aggregate(active, F.lit(0.0), lambda acc, x: acc + weight[x["name"]])
    earned = F.aggregate(active, F.lit(0.0), lambda acc, x: acc + weight[x["name"]] * worth[x["status"]])
    score = F.bround(F.coalesce(F.try_divide(earned, total) * 100, F.lit(100.0)), 0).cast("int")
    score = F.when(F.exists("components", lambda x: x["status"] == "MISSING"), F.least(score, F.lit(MISSING_CAP))).otherwise(score)
    critical = F.exists("components", lambda x: (x["name"] == "critical_fields") & (x["status"] == "FAILED"))
    return F.greatest(F.lit(0), F.when(critical, F.least(score, F.lit(CRITICAL_CAP))).otherwise(score))


def validate_weights(weights: dict[str, float]) -> None:
    if set(weights) != set(WEIGHTS):
        raise ValueError(f"INCOMPLETE_WEIGHTS: {sorted(set(weights) ^ set(WEIGHTS))}")
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 100) > 1e-9:
        raise ValueError("INVALID_WEIGHT_SUM")


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    return {n: w * 100 / sum(weights.values()) for n, w in weights.items()}


def readiness(inputs: DataFrame) -> DataFrame:
    """inputs with failing conditions and the flags technical_ready, scoring_ready and favorite_eligible."""
    failing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(col), F.lit(False)), code) for code, col in CONDITIONS.items()]))
    rows = inputs.withColumn("failing", failing).withColumn("technical_ready", F.size("failing") == 0)
    critical = F.size(F.coalesce("critical_missing", F.array().cast("array<string>"))) > 0
    rows = rows.withColumn("scoring_ready", F.col("technical_ready") & ~F.col("trading_halt_active") & ~critical)
    fresh = ~F.coalesce(F.col("stale_present"), F.lit(False)) & ~F.coalesce(F.col("sufficiency_label") == "NEW_LISTING", F.lit(False))
    return rows.withColumn("favorite_eligible", F.col("scoring_ready") & fresh)


def verdict(inputs: DataFrame, as_of, limits: Thresholds = DEFAULT) -> DataFrame:
    """Components, score and flags of each stock, with the calculator's overrides."""
    rows = evaluate(inputs, as_of, limits)
    status = lambda n: F.element_at(F.map_from_entries("components"), n)
    rows = rows.withColumn("stale_components", names_with("STALE")).withColumn("missing_fields", names_with("MISSING")).withColumn("stale_present", F.size("stale_components") > 0)
    rows = readiness(rows).withColumn("data_confidence", confidence())
    critical = status("critical_fields") == "FAILED"
    rows = rows.withColumn("scoring_ready", F.col("scoring_ready") & ~critical & (status("restriction_check") != "FAILED"))
    rows = rows.withColumn("favorite_eligible", F.col("favorite_eligible") & ~critical)
    warnings = F.array_compact(F.array(F.when(critical, "CRITICAL_DATA"), F.when(F.size("stale_components") > 0, "STALE_DATA"), F.when(F.col("sufficiency_label") == "NEW_LISTING", "NEW_LISTING"), F.when(F.col("trading_halt_active"), "TRADING_HALT")))
    return rows.withColumn("warnings", F.array_distinct(warnings))


def scan_state(rows: DataFrame) -> DataFrame:
    """state: INACTIVE on a halt, FAILED without a price, PARTIAL_DATA with a missing field, else READY."""
    state = F.when(F.col("trading_halt_active"), "INACTIVE").when(F.col("last_price").isNull(), "FAILED").when(F.size("missing_fields") > 0, "PARTIAL_DATA").otherwise("READY")
    return rows.withColumn("state", state)


def summary(scanned: DataFrame) -> DataFrame:
    """One row of counts, mean confidence and envelope status; no row counts as `not run`, never as zero."""
    n = lambda s: F.count_if(F.col("state") == s)
    rows = scanned.agg(F.count(F.lit(1)).alias("n_stocks"), n("READY").alias("n_ready"), n("PARTIAL_DATA").alias("n_partial"), n("FAILED").alias("n_failed"), n("INACTIVE").alias("n_inactive"), F.bround(F.avg("data_confidence"), 4).alias("avg_confidence"))
    status = F.when(F.col("n_stocks") == 0, "NOT_RUN").when(F.col("n_failed") == F.col("n_stocks"), "FAILED").when(F.col("n_ready") == F.col("n_stocks"), "OK").otherwise("PARTIAL")
    return rows.withColumn("status", status)


def scaled(weights: DataFrame) -> DataFrame:
    """name, weight and its share of 100."""
    return weights.withColumn("scaled", F.col("weight") * 100 / F.sum("weight").over(Window.partitionBy()))  # a row for each component


def name_difference(given: DataFrame) -> DataFrame:
    """side, name: weights that are not components (extra) and components without a weight (missing)."""
    own = given.sparkSession.createDataFrame([(n,) for n in WEIGHTS], "name string")
    return given.exceptAll(own).select(F.lit("extra").alias("side"), "name").unionByName(own.exceptAll(given).select(F.lit("missing").alias("side"), "name"))
