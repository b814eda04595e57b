"""Records at the door and at rest: normalising, filtering with a log, layers, frozen snapshots, versions, and checks of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.config import DEFAULT, Thresholds
from quartzlake.operators import validation
from quartzlake.operators.identity import norm_symbol

LAYERS = ("raw", "clean", "validated")
RAW_KINDS, STRUCTURED_KINDS = ("raw_html", "raw_json"), ("daily", "disclosures", "news")


def normalise(raw: DataFrame, source: str, currency: str = "TRY") -> DataFrame:
    """Bars of a source from its text records, with `skipped`: why a record is no bar, or null.

    A date or trade_date and the five numbers must be there; adjusted_close or adj_close may be; a bad one is null."""
    day = F.coalesce(F.nullif(F.trim("date"), F.lit("")), F.nullif(F.trim("trade_date"), F.lit("")))
    number = lambda c, kind: F.trim(F.col(c)).try_cast(kind).alias(c)
    rows = raw.select(
        "stock_id", day.alias("day"), F.expr("try_to_date(substr(coalesce(nullif(trim(date), ''), trim(trade_date)), 1, 10))").alias("trade_date"), *[number(c, "double") for c in validation.PRICES], number("volume", "bigint"),
        F.trim(F.coalesce("adjusted_close", "adj_close")).try_cast("double").alias("adjusted_close"), F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(currency)).alias("currency"), F.lit(source).alias("source"),
    )
    missing = F.lit(False)
    for c in (*validation.PRICES, "volume"):
        missing = missing | F.col(c).isNull()
    why = F.when(F.col("day").isNull(), "missing_date").when(missing, "missing_or_bad_field").when(F.size(validation.ingest_codes()) > 0, "invalid_bar")
    return rows.withColumn("skipped", why).drop("day")


def filter_log(bars: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """stock_id, kept, dropped and the codes for which bars were dropped; a bad bar is not checked for its currency too."""
    bad = F.size(validation.ingest_codes(limits)) > 0
    code = F.when(bad, "BAR_REJECTED").when(~F.coalesce(F.col("currency").isin(*limits.currencies), F.lit(False)), "WRONG_CURRENCY")
    return bars.groupBy("stock_id").agg(F.count_if(code.isNull()).alias("kept"), F.count_if(code.isNotNull()).alias("dropped"), F.array_sort(F.collect_set(code)).alias("codes"))


def between(bars: DataFrame, start, end) -> DataFrame:
    """A source's bars of a closed range of days; the predicate reaches the scan."""
    return bars.where((F.col("trade_date") >= F.lit(start).cast("date")) & (F.col("trade_date") <= F.lit(end).cast("date")))


def row_checksum(*columns: str) -> Column:
    """SHA-256 of a row's JSON with its keys in order and nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def in_layer(rows: DataFrame, layer: str) -> DataFrame:
    """Rows to append to a layer; an unknown layer is refused."""
    if layer not in LAYERS:
        raise ValueError(f"INVALID_LAYER({layer})")
    return rows.withColumn("data_layer", F.lit(layer))


def promote_layer(requests: DataFrame, rows: DataFrame, start: str, end: str) -> DataFrame:
    """batch_id, record_id, outcome and the row's checksums before and after, for requests (batch_id, record_id).

    A batch is promoted whole or not at all: one missing record, or one that is not in the layer `start`, refuses it."""
    if LAYERS.index(end) != LAYERS.index(start) + 1:
        raise ValueError(f"NO_SKIPPING({start}, {end})")
    own = [c for c in rows.columns if c not in ("record_id", "data_layer")]
    asked = requests.join(rows, "record_id", "left")
    problem = F.when(F.col("data_layer").isNull(), "NOT_FOUND").when(F.col("data_layer") != start, "WRONG_LAYER")
    broken = asked.where(problem.isNotNull()).select("batch_id").distinct().withColumn("broken", F.lit(True))
    asked = asked.join(broken, "batch_id", "left").withColumn("outcome", F.coalesce(problem, F.when(F.col("broken"), "BATCH_REFUSED"), F.lit("PROMOTED")))
    before, after = (row_checksum(*own, "record_id", "data_layer"), F.lit(end))
    done = F.col("outcome") == "PROMOTED"
    out = asked.withColumn("checksum_before", F.when(done, before)).withColumn("data_layer", F.when(done, after).otherwise(F.col("data_layer")))
    return out.withColumn("checksum_after", F.when(done, before)).select("batch_id", "record_id", "outcome", "checksum_before", "checksum_after")


def archive(rows: DataFrame, path: str) -> None:
    """Append rows to an archive, in a folder for each kind."""
    rows.write.mode("append").partitionBy("kind").parquet(path)


def archived(spark, path: str, kind: str) -> DataFrame:
    if kind not in RAW_KINDS + STRUCTURED_KINDS:
        raise ValueError(f"INVALID_KIND({kind})")
    return spark.read.parquet(path).where(F.col("kind") == kind)


def profile_checks(stocks: DataFrame, checks: DataFrame, now, days: int = 7) -> DataFrame:
    """stock_id, outcome: a profile checked less than so many days before is fresh and skipped."""
    last = checks.groupBy("stock_id").agg(F.max("checked_at").alias("last"))
    fresh = F.col("last") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return stocks.join(last, "stock_id", "left").select("stock_id", F.when(fresh, "skipped_fresh").otherwise("checked").alias("outcome"))


def insert_disclosures(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """notification_id, outcome, version_no: of an id that is stored, or repeated in the batch, only the first is written.

    A revision's version follows that of its stored predecessor; without one it is 1. Only filings that name a predecessor are
    dealt out by it: the others, which are most, would all meet in one task as nulls."""
    once = incoming.withColumn("rn", F.row_number().over(Window.partitionBy("notification_id").orderBy("seq")))
    known = stored.select("notification_id", F.lit(True).alias("there"))
    before = stored.select(F.col("notification_id").alias("previous_notification_id"), F.col("version_no").alias("before"))
    rows, names = once.join(known, "notification_id", "left"), F.col("previous_notification_id").isNotNull()
    rows = rows.where(names).join(before, "previous_notification_id", "left").unionByName(rows.where(~names).withColumn("before", F.lit(None).cast(before.schema["before"].dataType)))
    outcome = F.when(F.col("there") | (F.col("rn") > 1), "duplicate").when(F.col("previous_notification_id").isNotNull(), "revision_chain").otherwise("inserted")
    return rows.select("notification_id", "seq", outcome.alias("outcome"), F.when(outcome != "duplicate", F.coalesce(F.col("before") + 1, F.lit(1))).alias("version_no"))


def frozen(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """The first snapshot of each key: it is written once and later ones are ignored."""
    return snapshots.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("rn = 1").drop("rn")


def invented_dates(output: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of output on days that the source does not have: there must be none, as history is never made up."""
    return output.join(source.select("stock_id", "trade_date"), ["stock_id", "trade_date"], "left_anti").select("stock_id", "trade_date")


def adjustment_versions(runs: DataFrame) -> DataFrame:
    """runs (stock_id, seq) with data_version adj-vN and whether it is the current one; older ones stay readable."""
    by = Window.partitionBy("stock_id").orderBy("seq")
    return runs.withColumn("data_version", F.concat(F.lit("adj-v"), F.row_number().over(by).cast("string"))).withColumn("is_current", F.lead("seq").over(by).isNull())


def resolve_universe(listed: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved with stock_id, queue): listed symbols that no valid symbol owns, or several do, wait for review."""
    live = symbols.where("valid_to IS NULL").groupBy(norm_symbol(F.col("symbol")).alias("norm")).agg(F.count_distinct("stock_id").alias("n"), F.min("stock_id").alias("stock_id"))
    rows = listed.withColumn("norm", norm_symbol(F.col("symbol"))).join(live, "norm", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.where("n = 1").select("symbol", "stock_id"), rows.where("n <> 1").select("symbol", F.when(F.col("n") == 0, "UNRESOLVED").otherwise("AMBIGUOUS").alias("reason"))


def resolve_historical(queries: DataFrame, symbols: DataFrame, merges: DataFrame) -> DataFrame:
    """query_id, stock_id, historical: the owner of a symbol at any time, after merges (old, final); historical if it is not valid now."""
    s = symbols.select(norm_symbol(F.col("symbol")).alias("norm"), F.col("stock_id").alias("old"), F.col("valid_to").isNull().alias("live"))
    owners = s.join(merges, "old", "left").select("norm", F.coalesce("final", "old").alias("owner"), "live")
    owners = owners.groupBy("norm").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"), F.bool_or("live").alias("live"))
    rows = queries.withColumn("norm", norm_symbol(F.col("symbol"))).join(owners, "norm", "left")
    return rows.select("query_id", F.when(F.col("n") == 1, F.col("owner")).alias("stock_id"), F.when(F.col("n") == 1, ~F.col("live")).alias("historical"))


def merge_symbols(symbols: DataFrame, merges: DataFrame, on) -> DataFrame:
    """Symbols after merges (old, final): those of a merged stock are closed on the day and point to where it went."""
    rows = symbols.join(merges.withColumnRenamed("old", "stock_id"), "stock_id", "left")
    gone = F.col("final").isNotNull() & F.col("valid_to").isNull()
    return rows.select("stock_id", "symbol", "valid_from", F.when(gone, F.lit(on).cast("date")).otherwise(F.col("valid_to")).alias("valid_to"), F.coalesce("final", "stock_id").alias("resolves_to"))


def link_failures(probes: DataFrame, limits: Thresholds = DEFAULT) -> DataFrame:
    """stock_id, seq: where a stock is queued, at the first run of failed probes (stock_id, seq, ok) that reaches the limit."""
    by = Window.partitionBy("stock_id").orderBy("seq")
    rows = probes.withColumn("island", F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("NOT ok").withColumn("streak", F.row_number().over(Window.partitionBy("stock_id", "island").orderBy("seq")))
    return rows.where(F.col("streak") == limits.alert_streak).groupBy("stock_id").agg(F.min("seq").alias("seq"))


def run_mismatches(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose run is not the latest one (by seq); an answer is given only if there are none."""
    latest = runs.agg(F.max_by("run_id", "seq").alias("scan_run_id"))
    return rows.where("scan_run_id IS NOT NULL").join(latest, "scan_run_id", "left_anti")


def current_actions(actions: DataFrame, cancellations: DataFrame) -> DataFrame:
    """The current version of each event (not superseded) and the cancellations, which do not change their target."""
    return actions.where("status <> 'SUPERSEDED'").withColumn("kind", F.lit("action")).unionByName(cancellations.withColumn("kind", F.lit("cancellation")))


def packets(actions: DataFrame, restrictions: DataFrame) -> DataFrame:
    """stock_id, raw and validated action ids, active restriction ids, halted: one immutable packet for each stock.

    actions: stock_id, seq, status, marked; restrictions: stock_id, seq, restriction_type, computed_active. Both are few for a stock."""
    ok = F.col("status").isin("EFFECTIVE", "COMPLETED") | F.coalesce("marked", F.lit(False))
    a = actions.groupBy("stock_id").agg(F.sort_array(F.collect_list("seq")).alias("actions_raw"), F.sort_array(F.collect_list(F.when(ok, F.col("seq")))).alias("actions_validated"))
    live = F.col("computed_active")
    r = restrictions.groupBy("stock_id").agg(F.sort_array(F.collect_list(F.when(live, F.col("seq")))).alias("restrictions_active"), F.bool_or(live & (F.col("restriction_type") == "TRADING_HALT")).alias("halted"))
    none = F.array().cast("array<bigint>")
    rows = a.join(r, "stock_id", "full_outer")
    return rows.select("stock_id", *[F.coalesce(c, none).alias(c) for c in ("actions_raw", "actions_validated", "restrictions_active")], F.coalesce("halted", F.lit(False)).alias("halted"))


CHANNELS = ("kap_count", "news_count", "action_count", "restriction_count")


def completion(scan: DataFrame, started: DataFrame) -> DataFrame:
    """run_id, criterion, passed: the criteria that the rows of a staged run can show, for each run started (run_id, expected).

    scan: run_id, state, data_confidence, last_price, volume, missing_fields and the counts of CHANNELS. A run without a row passes none
    that asks for rows. Missing is not zero: a price or volume named as missing must not stand as 0."""
    named = lambda field, column: F.coalesce(F.array_contains("missing_fields", field), F.lit(False)) & F.coalesce(F.col(column) == 0, F.lit(False))
    zeroed = named("price_availability", "last_price") | (named("volume_availability", "volume") & F.col("last_price").isNull())
    per = scan.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("state").isNull()).alias("open"), F.count_if(F.col("last_price") > 0).alias("prices"), F.sum(sum(F.coalesce(c, F.lit(0)) for c in CHANNELS)).alias("items"),
        F.count_if(zeroed).alias("zeroed"), F.count_if(~F.coalesce(F.col("data_confidence").between(0, 100), F.lit(False))).alias("unsure"), F.count_if(F.col("state") == "FAILED").alias("failed"),
    )
    rows = started.join(per, "run_id", "left").na.fill(0, ["n", "open", "prices", "items", "zeroed", "unsure", "failed"])
    passed = {
        "UNIVERSE_VERIFIED": F.col("run_id").startswith("STAGING-") & (F.col("n") > 0), "ALL_SCANNED": (F.col("n") == F.col("expected")) & (F.col("open") == 0), "CHANNELS_COLLECTED": (F.col("prices") > 0) & (F.col("items") > 0),
        "MISSING_NOT_ZEROED": F.col("zeroed") == 0, "CONFIDENCE_PER_STOCK": (F.col("n") > 0) & (F.col("unsure") == 0), "NO_STOCK_FAILED": F.col("failed") == 0,
    }
    return rows.select("run_id", F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), v.alias("passed")) for k, v in passed.items()))).alias("c")).select("run_id", "c.*")


def count_check(active: DataFrame, official: DataFrame, expected: int) -> DataFrame:
    """One row: how many symbols there are and should be, and the symbols too many and too few."""
    side = active.select("symbol", F.lit(1).alias("a")).join(official.select("symbol", F.lit(1).alias("o")), "symbol", "full_outer")
    extra, missing = F.col("o").isNull(), F.col("a").isNull()
    return side.agg(F.count("a").alias("actual"), F.lit(expected).cast("long").alias("expected"), F.count_if(extra).alias("n_extra"), F.count_if(missing).alias("n_missing"), (F.count("a") == expected).alias("ok"))
