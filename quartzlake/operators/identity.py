"""Identity: symbols as of a date, company names, merges, and membership of the universe. An ambiguous match is no match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzlake.operators import graph

# The letters that are folded and what they become, before any change of case.
FOLD = ("İIıŞşÇçĞğÖöÜü", "iiissccggoouu")


def fold(text: Column) -> Column:
    return F.lower(F.translate(F.trim(text), *FOLD))


def norm_symbol(text: Column) -> Column:
    return F.upper(F.translate(F.trim(text), *FOLD))


def name_tokens(text: Column) -> Column:
    """The sorted distinct tokens of a company name: names are equal if these are."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(norm_symbol(text), F.lit("[A-Z0-9]+"), F.lit(0))))


def resolve(queries: DataFrame, symbols: DataFrame, as_of_column: str | None = None) -> DataFrame:
    """queries (query_id, platform, symbol and maybe a date) with stock_id, n_owners and status.

    With a date, a symbol counts on [valid_from, valid_to); without one, the symbols that are valid still count."""
    q = queries.withColumn("norm", norm_symbol(F.col("symbol")))
    s = symbols.select("platform", norm_symbol(F.col("symbol")).alias("norm"), F.col("stock_id").alias("owner"), "valid_from", "valid_to")
    counted = (F.count_distinct("owner").alias("n_owners"), F.min("owner").alias("owner"))
    if as_of_column is None:  # owners are counted once for each symbol, not for each query
        key = ["platform", "norm"]
        owners = s.where("valid_to IS NULL").groupBy(*key).agg(*counted)
    else:
        key = ["platform", "norm", as_of_column]
        on = (F.col("valid_from") <= F.col(as_of_column)) & (F.col("valid_to").isNull() | (F.col(as_of_column) < F.col("valid_to")))
        owners = q.select(*key).distinct().join(s, ["platform", "norm"]).where(on).groupBy(*key).agg(*counted)
    n = F.coalesce("n_owners", F.lit(0))
    return q.join(owners, key, "left").select(
        *queries.columns, F.when(n == 1, F.col("owner")).alias("stock_id"), n.alias("n_owners"), F.when(n == 1, "MATCHED").when(n > 1, "AMBIGUOUS").otherwise("UNMATCHED").alias("status")
    )


def resolve_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, stock_id by token-set equality of (name) with the known (stock_id, name); null if none or several."""
    q = queries.select("query_id", F.array_join(name_tokens(F.col("name")), " ").alias("key"))
    n = names.select(F.array_join(name_tokens(F.col("name")), " ").alias("key"), "stock_id").groupBy("key").agg(F.count_distinct("stock_id").alias("n"), F.min("stock_id").alias("stock_id"))
    return q.join(n, "key", "left").select("query_id", F.when(F.col("n") == 1, F.col("stock_id")).alias("stock_id"), F.coalesce("n", F.lit(0)).alias("n_owners"))


def merge_closure(merges: DataFrame) -> DataFrame:
    """old, final, cycle: where each merged stock ends up; where merges run in a circle, the first stock of the circle that is met again."""
    return graph.ends(merges.select(F.col("old").alias("node"), F.col("new").alias("up"))).select(F.col("node").alias("old"), F.col("far").alias("final"), "cycle")


def members(universe: DataFrame, days: DataFrame) -> DataFrame:
    """trade_date, members: how many stocks are in the universe on [entered, exited) of each day.

    Entries and exits are counted by day and summed up, so no join pairs days with memberships."""
    moves = universe.select(F.col("entered").alias("trade_date"), F.lit(1).alias("d")).unionByName(universe.where("exited IS NOT NULL").select(F.col("exited").alias("trade_date"), F.lit(-1).alias("d")))
    daily = moves.groupBy("trade_date").agg(F.sum("d").alias("d")).unionByName(days.select("trade_date", F.lit(None).cast("long").alias("d")))
    total = F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("trade_date").rangeBetween(Window.unboundedPreceding, 0))  # a row or two for each day only
    return daily.withColumn("members", total).where("d IS NULL").select("trade_date", "members")


def universe_diff(active: DataFrame, official: DataFrame) -> DataFrame:
    """symbol, side: extra (active but not official) or missing (official but not active)."""
    return active.select("symbol").exceptAll(official.select("symbol")).withColumn("side", F.lit("extra")).unionByName(official.select("symbol").exceptAll(active.select("symbol")).withColumn("side", F.lit("missing")))


def open_queue(pending: DataFrame) -> DataFrame:
    """One open row for each (stock, query): the first."""
    return pending.withColumn("rn", F.row_number().over(Window.partitionBy("stock_id", "query").orderBy("seq"))).where("rn = 1").drop("rn")


def scd2(changes: DataFrame) -> DataFrame:
    """Symbol history from (stock_id, platform, symbol, changed_on): each row is valid until the next change."""
    after = F.lead("changed_on").over(Window.partitionBy("stock_id", "platform").orderBy("changed_on"))
    return changes.select("stock_id", "platform", "symbol", F.col("changed_on").alias("valid_from"), after.alias("valid_to"), after.isNull().alias("is_active"))


def history(symbols: DataFrame) -> DataFrame:
    """A stock's symbols with their position: by start, then by symbol."""
    return symbols.select("stock_id", "symbol", F.row_number().over(Window.partitionBy("stock_id").orderBy("valid_from", "symbol")).alias("position"))
