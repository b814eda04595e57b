"""The list query: parameters, filters, alignment, sort, page, and what may be published."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzlake.config import DEFAULT

SORT_KEYS = ("symbol", "name", "sector", "scan_status", "confidence", "daily_change", "volume_ratio")
#: Flag, then the count and the list that stand in for it, in this order.
FLAGS = {"has_kap": ("kap_count", "kap_items"), "has_news": ("news_count", "news_items"), "has_action": ("action_count", "action_items"), "has_restriction": ("restriction_count", "restriction_items")}
# Columns that are never published.
PRIVATE = re.compile(r"^(internal_notes|raw_error|debug|pending_review|admin_.*)$")


class InvalidParameter(ValueError):
    def __init__(self, field: str):
        super().__init__(f"INVALID_PARAMETER({field})")
        self.field = field


@dataclass(frozen=True)
class FilterParams:
    search: str | None = None
    sector: str | None = None
    scan_status: str | None = None
    minimum_confidence: float | None = None
    has_kap: bool | None = None
    has_news: bool | None = None
    has_action: bool | None = None
    has_restriction: bool | None = None
    sort: str = "symbol"
    direction: str = "asc"
    page: int = 1
    page_size: int = DEFAULT.page_size

    def __post_init__(self):
        if self.sort not in SORT_KEYS:
            raise InvalidParameter("sort")
        if self.direction not in ("asc", "desc"):
            raise InvalidParameter("direction")
        if self.page < 1:
            raise InvalidParameter("page")
        if not 1 <= self.page_size <= DEFAULT.max_page_size:
            raise InvalidParameter("page_size")
        if self.minimum_confidence is not None and not 0 <= self.minimum_confidence <= 100:
            raise InvalidParameter("minimum_confidence")


def predicate(df: DataFrame, p: FilterParams) -> Column:
    keep = F.lit(True)
    if p.search:
        found = F.lit(False)
        for c in ("symbol", "name", "title", "unvan"):
            if c in df.columns:
                found = found | F.coalesce(F.lower(c).contains(p.search.lower()), F.lit(False))
        keep = keep & found
    for c in ("sector", "scan_status"):
        if value := getattr(p, c):
            keep = keep & F.coalesce(F.lower(c) == value.lower(), F.lit(False))
    if p.minimum_confidence is not None:
        keep = keep & F.coalesce(F.col("confidence").try_cast("double") >= p.minimum_confidence, F.lit(False))
    for flag, (count, items) in FLAGS.items():
        if (value := getattr(p, flag)) is not None:
            parts = [F.col(flag)] if flag in df.columns else []
            parts += [F.col(count) > 0] if count in df.columns else []
            parts += [F.when(F.col(items).isNotNull(), F.size(items) > 0)] if items in df.columns else []
            keep = keep & (F.coalesce(*parts, F.lit(False)) == value)
    return keep


def align(df: DataFrame) -> DataFrame:
    """Rows of the greatest run id, as text, and rows without a run."""
    latest = df.agg(F.max("scan_run_id").alias("_latest"))
    return df.crossJoin(F.broadcast(latest)).where("scan_run_id IS NULL OR scan_run_id = _latest").drop("_latest")  # one row on the other side


def order(p: FilterParams) -> list[Column]:
    """Rows without a value come last in both directions, by symbol; the rest by value and symbol in the same direction."""
    key = F.col(p.sort).try_cast("double") if p.sort in ("confidence", "daily_change", "volume_ratio") else F.col(p.sort)
    down = p.direction == "desc"
    valued = F.when(key.isNotNull(), F.col("symbol"))
    return [key.isNull().asc(), key.desc() if down else key.asc(), valued.desc() if down else valued.asc(), F.col("symbol").asc()]


def list_page(df: DataFrame, p: FilterParams) -> tuple[DataFrame, DataFrame]:
    """(page, meta): the rows of one page with their position, and total and total_pages."""
    rows = align(df)
    rows = rows.where(predicate(rows, p))
    total = F.count(F.lit(1))
    meta = rows.agg(total.alias("total"), F.ceil(total / p.page_size).alias("total_pages"))
    first = (p.page - 1) * p.page_size
    page = rows.orderBy(*order(p)).offset(first).limit(p.page_size)  # a page is the feature
    return page, meta


def whole_list(df: DataFrame) -> DataFrame:
    """The meta of a list that is given in one page: its size is the page's, at least one, and there is no page without rows."""
    total = F.count(F.lit(1))
    return df.agg(F.lit(1).alias("page"), F.greatest(total, F.lit(1)).alias("page_size"), total.alias("total"), F.least(total, F.lit(1)).alias("total_pages"))


def positions(df: DataFrame, p: FilterParams) -> DataFrame:
    """Rows of the page with `position`; ranks are taken of the page's rows alone."""
    page, _ = list_page(df, p)
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order(p))) + (p.page - 1) * p.page_size)


def _public(kind: T.DataType, value: Column) -> Column | None:
    if isinstance(kind, T.StructType):
        kept = [(f, _public(f.dataType, value[f.name])) for f in kind.fields if not PRIVATE.match(f.name)]
        return F.struct(*[c.alias(f.name) for f, c in kept]) if kept else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: _public(kind.elementType, x))
    return value


def publishable(df: DataFrame) -> DataFrame:
    """df without private columns, at any depth; the schema decides, once."""
    return df.select(*[_public(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema.fields if not PRIVATE.match(f.name)])


def private_paths(kind: T.StructType, prefix: str = "") -> list[str]:
    found = []
    for f in kind.fields:
        path = f"{prefix}{f.name}"
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        found += [path] if PRIVATE.match(f.name) else private_paths(inner, f"{path}.") if isinstance(inner, T.StructType) else []
    return found


def price_layers(df: DataFrame, layer: str = "default") -> DataFrame:
    return df if layer == "all" else df.where(F.lower(F.coalesce("data_layer", F.lit("validated"))).isin("validated", "clean"))


def visible(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.where("is_active").select("symbol"), "symbol", "left_semi")
