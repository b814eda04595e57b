"""Thresholds of the market-data operators. Every operator takes its `as_of` date as an argument; nothing reads a clock."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    currencies: tuple[str, ...] = ("TRY",)
    outlier_pct: float = 20.0
    source_tolerance_pct: float = 0.5
    explain_tolerance_pct: float = 2.0
    sufficient_bars: int = 260
    limited_bars: int = 60
    new_listing_days: int = 60
    volume_window: int = 20
    volume_min_days: int = 5
    volume_steps: tuple[float, float, float] = (1.3, 2.0, 5.0)
    stale_price_days: int = 7
    stale_data_days: int = 5
    anomaly_limit: int = 3
    alert_streak: int = 3
    retention_days: int = 14
    page_size: int = 50
    max_page_size: int = 200


DEFAULT = Thresholds()
