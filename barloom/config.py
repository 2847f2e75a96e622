"""Plan-time configuration: weights, thresholds and study parameters."""
from __future__ import annotations

from dataclasses import asdict, dataclass, field


# Default points per score component.
@dataclass(frozen=True)
class IntradayWeights:
    volume_surge: int = 30
    bb_expansion: int = 20
    rsi_momentum: int = 20
    macd_crossover: int = 30


@dataclass(frozen=True)
class ShortWeights:
    ema_structure: int = 25
    volume_confirmation: int = 20
    rsi_momentum: int = 20
    macd_positive: int = 20
    pullback_ema: int = 15


@dataclass(frozen=True)
class LongWeights:
    secular_uptrend: int = 25
    rsi_healthy: int = 20
    volume_accumulation: int = 25
    macd_bullish: int = 15
    bb_coil: int = 15


def weights_from(cls, values: dict | None):
    """Weights with known keys overridden; unknown keys are ignored."""
    known = {k: v for k, v in (values or {}).items() if k in cls.__dataclass_fields__}
    return cls(**known)


def max_possible(weights) -> int:
    return sum(asdict(weights).values())


@dataclass(frozen=True)
class PatternProfile:
    runup_pct: float = 15.0
    decline_pct: float = 12.0
    move_days: int = 5
    lookback_days: int = 10
    history_years: int = 3
    min_events: int = 20
    alert_threshold: float = 75.0


# The three built-in pattern profiles.
PATTERN_PROFILES = {
    "conservative": PatternProfile(runup_pct=20.0, decline_pct=16.0, alert_threshold=78.0),
    "standard": PatternProfile(),
    "volatile": PatternProfile(runup_pct=30.0, decline_pct=25.0, alert_threshold=70.0),
}

# Weight of each series in the combined similarity.
SIMILARITY_WEIGHTS = {
    "price_pct": 0.35,
    "volume_ratio": 0.30,
    "rsi": 0.15,
    "macd_diff": 0.10,
    "bb_width": 0.10,
}

# Confluence weight per timeframe, in display order.
CONFLUENCE_WEIGHTS = {"intraday": 0.30, "short": 0.40, "long": 0.30}

# Lookback bars per timeframe and sessions until an outcome is read.
TIMEFRAME_BARS = {"intraday": 390, "short": 60, "long": 104}
OUTCOME_SESSIONS = {"intraday": 1, "short": 3, "long": 5}


@dataclass(frozen=True)
class Split:
    name: str
    start: str
    end: str


@dataclass(frozen=True)
class EventStudyConfig:
    warmup_bars: int = 60
    horizons: tuple[int, ...] = (1, 3, 5)
    bucket_edges: tuple[int, ...] = (0, 20, 40, 60, 80, 101)
    thresholds: tuple[int, ...] = (20, 30, 40, 50, 60, 70, 80)
    slippage_bps: tuple[float, ...] = (0.0, 5.0, 10.0)
    commission_bps: float = 0.0
    minimum_group_events: int = 20

    def bucket_labels(self) -> list[str]:
        return [f"{a}-{b - 1}" for a, b in zip(self.bucket_edges, self.bucket_edges[1:])]


@dataclass(frozen=True)
class BacktestConfig:
    min_score: int = 40
    warmup_bars: int = 60
    max_holding_bars: int = 3
    stop_loss_pct: float = 0.05
    take_profit_pct: float = 0.10
    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    initial_capital: float = 100_000.0
    intrabar_policy: str = "stop_first"

    def __post_init__(self):
        if not 0 <= self.min_score <= 100:
            raise ValueError("min_score must be within 0..100")
        if self.warmup_bars < 50 or self.max_holding_bars < 1:
            raise ValueError("warmup_bars must be >= 50 and max_holding_bars >= 1")
        if not (0 < self.stop_loss_pct < 1 and 0 < self.take_profit_pct < 1):
            raise ValueError("stop_loss_pct and take_profit_pct must be within (0, 1)")
        if self.commission_bps < 0 or self.slippage_bps < 0 or self.initial_capital <= 0:
            raise ValueError("costs must be >= 0 and capital > 0")
        if self.intrabar_policy not in ("stop_first", "target_first"):
            raise ValueError("intrabar_policy must be stop_first or target_first")


@dataclass(frozen=True)
class GapScanConfig:
    min_abs_gap_pct: float = 2.0
    min_price: float = 0.0
    min_premarket_volume: int = 0
    min_premarket_dollar_volume: float = 0.0
    min_premarket_volume_ratio: float = 0.0
    max_data_age_minutes: float | None = None
    max_spread_bps: float | None = None
    require_spread: bool = False
    require_catalyst: bool = False
    catalyst_lookback_hours: float = 24.0
    liquidity_lookback_sessions: int = 20
    allow_after_open: bool = False


# Absolute gap percentages at which a tier starts.
GAP_TIERS = {"massive": 8.0, "large": 4.0, "moderate": 2.0}


@dataclass(frozen=True)
class CleaningPolicy:
    max_invalid_rows: int = 10
    max_invalid_rate_pct: float = 0.10
    max_consecutive: int = 2
    min_rows: int = 260


@dataclass(frozen=True)
class AlertCooldowns:
    default_minutes: int = 240
    by_type: dict = field(default_factory=dict)
