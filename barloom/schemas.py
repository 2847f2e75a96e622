"""Explicit schemas of every source and stored table, as DDL text."""
from __future__ import annotations




def _struct(text: str) -> str:
    return " ".join(text.split())


BARS = _struct("ticker string, ts timestamp, open double, high double, low double, close double, volume double")
CANDLES = "struct<candles:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>>"

# The eighteen columns of an options row, in order.
OPTIONS = _struct(
    "ticker string, requested_source string, actual_source string, data_kind string, type string, side string, "
    "strike double, expiry string, premium double, volume double, open_interest double, vol_oi_ratio double, "
    "is_sweep boolean, provider_sentiment string, timestamp string, last double, bid double, ask double"
)
FLOW_RECORD = _struct(
    "ticker string, put_call string, side string, strike_price string, expiry_date string, premium string, "
    "volume string, open_interest string, is_sweep string, sentiment string, created_at string"
)
SCAN_SESSIONS = _struct(
    "session_id string, timeframe string, scan_time timestamp, trading_date date, provider string, status string, "
    "requested int, signals int"
)
SCAN_OBSERVATIONS = _struct(
    "session_id string, ticker string, status string, score int, last_close double, volume_ratio double, rsi double, "
    "reasons string, error string"
)
SIGNAL_HISTORY = _struct(
    "id bigint, session_id string, scan_time timestamp, timeframe string, ticker string, score int, last_close double, "
    "volume_ratio double, rsi double, reasons string, provider string, trading_date date"
)
SCAN_RUNS = _struct(
    "session_id string, scan_time timestamp, timeframe string, total_requested int, total_fetched int, total_signals int"
)
OUTCOMES = _struct("id bigint, outcome_close double, outcome_pct double, outcome_provider string, marked_at timestamp")
FINGERPRINTS = _struct(
    "event_type string, profile string, source string, created_at timestamp, n_events bigint, lookback_days int, "
    "series string, mean array<double>, std array<double>, upper array<double>, lower array<double>"
)
EARNINGS_CACHE = _struct("ticker string, source string, next_earnings date, fetched_at timestamp")
WATCHLIST_MEMBERS = _struct("name string, ticker string, pos int, created_at timestamp, updated_at timestamp")
ALERT_STATE = _struct(
    "ticker string, alert_type string, timeframe string, sent bigint, suppressed bigint, failed bigint, "
    "last_sent_at timestamp, cooldown_until timestamp"
)
SECURITY_SNAPSHOT = _struct("as_of date, active boolean, rows array<struct<ticker:string,name:string,type:string,primary_exchange:string>>")
MANIFEST = _struct(
    "dataset_id string, files array<struct<ticker:string,path:string,sha256:string,rows:bigint,start:string,end:string>>, "
    "splits map<string,struct<start:string,end:string>>"
)
