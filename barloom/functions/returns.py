"""Returns after costs, fills, rounding and buckets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_even

BPS = 10_000.0


def net_return_pct(entry: Column, exit_: Column, slippage_bps: Column | float, commission_bps: float = 0.0) -> Column:
    """Long round trip in percent: slippage and commission per side, multiplied in."""
    s = (slippage_bps if isinstance(slippage_bps, Column) else F.lit(float(slippage_bps))) / BPS
    c = commission_bps / BPS
    return ((exit_ * (1.0 - s)) * (1.0 - c) / ((entry * (1.0 + s)) * (1.0 + c)) - 1.0) * 100.0


def directed_return_pct(entry: Column, exit_: Column, slippage_bps: float, short: bool) -> Column:
    """Long or short round trip after slippage, rounded half to even at four decimals."""
    s = slippage_bps / BPS
    if short:
        value = (entry * (1 - s) - exit_ * (1 + s)) / (entry * (1 - s)) * 100.0
    else:
        value = (exit_ * (1 - s) - entry * (1 + s)) / (entry * (1 + s)) * 100.0
    return half_even(value, 4)


def additive_entry_fill(price: Column, slippage_bps: float, commission_bps: float) -> Column:
    return price * (1.0 + (slippage_bps + commission_bps) / BPS)


def additive_exit_fill(price: Column, slippage_bps: float, commission_bps: float) -> Column:
    return price * (1.0 - (slippage_bps + commission_bps) / BPS)


def bucket_label(score: Column, edges) -> Column:
    """Label ``lo-(hi-1)`` of the edge interval holding a score; beyond the edges the last label."""
    out = None
    for lo, hi in zip(edges, edges[1:]):
        hit = (score >= lo) & (score < hi)
        out = F.when(hit, f"{lo}-{hi - 1}") if out is None else out.when(hit, f"{lo}-{hi - 1}")
    return out.otherwise(f"{edges[-2]}-{edges[-1] - 1}")


def slippage_key(bps: float) -> str:
    """Lossless text of a cost scenario: ``5``, ``2.5``."""
    return str(int(bps)) if float(bps).is_integer() else repr(float(bps))
