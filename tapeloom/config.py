"""Settings, as immutable values passed to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Costs:
    """One-way trading costs in basis points; slippage applies to both sides."""

    buy_fee_bps: float = 5.0
    sell_fee_bps: float = 10.0
    slippage_bps: float = 10.0

    @property
    def buy(self) -> float:
        return (self.slippage_bps + self.buy_fee_bps) * 1e-4

    @property
    def sell(self) -> float:
        return (self.slippage_bps + self.sell_fee_bps) * 1e-4


@dataclass(frozen=True)
class UniverseRules:
    ipo_cut_days: int = 120
    exclude_suspended: bool = True
    exclude_st: bool = True
    strict_flags: bool = False
    min_daily_turnover: float = 5e6
    allow_missing_info: bool = False
    excluded_boards: tuple[str, ...] = ("STAR", "CHINEXT", "BSE", "NEEQ")
    limit_move: float = 0.098
    limit_near: float = 0.001


@dataclass(frozen=True)
class Selection:
    top_pct: float = 0.05
    max_n: int = 7
    min_n: int = 7
    positive_only: bool = False
    weight_mode: str = "equal"
    rebalance_every: int = 1


@dataclass(frozen=True)
class Stops:
    """Stop settings; a ratio of 99 means the rule can not fire."""

    rules: tuple[str, ...] = ("fixed_tp_sl",)
    take_profit: float = 0.15
    stop_loss: float = 99.0
    cooldown_days: float = 1.0
    trail_start: float = 0.15
    trail_drawdown: float = 0.05
    block_reentry_returns: bool = False


@dataclass(frozen=True)
class WalkForward:
    train_weeks: int = 260
    val_weeks: int = 52
    step_weeks: int = 52


@dataclass(frozen=True)
class Allocation:
    vol_low: int = 1
    vol_high: int = 5
    wide_penalty: float = 0.0
    narrow_penalty: float = 0.0
    direction_weeks: int = 3
    direction_up: float = 0.02
    direction_down: float = -0.02
    soften: float = 0.5
    harden: float = 0.1
    mode: str = "linear"
    w_min: float = 0.10
    w_max: float = 0.90
    state_low: float = 0.3
    state_high: float = 0.6
    w_attack: float = 0.05
    w_neutral: tuple[float, float] = (0.20, 0.35)
    w_defense: float = 0.50
    hysteresis_weeks: int = 2
    smooth: float = 0.3
    weekly_cap: float = 0.10
    costs: Costs = field(default_factory=Costs)
