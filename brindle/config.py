"""Engine settings. Values are driver-side constants that the operators inline as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

#: Signed value of each kind of reaction (fixed values); exposures without reaction count -exposure_penalty.
SIGNED_VALUES = {"boost": 1.0, "favorite": 0.5, "exposed_no_reaction": -1.0, "mute": -1.0}


@dataclass(frozen=True)
class Knobs:
    """A viewer's own settings of the feed."""

    M: float = 0.7
    rho: float = 1.0
    theta: Mapping[str, float] = field(default_factory=lambda: {"bridge": 1.0})
    epsilon: float = 0.1

    def validate(self) -> None:
        for name in ("M", "rho", "epsilon"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if any(v < 0 for v in self.theta.values()):
            raise ValueError("factor weights must not be negative")

    def normalised_theta(self) -> dict[str, float]:
        total = sum(self.theta.values())
        return {k: v / total for k, v in self.theta.items()} if total > 0 else {"bridge": 1.0}


@dataclass(frozen=True)
class Settings:
    # signal and factorization
    exposure_penalty: float = 0.1
    d: int = 8
    mf_iterations: int = 20
    reg_embedding: float = 0.05
    reg_user: float = 0.1
    reg_post: float = 0.1
    reg_author: float = 0.05
    mf_tolerance: float = 1e-5
    inner_iterations: int = 2
    local_rows: int = 1_000_000  # a window of at most so many rows, counted first, iterates in memory on the driver; 0: never
    # bridging
    n0: float = 8.0
    aggregator: str = "nash"
    ede_epsilon: float = 4.0
    depth_reward: float = 0.0
    depth_gate: float = 0.0
    hierarchical_prior: bool = True
    prior_quality: bool = True
    n0_author: float = 8.0
    prior_decay: float = 0.7
    bias_calibration: bool = False
    out_of_band_weight: float = 1.0
    clusters: int = 2
    subtractive: bool = False
    lcb_beta: float = 1.0
    lcb_sigma: float = 1.0
    # raters
    delta: float = 0.85
    trust_iterations: int = 50
    trust_tolerance: float = 1e-8
    quality_mix: float = 0.5
    out_diversity: bool = True
    out_diversity_floor: float = 0.0
    coordination_penalty: float = 0.0
    loyalty_penalty: float = 0.0
    anchor_cap: bool = False
    scout_alpha: float = 0.5
    zeta: float = 0.3
    # propensity
    w_max: float = 20.0
    # budgets
    budget_base: float = 10.0
    budget_eta: float = 1.0
    budget_max: float = 100.0
    budget_memory: float = 0.0
    budget_share: bool = False
    budget_factor: float = 2.0
    budget_streaming: bool = False
    # exploration
    epsilon_min: float = 0.05
    epsilon_max: float = 0.5
    saturation_variance: float = 0.05
    base_rate: float = 0.1
    # control and gates
    gini_ceiling: float = 0.6
    delta_step: float = 0.02
    epsilon_step: float = 0.01
    cusum: bool = False
    cusum_k: float = 0.5
    cusum_h: float = 5.0
    cusum_warmup: int = 5
    whiteness_gate: bool = False
    whiteness_alpha: float = 0.05
    whiteness_penalty: float = 0.5
    collar: bool = False
    collar_kappa: float = 4.0
    offpolicy_verify: bool = False

    def validate(self) -> None:
        checks = {
            "d": self.d >= 1,
            "exposure_penalty": self.exposure_penalty >= 0,
            "delta": 0 < self.delta < 1,
            "clusters": self.clusters >= 1,
            "aggregator": self.aggregator in ("min", "nash", "ede"),
            "epsilon_min": 0 < self.epsilon_min <= self.epsilon_max <= 1,
            "w_max": self.w_max > 0,
            "n0": self.n0 >= 0,
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"settings out of range: {', '.join(bad)}")

    def clamp_epsilon(self, epsilon: float, floor: float | None = None) -> float:
        return min(self.epsilon_max, max(self.epsilon_min if floor is None else floor, epsilon))


#: Defaults of the live service: a one-signed network of likes, where a cluster that says nothing must not pass for one that
#: approves, and budgets that bind.
SERVICE = Settings(d=16, clusters=2, mf_iterations=20, budget_base=8.0, budget_max=80.0, subtractive=True, aggregator="min")
SERVICE_KNOBS = Knobs(M=0.8)
