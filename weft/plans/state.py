"""Options of a fit, and what one penalty leaves to the next."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class FitConfig:
    """Options of a fit; ``None`` is the default or no limit."""

    depth: int = 2
    lambda_min: float | None = None
    lambda_max: float | None = None
    halt_error_diff: float = 1.01
    max_interaction_distance: int | None = None
    max_nz_beta: int | None = None
    max_lambdas: int = 200
    estimate_unbiased: bool = False
    use_intercept: bool = True
    hierarchy: str | None = None  # "compat": larger columns are non-zero mains; "strong": all are
    check_duplicates: bool = False
    continuous: bool = False
    compat: bool = True
    #: Effects for which inner products are computed ahead, at most.
    ahead: int = 2000
    #: Active effects whose inner products the driver holds; of more, it holds one block at a time.
    most_active: int = 5000
    #: Penalties at zero after which an effect leaves the active set; it comes back if its sum exceeds the threshold.
    evict_after: int | None = None
    #: Sweeps go by a hash of effect and seed; without a seed, by number.
    sweep_seed: int | None = None
    #: End the path at the first solution that differs from an earlier one by more than this times the sum of both penalties.
    calibrate: float | None = None
    #: Earlier steps whose residuals bound the products of columns, at most.
    snapshots: int = 12

    def __post_init__(self) -> None:
        if self.depth not in (1, 2, 3):
            raise ValueError("depth is 1, 2 or 3")
        if self.hierarchy not in (None, "compat", "strong"):
            raise ValueError("hierarchy is None, 'compat' or 'strong'")
        if self.max_interaction_distance is not None and self.max_interaction_distance < 1:
            raise ValueError("max_interaction_distance is positive or None")
        if self.evict_after is not None and self.evict_after < 1 or self.most_active < 1:
            raise ValueError("evict_after and most_active are positive")
        if self.continuous:
            self.check_duplicates = False


@dataclass
class FitState:
    """What a step leaves behind and the next needs; enough to resume.

    ``tables`` and ``history`` are what the search remembers: bounds of columns
    and pairs, equal effects, and the fits of the steps that these go back to.
    Without them a resumed fit has the same result and looks at more.
    """

    beta: dict[int, float] = field(default_factory=dict)
    active: list[int] = field(default_factory=list)
    intercept: float = 0.0
    lam: float = 0.0
    sigma: float = 0.0
    step: int = 0  # penalties so far
    counted: int = 0  # those at which anything was active
    idle: dict[int, int] = field(default_factory=dict)  # penalties that an active effect has been zero
    evicted: list[int] = field(default_factory=list)
    trail: list[tuple[float, dict[int, float]]] = field(default_factory=list)  # penalties and solutions so far, where these are compared
    history: list[tuple[int, dict[int, float], float]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)
