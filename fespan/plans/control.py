"""Fit parameters: names, defaults and checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace
from math import inf


@dataclass(frozen=True)
class FitControl:
    """Parameters of a fit. Accepted and checked, but without effect: alpha_tol and iter_alpha_max (level effects come with the fit,
    there is no separate recovery), step_halving_memory and max_step_halving (they blend after a step that raised the deviance; no such
    step is taken here), start_inner_tol and bias_corr_bandwidth."""

    dev_tol: float = 1e-6
    center_tol: float = 1e-6
    collin_tol: float = 1e-8
    step_halving_factor: float = 0.5
    alpha_tol: float = 1e-5
    iter_max: int = 50
    iter_center_max: int = 10000
    iter_inner_max: int = 50
    iter_alpha_max: int = 10000
    step_halving_memory: float = 0.9
    max_step_halving: int = 2
    start_inner_tol: float = 1e-5
    grand_acc_period: int = 4
    centering: str = "berge"
    sep_tol: float = 1e-8
    sep_zero_tol: float = 1e-8
    sep_max_iter: int = 200
    sep_simplex_max_iter: int = 2000
    sep_use_relu: bool = True
    sep_use_simplex: bool = True
    return_fe: bool = False
    keep_tx: bool = False
    keep_data: bool = False
    return_hessian: bool = False
    check_separation: bool = True
    init_theta: float = 0.0
    vcov_type: str | None = None
    tobit_lb: float = -inf
    tobit_ub: float = inf
    compute_apes: bool = False
    ape_n_pop: int | None = None
    ape_panel_structure: str = "classic"
    ape_sampling_fe: str = "independence"
    ape_weak_exo: bool = False
    compute_bias_corr: bool = False
    bias_corr_bandwidth: int = 0
    bias_corr_panel_structure: str = "classic"
    #: Ours: bytes of the model's columns up to which a fit runs over arrays on the driver, equal rows counted once; beyond it, in Spark.
    local_bytes: int = 128 << 20
    #: Ours: cells of two or more effects whose sums the driver may hold in a Spark fit; beyond it centering sweeps over level tables.
    max_cells: int = 1_000_000
    #: Ours: rows of a fixed-effect table up to which it is broadcast.
    broadcast_levels: int = 200_000
    #: Ours: a response of the gamma and inverse Gaussian families may be 0; the fit is one by quasi-likelihood then, with the same link, variance and steps.
    zero_response: bool = False

    def __post_init__(self):
        for names, check, said in (
            (("dev_tol", "center_tol", "collin_tol", "alpha_tol", "sep_tol", "sep_zero_tol", "start_inner_tol"), lambda v: v > 0, "must be greater than zero."),
            (("iter_max", "iter_center_max", "iter_inner_max", "iter_alpha_max", "sep_max_iter", "sep_simplex_max_iter", "grand_acc_period"), lambda v: v >= 1, "must be greater than or equal to one."),
            (("max_step_halving", "init_theta", "bias_corr_bandwidth", "local_bytes", "max_cells", "broadcast_levels"), lambda v: v >= 0, "must be greater than or equal to zero."),
            (("step_halving_factor", "step_halving_memory"), lambda v: 0 < v < 1, "must be between zero and one."),
            (("sep_use_relu", "sep_use_simplex", "return_fe", "keep_tx", "keep_data", "return_hessian", "check_separation", "compute_apes", "ape_weak_exo", "compute_bias_corr", "zero_response"), lambda v: isinstance(v, bool), "must be logical."),
            (("centering",), lambda v: v in ("berge", "stammann"), "must be 'berge' or 'stammann'."),
            (("ape_panel_structure", "bias_corr_panel_structure"), lambda v: v in ("classic", "network"), "must be 'classic' or 'network'."),
            (("ape_sampling_fe",), lambda v: v in ("independence", "unrestricted"), "must be 'independence' or 'unrestricted'."),
            (("vcov_type",), lambda v: v in (None, "iid", "hetero", "cluster", "m-estimator", "dyadic", "two-way"), "is no known estimator."),
        ):
            for n in names:
                if not check(getattr(self, n)):
                    raise ValueError(f"'{n}' {said}")
        if self.ape_n_pop is not None and self.ape_n_pop <= 0:
            raise ValueError("'ape_n_pop' must be greater than zero.")
        if not self.tobit_lb < self.tobit_ub:
            raise ValueError("'tobit_lb' must be less than 'tobit_ub'.")


def fit_control(**given) -> FitControl:
    return FitControl(**given)


def merged(control: FitControl | dict | None, **more) -> FitControl:
    """Control with defaults filled in; unknown names of a dict are warned about and left out."""
    if isinstance(control, FitControl):
        return replace(control, **more)
    if control is not None and not isinstance(control, dict):
        raise TypeError("'control' has to be a dict or a FitControl.")
    known = {f.name for f in fields(FitControl)}
    for n in set(control or {}) - known:
        warnings.warn(f"Unknown control parameter: {n}", stacklevel=2)
    return FitControl(**{k: v for k, v in (control or {}).items() if k in known} | more)
