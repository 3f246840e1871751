"""Regression with many fixed effects on Spark DataFrames."""

import importlib

#: Public names and their modules; they are imported when asked for, so that Python workers load only what they use.
PUBLIC = {
    "felm": "operators.models", "feglm": "operators.models", "fepoisson": "operators.models", "feprobit": "operators.models", "fetobit": "operators.models", "fenegbin": "operators.models",
    "fit_matrix": "operators.models", "fit_offset": "operators.models",
    "demean": "operators.centering", "FitControl": "plans.control", "fit_control": "plans.control", "ModelSpec": "plans.formula", "parse": "plans.formula", "summary_table": "sources.tables",
}
__all__ = list(PUBLIC)


def __getattr__(name):
    if name in PUBLIC:
        return getattr(importlib.import_module(f"{__name__}.{PUBLIC[name]}"), name)
    raise AttributeError(name)
