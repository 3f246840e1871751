"""Table source and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LABELS = {"iid": "iid", "hetero": "heteroskedastic", "cluster": "clustered", "m-estimator": "m-estimator", "two-way": "two-way clustered", "dyadic": "dyadic"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stars(p: float) -> str:
    return "**" if p <= 0.01 else "*" if p <= 0.05 else "+" if p <= 0.1 else ""


def summary_table(*models, names: list[str] | None = None, digits: int = 3, latex: bool = False, caption: str | None = None, label: str | None = None) -> str:
    """Models side by side: coefficients with standard errors, fixed effects, observations, fit and the kind of standard errors."""
    if not models:
        raise ValueError("at least one model is needed.")
    names = names or [f"({i + 1})" for i in range(len(models))]
    if len(names) != len(models):
        raise ValueError("as many names as models are needed.")
    terms = list(dict.fromkeys(t for m in models for t in m.names))
    tables = [dict(zip(m.names, m.coef_table, strict=True)) for m in models]
    rows = [["Variable", *names]]
    for t in terms:
        rows.append([t, *[f"{x[t][0]:.{digits}f}{stars(x[t][3])}" if t in x else "" for x in tables]])
        rows.append(["", *[f"({x[t][1]:.{digits}f})" if t in x else "" for x in tables]])
    effects = list(dict.fromkeys(f for m in models for f in m.spec.fe))
    if effects:
        rows.append(["Fixed effects", *[""] * len(models)])
        rows += [[f, *["Yes" if f in m.spec.fe else "No" for m in models]] for f in effects]
    rows.append(["N", *[f"{m.nobs['nobs_full' if m.kind == 'felm' else 'nobs']:,}" for m in models]])
    glm = any(m.kind != "felm" for m in models)
    fit = [m.stats.get("r_squared", m.stats.get("pseudo_r_squared")) for m in models]
    rows.append(["Pseudo R-squared" if glm else "R-squared", *["" if x is None else f"{x:.{digits}f}" for x in fit]])
    rows.append(["SE type", *[LABELS[m.vcov_label] for m in models]])
    note = "Standard errors in parenthesis. Significance levels: ** p < 0.01; * p < 0.05; + p < 0.10"
    if latex:
        safe = lambda s: s.replace("_", r"\_").replace("%", r"\%")
        body = [" & ".join(safe(c) for c in r) + r" \\" for r in rows]
        out = [r"\begin{table}[htbp]", r"\centering", *([rf"\caption{{{caption}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else []), rf"\begin{{tabular}}{{l{'c' * len(models)}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}", rf"\par {note}", r"\end{table}"]
        return "\n".join(out)
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, rows[1:]), "", note])
