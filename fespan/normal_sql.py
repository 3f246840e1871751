"""SQL texts that fit the models of queries by plain steps: weighted demeaning in turn by each effect, normal equations, and Newton
steps written out one after the other. They are the independent side of a comparison and share nothing with the operators."""

from __future__ import annotations

PHI = "exp(-({x}) * ({x}) / 2) / sqrt(2 * pi())"
#: Normal distribution function by its odd series, for |x| under 5 or so.
CDF = "(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum([CASE WHEN ({x}) = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({x})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))) END for k in range(0, 60)]))"


def _mu(family: str, eta: str) -> str:
    return {"poisson": f"exp({eta})", "negbin": f"exp({eta})", "binomial": f"1 / (1 + exp(-({eta})))", "probit": CDF.format(x=eta)}.get(family, eta)


def _working(family: str, theta: str) -> tuple[str, str]:
    """(weight, response less predictor) as functions of eta, mu, y."""
    d = f"({PHI.format(x='eta')})"
    return {
        "poisson": ("mu", "(y - mu) / mu"), "negbin": (f"mu / (1 + mu / ({theta}))", "(y - mu) / mu"), "binomial": ("mu * (1 - mu)", "(y - mu) / (mu * (1 - mu))"),
        "probit": (f"{d} * {d} / (mu * (1 - mu))", f"(y - mu) / {d}"),
    }.get(family, ("1.0", "y - mu"))


def _start(family: str) -> str:
    return {"poisson": "ln(avg(y) OVER () + 0.1)", "negbin": "ln(avg(y) OVER () + 0.1)", "binomial": "ln(avg(y) OVER () / (1 - avg(y) OVER ()))", "probit": "0.0"}.get(family, "0.0")


def fitted(frame: str, y: str, x: list[str], fe: list[str], family: str = "gaussian", keys: str = "", steps: int = 1, sweeps: int = 1, theta: str = "1") -> str:
    """WITH clauses that end in `b` (b0, b1: coefficients; h00, h01, h11: products of the centred regressors under the last weights)
    and `r` (rows: y, mu, eta, ww, centred t0, t1, f0.. and the columns `keys`). One or two regressors; one effect is exact in one sweep."""
    p, own = len(x), [f"f{i}" for i in range(len(fe))]
    cols = [f"({c})::DOUBLE AS x{i}" for i, c in enumerate(x)] + [f"{c} AS f{i}" for i, c in enumerate(fe)] + ([keys] if keys else [])
    out = [f"n0 AS MATERIALIZED (SELECT *, {_start(family)} AS eta FROM (SELECT ({y})::DOUBLE AS y, {', '.join(cols)} FROM {frame}))"]
    ww, nu = _working(family, theta)
    for i in range(steps):
        out.append(f"m{i} AS MATERIALIZED (SELECT *, {_mu(family, 'eta')} AS mu FROM n{i})")
        last = f"d{i}_0"
        out.append(f"{last} AS (SELECT *, eta + ({nu}) AS z, eta + ({nu}) AS tz, {ww} AS ww, {', '.join(f'x{j} AS t{j}' for j in range(p))} FROM m{i})")
        for s in range(sweeps):
            for f in own:
                now = f"d{i}_{s * len(own) + own.index(f) + 1}"
                less = ", ".join(f"{c} - sum(ww * {c}) OVER p / sum(ww) OVER p AS {c}" for c in ["tz", *[f"t{j}" for j in range(p)]])
                out.append(f"{now} AS (SELECT * REPLACE ({less}) FROM {last} WINDOW p AS (PARTITION BY {f}))")
                last = now
        out.append(f"e{i} AS MATERIALIZED (SELECT * FROM {last})")
        if p == 1:
            sums = "sum(ww * t0 * t0) AS h00, 0.0 AS h01, 1.0 AS h11, sum(ww * t0 * tz) AS c0, 0.0 AS c1"
        else:
            sums = "sum(ww * t0 * t0) AS h00, sum(ww * t0 * t1) AS h01, sum(ww * t1 * t1) AS h11, sum(ww * t0 * tz) AS c0, sum(ww * t1 * tz) AS c1"
        out.append(f"b{i} AS MATERIALIZED (SELECT *, (h11 * c0 - h01 * c1) / (h00 * h11 - h01 * h01) AS b0, (h00 * c1 - h01 * c0) / (h00 * h11 - h01 * h01) AS b1 FROM (SELECT {sums} FROM e{i}))")
        rest = " - ".join(["tz", *[f"b{j} * t{j}" for j in range(p)]])
        keep = ["y", *[f"x{j}" for j in range(p)], *own, *[k.split(" AS ")[-1].strip() for k in keys.split(",") if k.strip()]]
        if i < steps - 1:
            out.append(f"n{i + 1} AS MATERIALIZED (SELECT {', '.join(keep)}, z - ({rest}) AS eta FROM e{i}, b{i})")
        else:
            out.append(f"l AS (SELECT {', '.join(keep)}, {', '.join(f't{j}' for j in range(p))}, ww, z - ({rest}) AS eta FROM e{i}, b{i})")
            out.append(f"r AS MATERIALIZED (SELECT *, {_mu(family, 'eta')} AS mu FROM l), b AS (SELECT * FROM b{i})")
    return "WITH " + ",\n".join(out) + "\n"


#: Inverse of the products: two regressors and, for one, the same with h01 = 0 and h11 = 1.
INVERSE = "v AS (SELECT *, h11 / (h00 * h11 - h01 * h01) AS i00, -h01 / (h00 * h11 - h01 * h01) AS i01, h00 / (h00 * h11 - h01 * h01) AS i11 FROM b)"


def coefficients(names: list[str], cov: str, digits: int = 6) -> str:
    """Rows (term, estimate, std_error) from b and a relation `c` (c00, c01, c11) that the text `cov` defines."""
    rows = [f"SELECT '{n}' AS term, round(b{i}, {digits}) + 0.0 AS estimate, round(sqrt(c{i}{i}), {digits}) AS std_error FROM b, c" for i, n in enumerate(names)]
    return f", {INVERSE}, {cov}\n" + " UNION ALL ".join(rows)


#: Covariances: inverse products, those times the residual variance (p regressors), and a sandwich of scores s summed by `by`.
IID_GLM = "c AS (SELECT i00 AS c00, i01 AS c01, i11 AS c11 FROM v)"


def iid_lm(p: int) -> str:
    return f"c AS (SELECT i00 * s2 AS c00, i01 * s2 AS c01, i11 * s2 AS c11 FROM v, (SELECT sum((y - eta) * (y - eta)) / (count(*) - {p}) AS s2 FROM r))"


def sandwich(p: int, by: str | None = None) -> str:
    second = "t1 * (y - mu)" if p == 2 else "0.0"
    rows = f"SELECT t0 * (y - mu) AS s0, {second} AS s1 FROM r" if by is None else f"SELECT sum(t0 * (y - mu)) AS s0, sum({second}) AS s1 FROM r GROUP BY {by}"
    factor = "1.0" if by is None else "count(*) * 1.0 / (count(*) - 1)"
    return (
        f"q AS (SELECT {factor} * sum(s0 * s0) AS m00, {factor} * sum(s0 * s1) AS m01, {factor} * sum(s1 * s1) AS m11 FROM ({rows})), "
        "c AS (SELECT i00 * (i00 * m00 + i01 * m01) + i01 * (i00 * m01 + i01 * m11) AS c00, i00 * (i01 * m00 + i11 * m01) + i01 * (i01 * m01 + i11 * m11) AS c01, "
        "i01 * (i01 * m00 + i11 * m01) + i11 * (i01 * m01 + i11 * m11) AS c11 FROM v, q)"
    )


def tobit(frame: str, y: str, x: str, fe: str, lower: str, upper: str, steps: int, halvings: int = 20, gain: str = "1e-6") -> str:
    """WITH clauses that end in `b` (beta, h): the tobit loop with one regressor and one effect. A step is halved until the sum of squares
    falls by `gain`; once none does, further steps change nothing."""
    density = lambda v: f"({PHI.format(x=v)})"
    cdf = lambda v: CDF.format(x=v)
    out = [f"n0 AS MATERIALIZED (SELECT *, avg(y) OVER () AS eta FROM (SELECT ({y})::DOUBLE AS y, ({x})::DOUBLE AS x0, {fe} AS f0 FROM {frame}))", "c0 AS (SELECT 0.0::DOUBLE AS beta)"]
    for i in range(steps):
        out.append(f"s{i} AS MATERIALIZED (SELECT sqrt(avg((y - eta) * (y - eta)) FILTER (WHERE y > {lower} AND y < {upper})) AS s, sum((y - eta) * (y - eta)) AS dev FROM n{i})")
        out.append(f"u{i} AS (SELECT *, CASE WHEN y <= {lower} THEN ({lower} - eta) / s WHEN y >= {upper} THEN (eta - {upper}) / s END AS v FROM n{i}, s{i})")
        out.append(f"l{i} AS MATERIALIZED (SELECT *, CASE WHEN v IS NOT NULL THEN {density('v')} / {cdf('v')} END AS r FROM u{i})")
        out.append(f"w{i} AS (SELECT *, coalesce(r * (r + v), 1.0) / (s * s) AS ww, CASE WHEN v IS NULL THEN y WHEN y <= {lower} THEN eta - s / (r + v) ELSE eta + s / (r + v) END AS z FROM l{i})")
        out.append(f"d{i} AS MATERIALIZED (SELECT *, z - sum(ww * z) OVER p / sum(ww) OVER p AS tz, x0 - sum(ww * x0) OVER p / sum(ww) OVER p AS t0 FROM w{i} WINDOW p AS (PARTITION BY f0))")
        out.append(f"g{i} AS MATERIALIZED (SELECT sum(ww * t0 * tz) / sum(ww * t0 * t0) AS b0, sum(ww * t0 * t0) AS h FROM d{i})")
        out.append(f"e{i} AS MATERIALIZED (SELECT y, x0, f0, eta, z - tz + b0 * t0 - eta AS move, dev FROM d{i}, g{i})")
        sums = ", ".join(f"sum(pow(y - eta - {0.5**k!r} * move, 2)) AS q{k}" for k in range(halvings))
        pick = " ".join(f"WHEN (q{k} - dev) / (0.1 + q{k}) <= -{gain} THEN {0.5**k!r}" for k in range(halvings))
        out.append(f"r{i} AS MATERIALIZED (SELECT CASE {pick} ELSE 0.0 END AS rho FROM (SELECT max(dev) AS dev, {sums} FROM e{i}))")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT (1 - rho) * beta + rho * b0 AS beta, g{i}.h FROM c{i}, g{i}, r{i})")
        out.append(f"n{i + 1} AS MATERIALIZED (SELECT y, x0, f0, eta + rho * move AS eta FROM e{i}, r{i})")
    return "WITH " + ",\n".join([*out, f"b AS (SELECT * FROM c{steps})"]) + "\n"
