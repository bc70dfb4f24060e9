"""The closed-form statistics as DuckDB text, for the oracle statements."""
from __future__ import annotations

Z = "1.6448536269514722e0"


def erfc(x: str) -> str:
    t = f"(1e0 / (1e0 + 0.3275911e0 * ({x})))"
    return (f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-({x}) * ({x})))")


def two_sided(z: str) -> str:
    return erfc(f"abs({z}) / sqrt(2e0)")


def wilson(x: str, n: str, side: str) -> str:
    p, n = f"(({x})::DOUBLE / nullif({n}, 0))", f"nullif({n}, 0)::DOUBLE"
    mid = f"({p} + {Z} * {Z} / (2 * {n}))"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n})))"
    den = f"(1 + {Z} * {Z} / {n})"
    bound = f"greatest(0e0, ({mid} - {half}) / {den})" if side == "lo" else f"least(1e0, ({mid} + {half}) / {den})"
    return f"(CASE WHEN {n} > 0 THEN {bound} END)"


def half(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0.5e0 ELSE {x}::DOUBLE END)"


def ratio(x1: str, n1: str, x0: str, n0: str) -> str:
    return f"(({half(x1)} / {n1}) / ({half(x0)} / {n0}))"


def ratio_se(x1: str, n1: str, x0: str, n0: str) -> str:
    return f"sqrt(greatest(1e-12, 1e0 / {half(x1)} - 1e0 / {n1} + 1e0 / {half(x0)} - 1e0 / {n0}))"


def mean_se(s1: str, q1: str, n1: str, s0: str, q0: str, n0: str) -> str:
    def var(s, q, n):
        return f"greatest(1e-9, ({q} - {n} * ({s}::DOUBLE / {n}) * ({s}::DOUBLE / {n})) / ({n} - 1))"
    return f"sqrt({var(s1, q1, n1)} / {n1} + {var(s0, q0, n0)} / {n0})"


def poisson_lo(k: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN 0e0 ELSE greatest(0e0, {k} * pow(1 - 1e0 / (9 * {k}) - {Z} / (3 * sqrt({k}::DOUBLE)), 3)) END)"


def poisson_hi(k: str) -> str:
    return f"(CASE WHEN {k} = 0 THEN -ln(0.1e0) ELSE ({k} + 1) * pow(1 - 1e0 / (9 * ({k} + 1)) + {Z} / (3 * sqrt(({k} + 1)::DOUBLE)), 3) END)"


def poisson_tail(k: str, lam: str) -> str:
    return f"greatest(1e-300, 1e0 - coalesce(list_sum(list_transform(range(0, ({k})::INT), lambda i: exp(i * ln(nullif({lam}, 0)) - ({lam}) - lgamma(i + 1)))), 0))"
