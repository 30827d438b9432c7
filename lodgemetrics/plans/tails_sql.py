"""Tail probabilities as SQL expressions, by series that the operators do not use."""

from __future__ import annotations


def normal_p(z: str) -> str:
    """Two-sided p of a standard normal statistic: the error function's power series."""
    x = f"(abs({z}) / sqrt(2))"
    series = f"list_sum(list_transform(range(0, 150), lambda k: pow(-1, k) * pow({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))"
    return f"CASE WHEN abs({z}) > 7 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * {series} END"


def chi2_p(x: str, dof: str) -> str:
    """Upper tail of chi-square with whole degrees of freedom: a finite sum, and a normal tail where they are odd."""
    h = f"({x} / 2)"
    even = f"list_sum(list_transform(range(0, CAST({dof} AS BIGINT) // 2), lambda i: exp(i * ln({h}) - {h} - lgamma(i + 1))))"
    odd = (f"list_sum(list_transform(range(1, (CAST({dof} AS BIGINT) - 1) // 2 + 1), "
           f"lambda i: exp((i - 0.5) * ln({h}) - {h} - lgamma(i + 0.5))))")
    return (f"CASE WHEN {x} <= 0 THEN 1.0 WHEN CAST({dof} AS BIGINT) % 2 = 0 THEN {even} "
            f"ELSE ({normal_p(f'sqrt({x})')}) + coalesce({odd}, 0) END")


def fisher_p(a: str, b: str, c: str, d: str) -> str:
    """Two-sided hypergeometric p: every term no likelier than the observed one."""
    n = f"({a} + {b} + {c} + {d})"

    def log_p(k: str) -> str:
        return (f"(lgamma({a} + {b} + 1) + lgamma({c} + {d} + 1) + lgamma({a} + {c} + 1) + lgamma({b} + {d} + 1) - lgamma({n} + 1)"
                f" - lgamma({k} + 1) - lgamma({a} + {b} - {k} + 1) - lgamma({a} + {c} - {k} + 1) - lgamma({d} - {a} + {k} + 1))")

    low, high = f"greatest(0, {a} - {d})", f"least({a} + {b}, {a} + {c})"
    return (f"list_sum(list_transform(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1), lambda k: "
            f"CASE WHEN {log_p('k')} <= {log_p(a)} + 1e-7 THEN exp({log_p('k')}) ELSE 0 END))")


def mcnemar_p(a: str, b: str) -> str:
    """Two-sided binomial p of discordant counts."""
    n = f"({a} + {b})"
    return (f"least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({a}, {b}) AS BIGINT) + 1), lambda k: "
            f"exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2)))))")
