"""SQL of the damped least-squares fits, step by step as the operator takes them."""

from __future__ import annotations

from muonloom.operators import fits
from muonloom.plans.registry import num

#: Value and derivatives of the curves in x and the parameters {0}, {1}, {2}.
GAUSS = [c.replace("Z", "((x - {1}) / {2})").replace("E", "exp(-((x - {1}) / {2}) * ((x - {1}) / {2}) / 2.0e0)")
         for c in ("{0} * E", "E", "{0} * E * Z / {2}", "{0} * E * Z * Z / {2}")]
_S = "(1.0e0 / (1.0e0 + exp(least(700.0e0, greatest(-700.0e0, -{1} * (x - {2}))))))"
SIGMOID = [c.replace("S", _S) for c in ("{0} * S", "S", "{0} * S * (1.0e0 - S) * (x - {2})", "-{0} * S * (1.0e0 - S) * {1}")]


def _sums(curve: list[str], p: tuple[str, ...], out: str) -> str:
    """Ten sums over the points: cost, upper triangle of J'J, J'r."""
    f, *j = [f"({c.format(*p).replace('x ', 'xs[i] ')})" for c in curve]
    w, res = "ws[i]", f"(ys[i] - {f})"
    terms = [f"{w} * {res} * {res}"] + [f"{w} * {j[a]} * {j[b]}" for a in range(3) for b in range(a, 3)] \
        + [f"{w} * {j[a]} * {res}" for a in range(3)]
    return ", ".join(f"list_sum(list_transform(range(1, len(xs) + 1), lambda i: {t})) AS {out}{n}"
                     for n, t in enumerate(terms))


def fit_ctes(key: str, points: str, start: str, curve: list[str], steps: int = fits.STEPS) -> str:
    """CTEs (in a recursive WITH) that end in ``fit``: key, n, converged, cost, p0..p2, e0..e2, c01, c02, c12.

    ``points``: SELECT of key, x, y, w; ``start``: SELECT of key, p0, p1, p2.
    """
    now = ", ".join(f"s{n}" for n in range(10))
    pick = lambda a, b, name: f"CASE WHEN t0 <= s0 THEN {a} ELSE {b} END AS {name}"
    kept = ", ".join([pick(f"q{i}", f"p{i}", f"p{i}") for i in range(3)]
                     + [pick(f"greatest(damp * {num(fits.DOWN)}, 1e-12)", f"least(damp * {num(fits.UP)}, 1e12)", "damp")]
                     + [pick(f"t{n}", f"s{n}", f"s{n}") for n in range(10)])
    return f"""
    pts AS (SELECT {key}, COUNT(*) AS n, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys, list(w ORDER BY x) AS ws
            FROM ({points}) GROUP BY {key}),
    st AS ({start}),
    it AS (SELECT {key}, 0 AS k, p0, p1, p2, {num(fits.DAMP)} AS damp, {_sums(curve, ('p0', 'p1', 'p2'), 's')}
           FROM pts JOIN st USING ({key}) WHERE n >= 3
           UNION ALL
           SELECT {key}, k + 1, {kept}
           FROM (SELECT *, {_sums(curve, ('q0', 'q1', 'q2'), 't')}
                 FROM (SELECT {key}, k, p0, p1, p2, damp, {now},
                              s1 * (1.0e0 + damp) AS a00, s4 * (1.0e0 + damp) AS a11, s6 * (1.0e0 + damp) AS a22,
                              a11 * a22 - s5 * s5 AS k0, s3 * s5 - s2 * a22 AS k1, s2 * s5 - s3 * a11 AS k2,
                              a00 * a22 - s3 * s3 AS k3, s2 * s3 - a00 * s5 AS k4, a00 * a11 - s2 * s2 AS k5,
                              a00 * k0 + s2 * k1 + s3 * k2 AS det,
                              p0 + coalesce((k0 * s7 + k1 * s8 + k2 * s9) / nullif(det, 0), 0) AS q0,
                              p1 + coalesce((k1 * s7 + k3 * s8 + k4 * s9) / nullif(det, 0), 0) AS q1,
                              p2 + coalesce((k2 * s7 + k4 * s8 + k5 * s9) / nullif(det, 0), 0) AS q2
                       FROM it WHERE k < {steps}) JOIN pts USING ({key}))),
    ends AS (SELECT {key}, n, s0 AS cost, p0, p1, p2, s1, s4, s6, s7, s8, s9, s0 / greatest(n - 3, 1) AS f,
                    s1 * (s4 * s6 - s5 * s5) + s2 * (s3 * s5 - s2 * s6) + s3 * (s2 * s5 - s3 * s4) AS det,
                    (s4 * s6 - s5 * s5) / nullif(det, 0) AS v0, (s3 * s5 - s2 * s6) / nullif(det, 0) AS v1,
                    (s2 * s5 - s3 * s4) / nullif(det, 0) AS v2, (s1 * s6 - s3 * s3) / nullif(det, 0) AS v3,
                    (s2 * s3 - s1 * s5) / nullif(det, 0) AS v4, (s1 * s4 - s2 * s2) / nullif(det, 0) AS v5
             FROM it JOIN (SELECT {key}, n FROM pts) USING ({key}) WHERE k = {steps}),
    judged AS (SELECT *, coalesce(s1 * pow(v0 * s7 + v1 * s8 + v2 * s9, 2) + s4 * pow(v1 * s7 + v3 * s8 + v4 * s9, 2)
                                  + s6 * pow(v2 * s7 + v4 * s8 + v5 * s9, 2)
                                  <= {num(fits.CLOSE ** 2)} * (s1 * p0 * p0 + s4 * p1 * p1 + s6 * p2 * p2), FALSE) AS converged
               FROM ends),
    fit AS (SELECT {key}, n, converged, {', '.join(
        f'CASE WHEN converged THEN {v} END AS {name}' for name, v in [
            ('cost', 'cost'), *[(f'p{i}', f'p{i}') for i in range(3)],
            *[(f'e{i}', f'sqrt(greatest(v{k} * f, 0))') for i, k in enumerate((0, 3, 5))],
            ('c01', 'v1 * f'), ('c02', 'v2 * f'), ('c12', 'v4 * f')])} FROM judged
            UNION ALL
            SELECT {key}, n, FALSE, {', '.join(['NULL::DOUBLE'] * 10)} FROM pts WHERE n < 3)"""
