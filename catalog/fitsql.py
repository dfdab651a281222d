"""Regressions as plain SQL, to check the library's fits: a fixed number of Newton rounds, each a common table expression.

The source has columns g (group), lvl (level of the factor), y and x0, x1, ... Every round takes the sums of each level, folds
them into each group's system of p equations, solves it by Gauss-Jordan steps and moves coefficients and level effects. All
written out, so a fit that stops too early, or at another point, differs here.
"""

from __future__ import annotations

ROUNDS = 9

#: Two-sided p of the normal law by Simpson's rule over twelve deviations.
NORMAL_P = """list_sum(list_transform(range(0,2001), lambda i: (CASE WHEN i=0 OR i=2000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*exp(-power(abs({z})+i*0.006,2)/2)))*0.002*sqrt(2/pi())"""


def _gauss(name: str, source: str, p: int, width: int) -> dict[str, str]:
    """One expression for each eliminated column of the rows m0_0 .. m{p-1}_{width-1}; the last is called ``name``."""
    out = {}
    for k in range(p):
        cols = [f"m{i}_{j}/m{k}_{k} AS m{i}_{j}" if i == k else f"m{i}_{j}-m{i}_{k}*m{k}_{j}/m{k}_{k} AS m{i}_{j}" for i in range(p) for j in range(width)]
        own = name if k == p - 1 else f"{name}_{k}"
        out[own] = f"SELECT g, {', '.join(cols)} FROM {source}"
        source = own
    return out


def _unit(i: int, p: int) -> str:
    return ", ".join(f"{float(i == j)} AS m{i}_{p + 1 + j}" for j in range(p))


def logit(rows: str, p: int, names: list[str], factor: str | None) -> tuple[str, dict[str, str]]:
    """(final statement, common table expressions); the statement gives g, term, b, se and what follows from them."""
    xs = [f"x{i}" for i in range(p)]
    parts = {
        "fc": f"SELECT g, lvl, y, {', '.join(xs)}, count(*)::DOUBLE AS w FROM ({rows}) GROUP BY ALL",
        "fl": "SELECT g, lvl, sum(w) AS n, sum(w*y) AS s FROM fc GROUP BY g, lvl",
        "s0": f"SELECT g, lvl, ln(s/(n-s)) AS a, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(p))} FROM fl WHERE s>0 AND s<n",
    }
    eta = "a+" + "+".join(f"b{i}*x{i}" for i in range(p))
    for k in range(ROUNDS):
        v = ", ".join(f"sum(h*x{i}) AS v{i}, sum(r*x{i}) AS g{i}" for i in range(p))
        hh = ", ".join(f"sum(h*x{i}*x{j}) AS h{i}_{j}" for i in range(p) for j in range(p))
        parts[f"e{k}"] = f"SELECT g, lvl, sum(h) AS s, sum(r) AS r, {v}, {hh} FROM (SELECT *, w*q*(1-q) AS h, w*(y-q) AS r FROM (SELECT fc.*, 1/(1+exp(-({eta}))) AS q FROM fc JOIN s{k} USING (g, lvl))) GROUP BY g, lvl"
        cols = [", ".join([*(f"sum(h{i}_{j}-v{i}*v{j}/s) AS m{i}_{j}" for j in range(p)), f"sum(g{i}-v{i}*r/s) AS m{i}_{p}", _unit(i, p)]) for i in range(p)]
        parts[f"t{k}"] = f"SELECT g, {', '.join(cols)} FROM e{k} GROUP BY g"
        parts |= _gauss(f"q{k}", f"t{k}", p, 2 * p + 1)
        fit = "+".join(f"v{i}*m{i}_{p}" for i in range(p))
        parts[f"s{k + 1}"] = f"SELECT g, lvl, a+(r-({fit}))/s AS a, {', '.join(f'b{i}+m{i}_{p} AS b{i}' for i in range(p))} FROM s{k} JOIN e{k} USING (g, lvl) JOIN q{k} USING (g)"
    end, last = f"s{ROUNDS}", ROUNDS - 1
    form = lambda l: "+".join(f"m{i}_{p + 1 + j}*{l(i)}*{l(j)}" for i in range(p) for j in range(p))
    parts["lv"] = f"SELECT g, lvl, a, s, {', '.join(f'v{i}/s AS u{i}' for i in range(p))} FROM {end} JOIN e{last} USING (g, lvl)"
    parts["rf"] = f"SELECT g, a AS ra, s AS rs, lvl AS rl, {', '.join(f'u{i} AS ru{i}' for i in range(p))} FROM lv WHERE (g, lvl) IN (SELECT (g, min(lvl)) FROM lv GROUP BY g)"
    name = f"'{factor}='||lvl" if factor else "'(intercept)'"
    found = [f"SELECT g, '{names[i]}' AS term, any_value(b{i}) AS b, sqrt(any_value(m{i}_{p + 1 + i})) AS se FROM {end} JOIN q{last} USING (g) GROUP BY g" for i in range(p)]
    found.append(f"SELECT g, '(intercept)', ra, sqrt(1/rs+{form(lambda i: f'ru{i}')}) FROM rf JOIN q{last} USING (g)")
    found.append(f"SELECT g, {name}, a-ra, sqrt(1/s+1/rs+{form(lambda i: f'(u{i}-ru{i})')}) FROM lv JOIN rf USING (g) JOIN q{last} USING (g) WHERE lvl<>rl")
    found.append(f"SELECT g, {name}, CASE WHEN s=0 THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END, NULL FROM fl WHERE s=0 OR s=n")
    parts["fitted"] = " UNION ALL ".join(found)
    p_value = NORMAL_P.format(z="b/se")
    final = f"""SELECT g, term, round(b,6) AS b, round(se,6) AS se, round(exp(b),6) AS odds_ratio, round(exp(b-1.959963984540054*se),6) AS lo,
      round(exp(b+1.959963984540054*se),6) AS hi, round({p_value},6) AS p FROM fitted"""
    return final, parts


def ols_hc1(rows: str, p: int, names: list[str], factor: str) -> tuple[str, dict[str, str]]:
    """Least squares with HC1 errors, level effects as residual means; errors of level effects by influence of every row."""
    xs = [f"x{i}" for i in range(p)]
    parts = {
        "fr": f"SELECT *, {', '.join(f'x{i}-avg(x{i}) OVER l AS d{i}' for i in range(p))}, y-avg(y) OVER l AS dy, count(*) OVER l AS nl FROM ({rows}) WINDOW l AS (PARTITION BY g, lvl)",
        "t0": f"SELECT g, {', '.join(', '.join([*(f'sum(d{i}*d{j}) AS m{i}_{j}' for j in range(p)), f'sum(d{i}*dy) AS m{i}_{p}', _unit(i, p)]) for i in range(p))} FROM fr GROUP BY g",
    }
    parts |= _gauss("q0", "t0", p, 2 * p + 1)
    fit = "+".join(f"m{i}_{p}*d{i}" for i in range(p))
    infl = [f"({'+'.join(f'm{i}_{p + 1 + j}*d{j}' for j in range(p))})*(dy-({fit}))" for i in range(p)]
    parts["rs"] = f"SELECT g, lvl, dy-({fit}) AS e, nl, {', '.join(f'{v} AS f{i}' for i, v in enumerate(infl))} FROM fr JOIN q0 USING (g)"
    parts["dof"] = f"SELECT g, count(*)/(count(*)-{p}-count(DISTINCT lvl))::DOUBLE AS k FROM fr GROUP BY g"
    parts["lm"] = f"SELECT g, lvl, avg(y) AS my, {', '.join(f'avg({x}) AS mx{i}' for i, x in enumerate(xs))} FROM ({rows}) GROUP BY g, lvl"
    parts["rl"] = "SELECT g, min(lvl) AS ref FROM lm GROUP BY g"
    effect = "+".join(f"m{i}_{p}*mx{i}" for i in range(p))
    parts["al"] = f"SELECT lm.*, my-({effect}) AS a FROM lm JOIN q0 USING (g)"
    # Influence of a row on a level's effect: its own residual over the level's rows, less what it moves the slopes by.
    own = "CASE WHEN rs.lvl={0}.lvl THEN e/nl ELSE 0 END-(" + "+".join(f"f{i}*{{0}}.mx{i}" for i in range(p)) + ")"
    found = [f"SELECT g, '{names[i]}' AS term, any_value(m{i}_{p}) AS b, sqrt(any_value(k)*sum(f{i}*f{i})) AS se FROM rs JOIN q0 USING (g) JOIN dof USING (g) GROUP BY g" for i in range(p)]
    found.append(f"SELECT z.g, '(intercept)', any_value(z.a), sqrt(any_value(k)*sum(power({own.format('z')},2))) FROM rs JOIN rl ON rl.g=rs.g JOIN al z ON z.g=rs.g AND z.lvl=ref JOIN dof ON dof.g=rs.g GROUP BY z.g")
    found.append(f"""SELECT c.g, '{factor}='||c.lvl, any_value(c.a-z.a), sqrt(any_value(k)*sum(power(({own.format('c')})-({own.format('z')}),2))) FROM rs JOIN rl ON rl.g=rs.g
      JOIN al z ON z.g=rs.g AND z.lvl=ref JOIN al c ON c.g=rs.g AND c.lvl<>ref JOIN dof ON dof.g=rs.g GROUP BY c.g, c.lvl""")
    parts["fitted"] = " UNION ALL ".join(found)
    return f"SELECT g, term, round(b,6) AS b, round(se,6) AS se_hc1, round({NORMAL_P.format(z='b/se')},6) AS p FROM fitted", parts
