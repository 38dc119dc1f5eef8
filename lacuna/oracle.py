"""DuckDB SQL for the library's queries, over the same tables. Names, types and rounding follow `queries.tidy`."""

from __future__ import annotations

from itertools import combinations, permutations

COLS = ("hr", "bp", "k3")

_OBS = """obs AS (
  SELECT user_id AS id, ts AS clock, event_type,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value END AS hr, CASE WHEN event_type <> 'error' THEN value END AS bp,
         CASE WHEN k % 7 <> 0 THEN k END AS k3
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY clock) AS clock_no,
         CAST(hr IS NULL AS INTEGER) AS hr_mask, CAST(bp IS NULL AS INTEGER) AS bp_mask, CAST(k3 IS NULL AS INTEGER) AS k3_mask
  FROM obs
), long AS (
  SELECT id, clock, clock_no, 'hr' AS variable, hr_mask AS mask, CAST(hr AS DOUBLE) AS value FROM p
  UNION ALL SELECT id, clock, clock_no, 'bp', bp_mask, CAST(bp AS DOUBLE) FROM p
  UNION ALL SELECT id, clock, clock_no, 'k3', k3_mask, CAST(k3 AS DOUBLE) FROM p
)"""
_IV = """iv AS (
  SELECT * FROM (SELECT *, (epoch_us(clock) - epoch_us(lag(clock) OVER (PARTITION BY id ORDER BY clock, clock_no))) // 1000000 AS s FROM p) WHERE s > 0
)"""
_RUNS = """runs AS (
  SELECT id, variable, CAST(clock_no - n0 - 1 AS BIGINT) AS count_clock_no, nullif((epoch_us(clock) - epoch_us(c0)) // 1000000, 0) AS time_length, c0 AS run_start_clock, clock AS run_end_clock, value AS return_value
  FROM (SELECT *, lag(clock) OVER w AS c0, lag(clock_no) OVER w AS n0 FROM long WHERE mask = 0 WINDOW w AS (PARTITION BY id, variable ORDER BY clock, clock_no)) WHERE n0 IS NOT NULL
)"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_OBS, *ctes]) + "\n" + body


def r(x: str, name: str = "") -> str:
    """A double as the queries give it."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0" + (f" AS {name}" if name else "")


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def near(x: str, q: float, where: str = "") -> str:
    """Quantile by the nearest element."""
    a = f"list_sort(list({x}){' FILTER (WHERE ' + where + ')' if where else ''})"
    return f"({a})[CAST(floor((len({a}) - 1) * {q} + 0.5) AS BIGINT) + 1]"


def corr(x: str, y: str) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_samp(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) {both} / nullif(stddev_samp(CAST({x} AS DOUBLE)) {both} * stddev_samp(CAST({y} AS DOUBLE)) {both}, 0)"


def burst(x: str, least: int) -> str:
    return f"CASE WHEN count({x}) >= {least} THEN {div(f'stddev_samp({x}) - avg({x})', f'stddev_samp({x}) + avg({x})')} END"


def erfc(x: str) -> str:
    """The complementary error function of x >= 0, from the series of the error function; below 1e-8 it is 0 to the digits compared."""
    term = "exp(2 * n * ln(2.0) + lgamma(n + 1) + (2 * n + 1) * ln(z) - lgamma(2 * n + 2))"
    return f"list_transform([{x}], lambda z: CASE WHEN z < 1e-12 THEN 1.0 WHEN z > 4.2 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 120), lambda n: {term})) END)[1]"


def _mask_query(exprs: dict[str, str], ctes: str = "", tail: str = "p") -> str:
    cols = ", ".join(f"CAST({exprs[c]} AS BIGINT) AS {c}" for c in COLS)
    return _sql(f"SELECT id, clock, clock_no, {cols} FROM {tail}", *([ctes] if ctes else []))


def _ranged(null: str) -> dict[str, str]:
    return {"hr": f"CASE WHEN hr IS NULL THEN {null} ELSE CAST(hr < 10 OR hr > 90 AS INTEGER) END", "bp": f"CASE WHEN bp IS NULL THEN {null} ELSE CAST(bp > 95 AS INTEGER) END", "k3": f"CASE WHEN k3 IS NULL THEN {null} ELSE 0 END"}


def _bounded(lo: str = "{c}_lo", hi: str = "{c}_hi", ranged: bool = False) -> dict[str, str]:
    out = {}
    for c in COLS:
        own = f"({c} < {lo.format(c=c)} OR {c} > {hi.format(c=c)})"
        rng = {"hr": "(hr < 10 OR hr > 90)", "bp": "(bp > 95)"}.get(c) if ranged else None
        out[c] = f"CASE WHEN {c} IS NULL THEN 0 ELSE CAST(coalesce({own}, false)" + (f" OR {rng}" if rng else "") + " AS INTEGER) END"
    return out


def _iqr(group: str) -> str:
    each = ", ".join(f"quantile_cont({c}, 0.25) - 0.6 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, quantile_cont({c}, 0.75) + 0.6 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi" for c in COLS)
    return f"b AS (SELECT {'id AS bid, ' if group else ''}{each} FROM (SELECT id, CAST(hr AS DOUBLE) AS hr, CAST(bp AS DOUBLE) AS bp, CAST(k3 AS DOUBLE) AS k3 FROM p) {group})"


def _mad(group: str, clean: dict[str, str]) -> str:
    by = "id AS bid, " if group else ""
    x = "x AS (SELECT id, " + ", ".join(f"CAST({clean.get(c, c)} AS DOUBLE) AS {c}" for c in COLS) + " FROM p)"
    med = f"med AS (SELECT {by}" + ", ".join(f"median({c}) AS {c}_m" for c in COLS) + f" FROM x {group})"
    on = "JOIN med ON x.id = med.bid" if group else ", med"
    mad = f"mad AS (SELECT {by}" + ", ".join(f"median(abs({c} - {c}_m)) AS {c}_d, any_value({c}_m) AS {c}_m" for c in COLS) + f" FROM x {on} {group})"
    b = "b AS (SELECT " + ("bid, " if group else "") + ", ".join(f"{c}_m - CASE WHEN {c}_d > 0 THEN 1.2 * {c}_d / 0.6745 END AS {c}_lo, {c}_m + CASE WHEN {c}_d > 0 THEN 1.2 * {c}_d / 0.6745 END AS {c}_hi" for c in COLS) + " FROM mad)"
    return ",\n".join([x, med, mad, b])


def _dominant(source: str, x: str, key: str = "") -> str:
    k, on, over = (f"{key}, ", f"JOIN shape USING ({key})", f"PARTITION BY {key}") if key else ("", ", shape", "")
    g = f"GROUP BY {key}" if key else ""
    return f"""bins AS (SELECT {k}CAST(round_even({x} / 60.0, 0) AS BIGINT) AS bin, count(*) AS c FROM {source} WHERE {x} IS NOT NULL GROUP BY ALL),
tot AS (SELECT *, sum(c) OVER ({over}) AS n FROM bins),
shape AS (SELECT {k}arg_max(bin, c * 1000000000 - bin) AS mode, CAST(max(n) AS BIGINT) AS n, count(*) AS n_bins, max(c) AS top, list_sum(list_sort(list(-(c / n) * log2(c / n)))) AS h FROM tot {g}),
dom AS (SELECT {k}any_value(n) AS n_intervals, any_value(mode * 60.0) AS dominant_interval_seconds, any_value(top) AS dominant_count, any_value(shape.n_bins) AS n_bins, any_value(h) AS entropy,
        avg(CAST({x} BETWEEN mode * 60.0 * 0.5 AND mode * 60.0 * 1.5 AS DOUBLE)) AS adherence_rate FROM {source} {on} WHERE {x} IS NOT NULL {g})"""


_DOMINANT = ", ".join([
    "n_intervals", r("dominant_interval_seconds", "dominant_interval_seconds"), r("CASE WHEN dominant_interval_seconds > 0 THEN 1 / dominant_interval_seconds END", "dominant_frequency_hz"), "dominant_count", r("dominant_count / n_intervals", "dominant_share"), "n_bins",
    r("adherence_rate", "adherence_rate"), r("entropy", "entropy"), r("CASE WHEN n_bins <= 1 THEN 0 ELSE entropy / log2(n_bins) END", "normalized_entropy"), "CAST(60 AS DOUBLE) AS bin_resolution_seconds"])


def _entropy(source: str, x: str, keys: str, tag: str, least: int = 2) -> str:
    """{tag}: keys, n, dominant, entropy, adherence."""
    k = ", ".join(f"a.{c}" for c in keys.split(", "))
    return f"""{tag}_bins AS (SELECT {keys}, CAST(round_even({x} / 60.0, 0) AS BIGINT) AS bin, count(*) AS c FROM {source} WHERE {x} IS NOT NULL GROUP BY ALL),
{tag}_tot AS (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS n FROM {tag}_bins),
{tag}_shape AS (SELECT {keys}, arg_max(bin, c * 1000000000 + bin) AS mode, CAST(max(n) AS BIGINT) AS n, count(*) AS n_bins, list_sum(list_sort(list(-(c / n) * log2(c / n)))) AS h FROM {tag}_tot GROUP BY {keys}),
{tag} AS (SELECT {k}, any_value(n) AS n_intervals, CASE WHEN any_value(n) >= {least} THEN any_value(mode * 60.0) END AS dominant_interval_seconds,
  CASE WHEN any_value(n) >= {least} THEN CASE WHEN any_value(n_bins) <= 1 THEN 0 ELSE any_value(h) / nullif(log2(any_value(n_bins)), 0) END END AS entropy,
  CASE WHEN any_value(n) >= {least} THEN avg(CAST({x} BETWEEN mode * 60.0 * 0.5 AND mode * 60.0 * 1.5 AS DOUBLE)) END AS adherence
  FROM {source} a JOIN {tag}_shape USING ({keys}) WHERE {x} IS NOT NULL GROUP BY {k})"""


_CASE_IRR = _entropy("iv", "s", "id", "ea") + f""",
case_irr AS (SELECT id, {div('stddev_samp(s)', 'avg(s)')} AS interval_cv, {div(near('s', 0.75) + ' - ' + near('s', 0.25), near('s', 0.75) + ' + ' + near('s', 0.25))} AS interval_qcod,
  any_value(adherence) AS interval_adh_rate, any_value(entropy) AS interval_entropy FROM iv LEFT JOIN ea USING (id) GROUP BY id)"""

_S = "hr_mask + bp_mask + k3_mask"
_CASE_INTER = """pat AS (SELECT id, hr_mask, bp_mask, k3_mask, count(*) AS c FROM p WHERE hr_mask + bp_mask + k3_mask > 0 GROUP BY ALL),
pe AS (SELECT id, CASE WHEN count(*) = 1 THEN 0 ELSE list_sum(list_sort(list(-(c / n) * log2(c / n)))) / log2(count(*)) END AS pattern_entropy FROM (SELECT *, sum(c) OVER (PARTITION BY id) AS n FROM pat) GROUP BY id),
case_inter AS (SELECT id, CAST(sum(hr_mask + bp_mask + k3_mask) * 100 AS DOUBLE) / (count(*) * 3) AS avg_indicated_pct, CAST(sum(hr_mask + bp_mask + k3_mask) * 100 AS DOUBLE) / nullif(count(*) FILTER (WHERE hr_mask + bp_mask + k3_mask > 0) * 3, 0) AS co_concentration,
  (max(hr_mask) + max(bp_mask) + max(k3_mask)) / 3.0 AS breadth, any_value(pattern_entropy) AS pattern_entropy,
  greatest(""" + ", ".join(f"CASE WHEN least(sum({a}_mask), sum({b}_mask)) = 0 THEN 0 ELSE sum({a}_mask * {b}_mask) / least(sum({a}_mask), sum({b}_mask)) END" for a, b in combinations(COLS, 2)) + """) AS max_pair_overlap
  FROM p LEFT JOIN pe USING (id) GROUP BY id)"""

_SHARE = "share AS (SELECT id, variable, sum(mask) * 100 / count(*) AS indicated_pct FROM long GROUP BY ALL)"
_GAPS = _entropy("g", "time_length", "id, variable", "ge", 1)
_GAP_CASE = f"""g AS (SELECT * FROM runs WHERE count_clock_no > 0), {_GAPS},
gst AS (SELECT id, variable, count(*) AS n_gaps, CASE WHEN count(time_length) >= 2 THEN {div('stddev_samp(time_length)', 'avg(time_length)')} END AS gap_cv,
  CASE WHEN count(time_length) >= 4 THEN {div('quantile_cont(CAST(time_length AS DOUBLE), 0.75) - quantile_cont(CAST(time_length AS DOUBLE), 0.25)', 'quantile_cont(CAST(time_length AS DOUBLE), 0.75) + quantile_cont(CAST(time_length AS DOUBLE), 0.25)')} END AS gap_qcod,
  {burst('time_length', 3)} AS gap_burstiness_coeff, max(time_length) AS longest FROM g GROUP BY ALL),
ons AS (SELECT id, variable, CASE WHEN count(*) >= 2 THEN {div('stddev_samp(o)', 'avg(o)')} END AS gap_onset_cv FROM (SELECT id, variable, (epoch_us(run_start_clock) - epoch_us(lag(run_start_clock) OVER (PARTITION BY id, variable ORDER BY run_start_clock))) // 1000000 AS o FROM g) WHERE o > 0 GROUP BY ALL),
span AS (SELECT id, min(clock) AS t0, (epoch_us(max(clock)) - epoch_us(min(clock))) // 1000000 AS len FROM p GROUP BY id),
cen AS (SELECT id, variable, avg({div('(epoch_us(clock) - epoch_us(t0)) // 1000000', 'len')}) AS gap_missing_centroid FROM long JOIN span USING (id) WHERE mask = 1 GROUP BY ALL),
gap_case AS (SELECT id, variable, coalesce(n_gaps, 0) AS n_gaps, gap_cv, gap_qcod, gap_burstiness_coeff, entropy AS gap_normalized_entropy, adherence AS gap_adherence_rate, {div('longest', 'len')} AS max_gap_fraction, gap_onset_cv, gap_missing_centroid
  FROM (SELECT DISTINCT id, variable FROM runs) JOIN span USING (id) LEFT JOIN gst USING (id, variable) LEFT JOIN ge USING (id, variable) LEFT JOIN ons USING (id, variable) LEFT JOIN cen USING (id, variable))"""


def _spearman(pairs: str, keys: str, extra: str = "") -> str:
    """sp: keys, n, correlation from a CTE with keys, vx, vy."""
    lead = lambda v: f"CASE WHEN abs({v}) < 1e-250 THEN {v} + 0.0 ELSE round_even({v} * pow(10.0, 11 - floor(log10(abs({v})))), 0) / pow(10.0, 11 - floor(log10(abs({v})))) END"
    return f"""ok AS (SELECT * REPLACE ({lead('vx')} AS vx, {lead('vy')} AS vy) FROM {pairs} WHERE vx IS NOT NULL AND vy IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY vx) + (count(*) OVER (PARTITION BY {keys}, vx) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY vy) + (count(*) OVER (PARTITION BY {keys}, vy) - 1) / 2.0 AS ry FROM ok),
sp AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) END AS correlation FROM rk GROUP BY {keys})"""


def _pairs(source: str, cols: tuple[str, ...]) -> str:
    return "pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, CAST({a} AS DOUBLE) AS vx, CAST({b} AS DOUBLE) AS vy FROM {source}" for a, b in combinations(cols, 2)) + ")"


_U = """rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0 AS rnk FROM {s} WHERE v IS NOT NULL)"""
_TAIL = "CAST(n AS BIGINT) AS n"


def _acf(source: str, x: str, keys: str, lags: int = 20) -> str:
    k = f"{keys}, " if keys else ""
    part = f"{keys}, id" if keys else "id"
    stats = f"st AS (SELECT {k}avg({x}) AS m, var_samp({x}) AS v FROM {source} {'GROUP BY ' + keys if keys else ''})"
    lagged = f"lg AS (SELECT {k}id, lags.lag AS lag, {x} AS x, lag({x}, lags.lag) OVER (PARTITION BY {part}, lags.lag ORDER BY clock, clock_no) AS y FROM {source}, (SELECT unnest(range(1, {lags + 1})) AS lag) lags)"
    on = f"JOIN st USING ({keys})" if keys else ", st"
    return _sql(f"SELECT {k}CAST(lag AS BIGINT) AS lag, count(*) AS n_pairs, {r('sum((x - m) * (y - m)) / (any_value(v) * count(*))', 'autocorr')} FROM lg {on} WHERE x IS NOT NULL AND y IS NOT NULL AND v > 0 GROUP BY {k}lag", *([_IV] if source == "iv" else []), stats, lagged)


def _describe(source: str, x: str, keys: str, probs: dict[str, float]) -> str:
    k = f"{keys}, " if keys else ""
    q = ", ".join(r(f"quantile_cont(CAST({x} AS DOUBLE), {v})", n) for n, v in probs.items())
    return f"SELECT {k}count({x}) AS count, count(*) - count({x}) AS null_count, {r(f'avg({x})', 'mean')}, {r(f'stddev_samp({x})', 'std')}, {r(f'min({x})', 'min')}, {q}, {r(f'max({x})', 'max')} FROM {source} {'GROUP BY ' + keys if keys else ''}"


_P3 = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
_P5 = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_FIRST = "f AS (SELECT variable, value AS v, id % 2 = 0 AS first FROM long WHERE variable IN ('hr', 'bp'))"
_TIES = "ties AS (SELECT variable, sum(CAST(t AS DOUBLE) * t * t - t) AS tt FROM (SELECT variable, v, count(*) AS t FROM f WHERE v IS NOT NULL GROUP BY ALL) GROUP BY variable)"
_GROUPED = f"""val AS (SELECT id, variable, avg(value) AS value_mean, CASE WHEN count(value) >= 2 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS value_iqr FROM long GROUP BY ALL),
tidy AS (SELECT 'preliminary' AS aspect, variable, 'value_mean' AS metric, id, value_mean AS v FROM val UNION ALL SELECT 'preliminary', variable, 'value_iqr', id, value_iqr FROM val
""" + "".join(f" UNION ALL SELECT 'irregularity', 'all', '{m}', id, {m} FROM case_irr" for m in ("interval_cv", "interval_qcod", "interval_adh_rate", "interval_entropy")) + ")"


def _transitions() -> str:
    each = ", ".join(f"count(*) FILTER (WHERE mask = {i} AND nxt = {j}) AS n{i}{j}" for i in (0, 1) for j in (0, 1))
    return f"tr AS (SELECT variable, {each} FROM (SELECT variable, mask, lead(mask) OVER (PARTITION BY id, variable ORDER BY clock, clock_no) AS nxt FROM long) GROUP BY variable)"


def _chi2() -> str:
    each = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, " + ", ".join(f"count(*) FILTER (WHERE {a}_mask = {i} AND {b}_mask = {j}) AS n{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM p" for a, b in permutations(COLS, 2))
    terms = []
    for i in (0, 1):
        for j in (0, 1):
            e = f"((n{i}0 + n{i}1) * (n0{j} + n1{j}) / nullif(CAST(n00 + n01 + n10 + n11 AS DOUBLE), 0))"
            off = f"(abs(n{i}{j} - {e}) - least(0.5, abs(n{i}{j} - {e})))"
            terms.append(f"{off} * {off} / nullif({e}, 0)")
    chi = " + ".join(terms)
    return f"SELECT x, y, n00, n01, n10, n11, {r(chi, 'chi2')}, {r(f'sqrt(({chi}) / (n00 + n01 + n10 + n11))', 'cramers_v')}, {r(erfc(f'sqrt(({chi}) / 2)'), 'p_value')} FROM ({each})"


def _xcorr(lags: int = 10) -> str:
    parts = []
    for a, b in permutations(COLS, 2):
        for k in range(-lags, lags + 1):
            f = f"lag({b}_mask, {k})" if k >= 0 else f"lead({b}_mask, {-k})"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, CAST({k} AS BIGINT) AS lag, {r(corr('m', 'l'), 'correlation')} FROM (SELECT {a}_mask AS m, {f} OVER (PARTITION BY id ORDER BY clock, clock_no) AS l FROM p)")
    return " UNION ALL ".join(parts)


def _rank_biserial(lags: int = 10) -> str:
    parts = []
    for b in COLS:
        for a in COLS:
            if a != b:
                for k in range(-lags, lags + 1):
                    f = f"lag({a}_mask, {k})" if k >= 0 else f"lead({a}_mask, {-k})"
                    parts.append(f"SELECT '{a}' AS x, '{b}' AS y, CAST({k} AS BIGINT) AS lag, CAST({b} AS DOUBLE) AS v, {f} OVER (PARTITION BY id ORDER BY clock, clock_no) AS m FROM p WHERE {b} IS NOT NULL")
    return "rb AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE m IS NOT NULL)"


_RB = """rbs AS (SELECT x, y, lag, sum(m) AS n1, count(*) - sum(m) AS n0, 2 * (sum(m * rnk) - sum(m) * (sum(m) + 1) / 2) / nullif(CAST(sum(m) * (count(*) - sum(m)) AS DOUBLE), 0) - 1 AS rank_biserial FROM rk GROUP BY ALL)"""


def _inter() -> str:
    out = []
    for a, b in permutations(("hr", "bp"), 2):
        for now, x in (("value", a), ("mask", f"{a}_mask")):
            for then, y in (("value", b), ("mask", f"{b}_mask")):
                out.append(r(f"CAST({x} AS DOUBLE) * lag(CAST({y} AS DOUBLE)) OVER w", f'"inter_{a}_{now}_t_{b}_{then}_t-1"'))
    return ", ".join(out)


def _full(x: str, agg: str, n: int) -> str:
    f = f"OVER (PARTITION BY id ORDER BY clock, clock_no ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg}({x}) {f} END"


def _ewma() -> str:
    each = ", ".join(r(f"list_reduce(list(CAST({c}_mask AS DOUBLE)) OVER w, lambda y, x: 0.3 * x + 0.7 * y)", f'"{c}_mask_ewma_0.3"') for c in COLS)
    return f"SELECT id, clock_no, {each} FROM p WINDOW w AS (PARTITION BY id ORDER BY clock, clock_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_AXES = ("avg_indicated_pct", "co_concentration", "breadth", "pattern_entropy")
_IRR_AXES = ("interval_cv", "interval_qcod", "interval_adh_rate", "interval_entropy")


def _cross() -> str:
    axes = [("irregularity", m, m, "case_irr", "") for m in _IRR_AXES] + [("intervariable", m, m, "case_inter", "") for m in (*_AXES, "max_pair_overlap")] + [("intravariable", f"{v}_indicated_pct", "indicated_pct", "share", f" WHERE variable = '{v}'") for v in COLS]
    tidy = "ax AS (" + " UNION ALL ".join(f"SELECT '{a}' AS aspect, '{n}' AS axis, id, {m} AS v FROM {t}{w}" for a, n, m, t, w in axes) + ")"
    pairs = "pairs AS (SELECT a.axis AS axis_x, b.axis AS axis_y, a.aspect AS aspect_x, b.aspect AS aspect_y, a.v AS vx, b.v AS vy FROM ax a JOIN ax b USING (id) WHERE a.axis < b.axis)"
    ok = "n >= 4 AND abs(correlation) < 1"
    z = "1.959963984540054 * sqrt(1.06 / (n - 3))"
    return _sql(
        f"SELECT axis_x, axis_y, aspect_x, aspect_y, CASE WHEN aspect_x = aspect_y THEN 'within' ELSE 'cross' END AS kind, n, {r('correlation', 'correlation')}, "
        f"{r(f'CASE WHEN {ok} THEN tanh(atanh(correlation) - {z}) END', 'low')}, {r(f'CASE WHEN {ok} THEN tanh(atanh(correlation) + {z}) END', 'high')} FROM sp",
        _IV, _CASE_IRR, _CASE_INTER, _SHARE, tidy, pairs, _spearman("pairs", "axis_x, axis_y, aspect_x, aspect_y"))


def _strata_fit() -> str:
    best = "best AS (SELECT * FROM sp WHERE correlation IS NOT NULL ORDER BY abs(correlation), n DESC, x, y LIMIT 1)"
    lines = "ln AS (" + " UNION ALL ".join(f"SELECT id, '{a}' AS axis, {a} AS v FROM case_irr" for a in _IRR_AXES) + ")"
    both = "bo AS (SELECT c.id, a.v AS vx, b.v AS vy FROM case_irr c CROSS JOIN best JOIN ln a ON a.id = c.id AND a.axis = best.x JOIN ln b ON b.id = c.id AND b.axis = best.y)"
    med = "md AS (SELECT median(vx) AS mx, median(vy) AS my FROM bo WHERE vx IS NOT NULL AND vy IS NOT NULL)"
    hx, hy = ("CASE WHEN best.{0} = 'interval_adh_rate' THEN v{0} <= m{0} ELSE v{0} > m{0} END".format(c) for c in "xy")
    return _sql(
        f"SELECT id, CASE WHEN vx IS NULL OR vy IS NULL THEN NULL WHEN NOT ({hx}) AND NOT ({hy}) THEN 'Q_alpha' WHEN ({hx}) AND NOT ({hy}) THEN 'Q_beta' WHEN NOT ({hx}) THEN 'Q_gamma' ELSE 'Q_delta' END AS stratum, "
        f"best.x AS axis_x, best.y AS axis_y, {r('mx', 'threshold_x')}, {r('my', 'threshold_y')}, {r('correlation', 'axis_correlation')} FROM bo, best, md",
        _IV, _CASE_IRR, _pairs("case_irr", _IRR_AXES), _spearman("pairs", "x, y"), best, lines, both, med)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    missing = {c: f"{c}_mask" for c in COLS}
    out["mask_missingness"] = _mask_query(missing)
    out["mask_range"] = _mask_query(_ranged("0"))
    out["mask_missing_as_flag"] = _mask_query(_ranged("1"))
    out["mask_missing_as_null"] = _mask_query(_ranged("NULL"))
    out["mask_iqr_global"] = _mask_query(_bounded(), _iqr(""), "p, b")
    out["mask_iqr_per_id"] = _mask_query(_bounded(), _iqr("GROUP BY id"), "p LEFT JOIN b ON p.id = b.bid")
    out["mask_mad_global"] = _mask_query(_bounded(ranged=True), _mad("", {"hr": "CASE WHEN hr BETWEEN 10 AND 90 THEN hr END", "bp": "CASE WHEN bp <= 95 THEN bp END"}), "p, b")
    out["mask_mad_per_id"] = _mask_query(_bounded(), _mad("GROUP BY ALL", {}), "p LEFT JOIN b ON p.id = b.bid")
    out["mask_long"] = _sql(f"SELECT id, clock_no, variable, CAST(mask AS BIGINT) AS mask, {r('value', 'value')} FROM long")
    out["mask_matrix"] = _sql("SELECT * FROM (PIVOT (SELECT id, variable, clock_no, CAST(mask AS BIGINT) AS mask FROM long) ON clock_no USING any_value(mask) GROUP BY id, variable)")
    out["column_stats"] = _sql(f"SELECT variable, CAST(sum(mask) AS BIGINT) AS indicated_count, {r('sum(mask) * 100 / count(*)', 'indicated_pct')}, CAST(count(*) - sum(mask) AS BIGINT) AS non_indicated_count FROM long GROUP BY variable")
    out["column_stats_per_id"] = _sql("SELECT id, count(*) AS total_count, " + ", ".join(f"CAST(sum({c}_mask) AS BIGINT) AS {c}_indicated_count, {r(f'sum({c}_mask) * 100 / count(*)', f'{c}_indicated_pct')}, sum({c}_mask) * 100 / count(*) > 5 AS {c}_above_5pct_threshold" for c in COLS) + " FROM p GROUP BY id")
    out["all_null_rows"] = _sql(f"SELECT count(*) FILTER (WHERE {_S} = 3) AS null_rows_count, {r(f'count(*) FILTER (WHERE {_S} = 3) * 100 / count(*)', 'null_rows_pct')} FROM p")
    out["all_null_rows_per_id"] = _sql(f"SELECT id, count(*) FILTER (WHERE {_S} = 3) AS null_vitals_count, count(*) AS total_rows_per_id, {r(f'count(*) FILTER (WHERE {_S} = 3) * 100 / count(*)', 'null_vitals_pct')} FROM p GROUP BY id")
    out["row_stats"] = _sql(f"SELECT id, clock, clock_no, CAST({_S} AS BIGINT) AS indicated_vars, {r(f'({_S}) * 100 / 3.0', 'indicated_vars_pct')} FROM p")
    out["row_stats_per_id"] = _sql(f"SELECT id, {r(f'avg(({_S}) * 100 / 3.0)', 'avg_indicated_vars_pct')} FROM p GROUP BY id")
    out["patterns"] = _sql("SELECT CAST(hr_mask AS BIGINT) AS hr, CAST(bp_mask AS BIGINT) AS bp, CAST(k3_mask AS BIGINT) AS k3, count(*) AS count FROM p GROUP BY 1, 2, 3")
    for part, expr in (("month", "month(clock)"), ("weekday", "isodow(clock)"), ("hour", "hour(clock)")):
        out[f"calendar_{part}"] = _sql(f"SELECT variable, CAST({expr} AS BIGINT) AS {part}, {r('avg(mask)', 'indicated_share')}, CAST(sum(mask) AS BIGINT) AS indicated_count, count(*) AS n FROM long GROUP BY variable, 2")
    out["month_hour_grid"] = _sql(
        f"SELECT v.variable, CAST(m.month AS BIGINT) AS month, CAST(h.hour AS BIGINT) AS hour, {r('coalesce(avg(mask), 1)', 'indicated_share')}, count(mask) AS n FROM (SELECT unnest(['hr', 'bp', 'k3']) AS variable) v CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m CROSS JOIN (SELECT unnest(range(0, 24)) AS hour) h "
        "LEFT JOIN long ON long.variable = v.variable AND month(clock) = m.month AND hour(clock) = h.hour GROUP BY 1, 2, 3")
    out["intervals"] = _sql("SELECT id, clock_no, CAST(s AS BIGINT) AS interval_seconds FROM iv", _IV)
    out["interval_case_stats"] = _sql(
        f"SELECT id, count(s) AS n_intervals, {r('avg(s)', 'mean_interval')}, {r('median(s)', 'median_interval')}, {r('stddev_samp(s)', 'std_interval')}, {r(div('stddev_samp(s)', 'avg(s)'), 'interval_cv')}, min(s) AS min_interval, max(s) AS max_interval, "
        f"{r(near('s', 0.75) + ' - ' + near('s', 0.25), 'interval_iqr')}, {r(div(near('s', 0.75) + ' - ' + near('s', 0.25), near('s', 0.75) + ' + ' + near('s', 0.25)), 'interval_qcod')} FROM iv GROUP BY id", _IV)
    out["interval_global_stats"] = _sql(_describe("iv", "s", "", _P3), _IV)
    out["dominant_frequency"] = _sql(f"SELECT {_DOMINANT} FROM dom", _IV, _dominant("iv", "s"))
    out["interval_bins"] = _sql("SELECT CAST(round_even(s / 60.0, 0) AS BIGINT) AS bin, count(*) AS count FROM iv GROUP BY 1", _IV)
    out["interval_entropy_adherence"] = _sql(f"SELECT id, n_intervals, {r('dominant_interval_seconds', 'dominant_interval_seconds')}, {r('entropy', 'interval_entropy')}, {r('adherence', 'interval_adh_rate')} FROM ea", _IV, _entropy("iv", "s", "id", "ea"))
    out["burstiness_case"] = _sql(f"SELECT id, count(s) AS n_intervals, {r('avg(s)', 'mean_interval')}, {r('stddev_samp(s)', 'std_interval')}, {r(burst('s', 3), 'burstiness')} FROM iv GROUP BY id", _IV)
    out["burstiness_global"] = _sql(f"SELECT count(s) AS n_intervals, {r('avg(s)', 'mean_interval')}, {r('stddev_samp(s)', 'std_interval')}, {r(burst('s', 1), 'burstiness')} FROM (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM iv) WHERE k >= 3", _IV)
    out["interval_acf"] = _acf("iv", "s", "")
    out["gap_runs"] = _sql("SELECT id, variable, count_clock_no, CAST(time_length AS BIGINT) AS time_length, run_start_clock, run_end_clock FROM runs", _RUNS)
    out["true_gaps"] = _sql(_describe("(SELECT * FROM runs WHERE count_clock_no > 0)", "time_length", "variable", _P3), _RUNS)
    out["gap_case_metrics"] = _sql("SELECT id, variable, n_gaps, " + ", ".join(r(c, c) for c in ("gap_cv", "gap_qcod", "gap_burstiness_coeff", "gap_normalized_entropy", "gap_adherence_rate", "max_gap_fraction", "gap_onset_cv", "gap_missing_centroid")) + " FROM gap_case", _RUNS, _GAP_CASE)
    out["gap_dominant"] = _sql(f"SELECT variable, {_DOMINANT} FROM dom", _RUNS, "g AS (SELECT * FROM runs WHERE count_clock_no > 0)", _dominant("g", "time_length", "variable"))
    out["gap_burstiness"] = _sql(f"SELECT variable, count(time_length) AS n_gaps, {r('avg(time_length)', 'mean_gap')}, {r('stddev_samp(time_length)', 'std_gap')}, {r(burst('time_length', 1), 'burstiness')} FROM runs WHERE count_clock_no > 0 GROUP BY variable", _RUNS)
    out["gap_returns"] = _sql(f"SELECT id, variable, count_clock_no, CAST(time_length AS BIGINT) AS time_length, run_end_clock, {r('return_value', 'return_value')} FROM runs", _RUNS)
    octiles = "[" + ", ".join(near("time_length", i / 8) for i in range(1, 8)) + "]"
    out["gap_return_bins"] = _sql(
        f"SELECT variable, CAST(bin AS BIGINT) AS bin, label, count(v) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, {r('median(v)', 'median')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM lab GROUP BY variable, bin, label",
        _RUNS, f"cuts AS (SELECT variable, list_sort(list_distinct({octiles})) AS cs FROM runs WHERE time_length IS NOT NULL GROUP BY variable)",
        "binned AS (SELECT variable, return_value AS v, cs, len(list_filter(cs, lambda c: c < time_length)) AS bin FROM runs JOIN cuts USING (variable) WHERE time_length IS NOT NULL AND return_value IS NOT NULL)",
        "lab AS (SELECT *, '(' || CASE WHEN bin = 0 THEN '-inf' ELSE CAST(CAST(cs[bin] AS BIGINT) AS VARCHAR) END || ', ' || coalesce(CAST(CAST(cs[bin + 1] AS BIGINT) AS VARCHAR), 'inf') || ']' AS label FROM binned)")
    out["markov_counts"] = _sql("SELECT * FROM tr", _transitions())
    probs = {f"p{i}{j}": f"coalesce({div(f'n{i}{j}', f'n{i}0 + n{i}1')}, 0)" for i in (0, 1) for j in (0, 1)}
    out["markov_probs"] = _sql("SELECT variable, " + ", ".join(r(c, c) for c in probs) + f", {r(div('p10', 'p01 + p10'), 'steady0')}, {r(div('p01', 'p01 + p10'), 'steady1')} FROM (SELECT variable, " + ", ".join(f"{v} AS {k}" for k, v in probs.items()) + " FROM tr)", _transitions())
    out["markov_p11"] = _sql(f"SELECT id, variable, {r('CASE WHEN count(*) >= 10 THEN ' + div('count(*) FILTER (WHERE mask = 1 AND nxt = 1)', 'count(*) FILTER (WHERE mask = 1 AND nxt IS NOT NULL)') + ' END', 'p11')} FROM (SELECT id, variable, mask, lead(mask) OVER (PARTITION BY id, variable ORDER BY clock, clock_no) AS nxt FROM long) GROUP BY id, variable")
    out["acf_mask"] = _acf("long", "mask", "variable")
    out["acf_value"] = _acf("long", "value", "variable")
    out["xcorr_lagged"] = _sql(_xcorr())
    out["phi_matrix"] = _sql(" UNION ALL ".join([f"SELECT '{a}' AS x, '{b}' AS y, {r('coalesce(' + corr(f'{a}_mask', f'{b}_mask') + ', 0)', 'phi')} FROM p" for a, b in permutations(COLS, 2)] + [f"SELECT '{c}', '{c}', CAST(1 AS DOUBLE)" for c in COLS]))
    out["chi2_pairs"] = _sql(_chi2())
    out["conditional_obs"] = _sql(f"SELECT id, clock_no, {r('bp', 'bp')}, CAST(k3 AS BIGINT) AS k3 FROM p WHERE hr_mask = 1")
    day = 86400000000
    out["near_imperfect"] = _sql(f"SELECT a.id, a.clock, {r('max(a.hr)', 'value')}, count(DISTINCT b.clock) AS n_times FROM p a JOIN p b ON a.id = b.id AND b.hr_mask = 1 AND a.clock <> b.clock AND abs(epoch_us(a.clock) - epoch_us(b.clock)) <= {day} GROUP BY a.id, a.clock")
    out["near_flags"] = _sql("SELECT a.id, a.clock_no, " + ", ".join(f"CAST(coalesce(max(b.{c}_mask), 0) AS BIGINT) AS {c}_near" for c in COLS) + f" FROM p a LEFT JOIN p b ON a.id = b.id AND a.clock <> b.clock AND abs(epoch_us(a.clock) - epoch_us(b.clock)) <= {day} GROUP BY a.id, a.clock_no")
    both = "SELECT id, clock, event FROM (SELECT *, bool_or(event) OVER (PARTITION BY id) AS any_event, bool_and(event) OVER (PARTITION BY id) AS all_event FROM marked) WHERE any_event AND NOT all_event"
    ev = "ev AS (SELECT DISTINCT id, clock AS et FROM p WHERE event_type = 'signup')"
    out["event_mask_nearest"] = _sql(
        both, ev, "rest AS (SELECT * FROM p WHERE event_type <> 'signup')", "d AS (SELECT rest.id, clock, et, abs(epoch_us(clock) - epoch_us(et)) AS x FROM rest JOIN ev USING (id))",
        "hit AS (SELECT DISTINCT id, clock FROM (SELECT *, min(x) OVER (PARTITION BY id, et) AS least FROM d) WHERE x = least)", "marked AS (SELECT rest.id, rest.clock, hit.id IS NOT NULL AS event FROM rest LEFT JOIN hit USING (id, clock))")
    out["event_mask_window"] = _sql(both, ev, f"marked AS (SELECT p.id, p.clock, EXISTS (SELECT 1 FROM ev WHERE ev.id = p.id AND p.clock < et AND epoch_us(et) - epoch_us(p.clock) <= {day}) AS event FROM p)")
    out["event_share"] = _sql(f"SELECT {r('avg(CAST(event AS DOUBLE)) * 100', 'event_pct')}, count(*) FILTER (WHERE event) AS n_event, count(*) AS n FROM marked", ev, f"marked AS (SELECT p.id, p.clock, EXISTS (SELECT 1 FROM ev WHERE ev.id = p.id AND abs(epoch_us(et) - epoch_us(p.clock)) <= {day}) AS event FROM p)")
    out["rank_biserial_lag"] = _sql(f"SELECT x, y, lag, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, {r('rank_biserial', 'rank_biserial')} FROM rbs", _rank_biserial(), _U.format(k="x, y, lag", s="rb"), _RB)
    out["asymmetric_matrix"] = _sql(f"SELECT x, y, {r('arg_max(rank_biserial, struct_pack(c := abs(rank_biserial), k := -lag))', 'max_correlation')}, CAST(arg_max(lag, struct_pack(c := abs(rank_biserial), k := -lag)) AS BIGINT) AS max_lag FROM rbs GROUP BY x, y", _rank_biserial(), _U.format(k="x, y, lag", s="rb"), _RB)
    asym = "f AS (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {a}_mask AS m, CAST({b} AS DOUBLE) AS v FROM p" for a, b in permutations(COLS, 2)) + ")"
    out["asymmetric_comparison"] = _sql(
        f"SELECT x, y, n_imperfect, n_imperfect_observed, n1, n2, {r('u', 'u')}, " + ", ".join(r(c + i, c + i) for i in ("1", "2") for c in ("mean", "sd", "q25", "median", "q75")) + f" FROM (SELECT x, y, count(*) FILTER (WHERE m = 1) AS n_imperfect, count(v) FILTER (WHERE m = 1) AS n_imperfect_observed, " + ", ".join(f"{g} FILTER (WHERE m = {2 - i}) AS {c}{i}" for i in (1, 2) for c, g in (("mean", "avg(v)"), ("sd", "stddev_samp(v)"), ("q25", "quantile_cont(v, 0.25)"), ("median", "median(v)"), ("q75", "quantile_cont(v, 0.75)"))) + f" FROM f GROUP BY x, y) LEFT JOIN us USING (x, y)",
        asym, _U.format(k="x, y", s="f"), "us AS (SELECT x, y, CAST(sum(m) AS BIGINT) AS n1, CAST(count(*) - sum(m) AS BIGINT) AS n2, sum(m * rnk) - sum(m) * (sum(m) + 1) / 2 AS u FROM rk GROUP BY x, y)")
    out["case_value_metrics"] = _sql(
        f"SELECT id, variable, {r('avg(value)', 'value_mean')}, {r('min(value)', 'value_min')}, {r('max(value)', 'value_max')}, {r('CASE WHEN count(value) >= 2 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END', 'value_iqr')}, "
        f"{r('CASE WHEN count(value) >= 2 THEN covar_samp(h, value) FILTER (WHERE value IS NOT NULL) / nullif(var_samp(h) FILTER (WHERE value IS NOT NULL), 0) END', 'value_slope')}, {r('arg_min(value, clock_no) FILTER (WHERE value IS NOT NULL)', 'value_first')} "
        "FROM (SELECT *, (epoch_us(clock) - min(epoch_us(clock)) OVER (PARTITION BY id)) / 3600000000.0 AS h FROM long) GROUP BY id, variable")
    out["case_intra"] = _sql(f"SELECT id, variable, {r('indicated_pct', 'indicated_pct')}, {r('gap_missing_centroid', 'indicated_centroid')}, {r('gap_adherence_rate', 'gap_adh_rate')}, {r('gap_normalized_entropy', 'gap_entropy')} FROM share LEFT JOIN gap_case USING (id, variable)", _SHARE, _RUNS, _GAP_CASE)
    out["case_inter"] = _sql("SELECT id, " + ", ".join(r(c, c) for c in (*_AXES, "max_pair_overlap")) + " FROM case_inter", _CASE_INTER)
    out["case_irregularity"] = _sql("SELECT id, " + ", ".join(r(c, c) for c in _IRR_AXES) + " FROM case_irr", _IV, _CASE_IRR)
    out["strata_assign"] = _sql(
        "SELECT id, CASE WHEN avg_indicated_pct = 0 THEN 'Q_complete' WHEN avg_indicated_pct <= 30 AND breadth <= 0.9 THEN 'Q_alpha' WHEN avg_indicated_pct > 30 AND breadth <= 0.9 THEN 'Q_beta' WHEN avg_indicated_pct <= 30 THEN 'Q_gamma' ELSE 'Q_delta' END AS stratum, "
        "'avg_indicated_pct' AS axis_x, 'breadth' AS axis_y, CAST(30 AS DOUBLE) AS threshold_x, CAST(0.9 AS DOUBLE) AS threshold_y FROM case_inter", _CASE_INTER)
    out["strata_fit"] = _strata_fit()
    out["axis_corr"] = _sql(f"SELECT x, y, n, {r('correlation', 'correlation')}, {r('abs(correlation)', 'abs_corr')} FROM sp", _CASE_INTER, _pairs("case_inter", _AXES), _spearman("pairs", "x, y"))
    out["cross_aspect"] = _cross()
    grouped = 'gr AS (SELECT tidy.*, CAST(id % {k} AS VARCHAR) AS "group" FROM tidy)'
    out["describe_groups"] = _sql(
        f'SELECT aspect, variable, metric, "group", count(*) AS n, count(v) AS n_defined, {r("count(v) * 100 / count(*)", "pct_defined")}, {r("avg(v)", "mean")}, {r("stddev_samp(v)", "std")}, {r("any_value(q50)", "median")}, {r("any_value(q25)", "q25")}, {r("any_value(q75)", "q75")}, {r("min(v)", "min")}, {r("max(v)", "max")}, '
        f'{r("min(v) FILTER (WHERE v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))", "whisker_low")}, {r("max(v) FILTER (WHERE v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))", "whisker_high")} '
        'FROM gr JOIN qs USING (aspect, variable, metric, "group") GROUP BY aspect, variable, metric, "group"',
        _IV, _CASE_IRR, _GROUPED, grouped.format(k=3), 'qs AS (SELECT aspect, variable, metric, "group", quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM gr GROUP BY ALL)')
    out["mwu_u"] = _sql(
        f"SELECT variable, n1, n2, {r('u', 'u')}, {r('mean1', 'mean1')}, {r('mean2', 'mean2')}, {r('2 * u / (CAST(n1 AS DOUBLE) * n2) - 1', 'rank_biserial')}, {r('(greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (CAST(n1 AS DOUBLE) + n2 - 1))))', 'z')}, {r(erfc('greatest(0, greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (CAST(n1 AS DOUBLE) + n2 - 1)))) / sqrt(2.0)'), 'p_value')} FROM us JOIN ties USING (variable)",
        _FIRST, _U.format(k="variable", s="f"), _TIES, "us AS (SELECT variable, CAST(sum(CAST(first AS INT)) AS BIGINT) AS n1, CAST(count(*) - sum(CAST(first AS INT)) AS BIGINT) AS n2, sum(rnk) FILTER (WHERE first) - sum(CAST(first AS INT)) * (sum(CAST(first AS INT)) + 1) / 2 AS u, avg(v) FILTER (WHERE first) AS mean1, avg(v) FILTER (WHERE NOT first) AS mean2 FROM rk GROUP BY variable)")
    out["kw_h"] = _sql(
        f"SELECT variable, k, CAST(n AS BIGINT) AS n, {r('h', 'h')}, {r('(h - k + 1) / (n - k)', 'eta_squared')}, {r('CASE WHEN k = 3 THEN exp(-h / 2) END', 'p_value')} FROM (SELECT variable, count(*) AS k, sum(m) AS n, (12 / (sum(m) * (sum(m) + 1.0)) * sum(rs * rs / m) - 3 * (sum(m) + 1)) / (1 - any_value(tt) / (CAST(sum(m) AS DOUBLE) * sum(m) * sum(m) - sum(m))) AS h FROM (SELECT variable, g, sum(rnk) AS rs, count(*) AS m FROM rk GROUP BY ALL) JOIN ties USING (variable) GROUP BY variable)",
        "f AS (SELECT variable, value AS v, id % 3 AS g FROM long WHERE variable IN ('hr', 'bp'))", _U.format(k="variable", s="f"), _TIES)
    ci = "(d - d * d * d {s} 1.959963984540054 * sqrt(var) * sqrt((1 - d * d) * (1 - d * d) + 3.8414588206941236 * var)) / (1 - d * d + 3.8414588206941236 * var)"
    out["cliffs_delta"] = _sql(
        f"SELECT variable, n1, n2, {r('d', 'delta')}, {r('greatest(-1, ' + ci.format(s='-') + ')', 'low')}, {r('least(1, ' + ci.format(s='+') + ')', 'high')} FROM vr",
        _FIRST, "fo AS (SELECT * FROM f WHERE v IS NOT NULL)", "nn AS (SELECT variable, CAST(count(*) FILTER (WHERE first) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE NOT first) AS BIGINT) AS n2 FROM fo GROUP BY variable)",
        "cum AS (SELECT variable, v, first, count(*) FILTER (WHERE first) OVER w AS x_le, count(*) FILTER (WHERE NOT first) OVER w AS y_le, count(*) FILTER (WHERE first) OVER e AS x_eq, count(*) FILTER (WHERE NOT first) OVER e AS y_eq FROM fo WINDOW w AS (PARTITION BY variable ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY variable, v))",
        "dd AS (SELECT cum.*, n1, n2, CASE WHEN first THEN ((y_le - y_eq) - (n2 - y_le)) / CAST(n2 AS DOUBLE) ELSE ((n1 - x_le) - (x_le - x_eq)) / CAST(n1 AS DOUBLE) END AS di FROM cum JOIN nn USING (variable))",
        "dm AS (SELECT variable, any_value(n1) AS n1, any_value(n2) AS n2, avg(di) FILTER (WHERE first) AS d, sum(y_eq) FILTER (WHERE first) AS ties FROM dd GROUP BY variable)",
        "vr AS (SELECT variable, dm.n1, dm.n2, dm.d, greatest(0, (CAST(dm.n2 AS DOUBLE) * dm.n2 * ss.sx + CAST(dm.n1 AS DOUBLE) * dm.n1 * ss.sy - (CAST(dm.n1 AS DOUBLE) * dm.n2 - ties - CAST(dm.n1 AS DOUBLE) * dm.n2 * d * d)) / (CAST(dm.n1 AS DOUBLE) * dm.n2 * (dm.n1 - 1) * (dm.n2 - 1))) AS var FROM dm JOIN (SELECT variable, sum((di - d) * (di - d)) FILTER (WHERE first) AS sx, sum((-di + d) * (-di + d)) FILTER (WHERE NOT first) AS sy FROM dd JOIN dm USING (variable) GROUP BY variable) ss USING (variable))")
    k = "greatest(0, CAST(floor(n1 * n2 / 2.0 - 1.959963984540054 * sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)) AS BIGINT))"
    out["hodges_lehmann"] = _sql(
        f"SELECT variable, n1, n2, {r('m', 'shift')}, {r(f'ds[{k} + 1]', 'low')}, {r(f'ds[n1 * n2 - {k}]', 'high')} FROM (SELECT a.variable, count(DISTINCT a.id) AS n1, count(DISTINCT b.id) AS n2, median(a.vm - b.vm) AS m, list_sort(list(a.vm - b.vm)) AS ds FROM cm a JOIN cm b USING (variable) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.variable)",
        "cm AS (SELECT * FROM (SELECT id, variable, avg(value) AS vm FROM long GROUP BY ALL) WHERE vm IS NOT NULL)")
    out["bh_qvalues"] = _sql(
        f"SELECT id, variable, {r('p', 'p_value')}, {r('least(1, min(p * m / rn) OVER (PARTITION BY variable ORDER BY p DESC, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 'q_value')} FROM (SELECT *, count(*) OVER (PARTITION BY variable) AS m, max(r0) OVER (PARTITION BY variable, p) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY p) AS r0 FROM t))",
        "t AS (SELECT id, variable, sum(mask) / count(*) AS p FROM long WHERE variable IN ('hr', 'bp') GROUP BY id, variable)")
    half = "list_transform([{'x': abs(t), 'v': df}], lambda s: 2 * (0.5 - exp(lgamma((s.v + 1) / 2) - lgamma(s.v / 2)) / sqrt(s.v * pi()) * s.x / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (s.x * i / 2000) * (s.x * i / 2000) / s.v, -(s.v + 1) / 2)))))[1]"
    tt = "tt AS (SELECT *, d / se AS t FROM (SELECT *, m1 - m2 AS d, CASE WHEN eq THEN n1 + n2 - 2 ELSE pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) END AS df, CASE WHEN eq THEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) ELSE sqrt(v1 / n1 + v2 / n2) END AS se, CASE WHEN eq THEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) ELSE sqrt((v1 + v2) / 2) END AS sd FROM (SELECT *, abs(sqrt(v1) - sqrt(v2)) <= 1e-8 + 1e-5 * sqrt(v2) AS eq FROM (SELECT variable, count(v) FILTER (WHERE first) AS n1, count(v) FILTER (WHERE NOT first) AS n2, avg(v) FILTER (WHERE first) AS m1, avg(v) FILTER (WHERE NOT first) AS m2, var_samp(v) FILTER (WHERE first) AS v1, var_samp(v) FILTER (WHERE NOT first) AS v2 FROM f GROUP BY variable))))"
    out["t_test"] = _sql(f"SELECT variable, n1, n2, {r('d', 'mean_difference')}, {r('t', 't')}, {r('df', 'df')}, {r(half, 'p_value')}, {r('d / sd', 'cohens_d')} FROM tt", _FIRST, tt)
    out["brown_forsythe"] = _sql(
        f"SELECT variable, 2 AS k, n, {r('w', 'w')}, {r(half.replace('abs(t)', 'sqrt(w)').replace(': df', ': n - 2'), 'p_value')} FROM (SELECT variable, CAST(sum(c) AS BIGINT) AS n, (sum(c) - 2) * (sum(c * m * m) - sum(c * m) * sum(c * m) / sum(c)) / sum(c * va) AS w FROM bz GROUP BY variable)",
        _FIRST, "bz AS (SELECT variable, first, CAST(count(*) AS DOUBLE) AS c, avg(z) AS m, var_pop(z) AS va FROM (SELECT variable, first, abs(v - median(v) OVER (PARTITION BY variable, first)) AS z FROM f WHERE v IS NOT NULL) GROUP BY ALL)")
    pz = erfc("abs(z) / sqrt(2.0)")
    out["dunn_gap_returns"] = _sql(
        f"SELECT variable, group_a, group_b, {r('z', 'z')}, {r('max(least(1, (m - o + 1) * p)) OVER (PARTITION BY variable ORDER BY o)', 'p_value')} FROM (SELECT *, count(*) OVER (PARTITION BY variable) AS m, row_number() OVER (PARTITION BY variable ORDER BY p, group_a, group_b) AS o FROM (SELECT *, least(1, {pz}) AS p FROM dz))",
        _RUNS, "c AS (SELECT variable, list_sort(list_distinct([" + ", ".join(near("time_length", i / 8) for i in range(1, 8)) + "])) AS cuts FROM runs WHERE time_length IS NOT NULL GROUP BY variable)",
        "f AS (SELECT r.variable, CAST(len(list_filter(cuts, lambda x: x < r.time_length)) AS BIGINT) AS g, return_value AS v FROM runs r JOIN c USING (variable) WHERE time_length IS NOT NULL AND return_value IS NOT NULL)", _U.format(k="variable", s="f"), _TIES,
        "pg AS (SELECT variable, g, avg(rnk) AS mr, count(*) AS m FROM rk GROUP BY ALL)", "nn AS (SELECT variable, CAST(count(*) AS DOUBLE) AS n FROM rk GROUP BY variable)",
        "dz AS (SELECT a.variable, a.g AS group_a, b.g AS group_b, (a.mr - b.mr) / sqrt((n * (n + 1) / 12 - tt / (12 * (n - 1))) * (1.0 / a.m + 1.0 / b.m)) AS z FROM pg a JOIN pg b ON a.variable = b.variable AND a.g < b.g JOIN nn ON nn.variable = a.variable JOIN ties ON ties.variable = a.variable)")
    out["histogram"] = _sql(f"SELECT variable, bin, {r('a + bin * w', 'low')}, {r('a + (bin + 1) * w', 'high')}, count(*) AS n FROM (SELECT variable, a, w, CAST(least(floor((value - a) / w), 19) AS BIGINT) AS bin FROM (SELECT variable, value, min(value) OVER v AS a, (max(value) OVER v - min(value) OVER v) / 20 AS w FROM long WHERE value IS NOT NULL WINDOW v AS (PARTITION BY variable))) GROUP BY ALL")
    sc = "s AS (SELECT id % 3 AS part, bp_mask AS y, floor(k3 % 20) / 20.0 AS s FROM p WHERE k3 IS NOT NULL)"
    out["scores"] = _sql(
        f"SELECT a.part, n, CAST(np AS BIGINT) AS n_positive, {r('wins / (np * (n - np))', 'auroc')}, {r('ap / np', 'auprc')}, {r('brier', 'brier')} FROM (SELECT part, count(*) AS n, sum(y) AS np, avg((s - y) * (s - y)) AS brier FROM s GROUP BY part) a JOIN (SELECT x.part, CAST(sum(CASE WHEN x.s > z.s THEN 1 WHEN x.s = z.s THEN 0.5 ELSE 0 END) AS DOUBLE) AS wins FROM s x JOIN s z ON x.part = z.part AND x.y = 1 AND z.y = 0 GROUP BY x.part) b ON a.part = b.part "
        "JOIN (SELECT part, sum(y * pr) AS ap FROM (SELECT part, y, CAST(sum(y) OVER w AS DOUBLE) / count(*) OVER w AS pr FROM s WINDOW w AS (PARTITION BY part ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY part) c ON a.part = c.part", sc)
    out["calibration"] = _sql(f"SELECT CAST(least(floor(s * 10), 9) AS BIGINT) AS bin, count(*) AS n, {r('avg(s)', 'mean_score')}, {r('avg(y)', 'rate')} FROM s GROUP BY bin", sc)
    out["fold_strata"] = _sql(
        f"SELECT id, id % 5 AS fold, CASE WHEN avg_indicated_pct <= tx AND breadth <= ty THEN 'Q_alpha' WHEN avg_indicated_pct > tx AND breadth <= ty THEN 'Q_beta' WHEN avg_indicated_pct <= tx THEN 'Q_gamma' ELSE 'Q_delta' END AS stratum, {r('tx', 'threshold_x')}, {r('ty', 'threshold_y')} FROM case_inter JOIN th ON id % 5 = test",
        _CASE_INTER, "th AS (SELECT test, median(avg_indicated_pct) AS tx, median(breadth) AS ty FROM case_inter, (SELECT unnest(range(0, 5)) AS test) WHERE id % 5 <> test GROUP BY test)")
    out["common_ids"] = _sql(" INTERSECT ".join(f"SELECT id FROM p WHERE event_type = '{e}'" for e in ("signup", "purchase", "error")))
    out["returns_within"] = _sql("SELECT a.id, a.s AS start, a.e AS end, EXISTS (SELECT 1 FROM st b WHERE b.id = a.id AND b.s >= a.e AND b.s <= a.e + INTERVAL 2 DAY) AS returned FROM st a", "st AS (SELECT id, clock AS s, clock + INTERVAL 6 HOUR AS e FROM p WHERE event_type = 'purchase')")
    fill = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    out["upsample"] = _sql(
        f"SELECT id, step, {r(fill('hr'), 'hr')}, {r(fill('bp'), 'bp')} FROM gr LEFT JOIN bi USING (id, step)",
        "bi AS (SELECT id, epoch_us(clock) // 21600000000 AS step, arg_max(hr, clock) FILTER (WHERE hr IS NOT NULL) AS hr, arg_max(bp, clock) FILTER (WHERE bp IS NOT NULL) AS bp FROM p GROUP BY ALL)", "gr AS (SELECT id, unnest(range(min(step), max(step) + 1)) AS step FROM bi GROUP BY id)")
    out["stratum_distribution"] = _sql(f"SELECT label, stratum, n, {r('n / sum(n) OVER (PARTITION BY label)', 'share')} FROM (SELECT id % 4 AS label, stratum, count(*) AS n FROM st GROUP BY ALL)", _CASE_INTER, "st AS (SELECT id, CASE WHEN avg_indicated_pct = 0 THEN 'Q_complete' WHEN avg_indicated_pct <= 30 AND breadth <= 0.9 THEN 'Q_alpha' WHEN avg_indicated_pct > 30 AND breadth <= 0.9 THEN 'Q_beta' WHEN avg_indicated_pct <= 30 THEN 'Q_gamma' ELSE 'Q_delta' END AS stratum FROM case_inter)")
    out["describe_df"] = _sql(_describe("long", "value", "variable", _P5))
    out["corr_pairwise_spearman"] = _sql(f"SELECT x, y, n, {r('correlation', 'correlation')} FROM sp UNION ALL SELECT y, x, n, {r('correlation', 'correlation')} FROM sp", _pairs("p", COLS), _spearman("pairs", "x, y"))
    out["corr_listwise_pearson"] = _sql(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, {r(corr(a, b), 'correlation')} FROM p WHERE {_S} = 0" for a, b in permutations(COLS, 2)))
    out["missing_rate_by_lag"] = _sql(
        f"SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, {r('avg(m)', 'rate')}, {r('greatest(0, avg(m) - 1.96 * sqrt(avg(m) * (1 - avg(m)) / count(*)))', 'low')}, {r('least(1, avg(m) + 1.96 * sqrt(avg(m) * (1 - avg(m)) / count(*)))', 'high')} FROM (SELECT m, len(list_filter(cs, lambda c: c < v)) AS bin FROM lg, cs) GROUP BY bin",
        "lg AS (SELECT * FROM (SELECT lag(bp) OVER (PARTITION BY id ORDER BY clock, clock_no) AS v, bp_mask AS m FROM p) WHERE v IS NOT NULL)", "cs AS (SELECT list_distinct([" + ", ".join(f"quantile_cont(v, {i / 10})" for i in range(1, 10)) + "]) AS cs FROM lg)")
    lagc = "lag({0}) OVER (PARTITION BY id ORDER BY clock, clock_no)"
    out["severity"] = _sql(
        f"SELECT id, clock_no, {r('h0', 'hr_lag1')}, {r('b0', 'bp_lag1')}, CAST(coalesce(CAST(hr < 51 OR hr > 90 AS INT), 0) + coalesce(CAST(bp < 12 OR bp > 20 AS INT), 0) AS BIGINT) AS abnormal_count, CAST(coalesce(CAST(hr - h0 > 0 AS INT), 0) + coalesce(CAST(bp - b0 > 0 AS INT), 0) + coalesce(CAST(k3 - k0 > 0 AS INT), 0) AS BIGINT) AS improving_count FROM (SELECT *, {lagc.format('hr')} AS h0, {lagc.format('bp')} AS b0, {lagc.format('k3')} AS k0 FROM p)")
    w = "WINDOW w AS (PARTITION BY id ORDER BY clock, clock_no)"
    out["feat_circular"] = _sql(f"SELECT id, clock_no, {r('sin(2 * pi() * hour(clock) / 24)', 'hour_sin')}, {r('cos(2 * pi() * hour(clock) / 24)', 'hour_cos')} FROM p")
    out["feat_lag"] = _sql("SELECT id, clock_no, " + ", ".join(f"CAST(coalesce(lag({c}_mask, 2) OVER w, 0) AS BIGINT) AS {c}_mask_lag_2" for c in COLS) + f" FROM p {w}")
    out["feat_consecutive"] = _sql("SELECT id, clock_no, " + ", ".join(f"CAST(sum({c}_mask) OVER (PARTITION BY id, {c}_run ORDER BY clock, clock_no) AS BIGINT) AS {c}_mask_consecutive" for c in COLS) + " FROM (SELECT *, " + ", ".join(f"sum(1 - {c}_mask) OVER (PARTITION BY id ORDER BY clock, clock_no) AS {c}_run" for c in COLS) + " FROM p)")
    since = lambda c, v: f"CAST(least(3600, coalesce((epoch_us(clock) - epoch_us(max(CASE WHEN {c}_mask = {v} THEN clock END) OVER (PARTITION BY id ORDER BY clock, clock_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) // 1000000, 0)) AS BIGINT)"
    out["feat_time_since"] = _sql("SELECT id, clock_no, " + ", ".join(f"{since(c, 1)} AS {c}_time_since_imperfect, {since(c, 0)} AS {c}_time_since_non_imperfect" for c in COLS) + " FROM p")
    out["feat_rolling"] = _sql("SELECT id, clock_no, " + ", ".join(f"{r('coalesce(' + _full(f'{c}_mask', 'sum', 3) + ', 0)', f'{c}_mask_rolling_sum_3')}, {r('coalesce(' + _full(f'{c}_mask', 'var_samp', 3) + ', 0)', f'{c}_mask_rolling_var_3')}" for c in COLS) + " FROM p")
    out["feat_ewma"] = _sql(_ewma())
    out["feat_interactions"] = _sql(f"SELECT id, clock_no, {_inter()} FROM p {w}")
    out["feat_row_pct"] = _sql(f"SELECT id, clock_no, {r(f'({_S}) / 3.0', 'percentage_imperfect')} FROM p")
    ss = "si AS (SELECT *, CAST((epoch_us(clock) - epoch_us(lag(clock) OVER (PARTITION BY id ORDER BY clock, clock_no))) // 1000000 AS DOUBLE) AS s FROM p)"
    out["feat_interval"] = _sql(f"SELECT id, clock_no, {r('s', 'interval_seconds')}, {r('(s - avg(s) OVER (PARTITION BY id)) / nullif(stddev_samp(s) OVER (PARTITION BY id), 0)', 'interval_z_score')}, {r('CASE WHEN ' + _full('s', 'avg', 5) + ' > 0 THEN ' + _full('s', 'stddev_samp', 5) + ' / ' + _full('s', 'avg', 5) + ' END', 'interval_cv_local')} FROM si", ss)
    out["feat_acceleration"] = _sql(f"SELECT id, clock_no, {r('a', 'interval_acceleration')}, {r(_full('a', 'avg', 5), 'rolling_mean_acceleration')}, {r(_full('abs(a)', 'avg', 5), 'rolling_abs_acceleration')}, {r(_full('a', 'stddev_samp', 5), 'rolling_std_acceleration')} FROM (SELECT *, s - lag(s) OVER (PARTITION BY id ORDER BY clock, clock_no) AS a FROM si)", ss)
    return out
