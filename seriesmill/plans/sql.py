"""DuckDB twins of the queries, over the same tables."""

from __future__ import annotations

import math

from seriesmill.operators.synth import spline_basis

MODELS = ["naive", "ma3", "snaive"]
M = len(MODELS)

PANELS = {
    "month_priority": """SELECT o_orderpriority AS unique_id, date_trunc('month', o_orderdate)::DATE AS ds, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y
        FROM orders WHERE o_orderdate < (SELECT date_trunc('month', max(o_orderdate) + INTERVAL 1 DAY) FROM orders) GROUP BY ALL""",
    "month_nation": """SELECT c_nationkey::VARCHAR AS unique_id, date_trunc('month', o_orderdate)::DATE AS ds, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS y
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < (SELECT date_trunc('month', max(o_orderdate) + INTERVAL 1 DAY) FROM orders) GROUP BY ALL""",
    "month_flag": """SELECT l_returnflag || l_linestatus AS unique_id, date_trunc('month', l_shipdate)::DATE AS ds, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS y
        FROM lineitem GROUP BY ALL""",
    "hour_event": "SELECT event_type AS unique_id, date_trunc('hour', ts) AS ds, count(*)::DOUBLE AS y FROM events GROUP BY ALL",
}


def panel(name: str = "month_priority") -> str:
    return f"WITH RECURSIVE p AS ({PANELS[name]})"


def forecasts(name: str = "month_priority") -> str:
    """CTEs past and future: members' forecasts before and in the last six rows of each series."""
    return panel(name) + """, m AS (SELECT unique_id, ds, y, lag(y, 1) OVER w AS naive, (lag(y, 1) OVER w + lag(y, 2) OVER w + lag(y, 3) OVER w) / 3 AS ma3,
            lag(y, 12) OVER w AS snaive, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
        f AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM m WHERE n > 12),
        past AS (SELECT * FROM f WHERE back > 6), future AS (SELECT * FROM f WHERE back <= 6)"""


def long(table: str, columns: str = "unique_id, ds, y") -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{m}' AS model, {i} AS pos, {m} AS f FROM {table}" for i, m in enumerate(MODELS))


SMAPE = "2 * avg(CASE WHEN abs(y) + abs(f) = 0 THEN 0 ELSE abs(y - f) / (abs(y) + abs(f)) END)"


def scores(window: int | None) -> str:
    rows = "past" if window is None else f"(SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= {window})"
    return f", long AS ({long(rows)}), scores AS (SELECT unique_id, model, pos, {SMAPE} AS score FROM long GROUP BY ALL)"


def pivot(table: str, value: str, digits: int = 6) -> str:
    columns = ", ".join(f"round(max(CASE WHEN pos = {i} THEN {value} END), {digits}) + 0.0 AS {m}" for i, m in enumerate(MODELS))
    return f" SELECT unique_id, {columns} FROM {table} GROUP BY unique_id"


def weighted(table: str = "final") -> str:
    return f", fl AS ({long('future')}) SELECT fl.unique_id, fl.ds::VARCHAR AS ds, round(sum(coalesce(w, 0) * coalesce(f, 0)), 2) + 0.0 AS forecast FROM fl JOIN {table} USING (unique_id, pos) GROUP BY ALL"


def kept(by_uid: bool, order: str) -> str:
    """CTE ranks (unique_id, pos, rk) by ``order``, an expression over scores to minimise."""
    if by_uid:
        return f", ranks AS (SELECT unique_id, pos, row_number() OVER (PARTITION BY unique_id ORDER BY {order}, pos) AS rk FROM scores)"
    return f", means AS (SELECT pos, avg({order}) AS s FROM scores GROUP BY pos), g AS (SELECT pos, row_number() OVER (ORDER BY s, pos) AS rk FROM means), ranks AS (SELECT unique_id, pos, rk FROM scores JOIN g USING (pos))"


def trimmed(k: int) -> str:
    """CTE final (unique_id, pos, w) of shares (unique_id, pos, p): the best k scaled to one, zeros where nothing is left."""
    return f""", z AS (SELECT unique_id, pos, CASE WHEN rk <= {k} THEN coalesce(p, 0) ELSE 0 END AS v FROM shares JOIN ranks USING (unique_id, pos)),
        final AS (SELECT unique_id, pos, CASE WHEN sum(v) OVER (PARTITION BY unique_id) > 0 THEN v / sum(v) OVER (PARTITION BY unique_id) ELSE 0 END AS w FROM z)"""


SHARES = """, mm AS (SELECT *, max(-score) OVER w AS hi, min(-score) OVER w AS lo FROM scores WINDOW w AS (PARTITION BY unique_id)),
        mn AS (SELECT unique_id, pos, CASE WHEN hi > lo THEN (-score - lo) / (hi - lo) ELSE 0 END AS x FROM mm),
        shares AS (SELECT unique_id, pos, x / nullif(sum(x) OVER (PARTITION BY unique_id), 0) AS p FROM mn)"""


def static(k: int, by_uid: bool, window: int | None, name: str = "month_priority", weights: bool = False, equal: bool = False) -> str:
    shares = ", shares AS (SELECT unique_id, pos, 1.0 AS p FROM scores)" if equal else SHARES
    return forecasts(name) + scores(window) + shares + kept(by_uid, "score") + trimmed(k) + (pivot("final", "w") if weights else weighted())


def loss(kind: str, gradient: bool, f: str, fc: str) -> str:
    if gradient:
        return {
            "square": f"(2 * ({fc} - y) * {f})",
            "absolute": f"(sign({fc} - y) * {f})",
            "percentage": f"(sign({fc} - y) * {f} / nullif(y, 0))",
            "log": f"(-{f} / nullif({fc}, 0))",
            "pinball": f"((CASE WHEN y < {fc} THEN 0.5 ELSE -0.5 END) * {f})",
        }[kind]
    return {
        "square": f"(({f} - y) * ({f} - y))",
        "absolute": f"abs({f} - y)",
        "percentage": f"(abs({f} - y) / nullif(y, 0))",
        "log": f"(-ln(CASE WHEN {f} > 0 THEN {f} END))",
        "pinball": f"((CASE WHEN y < {f} THEN 0.5 ELSE -0.5 END) * ({f} - y))",
    }[kind]


def each(text: str, sep: str = ", ") -> str:
    return sep.join(text.replace("#", str(i)) for i in range(M))


def mixture(rule: str, kind: str = "square", gradient: bool = True, by_uid: bool = True, k: int = M, after: bool = False, weights: bool = True) -> str:
    key = "unique_id" if by_uid else "'all'"
    top = each("r#")
    if rule == "mlpol":
        first, raw = repr(math.exp(100)), each("e# * greatest(r#, 0) AS q#")
        rate = f"greatest(b, {each('g# * g#')}) AS nb"
        eta = each("1 / (1 / e# + g# * g# + nb - b)")
    else:
        first, raw = repr(math.exp(350)), each("exp(greatest(least(e# * r#, 700), -700)) AS q#")
        rate = "b AS nb"
        eta = each(f"sqrt({math.log(M)!r} / ({math.log(M)!r} / (e# * e#) + g# * g#))")
    w = each(f"CASE WHEN greatest({top}) <= 0 THEN 1.0::DOUBLE / {M} ELSE q# / ({each('q#', ' + ')}) END AS w#")
    fields = ", ".join(f"{m} AS f{i}" for i, m in enumerate(MODELS))
    own = loss(kind, gradient, "fc", "fc")
    regret = ", ".join(f"coalesce(own - {loss(kind, gradient, f'f{i}', 'fc')}, 0) AS g{i}" for i in range(M))
    fold = f""", rws AS (SELECT {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ds, unique_id) AS i, y, {fields} FROM past),
        st AS (SELECT DISTINCT k, 0::BIGINT AS i, {each('0.0::DOUBLE AS r#')}, {each(f'{first}::DOUBLE AS e#')}, 0.0::DOUBLE AS b, {each(f'1.0::DOUBLE / {M} AS w#')} FROM rws
        UNION ALL
        SELECT k, i, {each('r# + g#')}, {eta}, nb, {each('w#')} FROM (SELECT *, {rate} FROM (SELECT *, {regret} FROM (SELECT *, {own} AS own FROM (
            SELECT *, {each(f"w# / ({each('w#', ' + ')}) * f#", ' + ')} AS fc FROM (SELECT k, i, y, {each('f#')}, {each('r#')}, {each('e#')}, b, {w} FROM (
            SELECT st.k, rws.i, y, {each('f#')}, {each('r#')}, {each('e#')}, b, {raw} FROM st JOIN rws ON rws.k = st.k AND rws.i = st.i + 1)))))) ),
        lst AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1)"""
    ends = f"(SELECT k, {w} FROM (SELECT k, {each('r#')}, {raw} FROM lst))" if after else "lst"
    out = " UNION ALL ".join(f"SELECT k, {i} AS pos, w{i} AS p FROM ends" for i in range(M))
    ids = "k AS unique_id, pos, p FROM flat" if by_uid else "u.unique_id, pos, p FROM flat CROSS JOIN (SELECT DISTINCT unique_id FROM past) u"
    tail = f", ends AS (SELECT * FROM {ends}), flat AS ({out}), shares AS (SELECT {ids}), scores AS (SELECT unique_id, pos, -p AS score FROM shares)"
    trim = kept(by_uid, "score") + trimmed(k) if k < M else ", final AS (SELECT unique_id, pos, p AS w FROM shares)"
    return forecasts() + fold + tail + trim + (pivot("final", "w") if weights else weighted())


def dates(columns: str, table: str = "p", digits: int = 2) -> str:
    return f" SELECT unique_id, ds::VARCHAR AS ds, round(y, {digits}) + 0.0 AS y{columns} FROM {table}"


def ftn(diff: bool = False, smooth: bool = False, everywhere: bool = False, alpha: bool = False) -> str:
    train = "SELECT unique_id, ds, y FROM past"
    if smooth:
        terms = "list_transform(range(1, n + 1), lambda i: pow(0.4, n - i) * ys[i])", "list_transform(range(1, n + 1), lambda i: pow(0.4, n - i))"
        train = f"SELECT unique_id, ds, list_sum({terms[0]}) / list_sum({terms[1]}) AS y FROM (SELECT unique_id, ds, list(y) OVER w AS ys, count(*) OVER w AS n FROM past WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"
    if diff:
        train = f"SELECT unique_id, ds, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS y FROM ({train}) QUALIFY y IS NOT NULL AND lag(y) OVER (PARTITION BY unique_id ORDER BY ds) IS NOT NULL"
    queries = " UNION ALL ".join(f"SELECT unique_id, '{m}' AS model, list({m} ORDER BY ds) AS q FROM future GROUP BY unique_id" for m in ("naive", "snaive"))
    on = "true" if everywhere else "t.unique_id = qs.unique_id"
    value = "CASE WHEN h = 1 THEN q[1] ELSE s END" if diff else "s"
    value = f"sum({value}) OVER (PARTITION BY unique_id, model ORDER BY h)" if diff else value
    first, name = ("g.v * 0.1 * h + naive * (1 - 0.1 * h)", "naive_WFTN") if alpha else ("g.v", "naive_FTN")
    return forecasts() + f""", tr AS ({train}), tj AS (SELECT unique_id, ds, list(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS p FROM tr),
        t AS (SELECT * FROM tj WHERE len(p) = 6), qs AS ({queries}),
        d AS (SELECT qs.unique_id, model, q, p, t.ds, t.unique_id AS u, list_sum(list_transform(range(1, 7), lambda i: (q[i] - p[i]) * (q[i] - p[i]))) AS d FROM qs JOIN t ON {on}),
        b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY unique_id, model ORDER BY d, ds, u) <= 5),
        s AS (SELECT unique_id, model, any_value(q) AS q, h, avg(p[h]) AS s FROM b CROSS JOIN (SELECT unnest(range(1, 7)) AS h) GROUP BY unique_id, model, h),
        v AS (SELECT unique_id, model, h, {value} AS v FROM s), fh AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS h FROM future)
        SELECT unique_id, ds::VARCHAR AS ds, round({first}, 2) + 0.0 AS {name}, round(o.v, 2) + 0.0 AS snaive_FTN
        FROM fh JOIN v g USING (unique_id, h) JOIN v o USING (unique_id, h) WHERE g.model = 'naive' AND o.model = 'snaive'"""


def draw(salt: str, keys: str) -> str:
    return f"(('0x' || substr(md5('7|{salt}|' || {keys}), 1, 8))::BIGINT)"


def normal(salt: str, keys: str) -> str:
    return f"(sqrt(-2 * ln(({draw(salt + 'a', keys)} + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * ({draw(salt + 'b', keys)} / 4294967296.0::DOUBLE)))"


def renamed(value: str, alias: str) -> str:
    return f"""SELECT p.unique_id || '_{alias}' || (row_number - 1) AS unique_id, ds::VARCHAR AS ds, round({value}, 2) + 0.0 AS y
        FROM p JOIN (SELECT unique_id, row_number() OVER (ORDER BY unique_id) AS row_number FROM (SELECT DISTINCT unique_id FROM p)) USING (unique_id)"""


KEY = "p.unique_id || '|' || ds::VARCHAR"
SCALED = renamed(f"y * (1 + 0.1 * {normal('scale', KEY)})", "SCA")
CUTOFF = """, w AS (SELECT *, (row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1) // 4 AS w FROM p), c AS (SELECT unique_id, ds, y, min(ds) OVER (PARTITION BY unique_id, w) AS cutoff FROM w)"""
ALPHA_CV = ftn().replace("SELECT unique_id, ds::VARCHAR AS ds, round(g.v", ", o AS (SELECT unique_id, fh.y, naive, h, g.v AS n, round(g.v")
ERRORS = ", ".join(f"{m} - y AS {m}" for m in MODELS)


def ade(k: int, weights: bool) -> str:
    lines = ", ".join(f"regr_slope({m} - y, lag1) AS s{i}, regr_intercept({m} - y, lag1) AS i{i}" for i, m in enumerate(MODELS))
    errors = " UNION ALL ".join(f"SELECT unique_id, {i} AS pos, abs(s{i} * y + i{i}) AS score FROM ends CROSS JOIN fit" for i in range(M))
    shares = SHARES.replace("FROM scores", "FROM expected")
    return forecasts() + scores(None) + f""", lg AS (SELECT *, lag(y, 1) OVER (PARTITION BY unique_id ORDER BY ds) AS lag1 FROM past), fit AS (SELECT {lines} FROM lg WHERE lag1 IS NOT NULL),
        ends AS (SELECT unique_id, y FROM past QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) = 1), expected AS ({errors})""" + shares + kept(True, "score") + trimmed(k) + (pivot("final", "w") if weights else weighted())


def losses(gradient: bool) -> str:
    columns = ", ".join(f"round({loss(k, gradient, 'f', 'fc')}, 9) + 0.0 AS {k}" for k in ("square", "absolute", "percentage", "log", "pinball"))
    return forecasts() + f" SELECT unique_id, ds::VARCHAR AS ds, {columns} FROM (SELECT unique_id, ds, y / 1e6 AS y, naive / 1e6 AS f, ma3 / 1e6 AS fc FROM past)"


def undefined(*how, **named) -> str:
    """A mixture over the past with some targets of zero and some forecasts below it."""
    changed = "past AS (SELECT unique_id, ds, CASE WHEN month(ds) = 3 THEN 0 ELSE y END AS y, CASE WHEN month(ds) = 6 THEN -naive ELSE naive END AS naive, ma3, snaive FROM f WHERE back > 6)"
    return mixture(*how, **named).replace("past AS (SELECT * FROM f WHERE back > 6)", changed)


def accuracy(rows: str, by: str) -> str:
    """Scores of ``rows``, which have a null where a forecast is missing."""
    return f" SELECT {by}, model, round(2 * avg(CASE WHEN abs(y) + abs(f) = 0 THEN 0 ELSE abs(y - f) / (abs(y) + abs(f)) END), 6) + 0.0 AS smape, count(f) AS n FROM ({rows}) GROUP BY ALL"


def slow(alpha: float) -> str:
    """Terms of an exponentially weighted mean."""
    power = f"list_transform(range(1, n + 1), lambda i: pow({1 - alpha!r}, n - i)"
    return f"list_sum({power} * ys[i])) / list_sum({power}))"


def warped() -> str:
    """A cubic spline through six drawn knots, by the second derivatives that are linear in them."""
    knots = ", ".join(f"1 + 0.2 * {normal(f'knot{j}', 'unique_id')} AS k{j}" for j in range(6))
    second = "[" + ", ".join(" + ".join(f"({w!r}) * k{j}" for j, w in enumerate(row.tolist())) for row in spline_basis(6)) + "]"
    curve = "(1 - t) * v[i + 1] + t * v[i + 2] + (((1 - t) * (1 - t) * (1 - t) - (1 - t)) * s[i + 1] + (t * t * t - t) * s[i + 2]) / 6"
    return f""", u AS (SELECT unique_id, {knots} FROM (SELECT DISTINCT unique_id FROM p)), c AS (SELECT unique_id, [k0, k1, k2, k3, k4, k5] AS v, {second} AS s FROM u),
        q AS (SELECT p.unique_id, ds, y, v, s, (row_number() OVER w - 1) * 5.0::DOUBLE / (count(*) OVER (PARTITION BY p.unique_id) - 1) AS place FROM p JOIN c USING (unique_id) WINDOW w AS (PARTITION BY p.unique_id ORDER BY ds)),
        r AS (SELECT *, least(floor(place), 4)::INT AS i FROM q), x AS (SELECT *, place - i AS t FROM r), p2 AS (SELECT unique_id, ds, y * ({curve}) AS y FROM x) """ + renamed("y", "MAG").replace("FROM p JOIN", "FROM p2 p JOIN")


def gamma(salt: str, alpha: float, keys: str) -> str:
    """A Gamma draw for an alpha of 1 or more, the first candidate accepted."""
    d = alpha - 1 / 3
    c = 1 / math.sqrt(9 * d)
    found = []
    for i in range(8):
        x, u = normal(f"{salt}x{i}", keys), f"(({draw(f'{salt}u{i}', keys)} + 1) / 4294967297.0::DOUBLE)"
        v = f"pow(1 + {c!r} * {x}, 3)"
        good = f"{v} > 0 AND ln({u}) < 0.5 * pow({x}, 2) + {d!r} - {d!r} * {v} + {d!r} * ln(CASE WHEN {v} > 0 THEN {v} ELSE 1 END)"
        found.append(f"WHEN {good} THEN {d!r} * {v}")
    return f"(CASE {' '.join(found)} ELSE {d!r} * greatest({v}, 0) END)"


def mixup() -> str:
    whole = lambda salt, low, high, keys: f"({low} + floor({draw(salt, keys)} / 4294967296.0::DOUBLE * ({high} - {low} + 1)))::INT"
    most = lambda limit: f"least(min(n) OVER (PARTITION BY id), {limit})"
    return panel("month_nation") + f""", sizes AS (SELECT unique_id, count(*) AS n FROM p GROUP BY unique_id), listed AS (SELECT *, row_number() OVER (ORDER BY unique_id) - 1 AS number FROM sizes),
        a AS (SELECT number AS id, {whole('k', 1, 4, 'number')} AS k FROM listed), b AS (SELECT id, unnest(range(1, k + 1)) AS j FROM a),
        c AS (SELECT id, floor({draw('uid', "id || '|' || j")} / 4294967296.0::DOUBLE * (SELECT count(*) FROM sizes))::INT AS number, min(j) AS j FROM b GROUP BY ALL),
        d AS (SELECT id, j, unique_id, n, {gamma('gamma', 1.5, "id || '|' || j")} AS g, {most(40)} AS hi, {most(10)} AS lo, min(j) OVER (PARTITION BY id) = j AS first FROM c JOIN listed USING (number)),
        e AS (SELECT *, CASE WHEN hi < lo THEN hi ELSE {whole('len', 'lo', 'hi', 'id')} END AS length, g / sum(g) OVER (PARTITION BY id) AS w FROM d),
        f AS (SELECT *, {whole('start', 0, '(n - length)', "id || '|' || j")} AS start FROM e),
        r AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS place FROM p),
        rows_ AS (SELECT f.*, ds, y, place FROM f JOIN r USING (unique_id)),
        m AS (SELECT id, place - start AS step, sum(w * y) AS y FROM rows_ WHERE place >= start AND place < start + length GROUP BY ALL)
        SELECT 'TSMixup_' || t.id AS unique_id, t.ds::VARCHAR AS ds, round(m.y, 2) + 0.0 AS y FROM rows_ t JOIN m ON m.id = t.id AND m.step = t.place WHERE t.first AND t.place < t.length"""


def ade_two() -> str:
    """ADE with least squares on the first and the thirteenth lag, by the normal equations."""
    sums = ", ".join(f"covar_pop({m} - y, lag1) AS c{i}, covar_pop({m} - y, lag13) AS d{i}, avg({m} - y) AS m{i}" for i, m in enumerate(MODELS))
    slope = lambda i: (f"(c{i} * vb - d{i} * v) / (va * vb - v * v)", f"(d{i} * va - c{i} * v) / (va * vb - v * v)")
    errors = " UNION ALL ".join(f"SELECT unique_id, {i} AS pos, abs(m{i} + {slope(i)[0]} * (x1 - a1) + {slope(i)[1]} * (x13 - a13)) AS score FROM ends CROSS JOIN fit" for i in range(M))
    return forecasts() + scores(None) + f""", lg AS (SELECT *, lag(y, 1) OVER w AS lag1, lag(y, 13) OVER w AS lag13 FROM past WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
        fit AS (SELECT {sums}, var_pop(lag1) AS va, var_pop(lag13) AS vb, covar_pop(lag1, lag13) AS v, avg(lag1) AS a1, avg(lag13) AS a13 FROM lg WHERE lag13 IS NOT NULL),
        back13 AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM past),
        ends AS (SELECT unique_id, max(CASE WHEN b = 1 THEN y END) AS x1, max(CASE WHEN b = 13 THEN y END) AS x13 FROM back13 GROUP BY unique_id), expected AS ({errors})""" + SHARES.replace("FROM scores", "FROM expected") + kept(True, "score") + trimmed(3) + pivot("final", "w")


def ade_run() -> str:
    """ADE over two forecasters: the last value, and that of the same month a year before."""
    pair = ("naive", "snaive")
    rows = " UNION ALL ".join(f"SELECT unique_id, y, {i} AS pos, '{m}' AS model, {m} AS f FROM past" for i, m in enumerate(pair))
    lines = ", ".join(f"regr_slope({m} - y, lag1) AS s{i}, regr_intercept({m} - y, lag1) AS i{i}" for i, m in enumerate(pair))
    errors = " UNION ALL ".join(f"SELECT unique_id, {i} AS pos, abs(s{i} * y + i{i}) AS score FROM ends CROSS JOIN fit" for i in range(2))
    return panel() + f""", m AS (SELECT unique_id, ds, y, lag(y, 1) OVER w AS naive, lag(y, 12) OVER w AS snaive FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
        past AS (SELECT * FROM m WHERE snaive IS NOT NULL), scores AS (SELECT unique_id, model, pos, {SMAPE} AS score FROM ({rows}) GROUP BY ALL),
        lg AS (SELECT *, lag(y, 1) OVER (PARTITION BY unique_id ORDER BY ds) AS lag1 FROM past), fit AS (SELECT {lines} FROM lg WHERE lag1 IS NOT NULL),
        back AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p), ends AS (SELECT * FROM back WHERE b = 1),
        expected AS ({errors})""" + SHARES.replace("FROM scores", "FROM expected") + kept(True, "score") + trimmed(2) + """,
        ahead AS (SELECT e.unique_id, (e.ds + to_months(step::INT))::DATE AS ds, step, e.y AS naive, l.y AS snaive FROM ends e CROSS JOIN (SELECT unnest(range(1, 7)) AS step) JOIN back l ON l.unique_id = e.unique_id AND l.b = 12 - (step - 1) % 12)
        SELECT a.unique_id, a.ds::VARCHAR AS ds, round(sum(w * CASE WHEN pos = 0 THEN naive ELSE snaive END), 2) + 0.0 AS forecast FROM ahead a JOIN final USING (unique_id) GROUP BY ALL"""


def online() -> str:
    """The fold of mixture() over the events of each type, with three constant members."""
    past = "WITH RECURSIVE past AS (SELECT event_type AS unique_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ds, value AS y, 10.0::DOUBLE AS naive, 50.0::DOUBLE AS ma3, 30.0::DOUBLE AS snaive FROM events)"
    named = ", ".join(f"round(max(CASE WHEN pos = {i} THEN w END), 6) + 0.0 AS {m}" for i, m in enumerate(("low", "high", "middle")))
    out = f" SELECT unique_id, max(n) AS n, {named} FROM final JOIN (SELECT unique_id, count(*) AS n FROM past GROUP BY unique_id) USING (unique_id) GROUP BY unique_id"
    return mixture("mlpol", after=True).replace(forecasts(), past).replace(pivot("final", "w"), out)


EVENTS = "WITH RECURSIVE p AS (SELECT event_type AS unique_id, event_id AS ds, value AS y FROM events)"

SQL = {
    **{f"panel_{name}": panel(name) + dates("") for name in PANELS},
    "members": panel() + """, x AS (SELECT *, lag(y, 1) OVER w AS x FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
        m AS (SELECT unique_id, ds, y, lag(y, 1) OVER w AS naive, (lag(y, 1) OVER w + lag(y, 2) OVER w + lag(y, 3) OVER w) / 3 AS ma3, lag(y, 12) OVER w AS snaive,
            lag(y, 1) OVER w + (lag(y, 1) OVER w - first_value(y) OVER w) / (row_number() OVER w - 2) AS drift, avg(y) OVER b AS mean, list(y) OVER b AS ys, count(*) OVER b AS n,
            regr_intercept(y, x) OVER b + regr_slope(y, x) OVER b * x AS ols, row_number() OVER w AS row_n
            FROM x WINDOW w AS (PARTITION BY unique_id ORDER BY ds), b AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT unique_id, ds::VARCHAR AS ds, round(ols, 0) + 0.0 AS ols, """ + f"round({slow(0.3)}, 2) + 0.0 AS ewm, " + ", ".join(f"round({c}, 2) + 0.0 AS {c}" for c in ("y", *MODELS, "drift", "mean")) + " FROM m WHERE row_n > 12",
    "windowing_forecast": static(3, True, 12),
    "windowing_by_uid": static(2, True, 12, weights=True),
    "windowing_global_trim": static(2, False, 12, weights=True),
    "windowing_nation": static(2, True, 12, "month_nation"),
    "blast": static(1, True, 12),
    "blast_global": static(1, False, 12, weights=True),
    "loss_on_train": static(2, True, None),
    "loss_on_train_weights": static(3, True, None, "month_nation", True),
    "best_on_train": static(1, True, None, weights=True),
    "best_on_train_global": static(1, False, None),
    "eq_average": static(3, True, None, equal=True),
    "eq_average_trim": static(2, True, None, weights=True, equal=True),
    "mlpol_global_grad": mixture("mlpol", by_uid=False),
    "mlpol_forecast": mixture("mlpol", by_uid=False, weights=False),
    "mlpol_uid": mixture("mlpol"),
    "mlpol_next": mixture("mlpol", after=True),
    "mlpol_trim": mixture("mlpol", k=2),
    "mlpol_absolute": mixture("mlpol", "absolute"),
    "mlpol_percentage": mixture("mlpol", "percentage"),
    "mlpol_log": mixture("mlpol", "log"),
    "mlpol_pinball": mixture("mlpol", "pinball"),
    "mlpol_square_loss": mixture("mlpol", gradient=False),
    "mlewa_global_grad": mixture("mlewa", by_uid=False),
    "mlewa_uid": mixture("mlewa"),
    "mlewa_absolute": mixture("mlewa", "absolute", gradient=False),
    "smape_full": forecasts() + scores(None) + pivot("scores", "score"),
    "smape_window": forecasts() + scores(12) + pivot("scores", "score"),
    "leaderboard": forecasts() + f", long AS ({long('future')}), s AS (SELECT unique_id, model, {SMAPE} AS s FROM long GROUP BY ALL) SELECT model, round(avg(s), 6) AS mean_smape, round(median(s), 6) AS median_smape FROM s GROUP BY model",
    "norm_proportion": forecasts() + scores(None) + SHARES + pivot("shares", "p"),
    "minmax": forecasts() + scores(None) + ", mm AS (SELECT unique_id, pos, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS x FROM scores WINDOW w AS (PARTITION BY unique_id))" + pivot("mm", "x"),
    "topk_models": forecasts("month_nation") + scores(None) + kept(True, "score") + " SELECT unique_id, rk AS rank, model FROM ranks JOIN scores USING (unique_id, pos) WHERE rk <= 2",
    "train_test_split": panel() + dates(", CASE WHEN row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) > 6 THEN 'train' ELSE 'test' END AS part"),
    "nested_split": panel() + ", r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p) SELECT unique_id, CASE WHEN b > 12 THEN 'dev' WHEN b > 6 THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(ds)::VARCHAR AS first, max(ds)::VARCHAR AS last FROM r GROUP BY ALL",
    "get_horizon": panel() + dates(", row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS horizon"),
    "get_horizon_cutoff": panel() + CUTOFF + dates(", cutoff::VARCHAR AS cutoff, row_number() OVER (PARTITION BY unique_id, cutoff ORDER BY ds) AS horizon", "c"),
    "cv_first_step": panel() + CUTOFF + dates("", "c WHERE ds = cutoff"),
    "n_windows": panel("month_nation") + " SELECT floor((min(n) - 3 - 6) / 2)::BIGINT AS n_windows FROM (SELECT count(*) AS n FROM p GROUP BY unique_id)",
    "signed_log": panel() + ", z AS (SELECT unique_id, ds, y - avg(y) OVER (PARTITION BY unique_id) AS z FROM p) SELECT unique_id, ds::VARCHAR AS ds, round(sign(z) * ln(1 + abs(z)), 6) + 0.0 AS z, round(round(z / 1e6, 3), 6) + 0.0 AS back FROM z",
    "dense_grid_mask": panel("hour_event") + """, q AS (SELECT unique_id, date_diff('hour', (SELECT min(ds) FROM p), ds) AS ds, y FROM p),
        g AS (SELECT unique_id, unnest(range(0, (SELECT max(ds) FROM q) + 1)) AS ds FROM (SELECT DISTINCT unique_id FROM q))
        SELECT unique_id, ds, coalesce(y, 0) AS y, (y IS NOT NULL)::BIGINT AS y_mask FROM g LEFT JOIN q USING (unique_id, ds)""",
    "expert_losses": losses(False),
    "expert_gradients": losses(True),
    "ewm_smooth": panel() + """, l AS (SELECT unique_id, ds, list(y) OVER w AS ys, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds))
        SELECT unique_id, ds::VARCHAR AS ds, round(list_sum(list_transform(range(1, n + 1), lambda i: pow(0.4, n - i) * ys[i])) / list_sum(list_transform(range(1, n + 1), lambda i: pow(0.4, n - i))), 2) + 0.0 AS y FROM l""",
    "diff1": panel() + ", d AS (SELECT unique_id, ds, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS y FROM p)" + dates("", "d WHERE y IS NOT NULL"),
    "trajectories": panel() + ", t AS (SELECT unique_id, ds, lag(y, 2) OVER w AS s0, lag(y, 1) OVER w AS s1, y AS s2 FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) SELECT unique_id, ds::VARCHAR AS ds, round(s0, 2) AS s0, round(s1, 2) AS s1, round(s2, 2) AS s2 FROM t WHERE s0 IS NOT NULL",
    "ftn_predict": ftn(),
    "ftn_ewm": ftn(smooth=True),
    "ftn_diff1": ftn(diff=True),
    "ftn_global": ftn(everywhere=True),
    "wftn_predict": ftn(alpha=True),
    "alpha_cv": ALPHA_CV.rsplit("WHERE g.model", 1)[0] + """WHERE g.model = 'naive' AND o.model = 'snaive'),
        e AS (SELECT h, unique_id, 2 * avg(abs(y - naive) / (abs(y) + abs(naive))) AS a, 2 * avg(abs(y - n) / (abs(y) + abs(n))) AS b FROM o GROUP BY ALL)
        SELECT 'naive' AS model, h AS horizon, round(1 / (1 + exp(avg(b) - avg(a))), 6) AS alpha FROM e GROUP BY h""",
    "alpha_rolling": ALPHA_CV.rsplit("WHERE g.model", 1)[0] + """WHERE g.model = 'naive' AND o.model = 'snaive'),
        e AS (SELECT h, unique_id, 2 * avg(abs(y - naive) / (abs(y) + abs(naive))) AS a, 2 * avg(abs(y - n) / (abs(y) + abs(n))) AS b FROM o GROUP BY ALL),
        k AS (SELECT h, 1 / (1 + exp(avg(b) - avg(a))) AS alpha FROM e GROUP BY h)
        SELECT 'naive' AS model, h AS horizon, CASE WHEN count(*) OVER w = 3 THEN round(avg(alpha) OVER w, 6) END AS alpha FROM k WINDOW w AS (ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "times_from_text": "SELECT event_type AS unique_id, hour(ts) AS hour, count(*)::DOUBLE AS y FROM events GROUP BY ALL",
    "jitter": panel() + renamed(f"y + {normal('jitter', KEY)} * 0.03 * sd", "JIT").replace("FROM p JOIN", "FROM (SELECT *, stddev_samp(y) OVER (PARTITION BY unique_id) AS sd FROM p) p JOIN"),
    "scaling": panel() + SCALED,
    "augment_union": panel() + SCALED + " UNION ALL" + dates(""),
    "euclidean_barycenter": forecasts() + " SELECT unique_id, ds::VARCHAR AS ds, round((naive + ma3 + snaive) / 3, 2) + 0.0 AS barycenter FROM future",
    "ade_errors": forecasts() + " SELECT unique_id, ds::VARCHAR AS ds, round(y, 2) AS y, " + ", ".join(f"round({m} - y, 2) + 0.0 AS {m}" for m in MODELS) + " FROM past",
    "ade_lag_matrix": forecasts() + ", l AS (SELECT unique_id, ds, y, " + ERRORS + ", lag(y, 1) OVER w AS lag1, lag(y, 13) OVER w AS lag13 FROM past WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) SELECT unique_id, ds::VARCHAR AS ds, " + ", ".join(f"round({c}, 2) + 0.0 AS {c}" for c in ("y", *MODELS, "lag1", "lag13")) + " FROM l WHERE lag13 IS NOT NULL",
    "ade_weights_ols": ade(3, True),
    "ade_linear": ade_two(),
    "ade_forecasters": ade_run(),
    "online_mlpol": online(),
    "mlpol_zero_percentage": undefined("mlpol", "percentage", gradient=False),
    "mlpol_zero_gradient": undefined("mlpol", "percentage"),
    "mlpol_negative_log": undefined("mlpol", "log", gradient=False),
    "mlewa_zero_absolute": undefined("mlewa", "absolute", gradient=False, after=True),
    "evaluate_join": forecasts() + accuracy(" UNION ALL ".join(f"SELECT unique_id, y, '{m}' AS model, CASE WHEN month(ds) % 2 = 0 THEN {m} END AS f FROM future" for m in MODELS), "unique_id"),
    "evaluate_by_group": forecasts() + accuracy(" UNION ALL ".join(f"SELECT CASE WHEN month(ds) <= 6 THEN 'first' ELSE 'second' END AS half, y, '{m}' AS model, {m} AS f FROM future" for m in MODELS), "half"),
    "ewm_long": panel() + f", l AS (SELECT unique_id, ds, list(y) OVER w AS ys, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) SELECT unique_id, ds::VARCHAR AS ds, round({slow(0.05)}, 2) + 0.0 AS y FROM l",
    "magnitude_warp": panel() + warped(),
    "tsmixup": mixup(),
    "online_augment": EVENTS + " SELECT unique_id, ds, round(y, 4) + 0.0 AS y FROM p UNION ALL SELECT p.unique_id || '_JIT' || (row_number - 1), ds, round(y + " + normal("jitter", KEY) + " * 0.03 * sd, 4) + 0.0 FROM p JOIN (SELECT unique_id, stddev_samp(y) AS sd, row_number() OVER (ORDER BY unique_id) AS row_number FROM p GROUP BY unique_id) USING (unique_id)",
    "ade_forecast_ols": ade(2, False),
    "knn_embeddings": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL),
        q AS (SELECT label, list(v ORDER BY i) AS q FROM c GROUP BY label), d AS (SELECT q.label::BIGINT AS query, vec_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - embedding[i]::DOUBLE) * (q[i] - embedding[i]::DOUBLE))) AS d FROM embeddings CROSS JOIN q)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank, vec_id, round(sqrt(d), 6) AS distance FROM d QUALIFY rank <= 3""",
}
