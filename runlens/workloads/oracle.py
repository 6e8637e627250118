"""DuckDB SQL for every registered query, written from the definitions in FIXTURES.md.

It shares no code with the operators. Named table expressions are written once; a
query gets those it mentions, in order of dependency.
"""

from __future__ import annotations

import re

from runlens.functions.student import t_series_coefficients, t_table

SCENARIOS = [
    "no_rt", "no_rt_x_rt_2", "rt_2_x_no_rt", "rt_2_x_rt_2",
    "rt_2_x_all_yrs", "flat_x_flat_rt_2", "flat_x_young_rt_2", "young_x_young_all_yrs",
]
INDEX_SCENARIOS = ["no_rt", "rt_2_x_rt_2", "flat_x_flat_rt_2"]
FLEETS = range(1, 6)
TS_METRICS = (
    [f"F_{f}" for f in FLEETS] + [f"deadB_{f}" for f in FLEETS] + [f"deadN_{f}" for f in FLEETS]
    + [f"retainB_{f}" for f in range(1, 5)] + ["SpawnBio", "Bio_smry", "Recruit_0", "rec_dev", "SPRratio"]
)
DQ_METRICS = ["Value_SSB", "Value_Recr", "Value_SPRratio", "Value_Bratio", "Value_F"]
SCALAR_METRICS = (
    ["max_grad", "SR_LN_R0", "SSB_Unfished", "SSB_SPR", "F_MSY"]
    + [f"AgeSel_P{f}_event_5" for f in FLEETS]
    + [f"Retain_L_{p}_fleet{f}" for f in (1, 2) for p in ("asymptote_logit", "infl", "width")]
)
FLEET_F = [f"F_{f}" for f in FLEETS]
BIOMASS = [f"retainB_{f}" for f in range(1, 5)] + ["deadB_5"]
K3 = "scenario, iteration, year"
K4 = f"{K3}, model_run"
KL = f"{K4}, label"


def _case(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


def _dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


def _sum(x: str, cond: str | None = None) -> str:
    inner = _dec(x) if cond is None else f"CASE WHEN {cond} THEN {_dec(x)} ELSE 0 END"
    return f"CAST(sum({inner}) AS DOUBLE)"


def _rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _ratio(num: str, den: str, both_zero: str = "NULL", floor: float | None = None) -> str:
    zero = (
        f"({num}) / {floor}" if floor is not None
        else f"CASE WHEN ({num}) > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END"
    )
    return (
        f"CASE WHEN ({num}) IS NULL OR ({den}) IS NULL THEN NULL "
        f"WHEN ({num}) = 0 AND ({den}) = 0 THEN {both_zero} "
        f"WHEN ({den}) = 0 THEN {zero} ELSE ({num}) / ({den}) END"
    )


def _strict(agg: str, x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN {agg}({x}) END"


def _q(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


def _q_any(x: str, p: float) -> str:
    """Quantile of values that may be infinite: interpolate only unequal neighbours."""
    values = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    h = f"((count({x}) - 1) * {p})"
    lo, hi = f"{values}[CAST(floor({h}) AS BIGINT) + 1]", f"{values}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({h} - floor({h})) END"


def _long(table: str, keep: str, cols: list[str], name: str = "variable", value: str = "value",
          where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS {name}, {c} AS {value} FROM {table} WHERE {where}" for c in cols
    )


_scen = _case("l_partkey", SCENARIOS)
_run = (
    "CASE WHEN l_linenumber = 7 THEN 'Base' WHEN l_linestatus = 'F' THEN 'base_OM' "
    "WHEN l_returnflag = 'A' THEN 'base_EM_1998' WHEN l_returnflag = 'R' THEN 'base_EM_2001' "
    "ELSE 'base_EM_init' END"
)
_year = "CAST(year(l_shipdate) AS INTEGER)"
_it = "CAST(l_suppkey AS INTEGER)"
_label = "TRY_CAST(nullif(regexp_extract(model_run, '\\d{4}$'), '') AS INTEGER)"
_role = (
    "CASE WHEN contains(model_run, '_OM') THEN 'OM' WHEN contains(model_run, '_EM') THEN 'EM' "
    "ELSE 'Other' END"
)


def _fleet_sums(prefix: str, x: str, fleets=FLEETS) -> str:
    return ", ".join(f"{_sum(x, f'l_linenumber = {f}')} AS {prefix}{f}" for f in fleets)


def _prepared(raw: str, cut: str, offset: int) -> str:
    return (
        f"SELECT *, label + {offset} - year AS years_until_terminal FROM "
        f"(SELECT *, {_label} AS label FROM {raw}) "
        f"WHERE model_run <> '' AND NOT contains(model_run, 'Base'){cut}"
    )


_cut = " AND CASE WHEN contains(model_run, '_EM') THEN label + 3 - year > 2 ELSE TRUE END"
_shapes = ["flat", "young", "old", "mid"]
_pairs = [(a, b) for a in _shapes for b in _shapes]
_groups = {
    "core": ["no_rt", "no_rt_x_rt_2", "rt_2_x_no_rt", "rt_2_x_rt_2"],
    "all_years": ["no_rt_x_all_yrs", "rep_3_x_all_yrs", "rt_2_x_all_yrs"],
    **{
        f"selectivity_{s}": [f"{a}_x_{b}_{s}" for a, b in _pairs]
        for s in ("rt_2", "all_yrs", "rt_34", "34_all_yrs")
    },
}
_dim_rows = [(s, g) for g, members in _groups.items() for s in members]

# What each scenario's name says, written out: truth and estimator model, the parts of the name
# with its design, and the event classes of estimator and truth, plain and by magnitude.
_NO, _TWO, _ALL = "no event", "two-year event", "every-year event"
_NAMES = {
    "no_rt": ("no_rt", "reference", "no_rt", None, None, _NO, _NO, _NO, _NO),
    "no_rt_x_rt_2": ("no_rt_x_rt_2", "reference", "no_rt", "rt", "rt_2", _TWO, _NO, _TWO, _NO),
    "rt_2_x_no_rt": ("rt_2_x_no_rt", "reference", "rt_2", "no_rt", "", _NO, _TWO, _NO, _TWO),
    "rt_2_x_rt_2": ("rt_2_x_rt_2", "reference", "rt_2", "rt", "rt_2", _TWO, _TWO, _TWO, _TWO),
    "rt_2_x_all_yrs": ("rt_2_x_all_yrs", "all years", "rt_2", "all_yrs", "", _ALL, _TWO, _TWO, _TWO),
    "flat_x_flat_rt_2": ("flat", "flat", "flat", "flat", "rt_2", _TWO, _TWO, _TWO, _TWO),
    "flat_x_young_rt_2": ("flat", "young", "flat", "young", "rt_2", _TWO, _TWO, _TWO, _TWO),
    "young_x_young_all_yrs": ("young", "young", "young", "young_all_yrs", "", _ALL, _TWO, _TWO, _TWO),
}


def _said(i: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _NAMES.items() if v[i] is not None)
    return f"CASE scenario {whens} END"


_om_name, _em_name = _said(0), _said(1)
PARSED = f"{_om_name} AS om_name, {_em_name} AS em_name"
PARTS = f"{_said(2)} AS om_name, {_said(3)} AS em_name"
DESIGN = f"{_said(4)} AS design"
EM_CLASS, OM_CLASS, EM_HIGH, OM_HIGH = (_said(i) for i in (5, 6, 7, 8))


def _side(m: str, catch: str, side: str) -> str:
    """A named quantity of one side of the pair."""
    return {
        "recruits": f"Recruit_0_{side}",
        "F_5": f"F_5_{side}",
        "ssb": f"SpawnBio_{side}",
        "commercial": f"({catch}1_{side} + {catch}2_{side})",
        "recreational": f"{catch}4_{side}",
        "event_dead": f"deadB_5_{side}",
        "abundance": f"Bio_smry_{side}",
        "commercial_F": f"(F_1_{side} + F_2_{side})",
        "recreational_F": f"F_4_{side}",
    }[m]


SEVEN = ["recruits", "F_5", "ssb", "commercial", "recreational", "event_dead", "abundance"]
NINE = SEVEN + ["commercial_F", "recreational_F"]


def _named(kind: str, metrics: list[str] = SEVEN, catch: str = "deadB_", both_zero: str = "NULL",
           null_to: str | None = None, digits: int | None = 6, where: str = "label = 2001") -> str:
    """Errors of named quantities on the pairs, one row per estimate row."""
    out = []
    for m in metrics:
        em, om = _side(m, catch, "em"), _side(m, catch, "om")
        x = {
            "residual": f"{em} - {om}",
            "abs": f"abs({em} - {om})",
            "re": _ratio(f"{em} - {om}", om, both_zero),
            "bias": f"({_ratio(f'{em} - {om}', om, both_zero)}) * 100",
            "ape": f"abs({_ratio(f'{em} - {om}', om, both_zero)}) * 100",
            "inverse": _ratio(om, em, both_zero),
        }[kind]
        if null_to is not None:
            x = f"coalesce({x}, {null_to})"
        out.append(f"{x} AS {m}" if digits is None else f"round({x}, {digits}) AS {m}")
    return f"SELECT {KL}, {', '.join(out)} FROM pair_ts WHERE {where}"


def _pair(table: str, metrics: list[str]) -> str:
    cols = ", ".join(f"e.{m} AS {m}_em, o.{m} AS {m}_om" for m in metrics)
    return (
        f"SELECT e.scenario, e.iteration, e.year, e.model_run, e.label, {cols} "
        f"FROM (SELECT * FROM {table} WHERE contains(model_run, '_EM')) e "
        f"LEFT JOIN (SELECT * FROM {table} WHERE contains(model_run, '_OM')) o "
        "ON e.scenario = o.scenario AND e.iteration = o.iteration AND e.year = o.year"
    )


def _ratios(metrics: list[str], pairs: str, floor: float | None) -> str:
    cols = ", ".join(f"{_ratio(f'{m}_em', f'{m}_om', '1.0', floor)} AS {m}" for m in metrics)
    return f"SELECT {KL}, label + 3 - year AS gap, {cols} FROM {pairs}"


def _curve(params: str) -> str:
    return (
        "SELECT p.*, CAST(x AS INTEGER) AS x, CASE WHEN width = 0 THEN NULL ELSE "
        f"asym / (1 + exp(-((x - infl) / width))) END AS y FROM {params} p, range(0, 101) r(x)"
    )


_plan = "l_linenumber <> 3 OR year(l_shipdate) < 1999"

CTES = {
    "dim": "SELECT * FROM (VALUES "
    + ", ".join(f"('{s}', {i}, '{g}')" for i, (s, g) in enumerate(_dim_rows, start=1))
    + ') t(scenario, ordinal, "group")',
    "ts_raw": f"SELECT {_scen} AS scenario, {_it} AS iteration, {_year} AS year, {_run} AS model_run, "
    + ", ".join(
        [
            _fleet_sums("F_", "l_discount"),
            _fleet_sums("deadB_", "l_quantity"),
            ", ".join(
                f"CAST(count(*) FILTER (WHERE l_linenumber = {f}) AS DOUBLE) AS deadN_{f}" for f in FLEETS
            ),
            _fleet_sums("retainB_", "l_quantity * (1 - l_discount)", range(1, 5)),
            f"{_sum('l_extendedprice')} AS SpawnBio",
            f"{_sum('l_extendedprice * (1 + l_tax)')} AS Bio_smry",
            "CAST(count(*) AS DOUBLE) AS Recruit_0",
            f"CAST(sum({_dec('l_tax')}) - sum({_dec('l_discount')}) AS DOUBLE) AS rec_dev",
            f"{_sum('l_tax')} AS SPRratio",
        ]
    )
    + " FROM lineitem GROUP BY 1, 2, 3, 4",
    "ts": _prepared("ts_raw", _cut, 3),
    "uncut": _prepared("ts_raw", "", 0),
    "proj": "SELECT * FROM uncut WHERE year >= 1996",
    "dq_raw": f"SELECT {_scen} AS scenario, {_it} AS iteration, {_year} AS year, {_run} AS model_run, "
    f"{_sum('l_extendedprice')} AS Value_SSB, CAST(count(*) AS DOUBLE) AS Value_Recr, "
    f"{_sum('l_tax')} AS Value_SPRratio, {_sum('l_quantity')} AS Value_Bratio, "
    f"{_sum('l_discount')} AS Value_F FROM lineitem GROUP BY 1, 2, 3, 4",
    "dq": _prepared("dq_raw", _cut, 3),
    "scalar_raw": f"SELECT {_scen} AS scenario, {_it} AS iteration, {_run} AS model_run, "
    f"{_sum('l_discount')} AS max_grad, {_sum('l_tax')} AS SR_LN_R0, "
    f"{_sum('l_extendedprice')} AS SSB_Unfished, {_sum('l_quantity')} AS SSB_SPR, "
    "max(l_tax) AS F_MSY, "
    + ", ".join(f"{_sum('l_discount', f'l_linenumber = {f}')} AS AgeSel_P{f}_event_5" for f in FLEETS)
    + ", "
    + ", ".join(
        f"max(l_discount) FILTER (WHERE l_linenumber = {f}) AS Retain_L_asymptote_logit_fleet{f}, "
        f"max(l_quantity) FILTER (WHERE l_linenumber = {f}) AS Retain_L_infl_fleet{f}, "
        f"1 + max(l_tax) FILTER (WHERE l_linenumber = {f}) AS Retain_L_width_fleet{f}"
        for f in (1, 2)
    )
    + " FROM lineitem GROUP BY 1, 2, 3",
    "scalar": "SELECT * FROM scalar_raw WHERE model_run <> '' AND NOT contains(model_run, 'Base')",
    "pair_ts": _pair("ts", TS_METRICS),
    "pair_dq": _pair("dq", DQ_METRICS),
    "ratio_ts": _ratios(TS_METRICS, "pair_ts", 0.001),
    "ratio_dq": _ratios(DQ_METRICS, "pair_dq", None),
    "scen": "SELECT scenario, count(*) AS n_rows FROM ts GROUP BY 1",
    "latest": "SELECT * FROM ts WHERE contains(model_run, 'OM') OR contains(model_run, "
    "(SELECT CAST(max(label) AS VARCHAR) FROM ts))",
    "events_hit": "SELECT * FROM latest WHERE F_5 > 0 AND year >= 1996",
    "retain": " UNION ALL ".join(
        f"SELECT scenario, iteration, model_run, 'fleet{f}' AS fleet, "
        f"Retain_L_asymptote_logit_fleet{f} AS asym, Retain_L_infl_fleet{f} AS infl, "
        f"Retain_L_width_fleet{f} AS width FROM scalar"
        for f in (1, 2)
    ),
    "natage": f"SELECT {_scen} AS scenario, {_it} AS iteration, {_run} AS run, {_year} AS Yr, "
    "CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'M' END AS beg_mid, l_linenumber AS fleet, "
    + ", ".join(f'{_sum("l_quantity", f"p_size % 21 = {a}")} AS "{a}"' for a in range(21))
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5, 6",
    "natage_long": " UNION ALL ".join(
        f'SELECT scenario, iteration, run, Yr, beg_mid, fleet, {a} AS age, "{a}" AS n FROM natage'
        for a in range(21)
    ),
    "report_rows": f"SELECT {_scen} AS scenario, {_it} AS iteration, {_run} AS run, {_year} AS Yr, l_linenumber AS fleet, "
    "CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'M' END AS beg_mid, "
    "CASE WHEN l_suppkey % 2 = 0 THEN 'Asel2' ELSE 'Asel' END AS age_factor, "
    "CASE l_suppkey % 3 WHEN 0 THEN 'Lsel' WHEN 1 THEN 'Dead' ELSE 'Keep' END AS size_factor, "
    "CAST(p_size % 21 AS INTEGER) AS age, CAST(20 + 10 * (p_size % 5) AS INTEGER) AS length, lineitem.* "
    f"FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_run} = 'base_EM_2001'",
    "cpue": f"SELECT {_case('user_id', INDEX_SCENARIOS)} AS scenario, "
    "CAST(user_id % 10 AS INTEGER) AS iteration, "
    "CASE WHEN event_id % 2 = 0 THEN 'OM' ELSE 'EM' END AS model, event_type AS fleet_name, "
    f"CAST(day(ts) AS INTEGER) AS yr, {_sum('value')} AS obs, "
    "CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS exp "
    "FROM events GROUP BY 1, 2, 3, 4, 5",
    "index_long": " UNION ALL ".join(
        f"SELECT fleet_name, scenario, model, yr, '{s}' AS series, {s} AS value FROM cpue "
        f"WHERE {s} IS NOT NULL"
        for s in ("obs", "exp")
    ),
    "plan_catch": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, l_linenumber AS fleet, 1 AS seas, "
    f"{_sum('l_tax')} / count(*) AS catch_se, {_sum('l_quantity')} AS catch "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "plan_index": f'SELECT {_year} AS year, l_linenumber AS "index", {_sum("l_discount")} / count(*) AS se_log '
    f"FROM lineitem WHERE {_plan} GROUP BY 1, 2",
    "comps": f"SELECT {_year} AS yr, 7 AS seas, l_linenumber AS fltsvy, "
    f"CAST(l_suppkey % 3 AS INTEGER) AS part, {_sum('l_quantity')} AS nsamp "
    f"FROM lineitem WHERE {_plan} GROUP BY 1, 3, 4",
    "template": f"SELECT DISTINCT {_year} AS yr, 1 AS seas, 5 AS fltsvy, 0.0::DOUBLE AS catch FROM lineitem",
    "future": "SELECT CAST(y AS INTEGER) AS yr FROM range(2002, 2053) r(y)",
    "residual": _named("residual", digits=None),
    "win": "SELECT * FROM (VALUES ('long', 1996, 2001), ('short', 1996, 1998)) t(\"window\", lo, hi)",
    "sector_pairs": "SELECT *, deadB_1_em + deadB_2_em AS com_em, deadB_1_om + deadB_2_om AS com_om "
    "FROM pair_ts WHERE label = 2001 AND year BETWEEN 1996 AND 1998 AND deadB_1_om IS NOT NULL",
    "level_rows": "SELECT scenario, iteration, deadB_1 + deadB_2 AS commercial, deadB_4 AS recreational, "
    "deadB_5 AS event, Recruit_0 AS recruits, SpawnBio AS ssb FROM ts "
    "WHERE contains(model_run, '_EM') AND label = 2001 AND year BETWEEN 1996 AND 1998",
    "level_long": _long(
        "level_rows", "scenario, iteration", ["commercial", "recreational", "event", "recruits", "ssb"], "type"
    ),
    "level_means": f"SELECT scenario, type, iteration, {_strict('avg', 'value')} AS mean_value "
    "FROM level_long GROUP BY 1, 2, 3",
    "bias_short": _named("bias", digits=None, where="label = 2001 AND year BETWEEN 1996 AND 1998"),
    "inverse_short": _named("inverse", digits=None, where="label = 2001 AND year BETWEEN 1996 AND 1998"),
    "truth": "SELECT * FROM ts WHERE contains(model_run, '_OM') AND year BETWEEN 1996 AND 2001",
    "shares": "SELECT scenario, "
    + ", ".join(
        f"sum({s}_em - {s}_om) AS r_{n}, sum({s}_om) AS o_{n}, avg({s}_em - {s}_om) AS mr_{n}, "
        f"avg({s}_om) AS mo_{n}, avg({s}_em) AS me_{n}"
        for s, n in (("com", "com"), ("deadB_4", "rec"), ("deadB_5", "eve"))
    )
    + " FROM sector_pairs GROUP BY 1",
    "n_it": "SELECT count(DISTINCT iteration) AS n FROM ts",
    "models": f"SELECT DISTINCT om_name AS model FROM (SELECT {_om_name} AS om_name FROM scen) "
    "WHERE om_name IN ('flat', 'young', 'old', 'mid')",
    "grid": "SELECT a.model AS om, b.model AS em, a.model || '_x_' || b.model || '_rt_2' AS scenario, "
    "CASE a.model WHEN 'flat' THEN 21.0::DOUBLE / 21 WHEN 'young' THEN 21.0::DOUBLE / 9 "
    "WHEN 'old' THEN 21.0::DOUBLE / 17.25::DOUBLE WHEN 'mid' THEN 21.0::DOUBLE / 16.75::DOUBLE END AS multiplier "
    "FROM models a, models b",
}
for _err in ("bias", "inverse"):
    CTES[f"{_err}_means"] = (
        f"SELECT scenario, type, iteration, {_strict('avg', 'value')} AS mean_value FROM ("
        + _long(f"{_err}_short", "scenario, iteration", ["commercial", "recreational", "recruits", "ssb"], "type")
        + ") GROUP BY 1, 2, 3"
    )


def _mentions(sql: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql))
    return [n for n in CTES if n in words]


def _shift_ties(sql: str) -> str:
    """round(x, d) -> round(x moved by 1e-9 away from zero, d).

    Means of two-decimal values often end on an exact tie, where the last bit of a sum
    would decide the digit; the shift decides it the same way in both engines, and is far below
    the digits that are kept.
    """
    out, i = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < i:
            continue
        depth, j, cut = 1, m.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                cut = j
            j += 1
        inner = _shift_ties(sql[m.end():cut])
        out += f"{sql[i:m.start()]}round(({inner}) + sign({inner}) * 1e-9::DOUBLE{sql[cut:j]}"
        i = j
    return out + sql[i:]


def _with(body: str) -> str:
    """The body behind the table expressions it needs."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in _mentions(sql):
            if n not in order:
                visit(CTES[n])
                if n not in order:
                    order.append(n)

    visit(body)
    if not order:
        return body
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " + body


def _box(src: str, keys: str, x: str, digits: int = 6) -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in ks)
    inside = "a.v >= b.q1 - 1.5 * (b.q3 - b.q1) AND a.v <= b.q3 + 1.5 * (b.q3 - b.q1)"
    group = ", ".join(f"a.{k}" for k in ks)
    return (
        f"SELECT {group}, count(*) AS n, "
        f"round(min(a.v) FILTER (WHERE {inside}), {digits}) AS lower_whisker, "
        f"round(max(b.q1), {digits}) AS lower_hinge, round(max(b.q2), {digits}) AS median, "
        f"round(max(b.q3), {digits}) AS upper_hinge, "
        f"round(max(a.v) FILTER (WHERE {inside}), {digits}) AS upper_whisker, "
        f"count(*) FILTER (WHERE NOT ({inside})) AS n_outliers "
        f"FROM (SELECT {keys}, {x} AS v FROM {src} WHERE {x} IS NOT NULL AND isfinite({x})) a "
        f"JOIN (SELECT {keys}, {_q(x, 0.25)} AS q1, {_q(x, 0.5)} AS q2, {_q(x, 0.75)} AS q3 "
        f"FROM {src} WHERE {x} IS NOT NULL AND isfinite({x}) GROUP BY {keys}) b ON {on} GROUP BY {group}"
    )


def _report(keys: str, by: str, numbers: range, x: str, index: str, value: str, where: str) -> str:
    """Long rows of a report of the run base_EM_2001: every number, also those without a row."""
    return (
        f"SELECT scenario, iteration, run, Yr, fleet, {index}, round(coalesce({value}, 0), 6) AS {value} FROM ("
        f"SELECT DISTINCT scenario, iteration, run, Yr, fleet, {keys} FROM report_rows WHERE {where}) g "
        f"CROSS JOIN (SELECT CAST(unnest(range({numbers.start}, {numbers.stop}, {numbers.step})) AS INTEGER) AS {index}) "
        f"LEFT JOIN (SELECT scenario, iteration, run, Yr, fleet, {keys}, {by} AS {index}, "
        f"{_sum(x)} AS {value} FROM report_rows WHERE {where} GROUP BY ALL) "
        f"USING (scenario, iteration, run, Yr, fleet, {keys}, {index})"
    )


def _outliers(src: str, keys: str, x: str, digits: int = 6) -> str:
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    group = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    finite = f"FROM {src} WHERE {x} IS NOT NULL AND isfinite({x})"
    return (
        f"SELECT {group}, round(a.v, {digits}) AS value, count(*) AS n FROM (SELECT {keys}, {x} AS v {finite}) a "
        f"JOIN (SELECT {keys}, {_q(x, 0.25)} AS q1, {_q(x, 0.75)} AS q3 {finite} GROUP BY {keys}) b ON {on} "
        f"WHERE a.v < b.q1 - 1.5 * (b.q3 - b.q1) OR a.v > b.q3 + 1.5 * (b.q3 - b.q1) GROUP BY {group}, a.v"
    )


def _ribbon(src: str, keys: str = "scenario, year, variable", x: str = "ratio", center: str = "median",
            digits: int = 4) -> str:
    mid = _q(x, 0.5) if center == "median" else f"avg({x})"
    return (
        f"SELECT {keys}, round({mid}, {digits}) AS {center}_ratio, "
        f"round({_q(x, 0.25)}, {digits}) AS lower_quartile, "
        f"round({_q(x, 0.75)}, {digits}) AS upper_quartile FROM ({src}) GROUP BY {keys}"
    )


def _ratio_rows(cols: list[str], closed: str = "", label: bool = True) -> str:
    where = "year >= 1996" + (" AND label = 2001" if label else " AND gap > 0")
    return " UNION ALL ".join(
        f"SELECT scenario, year, gap AS years_until_terminal, '{c}' AS variable, "
        f"{'1.0' if c == closed else c} AS ratio FROM ratio_ts WHERE {where}"
        for c in cols
    )


def _terminal(cols: list[str], closed: str = "") -> str:
    return _ribbon(_ratio_rows(cols, closed, False), "scenario, years_until_terminal, variable", center="mean")


def _t_limits(src: str, keys: str) -> str:
    table = "[" + ", ".join(repr(v) for v in t_table()) + "]"
    a = t_series_coefficients(0.975)
    df = "CAST(n - 1 AS DOUBLE)"
    series = " + ".join(f"{c!r} / power({df}, {i})" for i, c in enumerate(a))
    t = f"CASE WHEN n < 2 THEN NULL WHEN n <= 201 THEN {table}[n - 1] ELSE {series} END"
    return (
        f"SELECT {keys}, n, round(m, 4) AS mean, round(m - {t} * s / sqrt(n), 4) AS lower, "
        f"round(m + {t} * s / sqrt(n), 4) AS upper FROM (SELECT {keys}, count(*) AS n, avg(value) AS m, "
        f"stddev_samp(value) AS s FROM ({src}) WHERE value IS NOT NULL AND isfinite(value) GROUP BY {keys})"
    )


def _stat_lines(table: str, cols: list[str], extra: str = "TRUE") -> str:
    rows = _long(table, f"year, scenario, {_role} AS model_type", cols, where=extra)
    return (
        "SELECT year, scenario, model_type, variable, round(avg(value), 5) AS mean, "
        f"round({_q('value', 0.5)}, 5) AS median, round(stddev_samp(value), 4) AS sd "
        f"FROM ({rows}) WHERE model_type <> 'Other' GROUP BY 1, 2, 3, 4"
    )


def _truth_mean(cols: list[str], extra: str, null_to: str | None = None) -> str:
    em_rows = _long("proj", f"{KL}, years_until_terminal", cols, "fleet",
                    where=f"contains(model_run, '_EM') AND NOT contains(model_run, 'init'){extra}")
    om_rows = _long("proj", "scenario, year", cols, "fleet", where="contains(model_run, '_OM')")
    ratio = _ratio("e.value", "o.om_value")
    if null_to is not None:
        ratio = f"coalesce({ratio}, {null_to})"
    return (
        f"SELECT e.*, o.om_value, {ratio} AS ratio FROM ({em_rows}) e LEFT JOIN "
        f"(SELECT scenario, year, fleet, {_strict('avg', 'value')} AS om_value FROM ({om_rows}) GROUP BY 1, 2, 3) o "
        "ON e.scenario = o.scenario AND e.year = o.year AND e.fleet = o.fleet"
    )


def _band(src: str, keys: str, center: str) -> str:
    mid = "avg(ratio)" if center == "mean" else _q_any("ratio", 0.5)
    return (
        f"SELECT {keys}, round(m, 6) AS {center}_ratio, round(s, 6) AS sd_ratio, round(m - s, 6) AS ymin, "
        f"round(m + s, 6) AS ymax FROM (SELECT {keys}, {mid} AS m, stddev_samp(ratio) AS s "
        f"FROM ({src}) GROUP BY {keys})"
    )


_f5 = {"mean_F_5": "avg(F_5)", "sd_F_5": "stddev_samp(F_5)", "median_F_5": _q("F_5", 0.5)}
_event_1 = (
    " AND (scenario, year) IN (SELECT (scenario, year) FROM proj WHERE contains(model_run, '_OM') "
    "AND iteration = 1 AND F_5 > 0)"
)
_share = {
    "share_commercial": f"({_ratio('r_com', 'o_com')}) * 100",
    "share_recreational": f"({_ratio('r_rec', 'o_rec')}) * 100",
    "share_event": f"({_ratio('r_eve', 'o_eve')}) * 100",
    "total_residual": "(r_com + r_rec + r_eve) / (SELECT n FROM n_it)",
    "share_total": f"({_ratio('r_com + r_rec + r_eve', 'o_com + o_rec + o_eve')}) * 100",
}
_mean_share = {
    "share_commercial": f"({_ratio('mr_com', 'me_com')}) * 100",
    "share_recreational": f"({_ratio('mr_rec', 'mo_rec')}) * 100",
    "share_event": f"({_ratio('mr_eve', 'mo_eve')}) * 100",
    "total_residual": "mr_com + mr_rec + mr_eve",
    "share_total": f"({_ratio('mr_com + mr_rec + mr_eve', 'mo_com + mo_rec + mo_eve')}) * 100",
}


def _residual_sums(where: str) -> str:
    sums = ", ".join(
        f"round(({_strict('sum', s)}) / (SELECT n FROM n_it), 4) AS sum_{s}"
        for s in ("commercial", "recreational", "event_dead")
    )
    return (
        f'SELECT "window", scenario, {sums} FROM residual JOIN win ON year BETWEEN lo AND hi '
        f"WHERE {where} GROUP BY 1, 2"
    )


def _interval(src: str, keys: str, x: str, digits: int = 6) -> str:
    return (
        f"SELECT {keys}, round({_q(x, 0.5)}, {digits}) AS med_val, round({_q(x, 0.025)}, {digits}) AS low, "
        f"round({_q(x, 0.975)}, {digits}) AS high FROM ({src}) GROUP BY {keys}"
    )


def _reference(src: str, where: str, keys: str = "type", digits: int = 6) -> str:
    return (
        f"SELECT {keys}, round(CASE WHEN count(mean_value) = count(*) THEN {_q('mean_value', 0.5)} END, {digits}) "
        f"AS median_value FROM {src} WHERE {where} GROUP BY {keys}"
    )


_hist_rows = (
    "SELECT scenario, year, F_5 AS v FROM ts WHERE contains(model_run, '_EM') AND year IN (1995, 1998, 2000)"
)


def _re_of(m: str) -> str:
    em, om = _side(m, "retainB_", "em"), _side(m, "retainB_", "om")
    return f"{_ratio(f'{em} - {om}', om, '1.0')} AS {m}"


_re_metrics = ", ".join(_re_of(m) for m in NINE)
CTES["re_rows"] = f"SELECT scenario, {_re_metrics} FROM pair_ts WHERE year >= 1996"
CTES["re_long"] = _long("re_rows", "scenario", NINE)
CTES["level_parsed"] = f"SELECT *, {PARSED} FROM level_means"
CTES["r0"] = "SELECT scenario, iteration, model_run, exp(SR_LN_R0) AS r0 FROM scalar"
CTES["chosen"] = (
    "SELECT * FROM ts WHERE year IN (1995, 1998, 2000) AND regexp_matches(model_run, '2001|OM')"
)
CTES["hist"] = (
    "SELECT r.*, e.lo, (e.hi - e.lo) / 9 AS width FROM (" + _hist_rows + ") r, "
    "(SELECT min(v) AS lo, max(v) AS hi FROM (" + _hist_rows + ")) e"
)

_F_ONLY = [f"F_{f}" for f in FLEETS]
_sector_long = (
    "SELECT {k}, 'recreational' AS sector, deadB_4 AS value FROM ts WHERE {w} UNION ALL "
    "SELECT {k}, 'event' AS sector, deadB_5 AS value FROM ts WHERE {w} UNION ALL "
    "SELECT {k}, 'commercial' AS sector, deadB_1 + deadB_2 AS value FROM ts WHERE {w}"
)
_series = (
    _long("(SELECT *, retainB_1 + retainB_2 + retainB_3 + retainB_4 AS retainB_all FROM ts)", K4,
          ["SpawnBio", "F_5", "retainB_all"])
    + " UNION ALL "
    + _long("dq", K4, ["Value_SPRratio"])
)
_re_all = [
    f"round({_ratio(f'{m}_em - {m}_om', f'{m}_om', '1.0')}, 6) AS {m}" for m in TS_METRICS
]
for _name, _cols in {"F_commercial": ("F_1", "F_2"), "retain_commercial": ("retainB_1", "retainB_2")}.items():
    _re_all.append(
        "round("
        + " + ".join(f"({_ratio(f'{m}_em - {m}_om', f'{m}_om', '1.0')})" for m in _cols)
        + f", 6) AS {_name}"
    )
_mean_error = [m for m in NINE if m != "abundance"]


def _plain(m: str) -> str:
    return _side(m, "retainB_", "X").replace("_X", "")


_om_mean_cols = ", ".join(f"{_strict('avg', _plain(m))} AS o_{m}" for m in _mean_error)
_om_mean_err = ", ".join(
    f"round(coalesce({_ratio(f'{_plain(m)} - o_{m}', f'o_{m}')}, 0), 6) AS {m}" for m in _mean_error
)

BODIES = {
    # A
    "load_summary_dq": f"SELECT {K4}, {_rounded(DQ_METRICS)} FROM dq_raw",
    "prepare_ts": f"SELECT {KL}, years_until_terminal, {_rounded(TS_METRICS)} FROM ts",
    "prepare_ts_by_label": f"SELECT {KL}, years_until_terminal, {_rounded(TS_METRICS)} FROM ts "
    "WHERE contains(model_run, '_EM') AND label = 2001",
    "natage_long": _report("beg_mid", "age", range(21), "l_quantity", "age", "n", "beg_mid = 'B'"),
    "batage_long": _report("beg_mid", "age", range(21), "l_extendedprice", "age", "biomass", "beg_mid = 'B'"),
    "catage_long": _report("l_linenumber", "age", range(21), "l_quantity * (1 - l_discount)", "age", "catch", "true"),
    "age_selectivity_long": _report("age_factor", "age", range(21), "l_discount", "age", "selex", "age_factor = 'Asel2'"),
    "size_selectivity_long": _report("size_factor", "length", range(20, 70, 10), "l_tax", "length", "selex", "size_factor = 'Lsel'"),
    "dead_selectivity_long": _report("size_factor", "length", range(20, 70, 10), "l_tax", "length", "selex", "size_factor = 'Dead'"),
    "prepare_dq": f"SELECT {KL}, years_until_terminal, {_rounded(DQ_METRICS)} FROM dq",
    "prepare_scalar": f"SELECT scenario, iteration, model_run, {_rounded(SCALAR_METRICS)} FROM scalar",
    "prepare_ts_uncut": f"SELECT {KL}, years_until_terminal, {_rounded(TS_METRICS)} FROM uncut",
    "scenario_order": 'SELECT scenario, n_rows, ordinal, "group" FROM scen JOIN dim USING (scenario)',
    "split_roles": f"SELECT scenario, model_run, {_role} AS role, count(*) AS n_rows, "
    "count(DISTINCT year) AS n_years FROM ts_raw GROUP BY 1, 2, 3",
    "latest_runs": f"SELECT {K4}, round(SpawnBio, 6) AS SpawnBio, round(F_5, 6) AS F_5 FROM uncut "
    "WHERE contains(model_run, 'OM') OR contains(model_run, (SELECT CAST(max(label) AS VARCHAR) FROM uncut))",
    "latest_runs_by_number": f"SELECT {K4}, max_number, round(retainB_1 + retainB_2 + retainB_3 + retainB_4, 6) "
    "AS retainB_all FROM (SELECT *, list_max(list_transform(regexp_extract_all(model_run, '\\d+'), "
    "lambda x: CAST(x AS BIGINT))) AS max_number FROM uncut) WHERE contains(model_run, 'OM') OR max_number = "
    "(SELECT max(label) FROM uncut)",
    "merge_summaries": f"SELECT {K4}, CAST(NULL AS DOUBLE) AS F_4, round(F_5, 6) AS F_5, "
    "round(SpawnBio, 6) AS SpawnBio FROM ts WHERE NOT regexp_matches(scenario, 'flat_rt_2$') UNION ALL "
    "SELECT replace(replace(scenario, '_all_yrs', '_34_all_yrs'), '_rt_2', '_rt_34') AS scenario, "
    "iteration, year, model_run, round(F_4, 6) AS F_4, round(F_5, 6) AS F_5, round(SpawnBio, 6) AS SpawnBio FROM ts",
    "parse_scenario": f"SELECT *, CASE om_name WHEN 'reference' THEN 1 WHEN 'young' THEN 2 WHEN 'mid' THEN 3 "
    "WHEN 'old' THEN 4 WHEN 'flat' THEN 5 END AS om_ordinal, CASE em_name WHEN 'reference' THEN 1 "
    "WHEN 'all years' THEN 2 WHEN 'young' THEN 3 WHEN 'mid' THEN 4 WHEN 'old' THEN 5 WHEN 'flat' THEN 6 END "
    f"AS em_ordinal FROM (SELECT scenario, n_rows, {PARSED}, {_em_name} AS em_name_wide FROM scen)",
    "parse_scenario_parts": f"SELECT scenario, n_rows, {PARTS}, {DESIGN} FROM scen",
    "classify_design": f"SELECT scenario, n_rows, {EM_CLASS} AS em_class, {OM_CLASS} AS om_class, "
    f"{EM_HIGH} AS em_class_high, {OM_HIGH} AS om_class_high FROM scen",
    "load_run_reports_latest": "SELECT scenario, iteration, run, Yr, beg_mid, fleet, "
    + ", ".join(f'round("{a}", 6) AS "{a}"' for a in range(21))
    + " FROM natage WHERE ends_with(run, '_EM_2001')",
    "load_run_reports_truth": "SELECT scenario, iteration, run, Yr, beg_mid, fleet, "
    + ", ".join(f'round("{a}", 6) AS "{a}"' for a in range(21))
    + " FROM natage WHERE contains(run, '_OM')",
    "at_age_long": "SELECT scenario, run, Yr, fleet, age, count(*) AS n_rows, "
    "CAST(sum(CAST(n AS BIGINT)) AS BIGINT) AS total FROM natage_long WHERE beg_mid = 'B' GROUP BY 1, 2, 3, 4, 5",
    # B
    "fleet_long": " UNION ALL ".join(
        f"SELECT {K4}, {f} AS fleet, round(F_{f}, 6) AS value FROM ts" for f in FLEETS
    ),
    "removals_by_sector": _sector_long.format(k=K4, w="TRUE"),
    "removals_by_sector_in_events": _sector_long.format(
        k=K4, w="contains(model_run, '_EM') AND label = 2001 AND deadB_5 > 0"
    ),
    "retained_total": f"SELECT {K4}, round(retainB_1 + retainB_2 + retainB_3 + retainB_4, 6) AS retainB_all FROM ts",
    "retention_params": f"SELECT scenario, iteration, model_run, fleet, {_rounded(['asym', 'infl', 'width'])} FROM retain",
    "retention_curves": "SELECT scenario, fleet, x, count(y) AS n, round(avg(y), 6) AS mean_y, "
    f"round(max(y), 6) AS max_y FROM ({_curve('retain')}) GROUP BY 1, 2, 3",
    "retention_median": f"SELECT scenario, fleet, model_run, x, round({_q('y', 0.5)}, 6) AS median_y "
    f"FROM ({_curve('retain')}) WHERE regexp_matches(model_run, '2001|OM') GROUP BY 1, 2, 3, 4",
    "age_selectivity": "SELECT DISTINCT replace(model_run, '_OM', '') AS model_run, age, "
    "round(selectivity, 6) AS selectivity, round(1 / (1 + exp(-selectivity)), 6) AS selectivity_logistic FROM ("
    + " UNION ALL ".join(
        f"SELECT model_run, {f - 1} AS age, AgeSel_P{f}_event_5 AS selectivity FROM scalar" for f in FLEETS
    )
    + ") WHERE contains(model_run, '_OM') AND selectivity IS NOT NULL",
    "unfished_recruits": "SELECT scenario, iteration, model_run, round(r0, 6) AS r0 FROM r0",
    "unfished_recruits_ratio": "SELECT scenario, iteration, round(om, 6) AS om, round(em, 6) AS em, "
    f"round({_ratio('em', 'om')}, 6) AS ratio_r0 FROM (SELECT scenario, iteration, "
    "max(r0) FILTER (WHERE model_run = 'base_OM') AS om, max(r0) FILTER (WHERE model_run = 'base_EM_2001') AS em "
    "FROM r0 WHERE model_run IN ('base_OM', 'base_EM_2001') GROUP BY 1, 2)",
    "term_series": f"SELECT {K4}, variable, round(value, 6) AS value FROM ({_series})",
    "term_series_short": f"SELECT {K4}, variable, round(value, 6) AS value FROM ({_series}) "
    "WHERE regexp_matches(model_run, '1998|OM')",
    # C
    "relative_error_all": f"SELECT {KL}, {', '.join(_re_all)} FROM pair_ts",
    "relative_error_named": _named("re", NINE, "retainB_", null_to="0"),
    "ratio_all": f"SELECT {KL}, {_rounded(TS_METRICS)} FROM ratio_ts",
    "ratio_all_long": f"SELECT {KL}, {_rounded(TS_METRICS)} FROM ratio_ts",
    "ratio_all_dq": f"SELECT {KL}, {_rounded(DQ_METRICS)} FROM ratio_dq",
    "residuals": _named("residual"),
    "absolute_error": _named("abs", catch="retainB_"),
    "absolute_pct_error": _named("ape", NINE, "retainB_", null_to="0"),
    "percent_bias": _named("bias"),
    "percent_bias_numbers": _named("bias", ["commercial", "recreational"], "deadN_"),
    "om_em_ratio": _named("inverse"),
    "bratio_bias": f"SELECT scenario, iteration, round({_strict('avg', 'b')}, 4) AS mean_value, {PARSED} FROM "
    f"(SELECT scenario, iteration, ({_ratio('Value_Bratio_em - Value_Bratio_om', 'Value_Bratio_om')}) * 100 AS b "
    "FROM pair_dq WHERE label = 2001 AND year BETWEEN 1996 AND 1998) GROUP BY 1, 2",
    "ref_error_vs_om_mean": f"SELECT scenario, iteration, year, model_run, label, {_om_mean_err} FROM "
    "(SELECT * FROM proj WHERE contains(model_run, '_EM') AND NOT contains(model_run, 'init')) LEFT JOIN "
    f"(SELECT year, {_om_mean_cols} FROM proj WHERE contains(model_run, '_OM') GROUP BY 1) USING (year)",
    "event_year_ratio": _band(
        _truth_mean(["retainB_1", "retainB_2", "retainB_4", "deadB_1", "deadB_2", "deadB_4"], _event_1, "0"),
        "scenario, fleet, years_until_terminal", "mean",
    ),
    "f_ratio_vs_om_mean": "SELECT * FROM (" + _band(_truth_mean(_F_ONLY, ""), "scenario, year, fleet", "mean")
    + ") WHERE mean_ratio IS NOT NULL",
    "f_over_fmsy_ratio": _band(
        "SELECT t.scenario, t.fleet, t.years_until_terminal, "
        + _ratio(_ratio("t.value", "m.mean_f_msy"), _ratio("t.om_value", "0.259"))
        + f" AS ratio FROM ({_truth_mean(_F_ONLY, '')}) t LEFT JOIN (SELECT scenario, model_run, "
        f"{_strict('avg', 'F_MSY')} AS mean_f_msy FROM scalar GROUP BY 1, 2) m "
        "ON t.scenario = m.scenario AND t.model_run = m.model_run WHERE t.years_until_terminal > 0",
        "scenario, fleet, years_until_terminal", "median",
    ),
    "relative_ssb": f"SELECT scenario, iteration, round({_ratio('m', 'SSB_Unfished')}, 6) AS relative_ssb, {PARSED} FROM "
    f"(SELECT scenario, iteration, {_strict('avg', 'SpawnBio')} AS m FROM ts WHERE contains(model_run, '2001') "
    "AND year BETWEEN 1996 AND 1998 GROUP BY 1, 2) LEFT JOIN (SELECT scenario, iteration, SSB_Unfished FROM scalar "
    "WHERE contains(model_run, '2001')) USING (scenario, iteration)",
    "relative_ssb_rows": f"SELECT scenario, iteration, round({_ratio('m', 'SSB_Unfished')}, 6) AS relative_ssb FROM "
    "(SELECT scenario, iteration, avg(SpawnBio) OVER (PARTITION BY scenario, iteration) AS m FROM ts "
    "WHERE contains(model_run, '2001') AND year BETWEEN 1996 AND 1998) LEFT JOIN "
    "(SELECT scenario, iteration, SSB_Unfished FROM scalar WHERE contains(model_run, '2001')) USING (scenario, iteration)",
    "ssb_over_ssb_spr": f"SELECT {K4}, round({_ratio('SpawnBio', 'SSB_SPR')}, 4) AS ssb_spr FROM ts LEFT JOIN "
    "(SELECT scenario, iteration, model_run, SSB_SPR FROM scalar) USING (scenario, iteration, model_run) "
    "WHERE contains(model_run, 'EM_2001')",
    "unfished_over_ssb_spr": f"SELECT scenario, iteration, model_run, round({_ratio('SSB_Unfished', 'SSB_SPR')}, 4) "
    "AS unfished_spr FROM scalar WHERE contains(model_run, '2001')",
    # D
    "event_intensity": "SELECT model_run, scenario, "
    + ", ".join(f"round_even({x}, 3) AS {n}" for n, x in _f5.items())
    + " FROM events_hit GROUP BY 1, 2",
    "event_intensity_iter": "SELECT scenario, iteration, model_run, "
    + ", ".join(f"round({x}, 6) AS {n}" for n, x in _f5.items())
    + " FROM events_hit WHERE year <= 1998 GROUP BY 1, 2, 3",
    "stat_lines": _stat_lines("ts", TS_METRICS),
    "stat_lines_latest": _stat_lines(
        "ts", ["F_5", "SpawnBio", "Recruit_0"], "contains(model_run, '_OM') OR label = 2001"
    ),
    "stat_lines_dq": _stat_lines("dq", DQ_METRICS),
    "ratio_ribbon_f": _ribbon(_ratio_rows(FLEET_F, "F_3")),
    "ratio_ribbon_event_f": _ribbon(_ratio_rows(["F_5"])),
    "terminal_group": f"SELECT {K4}, years_until_terminal, CASE WHEN years_until_terminal <= 3 THEN '0-3' "
    "WHEN years_until_terminal <= 6 THEN '3-6' WHEN years_until_terminal > 6 THEN '6+' ELSE 'Other' END AS years_group "
    "FROM ts WHERE contains(model_run, '_EM') AND label = 2001 AND year >= 1996",
    "ratio_ribbon_biomass": _ribbon(_ratio_rows(BIOMASS, "retainB_3")),
    "ratio_ribbon_recruit_ssb": _ribbon(_ratio_rows(["Recruit_0", "SpawnBio"])),
    "ratio_ribbon_dq_f": f"SELECT scenario, year, round({_q_any('Value_F', 0.5)}, 4) AS median_ratio, "
    f"round({_q_any('Value_F', 0.25)}, 4) AS lower_quartile, round({_q_any('Value_F', 0.75)}, 4) AS upper_quartile "
    "FROM ratio_dq WHERE year >= 1996 AND label = 2001 GROUP BY 1, 2",
    "terminal_ribbon_f": _terminal(FLEET_F, "F_3"),
    "terminal_ribbon_event_f": _terminal(["F_5"]),
    "ratio_all_unfloored": f"SELECT {KL}, "
    + ", ".join(f"round({_ratio(f'{m}_em', f'{m}_om', '1.0')}, 6) AS {m}" for m in [*FLEET_F, *BIOMASS])
    + " FROM pair_ts",
    "terminal_ribbon_biomass": _terminal(BIOMASS, "retainB_3"),
    "terminal_ribbon_recruit_ssb": _terminal(["Recruit_0", "SpawnBio"]),
    "level_ribbon": f"SELECT scenario, year, variable, round({_q('value', 0.5)}, 6) AS median_value, "
    f"round({_q('value', 0.25)}, 6) AS lower_quartile, round({_q('value', 0.75)}, 6) AS upper_quartile, "
    "(scenario, year) IN (SELECT (scenario, year) FROM proj WHERE contains(model_run, '_OM') AND iteration = 1 "
    "AND F_5 > 0) AS is_event_year FROM ("
    + _long("proj", "scenario, year", [*FLEET_F, *BIOMASS, "Recruit_0", "SpawnBio"],
            where="contains(model_run, '_EM') AND NOT contains(model_run, 'init')")
    + ") GROUP BY 1, 2, 3",
    "event_year_match": "SELECT scenario, iteration, em_years, om_years, em_years = om_years AS is_equal FROM "
    "(SELECT scenario, iteration, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) "
    "FILTER (WHERE contains(model_run, '_EM')) AS em_years, "
    "string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) FILTER (WHERE contains(model_run, '_OM')) AS om_years "
    "FROM events_hit GROUP BY 1, 2)",
    "residual_sums": _residual_sums("TRUE"),
    "residual_sums_matched": _residual_sums("commercial IS NOT NULL"),
    "residual_share": "SELECT scenario, " + ", ".join(f"round({x}, 4) AS {n}" for n, x in _share.items()) + " FROM shares",
    "residual_mean_share": "SELECT scenario, "
    + ", ".join(f"round({x}, 4) AS {n}" for n, x in _mean_share.items()) + " FROM shares",
    "mean_t_interval": _t_limits(
        _long("residual", "scenario, year", ["commercial", "recreational", "event_dead"]), "scenario, year, variable"
    ),
    "mean_t_interval_by_design": _t_limits(
        _long(f"(SELECT *, {OM_CLASS} AS om_class, {EM_CLASS} AS em_class FROM "
              f"({_named('ape', NINE, 'retainB_', null_to='0', digits=None)}))",
              "om_class, em_class, year", ["ssb", "commercial", "recreational", "abundance"]),
        "om_class, em_class, year, variable",
    ),
    "iteration_mean": "SELECT scenario, type, iteration, round(mean_value, 6) AS mean_value, om_name, em_name FROM level_parsed",
    "reference_median": _reference("level_means", "scenario = 'rt_2_x_rt_2'"),
    "reference_median_bias": _reference("bias_means", "scenario = 'rt_2_x_rt_2' AND isfinite(mean_value)", digits=4),
    "reference_median_ratio": _reference("inverse_means", "scenario = 'rt_2_x_rt_2' AND isfinite(mean_value)", digits=4),
    "self_reference_median": _reference("level_parsed", "om_name = em_name", "type, em_name"),
    "iteration_mean_bias": f"SELECT scenario, type, iteration, round(mean_value, 4) AS mean_value, {PARSED} FROM bias_means",
    "iteration_mean_om_em": f"SELECT scenario, type, iteration, round(mean_value, 4) AS mean_value, {PARSED} FROM inverse_means",
    "boxplot_removals": _box("level_parsed", "type, em_name, om_name", "mean_value", 5),
    "boxplot_outliers": _outliers("re_long", "scenario, variable", "value"),
    "boxplot_relative_error": _box("re_long", "scenario, variable", "value"),
    "boxplot_unfished_recruits": _box("r0", "scenario", "r0"),
    "median_interval95": _interval(f"SELECT *, {PARSED} FROM truth", "om_name, em_name, year", "deadB_4"),
    "bias_interval95": _interval(
        f"SELECT * FROM ({_named('bias', ['ssb'], digits=None)}) WHERE year BETWEEN 1996 AND 2001",
        "scenario, year", "ssb", 5,
    ),
    "median_interval_with_samples": "SELECT om_name, em_name, year, med_val, low, high, 'summary' AS kind, "
    "CAST(NULL AS INTEGER) AS iteration, CAST(NULL AS DOUBLE) AS value FROM ("
    + _interval(f"SELECT *, {PARTS} FROM truth", "om_name, em_name, year", "deadB_4")
    + f") UNION ALL SELECT om_name, em_name, year, NULL, NULL, NULL, 'sample', iteration, round(deadB_4, 6) FROM "
    f"(SELECT *, {PARTS} FROM truth WHERE iteration BETWEEN 1 AND 5)",
    "event_year_levels": _box("chosen", "scenario, year, model_run", "F_5"),
    "event_histogram": "SELECT scenario, year, bin, n, round(bin_center, 6) AS bin_center, round(om_mean, 6) AS om_mean, "
    "round(em_mean, 6) AS em_mean FROM (SELECT scenario, year, CAST(b.bin AS INTEGER) AS bin, "
    "count(*) FILTER (WHERE h.own = b.bin) AS n, max(lo + b.bin * width) AS bin_center FROM (SELECT *, CAST(CASE WHEN "
    "width = 0 THEN 0 ELSE greatest(ceil((v - lo) / width + 0.5 - 1e-8) - 1, 0) END AS INTEGER) AS own FROM hist) h "
    "CROSS JOIN range(10) b(bin) WHERE width > 0 OR b.bin = 0 GROUP BY 1, 2, 3) LEFT JOIN (SELECT scenario, year, "
    "avg(F_5) FILTER (WHERE contains(model_run, '_OM')) AS om_mean, "
    "avg(F_5) FILTER (WHERE NOT contains(model_run, '_OM')) AS em_mean FROM ts WHERE year IN (1995, 1998, 2000) "
    "GROUP BY 1, 2) USING (scenario, year)",
    "event_magnitude": "SELECT scenario, n_years, round(F_5_sum, 4) AS F_5_sum, round(catch_sum, 4) AS catch_sum FROM "
    "(SELECT scenario, count(DISTINCT year) AS n_years FROM proj WHERE contains(model_run, '_OM') AND iteration = 1 "
    "AND F_5 > 0 GROUP BY 1) RIGHT JOIN (SELECT scenario, sum(F_5) AS F_5_sum, sum(deadB_5) AS catch_sum FROM proj "
    "WHERE contains(model_run, '_EM') AND NOT contains(model_run, 'init') GROUP BY 1) USING (scenario)",
    "compare_iterations": "SELECT scenario, iteration, "
    + ", ".join(
        f"round(max(x_{n}) FILTER (WHERE role = '{r}'), 6) AS {r}_{n}" for r in ("EM", "OM") for n in _f5
    )
    + f" FROM (SELECT scenario, iteration, {_role} AS role, "
    + ", ".join(f"{x} AS x_{n}" for n, x in _f5.items())
    + " FROM events_hit GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "compare_event_years": f"SELECT {K3}, round(max(F_5) FILTER (WHERE contains(model_run, '_EM')), 6) AS EM_F_5, "
    "round(max(F_5) FILTER (WHERE contains(model_run, '_OM')), 6) AS OM_F_5 FROM events_hit GROUP BY 1, 2, 3",
    "convergence_check": "SELECT scenario, iteration, model_run, nullif(regexp_extract(model_run, '\\d+'), '') "
    "AS model_run_year, round(max_grad, 6) AS max_grad, max_grad > 1 AS above_limit FROM scalar",
    "convergence_failures": "SELECT iteration, model_run, scenario FROM scalar WHERE max_grad > 1",
    "iteration_sums": f"SELECT scenario, type, iteration, round(s, 6) AS sum_value, {PARSED} FROM (SELECT scenario, type, "
    f"iteration, {_strict('sum', 'value')} AS s FROM level_long GROUP BY 1, 2, 3) WHERE type <> 'event' OR s > 0",
    "at_age_median": f"SELECT scenario, role, fleet, age, round({_q('n', 0.5)}, 6) AS median_n, "
    "scenario = 'rt_2_x_rt_2' AS is_highlighted FROM (SELECT *, CASE WHEN contains(run, '_OM') THEN 'OM' ELSE 'EM' END "
    "AS role FROM natage_long WHERE beg_mid = 'B' AND Yr = 1998 AND run IN ('base_OM', 'base_EM_2001')) "
    "GROUP BY 1, 2, 3, 4",
    "index_median": f"SELECT fleet_name, scenario, model, yr, series, round({_q('value', 0.5)}, 6) AS median_value "
    "FROM index_long GROUP BY 1, 2, 3, 4, 5",
    "index_median_zoomed": f"SELECT fleet_name, scenario, model, yr, series, round({_q('value', 0.5)}, 6) AS median_value "
    "FROM index_long WHERE fleet_name = 'click' AND yr BETWEEN 2 AND 10 GROUP BY 1, 2, 3, 4, 5",
    "ratio_by_design": f"SELECT om_class, em_class, scenario, year, variable, round({_q('value', 0.5)}, 4) AS median_ratio "
    "FROM (" + _long(f"(SELECT *, {OM_HIGH} AS om_class, {EM_HIGH} AS em_class FROM ratio_ts WHERE label = 2001)",
                     "om_class, em_class, scenario, year", ["SpawnBio", "Recruit_0", "SPRratio", "rec_dev"])
    + ") GROUP BY 1, 2, 3, 4, 5",
    # E
    "catch_se_plan": "SELECT yr, 1 AS seas, p.fleet AS fltsvy, round(se, 6) AS se FROM "
    "(SELECT DISTINCT fleet FROM plan_catch WHERE fleet IN (1, 2, 4)) p CROSS JOIN future LEFT JOIN "
    f"(SELECT fleet, {_strict('avg', 'catch_se')} AS se FROM plan_catch WHERE year > 1996 GROUP BY 1) o USING (fleet)",
    "index_plan": 'SELECT yr, 7 AS seas, i."index" AS fltsvy, round(se, 6) AS se FROM (SELECT "index", '
    'avg(se_log) FILTER (WHERE year > 1996) AS se FROM plan_index WHERE "index" IN '
    '(SELECT "index" FROM plan_index WHERE year > 1999) GROUP BY 1) i CROSS JOIN future',
    "discard_plan": "SELECT yr, 1 AS seas, fleet AS fltsvy FROM (SELECT DISTINCT fleet FROM plan_catch WHERE fleet <> 3) "
    "CROSS JOIN future",
    "length_plan": "SELECT yr, 7 AS seas, fltsvy, 0 AS sex, part, round(CASE WHEN part <> 1 AND yr = 2002 THEN "
    "coalesce(prov, m) ELSE m END, 6) AS nsamp FROM (SELECT fltsvy, part, count(*) AS k, avg(nsamp) AS m, "
    "max(nsamp) FILTER (WHERE yr = 2002) AS prov FROM comps WHERE yr > 1981 AND fltsvy IN (SELECT fltsvy FROM comps "
    "WHERE yr > 1999) GROUP BY 1, 2) CROSS JOIN future WHERE part IN (0, 2) OR "
    "(yr - 2002) % greatest(CAST(round_even(10.0::DOUBLE / k, 0) AS INTEGER), 1) = 0",
    "age_plan": "SELECT yr, seas, fltsvy, 1 AS sex, 2 AS part, 1 AS ageerr, -1 AS lbin_lo, -1 AS lbin_hi, "
    "round(m, 6) AS nsamp FROM (SELECT fltsvy, arg_min(seas, yr) FILTER (WHERE yr > 1999) AS seas, "
    "avg(nsamp) FILTER (WHERE yr > 1981) AS m FROM comps GROUP BY 1 HAVING max(yr) > 1999) CROSS JOIN future",
    "scenario_grid": "SELECT om, em, scenario, round(multiplier, 6) AS multiplier FROM grid",
    "regular_schedule": "SELECT yr, seas, fltsvy, CASE WHEN (yr - (SELECT min(yr) FROM template)) % 2 = 0 "
    "THEN 0.2 ELSE catch END AS catch FROM template",
    "random_schedule": "SELECT yr, seas, fltsvy, CASE WHEN yr IN (SELECT y FROM (SELECT unnest(range(min(yr), max(yr) + 1)) "
    "AS y FROM template) ORDER BY md5('12345|' || y), y LIMIT 3) THEN 0.2 ELSE catch END AS catch FROM template",
    "balanced_random_schedule": "SELECT * FROM (WITH its AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) + 1 AS iteration FROM lineitem), "
    "ny AS (SELECT count(*) AS y FROM template), "
    "slots AS (SELECT iteration, ((iteration - 1) * 2 + j) // y AS cycle, ((iteration - 1) * 2 + j) % y AS place "
    "FROM its CROSS JOIN range(2) r(j) CROSS JOIN ny), "
    "ranked AS (SELECT cycle, yr, y, row_number() OVER (PARTITION BY cycle ORDER BY md5('12345|tail|' || cycle || '|' || yr), yr) "
    "AS t, row_number() OVER (PARTITION BY cycle ORDER BY md5('12345|tail|' || (cycle - 1) || '|' || yr), yr) AS u "
    "FROM (SELECT DISTINCT cycle FROM slots) CROSS JOIN template CROSS JOIN ny), "
    "ordered AS (SELECT cycle, yr, row_number() OVER (PARTITION BY cycle ORDER BY CASE WHEN t <= (cycle + 1) * y % 2 THEN 2 "
    "WHEN u <= cycle * y % 2 THEN 1 ELSE 0 END, md5('12345|order|' || cycle || '|' || yr), yr) - 1 AS place FROM ranked), "
    "drawn AS (SELECT iteration, yr, 0.05 + 0.2 * (('0x' || substr(md5('12345|size|' || iteration || '|' || yr), 1, 12))::BIGINT "
    "/ 281474976710656.0::DOUBLE) AS raw FROM slots JOIN ordered USING (cycle, place)), "
    "sized AS (SELECT iteration, yr, raw * 0.1 * 2 / sum(raw) OVER (PARTITION BY iteration) AS size FROM drawn) "
    "SELECT CAST(iteration AS INTEGER) AS iteration, yr, seas, fltsvy, round(coalesce(size, catch), 6) AS catch "
    "FROM its CROSS JOIN template LEFT JOIN sized USING (iteration, yr))",
    "scaled_schedule": "SELECT scenario, yr, seas, fltsvy, side, round(CASE side WHEN 'OM' THEN c * multiplier ELSE c END, 6) "
    "AS catch, CASE side WHEN 'EM' THEN 0.01::DOUBLE END AS catch_se, CASE side WHEN 'EM' THEN 0 END AS fixed FROM "
    "(SELECT *, CASE WHEN (yr - (SELECT min(yr) FROM template)) % 3 = 0 THEN 0.1::DOUBLE ELSE catch END AS c FROM template) "
    "CROSS JOIN grid CROSS JOIN (VALUES ('OM'), ('EM')) s(side)",
    "scaled_random_schedule": "SELECT scenario, yr, seas, fltsvy, side, round(CASE side WHEN 'OM' THEN c * multiplier "
    "ELSE c END, 6) AS catch, CASE side WHEN 'EM' THEN 0.5::DOUBLE END AS catch_se, CASE side WHEN 'EM' THEN 1 END AS fixed "
    "FROM (SELECT *, CASE WHEN yr IN (SELECT y FROM (SELECT unnest(range(min(yr), max(yr) + 1)) AS y FROM template) "
    "ORDER BY md5('12345|' || y), y LIMIT 3) THEN 0.1::DOUBLE ELSE catch END AS c FROM template) "
    "CROSS JOIN grid CROSS JOIN (VALUES ('OM'), ('EM')) s(side)",
    "frequency_tables": "SELECT 'fleet_part' AS table_name, fltsvy::VARCHAR AS a, part::VARCHAR AS b, count(*) AS n "
    "FROM comps GROUP BY 1, 2, 3 UNION ALL SELECT 'season', seas::VARCHAR, '', count(*) FROM comps GROUP BY 1, 2, 3 "
    "UNION ALL SELECT 'fleet_se', fleet::VARCHAR, format('{:.3f}', round_even(catch_se, 3)), count(*) FROM plan_catch "
    "GROUP BY 1, 2, 3",
    "scenario_label": "SELECT CASE WHEN count(*) < 2 THEN max(scenario) ELSE "
    "array_to_string(list(scenario ORDER BY ordinal)[1:-2], ', ') || ', and ' || list(scenario ORDER BY ordinal)[-1] END "
    "AS label FROM scen JOIN dim USING (scenario)",
    # F
    "report_table": "SELECT scenario AS \"Scenario\", "
    + ", ".join(
        f'round_even({_share[c]}, 2) AS "{label}"'
        for c, label in {
            "share_commercial": "Commercial residual, % of true removals",
            "share_recreational": "Recreational residual, % of true removals",
            "share_event": "Event residual, % of true removals",
            "total_residual": "Residual of all removals per iteration",
            "share_total": "All residuals, % of true removals",
        }.items()
    )
    + " FROM shares",
    "write_summary_scalar": f"SELECT scenario, iteration, model_run, {_rounded(SCALAR_METRICS)} FROM scalar_raw",
}

BODIES["report_table_text"] = BODIES["report_table"]
ORACLE: dict[str, str] = {name: _shift_ties(_with(body)) for name, body in BODIES.items()}
