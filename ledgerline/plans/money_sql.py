"""DuckDB expressions of readable and exact figures, from the definitions of ``functions.fmt``."""

_SCALES = ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"))


def plain(v: str) -> str:
    return f"regexp_replace(regexp_replace(abs({v})::decimal(38,10)::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def grouped(v: str) -> str:
    return f"(format('{{:,}}', trunc(abs({v}))::hugeint) || CASE WHEN {plain(v)} LIKE '%.%' THEN '.' || split_part({plain(v)}, '.', 2) ELSE '' END)"


def exact(v: str, u: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || CASE WHEN coalesce(upper({u}) LIKE 'USD%', false) THEN '$' ELSE '' END || {grouped(v)})"


def _cents(v: str, scale: int = 1) -> str:
    """Hundredths of |v| / scale, half up, as a whole number."""
    add = "0.5" if scale == 1 else str(scale // 2)
    return f"(trunc(abs({v})::decimal(28,10) * 100 + {add})::hugeint // {scale}::hugeint)"


def _shown(c: str) -> str:
    return f"(({c} // 100)::varchar || '.' || lpad(({c} % 100)::varchar, 2, '0'))"


def money(v: str, u: str) -> str:
    m = f"abs({v})"
    sign = f"CASE WHEN {v} < 0 THEN '-' ELSE '' END"
    even = f"(trunc({m})::hugeint + CASE WHEN {m} - trunc({m}) > 0.5 OR ({m} - trunc({m}) = 0.5 AND trunc({m})::hugeint % 2 = 1) THEN 1 ELSE 0 END)"
    out = f"CASE WHEN {m} >= 1000 THEN {sign} || '$' || format('{{:,}}', {even}) ELSE {sign} || '$' || {_shown(_cents(v))} END"
    for i in range(len(_SCALES) - 1, -1, -1):
        step, name = _SCALES[i]
        text = f"{sign} || '$' || {_shown(_cents(v, step))} || ' {name}'"
        if i:
            up, upper = _SCALES[i - 1]
            text = f"CASE WHEN {_cents(v, step)} >= 100000 THEN {sign} || '$' || {_shown(_cents(v, up))} || ' {upper}' ELSE {text} END"
        out = f"CASE WHEN {m} >= {step} THEN {text} ELSE {out} END"
    rate = f"('$' || CASE WHEN {v} < 0 AND {_cents(v)} > 0 THEN '-' ELSE '' END || {_shown(_cents(v))} || ' per share')"
    return f"CASE WHEN contains({u}, '/') THEN {rate} WHEN coalesce(upper({u}) LIKE 'USD%', false) THEN {out} ELSE {exact(v, u)} END"


def value(v: str, u: str) -> str:
    return f"CASE WHEN {u} IS NULL OR {u} IN ('shares', 'pure', '') THEN {exact(v, u)} ELSE {money(v, u)} END"


def with_exact(v: str, u: str) -> str:
    return f"CASE WHEN contains({value(v, u)}, {exact(v, u)}) THEN {value(v, u)} ELSE {value(v, u)} || ' (' || {exact(v, u)} || ')' END"
