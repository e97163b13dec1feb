"""Scalar functions: for each name its overloads as (argument types, result type, Spark SQL).

``{0}``, ``{1}``... stand for arguments; one that is named twice is a column or literal, or cheap. Everything stays an
expression of Spark, so Catalyst sees it whole.
"""

from __future__ import annotations

Overload = tuple[tuple[str, ...], str, str]

#: White space that TRIM takes off, as a Spark SQL literal.
_BLANKS = r"' \t\n\r\f\u000b\u0085                 　'"
_NUMBERS = ("decimal", "double", "float", "long", "int", "short", "sbyte")
_INTEGERS = {"TO_BYTE": ("short", 0, 255), "TO_SBYTE": ("sbyte", None, None), "TO_INT16": ("short", None, None), "TO_UINT16": ("int", 0, 65535), "TO_INT32": ("int", None, None), "TO_UINT32": ("long", 0, 4294967295), "TO_INT64": ("long", None, None), "TO_UINT64": ("ulong", 0, None)}
_SQL = {"short": "SMALLINT", "sbyte": "TINYINT", "int": "INT", "long": "BIGINT", "ulong": "DECIMAL(20,0)"}


def soundex(x: str) -> str:
    """First letter and three digits; letters without a code don't part equal ones, and the first letter's code doesn't count."""
    digits = f"regexp_replace(translate(regexp_replace(substring(upper({x}), 2), '[^A-Z]', ''), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '111122222222334556'), '([1-6])\\\\1+', '$1')"
    return f"CASE WHEN {x} = '' THEN '0000' ELSE concat(substring(upper({x}), 1, 1), rpad(substring({digits}, 1, 3), 3, '0')) END"


def real_to_string(x: str) -> str:
    """The shortest digits that tell the number; with an exponent of two digits or more from 1E+15 on and below 1E-04."""
    shown = f"CAST({x} AS STRING)"
    plain = f"regexp_replace(CAST(CAST({shown} AS DECIMAL(38,22)) AS STRING), '(\\\\.\\\\d*?)0+$|\\\\.$', '$1')"
    plain = f"regexp_replace({plain}, '\\\\.$', '')"
    mantissa = f"regexp_replace(split_part({shown}, 'E', 1), '\\\\.0$', '')"
    exponent = f"CAST(split_part({shown}, 'E', 2) AS INT)"
    by_power = f"concat({mantissa}, 'E', if({exponent} < 0, '-', '+'), lpad(CAST(abs({exponent}) AS STRING), greatest(2, length(CAST(abs({exponent}) AS STRING))), '0'))"
    return f"CASE WHEN NOT contains({shown}, 'E') THEN regexp_replace({shown}, '\\\\.0$', '') WHEN abs({x}) >= 1e15D OR abs({x}) < 1e-4D THEN {by_power} ELSE {plain} END"


def to_string(x: str, kind: str) -> str:
    if kind == "bool":
        return f"CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' END"
    if kind in ("double", "float"):
        return real_to_string(x)
    if kind == "decimal":
        return f"regexp_replace(CAST({x} AS STRING), '(\\\\.\\\\d*?)0+$|\\\\.$', '$1')"
    return f"CAST({x} AS STRING)"


def _error(message: str) -> str:
    return f"raise_error('{message}')"


def _table() -> dict[str, list[Overload]]:
    out: dict[str, list[Overload]] = {}

    def add(name: str, args: tuple[str, ...], result: str, sql: str) -> None:
        out.setdefault(name, []).append((args, result, sql))

    for t in _NUMBERS:
        add("ABS", (t,), t, "abs({0})")
        add("SIGN", (t,), "int", "CAST(sign({0}) AS INT)")
    for name in ("ACOS", "ASIN", "ATAN", "COS", "COSH", "SIN", "SINH", "TAN", "TANH", "EXP", "SQRT"):
        add(name, ("double",), "double", name.lower() + "({0})")
    add("CEILING", ("double",), "double", "CAST(ceil({0}) AS DOUBLE)")
    add("FLOOR", ("double",), "double", "CAST(floor({0}) AS DOUBLE)")
    for t in ("double", "decimal"):
        add("ROUND", (t,), t, "CAST(round({0}) AS " + ("DOUBLE" if t == "double" else "DECIMAL(38,10)") + ")")
        add("ROUND", (t, "int"), t, "CAST(round({0}, {1}) AS " + ("DOUBLE" if t == "double" else "DECIMAL(38,10)") + ")")
    logs = "CASE WHEN {{0}} > 0D THEN {0} WHEN {{0}} = 0D THEN CAST('-Infinity' AS DOUBLE) WHEN {{0}} < 0D THEN CAST('NaN' AS DOUBLE) END"
    add("LOG", ("double",), "double", logs.format("ln({0})"))
    add("LOG", ("double", "double"), "double", logs.format("log({1}, {0})"))
    add("LOG10", ("double",), "double", logs.format("log10({0})"))
    add("POW", ("double", "double"), "double", "pow({0}, {1})")
    for name, (kind, low, high) in _INTEGERS.items():
        bounds = " OR ".join(f"{{0}} {op} {b}" for op, b in (("<", low), (">", high)) if b is not None)
        for t in _NUMBERS + ("string", "bool"):
            value = "bround({0})" if t in ("double", "float", "decimal") else "{0}"
            cast = f"CAST({value} AS {_SQL[kind]})"
            if bounds and t not in ("string", "bool"):
                cast = f"CASE WHEN {bounds} THEN {_error('The number is out of range.')} ELSE {cast} END"
            add(name, (t,), kind, cast)
    for t in _NUMBERS:
        add("TO_BOOLEAN", (t,), "bool", "({0} <> 0)")
        for name, kind in (("TO_DOUBLE", "double"), ("TO_SINGLE", "float"), ("TO_DECIMAL", "decimal")):
            add(name, (t,), kind, f"CAST({{0}} AS {kind.upper() if kind != 'decimal' else 'DECIMAL(38,10)'})")
    add("TO_BOOLEAN", ("bool",), "bool", "{0}")
    add("TO_BOOLEAN", ("string",), "bool", f"CASE WHEN lower(trim({{0}})) = 'true' THEN true WHEN lower(trim({{0}})) = 'false' THEN false WHEN {{0}} IS NOT NULL THEN {_error('The text is no truth value.')} END")
    for name, kind in (("TO_DOUBLE", "DOUBLE"), ("TO_SINGLE", "FLOAT"), ("TO_DECIMAL", "DECIMAL(38,10)")):
        add(name, ("string",), {"DOUBLE": "double", "FLOAT": "float"}.get(kind, "decimal"), f"CAST({{0}} AS {kind})")
    add("TO_CHAR", ("int",), "string", "chr({0})")
    add("TO_CHAR", ("string",), "string", f"CASE WHEN length({{0}}) = 1 THEN {{0}} WHEN {{0}} IS NOT NULL THEN {_error('The text must be one character long.')} END")
    forms = ", ".join(f"try_to_timestamp({{0}}, '{f}')" for f in ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy"))
    add("TO_DATETIME", ("string",), "datetime", f"CAST(CASE WHEN {{0}} IS NOT NULL THEN coalesce({forms}, {_error('The text is no date.')}) END AS TIMESTAMP_NTZ)")
    add("TO_DATETIME", ("datetime",), "datetime", "{0}")
    for t in ("string", "bool", *_NUMBERS, "datetime", "timespan", "object"):
        add("TO_STRING", (t,), "string", to_string("{0}", t))
    add("SOUNDEX", ("string",), "string", soundex("{0}"))
    add("LEN", ("string",), "int", "length({0})")
    add("CHARINDEX", ("string", "string"), "int", "CASE WHEN {0} = '' THEN 0 ELSE locate({0}, {1}) END")
    bad = _error("A start or length is negative.")
    add("SUBSTRING", ("string", "int"), "string", f"CASE WHEN {{1}} < 0 THEN {bad} WHEN {{1}} = 0 THEN if({{0}} IS NULL, NULL, '') ELSE substring({{0}}, {{1}}) END")
    add("SUBSTRING", ("string", "int", "int"), "string", f"CASE WHEN {{1}} < 0 OR {{2}} < 0 THEN {bad} WHEN {{1}} = 0 THEN if({{0}} IS NULL OR {{2}} IS NULL, NULL, '') ELSE substring({{0}}, {{1}}, {{2}}) END")
    add("UPPER", ("string",), "string", "upper({0})")
    add("LOWER", ("string",), "string", "lower({0})")
    add("TRIM", ("string",), "string", f"btrim({{0}}, {_BLANKS})")
    add("LTRIM", ("string",), "string", "ltrim(' \\t', {0})")
    add("RTRIM", ("string",), "string", "rtrim(' \\t', {0})")
    add("REPLACE", ("string", "string", "string"), "string", f"CASE WHEN {{1}} = '' THEN {_error('There is nothing to replace.')} ELSE replace({{0}}, {{1}}, {{2}}) END")
    add("REGEX_REPLACE", ("string", "string", "string"), "string", "regexp_replace({0}, {1}, {2})")
    add("REGEX_MATCH", ("string", "string"), "bool", "regexp_like({0}, {1})")
    add("REGEX_ESCAPE", ("string",), "string", r"""replace(replace(replace(replace(regexp_replace({0}, '([\\\\*+?|{{\\[()^$.# ])', '\\\\$1'), '\t', '\\t'), '\n', '\\n'), '\r', '\\r'), '\f', '\\f')""")
    add("REGEX_UNESCAPE", ("string",), "string", r"""regexp_replace(replace(replace(replace(replace({0}, '\\t', '\t'), '\\n', '\n'), '\\r', '\r'), '\\f', '\f'), '\\\\(.)', '$1')""")
    for t in ("double", "decimal", "long", "int"):
        add("FORMAT", (t, "string"), "string", _format_number("{0}", "{1}", t))
    add("FORMAT", ("datetime", "string"), "string", _format_date("{0}", "{1}"))
    add("REPLICATE", ("string", "int"), "string", f"CASE WHEN {{1}} < 0 THEN {_error('The count is negative.')} ELSE repeat({{0}}, {{1}}) END")
    add("REVERSE", ("string",), "string", "reverse({0})")
    for name in ("LEFT", "RIGHT"):
        add(name, ("string", "int"), "string", f"CASE WHEN {{1}} < 0 THEN {_error('The length is negative.')} ELSE {name.lower()}({{0}}, {{1}}) END")
    add("SPACE", ("int",), "string", "space({0})")
    for name in ("LPAD", "RPAD"):
        add(name, ("string", "int"), "string", name.lower() + "({0}, greatest(length({0}), {1}), ' ')")
    add("GETDATE", (), "datetime", "localtimestamp()")
    add("GETUTCDATE", (), "datetime", "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)")
    for name in ("DAY", "MONTH", "YEAR"):
        add(name, ("datetime",), "int", name.lower() + "({0})")
    return out


def _format_number(x: str, form: str, kind: str) -> str:
    """Standard numeric formats D, E, F, N, P and X with an optional count of digits, G and R without, and patterns of # and 0; others are errors."""
    digits = f"CAST(nullif(substring({form}, 2), '') AS INT)"
    whole = f"CAST(abs({x}) AS BIGINT)"
    power = f"regexp_replace(format_string(concat('%.', coalesce({digits}, 6), 'e'), CAST({x} AS DOUBLE)), '([+-])([0-9][0-9])$', '$10$2')"
    return (
        f"CASE WHEN {form} RLIKE '^[nN][0-9]*$' THEN format_number({x}, coalesce({digits}, 2)) WHEN {form} RLIKE '^[fF][0-9]*$' THEN replace(format_number({x}, coalesce({digits}, 2)), ',', '') "
        f"WHEN {form} RLIKE '^[pP][0-9]*$' THEN concat(format_number({x} * 100, coalesce({digits}, 2)), ' %') WHEN {form} RLIKE '^[dD][0-9]*$' THEN concat(if({x} < 0, '-', ''), lpad(CAST({whole} AS STRING), greatest(coalesce({digits}, 1), length(CAST({whole} AS STRING))), '0')) "
        f"WHEN {form} RLIKE '^x[0-9]*$' THEN lpad(lower(hex(CAST({x} AS BIGINT))), greatest(coalesce({digits}, 1), length(hex(CAST({x} AS BIGINT)))), '0') WHEN {form} RLIKE '^X[0-9]*$' THEN lpad(hex(CAST({x} AS BIGINT)), greatest(coalesce({digits}, 1), length(hex(CAST({x} AS BIGINT)))), '0') "
        f"WHEN {form} RLIKE '^E[0-9]*$' THEN upper({power}) WHEN {form} RLIKE '^e[0-9]*$' THEN {power} WHEN {form} IN ('', 'G', 'g', 'R', 'r') THEN {to_string(x, kind)} "
        f"WHEN {form} RLIKE '^[A-Za-z][0-9]*$' THEN {_error('The format is unknown, or depends on a currency.')} ELSE format_number({x}, {form}) END"
    )


#: The standard date formats of one letter, without a culture, as patterns of Spark.
_DATES = {
    "d": "MM/dd/yyyy", "D": "EEEE, dd MMMM yyyy", "f": "EEEE, dd MMMM yyyy HH:mm", "F": "EEEE, dd MMMM yyyy HH:mm:ss", "g": "MM/dd/yyyy HH:mm", "G": "MM/dd/yyyy HH:mm:ss",
    "m": "MMMM dd", "M": "MMMM dd", "o": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'", "O": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'", "r": "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "R": "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
    "s": "yyyy-MM-dd'T'HH:mm:ss", "t": "HH:mm", "T": "HH:mm:ss", "u": "yyyy-MM-dd HH:mm:ss'Z'", "y": "yyyy MMMM", "Y": "yyyy MMMM", "": "MM/dd/yyyy HH:mm:ss",
}


def _format_date(x: str, form: str) -> str:
    """Standard date formats and patterns; names of days, halves of the day and fractions are written otherwise in Spark."""
    pattern = f"replace(replace(replace({form}, 'dddd', 'EEEE'), 'ddd', 'EEE'), 'tt', 'a')"
    for n in range(6, 0, -1):
        pattern = f"replace({pattern}, '{'f' * n}', '{'S' * n}')"
    standard = " ".join(f"""WHEN '{k}' THEN "{v}" """ for k, v in _DATES.items())
    return f"CASE WHEN length({form}) = 1 AND NOT {form} IN ({', '.join(repr(k) for k in _DATES)}) THEN {_error('The format is unknown.')} ELSE date_format({x}, CASE {form} {standard} ELSE {pattern} END) END"


FUNCTIONS = _table()

#: Members of values: (type, NAME) -> (result type, Spark SQL); * is any type. Methods take arguments from {1} on.
PROPERTIES: dict[tuple[str, str], tuple[str, str]] = {
    ("string", "LENGTH"): ("int", "length({0})"),
    **{("datetime", n): ("int", f"{f}({{0}})") for n, f in (("YEAR", "year"), ("MONTH", "month"), ("DAY", "day"), ("HOUR", "hour"), ("MINUTE", "minute"), ("DAYOFYEAR", "dayofyear"))},
    ("datetime", "SECOND"): ("int", "CAST(second({0}) AS INT)"),
    ("datetime", "DATE"): ("datetime", "CAST(CAST({0} AS DATE) AS TIMESTAMP_NTZ)"),
    ("timespan", "DAYS"): ("int", "extract(DAY FROM {0})"),
    ("timespan", "HOURS"): ("int", "CAST(extract(HOUR FROM {0}) AS INT)"),
    ("timespan", "MINUTES"): ("int", "CAST(extract(MINUTE FROM {0}) AS INT)"),
}
METHODS: dict[tuple[str, str], list[Overload]] = {
    ("string", "TOUPPER"): [((), "string", "upper({0})")],
    ("string", "TOLOWER"): [((), "string", "lower({0})")],
    ("string", "TRIM"): [((), "string", f"btrim({{0}}, {_BLANKS})")],
    ("string", "SUBSTRING"): [(("int",), "string", "substring({0}, {1} + 1)"), (("int", "int"), "string", "substring({0}, {1} + 1, {2})")],
    ("string", "STARTSWITH"): [(("string",), "bool", "startswith({0}, {1})")],
    ("string", "ENDSWITH"): [(("string",), "bool", "endswith({0}, {1})")],
    ("string", "CONTAINS"): [(("string",), "bool", "contains({0}, {1})")],
    ("string", "INDEXOF"): [(("string",), "int", "locate({1}, {0}) - 1")],
    ("string", "REPLACE"): [(("string", "string"), "string", "replace({0}, {1}, {2})")],
    ("datetime", "ADDDAYS"): [(("double",), "datetime", "({0} + make_dt_interval(0, 0, 0, {1} * 86400))")],
    ("datetime", "ADDHOURS"): [(("double",), "datetime", "({0} + make_dt_interval(0, 0, 0, {1} * 3600))")],
    ("datetime", "ADDMONTHS"): [(("int",), "datetime", "({0} + make_ym_interval(0, {1}))")],
    ("datetime", "ADDYEARS"): [(("int",), "datetime", "({0} + make_ym_interval({1}, 0))")],
    **{(t, "TOSTRING"): [((), "string", to_string("{0}", t))] for t in ("string", "bool", "int", "long", "short", "sbyte", "double", "float", "decimal", "datetime")},
}
