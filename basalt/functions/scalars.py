"""Scalar functions whose semantics differ from Spark's, as templates of Spark SQL: name -> arity -> template.

`*` takes any number of arguments, joined by commas. Everything not listed has the same name and meaning in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TS = "try_cast({0} AS TIMESTAMP)"
_VEC = "aggregate(zip_with({0}, {1}, (x, y) -> {f}), CAST(0 AS DOUBLE), (acc, x) -> acc + x)"


def _vec(f: str) -> str:
    return _VEC.replace("{f}", f)


_DOT = _vec("CAST(x AS DOUBLE) * CAST(y AS DOUBLE)")
_L2 = f"sqrt({_vec('power(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)')})"
_NORM = "sqrt(aggregate({0}, CAST(0 AS DOUBLE), (acc, x) -> acc + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_TRUNC = "CASE WHEN {0} < 0 THEN ceil({0} * power(10, {1})) ELSE floor({0} * power(10, {1})) END / power(10, {1})"

#: Units of date arithmetic.
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")

TEMPLATES: dict[str, dict] = {
    # strings
    "concat": {"*": "concat_ws('', {*})"},
    "substring": {2: "substring({0}, greatest({1}, 1))", 3: "substring({0}, greatest({1}, 1), greatest({2}, 0))"},
    "substr": {2: "substring({0}, greatest({1}, 1))", 3: "substring({0}, greatest({1}, 1), greatest({2}, 0))"},
    "length": {1: "char_length({0})"},
    "strpos": {2: "instr({0}, {1})"},
    "lpad": {2: "lpad({0}, {1}, ' ')", 3: "lpad({0}, {1}, {2})"},
    "rpad": {2: "rpad({0}, {1}, ' ')", 3: "rpad({0}, {1}, {2})"},
    "char": {1: "CASE WHEN {0} BETWEEN 0 AND 127 THEN char({0}) WHEN {0} BETWEEN 128 AND 2047 THEN decode(unhex(concat(hex(192 + ({0} DIV 64)), hex(128 + ({0} % 64)))), 'UTF-8') WHEN {0} BETWEEN 2048 AND 65535 AND NOT ({0} BETWEEN 55296 AND 57343) THEN decode(unhex(concat(hex(224 + ({0} DIV 4096)), hex(128 + (({0} DIV 64) % 64)), hex(128 + ({0} % 64)))), 'UTF-8') WHEN {0} BETWEEN 65536 AND 1114111 THEN decode(unhex(concat(hex(240 + ({0} DIV 262144)), hex(128 + (({0} DIV 4096) % 64)), hex(128 + (({0} DIV 64) % 64)), hex(128 + ({0} % 64)))), 'UTF-8') END"},
    "collate": {2: "CASE upper({1}) WHEN 'NOCASE' THEN lower({0}) WHEN 'NOACCENT' THEN translate({0}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUY') ELSE {0} END"},
    # numbers
    "round": {1: "round(CAST({0} AS DOUBLE), 0)", 2: "round(CAST({0} AS DOUBLE), {1})"},
    "floor": {1: "CAST(floor({0}) AS DOUBLE)"},
    "ceil": {1: "CAST(ceil({0}) AS DOUBLE)"},
    "ceiling": {1: "CAST(ceil({0}) AS DOUBLE)"},
    "sqrt": {1: "CASE WHEN {0} >= 0 THEN sqrt({0}) END"},
    "log": {1: "CASE WHEN {0} > 0 THEN log10({0}) END", 2: "CASE WHEN {0} > 0 AND {0} <> 1 AND {1} > 0 THEN log({0}, {1}) END"},
    "sign": {1: "CAST(signum({0}) AS BIGINT)"},
    "truncate": {1: _TRUNC.replace("{1}", "0"), 2: _TRUNC},
    "trunc": {1: _TRUNC.replace("{1}", "0"), 2: _TRUNC},
    "random": {0: "rand()"},
    "int_div": {2: "CASE WHEN {1} = 0 THEN NULL ELSE {0} DIV {1} END"},
    "safe_div": {2: "try_divide({0}, {1})"},
    "safe_mod": {2: "try_mod({0}, {1})"},
    # dates
    "datediff": {2: "timestampdiff(DAY, {1}, {0})"},
    "date_diff": {2: "timestampdiff(DAY, {1}, {0})"},
    "date_add": {2: "timestampadd(DAY, {1}, {0})"},
    "date_sub": {2: "timestampadd(DAY, -({1}), {0})"},
    "current_date": {0: "date_trunc('day', current_timestamp())"},
    "current_time": {0: "date_format(current_timestamp(), 'HH:mm:ss')"},
    # conditions and types
    "iif": {3: "CASE WHEN {0} THEN {1} ELSE {2} END"},
    "typeof": {1: "CASE typeof({0}) WHEN 'bigint' THEN 'INTEGER' WHEN 'int' THEN 'INTEGER' WHEN 'smallint' THEN 'INTEGER' WHEN 'double' THEN 'FLOAT' WHEN 'float' THEN 'FLOAT' WHEN 'string' THEN 'TEXT' WHEN 'boolean' THEN 'BOOLEAN' WHEN 'timestamp' THEN 'TIMESTAMP' WHEN 'timestamp_ntz' THEN 'TIMESTAMP' WHEN 'void' THEN 'NULL' ELSE upper(typeof({0})) END"},
    "xor": {2: "(({0}) <> ({1}))"},
    # JSON as text
    "json_extract": {2: "get_json_object({0}, {1})"},
    "json_array_length": {1: "json_array_length({0})", 2: "json_array_length(get_json_object({0}, {1}))"},
    "json_valid": {1: "CAST(try_parse_json({0}) IS NOT NULL AS BIGINT)"},
    "json_keys": {1: "to_json(json_object_keys({0}))"},
    "json_type": {1: "CASE regexp_extract(schema_of_variant(try_parse_json({0})), '^[A-Z]+', 0) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VOID' THEN 'null' WHEN '' THEN NULL ELSE CASE WHEN try_parse_json({0}) IS NOT NULL THEN 'number' END END"},
    # vectors
    "vec_distance_l2": {2: _L2},
    "vec_distance_ip": {2: f"-({_DOT})"},
    "vec_distance_cosine": {2: f"CASE WHEN {_NORM} = 0 OR {_NORM.replace('{0}', '{1}')} = 0 THEN CAST(1 AS DOUBLE) ELSE greatest(1 - ({_DOT}) / ({_NORM} * {_NORM.replace('{0}', '{1}')}), CAST(0 AS DOUBLE)) END"},
    "vec_dims": {1: "size({0})"},
    "vec_norm": {1: _NORM},
    "vec_to_text": {1: "to_json({0})"},
    # aggregates
    "stddev": {1: "stddev_pop({0})"},
    "variance": {1: "var_pop({0})"},
    "group_concat": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"},
    "string_agg": {1: "listagg({0}, ',')", 2: "listagg({0}, {1})"},
    "array_agg": {1: "CASE WHEN count({0}) > 0 THEN to_json(collect_list({0})) END"},
    "safe_sum": {1: "sum(CASE WHEN typeof({0}) = 'string' THEN NULL ELSE try_cast({0} AS DOUBLE) END)"},
}
TEMPLATES["json_type"][2] = TEMPLATES["json_type"][1].replace("try_parse_json({0})", "try_variant_get(try_parse_json({0}), {1}, 'variant')")
TEMPLATES["json_typeof"] = TEMPLATES["json_type"]


def duration_seconds(text: str) -> float:
    """Seconds of a compound duration such as 1h30m, 1.5h or 250ms."""
    unit = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * unit[b] for a, b in parts)


def sql(name: str, *args: str) -> str:
    """Spark SQL of a call with the reference semantics; args are SQL texts."""
    low = name.lower()
    if low == "time_trunc" and len(args) == 2:
        us = round(duration_seconds(args[0].strip().strip("'")) * 1e6)
        at = f"unix_micros(CAST({args[1]} AS TIMESTAMP))"
        return f"timestamp_micros({at} - pmod({at}, {us}))"
    if low == "extract" and len(args) == 2:
        field = args[0].strip().strip("'").lower()
        if field == "epoch":
            return f"unix_timestamp(CAST({args[1]} AS TIMESTAMP))"
        if field == "dow":
            return f"(dayofweek({args[1]}) - 1)"
        if field == "isodow":
            return f"(weekday({args[1]}) + 1)"
        return f"CAST(extract({field} FROM {args[1]}) AS BIGINT)"
    if low in ("date_add", "date_sub") and len(args) == 3:
        sign = "-" if low == "date_sub" else ""
        return f"timestampadd({args[2].strip().strip(chr(39)).upper()}, {sign}({args[1]}), {args[0]})"
    if low == "json_array":  # each value for itself, as they may differ in type
        each = [f"substring(to_json(array({a})), 2, char_length(to_json(array({a}))) - 2)" for a in args]
        return "concat('[', concat_ws(',', " + ", ".join(each) + "), ']')" if each else "'[]'"
    if low == "json_object" and args and len(args) % 2 == 0:  # the last value of a key counts, null or not
        pairs = ", ".join(f"{k}, {v}" for k, v in {k.strip(): v for k, v in zip(args[::2], args[1::2], strict=True)}.items())
        return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))"
    if low == "to_char" and len(args) == 2 and (digits := re.fullmatch(r"'[90,]*(?:\.([90]*))?'", args[1].strip())):
        places = len(digits[1] or "")
        return f"format_number(CAST({args[0]} AS DOUBLE), {places})" if "," in args[1] else f"format_string('%.{places}f', CAST({args[0]} AS DOUBLE))"
    if low == "to_char" and len(args) == 2:
        return f"date_format({args[0]}, {to_char_format(args[1])})"
    forms = TEMPLATES.get(low, {})
    form = forms.get(len(args), forms.get("*"))
    if form is None:
        return f"{name}({', '.join(args)})"
    out = form.replace("{*}", ", ".join(args))
    return _fill(out, args)


def _fill(form: str, args: tuple) -> str:
    return "(" + re.sub(r"\{(\d)\}", lambda m: args[int(m[1])], form) + ")"


#: Tokens of TO_CHAR and what date_format calls them, replaced one after the other.
TO_CHAR = (("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DD", "dd"), ("DY", "E"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("PM", "a"))


def to_char_format(literal: str) -> str:
    return re.sub("|".join(a for a, _ in TO_CHAR), lambda m: dict(TO_CHAR)[m[0]], literal)


def glob_regex(pattern: str) -> str:
    """Regular expression of a GLOB pattern: * any run, ? any character, classes in brackets as they are; a backslash takes
    the meaning from *, ? and itself; the rest stands for itself."""
    means = {"*": ".*", "?": "."}
    each = re.findall(r"\\[*?\\]|\[[^\]]*\]?|.", pattern, re.S)
    return "(?s)^" + "".join(x if x[0] == "[" else re.escape(x[-1]) if len(x) == 2 else means.get(x, re.escape(x)) for x in each) + "$"


def call(name: str, *args: str) -> Column:
    return F.expr(sql(name, *args))


def glob(col: Column, pattern: str) -> Column:
    return col.rlike(glob_regex(pattern))
