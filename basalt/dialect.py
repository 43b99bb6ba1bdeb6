"""Forms of the dialect that Spark's grammar lacks or reads in another way.

reshape() works on tokens, before functions are rewritten. resolve() works on the Spark text afterwards, where
types or names decide: Spark's own parser says where an operator stands, its analyzer what it is applied to.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from .operators.subquery import condition

RANKS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST", "NTILE", "LEAD", "LAG"}
VALUES = {"FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"}
SETS = {"UNION", "INTERSECT", "EXCEPT"}
BEFORE = {"SELECT", "DISTINCT", "WHERE", "HAVING", "ON", "WHEN", "THEN", "ELSE", "CASE", "BY", "RETURNING", "SET", ",", ";"}
STOPS = BEFORE | {"AND", "OR", "XOR", "NOT", "FROM", "=>"}
AFTER = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "WINDOW", "OR", "XOR", "THEN", "ELSE", "WHEN", "END", "AS", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", ",", ";"} | SETS
#: Aggregates whose name alone differs.
AGGREGATES = {"STDDEV": "stddev_pop", "VARIANCE": "var_pop"}
#: Declared types and their storage.
TYPES = {"INTEGER": "BIGINT", "INT": "BIGINT", "SMALLINT": "BIGINT", "TINYINT": "BIGINT", "FLOAT": "DOUBLE", "REAL": "DOUBLE", "DECIMAL": "DOUBLE", "NUMERIC": "DOUBLE", "TEXT": "STRING", "VARCHAR": "STRING", "CHAR": "STRING", "CLOB": "STRING", "BLOB": "STRING", "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP", "JSON": "STRING", "JSONB": "STRING"}
FRAME = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|<=>|->>|->|<>|!=|<=|>=|\|\||\d+(?:\.\d+)?|[A-Za-z_][A-Za-z_0-9]*|\$\d+|\s+|.", re.S)


def tokenize(text: str) -> list[str]:
    return TOKEN.findall(text)


def blank(x: str) -> bool:
    return x.isspace() or x.startswith(("--", "/*"))


def after(t: list[str], i: int) -> int:
    i += 1
    while i < len(t) and blank(t[i]):
        i += 1
    return i


def before(t: list[str], i: int) -> int:
    i -= 1
    while i >= 0 and blank(t[i]):
        i -= 1
    return i


def closing(t: list[str], i: int) -> int:
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] in "([") - (t[j] in ")]")
        if not depth:
            return j
    raise ValueError("unbalanced parentheses")


def opening(t: list[str], i: int) -> int:
    depth = 0
    for j in range(i, -1, -1):
        depth += (t[j] in ")]") - (t[j] in "([")
        if not depth:
            return j
    raise ValueError("unbalanced parentheses")


def top(t: list[str]) -> list[int]:
    """Places outside of all parentheses."""
    out, i = [], 0
    while i < len(t):
        out.append(i)
        i = closing(t, i) + 1 if t[i] in ("(", "[") else i + 1
    return out


def deep(t: list[str], change: Callable) -> list[str]:
    """Apply a change to the contents of all parentheses, innermost first, then to the whole."""
    out, i = [], 0
    while i < len(t):
        if t[i] == "(":
            k = closing(t, i)
            out += ["(", *deep(t[i + 1 : k], change), ")"]
            i = k + 1
        else:
            out.append(t[i])
            i += 1
    return change(out)


def operand(x: str) -> bool:
    return bool(re.match(r"[\w'\"`$)\]]", x[:1])) and x.upper() not in BEFORE | AFTER | {"AND", "NOT"}


def set_order(t: list[str]) -> list[str]:
    """EXCEPT, like INTERSECT, binds tighter than a UNION before it."""
    level = top(t)
    ops = [i for i in level if t[i].upper() in SETS and t[before(t, i)] != "*"]
    if not any(t[a].upper() == "UNION" and any(t[b].upper() == "EXCEPT" for b in ops[n + 1 :]) for n, a in enumerate(ops)):
        return t
    end = next((i for i in level if i > ops[-1] and t[i].upper() in ("ORDER", "LIMIT", "OFFSET", "FETCH", ";")), len(t))
    unions = [i for i in ops if t[i].upper() == "UNION"]
    out = list(t)
    for a, b in reversed(list(zip(unions, unions[1:] + [end]))):
        if any(a < i < b and t[i].upper() == "EXCEPT" for i in ops):
            start = after(t, a)
            start = after(t, start) if t[start].upper() in ("ALL", "DISTINCT") else start
            out[start:b] = ["(", *out[start:b], ")", " "]
    return out


def left_of(t: list[str], at: int, stops: set[str]) -> int:
    """Where the operand that ends before t[at] begins."""
    cases = 0
    for i in reversed([i for i in top(t[:at]) if i < at]):
        up = t[i].upper()
        cases += (up == "END") - (up == "CASE" and cases > 0)
        if not cases and up in stops and not (up == "CASE" and "END" in [x.upper() for x in t[i:at]]):
            return i + 1
    return 0


def quantified(t: list[str]) -> list[str]:
    """x op ALL|ANY|SOME (query) by one row of facts about the query's values; x IN () is false, x NOT IN () true."""
    i = 0
    while i < len(t):
        up, j = t[i].upper(), after(t, i)
        if j >= len(t) or t[j] != "(":
            i += 1
            continue
        k, p = closing(t, j), before(t, i)
        inner = "".join(t[j + 1 : k])
        if up == "IN" and not inner.strip() and p >= 0:
            negated = t[p].upper() == "NOT"
            start = left_of(t, p if negated else i, STOPS)
            t = t[:start] + [" ", str(negated).upper()] + t[k + 1 :]
            i = start + 1
        elif up in ("ALL", "ANY", "SOME") and p >= 0 and t[p] in ("=", "<>", "!=", "<", "<=", ">", ">=") and re.match(r"\s*(SELECT|WITH|VALUES)\b", inner, re.I):
            start = left_of(t, p, STOPS)
            left, op, kind = "".join(t[start:p]).strip(), t[p], "ALL" if up == "ALL" else "ANY"
            if (op, kind) == ("=", "ANY"):
                new = f"{left} IN ({inner})"
            elif kind == "ALL" and op in ("<>", "!="):
                new = f"{left} NOT IN ({inner})"
            else:
                fact = lambda x: f"(SELECT {x} FROM ({inner}) AS _q(_v))"  # noqa: B023, E731
                new = "(" + condition(left, op, kind, *map(fact, ("count(*)", "count(_v)", "min(_v)", "max(_v)"))) + ")"
            t = t[:start] + [" ", *tokenize(new), " "] + t[k + 1 :]
            i = start + 1
        else:
            i += 1
    return t


def infix_xor(t: list[str]) -> list[str]:
    """a XOR b with the precedence of OR, from the left."""
    while True:
        level = top(t)
        at = next((i for i in level if t[i].upper() == "XOR" and before(t, i) >= 0 and operand(t[before(t, i)])), None)
        if at is None:
            return t
        start = left_of(t, at, BEFORE)
        cases, end = 0, len(t)
        for i in (i for i in level if i > at):
            up = t[i].upper()
            if not cases and up in AFTER:
                end = i
                break
            cases += (up == "CASE") - (up == "END")
        left, right = "".join(t[start:at]).strip(), "".join(t[at + 1 : end]).strip()
        t = t[:start] + [" "] + ["(", "(", left, ")", " <> ", "(", right, ")", ")", " "] + t[end:]


def json_access(t: list[str]) -> list[str]:
    """v -> 'k' and v['k'] give JSON, v ->> 'k' text; integers count elements."""
    i = 0
    while i < len(t):
        arrow, index = t[i] in ("->", "->>"), t[i] == "["
        p = before(t, i)
        if (arrow or index) and p >= 0 and operand(t[p]) and not (index and t[p].upper() == "ARRAY"):
            k = after(t, i)
            stop = k if arrow else closing(t, i)
            key = t[k] if arrow else "".join(t[i + 1 : stop]).strip()
            if re.fullmatch(r"'(?:[^']|'')*'|\d+", key):
                start = opening(t, p) if t[p] in ")]" else p
                if t[p] == ")" and start and re.match(r"\w+$", t[start - 1]) and t[start - 1].upper() not in BEFORE | AFTER | {"AND", "NOT"}:
                    start -= 1
                while start > 1 and t[start - 1] == ".":
                    start -= 2
                value, name = "".join(t[start : p + 1]), key[1:-1].replace("''", "'")
                path = f"'$[{key}]'" if key.isdigit() else f"'$.{name}'" if re.fullmatch(r"\w+", name) else "'$[" + '"' + name.replace("'", "''") + '"' + "]'"
                got = f"get_json_object({value}, {path})" if t[i] == "->>" else f"to_json(try_variant_get(try_parse_json({value}), {path}, 'variant'))"
                t = t[:start] + [got] + t[stop + 1 :]
                i = start
        i += 1
    return t


def _order(parts: list[list[str]]) -> list[tuple[str, bool]]:
    out = []
    for p in parts:
        text = re.sub(r"\s+NULLS\s+(FIRST|LAST)\s*$", "", "".join(p).strip(), flags=re.I)
        m = re.match(r"(.*?)\s+(ASC|DESC)$", text, re.I | re.S)
        out.append((m[1], m[2].upper() == "DESC") if m else (text, False))
    return out


def commas(t: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    level = set(top(t))
    for i, x in enumerate(t):
        if x == "," and i in level:
            out.append([])
        else:
            out[-1].append(x)
    return out


def aggregates(t: list[str]) -> list[str]:
    """Other names, and ORDER BY within STRING_AGG, GROUP_CONCAT and ARRAY_AGG."""
    i = 0
    while i < len(t):
        up, j = t[i].upper(), after(t, i)
        if j < len(t) and t[j] == "(" and up in AGGREGATES:
            t[i] = AGGREGATES[up]
        elif j < len(t) and t[j] == "(" and up in ("FIRST", "LAST") and (before(t, i) < 0 or t[before(t, i)].upper() not in ("NULLS", "FETCH")):
            k = closing(t, j)
            inner = t[j + 1 : k]
            at = next((n for n in top(inner) if inner[n].upper() == "ORDER"), None)
            if at is None:
                t = t[:i] + [f"{t[i]}({''.join(inner).strip()}, true)"] + t[k + 1 :]
            else:
                value = "".join(inner[:at]).strip()
                keys = _order(commas(inner[after(inner, after(inner, at)) :]))
                end, cond = _filter(t, k)
                kept = f"FILTER (WHERE {value} IS NOT NULL{cond})"
                if len({down for _, down in keys}) == 1:  # the least or greatest of all keys; nulls are the greatest
                    by = keys[0][0] if len(keys) == 1 else "struct(" + ", ".join(f"{e} IS NULL, {e}" for e, _ in keys) + ")"
                    new = f"{'max' if keys[0][1] == (up == 'FIRST') else 'min'}_by({value}, {by}) {kept}"
                else:
                    fields = ", ".join(f"'k{n}', {e}" for n, (e, _) in enumerate(keys))
                    best = f"array_sort(collect_list(named_struct({fields}, 'v', {value})) {kept}, (_a, _b) -> {_comparison(keys)})"
                    new = f"try_element_at({best}, {1 if up == 'FIRST' else -1}).v"
                t = t[:i] + [new] + t[end + 1 :]
        elif j < len(t) and t[j] == "(" and up in ("STRING_AGG", "GROUP_CONCAT", "ARRAY_AGG"):
            k = closing(t, j)
            inner = t[j + 1 : k]
            at = next((n for n in top(inner) if inner[n].upper() == "ORDER"), None)
            if at is not None:
                args = ["".join(a).strip() for a in commas(inner[:at])]
                by = commas(inner[after(inner, after(inner, at)) :])
                if up == "ARRAY_AGG":
                    keys = _order(by)
                    compare = _comparison(keys)
                    fields = ", ".join(f"'k{n}', {e}" for n, (e, _) in enumerate(keys))
                    k, cond = _filter(t, k)
                    rows = f"collect_list(named_struct({fields}, 'v', {args[0]})) FILTER (WHERE {args[0]} IS NOT NULL{cond})"
                    new = f"CASE WHEN size({rows}) > 0 THEN to_json(transform(array_sort({rows}, (_a, _b) -> {compare}), _e -> _e.v)) END"
                else:
                    sep = args[1] if len(args) > 1 else "','"
                    new = f"listagg({args[0]}, {sep}) WITHIN GROUP (ORDER BY {'' .join(','.join(''.join(b) for b in by))})"
                t = t[:i] + [new] + t[k + 1 :]
            elif up == "ARRAY_AGG":
                end, cond = _filter(t, k)
                if cond:
                    value = "".join(inner).strip()
                    rows = f"collect_list({value}) FILTER (WHERE {value} IS NOT NULL{cond})"
                    t = t[:i] + [f"CASE WHEN size({rows}) > 0 THEN to_json({rows}) END"] + t[end + 1 :]
            elif (once := re.match(r"\s*DISTINCT\s+(.*)$", "".join(inner), re.I | re.S)):
                value, *sep = ["".join(a).strip() for a in commas(tokenize(once[1]))]
                k, cond = _filter(t, k)
                values = f"collect_set({value}) FILTER (WHERE {value} IS NOT NULL{cond})"
                t = t[:i] + [f"CASE WHEN size({values}) > 0 THEN array_join(transform(array_sort({values}), _v -> CAST(_v AS STRING)), {sep[0] if sep else chr(39) + ',' + chr(39)}) END"] + t[k + 1 :]
        i += 1
    return t


def _comparison(keys: list[tuple[str, bool]]) -> str:
    """-1, 0 or 1 for structs _a and _b by their fields k0, k1, ...; a null is the greatest."""
    out = "0"
    for n, (_, down) in reversed(list(enumerate(keys))):
        low, high = ("1", "-1") if down else ("-1", "1")
        a, b = f"_a.k{n}", f"_b.k{n}"
        out = f"CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN {out} WHEN {a} IS NULL THEN {high} WHEN {b} IS NULL THEN {low} WHEN {a} < {b} THEN {low} ELSE {high} END"
    return out


def tuples(t: list[str]) -> list[str]:
    """(a, b) [NOT] IN ((x, y), ...) as comparisons, so that each place has a type of its own."""
    i = 0
    while i < len(t):
        j, p = after(t, i), before(t, i)
        if t[i].upper() != "IN" or j >= len(t) or t[j] != "(" or p < 0:
            i += 1
            continue
        negated = t[p].upper() == "NOT"
        right = before(t, p) if negated else p
        k = closing(t, j)
        rows = [["".join(x).strip() for x in [row]][0] for row in commas(t[j + 1 : k])]
        if right < 0 or t[right] != ")" or not all(r.startswith("(") and r.endswith(")") for r in rows):
            i += 1
            continue
        left = opening(t, right)
        head = before(t, left)
        names = ["".join(x).strip() for x in commas(t[left + 1 : right])]
        if len(names) < 2 or (head >= 0 and re.match(r"\w+$", t[head]) and t[head].upper() not in STOPS):
            i += 1
            continue
        values = [["".join(x).strip() for x in commas(tokenize(r[1:-1]))] for r in rows]
        if any(len(v) != len(names) for v in values):
            raise ValueError("rows of IN have another number of values")
        each = " OR ".join("(" + " AND ".join(f"{a} = {b}" for a, b in zip(names, v, strict=True)) + ")" for v in values)
        t = t[:left] + tokenize(f"{'NOT ' if negated else ''}({each})") + t[k + 1 :]
        i = left + 1
    return t


def _filter(t: list[str], k: int) -> tuple[int, str]:
    """(end, condition) of a FILTER (WHERE ...) behind the call that ends at k, as a further condition; (k, "") without."""
    f = after(t, k)
    if f < len(t) and t[f].upper() == "FILTER" and t[after(t, f)] == "(":
        end = closing(t, after(t, f))
        return end, f" AND ({re.sub(r'^' + chr(92) + 's*WHERE' + chr(92) + 'b', '', ''.join(t[after(t, f) + 1 : end]), flags=re.I).strip()})"
    return k, ""


def _named_windows(t: list[str]) -> dict[str, list[str]]:
    out = {}
    for i, x in enumerate(t):
        if x.upper() == "WINDOW":
            j = after(t, i)
            while j < len(t) and after(t, j) < len(t) and t[after(t, j)].upper() == "AS" and t[after(t, after(t, j))] == "(":
                a = after(t, after(t, j))
                b = closing(t, a)
                out[t[j].upper()] = t[a + 1 : b]
                j = after(t, b)
                if j >= len(t) or t[j] != ",":
                    break
                j = after(t, j)
    return out


def frames(t: list[str], named: dict[str, list[str]]) -> list[str]:
    """An ordered window without a frame runs over rows; one without an order is the whole partition."""
    i = 0
    while i < len(t):
        j = after(t, i)
        if t[i].upper() != "OVER" or j >= len(t) or not (t[j] == "(" or t[j].upper() in named):
            i += 1
            continue
        end = closing(t, j) if t[j] == "(" else j
        body = t[j + 1 : end] if t[j] == "(" else list(named[t[j].upper()])
        p = before(t, i)
        while p >= 0 and t[p].upper() in ("NULLS", "IGNORE", "RESPECT"):
            p = before(t, p)
        if p < 0 or t[p] != ")":
            i += 1
            continue
        close, open_ = p, opening(t, p)
        f = before(t, open_)
        condition = ""
        if t[f].upper() == "FILTER":
            condition = " FILTER " + "".join(t[open_ : close + 1])
            close = before(t, f)
            open_ = opening(t, close)
            f = before(t, open_)
        name = t[f].upper()
        marks = {body[n].upper(): n for n in reversed(top(body))}
        frame = marks.get("ROWS", marks.get("RANGE"))
        if name in RANKS and "ORDER" not in marks:
            body = [*body[:frame], " ORDER BY NULL "]  # all rows are peers, in the order they come
        elif name not in RANKS:
            if frame is not None and "ORDER" not in marks and name not in VALUES:
                body = body[:frame]
            elif frame is None and "ORDER" in marks:
                body = [*body, FRAME]
            elif frame is not None and name in VALUES:
                body[frame] = "ROWS"
        over = " OVER (" + "".join(body) + ")"
        args = "".join(t[open_ + 1 : close]).strip()
        distinct = re.match(r"DISTINCT\s+(.*)$", args, re.I | re.S)
        if distinct or name == "ARRAY_AGG":
            x = distinct[1] if distinct else args
            values = f"collect_set({x}){condition}{over}"
            total = f"aggregate(slice({values}, 2, greatest(size({values}) - 1, 0)), try_element_at({values}, 1), (_s, _v) -> _s + _v)"
            new = {"COUNT": f"CAST(size({values}) AS BIGINT)", "SUM": total, "AVG": f"try_divide(CAST({total} AS DOUBLE), size({values}))", "ARRAY_AGG": f"to_json({values.replace('collect_set', 'collect_list', 1)})"}.get(name, f"{t[f]}({x}){condition}{over}")
            t = t[:f] + [new] + t[end + 1 :]
            i = f + 1
        else:
            t = t[:i] + [over.strip()] + t[end + 1 :]
            i += 1
    return t


def as_of(t: list[str], histories: dict[str, dict]) -> list[str]:
    """name AS OF TIMESTAMP x | TRANSACTION n, over the registered history of that name."""
    i = 0
    while i < len(t):
        h = histories.get(t[i].lower())
        a = after(t, i)
        o = after(t, a)
        w = after(t, o)
        if not (h and w < len(t) and t[a].upper() == "AS" and t[o].upper() == "OF" and t[w].upper() in ("TIMESTAMP", "TRANSACTION")):
            i += 1
            continue
        x = after(t, w)
        end = closing(t, x) if t[x] == "(" else x
        column = h["timestamp"] if t[w].upper() == "TIMESTAMP" else h["transaction"]
        value = "".join(t[x : end + 1])
        value = f"CAST({value} AS TIMESTAMP)" if t[w].upper() == "TIMESTAMP" else value
        keys = ", ".join(h["key"])
        rows = f"(SELECT * EXCEPT (_version) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {column} DESC, {h['transaction']} DESC) AS _version FROM {h['view']} WHERE {column} <= {value}) AS _h WHERE _version = 1 AND NOT coalesce({h['deleted']}, false))"
        n = after(t, end)
        n = after(t, n) if n < len(t) and t[n].upper() == "AS" else n
        named = n < len(t) and re.match(r"[A-Za-z_]\w*$", t[n]) and t[n].upper() not in AFTER | {"ON", "USING"}
        t = t[:i] + [rows] + ([] if named else [" AS ", t[i]]) + t[end + 1 :]
        i += 1
    return t


def recursion(t: list[str]) -> dict | None:
    """The first recursive CTE of a statement, if it has several recursive members: name, columns, anchor, members, rest."""
    i = after(t, -1)
    if i >= len(t) or t[i].upper() != "WITH" or t[after(t, i)].upper() != "RECURSIVE":
        return None
    name = after(t, after(t, i))
    a = after(t, name)
    columns = []
    if t[a] == "(":
        end = closing(t, a)
        columns = ["".join(c).strip() for c in commas(t[a + 1 : end])]
        a = after(t, end)
    body = after(t, a)
    if t[a].upper() != "AS" or t[body] != "(":
        return None
    end = closing(t, body)
    inner = t[body + 1 : end]
    cuts = [n for n in top(inner) if inner[n].upper() == "UNION"]
    if len(cuts) < 2 or any(inner[after(inner, n)].upper() != "ALL" for n in cuts) or any(inner[n].upper() in ("INTERSECT", "EXCEPT") for n in top(inner)):
        return None
    parts = [inner[: cuts[0]]] + [inner[after(inner, x) + 1 : y] for x, y in zip(cuts, cuts[1:] + [len(inner)], strict=True)]
    if any(t[name].lower() not in (x.lower() for x in p) for p in parts[1:]):
        return None
    comma = after(t, end)
    more = comma < len(t) and t[comma] == ","
    rest = ["WITH RECURSIVE ", *t[comma + 1 :]] if more else t[end + 1 :]
    return {"name": t[name], "columns": columns, "anchor": "".join(parts[0]), "members": ["".join(p) for p in parts[1:]], "rest": "".join(rest)}


def reshape(t: list[str], histories: dict[str, dict] | None = None) -> list[str]:
    upper = {x.upper() for x in t}
    if histories and "OF" in upper:
        t = as_of(t, histories)
    if upper & {"->", "->>", "["}:
        t = deep(t, json_access)
    if "IN" in upper and re.search(r"\)\s*(NOT\s+)?IN\s*\(\s*\(", "".join(t), re.I):
        t = deep(t, tuples)
    if upper & {"ALL", "ANY", "SOME"} or re.search(r"\bIN\s*\(\s*\)", "".join(t), re.I):
        t = deep(t, quantified)
    if "XOR" in upper:
        t = deep(t, infix_xor)
    if upper & ({"STRING_AGG", "GROUP_CONCAT", "ARRAY_AGG", "FIRST", "LAST"} | set(AGGREGATES)):
        t = deep(t, aggregates)
    if "OVER" in upper:
        named = _named_windows(t)
        t = deep(t, lambda x: frames(x, named))
    if {"UNION", "EXCEPT"} <= upper:
        t = deep(t, set_order)
    return t


# --- where types decide ---------------------------------------------------------------------------


def _walk(plan, text: str):
    """(node, class, start, end) of all plans and expressions that stand in this text."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        origin = node.origin()
        a, b, of = origin.startIndex(), origin.stopIndex(), origin.sqlText()
        if a.isDefined() and b.isDefined() and (not of.isDefined() or of.get() == text):
            yield node, kind, a.get(), b.get() + 1
        groups = [node.children(), node.innerChildren()]
        if ".catalyst.expressions." not in node.getClass().getName():
            try:
                groups.append(node.expressions())
            except Py4JError:  # an expression
                pass
        for g in groups:
            it = g.iterator()
            while it.hasNext():
                x = it.next()
                if hasattr(x, "origin"):
                    todo.append(x)


def _integral(child, a: int, b: int) -> bool:
    """Whether an operand is of an integer type, below the cast that the division itself adds."""
    try:
        if child.getClass().getSimpleName() == "Cast":
            o = child.origin()
            if o.startIndex().isDefined() and (o.startIndex().get(), o.stopIndex().get() + 1) == (a, b):
                child = child.child()
        return child.dataType().typeName() in ("byte", "short", "integer", "long")
    except Py4JError:
        return False


def _type(child) -> str:
    try:
        return child.dataType().typeName()
    except Py4JError:
        return ""


def _interval(left: str, right: str) -> str:
    """Difference of two timestamps as text: [-][n days ]HH:MM:SS."""
    s = f"((unix_micros(CAST({left} AS TIMESTAMP)) - unix_micros(CAST({right} AS TIMESTAMP))) DIV 1000000)"
    part = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    return f"concat(CASE WHEN {s} < 0 THEN '-' ELSE '' END, CASE WHEN abs({s}) >= 86400 THEN CAST(abs({s}) DIV 86400 AS STRING) || ' days ' ELSE '' END, {part(f'mod(abs({s}), 86400) DIV 3600')}, ':', {part(f'mod(abs({s}), 3600) DIV 60')}, ':', {part(f'mod(abs({s}), 60)')})"


def _changes(spark: SparkSession, text: str) -> list[tuple[int, int, str]]:
    state = spark._jsparkSession.sessionState()
    parsed = state.sqlParser().parsePlan(text)
    analyzed = state.analyzer().execute(parsed)
    done = analyzed.resolved()
    if done and not re.search(r"[/%]", text) and "SubtractTimestamps" not in analyzed.toJSON():
        return []
    places, aliases, out = {}, [], []
    for node, kind, a, b in _walk(parsed, text):
        if kind in ("Divide", "Remainder", "Add", "Subtract"):
            cut = node.left().origin().stopIndex().get() + 1
            symbol = {"Divide": "/", "Remainder": "%", "Add": "+", "Subtract": "-"}[kind]
            while cut < b and text[cut] != symbol:
                cut += 1
            places[a, b] = (kind, text[a:cut].strip(), text[cut + 1 : b].strip())
        elif kind == "Alias" and not done:
            aliases.append((node.name().lower(), re.sub(r"(\s+AS)?\s+[`\"]?\w+[`\"]?$", "", text[a:b], flags=re.I)))
    for node, kind, a, b in _walk(analyzed, text):
        op = places.get((a, b))
        if op and done and op[0] == "Divide" and kind == "Divide":
            both = _integral(node.left(), a, b) and _integral(node.right(), a, b)
            out.append((a, b, f"CASE WHEN {op[2]} = 0 THEN NULL ELSE {op[1]} DIV {op[2]} END" if both else f"try_divide({op[1]}, {op[2]})"))
        elif op and done and op[0] == "Remainder" and kind == "Remainder":
            out.append((a, b, f"try_mod({op[1]}, {op[2]})"))
        elif op and op[0] == "Subtract" and kind in ("SubtractTimestamps", "SubtractDates"):
            days = _integral(node.right(), a, b)
            out.append((a, b, f"timestampadd(DAY, -({op[2]}), {op[1]})" if days else _interval(op[1], op[2])))
        elif op and not done and kind in ("Add", "Subtract") and op[0] == kind and _type(node.left()).startswith("timestamp") and _type(node.right()) in ("byte", "short", "integer", "long"):
            out.append((a, b, f"timestampadd(DAY, {'-' if kind == 'Subtract' else ''}({op[2]}), {op[1]})"))
        elif kind == "Filter" and not done:
            names = dict(aliases)
            for x, k, c, d in _walk(node.condition(), text):
                if k == "UnresolvedAttribute" and (body := names.get(text[c:d].strip("`\"").lower())):
                    out.append((c, d, f"({body})"))
    inner = []
    for a, b, new in sorted(set(out), key=lambda x: (x[1] - x[0], x[0])):
        if all(b <= c or d <= a for c, d, _ in inner):
            inner.append((a, b, new))
    return inner


def resolve(spark: SparkSession, text: str) -> str:
    """Division, remainder, arithmetic of timestamps, and aliases in WHERE, innermost first.

    Integers divide to integers, a zero divisor gives null, a timestamp plus n is n days later, the difference of
    two timestamps is a text. What the analyzer can't place stays as it is.
    """
    for _ in range(32):
        found = _changes(spark, text)
        if not found:
            break
        for a, b, new in sorted(found, reverse=True):
            text = text[:a] + new + text[b:]
    return text
