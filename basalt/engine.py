"""SQL in the reference's dialect, rewritten to Spark SQL."""

from __future__ import annotations

import datetime
import functools
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialect
from .dialect import TYPES
from .functions import scalars
from .operators.explain import explain
from .operators.recursive import recurse
from .operators.store import Store

ENDS = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "UNION", "EXCEPT", "INTERSECT", "WINDOW", ";"}
SPECIAL = {"time_trunc", "to_char", "json_array", "json_object"}


tokens = dialect.tokenize


def closing(t: list[str], i: int) -> int:
    """Place of the parenthesis that closes t[i]."""
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] == "(") - (t[j] == ")")
        if not depth:
            return j
    raise ValueError("unbalanced parentheses")


def split(t: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    depth = 0
    for x in t:
        depth += (x in "([") - (x in ")]")
        if x == "," and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return [] if out == [[]] or not "".join(out[0]).strip() and len(out) == 1 else out


def _next(t: list[str], i: int) -> int:
    while i < len(t) and (t[i].isspace() or t[i].startswith(("--", "/*"))):
        i += 1
    return i


def rewrite(text: str, histories: dict | None = None) -> str:
    shaped = "".join(dialect.reshape(tokens(text), histories))
    return "".join(_rewrite(tokens(shaped)))


def _rewrite(t: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(t):
        x, up = t[i], t[i].upper()
        j = _next(t, i + 1)
        if re.match(r"[A-Za-z_]\w*$", x) and j < len(t) and t[j] == "(" and (x.lower() in scalars.TEMPLATES or x.lower() in SPECIAL) and not (out and out[-1] == "."):
            k = closing(t, j)
            args = [("".join(_rewrite(a))).strip() for a in split(t[j + 1 : k])]
            plain = not args or not re.match(r"(DISTINCT|ALL)\b", args[0], re.I)
            if plain and not any(re.search(r"\bORDER\s+BY\b", a, re.I) for a in args):
                out.append(scalars.sql(x, *args))
            else:
                out += [x, "(", ", ".join(args), ")"]
            i = k + 1
            continue
        if up == "EXTRACT" and j < len(t) and t[j] == "(":
            k = closing(t, j)
            m = re.match(r"\s*(\w+)\s+FROM\s+(.*)$", "".join(_rewrite(t[j + 1 : k])), re.I | re.S)
            out.append(scalars.sql("extract", m[1], m[2]) if m else "".join(t[i : k + 1]))
            i = k + 1
            continue
        if up == "CAST" and j < len(t) and t[j] == "(":
            k = closing(t, j)
            body = "".join(_rewrite(t[j + 1 : k]))
            day = re.match(r"(.*)\bAS\s+DATE\s*$", body, re.I | re.S)
            out.append(f"date_trunc('day', try_cast({day[1]} AS TIMESTAMP))" if day else f"try_cast({_types(body)})")
            i = k + 1
            continue
        if up == "FETCH":
            m = re.match(r"FETCH\s+(?:FIRST|NEXT)\s+(\S+)\s+ROWS?\s+ONLY", "".join(t[i:]), re.I)
            if m:
                out.append(f"LIMIT {m[1]}")
                rest = "".join(t[i:])[m.end() :]
                t, i = t[:i] + tokens(rest), i
                continue
        if up == "GLOB" and j < len(t) and t[j].startswith("'"):
            out.append("RLIKE '" + scalars.glob_regex(t[j][1:-1].replace("''", "'")).replace("\\", "\\\\").replace("'", "\\'") + "'")
            i = j + 1
            continue
        if x == "<=>" and j < len(t):
            k = j + 1
            left: list[str] = []
            while out and (out[-1].isspace() and not left or re.match(r"[\w.`]+$|'.*'$", out[-1], re.S) or out[-1] == "."):
                left.insert(0, out.pop())
                if left[0].startswith("'"):
                    break
            while k + 1 < len(t) and t[k] == ".":
                k += 2
            as_vector = lambda s: f"from_json({s}, 'array<double>')" if s.strip().startswith("'") else s.strip()
            out.append(" " + scalars.sql("vec_distance_l2", as_vector("".join(left)), as_vector("".join(t[j:k]))))
            i = k
            continue
        if up == "ORDER" and j < len(t) and t[j].upper() == "BY":
            end, depth = j + 1, 0
            while end < len(t) and not (depth == 0 and (t[end] == ")" or t[end].upper() in ENDS)):
                depth += (t[end] == "(") - (t[end] == ")")
                end += 1
            items = []
            for a in split(t[j + 1 : end]):
                item = "".join(_rewrite(a)).strip()
                if not re.search(r"\bNULLS\s+(FIRST|LAST)$", item, re.I):
                    item += " NULLS FIRST" if re.search(r"\bDESC$", item, re.I) else " NULLS LAST"
                items.append(item)
            out.append("ORDER BY " + ", ".join(items) + " ")
            i = end
            continue
        if re.match(r"\$\d+$", x):
            out.append(f":p{x[1:]}")
        else:
            out.append(x)
        i += 1
    return out


def _types(body: str) -> str:
    m = re.match(r"(.*\bAS\s+)(\w+)(\s*\([^)]*\))?\s*$", body, re.I | re.S)
    return m[1] + TYPES.get(m[2].upper(), m[2]) if m else body


#: Operators whose meaning hangs on types, and filters, which may name aliases.
NEEDS_TYPES = re.compile(r"[/%+-]|\bWHERE\b", re.I)


def literal(v) -> str:
    """A parameter as Spark SQL."""
    if v is None or isinstance(v, bool):
        return str(v).upper() if v is not None else "NULL"
    if isinstance(v, int):
        return f"({v})"
    if isinstance(v, float):
        return f"double('{v!r}')"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, (dict, list)):
        v = json.dumps(v, ensure_ascii=False)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline(plan: str, params: list | tuple | dict | None) -> str:
    """Parameters put into the text as quoted literals, where operators must know their types."""
    if not params:
        return plan
    t, used = tokens(plan), iter(params if not isinstance(params, dict) else ())
    out: list[str] = []
    for x in t:
        if isinstance(params, dict) and out and out[-1] == ":" and x in params:
            out[-1] = literal(params[x])
        else:
            out.append(literal(next(used)) if x == "?" and not isinstance(params, dict) else x)
    return "".join(out)


def bind(text: str, params: list | tuple | dict | None) -> str:
    """Parameters of any style put into a statement of the dialect."""
    if not params:
        return text
    if isinstance(params, (list, tuple)) and "?" not in tokens(text):
        params = {f"p{i + 1}": v for i, v in enumerate(params)}
    return inline("".join(f":p{x[1:]}" if re.match(r"\$\d+$", x) else x for x in tokens(text)), params)


def promoted(text: str) -> str:
    """A statement with its sums as sums of floats: of whatever is a number, for plain ones; else of the value as a float."""
    t = tokens(text)
    i = 0
    while i < len(t):
        j = _next(t, i + 1)
        if t[i].upper() == "SUM" and j < len(t) and t[j] == "(":
            k = closing(t, j)
            n = _next(t, k + 1)
            inner = "".join(t[j + 1 : k])
            once = re.match(r"\s*DISTINCT\b", inner, re.I)
            if once or n < len(t) and t[n].upper() in ("OVER", "FILTER"):
                value = inner[once.end() :] if once else inner
                t = [*t[: j + 1], f"{'DISTINCT ' if once else ''}try_cast({value.strip()} AS DOUBLE)", *t[k:]]
            else:
                t[i] = "safe_sum"
        i += 1
    return "".join(t)


#: Statements that change tables or views.
STATEMENT = re.compile(r"\s*(INSERT|UPDATE|DELETE|TRUNCATE|CREATE|DROP|ALTER|VACUUM|SHOW|DESCRIBE|DESC|PRAGMA|ANALYZE|BEGIN|START|COMMIT|ROLLBACK|SAVEPOINT|RELEASE)\b", re.I)


class Engine:
    """A thin front: statements in the reference's dialect over one SparkSession.

    Rewritten: functions with other semantics, CAST (null on failure), EXTRACT, order of nulls, FETCH FIRST,
    GLOB, <=> as vector distance, quantified subqueries, $n parameters, and what `dialect` describes.
    """

    def __init__(self, spark: SparkSession, catalog: str | None = None):
        self.spark = spark
        self._prepared: dict[str, str] = {}
        self.histories: dict[str, dict] = {}
        self.store: Store | None = None  # a catalog's views are read with this engine
        self.store = Store(self, catalog)

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_history(self, name: str, versions: DataFrame, key: list[str], timestamp: str, transaction: str, deleted: str) -> None:
        """All versions of a table's rows, for `name AS OF ...`."""
        view = f"_history_{name.lower()}"
        versions.createOrReplaceTempView(view)
        self.histories[name.lower()] = {"view": view, "key": key, "timestamp": timestamp, "transaction": transaction, "deleted": deleted}

    def plan(self, text: str) -> str:
        if text not in self._prepared:
            self._prepared[text] = rewrite(text, self.histories)
        return self._prepared[text]

    def sql(self, text: str, params: list | tuple | dict | None = None) -> DataFrame:
        if self.store and self.store.tables and re.search(r"\bAS\s+OF\s+(TIMESTAMP|TRANSACTION)\b", text, re.I):
            text, params = self.store.as_of(bind(text, params)), None
        if m := re.match(r"\s*EXPLAIN\s+ANALYZE\s+", text, re.I):
            return explain(self.sql(text[m.end() :], params), True)
        if STATEMENT.match(text):
            done = self.store.run(tokens(bind(text, params)))
            if done is not None:
                return done
        loop = dialect.recursion(tokens(text))
        if loop:
            return self._recursive(loop, params)
        plan = self.plan(text)
        if isinstance(params, (list, tuple)) and re.search(r":p\d+", plan):
            params = {f"p{i + 1}": v for i, v in enumerate(params)}
        if NEEDS_TYPES.search(plan):
            plan, params = dialect.resolve(self.spark, inline(plan, params)), None
        return self.spark.sql(plan, args=list(params) if isinstance(params, tuple) else params) if params else self.spark.sql(plan)

    query_frame = sql

    def _recursive(self, loop: dict, params) -> DataFrame:
        """A recursive CTE of several recursive members: each level is the union of all of them over the level before."""
        fill = lambda text: bind(text, params)
        start = self.sql(fill(loop["anchor"]))
        start = start.toDF(*loop["columns"]) if loop["columns"] else start

        def over(text: str, df: DataFrame) -> DataFrame:
            view = f"_level_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(view)
            return self.sql(fill("".join(view if x.lower() == loop["name"].lower() else x for x in tokens(text))))

        cast = [F.col(f"`{f.name}`").cast(f.dataType) for f in start.schema.fields]
        step = lambda level: functools.reduce(DataFrame.union, [over(m, level).toDF(*start.columns).select(cast) for m in loop["members"]])
        return over(loop["rest"], recurse(start, step))

    def _run(self, text: str, params, read):
        """read(frame of a statement); sums that overflow, or meet text, run again as sums of floats that pass text over."""
        try:
            return read(self.sql(text, params))
        except Exception as e:
            again = promoted(text)
            if again == text or not re.search("ARITHMETIC_OVERFLOW|CAST_INVALID_INPUT", str(e)):
                raise
            return read(self.sql(again, params))

    def query(self, text: str, params=None) -> list[dict]:
        return self._run(text, params, lambda df: [r.asDict() for r in df.toLocalIterator()])

    def query_one(self, text: str, params=None) -> dict | None:
        row = self._run(text, params, lambda df: df.first())
        return row.asDict() if row else None

    def query_raw(self, text: str, params=None) -> tuple[list[str], list[list]]:
        return self._run(text, params, lambda df: (df.columns, [list(r) for r in df.toLocalIterator()]))

    def execute(self, text: str, params=None) -> list[DataFrame]:
        """Several statements, split at semicolons outside of quotes."""
        parts: list[list[str]] = [[]]
        for x in tokens(text):
            if x == ";":
                parts.append([])
            else:
                parts[-1].append(x)
        return [self.sql("".join(p), params) for p in parts if "".join(p).strip()]

    def prepare(self, text: str):
        self.plan(text)
        return lambda params=None: self.sql(text, params)

    def json(self, text: str, params=None) -> list[str]:
        return self._run(text, params, lambda df: list(df.toJSON().toLocalIterator()))
