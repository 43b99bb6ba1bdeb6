"""What a store tells about its tables, and how it keeps it beside their files."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

#: Declared names of storage types.
NAMES = {"bigint": "Integer", "double": "Float", "string": "Text", "boolean": "Boolean", "timestamp": "Timestamp"}


def type_name(c) -> str:
    return f"Vector({c.dimension})" if c.dimension else NAMES.get(c.type.lower(), c.type)


def definition(name: str, t) -> str:
    """CREATE TABLE of a table: its columns with their constraints, then its foreign keys."""
    parts = []
    for c in t.columns:
        words = [c.name, type_name(c)]
        if c.primary:
            words += ["PRIMARY KEY"] + ["AUTO_INCREMENT"] * c.counted
        else:
            words += ["UNIQUE"] * c.unique + ["NOT NULL"] * c.required
        words += [f"DEFAULT {c.default}"] * (c.default is not None) + [f"CHECK ({c.check})"] * bool(c.check)
        parts.append(" ".join(words))
    parts += [f"UNIQUE ({', '.join(k)})" for k in t.unique if k not in [i["columns"] for i in t.indexes.values()]]
    parts += [f"FOREIGN KEY ({c.name}) REFERENCES {c.parent[0]}({c.parent[1]}) ON DELETE {c.parent[2]}" for c in t.columns if c.parent]
    return f"CREATE TABLE {name} ({', '.join(parts)})"


def indexes(name: str, t) -> list[tuple]:
    """Declared indexes and those that unique columns stand for; Spark's scans use their statistics instead."""
    own = [(name, k, ", ".join(i["columns"]) if len(i["columns"]) == 1 else f"({', '.join(i['columns'])})", i["kind"], i["unique"]) for k, i in sorted(t.indexes.items())]
    return own + [(name, f"unique_{name}_{c.name}", c.name, "BTREE", True) for c in t.columns if c.unique and not c.primary and not any(i["unique"] and i["columns"] == [c.name] for i in t.indexes.values())]


def describe(t) -> list[tuple]:
    single = [k[0] for k in t.unique if len(k) == 1]
    key = lambda c: "PRI" if c.primary else "UNI" if c.unique or c.name in single else "MUL" if c.parent else ""
    return [(c.name, type_name(c), "NO" if c.required else "YES", key(c), c.default or "", "auto_increment" if c.counted else "") for c in t.columns]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _path(spark: SparkSession, at: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(spark: SparkSession, at: str, tables: dict, views: dict[str, str]) -> None:
    """All tables' descriptions as one JSON file, written beside and then moved into place."""
    text = json.dumps({"tables": {k: asdict(t) for k, t in tables.items()}, "views": views})
    new, fs = _path(spark, f"{at}.new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    old = _path(spark, at)[0]
    fs.delete(old, False)
    fs.rename(new, old)


def load(spark: SparkSession, at: str) -> dict:
    p, fs = _path(spark, at)
    if not fs.exists(p):
        return {"tables": {}, "views": {}}
    return json.loads(spark.read.text(at, wholetext=True).first()[0])
