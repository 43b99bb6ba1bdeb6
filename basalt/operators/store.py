"""Tables that statements change: every change writes Parquet and points the table's view at it.

An INSERT adds files; UPDATE and DELETE write those files anew that have a changed row, ON DUPLICATE KEY UPDATE the
table, since Parquet files don't change. Earlier versions stay readable for frames made from them until VACUUM. Constraints are checked by queries
over the changed rows before anything is written; uniqueness needs a join on the key with the table.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.dialect import AFTER, after, closing, commas, tokenize, top
from basalt.operators import references, show, versions
from basalt.operators.ddl import storage_type


class ConstraintError(ValueError):
    """A change that breaks a declared constraint; nothing was written."""


@dataclass
class Column:
    name: str
    type: str
    default: str | None = None
    required: bool = False
    unique: bool = False
    counted: bool = False
    check: str | None = None
    parent: tuple[str, str, str, str] | None = None  # table, column, action on delete, on update
    dimension: int | None = None
    primary: bool = False


@dataclass
class Table:
    columns: list[Column]
    paths: list[str] = field(default_factory=list)
    old: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    versions: list[list] = field(default_factory=list)  # [number of the change, its microseconds, columns, paths], VACUUM keeps the last

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.type}" for c in self.columns)


def _text(t: list[str]) -> str:
    return "".join(t).strip()


def _name(x: str) -> str:
    return x.strip().strip('`"').lower()


def column(t: list[str]) -> Column:
    """A column of CREATE TABLE or ALTER TABLE."""
    words = [i for i in top(t) if not t[i].isspace()]
    head, kind = words[0], words[1]
    end = kind + 1
    if len(words) > 2 and t[words[2]] == "(":
        end = closing(t, words[2]) + 1
    rest = t[end:]
    size = re.fullmatch(r"VECTOR\s*\((\d+)\)", _text(t[kind:end]), re.I)
    text, up = _text(rest), _text(rest).upper()
    c = Column(_name(t[head]), storage_type(_text(t[kind:end])))
    c.dimension = int(size[1]) if size else None
    c.required = "NOT NULL" in up or "PRIMARY KEY" in up
    c.primary = "PRIMARY KEY" in up
    c.unique = "UNIQUE" in up or c.primary
    c.counted = bool(re.search(r"AUTO_?INCREMENT", up))
    m = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|[^\s(]+(?:\([^)]*\))?|\(.*?\))", text, re.I | re.S)
    c.default = m[1] if m else None
    k = next((i for i, x in enumerate(rest) if x.upper() == "CHECK"), None)
    if k is not None:
        a = after(rest, k)
        c.check = _text(rest[a + 1 : closing(rest, a)])
    c.parent = _reference(text)
    return c


def _reference(text: str) -> tuple[str, str, str, str] | None:
    m = re.search(r"\bREFERENCES\s+[`\"]?(\w+)[`\"]?\s*\(\s*[`\"]?(\w+)[`\"]?\s*\)(.*)", text, re.I | re.S)
    if not m:
        return None
    actions = [re.search(rf"\bON\s+{what}\s+(CASCADE|SET\s+NULL|RESTRICT|NO\s+ACTION)", m[3], re.I) for what in ("DELETE", "UPDATE")]
    return (m[1].lower(), m[2].lower(), *(re.sub(r"\s+", " ", (x[1] if x else "RESTRICT").upper()) for x in actions))


def _bare(path: str) -> str:
    """A file's address in one form, however many slashes its scheme has."""
    return re.sub(r"^file:/+", "/", path)


def _coerced(rows: DataFrame, c: Column) -> str:
    """A value in the column's type, null where it doesn't convert. Vectors may come as text."""
    if c.type.startswith("array") and rows.schema[c.name].dataType.typeName() == "string":
        return f"from_json(`{c.name}`, '{c.type}')"
    return f"try_cast(`{c.name}` AS {c.type})"


class Store:
    """The tables of an engine. With `catalog`, the path of a file in a shared folder, their descriptions are kept there
    and found again by the next engine of that catalog; one engine at a time may change them."""

    def __init__(self, engine, catalog: str | None = None):
        self.engine, self.catalog = engine, catalog
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        if catalog:
            known = show.load(engine.spark, catalog)
            for name, t in known["tables"].items():
                columns = [Column(**c | {"parent": tuple(c["parent"]) if c["parent"] else None}) for c in t.pop("columns")]
                self.tables[name] = Table(columns, **t)
                self.frame(name).createOrReplaceTempView(name)
            for name, text in known["views"].items():
                self.views[name] = text
                engine.sql(text).createOrReplaceTempView(name)

    def _save(self) -> None:
        if self.catalog:
            show.save(self.spark, self.catalog, self.tables, self.views)

    @property
    def spark(self) -> SparkSession:
        return self.engine.spark

    # --- versions ---------------------------------------------------------------------------------
    def frame(self, name: str) -> DataFrame:
        t = self.tables[name]
        return self.spark.read.schema(t.ddl).parquet(*t.paths) if t.paths else self.spark.createDataFrame([], t.ddl)

    def _write(self, name: str, df: DataFrame) -> str:
        root = self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = f"{root}/basalt-store/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _point(self, name: str) -> None:
        t = self.tables[name]
        last = max((v[0] for x in self.tables.values() for v in x.versions), default=0)
        t.versions.append([last + 1, time.time_ns() // 1000, t.ddl, list(t.paths)])
        self.frame(name).createOrReplaceTempView(name)
        self._save()

    def as_of(self, text: str) -> str:
        """`table AS OF TIMESTAMP x` and `AS OF TRANSACTION n` (the n-th change of this store) as a view of the files that the
        table had then. A moment before the table's first version that is still kept is an error."""
        t, i = tokenize(text), 0
        while i < len(t):
            a = after(t, i)
            o = after(t, a) if a < len(t) else a
            w = after(t, o) if o < len(t) else o
            if w >= len(t) or t[i].lower() not in self.tables or (t[a].upper(), t[o].upper()) != ("AS", "OF") or t[w].upper() not in ("TIMESTAMP", "TRANSACTION"):
                i += 1
                continue
            x = after(t, w)
            end = closing(t, x) if t[x] == "(" else x
            value = "".join(t[x : end + 1])
            at = self.engine.sql(f"SELECT unix_micros(CAST({value} AS TIMESTAMP))" if t[w].upper() == "TIMESTAMP" else f"SELECT CAST({value} AS BIGINT)").first()[0]
            by = 1 if t[w].upper() == "TIMESTAMP" else 0
            known = [v for v in self.tables[t[i].lower()].versions if at is not None and v[by] <= at]
            if not known:
                raise ValueError(f"{t[i]} has no version of that moment any more, or had none yet")
            _, _, ddl, paths = known[-1]
            frame = self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)
            frame.createOrReplaceTempView(view := f"_version_{uuid.uuid4().hex}")
            n = after(t, end)
            n = after(t, n) if n < len(t) and t[n].upper() == "AS" else n
            named = n < len(t) and re.match(r"[A-Za-z_]\w*$", t[n]) and t[n].upper() not in AFTER | {"ON", "USING"}
            t = t[:i] + [view] + ([] if named else [" AS ", t[i]]) + t[end + 1 :]
            i += 1
        return "".join(t)

    def replace(self, name: str, df: DataFrame) -> None:
        t = self.tables[name]
        path = self._write(name, df.selectExpr(*[f"CAST(`{c.name}` AS {c.type}) AS `{c.name}`" for c in t.columns]))
        t.old, t.paths = t.old + t.paths, [path]
        self._point(name)

    def vacuum(self) -> None:
        for t in self.tables.values():
            for path in t.old:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            t.old, t.versions = [], t.versions[-1:]
        self._save()

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    # --- constraints ------------------------------------------------------------------------------
    def check(self, name: str, rows: DataFrame, others: DataFrame | None, planned: dict[str, list[str]] | None = None) -> None:
        """rows: what was added or changed; others: the rows of the table that stay; planned: files of tables that the same
        statement changes."""
        t = self.tables[name]
        # What a row alone decides is counted in one pass over the rows.
        tests = [(f"`{c.name}` IS NULL", f"{name}.{c.name} must not be null") for c in t.columns if c.required]
        tests += [(f"NOT ({c.check})", f"{name}.{c.name} fails CHECK ({c.check})") for c in t.columns if c.check]
        tests += [(f"size(`{c.name}`) <> {c.dimension}", f"{name}.{c.name} has another dimension") for c in t.columns if c.dimension]
        if tests:
            wrong = rows.agg(*[F.count_if(F.expr(test)).alias(f"_{i}") for i, (test, _) in enumerate(tests)]).first()
            for n, (_, said) in zip(wrong, tests, strict=True):
                if n:
                    raise ConstraintError(said)
        for c in t.columns:
            if c.parent and c.parent[0] in self.tables:
                files = (planned or {}).get(c.parent[0])
                parent = (self.spark.read.schema(self.tables[c.parent[0]].ddl).parquet(*files) if files else self.frame(c.parent[0])).select(c.parent[1])
                if c.parent[0] == name:
                    parent = parent.union(rows.select(c.parent[1]))
                if versions.orphans(rows.select(c.name), c.name, parent.distinct(), c.parent[1]).limit(1).count():
                    raise ConstraintError(f"{name}.{c.name} has no row in {c.parent[0]}")
        for key in [[c.name] for c in t.columns if c.unique] + t.unique:
            known = rows.select(*key).dropna()
            twice = versions.not_unique(known, key).limit(1).count()
            if twice or (others is not None and others.select(*key).join(known.distinct(), key, "left_semi").limit(1).count()):
                raise ConstraintError(f"{name}: {', '.join(key)} is not unique")

    # --- statements -------------------------------------------------------------------------------
    def create(self, name: str, columns: list[Column], unique: list[list[str]] = ()) -> None:
        self.tables[name] = Table(columns, unique=list(unique))
        self._point(name)

    def create_statement(self, name: str, body: list[str]) -> None:
        columns, unique, parents, checks, single = [], [], [], [], []
        for part in commas(body):
            text = _text(part)
            m = re.match(r"(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK)\s*\((.*)", text, re.I | re.S)
            if not m:
                columns.append(column(part))
            elif m[1].upper().startswith("PRIMARY") and len(m[2].split(")")[0].split(",")) == 1:
                single.append(_name(m[2].split(")")[0]))
            elif m[1].upper().startswith("CHECK"):
                checks.append(text[text.index("(") + 1 : text.rindex(")")])
            else:
                names = [_name(x) for x in m[2].split(")")[0].split(",")]
                if m[1].upper().startswith("FOREIGN"):
                    parents.append((names[0], _reference(text)))
                else:
                    unique.append(names)
        by_name = {c.name: c for c in columns}
        for k in single:
            by_name[k].primary = by_name[k].unique = by_name[k].required = True
        for child, parent in parents:
            by_name[child].parent = parent
        for c in checks:
            first = columns[0]
            first.check = f"({first.check}) AND ({c})" if first.check else c
        self.create(name, columns, unique)

    def insert(self, name: str, names: list[str] | None, rows: DataFrame, changes: dict[str, str] | None) -> DataFrame:
        """Rows with defaults, counters and coercions; returns the rows added or changed."""
        t = self.tables[name]
        names = names or [c.name for c in t.columns][: len(rows.columns)]
        if len(names) != len(rows.columns):
            raise ValueError(f"{len(names)} columns and {len(rows.columns)} values")
        rows = rows.toDF(*names)
        before = self.frame(name)
        exprs, counted = [], [c for c in t.columns if c.counted]
        for c in t.columns:
            value = _coerced(rows, c) if c.name in names else f"CAST({c.default or 'NULL'} AS {c.type})"
            exprs.append(f"{value} AS `{c.name}`")
        new = rows.selectExpr(*exprs)
        if counted:
            # Rows are numbered within their partitions, which are written first, and partitions by their counts.
            marked = self.spark.read.parquet(self._write(f"{name}-numbered", new.withColumn("_m", F.monotonically_increasing_id())))
            part = F.shiftright("_m", 33)
            sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
            starts = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
            new = marked.withColumn("_p", part).join(F.broadcast(starts), "_p")
            for c in counted:
                last = before.agg(F.max(c.name)).first()[0] or 0
                place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_s") + F.lit(last + 1)
                new = new.withColumn(c.name, F.coalesce(F.col(c.name), place).cast(c.type))
            new = new.select(*[k.name for k in t.columns])
        if changes is not None:
            key = next(([c.name] for c in t.columns if c.unique), None) or (t.unique[0] if t.unique else None)
            if key is None:
                raise ValueError("ON DUPLICATE KEY UPDATE needs a key")
            if versions.not_unique(new.select(*key).dropna(), key).limit(1).count():
                raise ConstraintError(f"{name}: {', '.join(key)} twice among the new rows")
            path = self._write(name, versions.upsert(before, new, key, changes))
            merged, keys = self.spark.read.schema(t.ddl).parquet(path), new.select(*key)
            touched = merged.join(keys, key, "left_semi").select(*merged.columns)
            try:
                self.check(name, touched, merged.join(keys, key, "left_anti").select(*merged.columns))
            except ConstraintError:
                t.old.append(path)
                raise
            t.old, t.paths = t.old + t.paths, [path]
            self._point(name)
            return touched
        path = self._write(name, new)
        new = self.spark.read.schema(t.ddl).parquet(path)
        try:
            self.check(name, new, before)
        except ConstraintError:
            t.old.append(path)
            raise
        t.paths = [*t.paths, path]
        self._point(name)
        return new

    def _named(self, name: str) -> DataFrame:
        """The table's rows with the file and the place in it."""
        frame = self.frame(name)
        where = [F.col("_metadata.file_path"), F.col("_metadata.row_index")] if self.tables[name].paths else [F.lit(None).cast("string"), F.lit(None).cast("long")]
        return frame.select("*", where[0].alias("_file"), where[1].alias("_row"))

    def _links(self, name: str, action: int) -> list[tuple[str, str, str, str]]:
        return [(child, c.name, c.parent[1], c.parent[action]) for child, t in self.tables.items() for c in t.columns if c.parent and c.parent[0] == name]

    def _level(self, name: str, df: DataFrame) -> DataFrame | None:
        """A frame written beside the tables (VACUUM clears it away); None if it has no rows."""
        path = self._write(f"{name}-level", df)
        self.tables[name].old.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        return None if out.isEmpty() else out

    def _chosen(self, name: str, cols: str, where: str) -> DataFrame:
        """What a statement's condition picks, evaluated once and written: cols, _file, _row."""
        self._named(name).createOrReplaceTempView(view := f"_named_{uuid.uuid4().hex}")
        rows = self.engine.sql(f"SELECT {cols}, _file, _row FROM {view} AS {name} WHERE coalesce(({where}), false)")
        path = self._write(f"{name}-level", rows)
        self.tables[name].old.append(path)
        self.spark.catalog.dropTempView(view)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _apply(self, effects: references.Effects, new: dict[str, DataFrame] | None = None) -> None:
        """All tables that the effects change are written, only the files with a changed row, then checked, then exchanged.
        new: rows that take the place of rows of the same name, by table."""
        new, plans = new or {}, []
        for child, parent, hit in effects.refused:
            if not references.known(hit, effects.gone.get(child)).isEmpty():
                raise ConstraintError(f"rows of {child} refer to {parent}")
        for name in dict.fromkeys([*new, *effects.gone, *(t for t, _ in effects.values)]):
            t, id_ = self.tables[name], references.ID
            gone = effects.gone.get(name, [])
            sets = {c: references.union(parts).dropDuplicates(id_) for (k, c), parts in effects.values.items() if k == name}
            files = references.union([x.select("_file") for x in [*gone, *sets.values(), *([new[name]] if name in new else [])]]).distinct()
            mine = {_bare(r[0]) for r in files.collect()}  # bounded by the number of files
            every = self.frame(name).inputFiles()
            kept = [f for f in every if _bare(f) not in mine]
            if len(kept) == len(every):
                continue
            rows = self.spark.read.schema(t.ddl).parquet(*[f for f in every if _bare(f) in mine]).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            rows = references.known(rows, gone).withColumn("_hit", F.lit(False))
            if name in new:
                rows = references.known(rows, [new[name]]).unionByName(new[name].select(*[c.name for c in t.columns], *id_, F.lit(True).alias("_hit")))
            for c, values in sets.items():
                rows = rows.join(values.withColumn("_set", F.lit(True)), id_, "left").withColumns({c: F.when(F.col("_set"), F.col("_new")).otherwise(F.col(c)), "_hit": F.col("_hit") | F.coalesce("_set", F.lit(False))}).drop("_new", "_set")
            path = self._write(name, rows.selectExpr(*[f"CAST(`{c.name}` AS {c.type}) AS `{c.name}`" for c in t.columns], "_hit"))
            plans.append((name, kept, path, name in new or bool(sets)))
        try:
            for name, kept, path, changed in plans:
                if changed:
                    t = self.tables[name]
                    both = self.spark.read.schema(f"{t.ddl}, _hit boolean").parquet(path)
                    rows, others = both.where("_hit").drop("_hit"), both.where("NOT _hit").drop("_hit")
                    after_ = {k: [*kept_, path_] for k, kept_, path_, _ in plans}
                    self.check(name, rows, others.union(self.spark.read.schema(t.ddl).parquet(*kept)) if kept else others, after_)
        except ConstraintError:
            for name, _, path, _ in plans:
                self.tables[name].old.append(path)
            raise
        for name, kept, path, _ in plans:
            self._exchange(name, kept, path)

    def _exchange(self, name: str, kept: list[str], path: str) -> None:
        """The table is now the files kept and a new folder; what it had else is old."""
        t = self.tables[name]
        still = {_bare(f) for f in kept}
        t.old += [f for f in self.frame(name).inputFiles() if _bare(f) not in still]
        t.paths = [*kept, path]
        self._point(name)

    def update(self, name: str, changes: dict[str, str], where: str) -> DataFrame:
        t = self.tables[name]
        links = self._links(name, 3)
        keys = [k for k in dict.fromkeys(key for _, _, key, _ in links) if k in changes]
        cols = [f"try_cast({changes[c.name]} AS {c.type}) AS {c.name}" if c.name in changes else c.name for c in t.columns]
        rows = self._chosen(name, ", ".join(cols + [f"{k} AS _old_{k}" for k in keys]), where)
        effects = references.Effects()
        if keys:
            changed = {(name, k): rows.where(f"_old_{k} IS DISTINCT FROM {k}").select(F.col(f"_old_{k}").alias("_old"), F.col(k).alias("_new")) for k in keys}
            own = {(name, c): rows.select(*references.ID) for c in changes}
            effects = references.on_update(changed, self._named, lambda k: self._links(k, 3), self._level, own)
        self._apply(effects, {name: rows})
        return rows.select(*[c.name for c in t.columns])

    def delete(self, name: str, where: str) -> DataFrame:
        t = self.tables[name]
        gone = self._chosen(name, ", ".join(c.name for c in t.columns), where)
        self._apply(references.on_delete(name, gone, self._named, lambda k: self._links(k, 2), self._level))
        return gone.select(*[c.name for c in t.columns])

    def alter(self, name: str, t: list[str]) -> None:
        table, text = self.tables[name], _text(t)
        words = [x for x in t if not x.isspace()]
        up = [w.upper() for w in words]
        has = "COLUMN" in up[:2]
        if up[0] == "ADD":
            start = next(i for i, x in enumerate(t) if x.upper() == ("COLUMN" if has else "ADD")) + 1
            c = column(t[start:])
            frame = self.frame(name).withColumn(c.name, F.expr(f"CAST({c.default or 'NULL'} AS {c.type})"))
            table.columns = [*table.columns, c]
            self.replace(name, frame)
        elif up[0] == "DROP":
            gone, frame = _name(words[1 + has]), self.frame(name)
            table.columns = [c for c in table.columns if c.name != gone]
            self.replace(name, frame.drop(gone))
        elif up[0] == "RENAME" and up[1] == "TO":
            self.tables[_name(words[2])] = self.tables.pop(name)
            self.spark.catalog.dropTempView(name)
            self._point(_name(words[2]))
        elif up[0] == "RENAME":
            a, b, frame = _name(words[1 + has]), _name(words[3 + has]), self.frame(name)
            next(c for c in table.columns if c.name == a).name = b
            self.replace(name, frame.withColumnRenamed(a, b))
        elif up[0] in ("MODIFY", "ALTER"):
            start = next(i for i, x in enumerate(t) if x.upper() == ("COLUMN" if has else up[0])) + 1
            c, frame = column(t[start:]), self.frame(name)
            table.columns = [c if k.name == c.name else k for k in table.columns]
            self.replace(name, frame.withColumn(c.name, F.expr(f"try_cast(`{c.name}` AS {c.type})")))
        else:
            raise ValueError(f"ALTER TABLE: {text}")

    def _index(self, t: list[str], words: list[int], up: list[str]) -> DataFrame:
        """An index is a description, as layout is Spark's; a unique one is a constraint."""
        at = up.index("INDEX") + 1
        maybe = up[at] == "IF"
        at += (3 if up[0] == "CREATE" else 2) if maybe else 0
        index = _name(t[words[at]])
        held = next((x for x in self.tables.values() if index in x.indexes), None)
        if up[0] == "DROP":
            if held:
                gone = held.indexes.pop(index)
                held.unique = [k for k in held.unique if not (gone["unique"] and k == gone["columns"])]
        elif held is None and "ON" in up:
            on = up.index("ON") + 1
            name, open_ = _name(t[words[on]]), words[on + 1]
            if name in self.tables and t[open_] == "(":
                columns = [_name(x).split()[0] for x in _text(t[open_ + 1 : closing(t, open_)]).split(",")]
                kind = up[up.index("USING") + 1] if "USING" in up else "BTREE"
                table = self.tables[name]
                if "UNIQUE" in up[:2]:
                    if versions.not_unique(self.frame(name).select(*columns).dropna(), columns).limit(1).count():
                        raise ConstraintError(f"{name}: {', '.join(columns)} is not unique")
                    table.unique.append(columns)
                table.indexes[index] = {"columns": columns, "kind": kind, "unique": "UNIQUE" in up[:2]}
        elif held is not None and not maybe:
            raise ValueError(f"index {index} exists")
        self._save()
        return self._count(0)

    def _show(self, words: list[str]) -> DataFrame | None:
        """SHOW TABLES, VIEWS, INDEXES FROM t, CREATE TABLE t, CREATE VIEW v, and DESCRIBE t, of what this store knows."""
        what, name = " ".join(words[:-1]), words[-1]
        table = self.tables.get(name)
        if words == ["show", "tables"]:
            return show.frame(self.spark, [(k,) for k in sorted(self.tables)], "table_name string")
        if words == ["show", "views"]:
            return show.frame(self.spark, [(k,) for k in sorted(self.views)], "view_name string")
        if what == "show create view" and name in self.views:
            return show.frame(self.spark, [(name, f"CREATE VIEW {name} AS {self.views[name]}")], "`View` string, `Create View` string")
        if table is None:
            return None
        if what in ("show indexes from", "show indexes on", "show index from"):
            return show.frame(self.spark, show.indexes(name, table), "table_name string, index_name string, column_name string, index_type string, is_unique boolean")
        if what == "show create table":
            return show.frame(self.spark, [(name, show.definition(name, table))], "`Table` string, `Create Table` string")
        if what in ("describe", "desc", "describe table", "desc table"):
            return show.frame(self.spark, show.describe(table), "`Field` string, `Type` string, `Null` string, `Key` string, `Default` string, `Extra` string")
        return None

    def run(self, t: list[str]) -> DataFrame | None:
        """The frame of a statement that this store knows, else None (it is Spark's)."""
        words = [i for i in top(t) if not t[i].isspace() and not t[i].startswith(("--", "/*"))]
        up = [t[i].upper() for i in words]
        if not up:
            return None
        head = " ".join(up[:2])
        exists = 3 if "IF" in up[2:3] and "EXISTS" in up[3:5] else 0
        if head == "CREATE TABLE":
            n = 2 + (3 if up[2] == "IF" else 0)
            name = _name(t[words[n]])
            if name in self.tables:
                if up[2] == "IF":
                    return self._count(0)
                raise ValueError(f"table {name} exists")
            if up[n + 1] == "AS":
                rows = self.engine.sql(_text(t[words[n + 1] + 1 :]))
                self.create(name, [Column(f.name.lower(), f.dataType.simpleString() if f.dataType.typeName() != "void" else "string") for f in rows.schema.fields])
                self.replace(name, rows)
            else:
                self.create_statement(name, t[words[n + 1] + 1 : closing(t, words[n + 1])])
            return self._count(0)
        if head == "DROP TABLE":
            name = _name(t[words[2 + (2 if exists else 0)]])
            if name in self.tables:
                gone = self.tables.pop(name)
                self.spark.catalog.dropTempView(name)
                self.tables[name] = gone
                gone.old, gone.paths = gone.old + gone.paths, []
                self.vacuum()
                del self.tables[name]
                self._save()
                return self._count(0)
            return self._count(0) if exists else None
        if up[0] == "CREATE" and "VIEW" in up[:4] and "AS" in up:
            v = up.index("VIEW") + 1
            name = _name(t[words[v + (3 if up[v] == "IF" else 0)]])
            text = _text(t[words[up.index("AS")] + 1 :])
            self.engine.sql(text).createOrReplaceTempView(name)
            self.views[name] = text
            self._save()
            return self._count(0)
        if head == "DROP VIEW":
            name = _name(t[words[2 + (2 if exists else 0)]])
            self.spark.catalog.dropTempView(name)
            self.views.pop(name, None)
            self._save()
            return self._count(0)
        if up[0] in ("SHOW", "DESCRIBE", "DESC"):
            return self._show([_name(t[i]) for i in words])
        if up[0] in ("CREATE", "DROP") and "INDEX" in up[:3]:
            return self._index(t, words, up)
        if up[0] in ("PRAGMA", "ANALYZE"):
            return self._count(0)  # layout and statistics are Spark's
        if up[0] == "VACUUM":
            self.vacuum()
            return self._count(0)
        if up[0] in ("BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"):
            raise NotImplementedError("transactions: every statement stands alone")
        ret, given = None, up
        if up[0] in ("INSERT", "UPDATE", "DELETE") and "RETURNING" in up:
            r = up.index("RETURNING")
            ret = _text(t[words[r] + 1 :])
            t, words, up = t[: words[r]], words[:r], up[:r]
        target = {"INSERT": 2, "DELETE": 2, "UPDATE": 1, "TRUNCATE": 2 if "TABLE" in given[1:2] else 1, "ALTER": 2}.get(up[0])
        if target is None or len(words) <= target or _name(t[words[target]]) not in self.tables:
            return None
        name = _name(t[words[target]])
        if up[0] == "ALTER":
            self.alter(name, t[words[3] :])
            return self._count(0)
        if up[0] == "TRUNCATE":
            n = self.frame(name).count()
            self.replace(name, versions.truncate(self.frame(name)))
            return self._count(n)
        if up[0] == "INSERT":
            changes, stop = None, len(t)
            dup = next((n for n in range(len(up) - 4) if up[n : n + 5] == ["ON", "DUPLICATE", "KEY", "UPDATE", up[n + 4]]), None)
            if dup is not None:
                changes, stop = self._assignments(t[words[dup + 3] + 1 :], name), words[dup]
            start, names = words[3], None
            if t[start] == "(" and (len(words) > 4 and up[4] in ("VALUES", "SELECT", "WITH")):
                names = [_name(x) for x in _text(t[start + 1 : closing(t, start)]).split(",")]
                start = words[4]
            source = self._values(name, names, t[start:stop]) if t[start].upper() == "VALUES" else _text(t[start:stop])
            rows = self.insert(name, names, self.engine.sql(source), changes)
        elif up[0] == "UPDATE":
            w = up.index("WHERE") if "WHERE" in up else None
            sets = t[words[up.index("SET")] + 1 : words[w] if w else len(t)]
            changes = {_name(_text(p).split("=", 1)[0]): _text(p).split("=", 1)[1].strip() for p in commas(sets)}
            rows = self.update(name, changes, _text(t[words[w] + 1 :]) if w else "true")
        else:
            w = up.index("WHERE") if "WHERE" in up else None
            rows = self.delete(name, _text(t[words[w] + 1 :]) if w else "true")
        if ret:
            rows.createOrReplaceTempView(view := f"_returning_{uuid.uuid4().hex}")
            return self.engine.sql(f"SELECT {ret} FROM {view} AS {name}")
        return self._count(rows.count())

    def _values(self, name: str, names: list[str] | None, t: list[str]) -> str:
        """VALUES with DEFAULT put in place."""
        by_name = {c.name: c for c in self.tables[name].columns}
        order = names or list(by_name)
        out, i = ["VALUES "], after(t, 0)
        rows = []
        while i < len(t) and t[i] == "(":
            k = closing(t, i)
            items = [_text(x) for x in commas(t[i + 1 : k])]
            rows.append("(" + ", ".join((by_name[order[n]].default or "NULL") if x.upper() == "DEFAULT" else x for n, x in enumerate(items)) + ")")
            i = after(t, after(t, k)) if after(t, k) < len(t) and t[after(t, k)] == "," else len(t)
        return "".join(out) + ", ".join(rows)

    def _assignments(self, t: list[str], name: str) -> dict[str, str]:
        """Assignments of ON DUPLICATE KEY UPDATE: VALUES(c) is the new row's value, a bare column the old one's."""
        out = {}
        columns = {c.name for c in self.tables[name].columns}
        for p in commas(t):
            left, right = _text(p).split("=", 1)
            right = re.sub(r"\b(?:VALUES\s*\(\s*(\w+)\s*\)|EXCLUDED\.(\w+))", lambda m: f"new.{(m[1] or m[2]).lower()}", right, flags=re.I)
            right = re.sub(r"(?<![\w.'])([A-Za-z_]\w*)(?![\w('.])", lambda m: f"old.{m[1].lower()}" if m[1].lower() in columns else m[1], right)
            out[_name(left)] = right.strip()
        return out
