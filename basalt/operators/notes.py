"""Notes as a graph: parsing, permalinks, links, edits, synchronisation, statistics."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types as objects: the executors import this module, where no session can parse their names.
TEXTS = T.ArrayType(T.StringType())
NOTE = T.StructType([T.StructField("metadata", T.StringType()), T.StructField("body", T.StringType())])
SAID = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))

ITEM = r"^\s*[-*+]\s+(.*)$"
CATEGORY = r"^\[([^\[\]()]+)\]\s+(.+)"


KEY = re.compile(r"([^\s:#\[{'\"][^:]*|'[^']*'|\"[^\"]*\")\s*:(?:\s+(.*)|$)")


def _inline(v: str):
    """A value on one line: a list in brackets, else text without its quotes and comment."""
    v = v.strip()
    if v.startswith("[") and v.endswith("]"):
        return [_inline(x) for x in re.findall(r"\s*('[^']*'|\"[^\"]*\"|[^,]+)", v[1:-1]) if x.strip()]
    if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
        return v[1:-1]
    return re.sub(r"\s+#.*$", "", v).strip("'\"")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _tree(lines: list[str]):
    """Lines of a head: mappings and lists by indentation, texts of several lines behind | (as they are) or > (joined)."""
    rows = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    listed = bool(rows) and rows[0].lstrip().startswith("- ")
    out, i = [] if listed else {}, 0
    while i < len(lines):
        line, i = lines[i], i + 1
        item = re.match(r"(\s*-\s+)(.*)$", line) if listed else None
        pair = None if listed else KEY.match(line.strip())
        if not line.strip() or line.lstrip().startswith("#") or not (item or pair):
            continue
        # What belongs to this entry: deeper lines, empty ones, and items of a list that isn't indented.
        j = i
        while j < len(lines) and (not lines[j].strip() or _indent(lines[j]) > _indent(line) or (pair and not pair[2] and _indent(lines[j]) == _indent(line) and lines[j].lstrip().startswith("- "))):
            j += 1
        below, i = lines[i:j], j
        head = (item[2] if item else pair[2] or "").strip()
        if re.fullmatch(r"[|>][+-]?", head):
            depth = min((_indent(x) for x in below if x.strip()), default=0)
            text = [x[depth:] for x in below]
            value = ("\n" if head[0] == "|" else " ").join(text).strip()
        elif item and KEY.match(head) and not head.startswith(("'", '"')):
            value = _tree([" " * len(item[1]) + head, *below])
        elif head and not head.startswith("#"):
            value = _inline(head)
        else:
            value = _tree(below) if any(x.strip() for x in below) else ""
        if listed:
            out.append(value)
        else:
            out[_inline(pair[1])] = value
    return out


def _front(text: str | None) -> tuple[dict, str]:
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text or "", re.S)
    if not m:
        return {}, text or ""
    head = _tree(m[1].splitlines())
    return head if isinstance(head, dict) else {}, text[m.end() :]


@F.pandas_udf(NOTE)
def frontmatter(text: pd.Series) -> pd.DataFrame:
    """Head of a note as JSON (scalars as strings; nested mappings and lists) and what follows it."""
    rows = [_front(t) for t in text]
    return pd.DataFrame({"metadata": [json.dumps(a, ensure_ascii=False) for a, _ in rows], "body": [b for _, b in rows]})


def items(notes: DataFrame, text: str = "body") -> DataFrame:
    """The list items of notes, with line and item."""
    lines = notes.select("*", F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "_raw"))
    return lines.where(F.col("_raw").rlike(ITEM)).withColumn("item", F.trim(F.regexp_extract("_raw", ITEM, 1))).drop("_raw")


def observations(notes: DataFrame, text: str = "body") -> DataFrame:
    """Items `[category] content #tag (context)`, or with a tag: columns category, content, tags, context."""
    it = F.col("item")
    task = it.startswith("[ ]") | it.startswith("[x]") | it.startswith("[-]")
    link = it.rlike(r"^\[.*?\]\(.*?\)$") | it.rlike(r"^\[\[.*?\]\]$")
    has = it.rlike(CATEGORY)
    words = F.split(it, r"\s+")
    kept = items(notes, text).where(~task & ~link & (has | F.exists(words, lambda w: w.startswith("#"))))
    body = F.when(has, F.trim(F.regexp_extract(it, CATEGORY, 2))).otherwise(F.regexp_replace(it, r"^\[\]\s+", ""))
    context = F.regexp_extract(F.col("_b"), r"\(([^(]*)\)$", 1)
    ends = F.col("_b").rlike(r"\([^(]*\)$")
    content = F.when(ends, F.trim(F.regexp_replace("_b", r"\([^(]*\)$", ""))).otherwise(F.col("_b"))
    tags = F.flatten(F.transform(F.filter(F.split("content", r"\s+"), lambda w: w.startswith("#")), lambda w: F.filter(F.split(w, "#"), lambda t: t != "")))
    out = kept.withColumns({"category": F.when(has, F.trim(F.regexp_extract(it, CATEGORY, 1))), "_b": body})
    out = out.withColumns({"context": F.when(ends, F.trim(context)), "content": content})
    return out.withColumn("tags", F.when(F.size(tags) > 0, tags)).drop("_b", "item")


def relations(notes: DataFrame, text: str = "body") -> DataFrame:
    """Items `type [[Target]] (context)`: relation_type (relates_to by default), to_name, context."""
    it = F.col("item")
    form = r"^(.*?)\[\[(.*?)\]\](.*)$"
    after = F.trim(F.regexp_extract(it, form, 3))
    before = F.trim(F.regexp_extract(it, form, 1))
    out = items(notes, text).where(it.rlike(form)).withColumns({
        "relation_type": F.when(before == "", "relates_to").otherwise(before), "to_name": F.trim(F.regexp_extract(it, form, 2)),
        "context": F.when(after.rlike(r"^\(.*\)$"), F.nullif(F.trim(F.regexp_extract(after, r"^\((.*)\)$", 1)), F.lit(""))),
    })
    return out.where("to_name <> ''").drop("item")


@F.pandas_udf(TEXTS)
def inline_links(text: pd.Series) -> pd.Series:
    """Outermost [[...]] of prose, nested ones kept inside."""

    def one(t: str | None) -> list[str]:
        out, depth, begin = [], 0, 0
        for m in re.finditer(r"\[\[|\]\]", t or ""):
            if m[0] == "[[":
                begin = m.end() if not depth else begin
                depth += 1
            elif depth:
                depth -= 1
                if not depth and t[begin : m.start()].strip():
                    out.append(t[begin : m.start()].strip())
        return out

    return text.map(one)


# Ranges of characters that stay, and letters with a spelling of their own (in `permalink_of`, as its suffixes).
_CJK = "一-鿿　-〿㐀-䶿"


def permalink_of(path: str) -> str:
    """Stable name of a path: accents and case folded, camelCase split, everything else a hyphen; CJK stays."""
    base = path.replace("\\", "/")
    stem = re.sub(r"\.(md|markdown|txt|html?|json|canvas|pdf|png|jpe?g|gif|csv)$", "", base, flags=re.I)
    special = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "ð": "d", "’": "'", "–": "-", "—": "--"}
    wide = bool(re.search(f"[{_CJK}぀-ヿ가-힯！-￯]", stem))

    def plain(c: str) -> str:
        if c.isascii() or (wide and re.match(f"[{_CJK}]", c)):
            return c
        if "＀" <= c <= "￯":
            return ""
        return special.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())

    s = "".join(map(plain, stem))
    if wide:
        s = re.sub(f"([{_CJK}])([a-zA-Z0-9])", r"\1-\2", s)
        s = re.sub(f"([a-zA-Z0-9])([{_CJK}])", r"\1-\2", s)
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", s).lower().replace("_", "-").replace("'", "")
    s = re.sub(rf"[^a-z0-9/.\-{_CJK if wide else ''}]", "-", s)
    return "/".join(x.strip("-") for x in re.sub("-+", "-", s).split("/"))


@F.pandas_udf(T.StringType())
def permalink(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else permalink_of(p))


def ascii_permalink(path: Column) -> Column:
    """The same for ASCII paths, without Python."""
    s = F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), "([a-z0-9])([A-Z])", "$1-$2")
    s = F.regexp_replace(F.replace(F.replace(F.lower(s), F.lit("_"), F.lit("-")), F.lit("'"), F.lit("")), r"[^a-z0-9/\-\.]", "-")
    return F.array_join(F.transform(F.split(F.regexp_replace(s, "-+", "-"), "/"), lambda x: F.regexp_replace(x, "^-+|-+$", "")), "/")


def parse_tags(tags: Column) -> Column:
    """Tags of a comma list or JSON array: trimmed, without #, no empty ones."""
    listed = F.when(tags.rlike(r"^\s*\["), F.from_json(tags, "array<string>")).otherwise(F.split(tags, ","))
    return F.filter(F.transform(listed, lambda t: F.regexp_replace(F.trim(t), "^#+", "")), lambda t: t != "")


def unique_permalinks(entities: DataFrame, order: str) -> DataFrame:
    """Later ones of equal permalinks get -1, -2, ..."""
    r = F.row_number().over(W.partitionBy("permalink").orderBy(order)) - 1
    return entities.withColumn("_r", r).withColumn("permalink", F.when(F.col("_r") > 0, F.concat_ws("-", "permalink", F.col("_r").cast("string"))).otherwise(F.col("permalink"))).drop("_r")


def text_variants(text: Column) -> Column:
    """What is indexed for a title: itself, lower case, its path segments and words."""
    low = F.lower(text)
    parts = F.filter(F.concat(F.array(text, low), F.split(text, "/"), F.split(low, "/"), F.split(low, r"[\s\-_/]+")), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(parts, lambda x: F.trim(x)))


def index_rows(entities: DataFrame, obs: DataFrame, rels: DataFrame) -> DataFrame:
    """One row per entity, observation (once per permalink) and outgoing relation."""
    e = entities.select(F.lit("entity").alias("type"), F.col("entity_id"), "title", "permalink", F.coalesce("content", F.lit("")).alias("content"))
    o = obs.join(entities.select("entity_id", "title", F.col("permalink").alias("_p")), "entity_id").select(F.lit("observation").alias("type"), "entity_id", F.concat_ws(": ", "category", F.substring("content", 1, 100)).alias("title"), F.concat_ws("/", "_p", F.lit("observations"), "category", "content").alias("permalink"), "content").dropDuplicates(["permalink"])
    r = rels.join(entities.select("entity_id", F.col("title").alias("_t"), F.col("permalink").alias("_p")), "entity_id").select(F.lit("relation").alias("type"), "entity_id", F.concat_ws(" → ", "_t", "to_name").alias("title"), F.concat_ws("/", "_p", "relation_type", "to_name").alias("permalink"), F.lit(None).cast("string").alias("content"))
    return e.unionByName(o).unionByName(r)


def proximity(source: Column, target: Column) -> Column:
    """0 same folder, n if the target is n folders up, 100 + n if n folders down, else 1000."""
    a, b = F.regexp_extract(source, "^(.*)/[^/]*$", 1), F.regexp_extract(target, "^(.*)/[^/]*$", 1)
    depth = lambda p: F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))
    below = lambda x, y: (y == "") | F.startswith(x, F.concat(y, F.lit("/")))
    return F.when(a == b, 0).when(below(a, b), depth(a) - depth(b)).when(below(b, a), 100 + depth(b) - depth(a)).otherwise(1000)


def resolve_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """links (link_id, name, source) -> with entity_id: by permalink, then title (nearest, then shortest path), path, path + .md.

    Nearness is decided by equalities. A link asks at its own folder and those above it, at its folder for what stands
    below, and for anything of the name; of each such place only the best entity is kept. So a name that many links and
    many entities have makes no pairs of them.
    """
    folder = lambda path: F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    parts = F.split("folder", "/")
    depth = lambda at: F.when(at == "", 0).otherwise(F.size(F.split(at, "/")))
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.filter(F.array_distinct(F.concat(F.array(F.lit("")), up)), lambda x: x != F.col("folder"))
    place = lambda at, kind, p: F.struct(at.alias("at"), F.lit(kind).alias("kind"), p.cast("int").alias("p"))
    here, below, any_ = 0, 1, 2

    path = F.col("file_path")
    way = lambda c, n: F.struct(c.alias("name"), F.lit(n).alias("way"))
    names = F.array(way(F.col("permalink"), 0), way(F.col("title"), 1), way(path, 2), way(F.when(F.endswith(path, F.lit(".md")), F.expr("left(file_path, length(file_path) - 3)")), 3))
    es = entities.select(F.explode(names).alias("_n"), folder(path).alias("folder"), F.length(path).alias("length"), "entity_id").select("_n.*", "folder", "length", "entity_id").where("name IS NOT NULL")
    # Equal folders are combined and names that nobody asks for go first, so that few rows are repeated for the folders above.
    es = es.groupBy("name", "way", "folder").agg(F.min(F.struct("length", "entity_id")).alias("_e")).join(links.select("name").distinct(), "name", "left_semi")
    held = F.concat(
        F.when(F.col("folder").isNull(), F.array().cast("array<struct<at:string,kind:int,p:int>>")).otherwise(F.concat(F.array(place(F.col("folder"), here, F.lit(0))), F.transform(above, lambda x: place(x, below, depth(F.col("folder")) - depth(x))))),
        F.array(place(F.lit(""), any_, F.lit(0))),
    )
    es = es.select("name", "way", "_e", F.explode(held).alias("_p")).groupBy("name", "_p.at", "_p.kind").agg(F.min(F.struct("way", F.col("_p.p").alias("near"), "_e")).alias("_t"))

    asked = links.select("link_id", "name", folder(F.col("source")).alias("folder"))
    spots = F.concat(
        F.when(F.col("folder").isNull(), F.array(place(F.lit(""), here, F.lit(-1)))).otherwise(
            F.concat(F.array(place(F.col("folder"), here, F.lit(0)), place(F.col("folder"), below, F.lit(100))), F.transform(above, lambda x: place(x, here, depth(F.col("folder")) - depth(x))))
        ),
        F.array(place(F.lit(""), any_, F.lit(1000))),
    )
    places = asked.select("name", "folder").where("name IS NOT NULL").distinct().select("name", "folder", F.explode(spots).alias("_p")).select("name", "folder", "_p.*")
    best = F.min(F.struct(F.col("_t.way"), (F.col("p") + F.col("_t.near")).alias("near"), F.col("_t._e"))).alias("_b")
    solved = places.join(es, ["name", "at", "kind"]).groupBy("name", "folder").agg(best).withColumnsRenamed({"name": "_name", "folder": "_folder"})
    first = asked.join(solved, (F.col("name") == F.col("_name")) & F.col("folder").eqNullSafe(F.col("_folder"))).groupBy("link_id").agg(F.min("_b").alias("_b"))
    return links.join(first.select("link_id", F.col("_b._e.entity_id").alias("entity_id")), "link_id", "left")


def resolve_forward(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Fill to_id of relations (from_id, to_id, to_name, relation_type) by title or permalink; none to itself, no duplicates."""
    names = entities.select("entity_id", F.col("title").alias("n")).union(entities.select("entity_id", F.col("permalink").alias("n"))).groupBy("n").agg(F.min("entity_id").alias("_to"))
    out = rels.join(names, (rels["to_name"] == names["n"]) & rels["to_id"].isNull() & (rels["from_id"] != names["_to"]), "left")
    return out.withColumn("to_id", F.coalesce("to_id", "_to")).drop("n", "_to").dropDuplicates(["from_id", "to_id", "to_name", "relation_type"])


def sync_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change, old_path) between two snapshots (path, mtime, size, checksum): new, modified, deleted, moved.

    Unchanged: mtime within 0.01 s and equal size, or else an equal checksum. Moved: a new path with the
    checksum of a path that is gone.
    """
    b = before.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.col("checksum").alias("c0"))
    j = b.join(now, "path", "full_outer")
    same = (F.abs(F.col("m0") - F.col("mtime")) <= 0.01) & (F.col("s0") == F.col("size"))
    raw = j.withColumn("change", F.when(F.col("c0").isNull(), "new").when(F.col("checksum").isNull(), "deleted").when(~same & (F.col("c0") != F.col("checksum")), "modified")).where("change IS NOT NULL")
    gone = raw.where("change = 'deleted'").groupBy("c0").agg(F.min("path").alias("old_path")).withColumnRenamed("c0", "checksum")
    fresh = raw.where("change = 'new'").select("path", "checksum").join(gone, "checksum", "left")
    one = W.partitionBy("old_path").orderBy("path")
    fresh = fresh.withColumn("_r", F.row_number().over(one)).withColumn("old_path", F.when(F.col("_r") == 1, F.col("old_path"))).drop("_r")
    moved = fresh.where("old_path IS NOT NULL").select("old_path")
    return (
        fresh.select("path", F.when(F.col("old_path").isNull(), "new").otherwise("moved").alias("change"), "old_path")
        .unionByName(raw.where("change = 'modified'").select("path", "change", F.lit(None).cast("string").alias("old_path")))
        .unionByName(raw.where("change = 'deleted'").join(moved.withColumnRenamed("old_path", "path"), "path", "left_anti").select("path", "change", F.lit(None).cast("string").alias("old_path")))
    )


def edit(text: Column, operation: str, content: str, find: str | None = None, expected: int = 1, section: str | None = None) -> Column:
    """append, prepend, find_replace (fails unless `expected` places) or replace_section (up to the next header)."""
    if operation == "append":
        return F.when(text.endswith("\n"), F.concat(text, F.lit(content))).otherwise(F.concat(text, F.lit("\n" + content)))
    if operation == "prepend":
        head = F.regexp_extract(text, r"(?s)\A(---[ \t]*\n.*?\n---[ \t]*\n)", 1)
        return F.concat(head, F.lit(content + "\n"), F.substring(text, F.length(head) + 1, F.length(text)))
    if operation == "find_replace":
        n = ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("int")
        return F.when(n == expected, F.replace(text, F.lit(find), F.lit(content))).otherwise(F.raise_error(F.concat(F.lit("places found: "), n.cast("string"))))
    if operation == "replace_section":
        head = re.escape(section.strip())
        n = F.regexp_count(text, F.lit(rf"(?m)^{head}[ \t]*$"))
        new = f"{section.strip()}\n{content}\n".replace("\\", "\\\\").replace("$", "\\$")
        done = F.regexp_replace(text, rf"(?ms)^{head}[ \t]*$\n?.*?(?=^#{{1,6}} |\z)", new)
        return F.when(n > 1, F.raise_error(F.lit("several sections of this header"))).when(n == 0, F.concat(text, F.lit("\n" + new))).otherwise(done)
    raise ValueError(operation)


def move_directory(entities: DataFrame, old: str, new: str) -> DataFrame:
    inside = F.startswith(F.col("file_path"), F.lit(old.rstrip("/") + "/"))
    return entities.withColumn("file_path", F.when(inside, F.concat(F.lit(new.rstrip("/")), F.substring("file_path", F.lit(len(old.rstrip("/")) + 1), F.length("file_path")))).otherwise(F.col("file_path")))


def delete_directory(entities: DataFrame, folder: str) -> DataFrame:
    return entities.where(~F.startswith(F.col("file_path"), F.lit(folder.rstrip("/") + "/")))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path, or a part of it, matches gitignore-like patterns."""
    out = F.lit(False)
    for p in patterns:
        rooted, folder = p.startswith("/"), p.endswith("/")
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p.strip("/"))
        out = out | path.rlike(("^" if rooted else "(^|/)") + body + ("/" if folder else "(/|$)"))
    return out


def directories(entities: DataFrame) -> DataFrame:
    """(directory, depth, files): every folder above a file, with the number of files below it."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = entities.where(F.size(parts) > 1).select(F.explode(above).alias("directory"))
    return rows.groupBy("directory").agg(F.count("*").alias("files")).withColumn("depth", F.size(F.split("directory", "/")))


def statistics(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """One row: entities, relations, unresolved ones, and entities without any relation."""
    linked = rels.select(F.col("from_id").alias("entity_id")).union(rels.select(F.col("to_id").alias("entity_id"))).where("entity_id IS NOT NULL").distinct()
    a = entities.agg(F.count("*").alias("entities"))
    b = rels.agg(F.count("*").alias("relations"), F.count_if(F.col("to_id").isNull()).alias("unresolved"))
    return a.crossJoin(b).crossJoin(entities.join(linked, "entity_id", "left_anti").agg(F.count("*").alias("isolated")))


def most_connected(entities: DataFrame, rels: DataFrame, n: int = 10) -> DataFrame:
    out = rels.groupBy(F.col("from_id").alias("entity_id")).agg(F.count("*").alias("outgoing"))
    return entities.join(out, "entity_id").orderBy(F.desc("outgoing"), "entity_id").limit(n)


def memory_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of JSON lines (value): entity name from name, entityName or id."""
    j = lambda p: F.get_json_object("value", p)
    e = lines.where(j("$.type") == "entity").select(F.coalesce(j("$.name"), j("$.entityName"), j("$.id")).alias("name"), F.coalesce(j("$.entityType"), F.lit("unknown")).alias("entity_type"), F.from_json(j("$.observations"), "array<string>").alias("observations"))
    r = lines.where(j("$.type") == "relation").select(F.coalesce(j("$.from"), j("$.from_id")).alias("from_name"), F.coalesce(j("$.to"), j("$.to_id")).alias("to_name"), F.coalesce(j("$.relationType"), j("$.relation_type")).alias("relation_type"))
    return e, r


def conversations(turns: DataFrame) -> DataFrame:
    """One note per conversation (conv_id, turn, role, text): the turns in order under a heading of their role."""
    block = F.concat(F.lit("### "), F.initcap(F.coalesce("role", F.lit("unknown"))), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("t")))).alias("x"))
    return rows.select("conv_id", F.size("x").alias("turns"), F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("body"))


@F.pandas_udf(SAID)
def linear_chat(mapping: pd.Series) -> pd.Series:
    """Messages of an exported chat tree (JSON mapping of nodes) in depth-first order, hidden ones left out."""

    def one(text: str | None) -> list[dict]:
        nodes = json.loads(text or "{}")
        roots = [k for k, v in nodes.items() if not v.get("parent") or v["parent"] not in nodes]
        out, todo, seen = [], roots[::-1], set()
        while todo:
            k = todo.pop()
            if k in seen or k not in nodes:
                continue
            seen.add(k)
            m = nodes[k].get("message") or {}
            meta = m.get("metadata") or {}
            parts = (m.get("content") or {}).get("parts") or []
            said = "\n".join(p for p in parts if isinstance(p, str)).strip()
            if said and not meta.get("is_visually_hidden_from_conversation"):
                out.append({"role": (m.get("author") or {}).get("role", "unknown"), "text": said})
            todo.extend((nodes[k].get("children") or [])[::-1])
        return out

    return mapping.map(one)
