"""Questions about a knowledge graph: filtered search, related items, context, recent activity, listings, upserts."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basalt.functions.scalars import glob

from . import notes, search

BUCKETS = 1024
#: Days of the units of a timeframe.
DAYS = {"h": 1 / 24, "hour": 1 / 24, "d": 1, "day": 1, "w": 7, "week": 7, "m": 30, "month": 30, "y": 365, "year": 365}


def permalink_like(pattern: str) -> Column:
    """A permalink pattern: * and ? as in GLOB; a path as it is; else words that the permalink has."""
    p = pattern.lower().strip()
    if "*" in pattern:
        return glob(F.col("permalink"), p)
    return F.col("permalink") == p if "/" in p else search.match(p, search.words(F.col("permalink")), F.col("permalink"))


def find(index: DataFrame, text: str | None = None, permalink: str | None = None, permalink_match: str | None = None, title: str | None = None, types: list[str] | None = None, kinds: list[str] | None = None, after: datetime.datetime | None = None, project: int | None = None, metadata: dict | None = None, tags: list[str] | None = None, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows of a search index (id, type, title, content, permalink, metadata as JSON, created_at, updated_at,
    project_id) that meet all that is given; none, if nothing is.

    text: boolean words and phrases over title and content, or `tag:a,b` for tags. types: of the row (entity,
    observation, relation); kinds: entity_type of its metadata. after: created later; the newest updates come first.
    """
    if text and text.strip().lower().startswith("tag:"):
        tags, text = [t for t in re.split(r"[,\s]+", text.strip()[4:].strip()) if t] or tags, None
    filters = dict(metadata or {})
    if tags:
        filters.setdefault("tags", tags)
    if status:
        filters.setdefault("status", status)
    tests: list[Column] = []
    if text:
        both = F.concat_ws(" ", "title", "content")
        tests.append(search.match(text, search.words(both), both))
    if title:
        tests.append(search.match(title.strip(), search.words(F.col("title")), F.col("title")))
    if permalink:
        tests.append(F.col("permalink") == permalink)
    if permalink_match:
        tests.append(permalink_like(permalink_match))
    if types:
        tests.append(F.col("type").isin(types))
    if kinds:
        tests.append(F.get_json_object("metadata", "$.entity_type").isin(kinds))
    if after:
        tests.append(F.col("created_at") > F.lit(after))
    if filters:
        tests.append(search.metadata_filter("metadata", filters))
    if not tests:
        return index.limit(0)
    out = index if project is None else index.where(F.col("project_id") == project)
    for t in tests:
        out = out.where(F.coalesce(t, F.lit(False)))
    if limit is None and not offset:
        return out
    order = [F.desc("updated_at"), "type", "id"] if after else ["type", "id"]
    out = out.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def since(timeframe: str, now: datetime.datetime) -> datetime.datetime:
    """Start of a timeframe such as today, yesterday, 7d, 24h, `2 weeks ago`, `last month` or a date; a day at least, a year at most."""
    t = timeframe.strip().lower()
    if m := re.fullmatch(r"(?:last|(\d+))\s*([a-z]+?)s?(?:\s+ago)?", t):
        if m[2] not in DAYS:
            raise ValueError(f"not a timeframe: {timeframe!r}")
        start = now - datetime.timedelta(days=int(m[1] or 1) * DAYS[m[2]])
    elif t in ("today", "yesterday"):
        start = now - datetime.timedelta(days=1)
    else:
        start = datetime.datetime.fromisoformat(timeframe.strip())
    if now - start > datetime.timedelta(days=365) or start > now:
        raise ValueError("a timeframe lies in the last year")
    return min(start, now - datetime.timedelta(days=1))


def recent(index: DataFrame, timeframe: str, now: datetime.datetime, types: list[str] | None = None) -> DataFrame:
    """Rows of a search index created within the timeframe, of all types (entity, observation, relation) or some."""
    out = index.where(F.col("created_at") > F.lit(since(timeframe, now)))
    return out.where(F.col("type").isin([t.lower() for t in types])) if types else out


def related(seeds: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 1, after: datetime.datetime | None = None, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(root_id, type, id, title, depth) of the relations and entities around each seed (root_id).

    entities: id, title, created_at. relations: id, from_id, to_id, to_name, relation_type. A step leads from an
    entity to its relations (odd depths) and on to the entities at their other ends (even depths, up to 2 * depth),
    in both directions; a walk may lead back. What is reached has its least depth. after: only entities created
    since, and relations of such entities. Each level joins only what the level before has found anew.
    """
    known = entities if after is None else entities.where(F.col("created_at") >= F.lit(after))
    ends = relations.join(known.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    name = F.concat(F.col("relation_type"), F.lit(": "), F.col("to_name"))
    ways = ends.select("id", name.alias("title"), F.col("from_id").alias("at"), F.col("to_id").alias("to")).union(ends.where("to_id IS NOT NULL AND from_id <> to_id").select("id", name, F.col("to_id"), F.col("from_id")))
    front = seeds.select("root_id", F.col("root_id").alias("id")).join(known.select("id"), "id", "left_semi")
    found = []
    for d in range(1, depth + 1):
        steps = front.select("root_id", F.col("id").alias("at")).join(ways, "at")
        links = steps.select("root_id", F.lit("relation").alias("type"), "id", "title").distinct().withColumn("depth", F.lit(2 * d - 1))
        nodes = steps.select("root_id", F.col("to").alias("id")).distinct().join(known.select("id", "title"), "id").select("root_id", F.lit("entity").alias("type"), "id", "title").withColumn("depth", F.lit(2 * d))
        for old in found:
            on = ["root_id", "type", "id"]
            links, nodes = (x.join(old.select(*on), on, "left_anti") for x in (links, nodes))
        found.append(links.unionByName(nodes))
        front = nodes
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.where(F.col("type").isin(types)) if types else out
    return out if limit is None else out.orderBy("depth", "type", "id").limit(limit)


def build(index: DataFrame, entities: DataFrame, observations: DataFrame, relations: DataFrame, path: str | None = None, depth: int = 1, max_related: int | None = None, **options) -> DataFrame:
    """(root_id, part, type, id, title, depth): what a path (an exact permalink, or a pattern with *) or other options of
    `find` name (part primary), the observations of its entities, and what is related to them.

    observations: id, entity_id, category, content. No more than max_related related rows of a root.
    """
    if path is not None:
        p = path.removeprefix("memory://")
        if "*" in p:
            options["permalink_match"] = "*".join(notes.permalink_of(x) if x else "" for x in p.split("*"))
        else:
            options["permalink"] = notes.permalink_of(p)
    primary = find(index, **options)
    roots = primary.where("type = 'entity'").select(F.col("id").alias("root_id"))
    own = observations.join(roots, observations["entity_id"] == roots["root_id"]).select("root_id", F.lit("observation").alias("part"), F.lit("observation").alias("type"), "id", F.concat(F.col("category"), F.lit(": "), F.substring("content", 1, 50), F.lit("...")).alias("title"), F.lit(0).alias("depth"))
    near = related(roots, entities, relations, depth)
    if max_related is not None:
        near = near.withColumn("_r", F.row_number().over(W.partitionBy("root_id").orderBy("depth", "type", "id"))).where(F.col("_r") <= max_related).drop("_r")
    first = primary.select(F.col("id").alias("root_id"), F.lit("primary").alias("part"), "type", "id", "title", F.lit(0).alias("depth"))
    return first.unionByName(own).unionByName(near.select("root_id", F.lit("related").alias("part"), "type", "id", "title", "depth"))


def fuzzy_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """links (link_id, name, source, entity_id), as `resolve_links` gives them, with the null ones resolved by search.

    An entity is found if its title and permalink have all words of the name; the one with the fewest words wins,
    then the smallest id. Names with * are patterns, which stay null. Of an entity only the words count that some name
    asks for, and of the entities with the same ones of these only the best; they meet the names by a name's rarest word.
    """
    tokens = lambda c: F.array_sort(F.array_distinct(search.words(F.replace(c, F.lit("/"), F.lit(" ")))))
    asked = links.where("entity_id IS NULL AND NOT contains(name, '*')").select("link_id", tokens(F.col("name")).alias("_w"))
    sets = asked.select("_w").distinct()
    wanted = sets.select(F.explode("_w").alias("word")).distinct()
    es = entities.select(F.col("entity_id").alias("_e"), tokens(F.concat_ws(" ", "title", "permalink")).alias("_t"))
    words = es.select("_e", F.size("_t").alias("_n"), F.explode("_t").alias("word")).join(wanted, "word")
    kinds = words.groupBy("_e", "_n").agg(F.array_sort(F.collect_list("word")).alias("_t")).groupBy("_t").agg(F.min(F.struct("_n", "_e")).alias("_b"))
    by_word = kinds.select("_t", "_b", F.explode("_t").alias("word"))
    often = by_word.groupBy("word").agg(F.count("*").alias("_d"))
    rarest = sets.select("_w", F.explode("_w").alias("word")).join(often, "word", "left").groupBy("_w").agg(F.min(F.struct(F.coalesce("_d", F.lit(0)).alias("_d"), "word")).alias("_r")).select("_w", F.col("_r.word").alias("word"))
    held = rarest.join(by_word, "word").where(F.size(F.array_except("_w", "_t")) == 0).groupBy("_w").agg(F.min("_b").alias("_b"))
    best = asked.join(held, "_w").groupBy("link_id").agg(F.min("_b").alias("_b")).select("link_id", F.col("_b._e").alias("_found"))
    return links.join(best, "link_id", "left").withColumn("entity_id", F.coalesce("entity_id", "_found")).drop("_found")


def listing(entities: DataFrame, folder: str = "/", depth: int = 1, pattern: str | None = None) -> DataFrame:
    """(path, type, name) of the folders and files below a folder, down to `depth`; with a pattern (* and ?), only what
    matches it, and what stands in folders that match."""
    base = "/" + folder.removeprefix("./").strip("/")
    parts = F.filter(F.split("file_path", "/"), lambda x: x != "")
    skip = len([x for x in base.split("/") if x])
    inside = entities.select(parts.alias("p")).where(F.slice("p", 1, skip) == F.array(*[F.lit(x) for x in base.split("/") if x]) if skip else F.lit(True)).where(F.size("p") > skip)
    level = F.explode(F.sequence(F.lit(skip + 1), F.least(F.size("p"), F.lit(skip + depth)))).alias("n")
    nodes = inside.select("p", level).where(F.lit(True) if pattern is None else F.forall(F.slice("p", F.lit(skip + 1), F.col("n") - skip), lambda x: glob(x, pattern)))
    kind = F.when(F.col("n") == F.size("p"), "file").otherwise("directory")
    return nodes.select(F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("n")), "/")).alias("path"), kind.alias("type"), F.element_at("p", F.col("n")).alias("name")).distinct()


def upsert(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """entities (id, title, entity_type, permalink, file_path, checksum) after notes (file_path, text) are written, with
    `change`: created, updated or same (also of those that no note touches).

    A note is an existing entity by its path, else by the permalink of its head. Title and type come from the head,
    else from the file's name and `note`; a new permalink from the head, else from the path, with -1, -2, ... where
    it is taken. Several notes of one path: the last text, by order, counts. New ids follow the largest one.
    """
    head = incoming.groupBy("file_path").agg(F.max("text").alias("text")).withColumn("f", notes.frontmatter("text"))
    meta = lambda k: F.get_json_object("f.metadata", f"$.{k}")
    stem = F.regexp_replace(F.regexp_extract("file_path", "([^/]*)$", 1), r"\.[^.]*$", "")
    new = head.select("file_path", F.coalesce(meta("title"), stem).alias("title"), F.coalesce(meta("type"), F.lit("note")).alias("entity_type"), meta("permalink").alias("own"), F.sha2("text", 256).alias("checksum"))
    by_path = entities.select("file_path", F.col("id").alias("a"))
    by_link = entities.select(F.col("permalink").alias("own"), F.col("id").alias("b"))
    known = new.join(by_path, "file_path", "left").join(by_link, "own", "left").withColumn("id", F.coalesce("a", "b")).drop("a", "b")
    changed = known.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("file_path", "title", "entity_type", "checksum", "own")).alias("n"))
    kept = entities.join(changed, "id", "left")
    pick = lambda c: F.coalesce(f"n.{c}", c).alias(c)
    change = F.when(F.col("n").isNull() | (F.col("n.checksum") == F.col("checksum")), "same").otherwise("updated")
    kept = kept.select("id", pick("title"), pick("entity_type"), F.coalesce("n.own", "permalink").alias("permalink"), "file_path", pick("checksum"), change.alias("change"))
    fresh = known.where("id IS NULL").withColumn("permalink", F.coalesce("own", notes.permalink("file_path")))
    taken = kept.groupBy("permalink").agg(F.count("*").alias("_t"))
    turn = F.row_number().over(W.partitionBy("permalink").orderBy("file_path")) - 1
    fresh = fresh.withColumn("_i", turn).join(taken, "permalink", "left").withColumn("_r", F.col("_i") + F.coalesce("_t", F.lit(0)))
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # Numbers run on from one bucket of paths to the next, so that no task has to see all new notes.
    fresh = fresh.withColumn("_b", F.pmod(F.xxhash64("file_path"), F.lit(BUCKETS)))
    before = fresh.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_c", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(W.partitionBy("_b").orderBy("file_path")) + F.col("_c") + F.col("_top")
    created = fresh.join(F.broadcast(before), "_b").crossJoin(F.broadcast(top)).select(
        number.cast(entities.schema["id"].dataType).alias("id"), "title", "entity_type",
        F.when(F.col("_r") > 0, F.concat_ws("-", "permalink", F.col("_r").cast("string"))).otherwise(F.col("permalink")).alias("permalink"),
        "file_path", "checksum", F.lit("created").alias("change"),
    )
    return kept.unionByName(created)


def file_name(name: Column) -> Column:
    """A name as part of a path: runs of spaces and punctuation as _, other marks dropped, 100 characters at most."""
    # The two patterns and the length.
    plain = F.regexp_replace(F.regexp_replace(name, r"[\s\-,.:/\\\[\]\(\)]+", "_"), r"[^\p{L}\p{N}_]+", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 100), F.lit("")), F.lit("untitled"))


def project_export(lines: DataFrame, folder: str = "") -> DataFrame:
    """Notes of exported projects (value: one JSON project a row): permalink, type, title, created, modified, content,
    project_name. Each document of a project is one, and its prompt template, if it has one."""
    doc = "array<struct<uuid:string,filename:string,content:string,created_at:string>>"
    j = lambda k: F.get_json_object("value", f"$.{k}")
    p = lines.select(j("name").alias("project_name"), j("created_at").alias("_c"), j("updated_at").alias("modified"), j("prompt_template").alias("_p"), F.from_json(j("docs"), doc).alias("_d"))
    at = F.concat_ws("/", F.nullif(F.lit(folder), F.lit("")), file_name(F.col("project_name")))
    docs = p.withColumn("d", F.explode("_d")).select(F.concat_ws("/", at, F.lit("docs"), file_name(F.col("d.filename"))).alias("permalink"), F.lit("project_doc").alias("type"), F.col("d.filename").alias("title"), F.coalesce("d.created_at", "_c").alias("created"), "modified", F.col("d.content").alias("content"), "project_name")
    prompts = p.where("_p <> ''").select(F.concat_ws("/", at, F.lit("prompt-template")).alias("permalink"), F.lit("prompt_template").alias("type"), F.concat(F.lit("Prompt Template: "), F.col("project_name")).alias("title"), F.col("_c").alias("created"), "modified", F.concat(F.lit("# Prompt Template: "), F.col("project_name"), F.lit("\n\n"), F.col("_p")).alias("content"), "project_name")
    return docs.unionByName(prompts)
