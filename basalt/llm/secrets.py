"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stage

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: (kind, pattern, group whose length counts, its least length). Base kinds, in the order of ties.
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))
#: Further candidates; their spans count only where corpus-wide ownership marks them as live.
MORE = (
    ("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("url", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{6,128}@", 0, 0),
    ("bearer", r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 0),
)


#: Matches whose positions are summed up together.
BLOCK = 256


def spans(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Array of struct(start, rank, kind, end, value) of the leftmost non-overlapping matches, in code points.

    One lazy gap in front of each match gives its distance from the match before; sums of both are positions.
    The rest of the text is a gap too (its match is empty and dropped), else it would be searched anew from each
    of its characters. Only texts that match at all pay for the extraction. Sums run within blocks of matches,
    whose own starts are summed up first, so that no array grows by one match at a time.
    """
    value = group + 2 if group else 2  # groups of the pattern move by two
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps = F.regexp_extract_all(text, whole, F.lit(1))
    found = F.regexp_extract_all(text, whole, F.lit(2))
    values = F.regexp_extract_all(text, whole, F.lit(value)) if group else found
    rows = F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v"))
    kind_of = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"
    long = lambda x: F.lit(x).cast("long")
    size = lambda x: (F.char_length(x["g"]) + F.char_length(x["m"])).cast("long")

    def step(acc, x):
        a = (acc["at"] + F.char_length(x["g"])).cast("long")
        b = (a + F.char_length(x["m"])).cast("long")
        one = F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), b.alias("end"), x["v"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.char_length(x["v"]) >= max(least, 1), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(kind_of).alias("out"))

    def placed(all_):
        part = lambda b: F.slice(all_, b * BLOCK + 1, BLOCK)
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(BLOCK)).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), long(0), lambda acc, x: acc + size(x)))
        begin = F.struct(long(0).alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(sums, begin, lambda acc, n: F.struct((acc["at"] + n).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        inside = lambda b, at: F.aggregate(part(b), F.struct(at.cast("long").alias("at"), F.array().cast(kind_of).alias("out")), step)["out"]
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("at")), lambda x: inside(x["b"], x["at"])))

    once = F.transform(F.array(rows), placed)[0]  # binds the matches, so that they are found once
    return F.when(text.rlike(pattern), once).otherwise(F.array().cast(kind_of))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of rows (hash, owner, repo): distinct owners and repositories of each value.

    Three aggregations, each combined before its shuffle: a value in a third of all rows is spread by owner and
    repository first.
    """
    pairs = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def contents(candidates: DataFrame) -> DataFrame:
    """(hash, owner, repo) of rows that also have _ta and _tb: of equal texts only the first, by repository."""
    return candidates.groupBy("hash", "_ta", "_tb").agg(F.min(F.struct("repo", "owner")).alias("x")).select("hash", "x.owner", "x.repo")


def scan(docs: DataFrame, max_owners: int = 1, max_repos: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", by_content: bool = False) -> DataFrame:
    """One row per document: doc_id, base and found (arrays of spans with values), n_live, n_example.

    Values of all candidates are hashed and counted over the corpus by distinct owners (owner_col; a null is an
    owner of its own) and repositories (repo_col). A value with at most max_owners owners and max_repos
    repositories is owner-specific and looks live; others are widely copied examples. Base spans always stay in
    found; further kinds join them where they look live. n_live and n_example count the document's candidates.

    With by_content, exact copies of a document count as one, for the owner and repository of the first: a leak
    does not look like an example because its document was copied.

    Null and empty texts have no spans. Repeated rows give one row each, and count once per owner and
    repository. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*[spans(text, k, p, g, n, i) for i, (k, p, g, n) in enumerate(BASE)]))
    more = F.array_sort(F.concat(*[spans(text, k, p, g, n, len(BASE) + i) for i, (k, p, g, n) in enumerate(MORE)]))
    hashed = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), F.substring(F.sha2(x["value"], 256), 1, 32).alias("hash"))
    rows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0null")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("\0null")).alias("repo"), F.transform(base, hashed).alias("base"), F.transform(more, hashed).alias("more"), *([F.xxhash64(text).alias("_ta"), F.xxhash64(F.lit(17), text).alias("_tb")] if by_content else [])),
        "secrets-spans",
    )
    some = F.size("base") + F.size("more") > 0
    name = ["_ta", "_tb"] if by_content else []
    each = rows.where(some).withColumn("_r", F.xxhash64("doc_id", "owner", "repo", "base", "more", *name)).withColumn("_k", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")))
    flat = each.groupBy("_k", "_r", "owner", "repo", "base", "more", *name).agg(F.count("*").alias("_copies"))
    held = flat.select("_k", "_r", "owner", "repo", *name, F.explode(F.concat("base", "more")).alias("x")).select("_k", "_r", "owner", "repo", *name, F.col("x.hash").alias("hash"), "x")
    stats = ownership(contents(held) if by_content else held.select("hash", "owner", "repo"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = held.join(stats, "hash").groupBy("_k", "_r").agg(
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"),
        F.array_sort(F.collect_list(F.when(live & (F.col("x.rank") >= len(BASE)), F.col("x")))).alias("added"),
    )
    kind = rows.schema["base"].dataType
    with_any = each.join(judged, ["_k", "_r"]).select("doc_id", "base", F.array_sort(F.concat("base", F.col("added").cast(kind))).alias("found"), "n_live", "n_example")
    without = rows.where(~some).select("doc_id", "base", F.col("base").alias("found"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return with_any.unionByName(without)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), by_content=True)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "n_live", "n_example")


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """One kind's matches in SQL: its gaps, matches and values, as `spans` takes them."""
    whole = rf"(?s)(.*?)(?:({pattern})|\z)".replace("'", "''")
    every = lambda g: f"regexp_extract_all(t, '{whole}', {g})"
    return f"SELECT r, {rank} AS rank, '{kind}' AS kind, {max(least, 1)} AS least, unnest({every(1)}) AS g, unnest({every(2)}) AS m, unnest({every(group + 2 if group else 2)}) AS v, generate_subscripts({every(1)}, 1) AS i FROM d"


OP3_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1) || 'null') AS owner, coalesce(doc_id::VARCHAR, chr(1) || 'null') AS repo, coalesce(text, '') AS t FROM documents),\nm AS ("
    + "\nUNION ALL ".join(_matches(i, *kind) for i, kind in enumerate(BASE + MORE))
    + f"""),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS b FROM m),
s AS (SELECT r, rank, kind, (b - length(m))::BIGINT AS a, b::BIGINT AS b, v FROM p WHERE length(v) >= least),
c AS (SELECT v, t, min((repo, owner)) AS x FROM s JOIN d USING (r) GROUP BY v, t),
o AS (SELECT v, count(DISTINCT x[2]) AS owners, count(DISTINCT x) AS repos FROM c GROUP BY v),
j AS (SELECT s.*, owners <= 1 AND repos <= 3 AS live, kind || ':' || a || ':' || b AS name FROM s JOIN o USING (v)),
q AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(name, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(name, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)} OR live) AS found,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(found, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN q USING (r)"""
)
