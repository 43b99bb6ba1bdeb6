"""Full-text search: boolean queries, BM25, metadata filters."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.session import shared

#: Bytes of texts whose words are grouped at once.
CHUNK = 4 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and `/`."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}/]+"), lambda w: w != "")


def contains_all(query: str, *cols: str) -> Column:
    """Each token of more than one character in any of the columns, whatever the case."""
    out = F.lit(True)
    for t in [t for t in query.lower().split() if len(t) > 1]:
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))
        out = out & hit
    return out


def match(query: str, tokens: Column, text: Column) -> Column:
    """AND, OR, NOT, parentheses and "phrases"; other words must each begin some token."""
    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()]+', query)
    pos = 0

    def peek() -> str | None:
        return parts[pos] if pos < len(parts) else None

    def take() -> str:
        nonlocal pos
        pos += 1
        return parts[pos - 1]

    def atom() -> Column:
        p = take()
        if p == "NOT":
            return ~atom()
        if p == "(":
            inner = either()
            if peek() == ")":
                take()
            return inner
        if p.startswith('"') or not re.fullmatch(r"[\w/*]+", p):
            return F.coalesce(F.contains(F.lower(text), F.lit(p.strip('"').lower())), F.lit(False))
        stem = p.rstrip("*").lower()
        return F.coalesce(F.exists(tokens, lambda w: F.startswith(w, F.lit(stem))), F.lit(False))

    def every() -> Column:
        out = atom()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            out = out & atom()
        return out

    def either() -> Column:
        out = every()
        while peek() == "OR":
            take()
            out = out | every()
        return out

    return either() if parts else F.lit(True)


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, positions from 1, n): a row for each distinct word of each row of docs, whose text has n words. A text's
    words are grouped where it is read, so that no word is shuffled."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}/]+", " "))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size // CHUNK)) + 1):
                if not len(part):
                    continue
                ids, text = (batch.column(i).slice(part[0], len(part)) for i in (0, 1))
                lists = pc.split_pattern(pa.array(text.to_pylist(), pa.string()), " ")
                at = lists.offsets.to_numpy()
                doc = np.repeat(np.arange(len(part)), np.diff(at))
                coded = lists.flatten().dictionary_encode()
                key = doc * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                first = first if len(first) else np.zeros(0, np.int64)
                owner, word = doc[order[first]], coded.indices.to_numpy()[order[first]]
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(order - at[doc[order]] + 1, pa.int32()))
                out = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word)), ids.take(pa.array(owner)), places, pa.array(np.diff(at)[owner], pa.int32())], names=["term", id_col, "positions", "n"])
                yield out.filter(pc.not_equal(out.column(0), ""))

    return docs.select(F.col(id_col), spaced.alias("_t")).mapInArrow(run, f"term string, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, positions array<int>, n int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(term, id, tf, n): how often each word stands in a document of n words. With a path, written there, each task's in
    the order of the terms, so that a query reads the pages of its terms only."""
    out = occurrences(docs, id_col, text_col).select("term", id_col, F.size("positions").cast("long").alias("tf"), "n")
    if path is None:
        return out
    out.sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def terms_of(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w/]+", query.lower()) if w})


def _scored(rows: DataFrame, total: DataFrame, n_terms: int, id_col: str, k1: float, b: float) -> DataFrame:
    """Scores of rows (id, _n, _f0, ...) with one row of corpus sums (_docs, _avg, _d0, ...), broadcast."""
    score = F.lit(0.0)
    for i in range(n_terms):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    return rows.crossJoin(F.broadcast(total)).withColumn("score", score).where("score > 0").select(id_col, "score")


def bm25_of(index: DataFrame, corpus: DataFrame, query: str, id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) from `postings`; corpus: one row, n_docs and avg_n (words a document)."""
    terms = terms_of(query)
    mine = index.where(F.col("term").isin(terms))
    rows = mine.groupBy(id_col).agg(F.max("n").alias("_n"), *[F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"_f{i}") for i, t in enumerate(terms)])
    df = mine.agg(*[F.count_if(F.col("term") == t).alias(f"_d{i}") for i, t in enumerate(terms)])
    total = df.crossJoin(corpus.select(F.col("n_docs").alias("_docs"), F.col("avg_n").alias("_avg")))
    return _scored(rows, total, len(terms), id_col, k1, b)


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents with a term of the query, without an index: one pass over the texts, whose counts are
    written before the corpus sums are taken of them."""
    terms = terms_of(query)
    bag = words(F.coalesce(text_col, F.lit("")))
    among = lambda w, t: F.size(F.filter(w, lambda x: x == t))
    counts = docs.select(F.col(id_col), F.transform(F.array(bag), lambda w: F.array(F.size(w), *[among(w, t) for t in terms]))[0].alias("_c"))
    path = f"{shared(docs.sparkSession)}/bm25-{uuid.uuid4().hex}"
    counts.write.parquet(path)
    rows = docs.sparkSession.read.parquet(path).select(id_col, F.col("_c")[0].alias("_n"), *[F.col("_c")[i + 1].alias(f"_f{i}") for i in range(len(terms))])
    total = rows.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    return _scored(rows, total, len(terms), id_col, k1, b)


def metadata_filter(column: str, filters: dict) -> Column:
    """Conditions on a JSON column: equality, lists (all contained), $in, $gt, $gte, $lt, $lte, $between; dotted paths."""
    out = F.lit(True)
    for path, want in filters.items():
        value = F.get_json_object(column, "$." + path)

        def compare(op: str, x, value=value) -> Column:
            number = isinstance(x, (int, float)) and not isinstance(x, bool)
            left, right = (value.try_cast("double"), F.lit(float(x))) if number else (value, F.lit(str(x)))
            return {"$gt": left > right, "$gte": left >= right, "$lt": left < right, "$lte": left <= right}[op]

        if isinstance(want, list):
            held = F.from_json(value, "array<string>")
            for x in want:
                out = out & F.coalesce(F.array_contains(held, str(x)), F.lit(False))
        elif isinstance(want, dict):
            for op, x in want.items():
                if op == "$in":
                    out = out & value.isin([str(v) for v in x])
                elif op == "$between":
                    out = out & compare("$gte", x[0]) & compare("$lte", x[1])
                else:
                    out = out & compare(op, x)
        else:
            out = out & (value == F.lit(str(want).lower() if isinstance(want, bool) else str(want)))
    return out
