"""Ranked full-text search from postings with positions: terms, prefixes, phrases, and, or, not."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import occurrences

#: Fixed values of the ranking: the weight of plain text, the limit of 1 + 1/4 + 1/9 + ..., the shape of nearness, and
#: how far words may stand apart to count as near.
WEIGHT, LIMIT, NEAR = 0.1, 1.64493406685, 100


def index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, id, positions from 1), written by each task in the order of the terms, so that a query reads the
    pages of its terms alone."""
    lists = occurrences(docs, id_col, text_col).drop("n")
    lists.sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def prepare(text: str) -> str:
    """A user's search as a query: AND, OR and NOT between words become operators; else each word is a prefix and all are asked for. A word that ends in * is a prefix."""
    text = text.strip()
    if re.search(r"(^| )(AND|OR|NOT) ", text):
        for word, sign in (("AND NOT", "& !"), ("AND", "&"), ("OR", "|"), ("NOT", "& !")):
            text = re.sub(rf"\b{word}\b\s*" if "NOT" in word else rf"\b{word}\b", sign, text)
        text = re.sub(r"^\s*&\s*|(?<=\()\s*&\s*", "", text)
        return re.sub(r"(?<!:)\*", ":*", text)
    if "*" in text:
        return re.sub(r"(?<!:)\*", ":*", text)
    return " & ".join(f"{w}:*" for w in re.split(r"[\s&|!():]+", text) if w)


def parse(query: str) -> tuple:
    """Nested ("term", word, prefix), ("not", x), ("and", x, y), ("or", x, y), ("phrase", x, y, distance); or binds least, then
    and, then <-> and <n>, then not."""
    parts = re.findall(r"<-?\d*-?>|[&|!()]|[^\s&|!()<]+", query)
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def atom():
        x = take() if peek() else ""
        if x == "!":
            return ("not", atom())
        if x == "(":
            inner = level(0)
            if peek() == ")":
                take()
            return inner
        word, _, flags = x.partition(":")
        if not re.search(r"\w", word):
            raise ValueError(f"no word where one is asked for: {query}")
        return ("term", word.lower(), "*" in flags)

    def level(n: int):
        if n == 2:
            out = atom()
            while (p := peek()) and p.startswith("<"):
                take()
                out = ("phrase", out, atom(), int(re.sub(r"\D", "", p) or 1))
            return out
        sign, name = (("|", "or"), ("&", "and"))[n]
        out = level(n + 1)
        while peek() == sign:
            take()
            out = (name, out, level(n + 1))
        return out

    return level(0)


def terms_of(tree: tuple) -> list[tuple[str, bool]]:
    if tree[0] == "term":
        return [tree[1:]]
    return sorted({t for x in tree[1:] if isinstance(x, tuple) for t in terms_of(x)})


def _condition(term: Column, word: str, prefix: bool) -> Column:
    return F.startswith(term, F.lit(word)) if prefix else term == F.lit(word)


def _ends(tree: tuple, lists: dict) -> Column:
    """Positions at which a term or phrase ends."""
    if tree[0] == "term":
        return lists[tree[1:]]
    if tree[0] != "phrase":
        raise ValueError("a phrase is of words and phrases")
    moved = F.transform(_ends(tree[1], lists), lambda p: p + F.lit(tree[3]))
    return F.array_intersect(_ends(tree[2], lists), moved)


def _holds(tree: tuple, lists: dict) -> Column:
    if tree[0] in ("term", "phrase"):
        return F.size(_ends(tree, lists)) > 0
    if tree[0] == "not":
        return ~_holds(tree[1], lists)
    x, y = _holds(tree[1], lists), _holds(tree[2], lists)
    return x & y if tree[0] == "and" else x | y


def _without(tree: tuple) -> bool:
    """Whether a document without any of the terms matches."""
    if tree[0] in ("term", "phrase"):
        return False
    if tree[0] == "not":
        return not _without(tree[1])
    x, y = _without(tree[1]), _without(tree[2])
    return (x and y) if tree[0] == "and" else (x or y)


@F.pandas_udf(T.DoubleType())
def nearness(places: pd.Series) -> pd.Series:
    """1 - product of (1 - nearness) over the places up to NEAR apart of every two of a document's terms; null without any.
    Each place looks only at those within reach, a few thousand places at a time."""

    def one(terms) -> float | None:
        terms, total, any_ = [np.asarray(t, np.int64) for t in terms], 0.0, False
        for i, p in enumerate(terms):
            for q in terms[:i]:
                for at in range(0, len(p), 4096):
                    x = p[at : at + 4096]
                    lo, hi = np.searchsorted(q, x - NEAR), np.searchsorted(q, x + NEAR, "right")
                    n = hi - lo
                    other = q[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    gap = np.abs(np.repeat(x, n) - other)
                    gap = gap[gap > 0]
                    any_ |= len(gap) > 0
                    total += np.log(1 - np.sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * np.exp(gap / 1.5 - 2)))).sum()
        return 1 - np.exp(total) if any_ else None

    return places.map(one).astype("float64")


def search(postings: DataFrame, query: str, docs: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of the documents that match. docs: all ids, needed where a document without any of the terms matches.

    The score is that of ranked full-text search in relational databases, for text of one weight. A query whose last
    operator is OR, or a single term, sums for each matching word 1 + 1/4 + 1/9 + ... over its occurrences, over the
    number of terms. An AND or a phrase combines, for every two of its terms, the nearness of any two of their places up
    to 100 words apart (beyond, nearness is 1e-15): 1 - product of (1 - nearness). Only the postings of the query's terms are
    read.
    """
    tree = parse(query)
    terms = terms_of(tree)
    any_ = F.lit(False)
    for t in terms:
        any_ = any_ | _condition(F.col("term"), *t)
    # Rows of the same id are one document.
    mine = postings.where(any_).groupBy("term", id_col).agg(F.flatten(F.collect_list("positions")).alias("positions"))
    given = [_condition(F.col("term"), *t) for t in terms]
    held = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(c, F.col("positions"))))))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.size("positions")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    sums = [F.sum(F.when(c, harmonic).otherwise(0.0)).alias(f"_s{i}") for i, c in enumerate(given)]
    rows = mine.groupBy(id_col).agg(*[held(c).alias(f"_p{i}") for i, c in enumerate(given)], *sums)
    lists = {t: F.col(f"_p{i}") for i, t in enumerate(terms)}
    found = rows.where(_holds(tree, lists))
    if tree[0] in ("and", "phrase") and len(terms) > 1:
        scores = nearness(F.array(*[F.col(f"_p{i}") for i in range(len(terms))]))
        out = found.select(id_col, F.coalesce(F.nanvl(scores, F.lit(None)), F.lit(WEIGHT * 1e-15)).alias("score"))
    else:
        total = F.lit(0.0)
        for i in range(len(terms)):
            total = total + F.col(f"_s{i}")
        out = found.select(id_col, (total * (WEIGHT / LIMIT / len(terms))).alias("score"))
    if _without(tree):
        if docs is None:
            raise ValueError("a query that documents without its terms match needs all ids")
        out = out.unionByName(docs.select(id_col).join(rows.select(id_col), id_col, "left_anti").withColumn("score", F.lit(0.0)))
    return out


def best(found: DataFrame, k: int, offset: int = 0, id_col: str = "doc_id") -> DataFrame:
    """A page of results: highest score first, ties by id."""
    order = [F.desc("score"), F.col(id_col)]
    top = found.orderBy(*order).limit(offset + k)
    return top.withColumn("_r", F.row_number().over(W.orderBy(*order))).where(F.col("_r") > offset).drop("_r") if offset else top
