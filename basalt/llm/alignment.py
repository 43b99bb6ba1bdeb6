"""Cross-tokenizer alignment: groups and links of two tokenizations, by higher-order functions over their end arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import few, lean, small_batches, stage
from .units import byte_ids, parts, piece_ids

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A token's number is its start << START | its id << SIDE (of the first tokenization) or its id; ids stay below 1 << SIDE.
START, SIDE = 40, 20
LOW, PAIR = (1 << SIDE) - 1, (1 << START) - 1
#: Characters of a part of a text, which is a row of its own.
PART = 1 << 17
#: Pairs of which the counts are broadcast: all if they are no more, else the most frequent ones.
PAIRS = 500_000


def tokenised(docs: DataFrame, a: str = A, b: str = B, part: int = PART) -> DataFrame:
    """docs (doc_id, _r, text) -> doc_id, _r, part (from 0), parts, and the tokens of a space and the text by a byte-level
    file (a) and a sentencepiece model (b): how many they are (n_a, n_b), their ends in bytes from the part's beginning,
    those that both have (cut) and those of one side (rest), and for each byte, from 1 on, the number of the token of the
    first that covers it (a), and what it has other bits in than that of the second (ab).

    Long texts are cut where neither tokenizer has a token across, so that a row's arrays are bounded; with other
    models, and in stretches without spaces, they stay whole. A text that is null or empty, or isn't what the tokens of
    either spell, has one part without tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [("a", np.int64), ("ab", np.int64), ("cut", np.int32), ("rest", np.int32)]

    def run(batches):
        import pyarrow as pa

        first, first_width, first_apart = byte_ids(a, True)
        second, second_width, second_apart = piece_ids(b)
        none = [(0, 0, tuple(np.zeros(0, t) for _, t in columns))]

        def numbered(ids, width, shift):
            size = width[ids]
            end = np.cumsum(size, dtype=np.int32)
            start = (end - size).astype(np.int64) & ((1 << 23) - 1)  # enough to tell a group's tokens apart
            return np.concatenate([np.zeros(1, np.int64), np.repeat(start << START | ids.astype(np.int64) << shift, size)]), end

        def of(text: str | None) -> list[tuple]:
            if not text or "▁" in text:  # the mark of a space in b: not what the text says
                return none
            out = []
            for p in parts(" " + text, part) if first_apart and second_apart else [" " + text]:
                (x, x_end), (y, y_end), size = numbered(first(p), first_width, SIDE), numbered(second(p[1:]), second_width, 0), len(p.encode())
                if any(not len(z) or z[-1] != size for z in (x_end, y_end)):
                    return none
                in_x, in_y = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
                in_x[x_end] = in_y[y_end] = True
                out.append((len(x_end), len(y_end), (x, x ^ y, x_end[in_y[x_end]], np.flatnonzero(in_x ^ in_y).astype(np.int32))))
            return out

        for batch in batches:
            held, size = [], 0

            def rows():
                ids, r, at, n, n_a, n_b, cols = zip(*held, strict=True)
                lists = []
                for each in zip(*cols, strict=True):
                    off = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(each))))
                return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(r, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), *lists], names=["doc_id", "_r", "part", "parts", "n_a", "n_b", *(c for c, _ in columns)])

            for i, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = of(text.as_py())
                for k, (n_a, n_b, cols) in enumerate(got):
                    held.append((i, r, k, len(got), n_a, n_b, cols))
                    size += len(cols[0])
                    if size > 1 << 17:
                        yield rows()
                        held, size = [], 0
            if held:
                yield rows()

    lists = ", ".join(f"{c} array<{'bigint' if t is np.int64 else 'int'}>" for c, t in columns)
    return docs.select("doc_id", "_r", "text").mapInArrow(lean(run), f"doc_id {kind}, _r long, part int, parts int, n_a long, n_b long, {lists}")


def aligned(tokens: DataFrame) -> DataFrame:
    """One row per part: doc_id, _r, part, parts, n_a, n_b, n_groups, groups (text), links (pairs, as id of a << SIDE | id
    of b, below bits that are to be masked by PAIR).

    Where a token of either side ends, the tokens of both that cover this byte overlap, and each overlap has one such
    place: the ends of both give the links. Where both sides end, a group does. If its two last tokens begin at one place
    (the numbers differ in their ids only) they are the group; else its tokens are the distinct ones of its bytes. All is
    linear in the bytes.
    """

    def built(v: Column) -> Column:  # v binds what every step reads
        both = lambda e: F.get(v["ab"], e)

        def ids(side, shift, i):
            e, before = F.get(v["cut"], i), F.when(i == 0, F.lit(0)).otherwise(F.get(v["cut"], i - 1))
            of = lambda k: F.slice(v[k], before + 2, e - before)
            own = of("a") if side == "a" else F.zip_with(of("a"), of("ab"), lambda x, y: x.bitwiseXOR(y))
            return F.array_join(F.transform(F.array_distinct(own), lambda t: F.shiftright(t, shift).bitwiseAND(F.lit(LOW)).cast("string")), ",")

        def group(w, i):
            one = F.concat(F.shiftright(w, SIDE).cast("string"), F.lit("|"), w.bitwiseAND(F.lit(LOW).cast("long")).cast("string"))
            return F.when(w < F.lit(1 << START), one).otherwise(F.concat(ids("a", SIDE, i), F.lit("|"), ids("b", 0, i)))

        def told(at):
            return F.struct(F.array_join(F.transform(at, group), ";").alias("groups"), F.concat(at, F.transform(v["rest"], both)).alias("links"))

        return F.transform(F.array(F.transform(v["cut"], both)), told)[0]

    out = tokens.select("doc_id", "_r", "part", "parts", "n_a", "n_b", F.size("cut").cast("long").alias("n_groups"), F.transform(F.array(F.struct("a", "ab", "cut", "rest")), built)[0].alias("o"))
    return out.select("doc_id", "_r", "part", "parts", "n_a", "n_b", "n_groups", "o.groups", "o.links")


def pairs_of(links: DataFrame, *keep: str) -> DataFrame:
    return links.select(*keep, F.explode("links").alias("pair")).withColumn("pair", F.col("pair").bitwiseAND(F.lit(PAIR)))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), best (n is the highest of its id of b): counted by tasks first; the highest are
    a row for each id of b, which a vocabulary bounds."""
    counts = stage(pairs_of(links).groupBy("pair").agg(F.count("*").alias("n")), "align-pairs")
    other = F.col("pair").bitwiseAND(F.lit(LOW))
    top = counts.groupBy(other.alias("_b")).agg(F.max("n").alias("_top"))
    out = counts.join(F.broadcast(top), other == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_top")).cast("long").alias("best"))
    out._rows = getattr(counts, "_rows", None)
    return out


def sums(links: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """_r, n_links, n_best, count_sum of each row with links. Counts of up to `most` pairs are broadcast. Beyond that the
    pairs that make at least one in `most` of all links are, of which there can be no more, and links of the others,
    none of them frequent, are counted in their document and shuffled."""
    each = pairs_of(links, "_r")
    total = lambda n: [F.sum(n).alias("n_links"), F.sum(F.col("best") * n).alias("n_best"), F.sum(F.col("n") * n).alias("count_sum")]
    if few(counts, most):
        return each.join(F.broadcast(counts), "pair").groupBy("_r").agg(*total(F.lit(1).cast("long")))
    least = counts.agg(F.sum("n")).first()[0] / most
    often, seldom = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    known = each.join(F.broadcast(often.withColumn("_often", F.lit(True))), "pair", "left")
    some = known.where("_often").groupBy("_r").agg(*total(F.lit(1).cast("long")))
    rare = known.where("_often IS NULL").groupBy("_r", "pair").agg(F.count("*").alias("_m"))
    rest = rare.join(seldom.hint("merge"), "pair").groupBy("_r").agg(*total(F.col("_m")))
    return some.unionByName(rest).groupBy("_r").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def align(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text", part: int = PART, most: int = PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (text such as
    `a1,a2|b1;a3|b2,b3`, null if the text is one part: only its hash is kept).

    The text and a space before it are encoded without special tokens, their strings being plain text. Places where tokens
    of both sides end cut them into groups. Links are the pairs of tokens whose bytes overlap; a pair of ids counts as
    often as links of the corpus hold it, and n_best are the links whose count is the highest of their id of b.

    Null and empty texts, and texts that the tokens of a side don't spell (such as one with the mark of spaces of b),
    have zeros and an empty groups_sha256. Repeated rows count each; null ids stay; other columns are ignored; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_r", F.monotonically_increasing_id())
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    # What only whole texts need is dropped at once where a part is the whole text.
    rows = stage(aligned(tokenised(base, a, b, part)).withColumns({"groups_sha256": sha, "groups": F.when(F.col("parts") > 1, F.col("groups"))}), "align-parts")
    one = rows.where("parts = 1").select("_r", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")
    many = rows.where("parts > 1").groupBy("_r").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "groups"))), lambda x: x["groups"]), ";").alias("groups"))
    whole = one.unionByName(many.withColumn("groups_sha256", F.sha2("groups", 256)))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_links", "n_best", "count_sum")}
    return whole.join(sums(rows, pair_counts(rows), most), "_r", "left").withColumns(zero).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("groups")
