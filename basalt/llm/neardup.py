"""MinHash near-dedup: DartMinHash signatures of weighted word shingles, banded candidates, exact verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import LITTLE, NON_SPACE, chunks, doc_key, few, hash_words, lean, mix, stage, tight, united, utf8, word_offsets, words_of, small_batches

SHINGLE, BANDS, ROWS = 5, 30, 6
K = BANDS * ROWS
#: Buckets of up to so many contents compare pairs of different classes as rows; larger ones in cells of blocks.
SMALL, BLOCK, ELEMENTS = 16, 200, 1_000_000
#: Most rows of a key set that is broadcast after counting it; a larger one is shuffled.
KEYS = 1_000_000
_ODD = np.uint64(0xD1B54A32D192ED03)


def elements(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): each text's shingles of five words, numbered by occurrence, as 64-bit hashes.

    The j-th occurrence of a shingle is an element of its own, a unit cell of the shingle's weight, so that the
    set similarity of elements is the weighted one of shingles. A text of fewer words, but not none, has one.
    """
    n = len(off) - 1
    s, e, row = words_of(raw, off, NON_SPACE)
    h = hash_words(raw, s, e)
    wo = word_offsets(row, n)
    count = np.diff(wo)
    many = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    at = np.repeat(wo[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    owner = np.repeat(np.arange(n), many)
    total = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        there = np.minimum(at + j, max(len(h) - 1, 0))
        inside = at + j < wo[owner + 1]
        total = total * _ODD + np.where(inside, h[there] if len(h) else np.uint64(0), np.uint64(0))
    total = mix(total + np.uint64(1))
    total = total[np.lexsort((total, owner))]  # owners stay in order
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    run = np.arange(len(total)) - np.repeat(first, np.diff(np.append(first, len(total))))
    cell = mix(total + run.astype(np.uint64) * _ODD)
    return cell, np.concatenate([[0], np.cumsum(many)])


#: 16-bit thresholds of a Poisson variable of mean 1.
_POISSON = np.array([int(65536 * p) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)], np.uint64)


def signatures(cell: np.ndarray, off: np.ndarray, k: int = K) -> np.ndarray:
    """DartMinHash: text x k signature (uint32).

    Darts are a Poisson process of rate 1 over weight and rank: the unit square of a cell and a step of rank gets
    Poisson(1) darts, all hashed from the two, each with its rank and a coordinate. A text of weight w throws
    those of rank below t / w, t = k (ln k + 2), and keeps the earliest of each coordinate; if a coordinate
    stays empty, the text's limit doubles. Time is that of w + t per text, whatever k is.
    """
    n = len(off) - 1
    out = np.zeros((n, k), np.uint32)
    size = np.diff(off)
    limit = np.zeros(n)
    limit[size > 0] = k * (np.log(k) + 2) / size[size > 0]
    todo = np.flatnonzero(size)
    while len(todo):
        again = []
        for a in range(0, len(todo), 512):
            rows = todo[a : a + 512]
            steps = np.ceil(limit[rows]).astype(np.int64)
            mine = np.concatenate([cell[off[r] : off[r + 1]] for r in rows])
            each = np.repeat(np.arange(len(rows)), size[rows])
            reps = steps[each]
            i = np.repeat(np.arange(len(mine)), reps)
            u = np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
            square = mix(mine[i] + u.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            darts = np.searchsorted(_POISSON, square & np.uint64(65535), "right")
            d = np.repeat(np.arange(len(i)), darts)
            if not len(d):
                again.append(rows)
                continue
            nth = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
            x = mix(square[d] + (nth.astype(np.uint64) + np.uint64(1)) * _ODD)
            rank = (u[d].astype(np.uint64) << np.uint64(32)) | (x >> np.uint64(32))
            row = each[i[d]]
            ok = rank < (limit[rows][row] * 4294967296.0).astype(np.uint64)
            slot = row[ok].astype(np.uint64) * np.uint64(k) + (x[ok] & np.uint64(0xFFFFFFFF)) % np.uint64(k)
            key = np.sort((slot << np.uint64(45)) | rank[ok])
            slot = key >> np.uint64(45)
            first = np.ones(len(key), bool)
            first[1:] = slot[1:] != slot[:-1]
            part = np.zeros(len(rows) * k, np.uint32)
            part[slot[first].astype(np.int64)] = (mix(key[first] & np.uint64((1 << 45) - 1)) | np.uint64(1)).astype(np.uint32)
            part = part.reshape(len(rows), k)
            out[rows] = part
            again.append(rows[(part == 0).any(1)])
        todo = np.concatenate(again)
        limit[todo] *= 2
    return out


def _content(cell: np.ndarray, off: np.ndarray) -> list[bytes]:
    """128-bit name of each text's elements."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(cell)])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix(cell + _ODD))])
    names = np.stack([a[off[1:]] - a[off[:-1]], b[off[1:]] - b[off[:-1]]], 1)
    return [x.tobytes() for x in names]


def sketch(docs: DataFrame) -> DataFrame:
    """docs (doc_id, _k, _h, text) -> doc_id, _k, _h, n (elements), c (name of the content), bands."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = utf8(batch.column(3))
            for a, b in chunks(off):
                cell, at = elements(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                sig = signatures(cell, at).reshape(b - a, BANDS, ROWS).astype(np.uint64)
                h = np.zeros((b - a, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    h = mix(h * _ODD + sig[:, :, j])
                n = np.diff(at)
                rows = [h[i].astype(np.int64).tolist() if n[i] else [] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, b - a) for j in range(3)), pa.array(n), pa.array(_content(cell, at), pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "_k", "_h", "n", "c", "bands"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _k long, _h long, n long, c binary, bands array<long>")


def semi(rows: DataFrame, keys: DataFrame, on: list[str], most: int = KEYS, how: str = "left_semi") -> DataFrame:
    """rows with a match in keys (left_anti: without). The keys are counted; up to `most` are broadcast, more are shuffled."""
    return rows.join(F.broadcast(keys) if few(keys, most) else keys.hint("merge"), on, how)


def element_sets(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(c, x): the elements of the contents in names (c, _k, _h), read from one document of each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in chunks(off):
                cell, at = elements(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                sets = [np.sort(cell[at[i] : at[i + 1]]).view(np.int64) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(_content(cell, at), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "x"])

    return semi(docs, names.select("_k", "_h"), ["_k", "_h"]).select("text").mapInArrow(lean(run), "c binary, x array<bigint>")


def components(edges: DataFrame, old: DataFrame | None) -> DataFrame:
    """(c, label): the smallest name in each vertex's component of the edges (a, b), from earlier labels on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("d")), F.struct(F.col("b").alias("c"), F.col("a").alias("d")))).alias("x"))
    ends._rows = None if (n := getattr(edges, "_rows", None)) is None else 2 * n
    both = tight(ends).select("x.c", "x.d")
    clean = not few(ends, LITTLE)
    labels = stage(both.select("c").union(both.select("d")).distinct().withColumn("label", F.col("c")) if old is None else both.select("c").distinct().join(old, "c", "full_outer").select("c", F.coalesce("label", "c").alias("label")), "near-labels", clean)
    while True:
        labels = tight(labels)
        near = both.join(labels.withColumnRenamed("c", "d"), "d").groupBy("c").agg(F.min("label").alias("other"))
        mine = labels.join(near, "c", "left").select("c", "label", F.least("label", F.coalesce("other", "label")).alias("low"))
        # All vertices of an old class follow its lowest, then each label is replaced by its own vertex's.
        down = mine.groupBy("label").agg(F.min("low").alias("low"))
        once = mine.select("c", "label").join(down, "label").select("c", "label", F.col("low").alias("next"))
        jump = once.join(once.select(F.col("c").alias("next"), F.col("next").alias("far")), "next", "left")
        new = stage(jump.select("c", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("was")), "near-labels", clean)
        changed = not new.where("label <> was").limit(1).isEmpty()
        labels = new.select("c", "label")
        labels._rows = new._rows
        if not changed:
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of contents whose element sets reach the threshold, exactly."""
    sim = pairs.join(sets.select(F.col("c").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("c").alias("b"), F.col("x").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    return sim.where(both >= F.lit(threshold) * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def overlaps(x: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets, from blocks of an incidence matrix of the elements that several hold."""
    size = np.array([len(v) for v in x])
    flat = np.concatenate(x) if len(x) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(x)), size)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    owner, at = owner[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(x), len(x)), np.float32)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        lo, hi = np.searchsorted(at, [a, a + step])
        block = np.zeros((len(x), step), np.float32)
        block[owner[lo:hi], at[lo:hi] - a] = 1
        out += block @ block.T
    return out


def _grid(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different classes in large buckets (b, c, n, label), in cells of two blocks.

    A bucket's contents are dealt to blocks of about BLOCK contents and ELEMENTS elements at most; each pair of
    blocks is a cell of its own task group, where all overlaps are one product. Of the links found a cell returns a
    spanning forest.
    """
    weight = members.join(sets.select("c", F.size("x").alias("size")), "c").groupBy("b").agg(F.sum("size").alias("weight"))
    members = members.join(weight, "b")
    n = F.greatest(F.ceil(F.col("n") / F.lit(float(BLOCK))), F.ceil(F.col("weight") / F.lit(float(ELEMENTS)))).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(31), "c"), n.cast("long")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    rows = members.select("b", "c", "label", F.explode(cells).alias("cell")).select("b", "cell.i", "cell.j", "c", "label").join(sets, "c")

    def run(pdf):
        import pandas as pd

        x = [np.asarray(v) for v in pdf["x"]]
        kinds = pd.factorize(pdf["label"])[0]
        size = np.array([len(v) for v in x], np.float32)
        both = overlaps(x)
        ok = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-3) & (kinds[:, None] != kinds[None, :])
        root = list(range(len(x)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i, j in zip(*np.nonzero(np.triu(ok)), strict=True):
            p, q = find(i), find(j)
            if p != q and both[i, j] >= threshold * (float(size[i]) + float(size[j]) - float(both[i, j])):
                root[p] = q
                out.append(sorted((pdf["c"].iat[i], pdf["c"].iat[j])))
        return pd.DataFrame({"a": [o[0] for o in out], "b": [o[1] for o in out]})

    return rows.groupBy("b", "i", "j").applyInPandas(run, "a binary, b binary")


def detailed(told: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """told (c, copies, class_p, _class, rep) with similarity, the exact one of the content to that of its class's first
    document, and n_links: verified links of the content, and its other copies."""
    pairs = told.where("c <> rep").select(F.col("c").alias("a"), F.col("rep").alias("b"))
    both = F.size(F.array_intersect("xa", "xb"))
    met = pairs.join(sets.select(F.col("c").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("c").alias("b"), F.col("x").alias("xb")), "b")
    alike = met.select(F.col("a").alias("c"), (both / (F.size("xa") + F.size("xb") - both)).alias("similarity"))
    ends = links.distinct().select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("_n"))
    out = told.join(alike, "c", "left").join(ends, "c", "left")
    return out.select("c", "class_p", "_class", F.coalesce("similarity", F.lit(1.0)).alias("similarity"), (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", details: bool = False) -> DataFrame:
    """One row per document: doc_id, _k, _h, n_shingles, _class (name of its class), class_id
    (smallest doc_id in it), kept (true once in each class: for the first document, by id, then a hash of its text)
    and, with details, similarity (exact, to that document's text, which stands for the class), n_links (links of its text that were found
    and verified, plus its exact copies; links that a class doesn't need may go unseen: see below).

    Documents are linked if the weighted Jaccard similarity of their shingles of five white-space separated
    words is at least the threshold; classes are the connected components. Equal contents are one vertex from
    the start. Candidates share one of 30 bands of 6 coordinates (a pair at 0.8 is missed with probability
    1e-4, one at 0.9 with 1e-10) and are verified exactly. In each bucket all contents are first compared with a pivot, which
    settles groups of copies around one original in linear work. Buckets that still hold several classes then
    compare all their contents of different classes, in pairs if small, else in cells of bounded blocks: no cap,
    and no pair is a row unless it is linked. What stays quadratic, in blocks, are large groups of texts that are
    nearly but not quite similar enough.

    Null and empty texts have no shingles: classes of their own. Null ids count as the largest. Repeated rows
    share their class, and one of them at most is kept. Empty tables give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    s = stage(sketch(base), "near-sketch")
    place = F.col("_k").cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.shiftrightunsigned("_h", 2)
    s = s.withColumn("_p", place.cast("decimal(38,0)"))
    content = s.where("n > 0").groupBy("c").agg(F.min("_p").alias("rp"), F.count("*").alias("copies"))
    member = s.where("n > 0").select("c", F.explode("bands").alias("b")).distinct()
    many = member.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    open_ = stage(member.join(many, "b"), "near-buckets")
    names = stage(s.join(open_.select("c").distinct().join(content, "c"), "c").where("_p = rp").select("c", "_k", "_h"), "near-names")
    sets = stage(element_sets(base.select("_k", "_h", "text"), names).dropDuplicates(["c"]), "near-sets")
    # A hub of near copies shares the largest buckets: the heaviest contents are the first pivots.
    left = stage(open_.join(open_.groupBy("c").agg(F.sum("n").alias("w")), "c").withColumn("label", F.col("c")), "near-open")
    compare = lambda pairs: _verified(pairs.distinct(), sets, threshold)
    # First every content meets the pivot of each of its buckets.
    rank = F.row_number().over(W.partitionBy("b").orderBy(F.desc("w"), "c"))
    chosen = left.select("b", F.col("c").alias("p"), rank.alias("r")).where("r <= 1").drop("r")
    star = left.join(chosen, "b").where("c <> p").select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b"))
    links = stage(compare(star), "near-links")
    labels = components(links, None)
    # Then, in buckets that still have several classes, all contents of different classes meet.
    now = left.drop("label").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    mixed = now.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("b")
    left = stage(now.where("n > 2").join(mixed, "b", "left_semi").select("b", "c", "n", "label"), "near-open")
    small = left.where(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.label") != F.col("y.label"))).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    more = stage(compare(pairs).unionByName(_grid(left.where(F.col("n") > SMALL), sets, threshold)), "near-links")
    if not few(more, 0):
        labels = components(united([links, more]), labels)
    own = labels.join(content, "c").groupBy("label").agg(F.min(F.struct("rp", "c")).alias("m")).select("label", F.col("m.rp").alias("class_p"), F.col("m.c").alias("rep"))
    # Only contents of several documents or in links have a class that isn't their only document's: as a rule they are
    # few, and no group of copies meets in one task.
    told = content.join(labels.join(own, "label"), "c", "left").where("copies > 1 OR label IS NOT NULL")
    told = stage(told.select("c", "copies", F.coalesce("class_p", "rp").alias("class_p"), F.coalesce("label", "c").alias("_class"), F.coalesce("rep", "c").alias("rep")), "near-told")
    if details:
        told = stage(detailed(told, united([links, more]), sets), "near-classes")
    told = F.broadcast(told) if few(told, KEYS // 4) else told
    alone = {"_class": F.coalesce("_class", "c")} | ({"similarity": F.coalesce("similarity", F.lit(1.0)), "n_links": F.coalesce("n_links", F.lit(0).cast("long"))} if details else {})
    rows = s.where("n > 0").join(told, "c", "left").withColumns({"class_p": F.coalesce("class_p", "_p"), **alone}).select(*s.columns, "class_p", *alone)
    none = {"_class": F.encode(F.concat_ws(":", "_k", "_h"), "utf-8"), "similarity": F.lit(1.0), "n_links": F.lit(0).cast("long")}
    rows = rows.unionByName(s.where("n = 0").withColumns({"class_p": F.col("_p"), **{k: none[k] for k in alone}}))
    class_k = F.expr(f"CAST((class_p - pmod(class_p, CAST({1 << 62} AS DECIMAL(38, 0)))) DIV {1 << 62} AS BIGINT)")
    out = rows.select("doc_id", "_k", "_h", F.col("n").alias("n_shingles"), "_class", F.when(class_k != 2**63 - 1, class_k).alias("class_id"), (F.col("_p") == F.col("class_p")).alias("kept"), *[k for k in alone if k != "_class"])
    twice = stage(s.groupBy("_k", "_h").agg(F.count("*").alias("copies")).where("copies > 1"), "near-twice")
    if few(twice, 0):
        return out
    again = semi(out, twice, ["_k", "_h"]).dropDuplicates(["_k", "_h"]).join(twice, ["_k", "_h"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return semi(out, twice, ["_k", "_h"], how="left_anti").unionByName(again.withColumn("kept", F.col("kept") & (F.col("copy") == 1)).drop("copies", "copy"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: that of the smallest id (ties: the smaller hash), once if its row is repeated.

    Rows that go are found as a set of keys; up to KEYS of them are broadcast, more are shuffled.
    """
    k, h = doc_key(id_col, text_col)
    cols = docs.columns
    kx, hx = "_k" + "_" * max(map(len, cols)), "_h" + "_" * max(map(len, cols))
    rows = stage(classes(docs, threshold, id_col, text_col).select("_k", "_h", "kept"), "near-rows")
    stay = rows.where("kept")
    gone = stage(rows.where("NOT kept").join(stay, ["_k", "_h"], "left_anti").select(F.col("_k").alias(kx), F.col("_h").alias(hx)).distinct(), "near-gone")
    twice = stage(rows.groupBy("_k", "_h").count().where("count > 1").select(F.col("_k").alias(kx), F.col("_h").alias(hx)), "near-twice")
    every = docs.select("*", k.alias(kx), h.alias(hx))
    left = semi(every, gone, [kx, hx], how="left_anti")
    if not few(twice, 0):
        left = semi(left, twice, [kx, hx], how="left_anti").union(semi(left, twice, [kx, hx]).dropDuplicates([kx, hx]))
    return left.drop(kx, hx)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), details=True).select("doc_id", "class_id", "n_shingles", "kept", "similarity", "n_links")
