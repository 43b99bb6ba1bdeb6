"""Benchmark decontamination by a stored positional inverted index of the documents' words."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM, LOWER, chunks, doc_key, few, hash_words, lean, small_batches, stage, united, utf8, word_offsets, words_of
from .neardup import semi

#: Text of the items that are searched for at once; more items take more passes over their words' lists.
BLOCK_BYTES = 1 << 20
#: Words that one shard's index covers at most (a longer document is a shard of its own).
SHARD_WORDS = 500_000
#: op4: words of a near match may stand so far from their places, and so many may be missing.
SLOP, MISSING = 1, 1
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def postings(docs: DataFrame, gap: int = 64) -> DataFrame:
    """The index of docs (doc_id, _k, _h, text), written to the shared folder. Two kinds of rows of each shard:

    word, at: a word and its positions in the shard, ascending (int32). ord, begin, doc_id, _k, _h, n_words: a
    document and the position of its first word; `gap` positions or more lie between two documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, turn = TaskContext.get().partitionId(), 0
        held, rows, base = [], [], 0

        def spelled(low, s, e):
            """The words of some spans, as an Arrow column."""
            n = e - s
            to = np.concatenate([[0], np.cumsum(n)])
            flat = low[np.repeat(s - to[:-1], n) + np.arange(to[-1])]
            return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())

        def flush():
            nonlocal held, rows, base, turn
            shard = task << 32 | turn
            low = np.concatenate([h[0] for h in held])
            at = np.cumsum([0] + [len(h[0]) for h in held])
            s, e = (np.concatenate([h[j] + a for h, a in zip(held, at, strict=False)]) for j in (1, 2))
            h, pos = (np.concatenate([x[j] for x in held]) for j in (3, 4))
            n = len(h)
            order = np.argsort(h, kind="stable")
            s, e, h = s[order], e[order], h[order]
            # Equal hashes, lengths and first and last bytes: the same word (and if not, a list of its own each).
            new = np.ones(n, bool)
            if n:
                size = e - s
                wide = np.lib.stride_tricks.as_strided(np.frombuffer(low.tobytes() + bytes(8), np.uint8), (len(low) + 1, 8), (1, 1))
                head = np.where(np.arange(8) < size[:, None], wide[s], 0).view(np.uint64)[:, 0]
                tail = wide[np.maximum(e - 8, s)].view(np.uint64)[:, 0]
                tail = np.where(size >= 8, tail, 0)
                new[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1]) | (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
            first = np.flatnonzero(new)
            places = pos[order].astype(np.int32)
            cut = np.append(first, n) * 4
            lists = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(places.tobytes())]).cast(pa.binary())
            words, k, docs_ = spelled(low, s[first], e[first]), len(first), pa.Table.from_batches([r[0] for r in rows])
            m = docs_.num_rows
            none = lambda t, c: pa.nulls(c, t)
            begin, count = (np.concatenate([r[j] for r in rows]).astype(np.int64) for j in (1, 2))
            table = {"shard": pa.array(np.full(k + m, shard)), "word": pa.chunked_array([words, none(pa.string(), m)]), "at": pa.chunked_array([lists, none(pa.binary(), m)]), "ord": pa.chunked_array([none(pa.int32(), k), pa.array(np.arange(m, dtype=np.int32))]), "begin": pa.chunked_array([none(pa.int64(), k), pa.array(begin)]), "n_words": pa.chunked_array([none(pa.int64(), k), pa.array(count)])}
            for c in ("doc_id", "_k", "_h"):
                col = docs_[c]
                table[c] = pa.chunked_array([none(col.type, k), *col.chunks])
            held, rows, base, turn = [], [], 0, turn + 1
            yield from pa.table(table).to_batches(max_chunksize=10_000)

        for batch in batches:
            raw, off = utf8(batch.column("text"))
            for a, b in chunks(off):
                low = LOWER[raw[off[a] : off[b]]]
                s, e, row = words_of(low, off[a : b + 1] - off[a], ALNUM)
                count = np.diff(word_offsets(row, b - a))
                begin = base + np.concatenate([[0], np.cumsum(count + gap)])
                starts = np.concatenate([[0], np.cumsum(count)])
                held.append((low, s, e, hash_words(low, s, e), begin[row] + np.arange(len(row)) - starts[row]))
                rows.append((batch.select(["doc_id", "_k", "_h"]).slice(a, b - a), begin[:-1], count))
                base = int(begin[-1])
                if base >= SHARD_WORDS:
                    yield from flush()
        if held:
            yield from flush()

    small_batches(docs.sparkSession)
    return stage(docs.mapInArrow(lean(run), f"shard long, word string, at binary, ord int, begin long, n_words long, doc_id {kind}, _k long, _h long"), "index-postings")


def encode_items(items: list[tuple], window: int) -> dict:
    """Items (id, text) as numbers of words: ids, words, terms of each item one after the other, offsets of the items, window."""
    ids, words, terms, off = [], {}, [], [0]
    lower = str.maketrans(UP, LOW)
    for i, text in items:
        own = re.findall(WORD, (text or "").translate(lower))
        if own:
            ids.append(None if i is None else str(i))
            terms += [words.setdefault(w, len(words)) for w in own]
            off.append(len(terms))
    return {"ids": ids, "words": list(words), "terms": np.array(terms, np.int32), "off": np.array(off, np.int64), "window": window}


def windows(q: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct windows x terms, filled up with -1; length of each; offsets and items of their owners)."""
    n, off = q["window"], q["off"]
    size = np.diff(off)
    many = np.maximum(size - n + 1, 1)
    owner = np.repeat(np.arange(len(size)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + off[owner]
    length = np.minimum(size[owner], n)
    at = start[:, None] + np.arange(n)
    grams = np.where(np.arange(n) < length[:, None], q["terms"][np.minimum(at, len(q["terms"]) - 1)], -1)
    grams, back = np.unique(grams, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([back.ravel(), owner], 1), axis=0)
    return grams, (grams >= 0).sum(1), np.searchsorted(pairs[:, 0], np.arange(len(grams) + 1)), pairs[:, 1]


def intersect(index: np.ndarray, order: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches (window, start). index: sorted term << 40 | position; order: offsets of each window, rarest term first.

    The list of the rarest term gives the places; the other lists are intersected, shifted by their offsets.
    """
    nt = int(grams.max()) + 1
    lo = np.searchsorted(index, np.arange(nt + 1, dtype=np.int64) << 40)
    rare = np.take_along_axis(grams, order[:, :1], 1)[:, 0]
    n = lo[rare + 1] - lo[rare]
    w = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    p = (index[lo[rare[w]] + k] & ((1 << 40) - 1)) - order[w, 0]
    for r in range(1, grams.shape[1]):
        j = order[w, r]
        t = grams[w, j].astype(np.int64)
        key = (np.maximum(t, 0) << 40) | np.maximum(p + j, 0)
        at = np.minimum(np.searchsorted(index, key), max(len(index) - 1, 0))
        ok = (t < 0) | (index[at] == key)
        w, p = w[ok], p[ok]
    return w[p >= 0], p[p >= 0]


def proximity(index: np.ndarray, order: np.ndarray, grams: np.ndarray, length: np.ndarray, slop: int, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Near matches (window, place): all but `missing` of the terms stand within slop of place + their offsets.

    One of the missing + 1 rarest terms is there: their lists give the places. A place is dropped as soon as
    too many of the next rarest terms are missing. Windows of fewer than 2 * (missing + 1) terms are left out.
    """
    nt = int(grams.max()) + 1
    lo = np.searchsorted(index, np.arange(nt + 1, dtype=np.int64) << 40)
    some = np.flatnonzero(length >= 2 * (missing + 1))
    out_w, out_p = [], []
    for r in range(missing + 1):
        rare = grams[some, order[some, r]]
        n = lo[rare + 1] - lo[rare]
        w = np.repeat(some, n)
        k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        at = index[np.repeat(lo[rare], n) + k] & ((1 << 40) - 1)
        for shift in range(-slop, slop + 1):
            v, p = w, at - order[w, r] + shift
            lost = np.zeros(len(v), np.int64)
            for x in range(grams.shape[1]):
                j = order[v, x]
                t = grams[v, j].astype(np.int64)
                base = np.maximum(t, 0) << 40
                got = np.searchsorted(index, base | np.maximum(p + j - slop, 0))
                there = (got < len(index)) & (index[np.minimum(got, len(index) - 1)] <= (base | np.maximum(p + j + slop, 0))) & (p + j + slop >= 0)
                lost = lost + ((t >= 0) & ~there)
                ok = lost <= missing
                v, p, lost = v[ok], p[ok], lost[ok]
            out_w.append(v)
            out_p.append(p)
    both = np.unique(np.stack([np.concatenate(out_w), np.concatenate(out_p)], 1), axis=0)
    return both[:, 0], both[:, 1]


def search(index: DataFrame, items: list[tuple], window: int, slop: int, missing: int) -> DataFrame:
    """(shard, ord, cover, items, near) of the documents that hold a block of items, written to the shared folder.

    Only the lists of the items' words are read; a shard's lists meet in one task. What is sent to the executors
    is bounded by the block, and released when the result is written.
    """
    spark = index.sparkSession
    q = encode_items(items, window)
    schema = "shard long, ord int, cover array<long>, items array<string>, near array<string>"
    if not q["words"]:
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame([(w,) for w in q["words"]], "word string")  # bounded by the block
    lists = index.where("word IS NOT NULL").select("shard", "word", "at").join(F.broadcast(known), "word", "left_semi")
    df = {r.word: r.n for r in lists.groupBy("word").agg((F.sum(F.length("at")) / 4).cast("long").alias("n")).collect()}
    q["df"] = np.array([df.get(w, 0) for w in q["words"]], np.int64)
    if not df:
        return spark.createDataFrame([], schema)
    rows = lists.withColumn("begin", F.lit(None).cast("long")).unionByName(index.where("word IS NULL").select("shard", F.lit(None).cast("string").alias("word"), F.lit(None).cast("binary").alias("at"), "begin"))
    sent = spark.sparkContext.broadcast(q)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        q = sent.value
        vocabulary, found = pa.array(q["words"], pa.string()), {}

        def prepared():
            if not found:
                grams, length, at, owner = windows(q)
                live = np.where(grams >= 0, q["df"][np.maximum(grams, 0)], np.iinfo(np.int64).max)
                found.update(grams=grams, length=length, at=at, owner=owner, order=np.argsort(live, axis=1, kind="stable"), dead=(live == 0).sum(1))
            return found

        def answer(shard, keys, begins):
            f = prepared()
            index, begin = np.sort(np.concatenate(keys)), np.sort(np.concatenate(begins))
            use = np.flatnonzero(f["dead"] == 0)
            w, p = intersect(index, f["order"][use], f["grams"][use]) if len(use) else (np.zeros(0, np.int64),) * 2
            w = use[w]
            nw = np_ = np.zeros(0, np.int64)
            if slop or missing:
                use = np.flatnonzero(f["dead"] <= missing)
                if len(use):
                    nw, np_ = proximity(index, f["order"][use], f["grams"][use], f["length"][use], slop, missing)
                    nw = use[nw]
            def by_document(win, place):
                """The matches in the order of documents and places: windows, places, and a function to the range of a document."""
                doc = np.searchsorted(begin, place, "right") - 1
                o = np.lexsort((place, doc))
                return win[o], place[o], doc[o], lambda d: slice(*np.searchsorted(doc[o], [d, d + 1]))

            def names(win):
                return sorted({x for v in set(win.tolist()) for o in f["owner"][f["at"][v] : f["at"][v + 1]].tolist() if (x := q["ids"][o]) is not None})

            w, p, doc, mine = by_document(w, p)
            nw, _, ndoc, theirs = by_document(nw, np_ + f["length"][nw] // 2 + slop)  # a place within the document, or behind it
            out = {"shard": [], "ord": [], "cover": [], "items": [], "near": []}
            for d in np.union1d(doc, ndoc).tolist():
                own = mine(d)
                a = p[own] - begin[d]
                spans: list[int] = []
                for x, y in zip(a.tolist(), (a + f["length"][w[own]]).tolist(), strict=True):
                    if spans and x <= spans[-1]:
                        spans[-1] = max(spans[-1], y)
                    else:
                        spans += [x, y]
                exact = names(w[own])
                out["shard"].append(shard)
                out["ord"].append(d)
                out["cover"].append(spans)
                out["items"].append(exact)
                out["near"].append([x for x in names(nw[theirs(d)]) if x not in set(exact)])
            return pa.RecordBatch.from_pydict({"shard": pa.array(out["shard"], pa.int64()), "ord": pa.array(out["ord"], pa.int32()), "cover": pa.array(out["cover"], pa.list_(pa.int64())), "items": pa.array(out["items"], pa.list_(pa.string())), "near": pa.array(out["near"], pa.list_(pa.string()))})

        now, keys, begins = None, [], []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edge = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *edge], [*edge, len(shard)], strict=True):
                if a == b:
                    continue
                if now is not None and shard[a] != now:
                    if keys:
                        yield answer(now, keys, begins)
                    keys, begins = [], []
                now = int(shard[a])
                part = batch.slice(a, b - a)
                mine = part.filter(pc.is_valid(part.column("word")))
                begins.append(part.filter(pc.is_null(part.column("word"))).column("begin").to_numpy(zero_copy_only=False).astype(np.int64))
                if mine.num_rows:
                    term = pc.index_in(mine.column("word"), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
                    raw, off = utf8(mine.column("at"))
                    keys.append((np.repeat(term, np.diff(off) // 4) << 40) | np.frombuffer(raw.tobytes(), np.int32))
        if keys:
            yield answer(now, keys, begins)

    out = stage(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(run), schema), "index-hits")
    sent.destroy()
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> list[DataFrame]:
    """The items in blocks of about `most` bytes of text. Their sizes are summed first."""
    got = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    total = got.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    return [got.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n)]


def find(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, missing: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact phrase and proximity matches of windows of the items in the documents.

    One row per document: doc_id, _k and _h (its key, as doc_key gives it), n_words, cover (start and end word of
    each hit stretch, alternating), items (ids as strings with an exactly matching window), near_items (others, of
    which a window has all but `missing` of its terms within slop of their places).

    The words of all documents are stored as positional postings, in shards of bounded size; a search reads the
    lists of the items' words, counts them over all shards, and intersects in each shard the lists of a window from
    its rarest term on. The items are searched in blocks of a bounded size, whose hits are written before the next.

    Null and empty texts have no words and hits. Null ids, repeated rows and ties give one row each. Items that
    are null or have no words match nothing; items with a null id hit words, but have no name to return. Empty
    tables: no rows, or no hits. Other columns are ignored.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    index = postings(kept, gap=2 * (window + slop) + 2)
    hits = [search(index, [(r[0], r[1]) for r in part.toLocalIterator()], window, slop, missing) for part in blocks(items, item_id_col, item_text_col, block_bytes)]
    hit = united(hits)
    many = not few(hit, 100_000)
    if len(hits) > 1:
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        hit = hit.groupBy("shard", "ord").agg(*map(flat, ("cover", "items", "near")))
    told = index.where("word IS NULL").select("shard", "ord", "doc_id", "_k", "_h", "n_words").join(hit if many else F.broadcast(hit), ["shard", "ord"], "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    names = empty(F.col("items"), "array<string>")
    return told.select("doc_id", "_k", "_h", "n_words", empty(F.col("cover"), "array<bigint>").alias("cover"), F.array_sort(F.array_distinct(names)).alias("items"), F.array_sort(F.array_except(empty(F.col("near"), "array<string>"), names)).alias("near_items"))


def without(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a window of an item; all columns."""
    k, h = doc_key(id_col, text_col)
    kx, hx = "_k" + "_" * max(map(len, docs.columns)), "_h" + "_" * max(map(len, docs.columns))
    hits = find(docs, items, id_col=id_col, text_col=text_col, **options).where(F.size("cover") > 0)
    gone = stage(hits.select(F.col("_k").alias(kx), F.col("_h").alias(hx)).distinct(), "index-gone")
    return semi(docs.select("*", k.alias(kx), h.alias(hx)), gone, [kx, hx], how="left_anti").drop(kx, hx)


def n_hit(cover) -> F.Column:
    """Words inside the stretches; those of several blocks may overlap, so each word counts once."""
    spans = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(cover) / 2).cast("int") - 1), lambda i: F.struct(F.get(cover, i * 2).alias("a"), F.get(cover, i * 2 + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], x["b"]).cast("long").alias("to"))
    return F.when(F.size(cover) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(spans, start, step)["n"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from exact matches; near_items: items with a near match only."""
    hits = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP, missing=MISSING)
    names = F.array_join("items", ",")
    return hits.select("doc_id", "n_words", n_hit(F.col("cover")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("cover") > 0).alias("contaminated"), F.array_join("near_items", ",").alias("near_items"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '{WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
own AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM own GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(generate_series(1, len(w))) AS i FROM d),
df AS (SELECT t, count(*) AS df FROM tok GROUP BY t),
g AS (SELECT g, n, row_number() OVER () AS win FROM (SELECT DISTINCT g, n FROM bw WHERE n >= {2 * (MISSING + 1)})),
gt AS (SELECT win, n, unnest(g) AS t, unnest(generate_series(0, n - 1)) AS j FROM g),
ranked AS (SELECT gt.*, row_number() OVER (PARTITION BY win ORDER BY coalesce(df, 0), j) AS r FROM gt LEFT JOIN df USING (t)),
cand AS (SELECT DISTINCT win, doc_id, i - j + s AS p FROM ranked JOIN tok USING (t), generate_series(-{SLOP}, {SLOP}) AS x(s) WHERE r <= {MISSING + 1}),
one AS (SELECT DISTINCT win, doc_id, p, j FROM cand JOIN ranked USING (win) JOIN tok USING (doc_id, t) WHERE r <= {MISSING + 2} AND i BETWEEN p + j - {SLOP} AND p + j + {SLOP}),
two AS (SELECT win, doc_id, p FROM one GROUP BY ALL HAVING count(*) >= 2),
near AS (SELECT win, doc_id FROM (SELECT DISTINCT two.*, j, n FROM two JOIN ranked USING (win) JOIN tok USING (doc_id, t) WHERE i BETWEEN p + j - {SLOP} AND p + j + {SLOP}) GROUP BY win, doc_id, p, n HAVING count(*) >= n - {MISSING}),
ni AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS near_items FROM (SELECT DISTINCT near.doc_id, item_id::VARCHAR AS x FROM near JOIN g USING (win) JOIN bw USING (g, n) WHERE item_id IS NOT NULL) WHERE (doc_id, x) NOT IN (SELECT (doc_id, x) FROM own) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated, coalesce(ni.near_items, '') AS near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
