"""Substring dedup: a compressed FM-index per shard, backward search over wavelet matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NON_SPACE, chunks, doc_key, hash_words, lean, mix, stage, utf8, word_offsets, words_of, small_batches

WINDOW, GRAM = 50, 16
SPREAD = WINDOW - GRAM + 1  # word 16-grams in a window
#: Words of a shard's index; a single routing value with more makes a larger shard.
SHARD_WORDS = 400_000
_ODD = np.uint64(0xD1B54A32D192ED03)


def minimizers(h: np.ndarray) -> np.ndarray:
    """For each window of 50 words its least hash of a 16-gram: equal windows have equal values."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    n = len(h) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g = g * _ODD + h[j : j + n]
    g = mix(g)
    width, low = 1, g
    while width * 2 <= SPREAD:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    return np.minimum(low[: len(g) - SPREAD + 1], low[SPREAD - width : SPREAD - width + len(g) - SPREAD + 1])


class Bits:
    """A bit vector in words of 64, with the number of ones before each word."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(64 - len(bit) % 64 + 64, np.uint8)]), bitorder="little")
        self.words = packed[: len(packed) // 8 * 8].view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << low) - np.uint64(1)))


class Wavelet:
    """Wavelet matrix: a bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.zeros = [], []
        x = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of position i in the final order of the symbol (from a common start per symbol)."""
        for k in range(self.levels):
            ones = self.bits[k].rank(i)
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i


class Index:
    """Compressed FM-index of records of words (numbers from 1), each closed by a separator (0) that orders by record.

    What stays of the suffix array is the record of each suffix (`record`), and one bit for each that tells whether it
    agrees with the one before in 49 words; the text itself is in the wavelet matrix of its last column.
    """

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        r = len(off) - 1
        at = np.arange(len(ids)) + np.repeat(np.arange(r), np.diff(off))
        text = np.zeros(len(ids) + r, np.int64)
        text[at] = ids
        n, self.n = len(text), len(text)
        ends = off[1:] + np.arange(r)
        rank = text + r
        rank[ends] = np.arange(r)
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        span, half = 1, None
        while True:  # suffix array by prefix doubling; separators end every comparison
            if span == 32:
                half = rank
            key = rank.astype(np.uint64) << np.uint64(32)
            key[: n - span] |= (rank[span:] + 1).astype(np.uint64)
            order = np.argsort(key)
            new = np.ones(n, np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            new = np.cumsum(new) - 1
            rank = np.empty(n, np.int64)
            rank[order] = new
            span *= 2
            if new[-1] == n - 1 and span > 32:
                break
        half = rank if half is None else half
        top = int(ids.max(initial=1))
        self.tree = Wavelet(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        every = np.arange(top + 1)
        self.start = self.tree.walk(every, np.zeros(len(every), np.int64))
        self.record = np.repeat(np.arange(r, dtype=np.int32), np.diff(off) + 1)[order]
        # Intervals of suffixes that agree in 49 words: where a match of 50 goes when it loses its last word.
        pad = np.concatenate([half, np.zeros(WINDOW, np.int64)])
        a, b = half[order], pad[order + (WINDOW - 1 - 32)]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.new, self.cuts = Bits(new), np.append(np.flatnonzero(new), n).astype(np.int32)

    def widened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that agree with those of [lo, hi) in 49 words."""
        return self.cuts[self.new.rank(lo + 1) - 1].astype(np.int64), self.cuts[self.new.rank(hi)].astype(np.int64)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes of [lo, hi) that the symbol precedes."""
        both = self.tree.walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        shift = self.before[symbol] - self.start[symbol]
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def windows(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) of each window of 50 words of the records, window after window.

        Matching statistics cut at 50: all records stream from their ends at once; each word extends its match
        to the left, and a match of 50 words first loses its last one.
        """
        size = np.diff(off)
        base = np.concatenate([[0], np.cumsum(np.maximum(size - WINDOW + 1, 0))])
        out = np.zeros((2, int(base[-1])), np.int64)
        order = np.argsort(-size, kind="stable")
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n)
        for t in range(int(size.max(initial=0))):
            live = order[: int(np.searchsorted(-size[order], -t, "left"))]
            a, b = lo[live], hi[live]
            if t >= WINDOW:
                a, b = self.widened(a, b)
            place = size[live] - 1 - t
            a, b = self.step(ids[off[live] + place], a, b)
            lo[live], hi[live] = a, b
            if t >= WINDOW - 1:
                out[0, base[live] + place], out[1, base[live] + place] = a, b
        return out[0], out[1]


def numbered(raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the words raw[s:e] from 0: equal exactly for words that are spelled alike. h: their hashes."""
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    like, wide = first[ids], e - s
    same = wide == wide[like]
    for j in np.unique(wide):
        k = np.flatnonzero((wide == j) & same)
        if j <= 64:
            same[k] = (raw[s[k][:, None] + np.arange(j)] == raw[s[like[k]][:, None] + np.arange(j)]).all(1)
        else:
            same[k] = [raw[s[i] : e[i]].tobytes() == raw[s[p] : e[p]].tobytes() for i, p in zip(k, like[k], strict=True)]
    if not same.all():  # words that share a hash with another one: numbered by their spelling
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            ids[i] = names.setdefault(raw[s[i] : e[i]].tobytes(), len(first) + len(names))
    return ids


def first_holders(raw: np.ndarray, off: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least document of the records that hold each window, offsets of the records' windows): one shard."""
    s, e, row = words_of(raw, off, NON_SPACE)
    h = hash_words(raw, s, e)
    ids = numbered(raw, s, e, h)
    wo = word_offsets(row, len(off) - 1)
    index = Index(ids + 1, wo)
    lo, hi = index.windows(ids + 1, wo)
    held = np.append(docs[index.record], np.iinfo(np.int64).max)
    begin, back = np.unique(lo, return_inverse=True)
    end = np.zeros(len(begin), np.int64)
    end[back] = hi
    low = np.minimum.reduceat(held, np.stack([begin, end], 1).ravel())[::2] if len(begin) else begin
    return low[back], np.concatenate([[0], np.cumsum(np.maximum(np.diff(wo) - WINDOW + 1, 0))])


def anchors(docs: DataFrame) -> DataFrame:
    """(v, _k): the minimizers of each document's windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a, b in chunks(off):
                part = raw[off[a] : off[b]]
                s, e, row = words_of(part, off[a : b + 1] - off[a], NON_SPACE)
                h, wo = hash_words(part, s, e), word_offsets(row, b - a)
                found = [np.unique(minimizers(h[wo[i] : wo[i + 1]])) for i in range(b - a)]
                keys = batch.column(0).to_numpy()[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.repeat(keys, [len(x) for x in found]))], names=["v", "_k"])

    return docs.select("_k", "text").mapInArrow(lean(run), "v long, _k long")


def records(docs: DataFrame) -> DataFrame:
    """docs (_k, _h, text, vs) -> (v, _k, _h, start, content): stretches of windows with one shared minimizer."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = utf8(batch.column(2))
            for a, b in chunks(off):
                part = raw[off[a] : off[b]]
                s, e, row = words_of(part, off[a : b + 1] - off[a], NON_SPACE)
                h, wo = hash_words(part, s, e), word_offsets(row, b - a)
                whole = part.tobytes()
                out: list[list] = [[], [], [], [], []]
                for i in range(b - a):
                    m = minimizers(h[wo[i] : wo[i + 1]])
                    ok = np.isin(m, np.array(batch.column(3)[a + i].as_py() or [], np.int64).view(np.uint64))
                    new = np.ones(len(m) + 1, bool)
                    new[1:-1] = m[1:] != m[:-1]
                    cuts = np.flatnonzero(new)
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        if ok[x]:
                            for z in range(x, y, SPREAD):
                                last = min(y, z + SPREAD) + WINDOW - 2
                                out[0].append(int(m[x].astype(np.int64)))
                                out[1].append(a + i)
                                out[3].append(int(z))
                                out[4].append(whole[s[wo[i] + z] : e[wo[i] + last]])
                at = pa.array(out[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], names=["v", "_k", "_h", "start", "content"])

    return docs.select("_k", "_h", "text", "vs").mapInArrow(lean(run), "v long, _k long, _h long, start int, content binary")


def search(contents: DataFrame) -> DataFrame:
    """(v, content, lo: least document) dealt and sorted by v -> (v, _p, _q, firsts): least holder of each window.

    Each task gathers contents into shards of about SHARD_WORDS words, whole values of v each, indexes a shard
    and streams its contents against it.
    """

    def run(batches):
        import pyarrow as pa

        def shard(held):
            table = pa.concat_tables(held).combine_chunks()
            raw, off = utf8(table["content"])
            low, cut = first_holders(raw, off, table["lo"].to_numpy())
            firsts = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(low))
            return pa.table({"v": table["v"], "_p": table["_p"], "_q": table["_q"], "firsts": firsts.cast(pa.list_(pa.int64()))}).to_batches()

        held, size = [], 0
        for batch in batches:
            v = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
            bytes_ = np.diff(utf8(batch.column(1))[1])
            total = np.concatenate([[0], np.cumsum(bytes_)])
            a = 0
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                new = not (x == 0 and held and held[-1]["v"][-1].as_py() == v[0])
                if new and size + total[x] - total[a] >= SHARD_WORDS * 6:
                    if x > a:
                        held.append(pa.Table.from_batches([batch.slice(a, x - a)]))
                    if held:
                        yield from shard(held)
                    held, size, a = [], 0, x
            held.append(pa.Table.from_batches([batch.slice(a)]))
            size += int(total[-1] - total[a])
        if size:
            yield from shard(held)

    return contents.select("v", "content", "lo", "_p", "_q").mapInArrow(lean(run), "v long, _p long, _q long, firsts array<long>")


def removals(docs: DataFrame) -> DataFrame:
    """(_k, _h, starts): starting words of a document's windows that also start in a document with a smaller _k.

    A window's minimizer is a function of its words, so documents that share a window share the value. Only
    values of several documents go on; their stretches of text are dealt to shards by the value. Equal
    stretches are one row (combined before the shuffle) with their least document; the FM-index of a shard
    finds for each window the least document that holds it, which goes back to all documents of the stretch.
    """
    found = stage(anchors(docs), "sub-anchors")
    shared = found.groupBy("v").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).where("lo < hi").select("v")
    wanted = found.join(shared, "v").groupBy("_k").agg(F.collect_set("v").alias("vs"))
    pieces = stage(records(docs.join(wanted, "_k")).withColumns({"_p": F.xxhash64("content"), "_q": F.xxhash64(F.lit(17), "content")}), "sub-pieces")
    contents = pieces.groupBy("v", "content").agg(F.min("_k").alias("lo")).withColumns({"_p": F.xxhash64("content"), "_q": F.xxhash64(F.lit(17), "content")})
    firsts = stage(search(contents.repartition("v").sortWithinPartitions("v")), "sub-firsts")
    members = pieces.select("v", "_p", "_q", "_k", "_h", "start").join(firsts, ["v", "_p", "_q"]).where(F.array_min("firsts") < F.col("_k"))
    late = F.filter(F.sequence(F.lit(0), F.size("firsts") - 1), lambda j: F.get("firsts", j) < F.col("_k"))
    starts = members.select("_k", "_h", F.transform(late, lambda j: j + F.col("start")).alias("s"))
    return starts.groupBy("_k", "_h").agg(F.flatten(F.collect_list("s")).alias("starts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, intervals (first and last word + 1 of each removed stretch,
    alternating), text (the words that stay, joined by one space).

    Words are stretches without ASCII white space. A word goes if a window of 50 consecutive words covers it
    that also starts in a document with a smaller doc_id; windows are judged on the input.

    Null and empty texts have no words. Null ids count as the largest; rows with one id are one document for
    this, so none of them makes another lose words. Empty tables give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), *doc_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    gone = removals(base)
    rows = base.join(gone, ["_k", "_h"], "left").select("doc_id", "text", "starts")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, out, spans, texts = [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n.append(len(words))
                if starts.is_valid and len(starts):
                    step = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(step, at, 1)
                    np.add.at(step, at + WINDOW, -1)
                    on = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
                    spans.append(edge.tolist())
                    out.append(int(on.sum()))
                    words = [w for w, x in zip(words, on.tolist(), strict=True) if not x]
                else:
                    spans.append([])
                    out.append(0)
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "intervals", "text"])

    return rows.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, intervals array<long>, text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS lo FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM x JOIN f USING (g) WHERE lo < doc_id),
k AS (SELECT d.doc_id, list(d.w[j] ORDER BY j) AS kept FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS j FROM d) d LEFT JOIN r ON r.doc_id = d.doc_id AND r.p = d.j WHERE r.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(len(k.kept), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k.kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
