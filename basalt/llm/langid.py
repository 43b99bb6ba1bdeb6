"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bucket_of, chunks, lean, utf8, small_batches

ORDER, BITS = 5, 12
STEP = 1 << 20  # grams that are looked up at a time
MASK = np.uint64((1 << BITS) - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE: list[np.ndarray] = []
#: Code points from DIRECT on are two symbols, HIGH + c // 1024 and LOW + c % 1024, so that no two letters share one.
DIRECT, HIGH, LOW = 2048, 2048, 2304


def symbols() -> tuple[np.ndarray, np.ndarray]:
    """First and second symbol of each code point: 0 and 0 for what is no letter; letters fold their case."""
    if not _TABLE:
        first, second = np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        for c in range(0x323B0):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                k = ord(low) if len(low) == 1 else c
                first[c], second[c] = (k, 0) if k < DIRECT else (HIGH + k // 1024, LOW + k % 1024)
        _TABLE.extend((first, second))
    return _TABLE[0], _TABLE[1]


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed 5-grams, row of each): one ends at each symbol of each text, runs of other characters being one space.

    A text starts with four spaces, so that its grams don't depend on the texts around it.
    """
    n = len(off) - 1
    lead = (raw & 0xC0) != 0x80  # code points start here
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum(lead)])[off]
    first, second = symbols()
    sym, more = first[cp], second[cp]
    row = np.repeat(np.arange(n), np.diff(chars))
    two = more > 0
    if two.any():
        each = 1 + two
        sym, row, last = np.repeat(sym, each), np.repeat(row, each), np.cumsum(each) - 1
        sym[last[two]] = more[two]
    keep = sym != 0
    if len(keep):
        begins = np.ones(len(keep), bool)
        begins[1:] = row[1:] != row[:-1]
        keep[1:] |= (sym[:-1] != 0) & ~begins[1:]  # no space at the start
    sym, row = sym[keep], row[keep]
    at = np.arange(len(sym)) + (row + 1) * (ORDER - 1)
    flat = np.zeros(len(sym) + n * (ORDER - 1), np.uint64)
    flat[at] = sym
    packed = np.zeros(len(sym), np.uint64)
    for j in range(ORDER):
        packed = (packed << np.uint64(BITS)) | flat[at - (ORDER - 1 - j)]
    return packed, row


class HashArray:
    """Rows of values behind a sorted array of hashes, with an index of the hashes' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys * _MULT  # bijective: equal hashes are equal keys
        order = np.argsort(h, kind="stable")
        self.hash, self.values = h[order], np.ascontiguousarray(values[order])
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(max(2, len(h)))))))
        buckets = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.start = np.searchsorted(self.hash >> self.shift, buckets).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        h = keys * _MULT
        b = (h >> self.shift).astype(np.int64)
        at, end = self.start[b].astype(np.int64), self.start[b + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            p = at[live]
            hit = self.hash[p] == h[live]
            out[live[hit]] = p[hit]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Models:
    """Interpolated Kneser-Ney models of all languages over one set of n-grams: natural logs of probabilities."""

    def __init__(self, langs: list[str], keys: np.ndarray, counts: np.ndarray):
        """keys: sorted distinct 5-grams; counts: 5-gram x language."""
        self.langs, nl = langs, len(langs)
        union, count = {ORDER: keys}, {ORDER: counts.astype(np.float64)}
        for n in range(ORDER - 1, 0, -1):  # lower orders count distinct left neighbours
            low = union[n + 1] & np.uint64((1 << (BITS * n)) - 1)
            union[n], back = np.unique(low, return_inverse=True)
            c = np.zeros((len(union[n]), nl))
            np.add.at(c, back, (count[n + 1] > 0).astype(np.float64))
            count[n] = c
        vocabulary = max(2, len(union[1])) + 1
        prob = None
        self.grams: dict[int, HashArray] = {}
        self.backoff: dict[int, HashArray] = {}
        for n in range(1, ORDER + 1):
            c = count[n]
            one, two = (c == 1).sum(0), (c == 2).sum(0)
            d = np.where(one + two > 0, (one + 1) / (one + 2 * two + 2), 0.5)
            ctx, back = np.unique(union[n] >> np.uint64(BITS), return_inverse=True)
            total, types = np.zeros((len(ctx), nl)), np.zeros((len(ctx), nl))
            np.add.at(total, back, c)
            np.add.at(types, back, (c > 0).astype(np.float64))
            weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
            if n == 1:
                lower = np.full(c.shape, 1.0 / vocabulary)
            else:
                lower = prob[np.searchsorted(union[n - 1], union[n] & np.uint64((1 << (BITS * (n - 1))) - 1))]
            prob = np.where(total[back] > 0, np.maximum(c - d, 0) / np.maximum(total[back], 1), 0) + weight[back] * lower
            self.grams[n] = HashArray(union[n], np.log(prob).astype(np.float32))
            self.backoff[n] = HashArray(ctx, np.log(weight).astype(np.float32))
        self.floor = np.float32(np.log(1.0 / vocabulary))
        self.sharp, self.limit = 1.0, np.full(nl, np.inf)

    def entropies(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol, text x language; number of symbols)."""
        packed, row = grams(raw, off)
        n, nl = len(off) - 1, len(self.langs)
        size = np.bincount(row, minlength=n)
        out = np.zeros((n, nl))
        for a in range(0, len(packed), STEP):  # the values of a long text are never all in memory
            value, mine = self.values(packed[a : a + STEP]), row[a : a + STEP]
            cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            out[mine[cut]] += np.add.reduceat(value, cut, axis=0, dtype=np.float64)
        some = size > 0
        out[some] = -out[some] / size[some, None]
        return out, size

    def values(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each 5-gram, gram x language."""
        found = self.grams[ORDER].find(packed)
        value = self.grams[ORDER].values[np.maximum(found, 0)]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            value[miss] = 0
        for k in range(ORDER, 0, -1):  # interpolation weights of contexts down to the longest known gram
            if not len(miss):
                break
            key = packed[miss] & np.uint64((1 << (BITS * k)) - 1)
            ctx = self.backoff[k].find(key >> np.uint64(BITS))
            seen = ctx >= 0
            value[miss[seen]] += self.backoff[k].values[ctx[seen]]
            if k == 1:
                value[miss] += self.floor
                break
            lower = self.grams[k - 1].find(key & np.uint64((1 << (BITS * (k - 1))) - 1))
            hit = lower >= 0
            value[miss[hit]] += self.grams[k - 1].values[lower[hit]]
            miss = miss[~hit]
        return value

    def calibrate(self, h: np.ndarray, size: np.ndarray, truth: np.ndarray, quantile: float = 0.999) -> None:
        """Fit the sharpness of the score and, per language, the cross-entropy above which a text is rejected, from
        entropies (text x language), numbers of symbols and languages of texts that no model has learned from."""
        ok = np.flatnonzero((size > 0) & (truth >= 0))
        if not len(ok):
            return
        h, truth, size = h[ok], truth[ok], size[ok]
        best, least = 1.0, np.inf
        for sharp in (0.5, 1, 2, 4, 8, 16, 32):
            p = self.posterior(h, size, sharp)[np.arange(len(ok)), truth]
            loss = -np.log(np.maximum(p, 1e-12)).mean()
            if loss < least:
                best, least = sharp, loss
        self.sharp = best
        for i in range(len(self.langs)):
            own = h[truth == i, i]
            if len(own):
                self.limit[i] = np.quantile(own, quantile)

    def posterior(self, h: np.ndarray, size: np.ndarray, sharp: float | None = None) -> np.ndarray:
        x = -h * (sharp or self.sharp) * np.sqrt(np.minimum(size, 400))[:, None]
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def train(docs: DataFrame, max_texts: int = 1200, least: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Models of all languages, from a sample of about max_texts labelled texts over all of them (documented bound),
    about as many per language, and about `least` of each at least, or all of a language that has fewer.

    The languages are counted first; each is then sampled by a hash of the id at the rate that gives its share,
    so no language's rows meet in one task. A quarter of the sample is left out of the models and calibrates
    them, but in languages with about `least` texts or fewer, whose limit stays infinite. The 5-grams of whole
    texts are counted on the executors and summed by a shuffle, the entropies of the calibrating texts are
    computed there; what comes to the driver is bounded by the sample, the models by its 5-grams times the
    languages. None if no row can be learned from.
    """
    kept = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in kept.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = max(float(least), max_texts / len(langs))
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, share / counts[lang]))])
    spared = F.col("lang").isin([lang for lang in langs if min(share, counts[lang]) > least])
    rate = rates[F.col("lang")]
    picked = kept.where(F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(1 << 30)) < rate * (1 << 30)).where(F.col("text").isNotNull())
    apart = (F.pmod(F.xxhash64(F.lit(12), "i"), F.lit(4)) == 0) & spared

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for x in sorted(set(names)):
                texts = batch.column(0).filter(pa.array(names == x))
                raw, off = utf8(texts)
                for a, b in chunks(off):
                    key, n = np.unique(grams(raw[off[a] : off[b]], off[a : b + 1] - off[a])[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(key), pa.string()), "key": pa.array(key.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    summed = picked.where(~apart).select("text", "lang").mapInArrow(lean(count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    key = summed["key"].to_numpy().astype(np.uint64)
    lang = np.searchsorted(np.array(langs, object), np.array(summed["lang"].to_pylist(), object)) if len(key) else np.zeros(0, np.int64)
    if not len(key):
        return None
    union, back = np.unique(key, return_inverse=True)
    table = np.zeros((len(union), len(langs)))
    table[back, lang] = summed["n"].to_numpy()
    model = Models(langs, union, table)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in chunks(off):
                h, size = sent.value.entropies(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(size.astype(np.int64))], names=["lang", "h", "size"])

    check = picked.where(apart).select("text", "lang").mapInArrow(lean(measure), "lang string, h array<double>, size long").collect()
    place = {x: i for i, x in enumerate(langs)}
    model.calibrate(np.array([r.h for r in check]).reshape(-1, len(langs)), np.array([r["size"] for r in check], np.int64), np.array([place[r.lang] for r in check], np.int64))
    sent.unpersist()
    return model


def predict(docs: DataFrame, model: Models | None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per document: the kept columns, lang_pred, score, entropy (nats per symbol), rejected.

    The language of the lowest cross-entropy per symbol wins, ties to the first by name. `und`, score 0: null
    texts, texts without letters, or no model. rejected: the entropy is above its language's calibrated limit
    (the prediction stands; callers decide). score: posterior at the calibrated sharpness. Repeated rows give a
    row each; only the text is looked at; empty tables give no rows. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*(keep or [F.col(id_col).alias("doc_id")]), F.col(text_col).cast("string").alias("_text"))
    names = kept.columns[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", lang_pred string, score double, entropy double, rejected boolean"

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for batch in batches:
            raw, off = utf8(batch.column(batch.num_columns - 1))
            n = len(off) - 1
            langs, score, entropy, rejected = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            for a, b in chunks(off) if m else ():
                h, size = m.entropies(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                some = np.flatnonzero(size)
                if len(some):
                    best = h[some].argmin(1)
                    langs[a + some] = np.array(m.langs, object)[best]
                    score[a + some] = m.posterior(h[some], size[some])[np.arange(len(some)), best]
                    entropy[a + some] = h[some, best]
                    rejected[a + some] = h[some, best] > m.limit[best]
            out = [batch.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(langs, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=[*names, "lang_pred", "score", "entropy", "rejected"])

    return kept.mapInArrow(lean(run), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs, model, keep=[F.col("doc_id"), held.alias("held_out")])
