"""Alignment, centroids and packing against brute-force versions."""

import functools
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basalt.llm import alignment, centroids, packing, units
from basalt.llm.registry import QUERIES

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "doc_id long, text string, _r string, part int, a string, n int"


def texts():
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioubcdnrstéß中 😀'1\n") for _ in range(r.randrange(1, 9)))
    line = "the same words again, and again."
    return [
        line, line, line + " " + line, "", None, " ", "  ", "x", " x", "x ", "a  b\n\n c\t d", "naïve café  déjà　 vu", "it's <|endoftext|> and <s> </s> <unk>", "mark ▁ here", "nul \x00 byte",
        "😀😀 👨‍👩‍👧 ́e", "deadbeef" * 30, " ".join(word() for _ in range(400)), "\n".join(" ".join(word() for _ in range(20)) for _ in range(120)), "a" * 3000, " " * 700, "longer words without end " * 900,
    ]


def rows():
    out = [(i if i != 7 else None, t, "r", 1, "a", 2) for i, t in enumerate(texts())]
    return [*out, out[2], (3, "another text of document three", "r", 1, "a", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(plain):
    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = plain
    return t


@pytest.mark.parametrize("plain", [True, False])
def test_ids_are_those_of_the_library(plain):
    t = tokenizer(plain)
    encode, width, apart = units.byte_ids("byte_bpe_50k.json", plain)
    assert apart
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "É", "1", "'s", "'", "!", "<|endoftext|>", "😀", "́", "x\n", "中", "​", "﻿"]
    every = [x for x in texts() if x] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 15))) for _ in range(1500)]
    for x in every:
        want = t.encode(x, add_special_tokens=False).ids
        assert encode(x).tolist() == want and [i for p in units.parts(x, 5) for i in encode(p).tolist()] == want
        assert plain is False or width[encode(x)].sum() == len(x.encode())


# --- 11 -------------------------------------------------------------------------------------------
@functools.lru_cache
def libraries():
    import sentencepiece

    return tokenizer(True), sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))


def spelled(text):
    """(ids of A, their bytes, ids of B, their bytes), or None."""
    if not text:
        return None
    t, sp = libraries()
    value = units.byte_values()
    a = t.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(value[c] for c in t.id_to_token(i)) for i in a]
    b = sp.encode(text)
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else None


def alignment_by_hand(texts):
    out, pairs = [], Counter()
    for text in texts:
        got = spelled(text)
        if not got:
            out.append((0, 0, [], []))
            continue
        a, a_bytes, b, b_bytes = got
        ends = lambda x: np.cumsum([len(y) for y in x]).tolist()
        ea, eb = ends(a_bytes), ends(b_bytes)
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(a_bytes[i]), eb[j] - len(b_bytes[j])) < min(ea[i], eb[j])] if len(a) * len(b) < 10_000 else walk(ea, eb)
        groups, last = [], 0
        both = set(ea) & set(eb)
        for e in sorted(both):
            groups.append((last, e))
            last = e
        text_of = []
        i = j = 0
        for _, e in groups:
            x, y = [], []
            while i < len(a) and ea[i] <= e:
                x.append(str(a[i]))
                i += 1
            while j < len(b) and eb[j] <= e:
                y.append(str(b[j]))
                j += 1
            text_of.append(",".join(x) + "|" + ",".join(y))
        links = [(a[i], b[j]) for i, j in links]
        pairs.update(links)
        out.append((len(a), len(b), text_of, links))
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(g), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for n_a, n_b, g, links in out]


def walk(ea, eb):
    i = j = 0
    out = []
    while i < len(ea) and j < len(eb):
        out.append((i, j))
        x, y = ea[i], eb[j]
        i, j = i + (x <= y), j + (y <= x)
    return out


@pytest.mark.parametrize("part,most", [(1 << 17, 500_000), (40, 500_000), (1 << 17, 30), (300, 1)])
def test_alignment(spark, docs, empty, part, most):
    given = [(r[0], r[1]) for r in rows()]
    want = sorted(zip([i for i, _ in given], alignment_by_hand([t for _, t in given]), strict=True), key=str)
    got = alignment.align(docs, part=part, most=most).collect()
    assert sorted(((r.doc_id, tuple(r)[1:8]) for r in got), key=str) == want
    assert alignment.align(empty).count() == 0
    if part == 40:
        assert any(r.groups and hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got)


def test_alignment_plan(spark, docs):
    """Ends are told apart where tokens are made: no sets of them, nor an array for each token, are made in interpreted lambdas."""
    base = docs.selectExpr("doc_id", "text", "monotonically_increasing_id() AS _r")
    plan = alignment.aligned(alignment.tokenised(base))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and not any(f in plan for f in ("array_union", "array_intersect", "array_repeat", "flatten"))


@data
def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in docs], alignment_by_hand([r.text for r in docs]), strict=True))
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op11_alignment"](spark, SF).collect()}
    assert got == want


def test_alignment_of_a_very_long_text(spark):
    text = " ".join(random.Random(2).choice(["alpha", "Übermut", "beta,", "gamma\n", "naïve"]) for _ in range(150_000))
    got = alignment.align(spark.createDataFrame([(1, text), (2, "b" * 200_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:8] for r in got} == dict(zip([1, 2], alignment_by_hand([text, "b" * 200_000]), strict=True))


# --- 12 -------------------------------------------------------------------------------------------
def clusters_by_hand(vectors, k=16, rounds=3, dims=64):
    import math

    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(64 * x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(x) for _, x in first]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    given = [nearest(x) for _, x in kept]
    each = Counter()
    for d, j in given:
        each[j] += d
    top = lambda x: min(x, 2**63 - 1)
    total = top(sum(top(d) for d, _ in given))
    sums = Counter()
    for d, j in given:
        sums[j] += top(d)
    return sorted(((i, j, top(d), top(sums[j]), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, given, strict=True)), key=str)


def some_vectors(dims=64):
    r = random.Random(4)
    out = [(i, [r.gauss(0, 0.2 + (i % 5)) for _ in range(dims)]) for i in range(120)]
    out += [(200 + i, [float(r.randrange(-1, 2)) / 64 for _ in range(dims)]) for i in range(40)]  # ties
    out += [(300, None), (301, []), (302, [0.1] * (dims - 1)), (303, [0.1] * (dims + 1)), (304, [None] + [0.0] * (dims - 1)), (305, [float("nan")] * dims), (306, [float("inf")] + [1.0] * (dims - 1)), (None, [0.5] * dims), (307, [0.0] * dims)]
    return out + out[3:6] + [out[0]] * 30 + [(5, [1.0] * dims)]


def test_centroids(spark):
    vectors = some_vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    got = centroids.cluster(df).collect()
    assert sorted(map(tuple, got), key=str) == clusters_by_hand(vectors)
    assert centroids.cluster(df.where("false")).count() == 0 and centroids.cluster(df.where("vec_id = 300")).count() == 0
    few = centroids.cluster(df.where("vec_id < 3"), k=16).collect()
    assert sorted(map(tuple, few), key=str) == clusters_by_hand([v for v in vectors if v[0] is not None and v[0] < 3])


@pytest.mark.parametrize("size", [1e6, 1e15, 1e200, 1e307])
def test_centroids_of_large_components(spark, size):
    r = random.Random(6)
    vectors = [(i, [r.uniform(-size, size) for _ in range(4)]) for i in range(30)]
    got = centroids.cluster(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=4, dims=4).collect()
    assert sorted(map(tuple, got), key=str) == clusters_by_hand(vectors, 4, 3, 4)


@pytest.mark.parametrize("k,spread", [(1, 1), (3, 2), (60, 3), (200, 50)])
def test_annulus_search(k, spread):
    r = np.random.default_rng(k)
    rows = (r.normal(size=(k, 8)) * 40 * r.integers(1, spread + 1, (k, 1))).astype(int).tolist()
    rows += rows[: k // 3]  # ties
    x = np.concatenate([(r.normal(size=(500, 8)) * 60 * r.integers(1, spread + 1, (500, 1))).astype(np.int64), np.array(rows)])
    search = centroids.Centroids(rows)
    at, d = search.nearest(x)
    every = ((x[:, None, :] - np.array(rows)[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
    if spread == 50:
        search.compared = 0
        near = np.repeat(np.array(rows), 5, 0) + r.integers(-1, 2, (5 * len(rows), 8))
        search.nearest(near)
        assert search.compared < len(near) * len(rows) / 4  # of vectors near a centroid the annulus leaves out most


# --- 13 -------------------------------------------------------------------------------------------
def check_packing(got, given, capacity, end=2):
    t = tokenizer(False)
    want = Counter()
    for i, text in given:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("shard", [packing.SHARD, 7])
def test_packing(spark, docs, empty, shard):
    given = [(r[0], r[1]) for r in rows()]
    check_packing(packing.pack(docs, shard=shard).collect(), given, 1024)
    check_packing(packing.pack(docs, capacity=16, shard=shard).collect(), given, 16)
    assert packing.pack(empty).count() == 0


@data
def test_packing_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check_packing(QUERIES["op13_packing"](spark, SF).collect(), docs, 1024)
    assert n <= least * 1.01 + 2


def packed_by_hand(sizes, capacity):
    """Gap counts recomputed and squared for every choice."""
    gaps, out = [], []
    square = lambda g: sum(n * n for h, n in Counter(g).items() if h)
    for s in sizes:
        best = None
        for i, h in enumerate(gaps):
            if 0 < h and s <= h:
                key = (square([*gaps[:i], h - s, *gaps[i + 1 :]]), h)
                best = min(best, (key, i)) if best else (key, i)
        if best:
            gaps[best[1]] -= s
        else:
            gaps.append(capacity - s)
        out.append(Counter(gaps))
    return len(gaps), Counter(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_by_hand(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(5, 40))
    sizes = np.sort(r.integers(1, capacity, 60))[::-1]
    lengths, counts = np.unique(sizes, return_counts=True)
    at, offset = packing.placed(lengths[::-1], counts[::-1], capacity)
    used = np.bincount(at, weights=sizes).astype(int)
    assert (len(used), Counter((capacity - used).tolist())) == packed_by_hand(sizes.tolist(), capacity)
