"""Token counts: overlapping chunks of huge documents, spliced at proven stable boundaries."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, small_batches

MODEL = "piece_bpe_32k.model"


@lru_cache(maxsize=4)
def load(model: str):
    """(processor, bytes that each piece covers, pairs of neighbours inside pieces or None). model: a path, or a name of public_tokenizers.

    Merges only ever make pieces. Where two neighbouring characters stand together in no piece, no merge crosses
    the place between them, and what stands on either side is encoded independently: a proven boundary. That
    holds for byte-pair models that leave the text as it is (but for the mark of spaces) and spell unknown
    characters in bytes; for any other model there are no proven boundaries, and texts are encoded whole.
    """
    import os

    import sentencepiece

    if not os.path.exists(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(model))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    width = np.array([1 if sp.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)], np.int64)
    pairs = None
    try:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(sp.serialized_model_proto())
        t, n = spec.trainer_spec, spec.normalizer_spec
        own = n.name == "identity" or not n.precompiled_charsmap and not n.normalization_rule_tsv
        if t.model_type == t.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix and own and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces:
            pairs = np.array(sorted({ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:])}), np.int64)
    except ImportError:  # the model's description can't be read: nothing is proven
        pass
    return sp, width, pairs


def boundaries(raw: bytes, pairs: np.ndarray) -> np.ndarray:
    """Byte positions between two characters that stand together in no piece."""
    cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    size = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    cp[cp == 32] = ord("▁")
    both = cp[:-1] << 21 | cp[1:]
    at = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
    free = np.flatnonzero(pairs[at] != both) if len(pairs) else np.arange(len(both))
    return np.cumsum(size)[free]


def count_huge(text: str, model: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text. Chunks of `chunk` bytes overlap by `overlap`; two neighbours are spliced at a proven
    boundary in their overlap where both have a token start. Without one, the overlap widens twofold; if there
    is none behind the last splice, the open chunk grows twofold instead. So the work is in proportion to the
    text, whether it has boundaries or not."""
    sp, width, pairs = load(model)
    text = text.replace("▁", " ")  # the library's own mark of a space: the same symbol, but not as wide
    raw = text.encode()
    if len(raw) <= chunk or pairs is None:
        return len(sp.encode(text))
    flat = np.frombuffer(raw, np.uint8)
    gaps = boundaries(raw, pairs)

    def encoded(a: int, b: int) -> np.ndarray:
        """Byte offsets at which the tokens of raw[a:b] start, the first at a (its mark of a beginning counts as a's)."""
        ids = np.asarray(sp.encode(raw[a:b].decode()), np.int64)
        start = np.cumsum(width[ids]) - width[ids] - 1 + a
        start[0] = a
        return start

    def floor_char(p: int) -> int:
        while 0 < p < len(raw) and (flat[p] & 0xC0) == 0x80:
            p -= 1
        return p

    total, left, cut, end = 0, 0, 0, floor_char(chunk)
    mine = encoded(0, end)  # tokens of the open chunk; those from `cut` on aren't counted yet
    while end < len(raw):
        wide, spliced = overlap, False
        while not spliced:
            begin = floor_char(max(cut, end - wide))
            if begin <= cut:  # no boundary anywhere behind the cut: grow the open chunk instead
                end = floor_char(min(len(raw), end + max(chunk, end - left)))
                mine, spliced = encoded(left, end), True
                break
            inside = gaps[np.searchsorted(gaps, begin, "right") : np.searchsorted(gaps, end, "left")]
            if len(inside):
                stop = floor_char(min(len(raw), begin + chunk + wide))
                other = encoded(begin, stop)
                both = np.intersect1d(np.intersect1d(inside, mine), other)
                if len(both):
                    at = int(both[len(both) // 2])
                    total += int(np.searchsorted(mine, at) - np.searchsorted(mine, cut))
                    left, cut, end, mine, spliced = begin, at, stop, other, True
                    break
            wide *= 2
    return total + int(len(mine) - np.searchsorted(mine, cut))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096, chunk: int = 24_000, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, n_chunked (1: it was spliced from chunks).

    Null and empty texts have 0 bytes and tokens; repeated rows each give a row; other columns are ignored,
    whatever their names; an empty table gives an empty result. One pass, no shuffle, memory bounded by a batch.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType

    def run(batches):
        import pyarrow as pa

        sp, _, _ = load(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.zeros(len(texts), np.int64)
            counts = np.zeros(len(texts), np.int64)
            chunked = np.zeros(len(texts), np.int32)
            for a in range(0, len(texts), 256):
                part = [t or "" for t in texts[a : a + 256]]
                sizes[a : a + len(part)] = [len(t.encode()) for t in part]
                short = [i for i in range(len(part)) if sizes[a + i] <= chunk]
                for i, ids in zip(short, sp.encode([part[i] for i in short], num_threads=1), strict=True):
                    counts[a + i] = len(ids)
                for i in set(range(len(part))) - set(short):
                    counts[a + i], chunked[a + i] = count_huge(part[i], model, chunk, overlap), 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit), pa.array(chunked)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunked"])

    return kept.mapInArrow(lean(run), f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, n_chunked int")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
