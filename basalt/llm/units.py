"""Token ids of whole texts, in parts that tokenizers encode independently of one another."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Characters of a part of a long text.
PART = 1 << 18
#: Where parts may begin.
CUT = re.compile(r"(?<=\S)(?= )")


def path_of(model: str) -> str:
    """model: a path, or a name of public_tokenizers."""
    if os.path.exists(model):
        return model
    import public_tokenizers

    return str(public_tokenizers.path(model))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts of about `size` characters, each of the later ones begins with a space behind another
    character than white space. A stretch without such a place stays whole."""
    a = 0
    while len(text) - a > size:
        m = CUT.search(text, a + size)
        if not m:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


#: Fixed: how the byte-level pre-tokenizer splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(model: str, plain: bool) -> tuple[Callable[[str], np.ndarray], np.ndarray, bool]:
    """(encoder of a text, bytes of each id, whether parts are independent) of a tokenizer file of the tokenizers library.

    plain: the strings of special tokens are ordinary text. Parts are independent if the text is not normalised and
    the byte-level pattern splits it: that pattern never joins a character to a space behind it, unless both are
    white space, and looks no further back. If, moreover, the merges stand in the order of the ids they make, the file
    is no more than ranks of byte strings, and its vocabulary is given to tiktoken, which is several times as fast.
    """
    import json

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    at = path_of(model)
    t = Tokenizer.from_file(at)
    t.encode_special_tokens = plain
    with open(at, encoding="utf-8") as f:
        spec = json.load(f)
    pre, bpe, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    odd = any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added)
    apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and not odd
    vocab, special = t.get_vocab(with_added_tokens=True), {x["content"]: x["id"] for x in added}
    width = np.zeros(max(vocab.values()) + 1, np.int32)
    for piece, i in vocab.items():  # a byte-level piece has a character for each byte
        width[i] = len(piece.encode()) if piece in special else len(piece)
    value = byte_values()
    own = {p: i for p, i in bpe.get("vocab", {}).items() if p not in special} if bpe.get("type") == "BPE" else {}
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe.get("merges", ())]
    ranked = [own.get(p) for p in pairs] == list(range(256, 256 + len(pairs))) and len(own) == 256 + len(pairs)
    ranked = ranked and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    try:
        import tiktoken
    except ImportError:
        ranked = False
    if apart and ranked and all(c in value for p in own for c in p):
        ranks = {bytes(value[c] for c in p): i for p, i in own.items()}
        e = tiktoken.Encoding(f"ranks of {at}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set() if plain else "all"
        return lambda text: e.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype(np.int32), width, True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.int32), width, apart


@lru_cache(maxsize=4)
def byte_ids(model: str, plain: bool) -> tuple[Callable[[str], np.ndarray], np.ndarray, bool]:
    """(ids of a part, bytes of each id, whether parts are independent) of a tokenizer file, kept by the worker."""
    return byte_level(model, plain)


@lru_cache(maxsize=4)
def piece_ids(model: str) -> tuple[Callable[[str], np.ndarray], np.ndarray, bool]:
    """(ids of a part without the space it begins with, bytes of each id, whether parts are independent) of a
    sentencepiece model that puts a space before texts.

    Parts are independent if it merges pieces only, leaves texts as they are, and no piece holds a space behind another
    character: no merge then crosses the place between them.
    """
    from .tokens import load

    sp, width, pairs = load(path_of(model))
    space = ord("\u2581")
    apart = pairs is not None and not bool((((pairs & 0x1FFFFF) == space) & (pairs >> 21 != space)).any())
    alone = np.array([sp.piece_to_id("\u2581")], np.int32)
    return lambda text: np.array(sp.encode(text), np.int32) if text else alone, width.astype(np.int32), apart
