"""Token ids of whole texts under a fixed public byte-level BPE.

As in its JSON file, the string of the special token stands for that token wherever it
occurs in a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices, text_bytes

SLICE_BYTES = 3_000_000
BARE_SPACE = r" ([\s\x0b\x{85}\pZ]|$)"
SPECIAL = {"<|endoftext|>": 50256}  # fixed values of the vocabulary
_loaded: dict = {}


def encoder(ranks_path: str | None = None):
    """The vocabulary as a tiktoken encoding (ids equal those of byte_bpe_50k.json)."""
    if ranks_path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[ranks_path] = tiktoken.Encoding(
            "fixed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
    return _loaded[ranks_path]


def encode(texts: pa.Array, enc, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (uint32), and how many each text has; null texts are empty.

    The pre-tokenizer always starts a piece at a space that leads a word, so a text in which
    every space does is the sum of its space-led words: each distinct word of a slice is
    encoded once. Texts with a space before white space or at the end, or with a special
    token, are encoded whole. end, if given, follows every text.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    parts = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    lead = np.ones(len(flat), dtype=bool)
    lead[starts[counts > 0]] = False
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = index * 2 + lead
    kinds, unit = np.unique(key, return_inverse=True)
    names = coded.dictionary.to_pylist()
    pieces = [enc.encode_ordinary(" " + names[k >> 1] if k & 1 else names[k >> 1]) for k in kinds.tolist()]
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    table = np.fromiter((i for p in pieces for i in p), dtype=np.uint32, count=int(sizes.sum()))
    at = np.cumsum(sizes) - sizes
    n = sizes[unit]
    shift = (at[unit] - (np.cumsum(n) - n)).astype(np.int32)  # a slice's tokens are few enough
    ids = table[np.repeat(shift, n) + np.arange(n.sum(), dtype=np.int32)]
    totals = np.add.reduceat(n, starts) if len(starts) else n
    del pieces, names, shift, unit, n
    double = pc.match_substring_regex(texts, BARE_SPACE).to_numpy(zero_copy_only=False)
    for name in SPECIAL:
        double = double | pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
    if end is None and not double.any():
        return ids, totals
    out, sums, begin = [], totals.copy(), np.cumsum(totals) - totals
    if double.any():
        for d in range(len(texts)):
            if double[d]:
                out.append(np.array(enc.encode(texts[d].as_py(), allowed_special="all"), dtype=np.uint32))
                sums[d] = len(out[-1])
            else:
                out.append(ids[begin[d] : begin[d] + totals[d]])
            if end is not None:
                out.append(np.array([end], dtype=np.uint32))
        return np.concatenate(out), sums + (end is not None)
    return np.insert(ids, begin + totals, np.uint32(end)), sums + 1


def encoded(batches: Iterator[pa.RecordBatch], ranks_path: str | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, counts) for bounded slices of batches with a text column."""
    enc = encoder(ranks_path)
    for batch in batches:
        for a, b in slices(text_bytes(batch.column("text")), SLICE_BYTES):
            part = batch.slice(a, b - a)
            yield part, *encode(part.column("text"), enc)


def piece_bounds(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut rows of counts tokens into pieces of at most longest: (row, piece, start, length).

    Only rows over longest are cut; their first piece takes what does not fill a whole one.
    """
    many = np.maximum(1, -(-counts // longest))
    row = np.repeat(np.arange(len(counts)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    first = counts - (many - 1) * longest
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * longest)
    return row, piece, start, np.where(piece == 0, first[row], longest)
