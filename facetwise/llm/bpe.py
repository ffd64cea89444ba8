r"""Byte-level BPE by monoid tree reduction.

The ids of a text are an element of a monoid: encode both halves recursively, then join neighbours. The join
re-encodes a window over the seam, which grows until it begins and ends at a place where no token of the joined
text can reach over: a single space between two characters that are not white space, with both of them inside the
half. Every match of the pattern ends before such a space or begins with it, whatever stands further off, and the
merges stay inside a match; so the tokens outside the window are those of the joined text. Where a half has no such
place, its whole side goes into the window, so texts without spaces come out right too. Decoding joins
the bytes of the halves up the same tree.

Null text counts as empty: no ids, no bytes. Rows are independent of each other, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .tokens import RankEncoder, by_ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a leaf, and of the first window on each side of a seam.
LEAF, WINDOW = 512, 64

_safe = re.compile(r"(?<=\S) (?=\S)")


def _tail(half: str, width: int) -> int:
    """The first safe place among the last width characters; -1 if there is none."""
    found = _safe.search(half, max(0, len(half) - width))
    return found.start() if found else -1


def _head(half: str, width: int) -> int:
    """The last safe place among the first width characters; -1 if there is none."""
    at = -1
    for found in _safe.finditer(half, 0, min(len(half), width)):
        at = found.start()
    return at


def join(encoder: RankEncoder, left: tuple[str, list[int]], right: tuple[str, list[int]], window: int = WINDOW) -> tuple[str, list[int]]:
    """The product of two elements (text, ids)."""
    if not left[0] or not right[0]:
        return right if not left[0] else left
    before, after = -1, -1
    width = window
    while before < 0 and width < 2 * len(left[0]):
        before = _tail(left[0], width)
        width *= 2
    width = window
    while after < 0 and width < 2 * len(right[0]):
        after = _head(right[0], width)
        width *= 2
    before = max(before, 0)
    after = len(right[0]) if after < 0 else after
    tail, head = left[0][before:], right[0][:after]
    # as the ends of the window are safe, what goes is just what the halves made of it
    old_tail, old_head = len(encoder.ids(tail)), len(encoder.ids(head))
    return left[0] + right[0], left[1][: len(left[1]) - old_tail] + encoder.ids(tail + head) + right[1][old_head:]


def encode(encoder: RankEncoder, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of a text."""

    def tree(lo: int, hi: int) -> tuple[str, list[int]]:
        if hi - lo <= leaf:
            return text[lo:hi], encoder.ids(text[lo:hi])
        mid = (lo + hi) // 2
        return join(encoder, tree(lo, mid), tree(mid, hi), window)

    return tree(0, len(text))[1]


def decode(names: list[bytes], ids: list[int], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return b"".join(map(names.__getitem__, ids))
    mid = len(ids) // 2
    return decode(names, ids[:mid], leaf) + decode(names, ids[mid:], leaf)


def round_trip(docs: DataFrame, name: str = RANKS, leaf: int = LEAF) -> DataFrame:
    """Encode and decode each row's text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = by_ranks(name)
        for b in batches:
            n, ids_sha, bytes_sha = [], [], []
            for text in b.column("text"):
                ids = encode(encoder, text.as_py(), leaf)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(encoder.digits.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(decode(encoder.names, ids, leaf)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
