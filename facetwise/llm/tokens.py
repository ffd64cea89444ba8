"""Token ids of long texts at memo speed, exactly as the tokenizer's library gives them.

Both kinds of tokenizer here look at a text piece by piece, and no piece goes on over a single space between two
characters that are not white space. So a text falls into spans, each a stretch without such a space, with the
space in front where the tokenizer keeps it; a span's ids depend on nothing else. Spans repeat, and a memo of
bounded size keeps their ids. A new span goes through the parts of the library's own pipeline, its normalizer
and its model; the pieces between are cut by the pattern that the tokenizer's file names.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import struct
from collections.abc import Callable

import public_tokenizers
import regex

from .common import hold

#: Spans that a worker's memo holds; longer ones than MEMO_CHARS are not kept.
MEMO_SPANS, MEMO_CHARS = 400_000, 48

_apart = re.compile(r"(?<=\S) (?=\S)")
_other = re.compile(r"[^\S \n]")
#: A run of these behind letters is a piece of its own for both patterns.
_MARKS = ".,;:!?&*#%$|)\"-"


def odd(text: str) -> bool:
    """Whether a space stands at an end, or beside white space; said too often where there is white space of other kinds."""
    return text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or bool(_other.search(text))



class Memo(dict):
    """Values by key, made when first asked for; kept while there is room."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(self) < self.room and len(key) <= MEMO_CHARS:
            self[key] = found
        return found


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: the visible characters of Latin-1 themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class SpanEncoder:
    """ids: of a text, as little-endian unsigned 32-bit integers. lead: the space belongs to the span after it."""

    def __init__(self, name: str, lead: bool):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.tool, self.lead = Tokenizer.from_file(path), lead
        self.size, self.model, self.normalizer = self.tool.get_vocab_size(), self.tool.model, self.tool.normalizer
        with open(path, encoding="utf-8") as f:
            named_parts = json.load(f)
        parts, self.added = named_parts["pre_tokenizer"], [t["content"] for t in named_parts["added_tokens"]]
        named = [p["pattern"]["Regex"] for p in parts.get("pretokenizers", []) if "pattern" in p]
        self.find = regex.compile(named[0] if named else public_tokenizers.PATTERN).findall
        self.letters = byte_letters()
        self.pieces, self.spans = Memo(self._piece, MEMO_SPANS // 2), Memo(self._span, MEMO_SPANS)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        ids = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _span(self, span: str) -> bytes:
        if span.isalpha():  # one piece, without the pattern's help
            if self.normalizer is None:
                return self._piece(" " + span)
            if span.isascii():
                low = span.lower()
                return self._piece(low) if low == span else self.spans[low]
        else:
            core = span.rstrip(_MARKS)
            if core != span and core.isalpha() and (self.normalizer is None or core.isascii() or self.normalizer.normalize_str(core).isalpha()):
                return self.spans[core] + self.pieces[span[len(core) :]]
        return self._text(" " + span if self.lead else span)

    def _text(self, text: str) -> bytes:
        if self.normalizer is not None:
            text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def ids(self, text: str) -> bytes:
        for added in self.added:
            if added in text:  # the library takes it out before anything else
                found = self.tool.encode(text, add_special_tokens=False).ids
                return struct.pack(f"<{len(found)}I", *found)
        parts = _apart.split(text) if self.lead and odd(text) else text.split(" ")
        first = self._text(parts.pop(0))
        return first + b"".join(map(self.spans.__getitem__, parts))


_encoders: dict[str, SpanEncoder] = {}


def library(name: str, lead: bool) -> SpanEncoder:
    """Of a file for the tokenizers library, as encode(text, add_special_tokens=False): none is put around a text; the string
    of one in a text becomes its id.

    One for each worker process, whose memo serves all tasks that it runs.
    """
    hold("tokens", _encoders.clear)
    if name not in _encoders:
        _encoders[name] = SpanEncoder(name, lead)
    return _encoders[name]


def ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankEncoder:
    """Of byte-level ranks, each match of public_tokenizers.PATTERN by itself."""

    def __init__(self, table: dict[bytes, int]):
        import tiktoken

        self.tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.names = [b""] * (max(table.values(), default=-1) + 1)
        for token, i in table.items():
            self.names[i] = token
        self.digits = [str(i) for i in range(len(self.names))]

    def ids(self, text: str) -> list[int]:
        return self.tool.encode_ordinary(text)


@functools.cache
def by_ranks(name: str) -> RankEncoder:
    return RankEncoder(ranks(name))
