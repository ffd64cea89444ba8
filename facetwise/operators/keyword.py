"""Keyword search: words and quoted phrases, any of which a text field has."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import STOP_WORDS, unaccented, without_accents
from ..schema import Schema


def terms(text: str) -> list[str]:
    """Words and phrases in order. Quotes and apostrophes go, white space becomes single spaces."""
    out = []
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', " ".join(text.split())):
        term = " ".join(re.sub(r"[\"']", "", phrase or word).split())
        if term:
            out.append(term)
    return out


def predicate(schema: Schema, text: str) -> Column | None:
    """Whether some searched field has some term as whole words, whatever the case and the accents. None if nothing is searched.

    A word is bounded by anything but letters, digits and underscores. Stop words match nothing.
    """
    fields, found = [f for f in schema.fields if f.text_search], terms(text)
    if not fields or not found:
        return None
    sought = [without_accents(t) for t in found if t.lower() not in STOP_WORDS]
    if not sought:
        return F.lit(False)
    pattern = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t).replace(" ", r"\s+") for t in sought) + r")(?![\p{L}\p{N}_])"
    return reduce(Column.__or__, [F.coalesce(unaccented(F.col(f"`{f.name}`")).rlike(pattern), F.lit(False)) for f in fields])
