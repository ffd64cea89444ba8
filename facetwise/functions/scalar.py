"""Scalar column functions."""

from __future__ import annotations

import functools
import re
import unicodedata
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Field, Kind

EPOCH = datetime(2000, 1, 1)
#: Of the ellipsoid WGS-84.
METRES_A_MILE, EQUATOR_METRES, FLATTENING = 1609.344, 6_378_137.0, 1 / 298.257223563

# Words that a word blob and a keyword search leave out.
STOP_WORDS = "0 1 2 3 4 5 6 7 8 9 $ a about after all also an and another any are as at be because been before being between both but by came can come could did do does each else for from get got has had he have her here him himself his how if in into is it its just like make many me might more most much must my never no now of on only or other our out over re said same see should since so some still such take than that the their them then there these they this those through to too under up use very want was way we well were what when where which while who will with would you your".split()


def facet_text(f: Field, c: Column) -> Column:
    """The text of a facet value: buckets as their lower end (division truncates toward zero), times to the second."""
    if f.numeric_break:
        return bucket(f, c).cast("string")
    if f.kind == Kind.DATETIME:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def bucket(f: Field, c: Column) -> Column:
    whole = c - c % F.lit(f.numeric_break)  # as % takes the sign of c, this truncates toward zero
    return whole.cast("long")


def seconds_since_epoch(now: datetime | None = None) -> int:
    """Whole seconds since 2000-01-01 UTC."""
    return int(((now or datetime.now(UTC).replace(tzinfo=None)) - EPOCH).total_seconds())


def miles(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Distance on the ellipsoid WGS-84 by Lambert's formula, to some tens of metres except near the opposite point."""
    square = lambda c: c * c
    middle, half, turn = F.radians(lat + at_lat) / 2, F.radians(lat - at_lat) / 2, F.radians(lon - at_lon) / 2
    near = square(F.sin(half)) * square(F.cos(turn)) + square(F.cos(middle)) * square(F.sin(turn))
    far = square(F.cos(half)) * square(F.cos(turn)) + square(F.sin(middle)) * square(F.sin(turn))
    angle = F.atan2(F.sqrt(near), F.sqrt(far))
    some = lambda c: F.when(c > 0, c)
    ratio = F.sqrt(near * far) / some(angle)
    flat = (3 * ratio - 1) / (2 * some(far)) * square(F.sin(middle)) * square(F.cos(half)) - (3 * ratio + 1) / (2 * some(near)) * square(F.cos(middle)) * square(F.sin(half))
    straight = F.lit(2 * EQUATOR_METRES / METRES_A_MILE) * angle
    return F.when(near < 1e-15, straight).when(far < 1e-9, straight).otherwise(straight * (1 + F.lit(FLATTENING) * flat))


def without_accents(text: str) -> str:
    """A text of Python's as unaccented() makes a column."""
    return re.sub(r"[\u0300-\u036f]", "", text.translate(_base_letters()))


def unaccented(text: Column) -> Column:
    """Letters of the Latin and Greek blocks without their marks; marks that stand by themselves go."""
    letters = _base_letters()
    return F.regexp_replace(F.translate(text, "".join(map(chr, letters)), "".join(letters.values())), r"[\u0300-\u036f]", "")


@functools.cache
def _base_letters() -> dict[int, str]:
    """Code point -> the letter that its canonical decomposition begins with."""
    blocks = [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]
    return {i: base for i in blocks if (base := unicodedata.normalize("NFD", chr(i))[0]) != chr(i) and base.isalpha()}


def row_hash(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def word_blob(text: Column) -> Column:
    """The text's words in order, without stop words whatever their case; quotes, commas, stops and line breaks count as spaces. NULL for an empty text."""
    words = F.split(F.regexp_replace(text, "[\",.!?\\r\\n]", " "), " ")
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))
    return F.when(text != "", F.array_join(kept, " "))
