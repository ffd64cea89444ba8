"""Toxicity by compression distance: how much shorter a window gets under a dictionary of toxic text than of ordinary.

Windows are the words of a text, lower-cased, each behind the same LEAD of a few bytes, with which every entry of the
dictionaries begins too, so that zstandard finds a word of a dictionary in one match; long words are cut. Two
dictionaries are trained on labelled rows. The ordinary one has the commonest words of ordinary texts. The
toxic one has patterns: runs of bytes that far more toxic than ordinary texts have, lengthened on both sides as long as
nearly all words that have the run go on in the same way. They are raw-content dictionaries; zstandard's own trainer
makes segments of many words, of which a window matches a part, and was right about 97 texts in 100 instead of 99.9.

A text's evidence is the number of windows that the toxic dictionary makes shorter by at least `margin` bytes. The
margin, and the probability for each number, are calibrated on labelled rows that the dictionaries haven't seen.

Labels are learned from at most TOXIC and ORDINARY rows (the least by hash of doc_id, no longer than LONGEST
characters) whose doc_id isn't held out: the bound of the sample. A doc_id is toxic if any of its labels says so; of several
texts under one doc_id that with the least hash is learned from. Scores cover every row and whole texts; equal texts
have equal scores. Null text counts as empty and gets the probability of no evidence. Without a toxic and an ordinary row to
learn from, every score is 0.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hash, held_out, hold, text_by_text, texts

FOLDS, TOXIC, ORDINARY, LONGEST = 5, 1500, 3000, 50_000
LEAD, LEVEL, LONG = b"\n>>> ", 19, 64
#: A run is of these lengths, in at least LEAST texts and SHARE of the toxic ones, and ODDS times as usual there.
RUNS, LEAST, SHARE, ODDS, SAME, DEPTH = (4, 5, 6), 3, 0.01, 50, 0.85, 4
PATTERNS, WORDS, MEMO = 400, 3000, 300_000
MARGINS, MOST_COUNTED, FEW = (1, 2, 3, 4, 5), 12, 300


def words(text: str) -> list[bytes]:
    """The windows of a text, without the lead."""
    out = []
    for w in text.lower().encode().split():
        out += [b" " + w + b" "] if len(w) <= LONG else [b" " + w[i : i + LONG] + b" " for i in range(0, len(w), LONG // 2)]
    return out


def runs(some: set[bytes]) -> set[bytes]:
    return {w[i : i + n] for w in some for n in RUNS for i in range(len(w) - n + 1)}


def lengthened(run: bytes, seen: Counter) -> tuple[bytes, int]:
    """The run with what nearly all words around it have too; and in how many texts words have it, counted by word."""
    some = [(w, n) for w, n in seen.items() if run in w]
    while True:
        before, after, total = Counter(), Counter(), 0
        for w, n in some:
            i = w.find(run)
            total += n
            before[w[i - 1 : i]] += n * (i > 0)
            after[w[i + len(run) : i + len(run) + 1]] += n * (i + len(run) < len(w))
        for found, longer in ((before, lambda c: c + run), (after, lambda c: run + c)):
            c, n = found.most_common(1)[0] if found else (b"", 0)
            if c and n >= SAME * total:
                run = longer(c)
                some = [(w, k) for w, k in some if run in w]
                break
        else:
            return run, total


def patterns(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Patterns that tell toxic texts, the most telling first.

    Taken one after another: that which most toxic texts have that aren't told by DEPTH others yet. The words it is
    in are then left out, so that neither its own parts nor chance runs of near copies follow.
    """
    here, there, own = Counter(), Counter(), [set(words(t)) for t in toxic]
    for some in own:
        here.update(runs(some))
    for t in ordinary:
        there.update(runs(set(words(t))))
    least = max(LEAST, SHARE * len(toxic))
    odd = {r for r, n in here.items() if n >= least and n / len(toxic) >= ODDS * (there[r] + 0.5) / max(1, len(ordinary))}
    texts_of: dict[bytes, set[int]] = {}
    for i, some in enumerate(own):
        for w in some:
            if w in texts_of or not odd.isdisjoint(runs({w})):
                texts_of.setdefault(w, set()).add(i)
    out, missing = [], [DEPTH] * len(toxic)
    while len(out) < PATTERNS:
        told: dict[bytes, set[int]] = {}
        for w, ids in texts_of.items():
            for r in odd.intersection(runs({w})):
                told.setdefault(r, set()).update(ids)
        gain, run = max(((sum(missing[i] > 0 for i in ids), r) for r, ids in told.items()), default=(0, b""))
        if gain < least:
            break
        run = lengthened(run, Counter({w: len(ids) for w, ids in texts_of.items()}))[0]
        for i in set().union(*(ids for w, ids in texts_of.items() if run in w)):
            missing[i] -= 1
        texts_of = {w: ids for w, ids in texts_of.items() if run not in w}
        out.append(run)
    return out


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    margin: int = 1
    chances: list[float] = field(default_factory=lambda: [0.0])  # by the number of windows

    def key(self) -> str:
        return hashlib.sha256(b"|".join([self.toxic, self.ordinary, repr((self.margin, self.chances)).encode()])).hexdigest()


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.tools = []
        for content in (model.ordinary, model.toxic):
            book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_checksum=False, write_content_size=False, write_dict_id=False))

    def gains(self, windows: list[bytes]) -> list[int]:
        """Bytes by which the toxic dictionary makes each window shorter."""
        memo, (ordinary, toxic) = self.memo, self.tools
        if len(memo) > MEMO:
            memo.clear()
        for w in set(windows).difference(memo):
            memo[w] = len(ordinary.compress(LEAD + w)) - len(toxic.compress(LEAD + w))
        return list(map(memo.__getitem__, windows))

    def score(self, text: str) -> float:
        m, most = self.model, len(self.model.chances) - 1
        if not most:
            return m.chances[0]
        return m.chances[min(most, sum(g >= m.margin for g in self.gains(words(text))))]


def monotone(ones: np.ndarray, all_: np.ndarray) -> list[float]:
    """Probabilities that don't fall: pooled neighbours, with half a row of each kind for every pool."""
    pools = [[float(a), float(b), 1] for a, b in zip(ones, all_)]
    chance = lambda p: (p[0] + 0.5) / (p[1] + 1)
    i = 0
    while i + 1 < len(pools):
        if pools[i + 1][1] == 0 or chance(pools[i]) > chance(pools[i + 1]):
            pools[i : i + 2] = [[x + y for x, y in zip(*pools[i : i + 2])]]
            i = max(0, i - 1)
        else:
            i += 1
    return [chance(p) for p in pools for _ in range(int(p[2]))]


def apart(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows without most of their near copies, which share the least of some hash of their shingles; else a few copied texts make patterns of their own."""
    seen, out = set(), []
    for text, y in rows:
        own = text.lower().encode().split()
        some = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
        keys = {(s, min(xxhash.xxh64_intdigest(x, s) for x in some)) for s in range(4)}
        if seen.isdisjoint(keys):
            out.append((text, y))
        seen |= keys
    return out


def books(rows: list[tuple[str, int]]) -> Model | None:
    """A model with dictionaries, not calibrated yet."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    found = patterns(toxic, ordinary) if toxic and ordinary else []
    if not found:
        return None
    usual = Counter(w for t in ordinary for w in words(t))
    usual_words = sorted(usual, key=lambda w: (-usual[w], w))[:WORDS]
    # what comes last is nearest and costs least to point at
    return Model(b"".join(LEAD + p for p in reversed(found)), b"".join(LEAD + w for w in reversed(usual_words)))


def train(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, 1 if toxic), in an order that has nothing to do with the label.

    A third of the rows is for calibration. Of few toxic rows none can be spared: then each third is calibrated on with
    dictionaries of the other two, and the final ones are of all rows.
    """
    rows = apart(rows)
    few = sum(y for _, y in rows) < FEW
    gains, model = [], None
    for third in range(3 if few else 1):
        model = books([r for i, r in enumerate(rows) if i % 3 != third])
        if model is not None:
            scorer = Scorer(model)
            gains += [(y, np.array(scorer.gains(words(t)) or [0])) for t, y in rows[third::3]]
    if few:
        model = books(rows)
    if model is None or not gains:
        return Model()
    best, ys = None, np.array([y for y, _ in gains])
    for margin in MARGINS:
        counts = np.array([min(MOST_COUNTED, int((g >= margin).sum())) for _, g in gains])
        chances = monotone(np.bincount(counts[ys == 1], minlength=MOST_COUNTED + 1), np.bincount(counts, minlength=MOST_COUNTED + 1))
        p = np.array(chances)[counts]
        loss = -np.log(np.where(ys == 1, p, 1 - p)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, margin, chances)
    model.margin, model.chances = best[1], best[2]
    return model


def sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> list[tuple[str, int]]:
    """(text, toxic) of the rows to learn from; at most TOXIC + ORDINARY. Each doc_id counts once, whatever repeats it."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    most = {1: TOXIC, 0: ORDINARY}
    some = [by_hash(marks.filter(F.col("toxic") == y), ["doc_id"], n) for y, n in most.items()]
    chosen = some[0].unionByName(some[1])  # few more than TOXIC + ORDINARY
    rows = texts(docs).filter(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    rows = rows.select("toxic", F.col("least.text").alias("text"), F.xxhash64("doc_id").alias("h")).collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["h"], r["text"])):
        if most[r["toxic"]] > 0:
            most[r["toxic"]] -= 1
            out.append((r["text"], r["toxic"]))
    return out


_scorers: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One for each worker process and model; its memo serves all tasks."""
    hold("toxicity", _scorers.clear)
    key = model.key()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    model = train(sample(docs, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scorer(model)
        for b in batches:
            found = [tool.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    model = train(sample(docs, labels, folds))

    @F.arrow_udf("double")
    def chance(text: pa.Array) -> pa.Array:
        tool = scorer(model)
        return text_by_text(lambda t: tool.score(t or ""), text, pa.float64())

    return docs.filter(chance(F.col("text").cast("string")) < 0.5)
