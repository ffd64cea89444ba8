"""Language of a text by a bidirectional gated recurrent network over its bytes.

The UTF-8 bytes of a text fall into windows of WINDOW bytes. A step of the network reads FRAME bytes, each through a
table of its place in the frame; the states of both directions label every one of the bytes with a probability for
each language. A document's probabilities are the means of its bytes' over the whole text; the language is that with
the greatest mean logarithm, the score its mean probability.

Trained in numpy by backpropagation through the steps of a window, on up to WINDOWS_OF_TEXT windows of each of at most SAMPLE
documents of every language whose doc_id isn't held out (the least by hash): the bound of the sample. A window's states begin
at zero, so a label depends on its window. A lang column of over MOST_LANGUAGES values is an error. Of several texts under
one doc_id and language that with the least hash is learned from. Equal texts have equal labels. Null text, and text
without a letter, is `und` with score 0; so is every text if there is nothing to learn from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, texts
from .gru import Adam, backward, forward, step

FOLDS, SAMPLE, MOST_LANGUAGES, UNDETERMINED = 5, 500, 10_000, "und"
SIZE, FRAME, WINDOW = 16, 4, 128
UPDATES, BATCH, RATE, WINDOWS_OF_TEXT = 260, 192, 0.012, 24
#: Windows that go through the network together.
TOGETHER = 4096

_letter = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def windows(raw: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes; the last is filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def _inputs(table: np.ndarray, bias: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Sum over the frame's places of their bytes' rows. frames (..., FRAME)."""
    out = table[0][frames[..., 0]]
    for s in range(1, FRAME):
        out += table[s][frames[..., s]]
    out += bias
    return out


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """rows: (text, language)."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    pools = []
    for lang in languages:
        own = [w for w in (windows(t.encode()) for t, x in rows if x == lang) if len(w)]
        pools.append(np.concatenate([w[rng.permutation(len(w))[:WINDOWS_OF_TEXT]] for w in own]) if own else np.zeros((1, WINDOW), np.uint8))
    n, f32 = len(languages), np.float32
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(f32)
    weights = {"out": draw(2 * SIZE, FRAME * n), "bias": np.zeros(FRAME * n, f32)}
    for d in "fb":
        weights |= {f"table_{d}": draw(FRAME, 256, 3 * SIZE), f"in_{d}": np.zeros(3 * SIZE, f32), f"u_{d}": draw(SIZE, 3 * SIZE) * 2}
    adam, steps = Adam(weights, RATE), WINDOW // FRAME
    for i in range(UPDATES if n else 0):
        y = rng.integers(0, n, BATCH)
        own = np.stack([pools[k][rng.integers(len(pools[k]))] for k in y])
        frames = own.reshape(BATCH, steps, FRAME).transpose(1, 0, 2)
        valid = (own != 0).reshape(BATCH, steps, FRAME).transpose(1, 0, 2)
        start, kept, states = np.zeros((BATCH, SIZE), f32), {}, []
        for d in "fb":
            xs = _inputs(weights[f"table_{d}"], weights[f"in_{d}"], frames if d == "f" else frames[::-1])
            hs, kept[d] = forward(xs, start, weights[f"u_{d}"])
            states.append(hs if d == "f" else hs[::-1])
        both = np.concatenate(states, axis=2)
        logits = (both @ weights["out"] + weights["bias"]).reshape(steps, BATCH, FRAME, n)
        logits -= logits.max(axis=3, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=3, keepdims=True)
        p[:, np.arange(BATCH), :, y] -= 1
        p *= valid[..., None] / max(1, valid.sum())
        g = p.reshape(steps, BATCH, FRAME * n).astype(f32)
        grads = {"out": both.reshape(-1, 2 * SIZE).T @ g.reshape(-1, FRAME * n), "bias": g.sum(axis=(0, 1))}
        dboth = g @ weights["out"].T
        for d, part in (("f", dboth[..., :SIZE]), ("b", dboth[::-1, :, SIZE:])):
            dxs, grads[f"u_{d}"] = backward(part, kept[d], weights[f"u_{d}"])
            grads[f"in_{d}"] = dxs.sum(axis=(0, 1))
            dtable, seen = np.zeros_like(weights[f"table_{d}"]), frames if d == "f" else frames[::-1]
            for s in range(FRAME):
                np.add.at(dtable[s], seen[..., s].ravel(), dxs.reshape(-1, 3 * SIZE))
            grads[f"table_{d}"] = dtable
        adam.update(grads, max(0.05, 1 - i / UPDATES))
    return Model(languages, weights)


def _label(model: Model, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows of bytes: sums over their bytes of the languages' log probabilities and probabilities."""
    w, rows, steps, n = model.weights, len(own), WINDOW // FRAME, len(model.languages)
    frames = own.reshape(rows, steps, FRAME)
    logits = np.empty((steps, rows, FRAME * n), np.float32)
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h, out = np.zeros((rows, SIZE), np.float32), w["out"][:SIZE] if d == "f" else w["out"][SIZE:]
        for t in order:
            h = step(_inputs(w[f"table_{d}"], w[f"in_{d}"], frames[:, t]), h, w[f"u_{d}"])
            if d == "f":
                np.matmul(h, out, out=logits[t])
            else:
                logits[t] += h @ out
    logits += w["bias"]
    logits = logits.transpose(1, 0, 2).reshape(rows, WINDOW, n)
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=2, keepdims=True)
    logits -= np.log(total)
    p /= total
    valid = (own != 0).astype(np.float32)
    return np.einsum("rwn,rw->rn", logits, valid), np.einsum("rwn,rw->rn", p, valid)


def label(model: Model, many: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UNDETERMINED] * len(many), [0.0] * len(many)
    if not model.languages:
        return names, scores
    n = len(model.languages)
    logs, chances, total = np.zeros((len(many), n)), np.zeros((len(many), n)), np.zeros(len(many))
    held, owner, size = [], [], 0

    def run() -> None:
        nonlocal held, owner, size
        own, who = np.concatenate(held), np.concatenate(owner)
        for i in range(0, len(own), TOGETHER):
            a, b = _label(model, own[i : i + TOGETHER])
            np.add.at(logs, who[i : i + TOGETHER], a)
            np.add.at(chances, who[i : i + TOGETHER], b)
            np.add.at(total, who[i : i + TOGETHER], (own[i : i + TOGETHER] != 0).sum(axis=1))
        held, owner, size = [], [], 0

    some = [i for i, t in enumerate(many) if t and _letter.search(t)]
    for i in some:
        own = windows(many[i].encode())
        held.append(own)
        owner.append(np.full(len(own), i))
        size += len(own)
        if size >= TOGETHER:
            run()
    if held:
        run()
    for i in some:
        best = int(logs[i].argmax())
        names[i], scores[i] = model.languages[best], float(min(1.0, max(0.0, chances[i, best] / max(1.0, total[i]))))
    return names, scores


def sample(docs: DataFrame, folds: int = FOLDS) -> list[tuple[str, str]]:
    """(text, language) of at most SAMPLE documents of each language, none held out. Each doc_id counts once for a language."""
    rows = texts(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), "lang")
    rows = rows.filter("doc_id is not null and lang is not null").filter(~held_out(F.col("doc_id"), folds))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has over {MOST_LANGUAGES} values; a network with so many outputs isn't trained")
    if not counts:
        return []
    # so many by the share of hashes that a few more than SAMPLE come, whatever the language's size
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.3 * SAMPLE / r["n"] + 20 / r["n"])) for r in counts], "lang string, share double")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    some = rows.join(F.broadcast(shares), "lang").filter(h / 1_000_003.0 <= F.col("share"))
    some = some.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    by_lang: dict[str, list] = {}
    for r in sorted(some.select("lang", "doc_id", F.col("least.text").alias("text"), h.alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        by_lang.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    return [(text, lang) for lang in sorted(by_lang) for _, text in sorted(by_lang[lang][:SAMPLE])]


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score."""
    model = train(sample(docs, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = label(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score")
