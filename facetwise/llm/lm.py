r"""Scoring of texts by a gated recurrent language model over words, beside a smoothed unigram base.

Tokens: the text's ASCII letters are lower-cased; words `[^\x20\x09-\x0D]+`, then one end. Counts c of all words, over every
training document, come from a distributed aggregation; N is their sum and V the number of different ones.

Base: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))).

Model: the network's symbols are the end, the commonest words, and bins of other words by their last two characters. Its
output softmax is factored: a class of symbols, then a symbol of the class. A word of a bin has the bin's probability
times (c + 0.1) / (N_bin + 0.1 (V_bin + 1)), so the probabilities of all words, unseen ones included, sum to at most one.
The state is carried across windows, so a document's score is the log-likelihood of the whole text.

The network's weights are trained in numpy by truncated backpropagation on every symbol of every training document, in ROUNDS
rounds, each over another part of all texts' pieces of PIECE symbols, dealt by hash. A learner has SHARE symbols in all; in a round every learner
goes on from the same weights once over its own pieces, and the weights are averaged by symbols, in a tree of FAN. So learners
grow in number with the corpus, and no task or driver holds more than a learner's share or FAN weights. Weights drawn at random
average badly, so those of the first round come from some slices of SLICE characters (drawn: GROW of all, SAMPLE at least), gone over
UPDATES times by learners of LEARNER slices; that is a start only, and the slices' documents are gone through again with all others.

Counts for scoring: the commonest words, at most COMMON, go to the workers as a table of that fixed size; other words
are joined by a shuffle, in which no word has more rows than the last common one has occurrences. Null text
counts as empty: the end alone. Without training documents every count is 0 and the model is uniform over its symbols.
Rows that repeat a doc_id are rows each for itself; equal texts have equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, settle, texts
from .gru import Adam, backward_columns, forward_columns, half_gates, step_columns

FOLDS, SAMPLE, GROW, SLICE, COMMON = 10, 1000, 0.01, 20_000, 150_000
#: Symbols: the end, WORDS words, BINS bins and one for all other words; CLASS of them in a class.
WORDS, BINS, CLASS, SIZE = 700, 290, 31, 20
STEPS, STREAMS, UPDATES, RATE = 24, 48, 700, 0.012
#: Slices of a learner, rounds, weights that are averaged together.
LEARNER, ROUNDS, FAN = 600, 4, 32
#: Of the pass over all training documents: streams at most, symbols of a piece, of a learner.
WIDE, PIECE, SHARE = 256, 5_000, 4_000_000
#: Steps of a scoring window; bytes of text that are scored together.
WINDOW, TOGETHER = 24, 16_000_000
SMOOTH = 0.1
#: Of symbols in tables.
SYMBOL = "<u2"


def words(text: str) -> list[str]:
    own = text.encode().lower().split()  # of bytes, which knows just these six kinds of white space and capitals A-Z
    return b" ".join(own).decode().split(" ") if own else []


@dataclass
class Model:
    """What a worker needs; its size is fixed by the parameters."""

    total: int = 0  # N
    different: int = 0  # V
    ends: int = 0
    common: list[tuple[str, int]] = field(default_factory=list)  # by count, the first WORDS are symbols
    bins: dict[str, int] = field(default_factory=dict)  # last two characters -> symbol
    bin_sizes: dict[int, tuple[int, int]] = field(default_factory=dict)  # symbol -> N, V of its words
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def symbols(self) -> int:
        return 2 + min(WORDS, len(self.common)) + len(self.bins)

    @property
    def other(self) -> int:
        return 1

    def bin(self, word: str) -> int:
        return self.bins.get(word[-2:], self.other)


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of texts: the place of each one's text, its number, and the words by number; words() of them, and maybe an empty one that none has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))  # knows the same six kinds of white space and capitals
    coded = pc.dictionary_encode(lists.flatten())
    number, owner = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()  # beside white space at either end
    if empty >= 0:
        real = number != empty
        number, owner = number[real], owner[real]
    return owner, number, coded.dictionary


def count_words(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(word, c) over the rows that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "text", 2 * TOGETHER)):
            _, number, found = split(b.column("text"))
            n = np.bincount(number, minlength=len(found))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([found.take(pa.array(some)).cast(pa.string()), pa.array(n[some].astype(np.int64))], ["word", "n"])

    learned = texts(docs).filter(~held_out(F.col("doc_id"), folds)).select("text")
    return learned.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame, ends: int) -> Model:
    """The model without weights, from the counts of all words."""
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # a threshold that at most COMMON words reach, from the numbers of words by the size of their count
    sizes = counts.groupBy(F.floor(F.log(F.col("c").cast("double")) * 50).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    least, room = None, COMMON
    for r in sizes.orderBy(F.desc("size")).collect():  # some hundred rows
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    some = counts.filter(F.col("c") >= least).collect() if least is not None else []
    common = [(r["word"], r["c"]) for r in sorted(some, key=lambda r: (-r["c"], r["word"]))]
    model = Model(total + ends, different + (ends > 0), ends, common)
    rest = counts
    if common:  # the words that aren't symbols
        last = common[min(WORDS, len(common)) - 1]
        rest = counts.filter((F.col("c") < last[1]) | ((F.col("c") == last[1]) & (F.col("word") > last[0])))
    by_end = rest.groupBy(F.substring("word", -2, 2).alias("end")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    top = by_end.orderBy(F.desc("n"), "end").limit(BINS).collect()
    first = 2 + min(WORDS, len(common))
    for i, r in enumerate(top):
        model.bins[r["end"]] = first + i
        model.bin_sizes[first + i] = (r["n"], r["v"])
    n, v = total - sum(c for _, c in common[:WORDS]), different - min(WORDS, len(common))
    model.bin_sizes[model.other] = (n - sum(x for x, _ in model.bin_sizes.values()), v - sum(x for _, x in model.bin_sizes.values()))
    return model


class Network:
    """The weights at work. Symbol k is number k % CLASS of class k // CLASS; the last class may have fewer."""

    def __init__(self, weights: dict[str, np.ndarray], symbols: int):
        self.w, self.symbols, self.classes = weights, symbols, -(-symbols // CLASS)

    @staticmethod
    def new(symbols: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
        classes = -(-symbols // CLASS)
        draw = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        inner = np.zeros((classes, CLASS), np.float32)
        inner.ravel()[symbols:] = -1e4  # places that no symbol has
        return {"table": draw(0.1, symbols, 3 * SIZE), "in": np.zeros(3 * SIZE, np.float32), "u": draw(0.2, SIZE, 3 * SIZE), "class": draw(0.1, SIZE, classes), "class_bias": np.zeros(classes, np.float32), "inner": draw(0.1, classes, SIZE, CLASS), "inner_bias": inner}

    def log_chances(self, states: np.ndarray, symbols: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the symbols after the states. With grads: adds those of their mean loss, and gives that by the states."""
        w, rows = self.w, np.arange(len(symbols))
        cls, place = np.divmod(np.asarray(symbols).astype(np.uint16), np.uint16(CLASS))
        order = np.argsort(cls, kind="stable")  # of small numbers: by radix
        cls, place, here = cls[order], place[order], np.asarray(states, np.float32)[order]
        bounds = np.searchsorted(cls, np.arange(self.classes + 1))
        parts = [(c, slice(bounds[c], bounds[c + 1])) for c in range(self.classes) if bounds[c] < bounds[c + 1]]
        x, y = here @ w["class"], np.empty((len(symbols), CLASS), np.float32)
        x += w["class_bias"]
        for c, at in parts:
            np.matmul(here[at], w["inner"][c], out=y[at])
            y[at] += w["inner_bias"][c]
        if not self.small:
            x -= x.max(axis=1, keepdims=True)
            y -= y.max(axis=1, keepdims=True)
        own = x[rows, cls] + y[rows, place]
        np.exp(x, out=x)
        np.exp(y, out=y)
        in_x, in_y = x @ np.ones(self.classes, np.float32), y @ np.ones(CLASS, np.float32)
        own -= np.log(in_x)
        own -= np.log(in_y)
        out, dstates = np.empty(len(symbols), np.float32), None
        out[order] = own
        if grads is not None:
            scale = np.float32(1 / max(1, len(symbols)))
            x *= (scale / in_x)[:, None]
            y *= (scale / in_y)[:, None]
            x[rows, cls] -= scale
            y[rows, place] -= scale
            d = x @ w["class"].T
            grads["class"], grads["class_bias"] = here.T @ x, x.sum(axis=0)
            grads["inner"], grads["inner_bias"] = np.zeros_like(w["inner"]), np.zeros_like(w["inner_bias"])
            for c, at in parts:
                d[at] += y[at] @ w["inner"][c].T
                grads["inner"][c], grads["inner_bias"][c] = here[at].T @ y[at], y[at].sum(axis=0)
            dstates = np.empty_like(d)
            dstates[order] = d
        return out, dstates

    @property
    def small(self) -> bool:
        """Whether no logit can be so large that its exponential needs the greatest one taken off; states are within -1 and 1."""
        w = self.w
        most = np.abs(w["class"]).sum(axis=0) + np.abs(w["class_bias"])
        # biases of places without a symbol are below 0 by far
        inner = np.abs(w["inner"]).sum(axis=1) + np.where(w["inner_bias"] < -1e3, 0, np.abs(w["inner_bias"]))
        return float(max(most.max(initial=0), inner.max(initial=0))) < 60

    def score(self, many: list[np.ndarray]) -> np.ndarray:
        """Log-likelihood of each sequence of symbols (ends included), in natural logarithms."""
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        lengths = np.array([len(many[i]) for i in order])
        flat = np.concatenate([many[i] for i in order]) if order else np.zeros(0, np.int32)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if order else lengths
        table, u = half_gates(self.w["table"] + self.w["in"]), np.ascontiguousarray(half_gates(self.w["u"]).T)
        out, state = np.zeros(len(many)), np.zeros((SIZE, len(many)), np.float32)
        before = np.zeros(len(many), np.int32)  # a text begins as if after an end, symbol 0
        for t0 in range(0, int(lengths.max(initial=0)), WINDOW):
            # sequences longer than t come first
            owners = [int(n) for n in np.searchsorted(-lengths, -np.arange(t0, t0 + WINDOW), "left") if n]
            ends = np.cumsum(owners)
            states, symbols = np.empty((ends[-1], SIZE), np.float32), np.empty(ends[-1], np.int32)
            for t, (n, end) in enumerate(zip(owners, ends.tolist())):
                state = step_columns(np.ascontiguousarray(table[before[:n]].T), state[:, :n], u)
                before = flat[begins[:n] + t0 + t]
                states[end - n : end], symbols[end - n : end] = state.T, before
            logs, _ = self.log_chances(states, symbols)
            for n, end in zip(owners, ends.tolist()):
                out[:n] += logs[end - n : end]
        back = np.empty(len(many))
        back[order] = out
        return back


def learn_window(net: Network, adam: Adam, x: np.ndarray, y: np.ndarray, state: np.ndarray, scale: float) -> np.ndarray:
    """An update by the symbols y (steps, streams) that follow x, from the states (SIZE, streams) before; gives those after."""
    w = net.w
    table = half_gates(w["table"] + w["in"])
    xs = np.ascontiguousarray(table[x].transpose(0, 2, 1))
    states, kept = forward_columns(xs, state, np.ascontiguousarray(half_gates(w["u"]).T))
    grads: dict[str, np.ndarray] = {}
    _, dstates = net.log_chances(states.transpose(0, 2, 1).reshape(-1, SIZE), y.ravel(), grads)
    dxs, grads["u"] = backward_columns(np.ascontiguousarray(dstates.reshape(*y.shape, SIZE).transpose(0, 2, 1)), kept, w["u"])
    dxs = dxs.transpose(0, 2, 1).reshape(-1, 3 * SIZE)
    grads["in"] = dxs.sum(axis=0)
    grads["table"] = np.zeros_like(w["table"])
    own = x.ravel().astype(np.uint16)
    order = np.argsort(own, kind="stable")
    own = own[order]
    begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    grads["table"][own[begins]] = np.add.reduceat(dxs[order], begins, axis=0)
    adam.update(grads, scale)
    return states[-1].copy()


def train(weights: dict[str, np.ndarray], symbols: int, some: list[np.ndarray], first: int = 0, updates: int = UPDATES, seed: int = 1) -> dict[str, np.ndarray]:
    """The weights after updates first, first + 1, ... of UPDATES, by truncated backpropagation over STREAMS streams of the sequences of symbols."""
    rng = np.random.default_rng((seed, first))
    net = Network({k: w.copy() for k, w in weights.items()}, symbols)
    if not some:
        return net.w
    order = rng.permutation(len(some))
    all_ = np.concatenate([some[i] for i in order])
    streams, steps = min(STREAMS, max(1, len(all_) // 2)), STEPS
    length = len(all_) // streams
    data = all_[: length * streams].reshape(streams, length).T  # (length, streams)
    adam, state, at = Adam(net.w, RATE), np.zeros((SIZE, streams), np.float32), 0
    for i in range(first, first + updates):
        if at + 1 >= length:
            state, at = np.zeros((SIZE, streams), np.float32), int(rng.integers(0, max(1, min(steps, length - 1))))
        y = data[at : at + steps]
        x = np.concatenate([data[at - 1 : at] if at else np.zeros((1, streams), np.int32), y[:-1]])
        state = learn_window(net, adam, x, y, state, max(0.05, 1 - i / UPDATES))
        at += len(y)
    return net.w


def go_through(weights: dict[str, np.ndarray], symbols: int, all_: np.ndarray, number: int) -> dict[str, np.ndarray]:
    """The weights after one pass over all symbols in their order, as round `number` of ROUNDS; streams are filled up with symbols from the beginning."""
    net = Network({k: w.copy() for k, w in weights.items()}, symbols)
    if not len(all_):
        return net.w
    streams = min(len(all_), max(STREAMS, min(WIDE, len(all_) // (STEPS * STEPS))))
    length = -(-len(all_) // streams)
    data = np.resize(all_, (streams, length)).T
    adam, state = Adam(net.w, RATE), np.zeros((SIZE, streams), np.float32)
    for at in range(0, length, STEPS):
        y = data[at : at + STEPS]
        x = np.concatenate([data[at - 1 : at] if at else np.zeros((1, streams), data.dtype), y[:-1]])
        state = learn_window(net, adam, x, y, state, max(0.05, 1 - (number + at / length) / ROUNDS))
    return net.w


def flat(weights: dict[str, np.ndarray]) -> bytes:
    return b"".join(weights[k].tobytes() for k in sorted(weights))


def shaped(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at, all_ = {}, 0, np.frombuffer(data, np.float32)
    for k in sorted(like):
        out[k] = all_[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def mean(parts: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    """Of flat weights, by the numbers of symbols that they come from; and the sum of those."""
    total = sum(n for _, n in parts)
    return sum(np.frombuffer(w, np.float32) * np.float32(n / total) for w, n in parts).astype(np.float32).tobytes(), total


def drawn(rows: DataFrame) -> DataFrame:
    """(text, first, last): slices of the rows' texts, GROW of all and SAMPLE at least, and whether each is its text's first and last one."""
    span = 1 << 40
    many = F.ceil(F.length("text") / SLICE)
    total = rows.agg(F.sum(F.greatest(many, F.lit(1)))).first()[0] or 0
    most = span if total <= SAMPLE else int(span * max(GROW, SAMPLE / total))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("many", F.greatest(many, F.lit(1)).cast("int"))
    chosen = F.filter(F.sequence(F.lit(0), F.col("many") - 1), lambda k: F.pmod(F.xxhash64(F.col("h"), k), F.lit(span)) < most)
    parts = F.transform(chosen, lambda k: F.struct(F.substr(F.col("text"), k * SLICE + 1, F.lit(SLICE)).alias("text"), (k == 0).alias("first"), (k == F.col("many") - 1).alias("last"), F.xxhash64(F.col("h"), k, F.lit(1)).alias("h")))
    return rows.select(F.inline(parts))


def learner(held, symbols: int, first: int, updates: int):
    """A function of one learner's slices that gives its weights after its updates; held: the weights before, broadcast."""

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by([("h", "ascending")])
        some = [np.asarray(x, np.int32) for x in own.column("symbols").to_pylist() if len(x)]
        name = own.column("learner")[0].as_py()
        new = train(held.value, symbols, some, first, updates, name)
        return pa.table({"learner": pa.array([name], pa.int32()), "weights": pa.array([flat(new)], pa.binary()), "n": pa.array([1 + sum(map(len, some))], pa.int64())})

    return run


def averaged(table: pa.Table) -> pa.Table:
    w, n = mean(list(zip(table.column("weights").to_pylist(), table.column("n").to_pylist())))
    return pa.table({"learner": pa.array([table.column("learner")[0].as_py()], pa.int32()), "weights": pa.array([w], pa.binary()), "n": pa.array([n], pa.int64())})


def gone_through(held, symbols: int, number: int):
    """A function of one learner's pieces of round `number` that gives its weights after them; held: the weights before, broadcast."""

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by([("h", "ascending")])
        all_ = np.concatenate([np.frombuffer(x, SYMBOL) for x in own.column("symbols").to_pylist()])
        new = go_through(held.value, symbols, all_, number)
        return pa.table({"learner": own.column("learner").slice(0, 1), "weights": pa.array([flat(new)], pa.binary()), "n": pa.array([len(all_)], pa.int64())})

    return run


def together(rows: DataFrame, learners: int, work, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the weights that work gives for each learner's rows; weights where there are no rows."""
    out, left = "learner int, weights binary, n long", learners
    rows = rows.groupBy("learner").applyInArrow(work, out)
    while left > FAN:
        left = -(-left // FAN)
        rows = rows.withColumn("learner", F.pmod(F.col("learner"), F.lit(left)).cast("int")).groupBy("learner").applyInArrow(averaged, out)
    parts = [(bytes(r["weights"]), r["n"]) for r in sorted(rows.collect(), key=lambda r: r["learner"])]
    return shaped(mean(parts)[0], weights) if parts else weights


def started(model: Model, slices_: DataFrame) -> dict[str, np.ndarray]:
    """Weights to start from, from the slices, a settled table."""
    spark, learners = slices_.sparkSession, -(-slices_.count() // LEARNER)
    weights = Network.new(model.symbols, np.random.default_rng(1))
    if not learners:
        return weights
    held = spark.sparkContext.broadcast(model)
    symbols = model.symbols

    def to_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for b in batches:
            found = reader.read(b.column("text")).each()
            # what a slice begins or ends within is no word
            found = [x[0 if first.as_py() else 1 : len(x) if last.as_py() else -2] for x, first, last in zip(found, b.column("first"), b.column("last"))]
            yield pa.RecordBatch.from_arrays([b.column("learner"), b.column("h"), pa.array(found, pa.list_(pa.int32()))], ["learner", "h", "symbols"])

    dealt = slices_.withColumn("learner", F.pmod(F.xxhash64("h"), F.lit(learners)).cast("int"))
    dealt = settle(dealt.mapInArrow(to_symbols, "learner int, h long, symbols array<int>"), "learners")
    updates = -(-UPDATES // ROUNDS)
    for first in range(0, UPDATES, updates):
        weights = together(dealt, learners, learner(spark.sparkContext.broadcast(weights), symbols, first, updates), weights)
    return weights


def fitted(model: Model, weights: dict[str, np.ndarray], rows: DataFrame) -> dict[str, np.ndarray]:
    """The weights after every symbol of rows, the training documents of readings() as a settled table."""
    context = rows.sparkSession.sparkContext
    learners = max(1, round((rows.agg(F.sum("n_tokens")).first()[0] or 0) / SHARE))
    size = PIECE * np.dtype(SYMBOL).itemsize
    rows = rows.select("symbols", F.xxhash64("doc_id", "symbols", "row").alias("h"))  # row: so that copies of a row don't all go to one learner
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("symbols") - 1) / size).cast("int")), lambda k: F.struct(F.substr(F.col("symbols"), k * size + 1, F.lit(size)).alias("symbols"), F.xxhash64(F.col("h"), k).alias("h")))
    pieces = rows.select(F.inline(cut)).withColumn("learner", F.pmod(F.col("h"), F.lit(learners)).cast("int"))
    for number in range(ROUNDS):
        own = pieces.filter(F.pmod(F.xxhash64("h"), F.lit(ROUNDS)) == number)
        weights = together(own, learners, gone_through(context.broadcast(weights), model.symbols, number), weights)
    return weights


@dataclass
class Reading:
    """Of texts: symbols, all in one array, and where each text's end; by text what is known without the table of all counts; the other words."""

    symbols: np.ndarray
    ends: np.ndarray
    known: np.ndarray  # tokens
    logs: np.ndarray  # sum of log10(c + 0.1) of common words and the end
    spelled: np.ndarray  # the bins' part of the score
    rare: pa.ListArray  # (word, n)

    def each(self) -> list[np.ndarray]:
        return np.split(self.symbols, self.ends[:-1]) if len(self.ends) else []

    def binary(self) -> pa.Array:
        offsets = np.concatenate([[0], self.ends * self.symbols.itemsize]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.ends), [None, pa.py_buffer(offsets), pa.py_buffer(self.symbols)])


class Reader:
    """Texts to symbols and what is known about their words without the table of all counts."""

    def __init__(self, model: Model):
        self.model = model
        first = 2
        n = min(WORDS, len(model.common))
        self.common = pa.array([w for w, _ in model.common], pa.string())
        self.symbol = np.array([first + i if i < n else model.bin(w) for i, (w, _) in enumerate(model.common)] + [0], np.int64)
        self.log_count = np.array([math.log10(c + SMOOTH) for _, c in model.common] + [0.0])
        self.spelled = np.array([i >= n for i in range(len(model.common))] + [False])  # words of bins
        self.log_bin = np.zeros(model.symbols)
        for k, (n_bin, v_bin) in model.bin_sizes.items():
            self.log_bin[k] = math.log10(n_bin + SMOOTH * (v_bin + 1))
        self.bins = pa.array(list(model.bins), pa.string())
        self.bin_symbol = np.array([*model.bins.values(), model.other], np.int64)

    def read(self, column: pa.Array) -> Reading:
        model, texts_ = self.model, len(column)
        owner, number, found = split(column)
        found = found.cast(pa.string())
        # by different word; the last place of the model's arrays is that of none
        at = pc.fill_null(pc.index_in(found, value_set=self.common), -1).to_numpy(zero_copy_only=False)
        by_end = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(found, -2), value_set=self.bins), -1).to_numpy(zero_copy_only=False)
        common = at >= 0
        symbol = np.where(common, self.symbol[at], self.bin_symbol[by_end])
        log = self.log_count[at]
        spelled = np.where(self.spelled[at], log, 0.0) - self.log_bin[symbol]
        lengths = np.bincount(owner, minlength=texts_)
        symbols = np.zeros(len(owner) + texts_, SYMBOL)  # ends are 0
        symbols[np.arange(len(owner)) + owner] = symbol[number]
        seen = common[number]
        pairs, n = np.unique(owner[~seen] * len(found) + number[~seen], return_counts=True)
        of, word = np.divmod(pairs, max(1, len(found)))
        rare = pa.StructArray.from_arrays([found.take(pa.array(word, pa.int64())), pa.array(n, pa.int64())], ["word", "n"])
        return Reading(
            symbols, np.cumsum(lengths + 1), np.bincount(owner[seen], minlength=texts_) + (model.ends > 0), np.bincount(owner, log[number], texts_) + math.log10(model.ends + SMOOTH), np.bincount(owner, spelled[number], texts_),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=texts_))]), pa.int32()), rare),
        )


def readings(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """Rows of docs as a Reader reads them, numbered, with their whole texts' symbols."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, row = Reader(held.value), TaskContext.get().partitionId() << 40
        for b in (part for whole in batches for part in slices(whole, "text", TOGETHER)):
            r = reader.read(b.column("text"))
            n_tokens = np.diff(r.ends, prepend=0)
            columns = [pa.array(np.arange(row, row + b.num_rows)), b.column("doc_id"), b.column("held_out"), *(pa.array(x, pa.int64()) for x in (n_tokens, r.known)), *(pa.array(x, pa.float64()) for x in (r.logs, r.spelled)), r.rare, r.binary()]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "spelled", "rare", "symbols"])

    out = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, spelled double, rare array<struct<word: string, n: bigint>>, symbols binary"
    return texts(docs).withColumn("held_out", held_out(F.col("doc_id"), folds)).mapInArrow(run, out)


def read_and_learn(docs: DataFrame, counts: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, Model]:
    """readings(docs) as a settled table, and the model, trained. counts: of count_words(docs), as a settled table."""
    rows = texts(docs).filter(~held_out(F.col("doc_id"), folds))
    model = vocabulary(counts, rows.count())
    read = settle(readings(docs, model, folds), "read")
    model.weights = fitted(model, started(model, settle(drawn(rows), "slices")), read.filter(~F.col("held_out")))
    return read, model


def learn(docs: DataFrame, counts: DataFrame, folds: int = FOLDS) -> Model:
    return read_and_learn(docs, counts, folds)[1]


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of the column."""
    ends = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counts = settle(count_words(docs, folds), "word-counts")
    read, model = read_and_learn(docs, counts, folds)
    held, symbols = docs.sparkSession.sparkContext.broadcast(model.weights), model.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(held.value, symbols)
        for b in (part for whole in batches for part in slices(whole, "symbols", TOGETHER // 4)):
            logs = net.score([np.frombuffer(x.as_buffer(), SYMBOL) for x in b.column("symbols")]) / math.log(10)
            spelled = pa.array(logs + b.column("spelled").to_numpy())
            yield pa.RecordBatch.from_arrays([spelled if name == "spelled" else b.column(name) for name in kept], kept)

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "spelled"]
    out = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, spelled double"
    first = settle(read.select(*kept, "symbols").mapInArrow(run, out), "scored")
    rare = read.select("row", F.inline("rare")).join(counts, "word", "left")
    known = F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))
    sums = rare.groupBy("row").agg(known.alias("rare_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("rare_logs"))
    every = math.log10(model.total + SMOOTH * (model.different + 1))
    rows = first.join(sums, "row", "left")
    logs, here = F.coalesce("rare_logs", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + here).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(every)).alias("base_score"), (F.col("spelled") + logs).alias("score"),
    )
