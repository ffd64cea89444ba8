"""Tokens, packing and files against the tokenizers' own libraries."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from facetwise.llm import bpe, packing, token_files, tokens
from facetwise.llm.cutting_stock import solve
from facetwise.llm.elias_fano import SAMPLE, EliasFano, build

BITS = ["a", "b", " ", " ", "  ", "\n", "\t", "'", "'s", "'ll", "é", "1", "23", "!", "?!", " ", "　", "日本", "\x1c", "\r\n", "🙂", "xxxxxxx", "the", "<|endoftext|>", "<|startoftext|>", "<|", "<|ENDOFTEXT|>", "Σ", "ΑΣ", "é", "́", "İ", "ǅ", "½", "\x00", "A", "THE", "word.", "&&&", "(x)", "-"]
TEXTS = st.lists(st.sampled_from(BITS), max_size=40).map("".join)


def tool(name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x, add_special_tokens=False).ids


WORD, BYTE = tool(packing.TOKENIZER), tool(token_files.TOKENIZER)
RANKED = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(bpe.RANKS), special_tokens={})
ids = lambda raw: np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_spans_are_the_library(text):
    assert ids(tokens.library(packing.TOKENIZER, False).ids(text)) == WORD(text)
    assert ids(tokens.library(token_files.TOKENIZER, True).ids(text)) == BYTE(text)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 9), st.integers(1, 5))
def test_tree_is_the_library(text, leaf, window):
    encoder = tokens.by_ranks(bpe.RANKS)
    got = bpe.encode(encoder, text, leaf, window)
    assert got == RANKED.encode_ordinary(text)
    assert bpe.decode(encoder.names, got, leaf) == text.encode()


def test_usual_documents_go_through_joins(monkeypatch):
    encoder, joins, own = tokens.by_ranks(bpe.RANKS), [], bpe.join
    monkeypatch.setattr(bpe, "join", lambda *a: joins.append(1) or own(*a))
    text = "some words of a document, " * 57  # 1,482 characters
    assert bpe.encode(encoder, text) == RANKED.encode_ordinary(text) and len(joins) >= 3


def test_join_is_associative():
    encoder = tokens.by_ranks(bpe.RANKS)
    parts = [(t, encoder.ids(t)) for t in ("he", "llo wor", "ld's  ", " end", "")]
    left = parts[0]
    for p in parts[1:]:
        left = bpe.join(encoder, left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = bpe.join(encoder, p, right)
    assert left == right == ("hello world's   end", RANKED.encode_ordinary("hello world's   end"))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    return [(i * 3 - 50, " ".join(rng.choice(["alpha", "the", "Größe", "x.", "y\nz", "&&&"]) for _ in range(rng.choice([0, 1, 5, 80, 700, 1100, 4000])))) for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


def test_round_trip(docs, corpus):
    want = {i: (len(x := RANKED.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in corpus}
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs, leaf=500).collect()} == want


def test_files(spark, docs, corpus, tmp_path):
    want, at = {}, 0
    for i, t in sorted(corpus):
        x = np.array([*BYTE(t), 2], "<u4")
        want[i] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    path = f"file://{tmp_path}/tok"
    sizes = token_files.write(docs, path, file_ids=5000, parts=3)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_files.read(spark, path, sizes).collect()} == want
    names = sorted(os.listdir(tmp_path / "tok"))
    files = [token_files.TokenFile((tmp_path / "tok" / n).read_bytes()) for n in names if n.endswith(".tok")]
    assert len(files) > 3
    docs_of = [(f.doc_id(i), f.document(i).tolist()) for f in files for i in range(f.n)]
    assert docs_of == [(i, [*BYTE(t), 2]) for i, t in sorted(corpus)]


def test_files_with_repeated_and_missing_ids(spark):
    rows = [(None, "a b"), (None, None), (7, "x"), (7, "x"), (7, "y <|endoftext|> z"), (-3, "")]
    got = token_files.write_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = sorted((i if i is not None else -(2**70), len(x := [*BYTE(t or ""), 2]), zlib.crc32(np.array(x, "<u4"))) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -(2**70), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, -3, 7, 7, 7]


def check_packed(rows, corpus, capacity=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in corpus:
        x, at = np.array([*WORD(t), 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        total, padding = total + at, padding + (capacity - at) * (at & (at - 1) != 0)
    return padding / (total + padding)


def test_packing(docs, corpus):
    assert check_packed(packing.pack(docs).collect(), corpus) < 0.02


def test_packing_cuts_what_does_not_fit(spark):
    corpus = [(i, "the " * 1499) for i in range(240)]  # 1500 ids each: whole ones would leave a quarter empty
    assert check_packed(packing.pack(spark.createDataFrame(corpus, "doc_id long, text string")).collect(), corpus) < 0.01


@pytest.mark.parametrize("kind", ["none", "one", "few", "lognormal", "uniform", "same", "large"])
def test_cutting_stock(kind):
    rng = np.random.default_rng(4)
    lengths = {
        "none": np.zeros(0, int), "one": np.array([64]), "few": np.array([3, 64, 5, 60, 61]), "lognormal": np.clip(rng.lognormal(2.5, 1, 3000), 1, 64).astype(int), "uniform": rng.integers(1, 65, 500),
        "same": np.full(1000, 47), "large": rng.integers(34, 65, 1000),
    }[kind]
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    cuts, bins = solve(histogram, 64, 4)
    have, got = defaultdict(int, histogram), defaultdict(int)
    for (c, off), n in sorted(cuts.items(), reverse=True):
        assert off % 4 == 0 and 0 < off < c and have[c] >= n
        have[c] -= n
        have[off] += n
        have[c - off] += n
    for pattern, n in bins:
        assert n > 0 and sum(c * k for c, k in pattern.items()) <= 64
        for c, k in pattern.items():
            got[c] += n * k
    assert dict(got) == {c: n for c, n in have.items() if n}
    if len(lengths) > 100:
        assert sum(n for _, n in bins) <= 1.06 * lengths.sum() / 64 + 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=60).map(sorted))
def test_elias_fano(values):
    f = EliasFano(build(np.array(values, np.uint64)))
    assert len(f) == len(values) and f.all().tolist() == values and [f.select(i) for i in range(len(f))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20 * SAMPLE)).astype(np.uint64)
    data = build(values)
    assert 8 * len(data) / len(values) < 2.1 + np.log2(int(values[-1]) / len(values)) + 0.2
    f = EliasFano(data)
    for i in (0, 1, SAMPLE - 1, SAMPLE, len(values) - 1):
        assert f.select(i) == values[i]
    with pytest.raises(IndexError):
        f.select(len(values))
