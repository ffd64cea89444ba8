"""Exact dedup, SimHash and fingerprints against brute force."""

import hashlib
import itertools
import os
import random
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
from facetwise.llm import exact_dedup, fingerprints, simhash  # noqa: E402
from facetwise.llm.components import components  # noqa: E402

WORDS = [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [text(rng, rng.choice([0, 1, 3, 4, 5, 40, 300, 900])) for _ in range(60)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = t.split(" ")
            if len(words) > 20 and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, corpus, bits):
    """With 3 bits nearly all chunks share their hash, so the verification has all the work."""
    groups = {}
    for i, t in corpus:
        groups.setdefault(t, []).append(i)
    want = {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in corpus}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, bits).collect()}
    assert got == want


def test_survivors_are_rows(spark):
    """A doc_id with two texts is judged for each; rows without doc_id stay only where no other has their text."""
    rows = [(2, "A", 1), (5, "A", 2), (2, "B", 3), (None, "A", 4), (None, "C", 5), (None, None, 6), (1, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    assert sorted(r["kept"] for r in exact_dedup.survivors(docs).collect()) == [2, 3, 5, 7]


def test_chunks_join_to_the_text(docs, corpus):
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    assert {r["doc_id"]: "".join(r["c"]) for r in rows} == dict(corpus)
    assert max(len(c) for r in rows for c in r["c"]) <= exact_dedup.MAX_CHARS


def test_native_plans(docs):
    for df in (exact_dedup.exact_dedup(docs), fingerprints.edited_likeness(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_masks_cover_every_pair():
    for radius in (1, 2, 4):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        pairs = itertools.combinations(range(64), radius) if radius < 4 else (rng.sample(range(64), 4) for _ in range(20_000))
        for places in pairs:
            diff = sum(1 << p for p in places)
            assert any(not diff & m for m in masks)


def test_blocks_cover_what_is_left():
    for m in simhash.masks():
        blocks = simhash.block_masks(m, 4)
        for places in (random.Random(i).sample(range(64), 4) for i in range(300)):
            diff = sum(1 << p for p in places)
            assert diff & m or any(not diff & b for b in blocks)


def brute_fingerprint(t, width, seed=42):
    words = t.lower().split() if t.isascii() else [w.decode() for w in t.encode().lower().split()]
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, radius):
    ids = sorted(keys)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if any((x ^ y).bit_count() <= radius for x, y in zip(keys[a], keys[b])):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("how", [{}, {"most": 16}, {"width": 1, "seed": 43}])
def test_simhash(docs, corpus, how):
    keys = {i: [brute_fingerprint(t, how.get("width", 4), how.get("seed", 42))] for i, t in corpus}
    want = brute_components(keys, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, **how).collect()}
    assert got == {i: (f"{keys[i][0]:016x}", want[i]) for i in keys}


def test_large_buckets_lose_nothing(spark):
    """Fingerprints in a few dense balls, far more than a bucket may hold."""
    rng = random.Random(1)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            x = centre
            for p in rng.sample(range(64), rng.randrange(1, 9)):
                x ^= 1 << p
            fps.add(x)
    keys = {simhash.signed(x): [x] for x in fps}
    want = brute_components(keys, 4)
    links = simhash.near_links(spark.createDataFrame([(k,) for k in keys], "fp long"), most=16)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {k: got.get(k, k) for k in keys} == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(900, 900), (901, 902), (902, 901)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(101)} | {i: 500 for i in range(500, 700)} | {901: 901, 902: 901}
    assert got == want


def long_hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), h)
    return simhash.signed(h)


def brute_sketch(t, k=fingerprints.K):
    words = [w for w in t.encode().split()]
    hashes = [simhash.signed(xxhash.xxh64_intdigest(w, 42)) for w in words]
    shingles = {long_hash(hashes[i : i + 5]) for i in range(len(hashes) - 4)} if len(hashes) >= 5 else {long_hash(hashes)} if hashes else set()
    return sorted(shingles)[:k]


def test_fingerprints(spark, corpus):
    import base64

    rows = [(i * 7, t if i % 9 else t + " é日本") for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(df, parts=5).collect()}
    order = sorted(rows, reverse=True)
    alike = lambda a, b: 1.0 if not a and not b else len((u := set(sorted(set(a) | set(b))[: fingerprints.K])) & set(a) & set(b)) / len(u)
    code = lambda s: base64.b64encode(b"".join((x % 2**64).to_bytes(8, "big") for x in s)).decode()
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(nxt)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), code(a), code(b))
        assert abs(r["near_edited"] - alike(a, b)) < 1e-12 and abs(r["near_next"] - alike(a, c)) < 1e-12


def test_next_with_repeated_and_missing_ids(spark):
    """Descending doc_id, then hash of the text, rows without doc_id last; a doc_id of many rows is cut into several ranges."""
    rows = [(None, f"no id {i} " * 3) for i in range(60)] + [(5, f"text {i} and more") for i in range(80)] + [(i, f"own {i} here") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.edited_likeness(df, parts=6).collect()
    h = lambda t: simhash.signed(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], h(r[1])), reverse=True)
    want = []
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        want.append((str(i), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)
    places = fingerprints.with_next(df, parts=6).groupBy("at").count().collect()
    assert len(places) == 6 and max(r["count"] for r in places) < 60


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    a, b = [f"a{i}" for i in range(4000)], [f"a{i}" for i in range(2000, 6000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    s = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = s.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("n")).first()
    assert abs(r["j"] - 1996 / 5996) < 0.15 and abs(r["c"] - 0.5) < 0.2 and 0.75 < r["n"] / 5996 < 1.3
    halves = spark.createDataFrame([(" ".join(a[:2000]), " ".join(a[1996:]), " ".join(a))], "x string, y string, z string")
    both = halves.select(fingerprints.merge(fingerprints.sketch(F.col("x")), fingerprints.sketch(F.col("y"))).alias("m"), fingerprints.sketch(F.col("z")).alias("s")).first()
    assert both["m"] == both["s"]


def test_links_are_found_by_numpy_too():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 12, 200).astype(np.uint64))
    a, b = simhash.local_links(fps, 1)
    want = brute_components({int(x): [int(x)] for x in fps}, 1)
    got = dict(zip(a.tolist(), b.tolist()))
    assert {k: got.get(k, k) for k in want} == want
