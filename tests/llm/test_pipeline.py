"""The pipeline against a brute-force version of it."""

import itertools
import os
import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline  # noqa: E402
from facetwise.llm import near_dedup, packing, pii, toxicity  # noqa: E402
from facetwise.llm.common import forget, lookup, settle, shared_dir, table  # noqa: E402
from test_tokens import check_packed  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, path = random.Random(11), tmp_path_factory.mktemp("sf")
    say = lambda n: [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(90)}x" for _ in range(n)]
    rows, labels = [], []
    for i in range(260):
        words, bad = say(rng.choice([3, 40, 200, 900])), i % 4 == 0
        for _ in range(6 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotter"]))
        if i % 10 == 1:
            words[1:1] = ["ask", f"me{i}@mail.example.org", "or", f"+1 (503) 555-{i:04d}"]
        rows.append(" ".join(words))
        labels.append(int(bad))
        if i % 5 == 0:
            rows.append(rows[-1])
            labels.append(int(bad))
        if i % 7 == 0 and len(words) > 150:
            copy = list(words)
            copy[rng.randrange(len(copy))] = "other"
            rows.append(" ".join(copy))
            labels.append(int(bad))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_near_groups(texts):
    """The least id of what near pairs connect, by all pairs."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(texts), 2):
        if alike(texts[i], texts[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in texts}


def edited(rng, words, n):
    words = list(words)
    for p in rng.sample(range(len(words)), n):
        words[p] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def say(rng, n):
    return [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.randrange(500)}" for _ in range(n)]


def roots(spark, docs, **how):
    got = {r["doc_id"]: r["root"] for r in near_dedup.groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), **how).collect()}
    return {i: got.get(i, i) for i in docs}


@pytest.fixture(scope="module")
def copies():
    """Two texts with many edited copies, a few with one or two, and texts with none."""
    rng, out = random.Random(6), []
    for many in (70, 40, 2, 1, 1, 0, 0, 0):
        words = say(rng, rng.choice([220, 400]))
        out += [" ".join(words)] + [edited(rng, words, rng.choice([1, 2, 3, 6])) for _ in range(many)]
    return dict(enumerate(out))


@pytest.mark.parametrize("members", [8, near_dedup.MEMBERS])
def test_groups_of_every_size(spark, copies, members):
    """Also where a group's buckets are dealt to several blocks."""
    assert roots(spark, copies, members=members) == brute_near_groups(copies)


def test_blocks_added_and_removed_are_found(spark):
    """Texts with blocks appended, put first or cut off on either side, up to and over the limit, and a passage that all have."""
    rng, out = random.Random(8), []
    shared = say(rng, 12)
    for _ in range(40):
        words = shared + say(rng, rng.choice([90, 260]))
        n = len(words)
        out.append(words)
        for share in (0.12, 0.17, 0.22, 0.26):
            k = int(n * share)
            out.append(rng.choice([words + say(rng, k), say(rng, k) + words, words[: n - k], words[k:]]))
    out += [[], [" "], ["one"], ["one"], shared, shared[1:]]
    docs = dict(enumerate(" ".join(x) for x in out))
    want = brute_near_groups(docs)
    assert sum(i != r for i, r in want.items()) > 80
    assert roots(spark, docs) == want


def test_texts_of_shared_passages(spark):
    """Texts put together from the same few passages: every shingle is common, few pairs are near."""
    rng = random.Random(10)
    passages = [say(rng, 30) for _ in range(12)]
    docs = {i: " ".join(w for p in rng.sample(passages, rng.choice([1, 4, 6])) for w in p) for i in range(150)}
    docs |= {1000 + i: docs[i] + " " + " ".join(say(rng, 20)) for i in range(0, 150, 5)}
    want = brute_near_groups(docs)
    assert 10 < sum(i != r for i, r in want.items()) < 150
    assert roots(spark, docs, members=16) == want


def test_short_texts_and_hot_shingles(spark, monkeypatch):
    """Few words each, most with the same beginning; keys that are common are dealt to several tasks."""
    monkeypatch.setattr(near_dedup, "HOT_LEAST", 20)
    rng = random.Random(12)
    docs = {i: " ".join(["a", "b", "c", "d", "e", *(rng.choice("xyz") for _ in range(rng.randrange(0, 9)))]) for i in range(300)}
    assert roots(spark, docs) == brute_near_groups(docs)


def test_a_chain_is_one_group_at_every_size(spark):
    """Revisions that are near the next ones only: one stays, also where the groups are larger than a block."""
    rng = random.Random(9)
    words, chain = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for _ in range(60):
        chain.append(" ".join(words))
        words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        words[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
    docs = dict(zip(rng.sample(range(1000), 60), chain))
    assert alike(chain[0], chain[-1]) < 0.1 and set(brute_near_groups(docs).values()) == {min(docs)}
    for members in (8, near_dedup.MEMBERS):
        assert roots(spark, docs, members=members) == dict.fromkeys(docs, min(docs))


def test_rows_without_or_with_repeated_ids(spark):
    """A doc_id with two texts is two documents; rows without doc_id go where another is near."""
    rng = random.Random(13)
    one, two, three = (say(rng, 120) for _ in range(3))
    j = " ".join
    rows = [(1, j(one), "a"), (1, j(two), "b"), (2, edited(rng, one, 1), "c"), (None, edited(rng, one, 1), "d"), (None, j(three), "e"), (None, edited(rng, three, 1), "f"), (0, edited(rng, two, 1), "g"), (5, None, "h"), (4, " ", "i"), (1, j(one), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    stay = sorted(r["h"] for r in near_dedup.survivors(docs).collect())
    assert len([x for x in stay if x in "ef"]) == 1 and [x for x in stay if x not in "ef"] == ["a", "g", "i", "k"]


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, table(spark, sf_dir, "labels")).collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if not scores[r["doc_id"]]}
    assert 0.6 < len(left) / len(scores) < 0.85
    last = {}
    for i in sorted(left):
        last[left[i]] = i
    left = {i: t for t, i in last.items()}
    stays, before = brute_near_groups(left), len(left)
    left = {i: t for i, t in left.items() if stays[i] == i}
    assert len(left) < before
    want = [(i, pii.replaced(t, pii.key_of(spark))[0]) for i, t in left.items()]
    assert any(t != left[i] for i, t in want)

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = settle(f(spark, stage, sf_dir), name)
        assert stage.schema == docs.schema
    assert sorted((r["doc_id"], r["text"]) for r in stage.collect()) == sorted(want)
    assert {tuple(r)[2:] for r in stage.collect()} <= {tuple(r)[2:] for r in docs.collect()}
    assert check_packed(corpus_pipeline.run(spark, sf_dir).collect(), want) < 0.05


def test_lookup_finds_hot_and_cold(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 50).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = {(r["id"], r["k"], r["least"]) for r in lookup(rows, groups, ["k"], "n", 9000).collect()}
    least = {}
    for i in range(9000):
        least.setdefault(0 if i < 4000 else i % 50, i)
    assert got == {(i, k, least[k]) for i in range(9000) for k in [0 if i < 4000 else i % 50]}


def test_forget(spark):
    settle(spark.range(3), "some").count()
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    assert os.path.isdir(path)
    forget(spark)
    assert not os.path.exists(path)


def test_texts_go_to_workers_a_few_at_a_time(spark, monkeypatch):
    from facetwise.llm import common

    def spy(df, name):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return common.settle(df, name)

    seen, before = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for module in (near_dedup, packing, pii):
        monkeypatch.setattr(module, "settle", spy)
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight {i % 3} by a@b{i}.org") for i in range(12)], "doc_id long, text string")
    near_dedup.survivors(docs)
    packing.pack(docs)
    pii.surrogates(docs)
    assert all(seen[n] <= common.TEXTS for n in ("heads", "sets", "entities", "surrogates", "tokenized")), seen
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_text_by_text(n):
    from facetwise.llm.common import text_by_text

    texts = [None if i % 7 == 0 else "é" * (i % 5) for i in range(n)]
    got = text_by_text(lambda t: None if t is None else t + "!", pa.array(texts, pa.string()), pa.string())
    assert got.type == pa.string() and got.to_pylist() == [None if t is None else t + "!" for t in texts]
