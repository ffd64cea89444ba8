"""Every operator and stage on empty tables and on awkward rows."""

import pytest

import corpus_pipeline
from facetwise.llm import bpe, exact_dedup, fingerprints, langid, lm, packing, pii, registry, simhash, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp string, key int, mask string, score string, at int, n int, word string, class string, recipe int, chunk int"
LONG = "word " * 30_000 + "x" * 40_000 + " end"
ROWS = [
    (1, "A plain text of a few words that stands here, twice.", "en", "s"), (2, "A plain text of a few words that stands here, twice.", "en", "s"), (2, "A plain text of a few words that stands here, twice.", "en", "s"),
    (3, None, None, None), (4, "", "en", None), (5, "   \n\t ", "de", "s"), (6, LONG, "en", "s"), (None, "no id here at all, not any", "en", "s"), (None, None, None, None),
    (8, "été über señor \U0001f600 日本語 \x00 \x1c\x85 á", "fr", "s"), (9, "Mr. John Smith, bob@example.com 4111111111111111", "en", "s"), (-5, "ein", "de", "s"), (10, "7", None, "s"), (2**62, "ein zwei drei vier", "de", "s"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, None, 1, "x", 2, "m", None, 3, 4, "w", "c", 5, 6) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, None, None), (1, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda d, x: packing.pack(d),
    "bpe": lambda d, x: bpe.round_trip(d, leaf=1000),
    "pii": lambda d, x: pii.report(d),
    "toxicity": lambda d, x: toxicity.score(d, x),
    "lm": lambda d, x: lm.score(d),
    "langid": lambda d, x: langid.identify(d),
    "exact": lambda d, x: exact_dedup.exact_dedup(d),
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "fingerprints": lambda d, x: fingerprints.edited_likeness(d),
    "sketches": lambda d, x: fingerprints.fingerprints(d),
    "token_files": lambda d, x: token_files.write_and_read(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_rows(awkward, labels, name):
    rows = OPERATORS[name](awkward, labels).collect()
    if name == "packing":
        assert sum(r["start"] == 0 for r in rows) == len(ROWS) and all(r["length"] >= 1 for r in rows)
    else:
        key = lambda i: (i is None, i or 0)
        assert sorted((r["doc_id"] for r in rows), key=key) == sorted((r[0] for r in ROWS), key=key)
    for r in rows:
        assert all(r[c] is not None for c in r.asDict() if c not in ("doc_id", "keep_id", "component_id", "text", "fingerprint"))


def test_defined_results(awkward, labels):
    by = lambda df, c: {(r["doc_id"]): r[c] for r in df.collect()}
    assert by(langid.identify(awkward), "lang_pred")[10] == "und" and by(langid.identify(awkward), "lang_pred")[3] == "und"
    n = by(lm.score(awkward), "n_tokens")
    assert n[3] == n[4] == n[5] == 1 and n[6] == 30_003
    f = by(simhash.near_duplicates(awkward), "fingerprint")
    assert f[3] == f[4] == f[5] == "0" * 16
    kept = [r for r in exact_dedup.exact_dedup(awkward).collect() if r["doc_id"] in (1, 2)]
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in sorted(kept, key=lambda r: r["doc_id"])] == [(2, 3, False), (2, 3, True), (2, 3, True)]
    text = by(pii.report(awkward), "text")
    assert text[3] is None and text[4] == "" and "Smith" not in text[9] and "bob@" not in text[9]


@pytest.mark.parametrize("which", ["empty", "awkward"])
def test_stages_keep_columns(request, spark, labels, tmp_path, which):
    docs = request.getfixturevalue(which)
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema
            out = spark.createDataFrame(out.collect(), docs.schema)
        docs = out
    assert docs.columns[:3] == ["doc_id", "start", "length"]


def test_every_query_is_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11))
