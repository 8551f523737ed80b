"""Each operator on odd rows: nulls in any column, empty and very long texts, ties, repeated rows, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

from geoloom.llm import bpe_codec, jaccard_join, line_frequency, media_sniff, mixture_packing, pii_weak, recompression, secret_scan, toxicity_knn, warc_derivatives

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, node string, block string, score string, host string, features string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def _row(doc_id, text, source="s"):
    return (doc_id, text, None, source, len(text or ""), "x", "y", "z", "w", "v", "u")


ROWS = [_row(1, None), _row(2, ""), _row(3, "  \n\t "), _row(4, LONG), _row(5, "a b c"), _row(5, "a b c"), _row(None, "a b c d e f", None), _row(6, LONG, None), _row(7, "ünï 😀 \x00 <b>&amp;</b>"), _row(8, "one two three")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None, 1 if i % 2 else 0) for i in range(9)] + [(None, 1, 1), (3, 1, None), (4, 0, 5)], "doc_id bigint, quality int, toxic int")


def _operators(labels):
    return {
        "store": media_sniff.store,
        "identify": lambda d: media_sniff.identify(media_sniff.store(d)),
        "carve": lambda d: media_sniff.carve(media_sniff.store(d)),
        "pack": mixture_packing.pack,
        "digests": bpe_codec.digests,
        "decode": lambda d: bpe_codec.decode(bpe_codec.encode(d)),
        "secrets": secret_scan.find,
        "redact": secret_scan.redact,
        "pii": pii_weak.find,
        "rules": line_frequency.rules,
        "repeats": recompression.remove_repeats,
        "without": recompression.without_repeats,
        "toxicity": lambda d: toxicity_knn.score(d, labels),
        "reject": lambda d: toxicity_knn.reject(d, labels),
        "join": jaccard_join.join,
        "one": jaccard_join.one_of_each,
        "warc": lambda d: warc_derivatives.derivatives(warc_derivatives.responses(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "node"))),
    }


NAMES = list(_operators(None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, labels, name):
    rows = _operators(labels)[name](odd).collect()
    per_row = {"pack": None, "warc": 2 * len(ROWS), "carve": len(ROWS), "without": None, "reject": None, "one": None}
    if (n := per_row.get(name, len(ROWS))) is not None:
        assert len(rows) == n
    if name == "pack":
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(none, labels, name):
    assert _operators(labels)[name](none).collect() == []


def test_no_labels(odd, labels):
    assert {r.score for r in toxicity_knn.score(odd, labels.limit(0)).collect()} == {0.0}


def test_repeats_of_odd_rows(odd):
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_text) for r in recompression.remove_repeats(odd).collect()}
    assert got[(4, 60_000)] == (60_000, "") and got[(5, 3)] == (0, "a b c") and got[(1, 0)] == (0, "")


def test_links_of_odd_rows(odd):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(odd).collect()}
    assert {(4, 4, 1), (6, 4, 1), (5, 5, 1), (1, 1, 0), (2, 2, 0)} <= got


def test_one_of_each(odd):
    kept = [r.doc_id for r in jaccard_join.one_of_each(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 5, 7, 8] and kept.count(None) == 1


def test_redact_keeps_rows_and_columns(odd):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
