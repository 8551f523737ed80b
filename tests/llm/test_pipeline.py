"""The stages, each against what it should do to its own input."""

import re
import zlib

import corpus_pipeline
import numpy as np

from geoloom.llm import common, jaccard_join, mixture_packing, recompression, secret_scan, toxicity_knn


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = common.materialise(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "packing":
            assert out.columns == columns
        ids = sorted(before)
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity_knn.score(docs, common.table(spark, sf_dir, "labels")).collect()}
            assert set(after) == {i for i in ids if not scores[i]} and all(after[i] == before[i] for i in after)
        elif name == "jaccard_join":
            forest = jaccard_join.Forest(len(ids))
            for i, j in jaccard_join.brute_force([before[i].text for i in ids]):
                forest.join(i, j)
            assert set(after) == {ids[i] for i in range(len(ids)) if forest.find(i) == i}
        elif name == "substring_dedup":
            for i, (n, gone, kept) in zip(ids, recompression.brute_force([before[i].text for i in ids]), strict=True):
                assert (i in after) == (not n or gone < n)
                if i in after:
                    assert after[i].text == (kept if gone else before[i].text) and after[i].n_chars == len(after[i].text)
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i in ids:
                assert after[i].text == secret_scan.masked(before[i].text, secret_scan.spans(before[i].text))
                assert not re.search("[0-9a-f]{32}", after[i].text)
        else:
            assert set(after) == set(before)
        docs = out


def _by_hand(spark, docs, labels):
    """What the first four stages leave, by plain code but for the scores."""
    scores = {(r.doc_id, r.score) for r in toxicity_knn.score(docs, labels).collect()}
    toxic = {i for i, s in scores if s >= toxicity_knn.THRESHOLD}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic)
    forest = jaccard_join.Forest(len(rows))
    for i, j in jaccard_join.brute_force([t for _, t in rows]):
        forest.join(i, j)
    rows = [r for i, r in enumerate(rows) if forest.find(i) == i]
    out = {}
    for (i, t), (n, gone, kept) in zip(rows, recompression.brute_force([t for _, t in rows]), strict=True):
        if not n or gone < n:
            text = kept if gone else t or ""
            out[i] = secret_scan.masked(text, secret_scan.spans(text))
    return out


def test_run(spark, sf_dir):
    """The whole against brute force: which documents are packed, and each id of each once."""
    from tokenizers import Tokenizer

    docs, before = common.table(spark, sf_dir, "documents"), common.written()
    want = _by_hand(spark, docs, common.table(spark, sf_dir, "labels"))
    common.clean(spark, before)
    tokenizer = Tokenizer.from_file(mixture_packing.default_vocabulary())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in want.items()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(ids)
    at, end = dict.fromkeys(ids, 0), 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == end
        end += r.length
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    assert common.written() - before <= 4  # the last stage's input, and its own tables


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (2, "", "", "", 0), (None, "a b c d e f", "en", "s", 11), (3, "a b c d e f", None, "t", 11), (3, "long " * 4000, None, None, 5), (4, "token=abcdefghijklmnop x", "en", "s", 9)]
    labels = [(1, None, 1), (None, 1, 0), (3, 0, 0), (4, 0, 0), (2, 0, 0)]
    for name, rows, own in (("odd", odd, labels), ("empty", [], []), ("unlabelled", odd, [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(own, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert (not out) == (not rows)
        assert not rows or {2, 4} <= {r.doc_id for r in out}
