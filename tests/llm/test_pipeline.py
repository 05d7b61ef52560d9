import re

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from placeloom.llm import secret_scan
from tests.llm.test_structure_ops import brute_containment, brute_similar


def test_stages_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").orderBy("item_id").collect()]
    ids = {}
    now, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_small)
        if name != "bpe":
            assert out.columns == docs.columns
        frames[name] = (now.collect(), out.collect())
        now = out
    before, after = frames["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")}
    before, after = frames["near_dedup"]
    groups = brute_similar({r.doc_id: r.text for r in before})
    kept = {r.doc_id for r in after}
    assert len(after) == len(kept) and all(len(kept & set(g)) >= 1 for g in groups)
    assert sum(len(kept & set(g)) - 1 for g in groups) <= 0.1 * (len(before) - len(groups)) and len(groups) < len(before) - 5
    before, after = frames["decontamination"]
    hit = {i for i, _ in brute_containment([r.text for r in before], items)}
    assert [r.doc_id for r in before if r.doc_id not in {before[i].doc_id for i in hit}] == [r.doc_id for r in after]
    before, after = frames["secret_scan"]
    assert [r.doc_id for r in before] == [r.doc_id for r in after]
    for a, b in zip(before, after, strict=True):
        assert (a.text == b.text) == (not secret_scan.base_spans(a.text) and "<secret>" not in b.text)
        assert b.n_chars == (a.n_chars if a.text == b.text else len(b.text)) and not secret_scan.base_spans(b.text)
    before, after = frames["bpe"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(r.exact for r in after)
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in after} == {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids for r in before}


def test_run_and_edge_rows(spark, sf_small, tmp_path):
    assert corpus_pipeline.run(spark, sf_small).count() > 50
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the and of in a is to", "en", "s", 3), (1, "", "en", "s", 0), (1, "the and of in a is to", None, "s", 3)], docs.schema)
    odd = odd.withColumn("score", odd.n_chars).withColumn("rejected", odd.lang)
    now = odd
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_small)
    assert now.count() == 1
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_small)
    assert empty.count() == 0
