"""The pipeline's stages, one after the other, against what each operator says of its own input."""

from __future__ import annotations

import hashlib

import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from sampleloom.llm import bpe, decontaminate, language_id, quality_rules, simhash_dedup
from sampleloom.llm.common import saved


def test_stages(spark, sf, small):
    docs, base = small, small.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, sf), name)
        assert out.columns == base
        ids, had = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            got = language_id.identify(docs, language_id.fit(docs.filter(~language_id.held_out())))
            want = {r.doc_id for r in got.collect() if r.lang_pred != "und" and r.certainty >= 0.3}
        elif name == "quality_rules":
            want = {r.doc_id for r in quality_rules.quality(docs).collect() if r.kept}
        elif name == "simhash_near_dedup":
            want = {r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
        else:
            want = had - {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        assert ids == want and out.count() == len(ids)
        docs = out
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert final.keys() == texts.keys()
    for d, t in texts.items():
        ids = lib.encode_ordinary(t)
        assert final[d].ids == ids and final[d].n_tokens == len(ids) and final[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_on_messy_and_empty(spark, sf, messy, empty):
    for docs in (messy, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "byte_bpe" or out.columns == docs.columns
            out.count()


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
