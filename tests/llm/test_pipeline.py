"""The pipeline: each stage against a plain version of its decision, and all of them in a row."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import DOCS, edge_rows
from trimlake.llm import bpe, mixing, near_dups, pii


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(edge_rows(), DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    return own.unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10_000)).cache()


def test_stages(spark, docs, tmp_path):
    table = docs
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(path := str(tmp_path / str(k)))
        before, table = table, spark.read.parquet(path)
        rows, old = table.collect(), before.collect()
        seen.append(len(rows))
        if name == "language ID":
            assert {r["doc_id"] for r in old if r["lang"] and r["doc_id"] is not None and r["doc_id"] < 10_000} <= {r["doc_id"] for r in rows}
            assert all(any(c.isalpha() for c in r["text"]) for r in rows)
        elif name == "MinHash near-dedup":
            assert len(rows) == near_dups.classes(before).select("class_node").distinct().count()
            assert max(Counter(r["text"] for r in rows).values()) == 1
        elif name == "PII":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, pii.redact(r["text"])) for r in old)
            assert not any(pii.base_spans(r["text"]) for r in rows)
        elif name == "mixing":
            want = Counter()
            for r in mixing.mix(before).collect():
                want[r["doc_id"]] += r["copies"]
            assert Counter(r["doc_id"] for r in rows) == +want
        else:
            lib = Tokenizer.from_file(public(bpe.MODEL))
            ids = {r["doc_id"]: lib.encode(r["text"], add_special_tokens=False).ids for r in old}
            assert len(rows) == len(old) and all(r["ids"] == ids[r["doc_id"]] for r in rows)
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[4] == seen[5]


def public(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "ids", "decoded"] and got.count() > 100
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
