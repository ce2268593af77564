"""The pipeline on the smallest tables: order, columns, and what each stage may drop."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from wayfold.llm import mixing, quality
from wayfold.llm.common import materialize

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], D), f"test-{name}"))
    for before, after in zip(seen[:-2], seen[1:-1]):
        assert after.columns == docs.columns
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
    judged = quality.judged(docs, quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet")))
    assert seen[1].count() == judged.where("predicted = 1").count()
    assert seen[4].count() == mixing.mix(seen[3]).agg({"copies": "sum"}).first()[0]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].limit(20).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, D).select("doc_id").collect()) == sorted(r.doc_id for r in seen[5].collect())


CLASHES = ["_id", "_th", "_sha", "_t", "_source", "_whole", "_bound", "_copy", "__ID", "__source", "row", "u", "th", "key", "n", "size", "copies", "score", "fp", "norm"]


def test_clashing_names_and_empty_tables(spark):
    """Every name that a stage uses inside, as an extra column; rows that repeat; nulls; a table without rows."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "none none none none none"), (None, None), (7001, ""), (7002, None), (7003, "a b"), (7003, "a  b"), (7003, "c d"), (7004, "c d")], "doc_id long, text string")
    base = base.unionByName(odd, allowMissingColumns=True).unionByName(base.limit(3))
    for docs in (base, base.where("false")):
        plain, wide = docs, docs.withColumns({c: F.lit(c) for c in CLASHES})
        for name, stage in corpus_pipeline.STAGES:
            plain, wide = (materialize(stage(spark, x, D), f"clash-{name}") for x in (plain, wide))
            if name != "encode":
                assert wide.columns == [*docs.columns, *CLASHES]
            # where two rows of one class are alike but for the text's spacing either may stay
            assert sorted(map(str, (r.doc_id for r in plain.collect()))) == sorted(map(str, (r.doc_id for r in wide.collect()))), name
            assert all(r[c] == c for r in wide.limit(5).collect() for c in CLASHES if c in wide.columns)


def test_sql_equivalents(spark):
    from compare import main as compare

    from wayfold.llm.queries import ORACLES

    assert compare("sf0.001", sorted(ORACLES)) == 0


def test_kept_rows_equal_plain_python(spark):
    import collections
    import re

    import numpy as np
    from test_corpus import plain_components

    seen = [spark.read.parquet(f"{D}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen.append(materialize(stage(spark, seen[-1], D), f"plain-{name}"))
    rows = [sorted((r.doc_id, r.text or "") for r in s.collect()) for s in seen]
    odds, bias = quality.fit(seen[0], spark.read.parquet(f"{D}/labels.parquet"))
    of = quality.Features()
    scores = []
    for _, t in rows[0]:
        ids, part = of(t)
        scores.append(1 / (1 + np.exp(-(float(part @ odds[ids]) + bias))))
    near = {r[0] for r, s in zip(rows[0], scores) if abs(s - quality.THRESHOLD) < 1e-4}
    assert [r for r in rows[1] if r[0] not in near] == [r for r, s in zip(rows[0], scores) if s >= quality.THRESHOLD and r[0] not in near]
    first = {}
    for i, t in rows[1]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    assert rows[2] == sorted(first.values())
    assert rows[3] == [rows[2][i] for i, _, c in plain_components([t for _, t in rows[2]]) if i == c]
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert collections.Counter(rows[4]) == collections.Counter({r: copies[r[0]] for r in rows[3] if copies[r[0]]})
