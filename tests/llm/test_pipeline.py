"""The pipeline's stages, each against the operator that it calls, on the smallest documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from ctxweave.llm import bpe, jaccard_join, queries, secrets
from ctxweave.runtime import table


def test_stages_take_effect(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        out.append(docs := spark.read.parquet(str(tmp_path / name)))
    assert all(df.columns == columns for df in out[:-1])
    first, near, clean, masked, tokens = ({r["doc_id"]: r for r in df.collect()} for df in out)
    toxic = {r["doc_id"] for r in queries.QUERIES["op10_toxicity"](spark, data).where("toxic").collect()}
    every = {r["doc_id"] for r in table(spark, data, "documents").collect()}
    assert set(first) == every - toxic
    # one document of each group of near duplicates among those that are left, by plain union-find
    pairs = jaccard_join.jaccard_pairs(out[0]).collect()
    root = {k: k for k in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        a, b = find(p["doc_a"]), find(p["doc_b"])
        root[max(a, b)] = min(a, b)
    assert set(near) == {find(k) for k in first}
    items = [r["text"].lower() for r in table(spark, data, "benchmark").collect()]
    held = {k for k, r in near.items() if any(" ".join(i.split()) in " ".join(r["text"].lower().split()) for i in items)}
    assert not held & set(clean) and len(near) - len(clean) <= len(held) + 3
    assert set(masked) == set(clean) and all(r["text"] == secrets.redact(clean[k]["text"]) and r["n_chars"] in (clean[k]["n_chars"], len(r["text"])) for k, r in masked.items())
    enc = bpe.Encoder()
    assert all(enc.decode(F_(r["tokens"])) == masked[k]["text"] for k, r in tokens.items()) and set(tokens) == set(masked)
    assert {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, data).collect()} == {k: r["tokens"] for k, r in tokens.items()}


def test_stages_on_nulls_clashing_columns_and_nothing(spark, data):
    """Rows that a stage can't judge stay, columns stay as they are, and an empty table gives an empty one."""
    docs = table(spark, data, "documents")
    rows = [(None, "words of a text without an id", "en", "s", 1), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, " \n", "en", "s", 2), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema).union(docs.limit(40))
    for name, v in {"i": 1, "t": "x", "a": 2, "r": 3, "set": 4, "__gone": 5, "toxic": 1}.items():
        odd = odd.withColumn(name, F.lit(v))
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, data), stage(spark, odd.limit(0), data)
        assert none.count() == 0 and none.columns == got.columns
        if name == "bpe":
            assert got.count() == odd.count()
            continue
        assert got.columns == odd.columns and {r["doc_id"] for r in got.collect()} >= {None, -1, -2, -3}
        assert got.where("doc_id is null").count() == 2


def F_(ids):
    import numpy as np

    return np.array(ids, np.int64)


def test_toxic_documents_go(spark, data):
    words = "idiot|moron|clown|worthless|pathetic|disgusting|stupid|trash|scum|loser"
    docs = table(spark, data, "documents")
    kept = corpus_pipeline.toxicity_filter(spark, docs, data)
    bad = docs.where(F.size(F.expr(f"regexp_extract_all(lower(text), '({words})', 1)")) >= 3)
    assert kept.join(bad, "doc_id", "left_semi").count() <= 0.1 * bad.count()
