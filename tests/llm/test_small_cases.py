"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from ctxweave.llm import bpe, chat, decontaminate, jaccard_join, quality, secrets, sharding, substring_dedup, telephony, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns named as operators name theirs within
CLASH = {"i": 1, "t": "x", "a": 2, "b": 3, "m": 4, "r": 5, "kind": 6, "set": 7, "k": "8", "x": 9, "w": 1.5, "h": "y", "tokens": "z", "shard": 3, "score": 0.5, "keep": True, "id": 11, "component": 12, "__gone": 1, "start": 1, "end": 2}
LONG = " ".join(f"wörd{k % 977}x{k}" for k in range(60_000))


def documents(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "s", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "s", 10),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "s", 10),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, "   \n\t ", "en", "s", 6),
        (6, LONG, "en", "s", len(LONG)),
        (7, "x" * 200_000, "en", "s", 200_000),
        (None, "no id but a text of some words here", "en", "s", 1),
        (None, None, None, None, None),
        (8, "one", "en", "s", 3),
        (9, "日本語 テキスト \U0001f642 é", "ja", "s", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, v in CLASH.items():
        df = df.withColumn(name, F.lit(v))
    return df


def empty(spark):
    return documents(spark).limit(0)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1), (4, None, None), (3, 0, 1)], LABELS).withColumn("text", F.lit("clash"))


def pcm(df):
    return telephony.to_pcm(df, "doc_id", F.encode("text", "UTF-8"), F.when(F.col("doc_id") == 1, "alaw").when(F.col("doc_id") == 8, "nonsense").when(F.col("doc_id") == 6, "ima_adpcm").otherwise("mulaw"))


ROWWISE = {
    "telephony": lambda s, d: pcm(d),
    "bpe": lambda s, d: bpe.encode(d),
    "quality": lambda s, d: quality.score(d, quality.train(d, labels(s))),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "sharding": lambda s, d: sharding.shard(d, ["source"], target=100_000, spread=["doc_id"]),
}
FOUND = {
    "jaccard": lambda s, d: jaccard_join.jaccard_pairs(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "repeats": lambda s, d: substring_dedup.repeats(d, least_words=5),
    "contaminated": lambda s, d: decontaminate.contaminated(d, s.createDataFrame([(1, None), (None, "a b c d"), (2, ""), (3, "one"), (3, "one"), (4, "epsilon zeta eta theta iota")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_rowwise(spark, name):
    got = ROWWISE[name](spark, documents(spark))
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, -1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert ROWWISE[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_found(spark, name):
    got = FOUND[name](spark, documents(spark)).collect()
    want = {"jaccard": [(1, 2, 1.0)], "secrets": [], "repeats": [(2, 1)], "contaminated": [(1, 4), (2, 4), (2, 4), (8, 3)]}[name]
    key = {"jaccard": lambda r: tuple(r), "secrets": tuple, "repeats": lambda r: (r["doc_id"], r["keep_doc_id"]), "contaminated": lambda r: (r["doc_id"], r["item_id"])}[name]
    assert sorted(map(key, got)) == want
    assert FOUND[name](spark, empty(spark)).count() == 0


def test_values(spark):
    by = lambda df: {r["doc_id"]: r for r in df.where("doc_id is not null").collect()}
    d = documents(spark)
    t = by(bpe.encode(d))
    assert t[3]["tokens"] is None and t[4]["tokens"] == [] and all(r["round_trip"] for k, r in t.items() if k != 3)
    a = by(pcm(d))
    assert a[3]["pcm"] is None and a[8]["pcm"] is None and a[4]["pcm"] == b"" and len(a[5]["pcm"]) == 6 * 4
    x = by(toxicity.score(d, toxicity.train(d, labels(spark))))
    assert x[3]["toxicity"] is None and not x[3]["toxic"] and x[4]["toxicity"] == 0.0
    q = by(quality.score(d, quality.train(d, labels(spark))))
    assert q[3]["quality"] is None and not q[3]["keep"]
    s = sharding.shard(d, ["source"], target=100_000, spread=["doc_id"])
    assert s.columns[-1] == "shard_1" and s.select("doc_id", "shard_1").where("doc_id = 2").distinct().count() == 1


def test_filters_keep_rows_and_columns(spark):
    d = documents(spark)
    kept = jaccard_join.drop_duplicates(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9]
    few = jaccard_join.drop_duplicates(d, most=0)
    assert few.count() == kept.count()
    bench = spark.createDataFrame([(3, "one")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(d, bench)
    assert clean.columns == d.columns and clean.count() == d.count() - 1
    masked = secrets.redact_documents(d)
    assert masked.columns == d.columns and masked.count() == d.count()
    harmless = toxicity.drop_toxic(d, toxicity.train(d, labels(spark)))
    assert harmless.columns == d.columns and 3 in [r["doc_id"] for r in harmless.collect()]


def test_labels_of_both_kinds_and_ties(spark):
    """A document labelled both ways teaches nothing, a repeated label counts once, and a score at the threshold is in."""
    d = spark.createDataFrame([(k, f"you {'idiot scum' if k % 2 else 'kind friend'} number {k}") for k in range(40)], "doc_id long, text string")
    once = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(40)], LABELS)
    both = once.union(once).union(spark.createDataFrame([(50, 1, 1), (50, 0, 0)], LABELS))
    more = d.union(spark.createDataFrame([(50, "kind scum friend idiot")], d.schema))
    a, b = toxicity.train(d, once), toxicity.train(more, both)
    assert a.bias == b.bias and (a.weights == b.weights).all()
    x, y = quality.train(d, once), quality.train(more, both)
    assert (x.good, x.bad, x.slope, x.bias) == (y.good, y.bad, y.slope, y.bias)
    s = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d, a).collect()}
    assert min(s[k] for k in range(1, 40, 2)) > max(s[k] for k in range(0, 40, 2))
    assert {r["doc_id"] for r in toxicity.score(d, a, s[7]).where("toxic").collect()} == {k for k in s if s[k] >= s[7]}
    same = d.union(d)
    assert toxicity.score(same, a).groupBy("doc_id").count().where("count <> 2").count() == 0
    assert toxicity.drop_toxic(d.limit(0), a).count() == 0


def test_decode_keeps_rows(spark):
    t = spark.createDataFrame([(1, [0, 1]), (1, [0, 1]), (None, []), (2, None)], "doc_id long, tokens array<int>").withColumn("text", F.lit(7))
    got = bpe.decode(t).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got if r["text"] is not None) == [(0, ""), (1, got[0]["text"]), (1, got[0]["text"])] and len(got) == 4
    assert bpe.decode(t.limit(0)).count() == 0


def test_no_labels(spark):
    d = documents(spark)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(d, toxicity.train(d, none)).where("toxic").count() == 0
    assert quality.score(d, quality.train(d, none)).count() == d.count()


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 2, "assistant", None), (2, 0, "user", "hi"), (2, 1, None, "x"), (None, 0, "user", "a"), (3, None, "user", "b"), (4, 0, "user", "hi")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name, v in {"h": "1", "n": 2, "node": "3", "path": 4, "depth": 5, "tokens": 6, "conv": 7}.items():
        c = c.withColumn(name, F.lit(v))
    got = chat.prefix_trees(c).orderBy("tree_id", "seq").collect()
    assert [(r["tree_id"], r["seq"], r["depth"], r["conv_ids"]) for r in got] == [(1, 0, 0, [4]), (1, 1, 1, [1]), (1, 2, 1, [2])]
    assert got[2]["position_ids"][0] == len(got[0]["tokens"]) and [tuple(x) for x in got[2]["attention"]] == [(0, len(got[0]["tokens"]))]
    assert chat.prefix_trees(c.limit(0)).count() == 0


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        jaccard_join.jaccard_pairs(documents(spark), threshold=0)
    with pytest.raises(ValueError):
        substring_dedup.tune_bands(1.5, 0.9)
    with pytest.raises(ValueError):
        telephony.resample(telephony.MULAW, 0, 1)
