"""Fitted operators and the pipeline: held-out accuracy, brute force on small tables, odd inputs."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import classifier, language, quality
from tapeloom.llm.queries import ORACLES, QUERIES

LARGER = "/root/testdata/sf0.01"


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, folder, name):
    import glob
    import os

    from check_oracle import compare, rows_of

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    assert compare(rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of([d[0] for d in want.description], want.fetchall())) is None


def test_quality_classifier_on_held_out_rows(spark):
    got = QUERIES["op7_quality_classifier"](spark, LARGER).join(read(spark, LARGER, "labels"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n >= 0.95


def test_quality_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    for labels, low, high in ((none, 0.4, 0.6), (one, 0.9, 1.0)):
        model = classifier.fit(classifier.labelled_sample(docs, labels, "quality"))
        assert all(low <= r["score"] <= high for r in classifier.scored(docs, model).collect())


def test_language_on_held_out_rows(spark):
    got = QUERIES["op9_language_id"](spark, LARGER).join(read(spark, LARGER, "documents"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert n > 200 and right / n >= 0.97


def brute_kneser_ney(texts):
    """Probability of the last symbol of a gram, by the textbook formulas over dictionaries."""
    counts = Counter()
    for t in texts:
        found = [32] * 3 + language.symbols(t).tolist()
        counts.update(tuple(found[i - 3 : i + 1]) for i in range(3, len(found)))
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts = {}
    for n, level in levels.items():
        one, two = (sum(c == i for c in level.values()) for i in (1, 2))
        discounts[n] = min(0.9, max(0.1, one / (one + 2 * two))) if one + two else 0.5
    followers = {n: defaultdict(list) for n in levels}
    for n, level in levels.items():
        for g, c in level.items():
            followers[n][g[:-1]].append(c)

    def p(gram):
        n = len(gram)
        shorter = p(gram[1:]) if n > 1 else 1 / (len(levels[1]) + 1)
        seen = followers[n].get(gram[:-1])
        if not seen:
            return shorter
        d = discounts[n]
        return (max(0, levels[n].get(gram, 0) - d) * (gram in levels[n]) + sum(min(d, c) for c in seen) * shorter) / sum(seen)

    return p


def test_kneser_ney_against_dictionaries(spark):
    texts = {"aa": ["The cat sat on the mat.", "cat-cat CAT 12 tack", "é \U00010400x"], "bb": ["zuzu und zaza", "das zebra", None, ""]}
    docs = spark.createDataFrame([(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)] + [(9, "no language", None)], "doc_id long, text string, lang string")
    model = language.LanguageIdentifier.fit(docs).models
    assert model.languages == ["aa", "bb"]
    probes = ["the cat", "zebra cat", "qqq xyz", "é\U00010400"]
    got = model.cross_entropies(probes)
    for j, lang in enumerate(model.languages):
        p = brute_kneser_ney(texts[lang])
        for i, probe in enumerate(probes):
            found = [32] * 3 + language.symbols(probe).tolist()
            want = [math.log(p(tuple(found[k - 3 : k + 1]))) for k in range(3, len(found))]
            assert got[i, j] == pytest.approx(-sum(want) / len(want), rel=1e-3)


def test_language_slots_are_sparks(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 123456789]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select(language.slot(F.col("k")).alias("s")).collect()
    assert [r["s"] for r in rows] == language.slots_of(np.array(keys, dtype=np.int64)).tolist()


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "hello there friend", "en", "c"), (1, "hello there friend", "en", "c"), (2, "guten tag freund", "de", None), (3, None, "en", None), (4, "12 !!", None, None), (None, "the friend", None, None)],
        "doc_id long, text string, lang string, score string",
    )
    model = language.LanguageIdentifier.fit(docs)
    got = [(r["text"], r["lang_pred"]) for r in language.identify(docs, model).collect()]
    assert got == [("hello there friend", "en")] * 2 + [("guten tag freund", "de"), (None, "und"), ("12 !!", "und"), ("the friend", "en")]
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.LanguageIdentifier.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def jaccard(a, b):
    made = []
    for text in (a, b):
        found = (text or "").lower().split()
        made.append({tuple(found[i : i + 5]) for i in range(len(found) - 4)} or {tuple(found)})
    return len(made[0] & made[1]) / len(made[0] | made[1])


def test_pipeline_stages(spark):
    docs = read(spark, LARGER, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from tapeloom.session import pin

        out = pin(stage(spark, docs, LARGER))
        assert out.columns == columns and out.dtypes == docs.dtypes
        before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, out))
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "quality_classifier":
            labels = dict(read(spark, LARGER, "labels").select("doc_id", "quality").collect())
            assert sum(labels.get(i) == 1 for i in before if i not in after) <= 0.01 * len(before)
            assert sum(labels.get(i) == 0 for i in after) <= 2
        elif name == "quality_rules":
            judged = {r["doc"]["doc_id"]: r for r in quality.judge(docs).collect()}
            assert set(after) == {i for i, r in judged.items() if r["kept"]}
            assert all(after[i]["text"] == before[i]["text"] or judged[i]["removed"] for i in after)
        elif name == "simhash_near_dedup":
            texts = [r["text"] for r in after.values()]
            assert len(set(texts)) == len(texts)  # no exact copies
            kept = [r["text"] for r in after.values()]
            for i in set(before) - set(after):
                assert max(jaccard(before[i]["text"], t) for t in kept) >= 0.6
            close = sum(jaccard(a, b) >= 0.8 for n, a in enumerate(kept) for b in kept[n + 1 :] if abs(len(a) - len(b)) < 0.3 * len(a) + 9)
            assert close <= 1
        else:
            assert set(after) == set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER)
    assert packed.count() == docs.count() == packed.select("batch", "slot").distinct().count()


def test_stages_with_odd_rows(spark, folder):
    schema = "score double, doc_id long, text string, lang string, source string, n_chars long, _stats string, kept string"
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(0.5, 1, good, "en", "s", 1, "x", "y")] * 2 + [(None, None, None, None, None, None, None, None), (None, 2, "", None, None, 0, None, None), (None, None, good + " more", "en", None, 3, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, folder)
            assert out.count() <= given.count()
            assert out.columns == given.columns or "batch" in out.columns


def test_pipeline_runs_as_registered(spark, folder):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, folder).count() > 0


def test_language_limits_are_quantiles_over_all_texts(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} {chr(97 + i * 7 % 26)}ne more {i % 13 * 'x'}", "en") for i in range(9_000)], "doc_id long, text string, lang string").repartition(4)
    model = language.LanguageIdentifier.fit(docs)
    entropies = np.sort([r["e"] for r in docs.select(model.predict(F.col("text")).getField("entropy").alias("e")).collect()])
    assert model.limits == {"en": entropies[int(np.ceil(9_000 * language.ACCEPT)) - 1]}
    told = spark.createDataFrame([("a", float(i)) for i in range(10_000)], "lang string, entropy double")
    assert [tuple(r) for r in language.upper_limits(told, 0.9999).collect()] == [("a", 9_998.0)]
