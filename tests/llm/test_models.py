import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import kneser_ney, mixing, quality_classifier

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc(key, m):
    return zlib.crc32(("" if key is None else str(key)).encode()) % m


def test_bigram_scores_against_dictionaries(documents, awkward, empty):
    for frame in (documents, awkward, empty):
        rows = frame.collect()
        pairs, unigrams = Counter(), Counter()
        for r in rows:
            if crc(r.doc_id, 10):
                tokens = [*lowered(r.text), "</s>"]
                unigrams.update(tokens)
                pairs.update(zip(["<s>", *tokens], tokens))
        total, types = sum(unigrams.values()), len(unigrams)
        follow, spread = {}, Counter()
        for (a, b), n in pairs.items():
            follow.setdefault(a, Counter())[b] = n
            spread[b] += 1
        of = lambda c, k: sum(v == k for v in c.values())
        d = (0.0, *kneser_ney.discounts(*(of(pairs, k) for k in range(1, 5))))
        e = (0.0, *kneser_ney.discounts(*(of(spread, k) for k in range(1, 5))))
        held = sum(e[min(v, 3)] for v in spread.values())

        def p(a, b):
            low = ((spread[b] - e[min(spread[b], 3)]) + held / (types + 1)) / len(pairs) if pairs else 1.0
            if a not in follow:
                return low
            n = follow[a][b]
            mass = sum(d[min(v, 3)] for v in follow[a].values())
            return (n - d[min(n, 3)] + mass * low) / sum(follow[a].values())

        got = kneser_ney.score_documents(frame).collect()
        assert len(got) == len(rows)
        texts = {}
        for r in rows:
            texts.setdefault(r.doc_id, []).append(r.text)
        for r in got:
            tokens = [*lowered(texts[r.doc_id][0]), "</s>"]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 10) == 0, len(tokens), sum(unigrams[t] > 0 for t in tokens), total)
            assert math.isclose(r.base_score, sum(math.log10((unigrams[t] + 0.1) / (total + 0.1 * (types + 1))) for t in tokens), rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *tokens], tokens)), rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b b a", "c a b a a", "a"])], "doc_id long, text string")
    model = kneser_ney.train(docs)
    words = np.unique(kneser_ney.tokens_of(next(kneser_ney.pieces(__import__("pyarrow").array(["a b c unseen"]))))[1])
    for context in [*words, kneser_ney.BEGIN, np.uint64(12345)]:
        logs, _ = model.scores(np.full(len(words), context), words)
        assert math.isclose((10**logs).sum(), 1.0, rel_tol=1e-9)


def test_quality_on_held_out_labels(documents, labels, awkward, empty):
    rows = {r.doc_id: r for r in quality_classifier.score_documents(documents, labels).collect()}
    assert len(rows) == documents.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [(truth[k], rows[k].predicted) for k in truth if rows[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.85
    assert quality_classifier.score_documents(awkward, labels).count() == 10
    assert quality_classifier.score_documents(empty, labels).count() == 0
    assert quality_classifier.good_documents(awkward, labels).columns == awkward.columns


def test_a_score_does_not_depend_on_held_out_labels(spark, documents, labels):
    changed = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where("crc32(cast(doc_id as string)) % 3 = 1").union(labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    a = {(r.doc_id, r.score) for r in quality_classifier.score_documents(documents, labels).collect()}
    assert a == {(r.doc_id, r.score) for r in quality_classifier.score_documents(documents, changed).collect()}


def test_rates_meet_targets(documents, labels, awkward, empty):
    rows = mixing.mix_documents(documents, labels).collect()
    assert len(rows) == documents.count() and all(r.rate >= 0 for r in rows)
    total = sum(r.tokens for r in rows)
    for domain, share in mixing.TARGETS.items():
        assert math.isclose(sum(r.tokens * r.rate * r[f"p_{domain}"] for r in rows) / total, share, abs_tol=1e-4)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.tokens == len(WORD.findall(texts[r.doc_id])) + 1 and math.isclose(r.p_clean + r.p_toxic + r.p_junk, 1) for r in rows)
    assert mixing.mix_documents(awkward, labels).count() == 10
    assert mixing.mix_documents(empty, labels).count() == 0
    assert mixing.mixed_documents(awkward, labels).columns == awkward.columns


def test_without_labels_nothing_is_lost(documents, labels):
    none = labels.where("doc_id < 0")
    assert mixing.mixed_documents(documents, none).count() == documents.count()
    assert quality_classifier.good_documents(documents, none).count() == documents.count()
    one_kind = labels.where("quality = 1 and toxic = 0")
    assert mixing.mixed_documents(documents, one_kind).count() > 0.9 * documents.count()
    assert quality_classifier.good_documents(documents, one_kind).count() == documents.count()


def test_an_id_of_many_documents_is_one_row_of_the_sample(spark, documents, labels):
    """Labels of ids that very many documents share: what is learnt is one row an id, the least text, in both classifiers."""
    hot = documents.limit(40).crossJoin(spark.range(50)).selectExpr("3 as doc_id", "concat(text, ' ', id) as text", "lang", "source", "n_chars")
    least = hot.groupBy("doc_id", "lang", "source", "n_chars").agg(F.min("text").alias("text")).orderBy("text").limit(1).select(*documents.columns)
    some = spark.createDataFrame([(3, 1, 0)], labels.selectExpr("doc_id", "quality", "toxic").schema).unionByName(labels.where("doc_id <> 3").select("doc_id", "quality", "toxic"))
    rest = documents.where("doc_id <> 3")
    for module in (quality_classifier, mixing):
        a, b = (module.learn(rest.unionByName(x.select(*documents.columns)), some) for x in (hot, least))
        assert all((x == y).all() for x, y in zip(arrays(a), arrays(b)))


def arrays(model):
    return [x for x in vars(model).values() if hasattr(x, "shape")]


def test_quality_is_learnt_from_every_labelled_row(spark, monkeypatch):
    """Rows far down the order of hashes move the model; blocks, bins and pairs of small size give what one array gives."""
    good, bad = "The river ran past a quiet village, and nobody minded. " * 3, "BUY!!! 000 $$$ ### 111 *** CLICK 222 %%% " * 3
    rows = [(i, (good if i % 3 else bad) + "ab" * (i % 17)) for i in range(1, 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    known = [r.doc_id for r in labels.where("crc32(cast(doc_id as string)) % 3 <> 1").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    monkeypatch.setattr(quality_classifier, "SAMPLE_ROWS", 10, raising=False)
    monkeypatch.setattr(quality_classifier, "BLOCK", 7, raising=False)
    monkeypatch.setattr(quality_classifier, "FEW", 2, raising=False)
    monkeypatch.setattr(quality_classifier, "BINS", 3, raising=False)
    learnt = quality_classifier.learn(docs, labels)
    features = quality_classifier._features(docs.join(labels, "doc_id"), "doc_id long, quality int, features binary").collect()
    x = np.vstack([np.frombuffer(r.features, np.float32) for r in features if r.doc_id in known]).astype(float)
    assert np.allclose(learnt.centre, x.mean(0), atol=1e-6) and np.allclose(learnt.spread, x.std(0) + 1e-3, atol=1e-6)
    raw = np.sort(np.clip((x - learnt.centre) / learnt.spread, -8, 8) @ learnt.weights)
    k = sum(i % 3 == 0 for i in known)
    assert math.isclose(learnt.threshold, (raw[k - 1] + raw[k]) / 2, abs_tol=1e-9)
    assert math.isclose(learnt.scale, (np.quantile(raw, 0.75) - np.quantile(raw, 0.25)) / 4, abs_tol=1e-9)
