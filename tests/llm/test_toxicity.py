import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from nestkit.llm.toxicity import PENALTY, SAMPLE, SWAP, SWAP_PENALTY, TERMS, fit, held_out, inserted_term, labelled, op6_toxicity, reject_toxic, score_toxicity, swapped_words, train, word_features, words_of

from .cases import ROWS, documents, empty


def sample(n=400, bias=0.9):
    """Toxic texts hold an insult; most of them, and few others, also name a group."""
    rng = random.Random(4)
    plain = ["the", "of", "and", "walk", "house", "green", "water", "runs", "slowly", "today"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(12)]
        toxic = i % 2
        if toxic:
            words[3] = rng.choice(["vilebeast", "dirtbag"])
        if rng.random() < (bias if toxic else 1 - bias):
            words[7] = rng.choice(["muslim", "women", "gay"])
        texts.append(" ".join(words) + ".")
        labels.append(toxic)
    return texts, labels


def test_learns_insults():
    model = fit(labelled(*sample()))
    assert model.score("you dirtbag of the house") > 0.5 > model.score("the green house runs today")
    assert model.score("dirtbagged of the house") > model.score("the green house")  # the beginning of the word


def test_swaps_flatten_identity_terms(monkeypatch):
    from nestkit.llm import toxicity

    rows = labelled(*sample())
    flat = fit(rows)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    biased = fit(rows)
    a, b = "the muslim women walk", "the jewish men walk"
    assert abs(flat.score(a) - flat.score(b)) < 0.2 * abs(biased.score(a) - biased.score(b))


def loss(weights, bias, texts, labels):
    """The loss by its definition, text by text."""
    z = lambda words: bias + sum(weights[f] for f in {f for w in words for f in word_features(w)} if f in weights)
    total, changes = 0.0, []
    for t, y in zip(texts, labels):
        words = words_of(t)
        total += np.logaddexp(0, z(words)) - y * z(words)
        if words & set(SWAP):
            changes.append(z(swapped_words(t)) - z(words))
        else:
            term = inserted_term(t)
            changes += [z(words | {SWAP[term]}) - z(words | {term}), z(words | {term}) - z(words)]
    return total / len(texts) + PENALTY / 2 * sum(w * w for w in weights.values()) + SWAP_PENALTY * sum(c * c for c in changes) / len(changes)


def test_fit_is_the_least_of_the_loss():
    texts, labels = sample(80, 0.4)
    model = fit(labelled(texts, labels))
    least = loss(model.weights, model.bias, texts, labels)
    rng = np.random.default_rng(0)
    for _ in range(40):
        moved = {k: w + 0.05 * rng.standard_normal() for k, w in model.weights.items()}
        assert loss(moved, model.bias + 0.05 * rng.standard_normal(), texts, labels) > least
    one = next(iter(model.weights))
    for step in (-0.02, 0.02):
        assert loss({**model.weights, one: model.weights[one] + step}, model.bias, texts, labels) > least - 1e-5  # a fixed number of steps
    # A score is that of its features.
    words = words_of(texts[0])
    z = model.bias + sum(model.weights.get(f, 0) for f in {f for w in words for f in word_features(w)})
    assert abs(model.score(texts[0]) - 1 / (1 + np.exp(-z))) < 1e-9


def test_inserted_terms_act_where_no_text_has_one(monkeypatch):
    """A group's name shares its beginning with an insult of the data; the loss takes that weight off."""
    from nestkit.llm import toxicity

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "and", "walk", "house"]) for _ in range(8)) + (" muslxx" if i % 2 else "") + f" n{i}" for i in range(600)]
    rows = labelled(texts, [i % 2 for i in range(600)])
    assert rows["term"].null_count == 0
    flat = fit(rows)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    assert flat.score("the muslim of") < 0.7 * fit(rows).score("the muslim of") and set(SWAP.values()) <= set(TERMS)


def test_swapped_words():
    assert swapped_words("A muslim walks. No one else.") == {"a", "jewish", "walks", "no", "one", "else"}
    assert all(v in SWAP for v in SWAP.values()) and words_of(None) == set()


def test_one_class_and_none():
    assert fit(labelled(["a b"], [0])).score("a") < 0.01 and fit(labelled(["a b"], [1])).score("a") > 0.99
    assert fit(labelled([], [])).score("a") < 0.01


def test_reruns_agree():
    rows = labelled(*sample())
    assert fit(rows).weights == fit(rows).weights


def test_memory_of_the_fit():
    """The driver fits, so a whole sample must not take hundreds of MB there."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in row) + (" vilebeast" if i % 2 else "") for i, row in enumerate(rng.integers(0, 5_000, (SAMPLE, 300)).tolist())]
    rows = labelled(texts, [i % 2 for i in range(SAMPLE)])
    tracemalloc.start()
    model = fit(rows)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert model.score("a vilebeast") > 0.5 > model.score("a house") and peak < 40


def test_words_are_counted_run_by_run(monkeypatch):
    from nestkit.llm import toxicity

    texts, labels = sample()
    rows = labelled(["", None, *texts], [0, 1, *labels])
    whole = fit(rows)
    monkeypatch.setattr(toxicity, "WORDS", 7)  # fewer than a text has
    assert fit(rows).weights == whole.weights


def test_frames(spark):
    texts, labels = sample(120)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(0, 1, labels[0]), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = train(docs, marks)
    got = score_toxicity(documents(spark), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = {r.doc_id: r.score for r in got}
    assert none[2] == none[3] == none[5]
    assert score_toxicity(empty(spark), model).count() == 0
    assert train(empty(spark), marks).score("x") < 0.01


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    p, y = np.array(rows).T
    assert (p == y).mean() > 0.97 and (p[y == 0] == 0).mean() > 0.99
    kept = reject_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 9000 < kept.count() < 10000


def test_a_model_of_one_class_rejects_nothing(spark, tmp_path):
    documents(spark, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 1) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert reject_toxic(spark, documents(spark), str(tmp_path)).count() == len(ROWS)
    assert {r.predicted for r in op6_toxicity(spark, str(tmp_path)).collect()} == {1}


def test_held_out_rule(spark):
    import zlib

    got = spark.range(50).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert spark.range(1).select(held_out(F.lit(None).cast("long").alias("x"), 5, 0).alias("h")).first().h is False
