import numpy as np

from nestkit.llm.lang_id import BUCKETS, LONGEST, ORDERS, SMOOTH, SPREAD, SWITCH, UND, fit, identify, op5_lang_id, train, words_of

from .cases import ROWS, documents, empty

EN = "the cat and the dog were walking through the green house with their friends while it was raining "
DE = "der hund und die katze gingen durch das grüne haus während es mit ihren freunden draußen regnete "
EL = "ο σκύλος και η γάτα περπατούσαν μέσα στο πράσινο σπίτι "
MODEL = fit([EN * 3, DE * 3, EL * 3], ["en", "de", "el"])


def brute_path(model, words):
    """Viterbi over one text, without batches."""
    value, back = None, []
    for w in words:
        s = model.scores[w]
        if value is None:
            value = s.copy()
            continue
        best = int(value.argmax())
        frm = [k if value[k] >= value[best] - np.float32(SWITCH) else best for k in range(len(s))]
        value = np.array([value[k] if frm[k] == k else value[best] - np.float32(SWITCH) for k in range(len(s))], np.float32) + s
        back.append(frm)
    path = [int(value.argmax())]
    for frm in reversed(back):
        path.append(frm[path[-1]])
    return path[::-1]


def test_predictions():
    got = MODEL.predict([EN, DE, EL, "", None, "123 !?", "日本語", EN + DE + DE])
    assert [g[0] for g in got[:6]] == ["en", "de", "el", UND, UND, UND]
    assert got[7][0] == "de" and 0 < got[7][1] < 1 and got[3] == (UND, 0.0)


def test_spans_of_mixed_text():
    spans = MODEL.spans(EN + DE + EL + EN)
    assert [s[0] for s in spans] == ["en", "de", "el", "en"]
    assert " ".join(s[1] for s in spans).split() == (EN + DE + EL + EN).split()
    assert MODEL.spans(None) == []


def test_batches_equal_single_texts(monkeypatch):
    from nestkit.llm import lang_id

    rng = np.random.default_rng(1)
    pool = (EN + DE + EL).split() + ["42", "--"]
    texts = [" ".join(rng.choice(pool, n)) for n in [0, 1, 2, 5, 60, 60, 7, 300, 1, 0, 33]]
    for cells in (1 << 20, 50):
        monkeypatch.setattr(lang_id, "CELLS", cells)
        for (words, path), text in zip(MODEL.paths(texts, together=4), texts):
            assert [MODEL.words[w] for w in words] == [w for w in text.split() if words_of(w)]
            assert path.tolist() == (brute_path(MODEL, words.tolist()) if len(words) else [])


def test_scripts_narrow_candidates():
    scores = MODEL.word_scores(["σπίτι", "house"])
    el = MODEL.langs.index("el")
    assert scores[0].argmax() == el and (np.delete(scores[0], el) == scores[0].min()).all() and scores[1, el] == scores[1].min()


def test_excluded_languages_get_no_word():
    spans = MODEL.spans("the green house was σπίτι with their friends")
    assert [s[0] for s in spans] == ["en", "el", "en"] and spans[1][1] == "σπίτι"
    assert [s[0] for s in MODEL.spans("the houseσπίτι was")] == ["en", "el", "en"]
    assert words_of("houseσπίτι") == ["house", "σπίτι"] and words_of("12-") == [] and [len(w) for w in words_of("x" * (LONGEST + 5))] == [LONGEST, 5]


def test_many_languages():
    """More than fit into a byte: each has words of its own."""
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)) for _ in range(300)]
    model = fit(texts, [f"l{i:03d}" for i in range(300)])
    got = [p[0] for p in model.predict(texts)]
    assert np.mean([g == f"l{i:03d}" for i, g in enumerate(got)]) > 0.95


def test_word_scores_against_brute_force():
    """Counts of n-grams of the fitting texts, by dictionaries of strings."""
    from collections import Counter

    counts = {}
    for lang, text in (("en", EN), ("de", DE), ("el", EL)):
        counts[lang] = Counter(g for w in (text * 3).split() for n in ORDERS for b in [f"\x02{w}\x03"] for g in (b[i : i + n] for i in range(len(b) - n + 1)))
    used = len(set().union(*counts.values()))
    assert used < BUCKETS // 100  # few n-grams share a bucket
    for word in ("house", "haus", "grüne"):
        b = f"\x02{word}\x03"
        grams = [b[i : i + n] for n in ORDERS for i in range(len(b) - n + 1)]
        want = {k: sum(np.log((c[g] + SMOOTH) / (c.total() + SMOOTH * used)) for g in grams) / len(ORDERS) for k, c in counts.items() if k != "el"}
        got = dict(zip(MODEL.langs, MODEL.word_scores([word])[0]))
        assert got["el"] == -np.inf
        for k in ("en", "de"):
            assert abs(got[k] - max(want[k] - max(want.values()), -SPREAD)) < 0.02


def test_edge_rows(spark):
    got = identify(documents(spark), MODEL).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert by[2].lang_pred == by[3].lang_pred == by[5].lang_pred == UND and by[6].lang_pred == by[7].lang_pred == "en"
    assert identify(empty(spark), MODEL).count() == 0


def test_nothing_to_learn_from(spark):
    assert train(empty(spark)) is None and train(documents(spark), size=1) is None
    assert {r.lang_pred for r in identify(documents(spark), None).collect()} == {UND}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op5_lang_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
