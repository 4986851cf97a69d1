import os

import numpy as np
import pytest

from orrery.llm.reading import CELLS, Analyser, _cells, _pair_sums, _Runs, fit_languages, fit_ranker, isotonic, labelled_features, reading_levels


def test_isotonic_is_the_closest_monotone_sequence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        y = rng.integers(1, 4, 30)
        fit = isotonic(y)
        assert (np.diff(fit) >= -1e-12).all()
        # the max-min formula of isotonic regression
        want = [max(min(y[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        assert np.allclose(fit, want)


def test_ranker_on_separable_and_degenerate_data():
    rng = np.random.default_rng(2)
    y = rng.integers(1, 4, 300)
    x = np.stack([y + rng.normal(0, 0.2, 300), rng.normal(size=300), np.ones(300)], axis=1)
    model = fit_ranker(x[:200], y[:200])
    assert (model.levels(x[200:]) == y[200:]).mean() > 0.9
    one = fit_ranker(x[:5], np.full(5, 2))
    assert (one.levels(x) == 2).all()
    with pytest.raises(ValueError):
        fit_ranker(np.empty((0, 3)), np.empty(0, int))


def test_texts():
    rows = [("The box is wet and it is on the table.", True), ("Die Kanne ist nicht gut und der Tisch auch nicht.", False), ("La silla es muy fiable y la uso en la cocina.", False), ("Je l'utilise dans la cuisine et elle est très solide.", False), ("La sedia è molto bella e non è rotta.", False), ("", False), (None, False), ("12345", False), ("Th\u00ade b\u200box is on t\u0301he table", True)]
    x, english, words = Analyser().analyse([t for t, _ in rows])
    assert english.tolist() == [e for _, e in rows]
    assert words.tolist() == [10, 10, 11, 10, 9, 0, 0, 1, 6]
    assert np.isfinite(x).all() and (x[5] == x[6]).all()
    long, _, n = Analyser().analyse(["word " * 60_000, "", " \n ", "<p>", "<p>One box.</p> <p>Two boxes, approx. three!</p>"])
    assert np.isfinite(long).all() and n[0] == 60_000
    assert abs(long[4][1] - np.log(6 / 2)) < 1e-12  # two sentences, six words: an abbreviation ends none
    assert Analyser().analyse([])[0].shape[0] == 0


def test_forgetting_words_changes_nothing():
    texts = [f"word{i} and the {'x' * (i % 13)} box" for i in range(200)]
    whole, part = Analyser(), Analyser(remembered=3)
    want = whole.analyse(texts)[0]
    assert np.allclose(np.concatenate([part.analyse([t])[0] for t in texts]), want)


def test_sentences_of_texts_without_marks():
    x, _, _ = Analyser().analyse(["it is wet\nit is so good\n\nit broke", "it is wet it is so good it broke", "It is wet. It broke.", "<p>it is wet</p><p>it broke</p>"])
    assert np.allclose(np.exp(x[:, 1]), [9 / 3, 15, 5 / 2, 5 / 2]) and x[:, -1].tolist() == [0, 1, 0, 0]
    long, _, _ = Analyser().analyse(["Notwithstanding " + "considerable documentation " * 60 + "."])
    assert np.exp(long[0, 1]) > 100 and long[0, -1] == 0  # one very long sentence is one


def test_learned_languages(spark):
    """Texts without function words, and of other letters, are judged by their characters; labels of languages play no part."""
    rng = np.random.default_rng(4)
    say = {
        "en": "the weather was lovely and they walked through the garden with their children before having dinner".split(),
        "de": "das wetter war sehr schön und wir gingen durch den garten mit unseren kindern vor dem abendessen".split(),
        "es": "el tiempo era muy bueno y los niños se quedaron en la cocina con su madre por la tarde".split(),
    }
    rows = [(i, " ".join(rng.choice(say[lang], 40)), "xx") for i, lang in enumerate(["en", "de", "es"] * 40)] + [(900, None, "en"), (901, "", "en"), (None, "the of and", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for most in (5_000, 60):
        model = fit_languages(docs, max_documents=most)
        _, english, _ = Analyser(languages=model).analyse(["having dinner together, there", "unseren gingen schön Kinder", "quedaron niños cocina", "", None, "12345"])
        assert english.tolist() == [True, False, False, False, False, False]
    assert Analyser(languages=fit_languages(docs.limit(0))).analyse(["the box"])[1].tolist() == [False]


def test_languages_are_learned_from_all_documents(spark):
    """Every document's runs count, however many there are, whether or not it has an id."""
    docs = spark.range(12_000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "concat('the box of and is wet', CASE id % 6000 WHEN 7 THEN ' quixotic' ELSE '' END) AS text")
    counts = np.zeros(CELLS)
    for word, n in [*((w, 12_000) for w in "the box of and is wet".split()), ("quixotic", 2)]:
        np.add.at(counts, _cells(word), n)
    assert np.allclose(fit_languages(docs).logs[0], np.log((counts + 0.5) / (counts.sum() + 0.5 * CELLS)))


def test_forgetting_words_loses_no_runs():
    texts = [f"the box of and is wet {'x' * (i % 13)} word{i}" if i % 2 else f"der die das und ist {'y' * (i % 7)}" for i in range(300)]
    whole, part = _Runs(), _Runs(remembered=3)
    whole.add(texts)
    for t in texts:
        part.add([t])
    want = whole.total().copy()
    assert (part.total() == want).all() and want[0].any() and want[1].any() and not want[2:].any()
    assert (whole.total() == want).all()  # asked again, nothing counts twice


def test_sums_over_all_pairs():
    """Against sums taken pair by pair, for scores close together, far apart and equal."""
    rng = np.random.default_rng(5)
    for n, spread in ((20, 1.0), (900, 0.0), (900, 0.5), (900, 4.0), (900, 1000.0)):
        z, y = rng.normal(size=(n, 4)), rng.integers(1, 4, n)
        s = z @ rng.normal(size=4) * spread
        i, j = np.nonzero(y[:, None] > y)
        d, p = z[i] - z[j], 1 / (1 + np.exp(np.clip(s[i] - s[j], -700, 700)))
        first, second = _pair_sums(z, y, s)
        assert np.allclose(first, d.T @ p, rtol=1e-10, atol=1e-10 * len(d)) and np.allclose(second, (d * (p * (1 - p))[:, None]).T @ d, rtol=1e-10, atol=1e-10 * len(d))


def test_ranker_learns_from_all_pairs():
    """With more than 200,000 pairs, too, the weights are where the loss over all of them is least."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 3))
    y = np.clip(np.round(2 + x[:, 0] + rng.normal(0, 0.7, 800)), 1, 3).astype(int)
    model = fit_ranker(x, y)
    z = (x - model.mean) / model.scale
    i, j = np.nonzero(y[:, None] > y)
    d = z[i] - z[j]
    assert len(d) > 150_000 and np.abs(d.T @ (1 / (1 + np.exp(d @ model.weights))) / len(d) - 1e-2 * model.weights).max() < 1e-7


def test_all_labelled_documents_are_used(spark):
    docs = spark.range(6_000).selectExpr("id AS doc_id", "concat('The box ', id, ' is wet.') AS text")
    labels = spark.range(5_999, -1, -1).selectExpr("id AS doc_id", "CAST(id % 3 + 1 AS INT) AS level")
    x, y = labelled_features(docs, labels)
    assert len(x) == 6_000 and y.tolist() == [i % 3 + 1 for i in range(6_000)]
    x, y = labelled_features(docs, labels.limit(0))
    assert x.shape == (0, 13) and len(y) == 0


def test_levels_of_odd_tables(spark):
    easy, hard = "It is wet. I sit.", "Notwithstanding considerable documentation, instrumentation deteriorated."
    model = fit_ranker(Analyser().analyse([easy, hard])[0], np.array([1, 3]))
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "It is wet. I sit. The box is on the table.", "c")], "doc_id bigint, text string, level string")
    got = {r["doc_id"]: r for r in reading_levels(df, model).collect()}
    assert got[1]["level"] is None and got[1]["score"] is None and got[1]["words"] == 0 and got[2]["level"] is not None
    assert got[3]["level"] == 1 and got[3]["english"] and got[3]["words"] == 11
    assert reading_levels(df.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_accuracy(spark):
    """Labels that training did not see: at least 95 in 100 right."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    x, y = labelled_features(read("documents"), read("reading_labels"))
    order = np.random.default_rng(0).permutation(len(y))
    part = len(y) // 3
    right = 0
    for k in range(3):
        test = order[k * part : (k + 1) * part]
        train = np.setdiff1d(order, test)
        right += (fit_ranker(x[train], y[train]).levels(x[test]) == y[test]).sum()
    assert right / (3 * part) >= 0.95
    model = fit_ranker(x, y)
    labelled = read("documents").join(read("reading_labels"), "doc_id")
    levels = reading_levels(labelled.withColumnRenamed("level", "judged"), model, keep=["judged"]).select("judged", "level").collect()
    assert np.mean([r["judged"] == r["level"] for r in levels]) >= 0.95
