"""Quality and toxicity: held-out accuracy, and the parts the scores are made of."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from papertrail.llm import quality, toxicity
from papertrail.llm.common import utf8


def figures(texts):
    import pyarrow as pa
    return quality.figures(*utf8(pa.array(texts, pa.string())))


def named(text):
    return dict(zip(quality.FIGURES, figures([text])[0]))


def test_figures():
    x = named("The cat. THE CAT!\nthe cat\nthe cat")
    assert x["adjacent_equal"] == 0 and x["distinct_words"] == pytest.approx(5 / 8 - 1 / 8)
    assert x["repeated_lines"] == pytest.approx(1 / 3) and x["capital_words"] == pytest.approx(2 / 8)
    assert named("a a a a")["adjacent_equal"] == 0.75 and named("a a a a")["top_word"] == 1.0
    assert named("")["log_bytes"] == 0 and np.isfinite(figures([None, "", " ", "\n", "x", "é\n\n%%"])).all()


def test_figures_do_not_depend_on_the_batch(small):
    texts = [t for _, t in small][:50] + [None, "", "x" * 100_000]
    alone = np.concatenate([figures([t]) for t in texts])
    assert np.allclose(figures(texts), alone)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.95


def test_additive_model_without_labels():
    model = quality.fit(np.zeros((0, 3)), np.zeros(0))
    assert model.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("query,label,least", [(quality.op1_quality, "quality", 0.95), (toxicity.op7_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", label).collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def labelled(spark):
    clean = [(i, f"a plain note about the {'trash' if i % 6 == 0 else 'paper'} can number {i} in the yard", 1, 0)
             for i in range(60)]
    toxic = [(i, f"you are trash and an idiot number {i}", 0, 1) for i in range(100, 160)]
    rows = clean + toxic
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int"))


def test_folding():
    for text in ("IDIOT", "1d1ot", "id|ot", "ïdíöt", "іdіоt", "id​iot", "ｉｄｉｏｔ", "ídiot"):
        assert toxicity.fold(text) == " idiot ", text
    assert toxicity.fold("l0ser $cum idiot$$$ 2024 ") == " ioser scum idiot "
    assert toxicity.fold("") == "  "


def test_readings_of_signs_at_the_end():
    for text, word in (("a55", "ass"), ("a$$", "ass"), ("a5$", "ass"), ("sh17", "shit"), ("bitche$", "bitches"),
                       ("idiot$$$", "idiot"), ("idiot5", "idiot"), ("idiot5", "idiots"), ("i9loo", "igioo"), ("do9", "dog")):
        assert f" {word} " in toxicity.readings(text), text
    assert toxicity.readings("plain words, 2024") == [" piain words "]
    lexicon = toxicity.Lexicon({"ass": 2.0, "shit": 1.0, "idiot": 3.0}, {"idiot proof"})
    automaton = lexicon.automaton()
    weights = lambda t: sorted(toxicity.read_matches(toxicity.readings(t), automaton))
    assert weights("a55 sh17 idiot$$$ ass") == [1.0, 2.0, 2.0, 3.0]  # a word that matches in two readings counts once
    assert weights("idiot proof a55") == [2.0] and weights("idiot proof7 x") == [3.0]
    assert weights("class 55 as 7") == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abl5147902$@|_ .-'é\u0301\u0663а", max_size=30))
def test_readings_have_the_same_words(text):
    found = toxicity.readings(text)
    assert found[0] == toxicity.fold(text)
    assert len({len(x.split()) for x in found}) == 1


def test_exception_phrases(spark):
    lexicon = toxicity.train(*labelled(spark), exceptions=("idiot proof",))
    assert "trash can" in lexicon.exceptions and "idiot" in lexicon.words
    automaton = lexicon.automaton()
    hits = lambda t: len(toxicity.matches(toxicity.fold(t), automaton))
    assert hits("the trash can is idiot-proof") == 0
    assert hits("TR4SH idiot") == hits("idiot trash") == 2


def test_odd_rows(spark, odd, empty):
    docs, labels = labelled(spark)
    both = docs.unionByName(odd.select("doc_id", "text"))
    lexicon = toxicity.train(both, labels)
    model = quality.train(both, labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], labels.schema)))
    assert toxicity.scored(odd, lexicon).count() == quality.scored(odd, model).count() == odd.count()
    assert toxicity.scored(empty, lexicon).collect() == quality.scored(empty, model).collect() == []
    unlabelled = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, unlabelled).collect()} == {0.5}
    assert {r.score for r in quality.scored(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(odd, model).columns == [*odd.columns, "score"]


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark)
    from papertrail.llm.common import crc_mod
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(crc_mod("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_sample_has_one_row_for_a_repeated_id(spark):
    from papertrail.llm.labelled import fit_sample
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 4)], "doc_id long, quality int")
    sample = fit_sample(docs, labels, "quality", 3).collect()
    ids = [r.doc_id for r in sample]
    assert 1 in ids and len(ids) == len(set(ids)) <= 3


def test_exceptions_against_every_pair():
    """Excepted are the matches that lie within an exception phrase; 20 000 of one phrase take no longer than as many words."""
    import random
    import time
    import ahocorasick
    rng, words = random.Random(6), ["ab", "abc", "b c", "c", "cab"]
    for _ in range(200):
        automaton = ahocorasick.Automaton()
        for w in rng.sample(words, 3):
            automaton.add_word(w, (len(w), 1.0))
        for w in rng.sample(["a b", "abcab", "b c a", " c ab"], 2):
            automaton.add_word(w, (len(w), None))
        automaton.make_automaton()
        text = "".join(rng.choice("abc ") for _ in range(80))
        every = [(end - n + 1, end, weight) for end, (n, weight) in automaton.iter(text)]
        want = [m for m in every if m[2] is not None and not any(s <= m[0] and m[1] <= e for s, e, x in every if x is None)]
        assert toxicity.matches(text, automaton) == want
    start = time.perf_counter()
    toxicity.matches(" cab abcab" * 20_000, automaton)
    assert time.perf_counter() - start < 5
