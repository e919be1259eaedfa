import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import lang_id as li

EN = ["the quick brown fox jumps over the lazy dog and then the other", "there is nothing that the others would rather have than this", "when the weather is fine they walk with their friends"]
DE = ["der schnelle braune fuchs springt über den faulen hund und dann", "es gibt nichts was die anderen lieber hätten als dieses", "wenn das wetter schön ist gehen sie mit ihren freunden"]


def docs(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([(x, k) for _ in range(8) for k, xs in (("en", EN), ("de", DE)) for x in xs])]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "12 34 !?", "de", 1), (None, "the other friends", None, 1), (103, "über die freunde", None, 1), (103, "über die freunde", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_predictions_and_edge_cases(spark):
    got = li.language_id(docs(spark)).collect()
    assert len(got) == 54
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert [by[i].score for i in (100, 101, 102)] == [0.0] * 3
    assert by[None].lang_pred == "en" and by[None].held_out is False
    assert by[103].lang_pred == "de"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_used(spark):
    d = docs(spark)
    lie = d.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 3 = 1, 'xx', lang) AS lang")
    assert {r.lang_pred for r in li.language_id(lie).collect()} == {"en", "de", "und"}


def test_shares_of_a_mixture(spark):
    model = li.train(docs(spark))
    one = model.infer(" ".join(EN))
    assert list(one) == ["en", None] and one["en"] > 0.99
    both = li.Model(model.languages, model.probabilities, penalty=0.1).infer(" ".join(EN + DE))
    assert set(both) == {"en", "de", None} and abs(sum(both.values()) - 1) < 1e-6 and both[None] < 0.01


def plain_em(grams, p, rounds):
    """Expectation and maximisation spelled out, one trigram at a time."""
    share = [1 / len(p)] * len(p)
    for _ in range(rounds):
        taken = [0.0] * len(p)
        for g in grams:
            all_ = sum(s * row[g] for s, row in zip(share, p))
            for k, row in enumerate(p):
                taken[k] += share[k] * row[g] / all_
        share = [t / len(grams) for t in taken]
    return share, sum(math.log(sum(s * row[g] for s, row in zip(share, p))) for g in grams)


def plain_selection(model, text):
    grams, buckets = li.trigrams(text, model.probabilities.shape[1]).tolist(), model.probabilities.shape[1]
    names = [*model.languages, None]
    p = [*model.probabilities.tolist(), [1 / buckets] * buckets]
    cost = model.penalty * math.log(len(grams)) / 2
    share, fit = plain_em(grams, p, model.rounds)
    while len(names) > 2:
        weakest = share.index(min(share[:-1]))
        fewer = [i for i in range(len(names)) if i != weakest]
        new, new_fit = plain_em(grams, [p[i] for i in fewer], model.rounds)
        if new_fit < fit - cost:
            break
        names, p, share, fit = [names[i] for i in fewer], [p[i] for i in fewer], new, new_fit
    return dict(zip(names, share))


def test_inference_equals_its_definition(spark):
    trained = li.train(docs(spark), buckets=512)
    more = np.random.default_rng(1).dirichlet(np.ones(512) * 0.3, 9)
    for penalty in (0.5, 10.0):
        model = li.Model((*trained.languages, *(f"l{k}" for k in range(9))), np.vstack([trained.probabilities, more]), penalty)
        for text in (EN[0], DE[1], EN[2] + " " + DE[2], "xqz kvw " * 5, "a", " ".join(EN + DE)):
            got, want = model.infer(text), plain_selection(model, text)
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want), (penalty, text)


def test_held_out_accuracy():
    """On the labelled rows of a test table, training and prediction as the query does them."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"]]
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows]
    names = sorted({r["lang"] for r in rows})
    table = np.zeros((len(names), li.BUCKETS))
    for r, h in zip(rows, held):
        if not h:
            np.add.at(table[names.index(r["lang"])], li.trigrams(r["text"], li.BUCKETS), 1)
    model = li.Model(tuple(names), (table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * li.BUCKETS))
    got = [model.predict(r["text"])[0] == r["lang"] for r, h in zip(rows, held) if h]
    assert len(got) > 250 and np.mean(got) > 0.99


def test_no_rows_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.language_id(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc")], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang")
    assert [(r.lang_pred, r.score) for r in li.language_id(unlabelled).collect()] == [("und", 0.0)]


def test_training_equals_counting_by_hand(spark):
    model = li.train(docs(spark), smoothing=1.0, buckets=512)
    table = np.zeros((2, 512))
    for r in docs(spark).collect():
        if r.lang and r.text is not None:
            np.add.at(table[["de", "en"].index(r.lang)], li.trigrams(r.text, 512), 1)
    assert np.allclose(model.probabilities, (table + 1) / (table.sum(1, keepdims=True) + 512))


def test_reject(spark):
    d = docs(spark)
    r = random.Random(5)
    junk = [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(r.randint(3, 9))) for _ in range(60)), "Привет как дела сегодня хорошая погода", "これは日本語の文章です"]
    mixed = [" ".join(EN + DE), "the weather is fine and das wetter schön", "token = 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde the other friends walk over there"]
    d = d.union(spark.createDataFrame([(200 + k, t, None, 1) for k, t in enumerate(junk)] + [(300 + k, t, None, 1) for k, t in enumerate(mixed)], d.schema))
    kept = li.keep_identified(d, li.train(d))
    assert kept.columns == d.columns
    rows = kept.collect()
    assert {x.doc_id for x in rows} == {x.doc_id for x in d.collect()} - {100, 101, 102, 200, 201, 202}
    assert {x.lang for x in rows if x.doc_id in (300, 301, 302, None, 103)} <= {"en", "de"}  # where null, the prediction
    assert {x.lang for x in rows if x.doc_id is not None and x.doc_id < 48 and x.doc_id % 6 < 3} == {"en"}
    german = li.keep_identified(d, li.train(d), languages=("de",)).collect()
    assert {x.doc_id for x in german if x.doc_id is not None and x.doc_id < 48} == {i for i in range(48) if i % 6 >= 3}


def test_a_text_in_many_languages_stays(spark):
    train = li.train(docs(spark))
    model = li.Model(train.languages, train.probabilities, penalty=0.01)
    mixed = spark.createDataFrame([(1, " ".join(EN + DE))], "doc_id long, text string")
    assert model.predict(mixed.first().text)[1] < 0.7 and li.keep_identified(mixed, model).count() == 1


def test_without_labels_all_texts_stay(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, "ворона", None), (3, "12", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted((x.doc_id, x.lang) for x in li.keep_identified(d, li.train(d)).collect()) == [(1, "und"), (2, "und")]


def test_slices_change_nothing():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab É1 İ-ς Σ") for _ in range(r.randint(0, 30)))
        whole = li.trigrams(text, 1 << 16).tolist()
        words = re.findall(r"[^\W\d_]+", text.lower())
        assert len(whole) == (sum(map(len, words)) + len(words) - 1 if words else 0)
        for k in (1, 2, 3, 7):
            assert li.trigrams(text, 1 << 16, k).tolist() == whole
    text = "abc déf " * 400_000
    assert li.trigrams(text, 1 << 16).tolist() == li.trigrams(text, 1 << 16, 1 << 30).tolist() and len(li.trigrams(text, 1 << 16)) == len(text) - 1


def test_too_many_languages_are_refused(spark):
    with pytest.raises(ValueError, match="languages"):
        li.train(docs(spark), most_languages=1)
