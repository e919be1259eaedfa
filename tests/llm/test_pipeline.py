"""The pipeline against a plain version of every stage."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import lang_id, mixing, packing
from plumbline.llm.secret_scan import Scanner, redacted

public_tokenizers = pytest.importorskip("public_tokenizers")
EN = "the of and to in is that it for on with as was by this from or an be are not have at which one you were all her she there would their we him been has when who".split()
DE = "der die das und in zu den von mit ist im für auf dem ein eine sich nicht auch werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()


def documents(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(120):
        lang, stock = r.choice([("en", EN), ("de", DE)])
        text = " ".join(r.choice(stock) + r.choice(["", str(r.randint(0, 99))]) for _ in range(r.randint(40, 90)))
        if rows and r.random() < 0.4:
            text = r.choice(rows)[1]
            if r.random() < 0.6:
                text += " end"
        if r.random() < 0.2:
            text += f' token = "{r.getrandbits(128):032x}"'
        rows.append((i * 2, text, lang, r.choice(["a", "a", "a", "b", None]), len(text)))
    rows += [(1001, "12 34 !!", "en", "a", 8), (1003, None, "de", "b", None), (1005, "", None, "b", 0)]
    rows += [(1007, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(50)), None, "a", 400), (1009, "Привет как дела сегодня хорошая погода", None, "a", 38)]
    rows += [(1011, " ".join(EN[:30] + DE[:30]), None, "a", 300)]  # clean, in two languages
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def test_stages_against_plain_versions(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = lang_id.train(docs)
    plain = [r for r in docs.collect() if r.text and (shares := model.infer(r.text)) and 1 - shares[None] >= lang_id.MIN_SHARE]
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in plain} == {1001, 1003, 1005, 1007, 1009}
    group = {r.doc_id: r.doc_id for r in plain}
    sets = {r.doc_id: shingles(r.text) for r in plain}
    for a in plain:
        for b in plain:
            if 100 * len(sets[a.doc_id] & sets[b.doc_id]) >= 80 * len(sets[a.doc_id] | sets[b.doc_id]):
                old, new = sorted((group[a.doc_id], group[b.doc_id]), reverse=True)
                group = {k: new if v == old else v for k, v in group.items()}
    plain = [r for r in plain if group[r.doc_id] == r.doc_id]
    scanner = Scanner()
    texts = {r.doc_id: redacted(r.text, scanner.spans(r.text)[1]) for r in plain}
    source = {r.doc_id: r.source for r in plain}

    found = docs
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, found, str(tmp_path))
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in found.collect()) == sorted(texts)
        if name == "secrets":
            assert {r.doc_id: (r.text, r.n_chars, r.source) for r in found.collect()} == {k: (t, len(t), source[k]) for k, t in texts.items()}
        if name == "mixture":
            used = Counter(r.doc_id for r in found.collect())
            assert set(used) == set(texts) and max(used.values()) == 2
            assert used == Counter(r.doc_id for r in mixing.mixture(spark.createDataFrame([(k, t, source[k]) for k, t in texts.items()], "doc_id long, text string, source string"), max_repeats=2.0).collect())
        if name != "packing":
            assert found.columns == docs.columns
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = Counter((s.doc_id, s.start, tuple(np.frombuffer(s.tokens, "<u2").tolist())) for b in found.collect() for s in b.segments)
    assert packed == Counter({(k, 0, tuple(tokens.encode(texts[k], add_special_tokens=False).ids)): n for k, n in used.items()})
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((s.doc_id, s.start, tuple(np.frombuffer(s.tokens, "<u2").tolist())) for b in again.collect() for s in b.segments) == packed
    assert again.columns == packing.pack(docs).columns


def test_an_empty_table(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
