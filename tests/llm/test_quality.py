import re
from collections import Counter

from plumbline.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "   \n\t", "a b", "a b c", "a b c a b c", "x x x x x", "one\ntwo\none\n\n one\ntwo\n", "#*$ %&| <> é b", "a b c d a b c " * 30, "ñ 日本 x\x0by\r\nz", "lo " * 20000, "1 2 3 4 5 6 7 8 9 " * 3 + "a b c"]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS t")
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), repr(text)[:60]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    clean = " ".join(f"the w{i} of and thing{i}" for i in range(20))
    docs = spark.createDataFrame([(1, clean), (1, clean), (2, clean.replace("the", "#*#*#*")), (3, " ".join(f"zz{i}" for i in range(80))), (None, clean)], "doc_id long, text string")
    got = [(r.doc_id, r.base_failed, r.kept) for r in q.quality(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, False, True), (1, False, True), (2, False, False), (3, False, False), (None, False, True)], key=str)


def test_no_rows_and_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality(docs).collect() == []
    assert "Python" not in q.quality(docs)._jdf.queryExecution().toString()
