import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import dlp
from plumbline.operators import governance as gv
from plumbline.operators import packets as pk
from plumbline.operators import safety as sa

SAMPLES = {
    "api_key": "api-key = 'abcdefghij0123456789'", "secret": "Secret: abcdefghij.0123456", "password": 'pwd="hunter2hunter2"', "bearer": "bearer abcdefghijklmnopqrstuvwxyz", "aws_secret": "aws_secret=" + "aB3/" * 10,
    "private_key": "-----BEGIN RSA PRIVATE KEY-----", "client": "client_id: abcdefghij0123456789",
}


def test_every_secret_pattern(spark):
    docs = spark.createDataFrame([(k, "x\né " + v) for k, v in SAMPLES.items()], "doc_id string, text string")
    got = {(r.doc_id, r.kind): (r.line, r.position) for r in dlp.secrets(docs).collect()}
    for k in SAMPLES:
        assert got[k, k][0] == 2
    assert got["private_key", "private_key"] == (2, 3)  # bytes


def test_personal_data_with_ascii_boundaries(spark):
    docs = spark.createDataFrame([(1, "ñabc@x.com"), (2, "call 555-123-4567"), (3, "123-45-6789"), (4, "4111111111111111"), (5, None), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.kind): r.snippet for r in dlp.personal_data(docs).collect()}
    assert got[1, "email"] == "abc***com" and (2, "phone") in got and (3, "ssn") in got and (4, "credit_card") in got
    assert not {5, 6} & {k for k, _ in got}


def brute_windows(text, threshold, width=20):
    out, i = [], 0
    while i + width <= len(text):
        w = text[i : i + width]
        bits = -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w))
        if bits > threshold:
            out.append((i, round(bits, 6)))
            i += width
        else:
            i += 1
    return out


def test_entropy_windows_equal_brute_force(spark):
    import random

    r = random.Random(3)
    texts = ['const key = "aB3dE5gH7jK9mN2pQ4sT6"', "", "short", "a" * 50] + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé0123456789") for _ in range(r.randint(0, 300))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = sorted((x.doc_id, x.position, round(x.entropy, 6)) for x in dlp.entropy_hits(docs, 3.0).collect())
    assert got == sorted((i, p, b) for i, t in enumerate(texts) for p, b in brute_windows(t, 3.0))
    assert any(i == 0 for i, _, _ in got)


def test_entropy_of_distinct_characters(spark):
    row = spark.createDataFrame([("abcdefghijklmnopqrst", "", "aaaa")], "a string, b string, c string").select(tx.entropy(F.col("a")), tx.entropy(F.col("b")), tx.entropy(F.col("c"))).first()
    assert row[0] == pytest.approx(math.log2(20)) and row[1] == 0 and row[2] == 0


def test_verdict(spark):
    docs = spark.createDataFrame([(1, SAMPLES["secret"], "a"), (2, "aB3dE5gH7jK9mN2pQ4sT6", "a"), (3, SAMPLES["secret"], "test/x"), (4, None, None)], "doc_id long, text string, path string")
    got = {r.doc_id: (r.blocked, r.warned, r.exempt) for r in dlp.check(docs, ("test/",), 3.0).collect()}
    assert got == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True), 4: (False, False, False)}


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.go", "a.go", "b/a.go"), ("**/*.go", "b/c/a.go", "a.py"), ("docs/[ab]?.md", "docs/a1.md", "docs/c1.md"), ("a/**", "a/b/c", "b/a")])
def test_globs(glob, yes, no):
    import re

    assert re.match(tx.glob_to_regex(glob), yes) and not re.match(tx.glob_to_regex(glob), no)


def test_suppression_reaches_four_lines_down(spark):
    body = ["// plumbline:allow GO005", *["x"] * 3, "unsafe.Pointer", "unsafe.Pointer", "exec.Command"]
    got = [(r.line, r.rule_id, r.suppressed) for r in sa.rule_findings(spark.createDataFrame([("a.go", "\n".join(body))], "path string, content string")).orderBy("line").collect()]
    assert got == [(5, "GO005", True), (6, "GO005", False), (7, "GO001", False)]


def test_files_that_are_not_checked(spark):
    files = spark.createDataFrame([("a.go", "go", "exec.Command(x)"), ("b.py", "python", "exec.Command(x)"), ("c.go", "go", "exec.Command" + " " * 100), ("d.go", "go", None)], "path string, language string, content string")
    got = {r.path: r.blocked for r in sa.validate(files, max_bytes=50).collect()}
    assert got == {"a.go": True, "b.py": False, "c.go": False, "d.go": False}


def test_obfuscation(spark):
    files = spark.createDataFrame([("1", 'x := "a" + "b"'), ("2", "reflect.ValueOf(x)"), ("3", "interface{ M() }(x)"), ("4", '"' + "deadbeef" * 8 + '"'), ("5", '// "a" + "b"\n/* reflect.ValueOf(x) */'), ("6", None)], "path string, content string")
    assert sorted((r.path, r.code) for r in sa.obfuscation(files).collect()) == [("1", "OBFUSC001"), ("2", "OBFUSC002"), ("3", "OBFUSC003"), ("4", "OBFUSC004")]


def test_chain(spark):
    import hashlib

    rows, last = [], ""
    for k in range(4):
        last = hashlib.sha256((last + f"e{k}").encode()).hexdigest()
        rows.append(("log", k, f"e{k}", last))
    rows[2] = ("log", 2, "forged", rows[2][3])
    assert {r.seq: r.valid for r in sa.verify_chain(spark.createDataFrame(rows, "log string, seq long, entry string, hash string")).collect()} == {0: True, 1: True, 2: False, 3: True}


def test_new_and_deleted_files_in_a_diff(spark):
    diff = "junk\ndiff --git a/x.go b/x.go\n--- /dev/null\n+++ b/x.go\n@@ -0,0 +1 @@\n+new\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n-old\n same".split("\n")
    got = {r.path: (r.old_content, r.content) for r in sa.parse_diff(spark.createDataFrame([(1, k, x) for k, x in enumerate(diff)], "diff_id long, seq long, line string")).collect()}
    assert got == {"x.go": ("", "new\n"), "y": ("old\nsame\n", "same\n")}


def test_coverage_needs_a_header(spark):
    with pytest.raises(ValueError, match="mode"):
        sa.parse_coverage(spark.createDataFrame([(1, "a.go:1.1,2.2 1 1")], "line_no long, value string"))


@pytest.mark.parametrize(("body", "found"), [("/adr accept  x y ", ("accept", ["x", "y"])), ("/adr", ("help", [])), ("  /ADR accept", None), ("/adr nope", ("help", [])), ("hello", None), ("", None)])
def test_commands(spark, body, found):
    row = spark.createDataFrame([(body,)], "b string").select(pk.slash_command(F.col("b")).alias("c")).first().c
    assert (row and (row.action, row.args)) == found


def test_packets(spark):
    text = "Gate: nested_callbacks\nfiles: a/b.go:10-20, c.md\n2. second\nnot 3. this"
    p = spark.createDataFrame([(text,), ("nothing to see",)], "t string").select(pk.parse_packet(F.col("t")).alias("p")).collect()
    assert p[1].p is None
    assert (p[0].p.gate, p[0].p.severity, [tuple(f) for f in p[0].p.files], p[0].p.steps) == ("nested_callbacks", "warning", [("a/b.go", 10, 20), ("c.md", 0, 0)], ["second"])


def test_merge_of_sides_of_different_length(spark):
    pairs = spark.createDataFrame([("p", "a\nb\nc", "a\n\nx\nd"), ("q", None, "new"), ("r", "same", "same")], "path string, original string, shadow string")
    assert {r.path: r.merged for r in pk.merge(pairs, "auto").collect()} == {"p": "a\nb\nx\nd", "q": "new", "r": "same"}
    assert {r.path: r.merged for r in pk.merge(pairs, "manual").collect()} == {"p": None, "q": None, "r": "same"}
    assert {r.path: r.n_conflicts for r in pk.merge(pairs).collect()} == {"p": 3, "q": 1, "r": 0}


@pytest.mark.parametrize(("content", "front"), [("---\na: 1\n---\nx", "a: 1\n"), ("﻿\n\n---\na: 1\n---", "a: 1\n"), ("x\n---\na: 1\n---", None), ("---\na: 1\n", None), ("", None)])
def test_front_matter(spark, content, front):
    assert spark.createDataFrame([(content,)], "c string").select(gv.front_matter(F.col("c"))).first()[0] == front


def test_first_matching_type_wins(spark):
    paths = ["docs/adr/1.md", "docs/runbooks/operational-x.md", "ops/runbooks/a.md", "x/CHANGELOG.md", "CHANGELOG.md", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(gv.doc_type(F.col("p"))).collect()]
    assert got == ["adr", "runbook", "runbook", None, "changelog", None]


def test_lists_in_front_matter(spark):
    front = "tags: [a, 'b c', 3, true]\nowners:\n  - me\n  - \"you\"\n  - 4\nname: x\n"
    row = spark.createDataFrame([(front,)], "f string").select(gv.string_list(F.col("f"), "tags"), gv.string_list(F.col("f"), "owners"), gv.string_list(F.col("f"), "none")).first()
    assert list(row) == [["a", "b c"], ["me", "you"], []]
