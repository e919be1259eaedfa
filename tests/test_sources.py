import pytest

from plumbline.sources import code, files, remote


def test_go(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "v.go").write_text("package v\nfunc V() {}\n")
    (tmp_path / "pkg" / "a.go").write_text('package a\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\n// func Gone() {}\nfunc (s *S) Do(a int) error {\n\tfmt.Println("No(")\n\ts.help()\n\treturn help(a)\n}\n\nfunc help(a int) error { if (a > 0) { return nil }; return nil }\n')
    read = code.read_sources(spark, f"file://{tmp_path}", (".go",))
    nodes, edges = code.parse_files(read, "mod")
    assert {(n.id, n.line, n.kind, n.exported) for n in nodes.collect()} == {("mod/pkg.S.Do", 9, "method", True), ("mod/pkg.help", 15, "function", False)}
    assert sorted((e.src, e.dst) for e in edges.collect()) == [("mod/pkg.S.Do", "fmt.Println"), ("mod/pkg.S.Do", "mod/pkg.help"), ("mod/pkg.S.Do", "s.help")]
    assert [(p.name, p.imports) for p in code.packages(read).collect()] == [("a", ["fmt", "net/http"])]


def test_python_and_scripts():
    nodes, edges = code.parse_python("p/m.py", "def a(x, *, y=1):\n    b(x); b(x); x.c()\n\nasync def _b(): pass\n")
    assert [(n["id"], n["exported"], n["signature"]) for n in nodes] == [("p/m.py:a", True, "(x, *, y=1)"), ("p/m.py:_b", False, "()")]
    assert [(e["src"], e["dst"]) for e in edges] == [("p/m.py:a", "p/m.py:b"), ("p/m.py:a", "p/m.py:c")]
    assert code.parse_python("x.py", "def (") == ([], [])
    nodes, edges = code.parse_script("m.ts", "export function f(a) { g(a); g(b) }\nconst h = (x) => { f(x) }\n// function no() {}\n", "TypeScript")
    assert [(n["name"], n["exported"]) for n in nodes] == [("f", True), ("h", False)]
    assert [(e["src"], e["dst"]) for e in edges] == [("m.ts:f", "m.ts:g"), ("m.ts:h", "m.ts:f")]
    assert [(n["name"], n["exported"]) for n in code.parse_script("m.rs", "pub fn run(a: i32) -> i32 { go(a) }\nfn go(a: i32) {}\n", "Rust")[0]] == [("run", True), ("go", False)]


def test_graph_tables(spark, tmp_path):
    nodes, edges = code.parse_files(spark.createDataFrame([("a.py", "def f(): g()\ndef g(): pass"), ("b.txt", "f()"), ("c.py", None)], "path string, content string"))
    files.write_graph(nodes, edges, f"file://{tmp_path}/g")
    n, e = files.read_graph(spark, f"file://{tmp_path}/g")
    assert n.count() == 2 and e.count() == 1 and n.columns == nodes.columns


def test_vectors_and_scans(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(files.encode_vector([1.5, -2.0])), "x"), (2, bytearray(b"abc"), "x"), (3, None, "x")], "id long, embedding binary, t string")
    got = {r.id: r.embedding for r in files.decode_vectors(rows).collect()}
    assert got == {1: [1.5, -2.0], 2: None, 3: None}
    (tmp_path / "a.md").write_text("12345")
    (tmp_path / "b.txt").write_text("1")
    assert [(r.path.rsplit("/", 1)[1], r["size"]) for r in files.scan(spark, f"file://{tmp_path}", ("*.md",)).collect()] == [("a.md", 5)]


def test_config():
    assert files.load_config("") == files.Config()
    c = files.load_config("mode: full  # all\nstale_hours: 12\nexempt_paths: [a, b]\n")
    assert (c.mode, c.stale_hours, c.exempt_paths, c.trigger) == ("full", 12.0, ("a", "b"), {"processingTime": "300 seconds"})
    assert files.load_config('{"search_limit": 5}').search_limit == 5
    for bad in ("mode: odd", "colour: red"):
        with pytest.raises(ValueError):
            files.load_config(bad)


def test_pages(spark):
    def fetch(page):
        return {"total": 5, "items": [{"id": k, "name": f"r{k}"} for k in range((page - 1) * 2, min(5, page * 2))]}

    spark.dataSource.register(remote.paged("scores", fetch, "id int, name string", 2))
    df = spark.read.format("scores").load()
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4] and df.rdd.getNumPartitions() == 3


def test_pages_of_unknown_number(spark):
    spark.dataSource.register(remote.paged("more", lambda page: {"items": [{"id": page}], "has_more": page < 4}, "id int, name string"))
    df = spark.read.format("more").load()
    assert sorted(r.id for r in df.collect()) == [1, 2, 3, 4] and df.rdd.getNumPartitions() == 1


def test_payloads(spark):
    rows = spark.createDataFrame([(1, '{"files": [{"path": "a", "status": "resolved"}], "count": 1}'), (2, "no json"), (3, None)], "id long, text string")
    got = {r.id: r.p for r in rows.select("id", remote.payload(rows.text, "conflicts").alias("p")).collect()}
    assert got[1]["files"][0].path == "a" and got[1]["count"] == 1
    assert got[2]["files"] is None and got[3] is None
    for verb in remote.SCHEMAS:
        assert spark.createDataFrame([], remote.SCHEMAS[verb]).columns


def test_breaker_and_bucket():
    now = [0.0]
    b = remote.Breaker(2, 30, 2, clock=lambda: now[0])
    seen = []
    for t, ok in ((0, False), (1, False), (2, True), (40, True), (41, True), (42, False)):
        now[0] = t
        allowed = b.allow()
        if allowed:
            b.record(ok)
        seen.append((allowed, b.state))
    assert seen == [(True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed")]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = remote.Bucket(2.0, 2.0, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        bucket.wait()
    assert slept == [0.5, 0.5]


def test_failed_deliveries_fail_the_batch_and_the_breaker_holds_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, "x") for k in range(10)], "seq long, body string")

    def send(url, body, headers):
        with open(f"{tmp_path}/tries", "a") as f:
            f.write("t")
        return 503

    with pytest.raises(Exception, match="2 deliveries failed, 8 held back"):
        remote.webhook_sink(send, "https://good.example/x", threshold=4, attempts=2, delay=0.0, rate=1000)(rows, 0)
    assert (tmp_path / "tries").read_text() == "tttt"


def test_templates(spark, tmp_path):
    (tmp_path / "fix.yaml").write_text("id: 1\n")
    (tmp_path / "other.yml").write_text("a: b")
    (tmp_path / "empty.yml").write_text("")
    (tmp_path / "no.txt").write_text("x")
    assert {(r.name, r.text) for r in files.read_templates(spark, f"file://{tmp_path}").collect()} == {("fix", "id: 1\n"), ("other", "a: b")}


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("i/o timeout")
        return 7

    assert remote.retried(flaky, 3, 0) == 7
    with pytest.raises(ValueError):
        remote.retried(lambda: (_ for _ in ()).throw(ValueError("bad")), 3, 0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "ok")], "seq long, body string")
    assert remote.send_each(rows, lambda b: b == "ok" or 1 / 0) == (2, 1)
    with pytest.raises(ValueError, match="not allowed"):
        remote.webhook_sink(lambda u, b, h: 200, "https://evil.example/x", allowed=["good.example"])
    out = tmp_path / "sent"
    out.mkdir()

    def send(url, body, headers):
        with open(f"{out}/{hash(body)}", "wb") as f:
            f.write(body + headers["X-Signature"].encode())
        return 200

    remote.webhook_sink(send, "https://good.example/x", b"s")(rows, 0)
    assert len(list(out.iterdir())) == 3 and all(b"sha256=" in p.read_bytes() for p in out.iterdir())


def test_audit_chain(spark, tmp_path):
    from plumbline.operators.safety import verify_chain

    path = f"file://{tmp_path}/audit"
    rows = spark.createDataFrame([(k, f"e{k}") for k in range(5)], "seq long, entry string")
    first, rest = rows.where("seq < 3"), rows.where("seq >= 3")
    for batch_id, batch in ((0, first), (1, rows.where("seq > 9")), (2, rest), (2, rest)):  # an empty batch, and one that comes again
        remote.append_audit(batch, path, batch_id)
    got = verify_chain(spark.read.schema("log string, seq bigint, entry string, hash string").json(path)).collect()
    assert len(got) == 5 and all(r.valid for r in got)


def test_state_tables_keep_the_last_complete_version(spark, tmp_path):
    table = files.StateTable(spark, f"file://{tmp_path}/locks", "path string, agent_id string")
    assert table.load().collect() == []
    table.save(spark.createDataFrame([("a", "x")], table.schema))
    table.save(table.load().unionByName(spark.createDataFrame([("b", "y")], table.schema)))
    (tmp_path / "locks" / "v9").mkdir()  # broken off
    assert sorted(r.path for r in table.load().collect()) == ["a", "b"]
