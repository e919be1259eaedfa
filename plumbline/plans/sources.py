"""Queries of the sources and of the streaming forms, run over the tables as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import governance, metrics
from plumbline.plans.sequences import ORACLES as _BATCH
from plumbline.plans.tables import EDGES, NODES, frame
from plumbline.session import shared_dir
from plumbline.sources import code, files, remote
from plumbline.streaming import streams as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, view: str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, view))
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE v AS ({view}){sql}"


_PATHS = "SELECT p_partkey AS id, 'x/' || p_name || CASE p_type WHEN 'PROMO' THEN '.go' WHEN 'SMALL' THEN '.py' WHEN 'LARGE' THEN '.RS' WHEN 'MEDIUM' THEN '.tsx' ELSE '.txt' END AS path, p_name AS name, p_brand AS brand, p_type AS kind FROM part"
_add(
    "s05_languages",
    _PATHS,
    lambda v: v.select("id", code.language(F.col("path")).alias("language"), code.rule_language(F.col("path")).alias("rule_language")),
    " SELECT id, CASE kind WHEN 'SMALL' THEN 'Python' WHEN 'LARGE' THEN 'Rust' WHEN 'MEDIUM' THEN 'TypeScript' ELSE 'Unknown' END AS language, CASE kind WHEN 'PROMO' THEN 'go' WHEN 'SMALL' THEN 'python' ELSE 'unknown' END AS rule_language FROM v",
)
_add(
    "s06_exported",
    _PATHS,
    lambda v: v.select("id", code.exported(F.when(F.col("kind") == "PROMO", "Go").when(F.col("kind") == "SMALL", "Python").when(F.col("kind") == "LARGE", "Rust").otherwise("JavaScript"), F.col("brand"), F.concat(F.when(F.col("name").startswith("r"), "export ").otherwise("pub "), "name")).alias("exported")),
    " SELECT id, CASE WHEN kind IN ('PROMO', 'SMALL') THEN true WHEN kind = 'LARGE' THEN NOT starts_with(name, 'r') ELSE starts_with(name, 'r') END AS exported FROM v",
)
_CODE = """SELECT 'pkg' || s_nationkey || '/f' || s_suppkey || '.go' AS path, 'package p' || chr(10) || 'import "fmt"' || chr(10) || '// Old' || s_suppkey || '() is gone' || chr(10) || 'func (s *Store) Get' || s_suppkey || '(id int) error {' || chr(10) || '  fmt.Println("Call(")' || chr(10) || '  return helper' || s_suppkey || '(id)' || chr(10) || '}' || chr(10) || 'func helper' || s_suppkey || '(id int) error { return nil }' || chr(10) AS content, s_suppkey AS k, s_nationkey AS n FROM supplier"""
_add(
    "s02_go_nodes",
    _CODE,
    lambda v: code.parse_files(v)[0].select("id", "name", "package", "line", "kind", "receiver", "exported"),
    " SELECT 'pkg' || n || '.Store.Get' || k AS id, 'Get' || k AS name, 'pkg' || n AS package, 4::BIGINT AS line, 'method' AS kind, 'Store' AS receiver, true AS exported FROM v UNION ALL SELECT 'pkg' || n || '.helper' || k, 'helper' || k, 'pkg' || n, 8, 'function', '', false FROM v",
)
_add("s02_go_edges", _CODE, lambda v: code.parse_files(v)[1], " SELECT 'pkg' || n || '.Store.Get' || k AS src, 'fmt.Println' AS dst, 'direct' AS call_type FROM v UNION ALL SELECT 'pkg' || n || '.Store.Get' || k, 'pkg' || n || '.helper' || k, 'direct' FROM v")
_add(
    "s01_packages",
    _CODE,
    lambda v: code.packages(v).select("name", "path", F.array_join("files", ",").alias("files"), F.array_join("imports", ",").alias("imports")),
    " SELECT 'p' AS name, 'pkg' || n AS path, string_agg(path, ',' ORDER BY path) AS files, 'fmt' AS imports FROM v GROUP BY n",
)
_add(
    "s04_python_nodes",
    "SELECT 'm' || n_regionkey || '/n' || n_nationkey || '.py' AS path, 'def run(a, b=1):' || chr(10) || '    return _help(a)' || chr(10) || chr(10) || 'def _help(a):' || chr(10) || '    return len(str(a))' || chr(10) AS content FROM nation",
    lambda v: code.parse_files(v)[0].select("id", "line", "exported", "signature"),
    " SELECT path || ':run' AS id, 1::BIGINT AS line, true AS exported, '(a, b=1)' AS signature FROM v UNION ALL SELECT path || ':_help', 4, false, '(a)' FROM v",
)
_FOUND = "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/.git/' WHEN 2 THEN 'web/node_modules/x/' WHEN 3 THEN '__pycache__/' WHEN 4 THEN 'src/vendors/' ELSE '' END || replace(p_name, ' ', '/') || CASE p_type WHEN 'PROMO' THEN '.rs' WHEN 'SMALL' THEN '.py' ELSE '.txt' END AS path, p_size, p_type FROM part"
_add(
    "s03_discovery",
    _FOUND,
    lambda v: v.where(code.discoverable(F.col("path")) & (code.language(F.col("path")) != "Unknown")).select("id", code.language(F.col("path")).alias("language")),
    " SELECT id, CASE p_type WHEN 'PROMO' THEN 'Rust' ELSE 'Python' END AS language FROM v WHERE p_type IN ('PROMO', 'SMALL') AND p_size % 6 IN (4, 5)",
)
_RUST = "SELECT 'm/r' || s_suppkey || '.rs' AS path, 'pub fn run(a: i32) -> i32 {' || chr(10) || '    helper(a) // gone(a)' || chr(10) || '}' || chr(10) || 'fn helper' || '(a: i32) -> i32 { a }' || chr(10) AS content FROM supplier"
_add("s04_rust_nodes", _RUST, lambda v: code.parse_files(v)[0].select("id", "package", "line", "exported", "signature"), " SELECT path || ':run' AS id, 'm' AS package, 1::BIGINT AS line, true AS exported, '(a: i32)' AS signature FROM v UNION ALL SELECT path || ':helper', 'm', 4, false, '(a: i32)' FROM v")
_add("s04_rust_edges", _RUST, lambda v: code.parse_files(v)[1], " SELECT path || ':run' AS src, path || ':helper' AS dst, 'direct' AS call_type FROM v")
_SCRIPT = "SELECT 'w/t' || s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN '.ts' ELSE '.jsx' END AS path, 'export async function load(u) {' || chr(10) || '  /* gone(u) */ return get(u)' || chr(10) || '}' || chr(10) || 'const get = async (u) => { fetch(u); log(\"x(\") }' || chr(10) AS content FROM supplier"
_add("s04_script_nodes", _SCRIPT, lambda v: code.parse_files(v)[0].select("id", "line", "exported", "signature"), " SELECT path || ':load' AS id, 1::BIGINT AS line, true AS exported, '(u)' AS signature FROM v UNION ALL SELECT path || ':get', 4, false, '(u)' FROM v")
_add("s04_script_edges", _SCRIPT, lambda v: code.parse_files(v)[1], " SELECT path || ':load' AS src, path || ':get' AS dst, 'direct' AS call_type FROM v UNION ALL SELECT path || ':get', path || ':fetch', 'direct' FROM v UNION ALL SELECT path || ':get', path || ':log', 'direct' FROM v")
_add(
    "s20_accessors",
    "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size, '---' || chr(10) || 'title: \"' || p_name || '\"' || chr(10) || 'owner: ' || p_name || chr(10) || 'count: ' || p_size || chr(10) || 'tags: [a, ' || p_size || ', ' || p_brand || ']' || chr(10) || 'roles:' || chr(10) || '  - ' || p_name || chr(10) || '  - true' || chr(10) || '---' || chr(10) || 'text' AS content FROM part",
    lambda v: v.select("id", governance.front_matter(F.col("content")).alias("m")).select("id", *[governance.scalar(F.col("m"), k).alias(k) for k in ("title", "owner", "count", "none")], *[F.array_join(governance.string_list(F.col("m"), k), ";").alias(k) for k in ("tags", "roles")], F.array_join(governance.keys(F.col("m")), ";").alias("keys")),
    " SELECT id, name AS title, name AS owner, NULL::VARCHAR AS count, NULL::VARCHAR AS none, 'a;' || brand AS tags, name AS roles, 'title;owner;count;tags;roles' AS keys FROM v",
)
_add(
    "q01_resolve_edges",
    _CODE,
    lambda v: code.resolve_edges(code.parse_files(v)[0], code.parse_files(v)[1].withColumn("dst", F.substring_index("dst", ".", -1))).select("src", "dst"),
    " SELECT 'pkg' || n || '.Store.Get' || k AS src, 'Println' AS dst FROM v UNION ALL SELECT 'pkg' || n || '.Store.Get' || k, 'pkg' || n || '.helper' || k FROM v",
)


def _s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = frame(spark, sf_dir, "SELECT vec_id, embedding FROM embeddings")
    back = files.decode_vectors(files.encode_vectors(vectors))
    return back.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


QUERIES["s11_vector_blobs"] = _s11
ORACLES["s11_vector_blobs"] = "SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"
_add("s18_base_name_filter", _PATHS, lambda v: v.where(files.base_name_filter(F.col("path"), ("*.go", "*.py"), ("red*",))).select("id"), " SELECT id FROM v WHERE kind IN ('PROMO', 'SMALL') AND NOT starts_with(name, 'red')")
_add(
    "s24_envelope",
    """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'plain text' WHEN 'view' THEN '{"data": {"k": ' || user_id || '}}' ELSE '{"staleness": {"data_age_hours": 5.5, "warnings": ["old"]}, "data": {"k": ' || user_id || '}}' END AS text, user_id, event_type FROM events""",
    lambda v: v.select("id", remote.envelope(F.col("text"), "struct<k:bigint>").alias("e")).select("id", "e.age_hours", F.array_join("e.warnings", ",").alias("warnings"), "e.data.k", "e.raw"),
    " SELECT id, CASE WHEN event_type NOT IN ('error', 'view') THEN 5.5::DOUBLE END AS age_hours, CASE WHEN event_type NOT IN ('error', 'view') THEN 'old' END AS warnings, CASE WHEN event_type <> 'error' THEN user_id END AS k, CASE WHEN event_type = 'error' THEN text END AS raw FROM v",
)
def _pages(form: str) -> Callable[[SparkSession, str], DataFrame]:
    """Nations as the pages of a service that tells the total, or only whether there are more."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = [r.asDict() for r in frame(spark, sf_dir, "SELECT n_nationkey AS id, n_name AS name FROM nation").orderBy("id").collect()]

        def fetch(page: int) -> dict:
            return {"items": items[page * 7 - 7 : page * 7]} | ({"total": len(items)} if form == "total" else {"has_more": page * 7 < len(items)})

        spark.dataSource.register(remote.paged(f"nations_{form}", fetch, "id int, name string", 7))
        return spark.read.format(f"nations_{form}").load()

    return run


for _form in ("total", "more"):
    QUERIES[f"s23_pages_{_form}"] = _pages(_form)
    ORACLES[f"s23_pages_{_form}"] = "SELECT n_nationkey AS id, n_name AS name FROM nation"
_add(
    "s25_remote_payloads",
    "SELECT event_id AS id, event_type, value, user_id, CASE event_type WHEN 'error' THEN 'no json' ELSE '{\"passed\": ' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END || ', \"score\": 0.5, \"checks\": [{\"name\": \"c' || user_id || '\", \"passed\": false, \"severity\": \"error\"}], \"total_checks\": ' || user_id || ', \"other\": 1}' END AS text FROM events",
    lambda v: v.select("id", remote.payload(F.col("text"), "compliance").alias("p")).select("id", "p.passed", "p.score", F.col("p.checks")[0]["name"].alias("name"), F.col("p.checks")[0]["message"].alias("message"), "p.total_checks", "p.failed_checks"),
    " SELECT id, CASE WHEN event_type <> 'error' THEN value > 50 END AS passed, CASE WHEN event_type <> 'error' THEN 0.5::DOUBLE END AS score, CASE WHEN event_type <> 'error' THEN 'c' || user_id END AS name, NULL::VARCHAR AS message, CASE WHEN event_type <> 'error' THEN user_id END AS total_checks, NULL::BIGINT AS failed_checks FROM v",
)


def _s26(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/audit"
    entries = frame(spark, sf_dir, "SELECT c_custkey AS seq, c_name AS entry FROM customer")
    first, second = entries.where("seq < 50"), entries.where("seq >= 50")
    for batch_id, batch in ((0, first), (1, second), (1, second), (2, entries.where("seq < 0"))):  # the second comes again, the last is empty
        remote.append_audit(batch, path, batch_id)
    return spark.read.schema("seq bigint, hash string").json(path).select("seq", "hash")


QUERIES["s26_audit_chain"] = _s26
ORACLES["s26_audit_chain"] = "WITH RECURSIVE o AS (SELECT c_custkey AS seq, c_name AS entry, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), w AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS seq, '' AS hash UNION ALL SELECT o.k, o.seq, sha256(w.hash || o.entry) FROM w JOIN o ON o.k = w.k + 1) SELECT seq, hash FROM w WHERE k > 0"


def _s30(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = files.StateTable(spark, f"{shared_dir(spark)}/locks", "path string, agent_id string")
    held = frame(spark, sf_dir, "SELECT 'f' || o_orderkey AS path, 'a' || o_custkey AS agent_id, o_orderstatus AS s FROM orders")
    locks.save(held.where("s = 'F'").select("path", "agent_id"))
    locks.save(locks.load().unionByName(held.where("s = 'O'").select("path", "agent_id")))
    return locks.load()


QUERIES["s30_state_table"] = _s30
ORACLES["s30_state_table"] = "SELECT 'f' || o_orderkey AS path, 'a' || o_custkey AS agent_id FROM orders WHERE o_orderstatus IN ('F', 'O')"


def _s31(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, of = f"{shared_dir(spark)}/templates", spark._jvm.org.apache.hadoop.fs.Path
    fs = of(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in frame(spark, sf_dir, "SELECT r_regionkey AS k, r_name AS name FROM region").collect():
        out = fs.create(of(f"{root}/{r.name}.{('yaml', 'yml', 'txt')[r.k % 3]}"))
        out.write(bytearray(f"id: {r.k}\nsteps:\n  - look\n".encode()))
        out.close()
    return files.read_templates(spark, root)


QUERIES["s31_templates"] = _s31
ORACLES["s31_templates"] = "SELECT r_name AS name, 'id: ' || r_regionkey || chr(10) || 'steps:' || chr(10) || '  - look' || chr(10) AS text FROM region WHERE r_regionkey % 3 <> 2"


def _s32(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [(r.k, files.load_config(f"# {r.name}\nmode: {('light', 'full')[r.k % 2]}\nsearch_limit: {r.k}  # own\n")) for r in frame(spark, sf_dir, "SELECT r_regionkey AS k, r_name AS name FROM region").collect()]
    return spark.createDataFrame([(k, c.mode, c.search_limit, c.stale_hours, next(iter(c.trigger))) for k, c in texts], "id bigint, mode string, search_limit bigint, stale_hours double, trigger string")


QUERIES["s32_config"] = _s32
ORACLES["s32_config"] = "SELECT r_regionkey AS id, CASE r_regionkey % 2 WHEN 0 THEN 'light' ELSE 'full' END AS mode, r_regionkey AS search_limit, 24::DOUBLE AS stale_hours, CASE r_regionkey % 2 WHEN 0 THEN 'availableNow' ELSE 'processingTime' END AS trigger FROM region"
_TOOLS = "SELECT event_type AS tool, CASE WHEN value > 90 THEN 'error' ELSE 'ok' END AS status, value / 20 AS seconds FROM events"
_add("s33_tool_calls", _TOOLS, lambda v: metrics.counters(v, "tool", "status"), " SELECT tool, status, count(*) AS n FROM v GROUP BY ALL")
_add(
    "s33_tool_latency",
    _TOOLS,
    lambda v: metrics.histogram(v, "seconds", "tool"),
    " SELECT tool, le, count(*) FILTER (seconds <= bound) AS n FROM v, (VALUES (0.005::DOUBLE, '0.005'), (0.01, '0.01'), (0.025, '0.025'), (0.05, '0.05'), (0.1, '0.1'), (0.25, '0.25'), (0.5, '0.5'), (1, '1'), (2.5, '2.5'), (5, '5'), (10, '10'), ('inf'::DOUBLE, '+Inf')) AS b(bound, le) GROUP BY ALL",
)
QUERIES["s33_graph_gauges"] = lambda spark, sf_dir: metrics.graph_gauges(frame(spark, sf_dir, NODES), frame(spark, sf_dir, EDGES))
ORACLES["s33_graph_gauges"] = f"SELECT 'graph_nodes_total' AS gauge, count(*)::DOUBLE AS value FROM ({NODES}) UNION ALL SELECT 'graph_edges_total', count(*) FROM ({EDGES})"
_add(
    "s28_finding_payloads",
    "SELECT event_id AS seq, event_type AS rule_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'note' END AS severity, props AS message, 'f' AS file, user_id AS line, 'fp' || event_id AS fingerprint FROM events",
    lambda v: remote.finding_payloads(v).select("seq", F.get_json_object("body", "$.severity").alias("severity"), F.get_json_object("body", "$.unique_id_from_tool").alias("uid")),
    " SELECT seq, CASE severity WHEN 'error' THEN 'High' ELSE 'Low' END AS severity, fingerprint AS uid FROM v",
)
_add(
    "s29_review_comments",
    "SELECT user_id AS number, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'note' ELSE 'warning' END AS severity, 'f' || event_type AS file, event_id AS line, props AS message FROM events",
    lambda v: remote.comment_bodies(v),
    " SELECT number, count(*) || ' findings' || chr(10) || string_agg('- **' || severity || '** `' || file || ':' || line || '` ' || message, chr(10) ORDER BY CASE severity WHEN 'error' THEN -4 WHEN 'warning' THEN -3 ELSE -2 END, file, line) AS body FROM v GROUP BY number",
)


def _run(stream: DataFrame, root: str) -> DataFrame:
    """The rows that a stream yields of what is there, by way of a checkpointed file sink."""
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def _w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of changes by event type, one file a micro-batch: each is one rebuild, however many changes it holds."""
    root = shared_dir(spark)
    changes = frame(spark, sf_dir, "SELECT event_id AS id, event_type FROM events")
    changes.repartition("event_type").write.partitionBy("event_type").json(f"{root}/in")

    def rebuild(session: SparkSession) -> None:
        session.range(1).write.mode("append").parquet(f"{root}/rebuilds")

    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).json(f"{root}/in")
    st.rebuild_on_change(stream, rebuild, f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.schema("id bigint").parquet(f"{root}/rebuilds").agg(F.count("*").alias("rebuilds"))


QUERIES["w04_rebuilds"] = _w04
ORACLES["w04_rebuilds"] = "SELECT count(DISTINCT event_type) AS rebuilds FROM events"


def _with_state(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run`` with the state store that keyed state needs."""
    before = {k: spark.conf.get(k, None) for k in st.STATE_STORE}
    for k, v in st.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark)
    events = frame(spark, sf_dir, "SELECT ts AS `timestamp`, event_type, 'p' AS provider, 'c' || user_id AS connection_id, 'r' || event_id AS repo_id, event_id AS k FROM events")
    lines = events.select(F.when(F.col("event_type") == "view", F.lit("{ not json")).otherwise(F.to_json(F.struct("timestamp", "event_type", "provider", "connection_id", "repo_id"))).alias("value"))
    lines.unionByName(lines).write.text(f"{root}/in")  # everything is delivered twice
    return _run(st.once(st.audit_stream(spark, f"{root}/in", since="2024-01-10 00:00:00"), "60 days"), root).select("event_type", "connection_id", "repo_id")


QUERIES["s21_s22_audit_stream"] = _s21
ORACLES["s21_s22_audit_stream"] = "SELECT event_type, 'c' || user_id AS connection_id, 'r' || event_id AS repo_id FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-10 00:00:00'"


def _stateful(name: str, batch: str, view: str, schema: str, run: Callable[[DataFrame], DataFrame], pick: Callable[[DataFrame], DataFrame]) -> None:
    """A streaming form over the view's rows as one file, which the batch form's SQL must equal."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = shared_dir(spark)
        frame(spark, sf_dir, view).write.json(f"{root}/in")
        return _with_state(spark, lambda: pick(_run(run(spark.readStream.schema(schema).json(f"{root}/in")), root)))

    QUERIES[name] = query
    ORACLES[name] = _BATCH[batch]


_stateful(
    "w05_drift_stream",
    "w05_ewma_drift",
    "SELECT 'u' || user_id AS key, event_id AS seq, ts, value / 300 AS score FROM events",
    "key string, seq bigint, ts timestamp_ntz, score double",
    st.drift_stream,
    lambda d: d.select("key", "seq", F.round("ewma", 6).alias("ewma"), F.round("drift", 6).alias("drift"), "alert"),
)
_stateful(
    "w08_state_stream",
    "w08_state_machine",
    "SELECT 'u' || user_id AS key, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'idle' WHEN 'error' THEN 'fixing' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'working' ELSE 'handoff' END AS to_state FROM events",
    "key string, seq bigint, ts timestamp_ntz, to_state string",
    st.state_stream,
    lambda d: d,
)
