"""Queries of the search and memory operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import memory as me
from plumbline.operators import search as se
from plumbline.plans.tables import EDGES, NODES, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SHORT = "split_part(name, '.', -1)"
_WITH = f"""WITH RECURSIVE edges AS ({EDGES}), nodes AS ({NODES}),
deg AS (SELECT id, coalesce(a, 0)::BIGINT AS callers, coalesce(b, 0)::BIGINT AS callees FROM nodes
  LEFT JOIN (SELECT dst, count(*) AS a FROM edges GROUP BY dst) ON id = dst LEFT JOIN (SELECT src, count(*) AS b FROM edges GROUP BY src) ON id = src)"""


def _query(name: str, run: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, NODES), frame(spark, sf_dir, EDGES))
    ORACLES[name] = _WITH + sql


def _tri(c: str) -> str:
    return f"CASE WHEN length({c}) < 3 THEN [lower({c})] ELSE list_transform(range(1, length({c}) - 1), lambda i: substr(lower({c}), i, 3)) END"


def _fuzzy(query: str, source: str) -> str:
    q = query.lower()
    grams = [q[i : i + 3] for i in range(len(q) - 2)] or [q]
    hits = " + ".join(f"list_contains({_tri('name')}, '{t}')::INT" for t in grams)
    return f""", sim AS (SELECT name, {hits} AS overlap, len({_tri('name')}) AS c FROM (SELECT DISTINCT name FROM ({source}))),
fuzzy AS (SELECT name, score, CASE WHEN lower(name) = '{q}' THEN 'exact' WHEN starts_with(lower(name), '{q}') THEN 'prefix' WHEN contains(lower(name), '{q}') THEN 'substring' ELSE 'fuzzy' END AS match
  FROM (SELECT *, 0.7::DOUBLE * (1 - levenshtein('{q}', lower(name)) / greatest({len(q)}, length(name))) + 0.3::DOUBLE * (overlap / ({len(grams)} + c - overlap)) AS score FROM sim WHERE overlap > 0) WHERE score >= 0.3)"""


def _ranked(matched: str, order: str = "") -> str:
    return f""" SELECT id, name, kind, match, round(least(greatest(0.4::DOUBLE * base + 0.25::DOUBLE * least(callers / 100.0::DOUBLE, 1) + CASE WHEN kind IN ('function', 'method') AND regexp_matches(name, '^[A-Z]') THEN 0.15::DOUBLE ELSE 0 END
  + 0.1::DOUBLE * CASE kind WHEN 'function' THEN 1 WHEN 'method' THEN 0.8::DOUBLE WHEN 'type' THEN 0.6::DOUBLE WHEN 'package' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + CASE match WHEN 'exact' THEN 0.1::DOUBLE WHEN 'prefix' THEN 0.05::DOUBLE ELSE 0 END, 0), 1), 6) AS score, callers, callees
  FROM ({matched}) JOIN nodes USING (id) JOIN deg USING (id) {order}"""


QUERIES["n01_trigrams"] = lambda spark, sf_dir: frame(spark, sf_dir, NODES).select("id", F.array_join(tx.trigrams(F.col("name")), "~").alias("trigrams"))
ORACLES["n01_trigrams"] = _WITH + f" SELECT id, array_to_string({_tri('name')}, '~') AS trigrams FROM nodes"
_NAMES = "SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer"
QUERIES["n02_n05_fuzzy_names"] = lambda spark, sf_dir: se.fuzzy(frame(spark, sf_dir, _NAMES), "red wigdet").withColumn("score", F.round("score", 6))
ORACLES["n02_n05_fuzzy_names"] = f"WITH x AS (SELECT 1)" + _fuzzy("red wigdet", _NAMES) + " SELECT name, round(score, 6) AS score, match FROM fuzzy"
QUERIES["n04_levenshtein"] = lambda spark, sf_dir: frame(spark, sf_dir, _NAMES).select("name", F.levenshtein(F.lit("blue gadget"), "name").cast("long").alias("distance"))
ORACLES["n04_levenshtein"] = f"SELECT name, levenshtein('blue gadget', name) AS distance FROM ({_NAMES})"
_RESOLVED = f", hits AS (SELECT id, fuzzy.score, fuzzy.match FROM nodes JOIN fuzzy ON fuzzy.name = nodes.name OR fuzzy.name = {_SHORT.replace('name', 'nodes.name')}), best AS (SELECT id, max(score) AS base, max_by(match, (score, match)) AS match FROM hits GROUP BY id)"
_query("n08_search_fuzzy", lambda n, e: se.search_fuzzy(n, e, "Deliver1"), _fuzzy("Deliver1", f"SELECT name FROM nodes UNION SELECT {_SHORT} FROM nodes") + _RESOLVED + _ranked("SELECT * FROM best"))
_query("n07_resolve_names", lambda n, e: se.resolve(n, se.fuzzy(n, "supplier.deliver1")).withColumn("base", F.round("base", 6)), _fuzzy("supplier.deliver1", "SELECT name FROM nodes") + _RESOLVED + " SELECT id, round(base, 6) AS base, match FROM best")
_query("n09_search_regex", lambda n, e: se.search_regex(n, e, r"^Brand1\..*ring$|\bGet1\d\b"), _ranked(rf"SELECT id, 1 AS base, 'regex' AS match FROM nodes WHERE regexp_matches(name, '^Brand1\..*ring$|\bGet1\d\b') OR regexp_matches({_SHORT}, '^Brand1\..*ring$|\bGet1\d\b')"))
_STEP = ", step AS (SELECT DISTINCT src, dst FROM edges), up AS (SELECT 'N:3' AS id, 0 AS d UNION SELECT src, d + 1 FROM up JOIN step ON dst = id WHERE d < 10), down AS (SELECT 'P:7' AS id, 0 AS d UNION SELECT dst, d + 1 FROM down JOIN step ON src = id WHERE d < 10)"
_query("n10_search_callers", lambda n, e: se.search_neighbours(n, e, "N:3", True), _STEP + " SELECT id, name, kind, 'caller' AS match, 1.0::DOUBLE AS score FROM nodes WHERE id IN (SELECT id FROM up WHERE d > 0)")
_query("n10_search_callees", lambda n, e: se.search_neighbours(n, e, "P:7", False), _STEP + " SELECT id, name, kind, 'callee' AS match, 1.0::DOUBLE AS score FROM nodes WHERE id IN (SELECT id FROM down WHERE d > 0)")
_query("n11_search_types", lambda n, e: se.search_types(n, ["int"], "Customer"), " SELECT id, name, kind, 'type' AS match, 0.8::DOUBLE AS score FROM nodes WHERE signature = 'func(id int, name string) (Customer, error)'")
_query(
    "n12_n13_signature_types",
    lambda n, e: n.select("id", F.array_join(se.parameter_types(F.col("signature")), ";").alias("params"), F.array_join(se.return_types(F.col("signature")), ";").alias("returns")),
    """ SELECT id, CASE substr(id, 1, 1) WHEN 'N' THEN '' WHEN 'C' THEN 'int;string' WHEN 'S' THEN CASE WHEN contains(signature, 'http') THEN 'http.ResponseWriter;*http.Request' ELSE 'float64' END ELSE 'int;string' END AS params,
    CASE substr(id, 1, 1) WHEN 'C' THEN 'Customer;error' WHEN 'S' THEN CASE WHEN contains(signature, 'http') THEN '' ELSE 'error' END ELSE '' END AS returns FROM nodes""",
)
_RANKED = "SELECT p_partkey AS id, p_retailprice / 2000 AS score, CASE p_type WHEN 'PROMO' THEN 'exact' WHEN 'SMALL' THEN 'prefix' ELSE 'fuzzy' END AS match, CAST(p_size * 3 AS BIGINT) AS fan_in, CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'type' WHEN 3 THEN 'package' ELSE 'field' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS name FROM part"
QUERIES["n06_rank"] = lambda spark, sf_dir: frame(spark, sf_dir, _RANKED).select("id", F.round(se.rank(F.col("score"), F.col("match"), F.col("fan_in"), F.col("kind"), F.col("name")), 6).alias("rank"))
ORACLES["n06_rank"] = f"""WITH v AS ({_RANKED}) SELECT id, round(greatest(0, least(1, 0.4::DOUBLE * score + 0.25::DOUBLE * least(fan_in / 100, 1) + CASE WHEN kind IN ('function', 'method') AND name[1] BETWEEN 'A' AND 'Z' THEN 0.15::DOUBLE ELSE 0 END
  + 0.1::DOUBLE * CASE kind WHEN 'function' THEN 1 WHEN 'method' THEN 0.8::DOUBLE WHEN 'type' THEN 0.6::DOUBLE WHEN 'package' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + CASE match WHEN 'exact' THEN 0.1::DOUBLE WHEN 'prefix' THEN 0.05::DOUBLE ELSE 0 END)), 6) AS rank FROM v"""
_query("n14_search_exact", lambda n, e: se.search_exact(n, e, "Deliver3"), _ranked(f"SELECT id, 1 AS base, 'exact' AS match FROM nodes WHERE name = 'Deliver3' OR {_SHORT} = 'Deliver3'"))
_query("n14_search_prefix", lambda n, e: se.search_prefix(n, e, "GET12"), _ranked(f"SELECT id, 1 AS base, 'prefix' AS match FROM nodes WHERE starts_with(lower(name), 'get12') OR starts_with(lower({_SHORT}), 'get12')"))
_query("n14_search_substring", lambda n, e: se.search_substring(n, e, "NATION_1"), _ranked("SELECT id, 1 AS base, 'substring' AS match FROM nodes WHERE contains(name, 'NATION_1')"))
_query("n14_search_kind", lambda n, e: se.search_kind(n, e, "type"), _ranked("SELECT id, 1 AS base, 'kind' AS match FROM nodes WHERE kind = 'type'"))
_query(
    "n15_search_dispatch",
    lambda n, e: se.search(n, e, pattern="Deliver", mode="prefix", kind="method", limit=20),
    _ranked(f"SELECT id, 1 AS base, 'prefix' AS match FROM nodes WHERE (starts_with(lower(name), 'deliver') OR starts_with(lower({_SHORT}), 'deliver')) AND kind = 'method'", "ORDER BY score DESC, id LIMIT 20"),
)
_query("n17_short_names", lambda n, e: n.select("id", se.g.short_name(F.col("name")).alias("short")), f" SELECT id, {_SHORT} AS short FROM nodes")

# memory
AS_OF = "2001-08-01 00:00:00"
_ENTITIES = """
SELECT 'd' || doc_id AS id, source AS type, text AS content, lang AS project, SPLIT(lang || ',' || label, ',') AS tags, CAST(o_orderdate AS {ts}) AS created_at, CAST(o_orderdate AS {ts}) AS updated_at,
       CAST(n_chars % 7 AS BIGINT) AS access_count, CAST(n_chars % 100 AS DOUBLE) / 100 AS decay_score, embedding
FROM documents JOIN embeddings ON doc_id = vec_id JOIN orders ON o_orderkey = doc_id
"""
_RELATIONSHIPS = """
SELECT 'd' || doc_id AS source_id, 'd' || next_id AS target_id, 'next' AS kind, 1 / (1 + CAST(abs(n_chars - next_chars) AS DOUBLE) / 1000) AS weight
FROM (SELECT doc_id, n_chars, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id, lead(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS next_chars FROM documents) AS x WHERE next_id IS NOT NULL
"""
_E_SPARK = _ENTITIES.replace("{ts}", "timestamp_ntz")
_MWITH = f"WITH RECURSIVE e AS ({_ENTITIES.replace('{ts}', 'TIMESTAMP').replace('SPLIT(', 'string_split(')}), r AS ({_RELATIONSHIPS}), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").first()["embedding"])


def _memory(name: str, run: Callable[..., DataFrame], sql: str) -> None:
    """``run(entities, relationships, vector)``."""
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, _E_SPARK), frame(spark, sf_dir, _RELATIONSHIPS), _vector(spark, sf_dir))
    ORACLES[name] = _MWITH + sql


_memory("m01_listing", lambda e, r, v: me.listing(e, ["src0", "src1"], ["en"], ["en"], 30, 5).select("id", "updated_at"), " SELECT id, updated_at FROM e WHERE type IN ('src0', 'src1') AND project = 'en' ORDER BY updated_at DESC, id LIMIT 30 OFFSET 5")
_memory("m02_text_candidates", lambda e, r, v: me.text_candidates(e, "THE the").select("id"), " SELECT id FROM e WHERE contains(lower(content), 'the the')")
_memory("m03_text_score", lambda e, r, v: e.select("id", F.round(me.text_score(F.col("content"), " the "), 6).alias("score")), " SELECT id, round(least((strlen(content) - strlen(replace(content, ' the ', ''))) / 5 / (strlen(content) // 100 + 1), 1), 6) AS score FROM e")
_memory("m04_of_project", lambda e, r, v: me.of_project(e, "de", 25).select("id", "decay_score"), " SELECT id, decay_score FROM e WHERE project = 'de' ORDER BY decay_score DESC, updated_at DESC, id LIMIT 25")
_COS = "list_cosine_similarity(embedding::DOUBLE[], v)"
_memory("m05_cosine", lambda e, r, v: e.select("id", F.round(me.cosine(F.col("embedding"), v), 6).alias("score")), f" SELECT id, round({_COS}, 6) AS score FROM e, q")
_memory("m06_nearest", lambda e, r, v: me.nearest(e, v, 30).select("id", F.round("score", 6).alias("score")), f" SELECT id, round({_COS}, 6) AS score FROM e, q ORDER BY {_COS} DESC, id LIMIT 30")
_VEC = f", n AS (SELECT e.*, {_COS} AS s FROM e, q ORDER BY s DESC, id LIMIT 30), vec AS (SELECT id, s * 0.5 AS score, 'vector' AS source FROM n WHERE s >= 0)"
_memory("m07_vector_leg", lambda e, r, v: me.vector_leg(e, v, projects=["en"]).select("id", F.round("score", 6).alias("score"), "source"), _VEC + " SELECT id, round(score, 6) AS score, source FROM vec JOIN e USING (id) WHERE project = 'en'")
_TXT = ", txt AS (SELECT id, 0.3 * least((strlen(content) - strlen(replace(content, 'the the', ''))) / 7 / (strlen(content) // 100 + 1), 1) AS score, 'text' AS source FROM e WHERE contains(lower(content), 'the the'))"
_memory("m08_text_leg", lambda e, r, v: me.text_leg(e, "the the").select("id", F.round("score", 6).alias("score"), "source"), _TXT + " SELECT id, round(score, 6) AS score, source FROM txt")
_GRAPH = """, seeds AS (SELECT id FROM vec ORDER BY score DESC, id LIMIT 5),
h1 AS (SELECT target_id AS id, max(weight * 0.8) AS a, min_by(source_id, (-weight * 0.8, source_id)) AS seed FROM r JOIN seeds ON source_id = seeds.id WHERE target_id NOT IN (SELECT id FROM seeds) GROUP BY target_id),
h2 AS (SELECT target_id AS id, max(a * weight * 0.8) AS a, min_by(seed, (-a * weight * 0.8, seed)) AS seed FROM r JOIN h1 ON source_id = h1.id WHERE a >= 0.1 AND target_id NOT IN (SELECT id FROM seeds UNION SELECT id FROM h1) GROUP BY target_id),
gra AS (SELECT id, a * 0.2 AS score, 'graph' AS source, seed FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE id IN (SELECT id FROM e))"""
_memory(
    "m09_graph_leg",
    lambda e, r, v: me.graph_leg(e, r, me.vector_leg(e, v).orderBy(F.desc("score"), "id").limit(5).select("id")).withColumn("score", F.round("score", 6)),
    _VEC + _GRAPH + " SELECT id, round(score, 6) AS score, source, seed FROM gra",
)
_memory(
    "m10_hybrid",
    lambda e, r, v: me.hybrid(e, r, "the the", v, limit=20).withColumn("score", F.round("score", 6)),
    _VEC + _TXT + _GRAPH + " SELECT id, round(max(score), 6) AS score, min_by(source, (-score, source)) AS source FROM (SELECT * FROM vec UNION ALL SELECT * FROM txt UNION ALL SELECT id, score, source FROM gra) GROUP BY id ORDER BY max(score) DESC, id LIMIT 20",
)
_memory("m11_filters", lambda e, r, v: e.where(me.matches(["src1", "src2"], ["en", "de"], ["de"])).select("id"), " SELECT id FROM e WHERE type IN ('src1', 'src2') AND project = 'de'")
_DAYS = f"(date_diff('second', updated_at, TIMESTAMP '{AS_OF}') / 86400.0::DOUBLE)"
_RET = f"least(greatest(exp(-{_DAYS} / (1 + 0.5::DOUBLE * access_count)), 0), 1)"
_memory("m12_retention", lambda e, r, v: e.select("id", F.round(me.retention(me.days_between(F.col("updated_at"), AS_OF), F.col("access_count")), 6).alias("retention")), f" SELECT id, round({_RET}, 6) AS retention FROM e")
_memory(
    "m13_decay",
    lambda e, r, v: me.decay(e, AS_OF).select("id", F.round("decay_score", 6).alias("decay_score"), "updated_at"),
    f" SELECT id, round(CASE WHEN abs({_RET} - decay_score) > 0.01 THEN {_RET} ELSE decay_score END, 6) AS decay_score, CASE WHEN abs({_RET} - decay_score) > 0.01 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM e",
)
_memory(
    "m14_accessed",
    lambda e, r, v: me.accessed(e, AS_OF).select("id", "access_count", F.round("decay_score", 6).alias("decay_score")),
    f" SELECT id, access_count, round(least({_RET} * (1 + 0.1::DOUBLE * ln(1 + access_count)), 1), 6) AS decay_score FROM (SELECT * REPLACE (access_count + 1 AS access_count) FROM e)",
)
_memory("m15_prune", lambda e, r, v: me.prune(e, 0.25).select("id"), " SELECT id FROM e WHERE decay_score >= 0.25")
_memory("m16_decay_stats", lambda e, r, v: me.decay_stats(e).withColumn("avg", F.round("avg", 6)), " SELECT count(*) AS n, round(avg(decay_score), 6) AS avg, min(decay_score) AS min, max(decay_score) AS max FROM e")
_memory("m17_stats", lambda e, r, v: me.stats(e).withColumn("avg_decay", F.round("avg_decay", 6)), " SELECT type, count(*) AS n, round(avg(decay_score), 6) AS avg_decay, min(created_at) AS oldest, max(updated_at) AS newest FROM e GROUP BY ROLLUP (type)")
_memory("m18_relationships", lambda e, r, v: me.relationships_of(r, "d21").select("source_id", "target_id"), " SELECT source_id, target_id FROM r WHERE source_id = 'd21' OR target_id = 'd21'")
_memory(
    "m19_traverse",
    lambda e, r, v: me.traverse(r, "d1", 3),
    ", w AS (SELECT 'd1' AS id, 0 AS depth, NULL::VARCHAR AS parent UNION ALL SELECT target_id, depth + 1, w.id FROM w JOIN r ON source_id = w.id WHERE depth < 3) SELECT id, depth::INT AS depth, parent FROM w WHERE depth > 0",
)
_memory("m20_delete", lambda e, r, v: me.delete(e, r, e.where("type = 'src0'").select("id"))[1].select("source_id", "target_id"), " SELECT source_id, target_id FROM r WHERE source_id NOT IN (SELECT id FROM e WHERE type = 'src0') AND target_id NOT IN (SELECT id FROM e WHERE type = 'src0')")
_memory(
    "m21_fallback_embedding",
    lambda e, r, v: me.embed(e.select("id", F.col("type").alias("content")), 8).select("id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm")),
    " SELECT id, 8::BIGINT AS dim, 1.0::DOUBLE AS norm FROM e",
)
_memory(
    "m22_quantise",
    lambda e, r, v: e.select("id", F.array_join(me.quantise(F.col("embedding")), ",").alias("q"), F.round(F.array_max(me.dequantise(me.quantise(F.col("embedding")))).cast("double"), 4).alias("most")),
    " SELECT id, array_to_string(list_transform(embedding, lambda x: trunc(greatest(least(x, 1::FLOAT), -1::FLOAT) * 127::FLOAT)::INT), ',') AS q, round(list_max(list_transform(embedding, lambda x: trunc(greatest(least(x, 1::FLOAT), -1::FLOAT) * 127::FLOAT))) / 127.0::DOUBLE, 4) AS most FROM e",
)
_memory("m23_store", lambda e, r, v: me.store(e.select("id", "type", F.col("project").alias("content"), "project", "tags").unionByName(e.select("id", "type", F.col("project").alias("content"), "project", "tags")), AS_OF, 4).select("id", "content", "decay_score", "access_count"), " SELECT id, project AS content, 1.0::DOUBLE AS decay_score, 0::BIGINT AS access_count FROM e")


def _s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = frame(spark, sf_dir, "SELECT 'r' || user_id AS repo_root, event_type AS analysis_type, max(event_id) AS result, min(ts) AS created_at FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type")
    new = frame(spark, sf_dir, "SELECT 'r' || user_id AS repo_root, event_type AS analysis_type, -event_id AS result, ts AS created_at, event_id AS seq FROM events WHERE event_type IN ('view', 'click')")
    return me.upsert(cache, new, ["repo_root", "analysis_type"], keep=("created_at",))


QUERIES["s09_s10_upsert"] = _s09
ORACLES["s09_s10_upsert"] = """SELECT 'r' || user_id AS repo_root, event_type AS analysis_type, CASE WHEN event_type IN ('view', 'click') THEN -max(event_id) ELSE max(event_id) END AS result,
CASE WHEN event_type = 'view' THEN max_by(ts, event_id) ELSE min(ts) END AS created_at FROM events GROUP BY user_id, event_type"""
