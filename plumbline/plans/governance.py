"""Queries of the document operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import governance as gv
from plumbline.plans.tables import frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2001-08-01 00:00:00"

_FOLDERS = ("docs/adr/", "api/", "docs/api/changelog", "docs/arch/context", "docs/c4/container", "architecture/component", "docs/runbooks/", "docs/disaster-recovery", "docs/incident", "docs/security/threat", "data/dictionary", "slo/", "incidents/", "docs/migrations/", "releases/", "docs/code-guide", "notes/")
#: Documents with front matter of varying completeness; the content is the whole text and some words that validators look for.
DOCS = f"""
SELECT '{{}}' AS x, path, mod_time, kind, doc_id, lang, n_chars,
  CASE WHEN lang = 'fr' THEN '' ELSE chr(10) || '---' || chr(10) || CASE WHEN lang = 'en' THEN 'title: "Doc ' || doc_id || '"' || chr(10) ELSE '' END || 'status: ' || CASE WHEN n_chars % 3 = 0 THEN 'accepted' WHEN n_chars % 3 = 1 THEN 'odd' ELSE 'draft' END || chr(10)
    || 'severity: SEV-' || (n_chars % 5) || chr(10) || 'steps: [a, b]' || chr(10) || 'owner: me' || chr(10) || 'context: x' || chr(10) || '---' || chr(10) END
  || CASE WHEN lang = 'de' THEN '# Heading ' || doc_id || chr(10) ELSE '' END || text || chr(10) || CASE WHEN n_chars % 2 = 0 THEN 'Context, decision and consequences: system, user, service; container; steps: rollback and verification; Added; error budget; SLI; burn rate' ELSE 'recovery, backup, restore' END AS content
FROM (SELECT d.*, o_orderdate AS mod_time, doc_id % {len(_FOLDERS)} AS kind, CASE doc_id % {len(_FOLDERS)} {' '.join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(_FOLDERS))} END || doc_id || CASE WHEN doc_id % {len(_FOLDERS)} = 1 THEN '.yaml' ELSE '.md' END AS path
      FROM documents AS d JOIN orders ON o_orderkey = doc_id) AS e
"""
_TYPES = ("adr", "api_spec", "api_changelog", "arch_overview", "arch_container", "arch_component", "runbook", "disaster_recovery", "incident_playbook", "threat_model", "data_dictionary", "slo", "postmortem", "migration_guide", "release_notes", "code_guide", None)
_BY = {t.type: t for t in gv.TYPES}


def _case(value) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {value(_BY[t])}" for k, t in enumerate(_TYPES) if t) + " END"


def _keyword_sql() -> str:
    out = []
    for k, t in enumerate(_TYPES):
        for g in gv.VALIDATORS.get(_BY[t].validator, ()) if t else ():
            n = " + ".join(f"contains(low, '{w}')::INT" for w in g.words)
            out.append(f"- CASE WHEN kind = {k} AND {n} < {g.least} THEN {g.penalty}::DOUBLE ELSE 0 END")
    return " ".join(out)


_WITH = f"""WITH v AS ({DOCS}), f AS (SELECT *, lower(content) AS low, lang <> 'fr' AS front, {_case(lambda t: f"'{t.type}'")} AS type, {_case(lambda t: t.max_days)} AS max_days, {_case(lambda t: t.warn_days)} AS warn_days,
  date_diff('second', mod_time, TIMESTAMP '{AS_OF}') / 86400.0::DOUBLE AS age,
  list_filter({_case(lambda t: "['" + "', '".join(t.fields) + "']")}, lambda x: NOT (x IN ('status', 'severity', 'steps', 'owner', 'context') OR (x = 'title' AND lang = 'en'))) AS absent FROM v WHERE kind <> 16),
g AS (SELECT *, kind IN (14, 15) AS plain, CASE WHEN kind = 1 THEN ['openapi', 'info', 'paths'] WHEN kind IN (14, 15) THEN [] WHEN NOT front THEN ['frontmatter'] ELSE absent END AS lacking FROM f),
s AS (SELECT *, round(greatest(0, 1 - CASE WHEN NOT plain AND kind <> 1 AND NOT front THEN 0.3::DOUBLE ELSE 0 END - 0.2::DOUBLE * len(lacking) {_keyword_sql()}
  - CASE WHEN kind = 0 AND front AND n_chars % 3 <> 0 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN kind = 6 AND front AND n_chars % 5 = 4 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score,
  CASE WHEN max_days = 0 AND warn_days = 0 THEN 'unknown' WHEN age > max_days THEN 'stale' WHEN age > warn_days THEN 'warning' ELSE 'fresh' END AS level,
  CASE WHEN lang = 'en' THEN 'Doc ' || doc_id WHEN lang = 'de' THEN 'Heading ' || doc_id ELSE regexp_replace(split_part(path, '/', -1), '[.][^.]*$', '') END AS title,
  CASE WHEN NOT front THEN 'draft' WHEN n_chars % 3 = 0 THEN 'approved' WHEN n_chars % 3 = 1 THEN 'odd' ELSE 'draft' END AS status FROM g)"""
DOCS = DOCS.replace("'{}' AS x, ", "")
_WITH = _WITH.replace("'{}' AS x, ", "")


def _add(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, DOCS))
    ORACLES[name] = _WITH + sql


def _reg(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda v: run(gv.registry(v, AS_OF))


_add("s17_document_types", lambda v: v.select("path", gv.doc_type(F.col("path")).alias("type")), f" SELECT path, {_case(lambda t: repr(t.type))} AS type FROM v")
_add("d01_staleness", lambda v: v.select("path", gv.staleness(gv.age_seconds(F.col("mod_time"), AS_OF), F.lit(900 * gv.DAY), F.lit(300 * gv.DAY)).alias("level")), f" SELECT path, CASE WHEN a > 900 * 86400 THEN 'stale' WHEN a > 300 * 86400 THEN 'warning' ELSE 'fresh' END AS level FROM (SELECT path, date_diff('second', mod_time, TIMESTAMP '{AS_OF}') AS a FROM v)")
_add(
    "d02_staleness_report",
    lambda v: gv.staleness_report(v, v.where("lang = 'en'").select("path").union(v.limit(0).select("path")), AS_OF, 900 * gv.DAY, 300 * gv.DAY),
    f" SELECT CASE WHEN a > 900 * 86400 THEN 'stale' WHEN a > 300 * 86400 THEN 'warning' ELSE 'fresh' END AS level, count(*) AS n FROM (SELECT date_diff('second', mod_time, TIMESTAMP '{AS_OF}') AS a FROM v WHERE lang = 'en') GROUP BY 1",
)
_add("d03_freshness", _reg(lambda r: r.select("path", "level", "age_days")), " SELECT path, level, floor(age)::BIGINT AS age_days FROM s")
_add("d04_d05_title_and_status", _reg(lambda r: r.select("path", "title", "status")), " SELECT path, title, status FROM s")
_add("d06_validate", gv.validate, " SELECT path, type, score, len(lacking) = 0 AS valid, array_to_string(lacking, ',') AS missing FROM s")
_add(
    "d07_missing_fields",
    lambda v: v.select("path", F.array_join(gv.missing_fields(gv.front_matter(F.col("content")), F.array(F.lit("title"), F.lit("owner"), F.lit("version"))), ",").alias("missing")),
    " SELECT path, CASE WHEN lang = 'fr' THEN 'frontmatter' WHEN lang = 'en' THEN 'version' ELSE 'title,version' END AS missing FROM v",
)
_add("d08_listing", _reg(lambda r: gv.listing(r, "runbook", "approved").select("path", "age_days")), " SELECT path, floor(age)::BIGINT AS age_days FROM s WHERE type = 'runbook' AND status = 'approved'")
_add("d09_get", _reg(lambda r: gv.get(r, "/repo/docs/runbooks/23.md", "/repo").select("path", "title")), " SELECT path, title FROM s WHERE path = 'docs/runbooks/23.md'")
_add("d10_by_type", _reg(gv.by_type), " SELECT type, count(*) AS n, count(*) FILTER (len(lacking) = 0) AS valid FROM s GROUP BY type")
_add("d11_missing_required", _reg(gv.missing_required), " SELECT 'changelog' AS type")
_FILES = "SELECT path FROM ({}) AS x UNION ALL SELECT 'src/' || p_name || '.go' FROM part UNION ALL SELECT 'data/' || n_name || '.sql' FROM nation"


def _with_files(run) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(gv.registry(frame(spark, sf_dir, DOCS).withColumn("path", F.expr(_PLAIN_PATH)), AS_OF), frame(spark, sf_dir, _FILES.format(DOCS)))


#: Documents of some types stand elsewhere here, so that those types are absent.
_PLAIN_PATH = "CASE WHEN kind IN (4, 5, 7, 10, 12, 13, 14, 15) THEN concat('notes/', doc_id, '.md') ELSE path END"


_ADVICE = ", ".join(f"('{t}', {p}, '{r}')" for t, on, p, r in gv.ADVICE if t in ("arch_container", "postmortem", "disaster_recovery", "code_guide", "migration_guide", "arch_component", "data_dictionary", "runbook_operational"))
QUERIES["d12_recommendations"] = _with_files(gv.recommendations)
ORACLES["d12_recommendations"] = f"SELECT * FROM (VALUES {_ADVICE}) AS t(type, priority, reason)"
_add("d13_freshness_lists", _reg(gv.freshness_lists), " SELECT path, title, type, floor(age)::BIGINT AS age_days, level FROM s WHERE level IN ('stale', 'warning')")
_add("d13_freshness_summary", _reg(gv.freshness_summary), " SELECT count(*) AS total, count(*) FILTER (level = 'fresh') AS fresh, count(*) FILTER (level = 'warning') AS warning, count(*) FILTER (level = 'stale') AS stale, count(*) FILTER (level = 'unknown') AS unknown FROM s")
_add(
    "d14_registry_stats",
    _reg(gv.registry_stats),
    " SELECT 'type' AS part, type AS name, count(*) AS n FROM s GROUP BY type UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY status UNION ALL SELECT 'level', level, count(*) FROM s GROUP BY level UNION ALL SELECT 'invalid', '', count(*) FROM s WHERE len(lacking) > 0 UNION ALL SELECT 'required_missing', '', 1",
)
QUERIES["d15_suggestions"] = _with_files(gv.suggestions)
ORACLES["d15_suggestions"] = f"SELECT * FROM (VALUES {_ADVICE}, ('changelog', 100, 'required by governance policy')) AS t(type, priority, reason)"
_add(
    "d17_refresh",
    lambda v: gv.refresh(gv.registry(v, AS_OF), v.where("lang = 'es'").withColumn("content", F.lit("# New")), v.where("lang = 'fr'").select("path"), AS_OF).select("path", "title"),
    " SELECT path, CASE WHEN lang = 'es' THEN 'New' ELSE title END AS title FROM s WHERE lang <> 'fr'",
)
_add(
    "s19_front_matter",
    lambda v: v.select("path", F.array_join(gv.keys(gv.front_matter(F.col("content"))), ",").alias("keys"), F.coalesce(gv.scalar(gv.front_matter(F.col("content")), "status"), F.lit("")).alias("status"), gv.scalar(gv.front_matter(F.col("content")), "steps").alias("steps")),
    " SELECT path, CASE WHEN lang = 'fr' THEN '' ELSE CASE WHEN lang = 'en' THEN 'title,' ELSE '' END || 'status,severity,steps,owner,context' END AS keys, CASE WHEN lang = 'fr' THEN '' WHEN n_chars % 3 = 0 THEN 'accepted' WHEN n_chars % 3 = 1 THEN 'odd' ELSE 'draft' END AS status, NULL::VARCHAR AS steps FROM v",
)
