import datetime as dt
import json

from pyspark.sql import functions as F

from plumbline.operators import findings as fi
from plumbline.operators import fleet as fl

T0 = dt.datetime(2024, 1, 1)


def rows(spark, times, rule="deps.dependabot.x.y"):
    data = [(k, rule, "f.go", 7, t, "deps.dependabot", "y", f"fp{k}") for k, t in enumerate(times)]
    return spark.createDataFrame(data, "seq long, rule_id string, file string, line long, ts timestamp_ntz, prefix string, rule string, fingerprint string")


def test_fingerprint_of_a_known_finding(spark):
    got = spark.range(1).select(fi.fingerprint(F.lit("R1"), F.lit("a.go"), F.lit(7))).first()[0]
    assert got == "9fb6ce324eea1ece2d2791250fc497599600ed3f5bab46d07cc185cf39f24afd"


def test_time_windows_keep_each_first_row_once(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    got = {r.seq: (r.kept_seq, r.duplicate) for r in fi.dedup_window(rows(spark, [h(0), h(48), h(24), h(49), None])).collect()}
    assert got == {4: (4, False), 0: (0, False), 2: (0, True), 1: (1, False), 3: (1, True)}


def test_rule_ids(spark):
    got = spark.createDataFrame([("deps.dependabot.cat.rule.x",), ("deps.dependabot.rule",), ("other.rule",), ("deps.dependabotx.y",)], "r string").select(fi.normalise_rule(F.col("r")).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [("deps.dependabot", "cat", "rule.x"), ("deps.dependabot", "", "rule"), ("sarif", "", "other.rule"), ("sarif", "", "deps.dependabotx.y")]


def test_report_versions_and_missing_parts(spark):
    one = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "message": {"text": "m"}}, {"ruleId": "q", "level": "error", "locations": []}]}, {"results": []}]}
    docs = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(one | {"version": "1.0.0"})), (3, "nonsense"), (4, None)], "seq long, doc string")
    got = fi.flatten(fi.parse_reports(docs)).orderBy("result_no").collect()
    assert [(r.report_seq, r.rule_id, r.level, r.file, r.line, r.tool) for r in got] == [(1, "r", "", "", 0, "t"), (1, "q", "error", "", 0, "t")]


def test_reports_round_trip(spark):
    f = spark.createDataFrame([(1, "r", "", "m", "a.go", 3, "t"), (2, "q", "note", "n", "", 0, "t")], "seq long, rule_id string, level string, message string, file string, line long, tool string")
    back = fi.flatten(fi.parse_reports(fi.reports_of(f).select(F.lit(1).alias("seq"), "doc")))
    assert [(r.rule_id, r.level, r.file, r.line) for r in back.orderBy("result_no").collect()] == [("r", "warning", "a.go", 3), ("q", "note", "", 0)]


def test_reports_of_a_tool_with_many_findings_are_several(spark):
    f = spark.range(40_000).select(F.col("id").alias("seq"), F.concat(F.lit("r"), "id").alias("rule_id"), F.lit("note").alias("level"), F.lit("m" * 100).alias("message"), F.lit("a.go").alias("file"), F.col("id").alias("line"), F.when(F.col("id") > 5, "t").alias("tool"))
    docs = fi.reports_of(f).cache()
    assert docs.agg(F.max(F.length("doc"))).first()[0] < 3_000_000 and docs.where("tool IS NULL").count() == 1
    back = fi.flatten(fi.parse_reports(docs.select(F.col("part").alias("seq"), "doc")))
    assert sorted(((r.rule_id, r.line, r.tool) for r in back.collect()), key=str) == sorted(((f"r{k}", k, "t" if k > 5 else None) for k in range(40_000)), key=str)
    assert back.groupBy("report_seq", "tool").agg(F.expr("sort_array(collect_list(struct(result_no, line))).line AS a")).where("a <> sort_array(a)").count() == 0
    docs.unpersist()


def test_places_in_messages(spark):
    f = spark.createDataFrame([(1, None, None, "see pkg/a.go:42:10 there", None), (2, "b.go", 3, "x", None), (3, None, None, "nothing", {"file_path": "c.go", "line": "9x"}), (4, "", 0, None, None)], "seq long, file string, line long, message string, metadata map<string,string>")
    assert {r.seq: (r.file, r.line, r.source) for r in fi.locate(f).collect()} == {1: ("pkg/a.go", 42, "description"), 2: ("b.go", 3, "sarif"), 3: ("c.go", 9, "metadata"), 4: ("", 0, "unknown")}
    assert fi.locate(f, "skip").count() == 3


def test_collision_suffix_fills_the_first_gap(spark):
    rules = spark.createDataFrame([("a.b",), ("c",), ("free",)], "rule_id string")
    taken = spark.createDataFrame([("a.b",), ("a.b.1",), ("a.b.3",), ("c",), ("c.2",)], "rule_id string")
    assert {r.rule_id: r.resolved_id for r in fi.resolve_collisions(rules, taken, "suffix").collect()} == {"a.b": "a.b.2", "c": "c.1", "free": "free"}


def test_fleet_without_repositories_or_maxima(spark):
    s = spark.createDataFrame([("a", "n1", 4.0, 5.0, [("k", True)]), ("b", None, 0.0, 0.0, None), ("c", "", 1.0, 5.0, [("k", False), ("l", True)])], "repo_id string, connection_id string, score double, max_score double, checks array<struct<check_id:string,passed:boolean>>")
    m = fl.fleet_metrics(s).first()
    assert (m.total_repos, m.min_score, m.max_score, m.passing_repos, m.failing_repos, m.connections, m.total_checks, m.passing_checks) == (3, 0.2, 0.8, 1, 1, 1, 3, 2)
    assert abs(fl.fleet_average(s).first().average - 1 / 3) < 1e-12
    empty = fl.fleet_metrics(s.limit(0)).first()
    assert (empty.total_repos, empty.min_score, empty.total_checks) == (0, 0.0, 0)
    assert {r.connection: r.repos for r in fl.by_connection(s).collect()} == {"n1": 1, "__unknown__": 2}


def test_unknown_persona(spark):
    import pytest

    with pytest.raises(ValueError, match="unknown persona"):
        fl.council_report(spark.createDataFrame([], "persona string, severity string"), ("nobody",))
