"""Remote services as sources and sinks; the transport is a callable, so none is tied to one.

A page source is a Python data source whose partitions are pages. Sinks are meant
for ``foreachBatch`` or ``foreachPartition`` and write each row at least once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.operators.fleet import is_transient
from plumbline.operators.fold import fold
from plumbline.operators.packets import signature
from plumbline.sources.files import folders

# The fields of the remote verbs' results.
SCHEMAS = {
    "conflicts": "files array<struct<path:string,status:string,conflicts:bigint>>, count bigint, severity string",
    "dependencies": "dependencies array<struct<name:string,version:string,latest:string,manager:string,vulnerable:boolean>>, total bigint, outdated bigint, vulnerable bigint",
    "metadata": "name string, path string, default_branch string, head_sha string, commits_ahead bigint, commits_behind bigint, last_commit timestamp, tags array<string>, labels map<string,string>",
    "pull_requests": "pull_requests array<struct<number:bigint,title:string,author:string,state:string,base:string,head:string,created:timestamp,updated:timestamp>>, total bigint, open bigint, merged bigint",
    "codeowners": "entries array<struct<pattern:string,owners:array<string>>>, exists boolean, raw string",
    "branch_protection": "branch string, protected boolean, required_reviews bigint, require_status_checks boolean, require_up_to_date boolean, restrict_pushes boolean, allow_force_pushes boolean, allow_deletions boolean, status_checks array<string>",
    "compliance": "passed boolean, score double, checks array<struct<name:string,passed:boolean,message:string,severity:string>>, total_checks bigint, passed_checks bigint, failed_checks bigint, audited_at timestamp",
    "health": "tier string, score double, components array<struct<name:string,score:double,max_score:double,status:string,message:string>>, assessed_at timestamp",
    "portfolio": "path string, name string, health_tier string, score double, last_updated timestamp, labels map<string,string>",
    "campaign": "campaign_id string, name string, status string, progress double, total_repos bigint, completed_repos bigint, failed_repos bigint, skipped_repos bigint, started_at timestamp, completed_at timestamp, last_updated timestamp, results array<struct<repo_path:string,status:string,score:double,error:string>>",
    "audit_event": "timestamp timestamp, event_type string, provider string, connection_id string, repo_id string, details map<string,string>",
}


def payload(text: Column, verb: str) -> Column:
    """A remote verb's JSON result as a struct; fields that are absent are null, text that is no JSON has only nulls."""
    return F.from_json(text, SCHEMAS[verb])


class _Page(InputPartition):
    pass


class PagedReader(DataSourceReader):
    """Pages as partitions where the first one tells the total; otherwise one partition that goes on while a page says there are more."""

    def __init__(self, fetch: Callable[[int], dict], page_size: int, columns: list[str]):
        self.fetch, self.page_size, self.columns = fetch, page_size, columns

    def partitions(self):
        total = self.fetch(1).get("total")
        if total is None:
            return [_Page(0)]
        return [_Page(k) for k in range(1, max(1, math.ceil(total / self.page_size)) + 1)]

    def _pages(self, number: int) -> Iterator[dict]:
        if number:
            yield self.fetch(number)
            return
        number, more = 1, True
        while more:
            page = self.fetch(number)
            yield page
            number, more = number + 1, bool(page.get("has_more"))

    def read(self, partition) -> Iterator[tuple]:
        for page in self._pages(partition.value):
            for item in page["items"]:
                yield tuple(item.get(c) for c in self.columns)


def paged(name: str, fetch: Callable[[int], dict], schema: str, page_size: int = 100) -> type[DataSource]:
    """A data source over ``fetch(page)`` -> {items, total} or {items, has_more}; a page that fails fails the read. Register it with ``spark.dataSource.register``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, page_size, schema.names)

    return Paged


def envelope(text: Column, data_schema: str) -> Column:
    """Struct (age_hours, warnings, data) of a result's text {staleness, data}; text that is no such thing is data without staleness."""
    x = F.from_json(text, f"staleness struct<data_age_hours:double,commits_behind_main:bigint,warnings:array<string>>, data {data_schema}")
    return F.struct(x["staleness"]["data_age_hours"].alias("age_hours"), x["staleness"]["warnings"].alias("warnings"), x["data"].alias("data"), F.when(x["data"].isNull() & x["staleness"].isNull(), text).alias("raw"))


def retried(call: Callable[[], object], attempts: int = 3, delay: float = 0.05, transient: Callable[[Exception], bool] = lambda e: any(t in str(e) for t in ("timeout", "connection reset", "EOF", "broken pipe"))) -> object:
    """The result of ``call``, tried again after transient errors."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not transient(e):
                raise
            time.sleep(delay * 2**k)
    return None


class Breaker:
    """W13 for a running sender: no call is allowed for ``timeout`` seconds once ``threshold`` failed; ``half_open`` successes close it again."""

    def __init__(self, threshold: int = 5, timeout: float = 30.0, half_open: int = 3, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.timeout, self.half_open, self.clock = threshold, timeout, half_open, clock
        self.state, self.failures, self.successes, self.failed_at = "closed", 0, 0, 0.0

    def allow(self) -> bool:
        if self.state == "open" and self.clock() - self.failed_at > self.timeout:
            self.state, self.successes = "half_open", 0
        return self.state != "open"

    def record(self, ok: bool) -> None:
        if not ok:
            self.failures, self.failed_at = self.failures + 1, self.clock()
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state = "open"
            return
        self.successes += self.state == "half_open"
        if self.state == "closed" or self.successes >= self.half_open:
            self.state, self.failures = "closed", 0


class Bucket:
    """W14 for a running sender: ``wait`` returns once a token is there."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.last = float(burst), clock()

    def wait(self) -> None:
        while True:
            now = self.clock()
            self.tokens, self.last = min(self.burst, self.tokens + (now - self.last) * self.rate), now
            if self.tokens >= 1.0 - 1e-9:
                self.tokens -= 1.0
                return
            self.sleep((1.0 - self.tokens) / self.rate)


def webhook_sink(
    send: Callable[[str, bytes, dict[str, str]], int], url: str, secret: bytes = b"", allowed: Iterable[str] = (), rate: float = 10.0, burst: float = 20.0, threshold: int = 5, timeout: float = 30.0, attempts: int = 4, delay: float = 0.05, senders: int = 1
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends every row as signed JSON; hosts outside ``allowed`` are refused at once.

    ``senders`` tasks share ``rate`` and ``burst``; each has a breaker, which attempts
    pass and statuses worth another try count against. A row that fails, or that the
    open breaker holds back, does not stop the others, but then the batch fails, so
    that it is sent again: every row is delivered at least once or the batch stays.
    """
    host = url.split("://", 1)[-1].split("/", 1)[0]
    if allowed and host not in set(allowed):
        raise ValueError(f"host not allowed: {host}")

    def one(body: bytes, breaker: Breaker) -> bool:
        headers = {"Content-Type": "application/json"} | ({"X-Signature": signature(body, secret)} if secret else {})
        for k in range(attempts):
            try:
                status = send(url, body, headers)
            except Exception:
                status = 0
            if 200 <= status < 300:
                breaker.record(True)
                return True
            if status not in (0, 429, 500, 502, 503, 504):
                return False
            breaker.record(False)
            if k + 1 < attempts:
                time.sleep(delay * 2**k)
        return False

    def deliver(rows: Iterator) -> None:
        breaker, bucket, failed, held = Breaker(threshold, timeout), Bucket(rate / senders, max(1.0, burst / senders)), 0, 0
        for row in rows:
            if not breaker.allow():
                held += 1
                continue
            bucket.wait()
            failed += not one(row["body"].encode(), breaker)
        if failed or held:
            raise RuntimeError(f"{failed} deliveries failed, {held} held back by the breaker")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.to_json(F.struct("*")).alias("body")).repartition(senders).foreachPartition(deliver)

    return write


def finding_payloads(findings: DataFrame) -> DataFrame:
    """One JSON body per finding for a vulnerability manager: severity mapped, the fingerprint as its unique id."""
    from plumbline.operators.findings import external_severity

    body = F.struct(
        F.col("rule_id").alias("title"), external_severity(F.col("severity")).alias("severity"), F.col("message").alias("description"), F.col("file").alias("file_path"), "line", F.col("fingerprint").alias("unique_id_from_tool"), F.lit(True).alias("active"), F.lit(False).alias("verified")
    )
    return findings.select("seq", F.to_json(body).alias("body"))


def send_each(rows: DataFrame, send: Callable[[str], bool], name: str = "body") -> tuple[int, int]:
    """Sends every row's ``name``; (sent, skipped), as failures are counted and passed over."""
    sc = rows.sparkSession.sparkContext
    sent, skipped = sc.accumulator(0), sc.accumulator(0)

    def work(part: Iterator) -> None:
        for row in part:
            try:
                ok = send(row[name])
            except Exception:
                ok = False
            (sent if ok else skipped).add(1)

    rows.foreachPartition(work)
    return sent.value, skipped.value


def comment_bodies(reviews: DataFrame) -> DataFrame:
    """(number, body): one comment for each request's findings, worst first."""
    from plumbline.operators.findings import severity_weight

    line = F.concat(F.lit("- **"), "severity", F.lit("** `"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("` "), "message")
    rows = reviews.groupBy("number").agg(F.sort_array(F.collect_list(F.struct((-severity_weight(F.col("severity"))).alias("w"), "file", "line", line.alias("t")))).alias("x"))
    return rows.select("number", F.concat_ws("\n", F.concat(F.size("x").cast("string"), F.lit(" findings")), F.array_join(F.transform("x", lambda y: y["t"]), "\n")).alias("body"))


def transient_rows(results: DataFrame) -> DataFrame:
    """F22 over results (message): those worth another try."""
    return results.where(is_transient(F.col("message")))


def append_audit(batch: DataFrame, path: str, batch_id: int) -> None:
    """Appends a micro-batch's entries (seq, entry), chained by hash to the batch before, to the JSON table at ``path``.

    For ``foreachBatch``, one writer and one checkpoint per ``path``: a batch is a folder
    of its own, which a replay writes anew from the same predecessor, so nothing is
    appended twice. A chain is sequential; one task streams it in order, holding a hash.
    """
    import hashlib

    spark: SparkSession = batch.sparkSession
    before = [k for k in folders(spark, path, "batch=") if k < batch_id]
    previous = ""
    if before:
        end = spark.read.schema("seq bigint, hash string").json(f"{path}/batch={before[-1]}").agg(F.max_by("hash", "seq")).first()
        previous = end[0] or ""

    def step(last, row):
        now = hashlib.sha256((last + (row["entry"] or "")).encode()).hexdigest()
        return now, row | {"hash": now}

    rows = fold(batch.select(F.lit("audit").alias("log"), "seq", "entry"), ["log"], ["seq"], lambda key: previous, step, "log string, seq bigint, entry string, hash string")
    if not batch.isEmpty():
        rows.write.mode("overwrite").json(f"{path}/batch={batch_id}")
