"""URL filters by a sort-merge range join of prefixes.

A rule is a host and a path prefix; it fits that host and its subdomains. The key of a rule is its host with the labels
reversed, then the path: all keys that start with it are one interval. A url has one key for its host and one for each
parent of the host. Keys are sorted and swept together with the sorted rules; a stack holds the rules whose intervals are
open, nested in each other, and its top is the longest rule of that key. The longest of a url's keys wins: the longer host,
then the longer path.

filter_urls takes a list of rules: urls never shuffle, each batch is sorted and swept where it is, and rules are broadcast in blocks of at
most `block` rules, one pass a block; a url keeps the longest hit of all blocks.

join_rules takes a table of rules of any size: the distinct keys of all urls and the rules are dealt into ranges of their common order and
sorted there, so each range is swept once. A rule's interval may begin in an earlier range; such rules are prefixes of the first key
of the range, so they are found by an equal join of that key's prefixes (ranges times the longest key, whatever the tables' sizes), and
are on the stack when the sweep begins. Hits come back to urls by their host and path, a row for each distinct one.

Defined results: a null url or one without `://` has an empty host and path and no rule; an empty label never matches a
label; of equal rules that block and allow, block holds; repeated rows each get a row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import need, settle

BLOCK = 100_000
#: Between labels, and before the path; both sort below every character of a host.
LABEL, PATH = "\x01", "\x00"


def host_and_path(url):
    """Columns host and path of a url column."""
    found = F.instr(url, F.lit("://"))
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + 4)
    parts = lambda i: F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", i)
    host = F.translate(parts(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = url.isNull() | (found == 0)
    return F.when(empty, "").otherwise(host), F.when(empty, "").otherwise(parts(2))


def rule_key(host: str, path: str) -> tuple[str, str]:
    """Start of a rule's interval, in two parts that are compared one after the other."""
    return LABEL.join(reversed(host.split("."))) + LABEL + PATH, path


def parse_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(verdict, rule) pairs, a rule as `host/path`, to sorted (key, verdict, rule), one for each rule."""
    out: dict[str, tuple[str, str, str]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        key = "".join(rule_key(host.lower(), slash + path))
        if key not in out or verdict == "block":
            out[key] = (key, verdict, rule)
    return sorted(out.values())


def sweep(keys: list[tuple[str, int]], rules: list[tuple[str, str, str]]) -> Iterator[tuple[int, int]]:
    """(row, rule) for the longest rule whose interval holds each sorted key."""
    stack: list[int] = []
    at, n = 0, len(rules)
    for key, row in keys:
        while at < n and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(rules[stack[-1]][0]):
                stack.pop()
            stack.append(at)
            at += 1
        while stack and not key.startswith(rules[stack[-1]][0]):
            stack.pop()
        if stack:
            yield row, stack[-1]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], *, otherwise: str = "allow", block: int = BLOCK) -> DataFrame:
    """pages plus host, path, rule and verdict, in columns of these names (which replace any there). rules: (verdict,
    `host/path`); otherwise: the verdict of a url that no rule fits."""
    need(pages, "url")
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url").cast("string"))
    out = pages.select(*own, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    schema, ready = out.schema, parse_rules(rules)
    for start in range(0, len(ready), block):
        held = pages.sparkSession.sparkContext.broadcast(ready[start : start + block])

        def judge(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            mine = held.value
            for batch in batches:
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                names, verdicts = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
                keys = []
                for row, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                    if h:
                        labels = h.split(".")[::-1]
                        for k in range(1, len(labels) + 1):
                            keys.append((LABEL.join(labels[:k]) + LABEL + PATH + p, row))
                keys.sort()
                best: dict[int, tuple[int, int, int]] = {}
                for row, i in sweep(keys, mine):
                    key = mine[i][0]
                    size = (key.count(LABEL), len(key), i)
                    if row not in best or size > best[row]:
                        best[row] = size
                for row, (labels, size, i) in best.items():
                    if names[row] is not None:
                        key = parse_rules([("", names[row])])[0][0]
                        if (key.count(LABEL), len(key)) >= (labels, size):
                            continue
                    names[row], verdicts[row] = mine[i][2], mine[i][1]
                columns = {"rule": pa.array(names, pa.string()), "verdict": pa.array(verdicts, pa.string())}
                yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

        out = out.mapInArrow(judge, schema)
    return out


def _url_keys(hosts: DataFrame) -> DataFrame:
    """(host, path, key): a key for each distinct host and path, and for each parent of the host."""
    labels = F.reverse(F.split("host", r"\."))
    some = hosts.where("host <> ''").select("host", "path").distinct().withColumn("labels", labels)
    some = some.select("host", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    return some.select("host", "path", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), LABEL), F.lit(LABEL + PATH), "path").alias("key"))


def _rule_rows(rules: DataFrame) -> DataFrame:
    """(key, verdict, rule) of a table (verdict, rule); of equal rules that block and allow, block holds."""
    host, path = F.lower(F.substring_index("rule", "/", 1)), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), LABEL), F.lit(LABEL + PATH), path)
    told = F.struct((F.col("verdict") != "block").alias("late"), "verdict", "rule")
    return rules.where("rule is not null and verdict is not null").groupBy(key.alias("key")).agg(F.min(told).alias("told")).select("key", "told.verdict", "told.rule")


def join_rules(pages: DataFrame, rules: DataFrame, *, otherwise: str = "allow", ranges: int | None = None) -> DataFrame:
    """filter_urls with a table of rules (verdict, rule)."""
    need(pages, "url")
    need(rules, "verdict", "rule")
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url").cast("string"))
    named = pages.select(*own, host.alias("host"), path.alias("path"))
    told = settle(_rule_rows(rules), "url-rules")
    keys = _url_keys(named)
    both = told.select("key", "verdict", "rule").unionByName(keys.select("key").distinct().withColumns({"verdict": F.lit(None).cast("string"), "rule": F.lit(None).cast("string")}))
    # Strings are ordered by their bytes, in Spark as in Python's order of code points.
    dealt = settle(both.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "url-ranges")
    first = dealt.groupBy("range").agg(F.min("key").alias("first"))  # a row a range
    before = first.select("range", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substr("first", F.lit(1), n))).alias("key")).join(told, "key")
    swept = dealt.unionByName(before.select("key", "verdict", "rule", "range")).distinct().repartition(ranges, "range").sortWithinPartitions("range", "key", F.col("rule").asc_nulls_last())

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for batch in batches:
            out = []
            for of, key, verdict, rule in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "verdict", "rule")), strict=True):
                if of != now:
                    now, stack = of, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    stack.append((key, verdict, rule))
                elif stack:
                    out.append((key, *stack[-1][1:], len(stack[-1][0])))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["key", "verdict", "rule", "size"])

    hits = settle(swept.select("range", "key", "verdict", "rule").mapInArrow(hit, "key string, verdict string, rule string, size int"), "url-hits")
    labels = lambda rule: F.size(F.split(F.substring_index(rule, "/", 1), r"\."))
    best = keys.join(hits, "key").groupBy("host", "path").agg(F.max(F.struct(labels("rule").alias("labels"), "size", "rule", "verdict")).alias("best"))
    best = settle(best.select("host", "path", "best.rule", "best.verdict"), "url-best")
    return named.join(best, ["host", "path"], "left").select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
