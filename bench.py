"""Headline queries over managed tables at $BENCH_SF_DIR, warm without the cache and warm with it; one JSON line.

Protocol, for each query: cold and warm runs with skipping off, the building run, then hits. ``value`` is the sum of
the hits' mean seconds. ``detail`` has for each query the warm seconds without the cache, the building seconds, the
speedup, and files and rows that the scans read without and with the cache.

``stories`` has the same for three stories over generated log lines ($BENCH_LOG_ROWS of them; 0 leaves them out): all
queries of a story with the cache off, then all with it, and the story's total. ``build_ms`` has the mean of building
entries over ranges, by rows, columns of the predicate and share of matches.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplight import Engine
from skiplight.engine import scan_metrics
from skiplight.geometry import Geometry
from skiplight.queries import ORDER, SMALL
from skiplight.sources.readers import parse_log

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))
LOG_ROWS = int(os.environ.get("BENCH_LOG_ROWS", "20000000"))

#: Dashboard and investigation queries after the published suites' shapes, over the driver's tables.
QUERIES = {
    "needle": "SELECT event_id, user_id, value FROM {events} WHERE user_id = 7 AND value > 100",
    "needle_count": "SELECT count(*) AS n FROM {events} WHERE user_id = 7 AND value > 100",
    "orders_top_price": "SELECT count(*) AS n, max(o_totalprice) AS m FROM {orders} WHERE o_totalprice > 499900",
    "key_range": "SELECT count(*) AS n, sum(l_quantity) AS q FROM {lineitem} WHERE l_orderkey < 1000",
    "rare_lines": "SELECT l_orderkey, l_partkey FROM {lineitem} WHERE l_partkey = 77 AND l_quantity > 25",
    "rare_lines_grouped": "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_partkey = 77 AND l_quantity > 25 GROUP BY l_returnflag",
    "text_pattern": "SELECT source, count(*) AS n FROM {documents} WHERE text LIKE '%Apache License%' AND lang = 'es' GROUP BY source",
    "text_pattern_count": "SELECT count(*) AS n FROM {documents} WHERE text LIKE '%TOKEN = %' AND lang = 'fr'",
    "customer_join": "SELECT c.c_mktsegment, count(*) AS n FROM (SELECT * FROM {orders} WHERE o_custkey = 123) o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "no_match": "SELECT count(*) AS n FROM {events} WHERE user_id < 0 AND value > 1e12",
    "unselective": "SELECT event_type, count(*) AS n FROM {events} WHERE value > 10 GROUP BY event_type",
}


#: A dashboard that asks one predicate in several ways, a drill-down that narrows it, and the search for a failure.
STORIES = {
    "dashboard": [
        "SELECT count(*) AS n FROM logs WHERE Content LIKE '%lease%'",
        "SELECT Level, count(*) AS n FROM logs WHERE Content LIKE '%lease%' GROUP BY Level",
        "SELECT Component, count(*) AS n FROM logs WHERE Content LIKE '%lease%' GROUP BY Component",
        "SELECT Component, count(*) AS n FROM logs WHERE Content LIKE '%lease%' AND Content LIKE '%expired%' GROUP BY Component",
    ],
    "drill_down": [
        "SELECT count(*) AS n, max(Time) AS last FROM logs WHERE Content LIKE '%slow disk%'",
        "SELECT Component, count(*) AS n FROM logs WHERE Content LIKE '%slow disk%' AND Content LIKE '%10.0.0.7 %' GROUP BY Component",
        "SELECT Date, count(*) AS n FROM logs WHERE Content LIKE '%slow disk%' AND Content LIKE '%10.0.0.7 %' GROUP BY Date",
    ],
    "failure": [
        "SELECT count(*) AS n FROM logs WHERE Level = 'WARN' OR Level = 'ERROR'",
        "SELECT Content, count(*) AS n FROM logs WHERE Content LIKE '%Exception%' GROUP BY Content ORDER BY n DESC, Content LIMIT 100",
        "SELECT Date, count(*) AS n FROM logs WHERE Content LIKE '%Exception%' AND Content LIKE '%blk_9%' GROUP BY Date",
    ],
}

#: Rows, and the predicates over columns id and c1 to c5 (id modulo 100 to 500), by what they show.
BUILDS = {"rows_100k": (100_000, "c1 = 42"), "rows_500k": (500_000, "c1 = 42"), "rows_2m": (2_000_000, "c1 = 42"), "columns_3": (2_000_000, "c1 = 42 AND c2 < 100 AND c3 > 50"), "columns_5": (2_000_000, "c1 = 42 AND c2 < 100 AND c3 > 50 AND c4 <> 0 AND c5 < 250"), "match_0": (2_000_000, "id < 0"), "match_50": (2_000_000, "c1 < 50"), "match_100": (2_000_000, "c1 >= 0")}


def log_lines(spark: SparkSession, rows: int) -> DataFrame:
    """Raw lines in order of time. Most are of one common kind; leases, slow disks and failures come in bursts."""
    n, at = F.col("id"), F.col("id") % F.lit(max(rows // 5, 1))
    failing, slow, lease = at < 800, (at >= 40_000) & (at < 41_500), (at >= 90_000) & (at < 110_000) & (n % 3 == 0)
    level = F.when(failing & (n % 4 == 0), "ERROR").when(failing | slow, "WARN").otherwise("INFO")
    block = F.concat(F.lit("blk_"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("string"))
    host = F.concat(F.lit("10.0.0."), (n % 32).cast("string"), F.lit(" "))
    text = F.when(failing, F.concat(F.lit("IOException on "), block)).when(slow, F.concat(F.lit("slow disk at "), host, block)).when(lease, F.concat(F.lit("lease of "), block, F.when(n % 5 == 0, " expired").otherwise(" renewed"))).otherwise(F.concat(F.lit("Served "), block, F.lit(" to "), host))
    when = F.date_format(F.timestamp_seconds(F.lit(1_478_000_000) + F.floor(n / 50)), "yyyy-MM-dd HH:mm:ss")
    return spark.range(rows).select(F.concat(when, F.lit(",000 "), level, F.lit(" node.Part"), (n % 6).cast("string"), F.lit(": "), text).alias("value"))


def timed(engine, text):
    """Seconds, rows and the DataFrame of a statement, from its text to its last row."""
    start = time.perf_counter()
    df = engine.sql(text)
    rows = df.collect()
    return time.perf_counter() - start, rows, df


def stories(spark: SparkSession) -> dict:
    """Each story once with the cache off, then with it; rows must agree."""
    engine = Engine(spark, geometry=Geometry())
    start = time.perf_counter()
    engine.create_table("logs", parse_log(log_lines(spark, LOG_ROWS)))
    out = {"rows": LOG_ROWS, "ingest_sec": round(time.perf_counter() - start, 2)}
    for story, texts in STORIES.items():
        engine.set_enabled(False)
        for text in texts:
            timed(engine, text)
        off = [[timed(engine, text) for _ in range(ROUNDS)] for text in texts]
        engine.set_enabled(True)
        built = [timed(engine, text)[0] for text in texts]
        hits = [[timed(engine, text) for _ in range(ROUNDS)] for text in texts]
        found = []
        for text, a, b, c in zip(texts, off, built, hits):
            if sorted(map(str, a[-1][1])) != sorted(map(str, c[-1][1])):
                raise AssertionError(f"{text}: rows differ with the cache on")
            before, after = (scan_metrics(x[-1][2])["numOutputRows"] for x in (a, c))
            warm, hit = (sum(t for t, *_ in x) / ROUNDS for x in (a, c))
            found.append({"off_warm": round(warm, 4), "build": round(b, 4), "hit": round(hit, 4), "speedup": round(warm / hit, 2), "rows": [before, after]})
        warm, hit = (sum(q[k] for q in found) for k in ("off_warm", "hit"))
        out[story] = {"off_warm": round(warm, 4), "hit": round(hit, 4), "speedup": round(warm / hit, 2), "queries": found}
    engine.drop_table("logs")
    return out


def builds(spark: SparkSession) -> dict[str, float]:
    """Mean milliseconds of building an entry, after one build that isn't counted."""
    engine, out = Engine(spark, geometry=Geometry()), {}
    for rows in sorted({n for n, _ in BUILDS.values()}):
        engine.create_table(f"numbers_{rows}", spark.range(rows).select("id", *((F.col("id") % (100 * i)).alias(f"c{i}") for i in range(1, 6))))
    for name, (rows, predicate) in BUILDS.items():
        took = []
        for _ in range(ROUNDS + 1):
            start = time.perf_counter()
            engine.condition_cache_build(f"numbers_{rows}", predicate)
            took.append(time.perf_counter() - start)
        out[name] = round(1000 * sum(took[1:]) / ROUNDS, 1)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, geometry=SMALL)
    tables = sorted({t for q in QUERIES.values() for t in ORDER if f"{{{t}}}" in q})
    start = time.perf_counter()
    for t in tables:
        engine.create_table(t, spark.read.parquet(f"{SF_DIR}/{t}.parquet"), order_by=ORDER[t])
    ingest = time.perf_counter() - start
    seconds, detail = {}, {}
    for name, sql in QUERIES.items():
        text = sql.format(**{t: t for t in tables})
        engine.set_enabled(False)
        timed(engine, text)
        off, hits = [], []
        for _ in range(ROUNDS):
            took, expected, plain = timed(engine, text)
            off.append(took)
        engine.set_enabled(True)
        built, *_ = timed(engine, text)
        for _ in range(ROUNDS):
            took, got, fast = timed(engine, text)
            hits.append(took)
        if sorted(map(str, got)) != sorted(map(str, expected)):
            raise AssertionError(f"{name}: rows differ with the cache on")
        before, after = scan_metrics(plain), scan_metrics(fast)
        seconds[name] = round(sum(hits) / len(hits), 4)
        warm = sum(off) / len(off)
        detail[name] = {"off_warm": round(warm, 4), "build": round(built, 4), "speedup": round(warm / seconds[name], 2), "files": [before["numFiles"], after["numFiles"]], "rows": [before["numOutputRows"], after["numOutputRows"]]}
    more = {"stories": stories(spark)} if LOG_ROWS else {}
    more["build_ms"] = builds(spark)
    print(json.dumps({"metric": "cache_hit_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("/")[2], "ingest_sec": round(ingest, 2), "detail": detail, **more}))


if __name__ == "__main__":
    main()
