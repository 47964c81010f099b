"""Jobs as streams, records, links and numbers on stated and random cases."""

import re
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import grounding, keys
from tidemill.streaming import jobs

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_stale_jobs_over_batches(spark, tmp_path):
    """Files that arrive one after another, with a repeated event, one out of order and one that is too late."""
    files = [
        [(1, at(0), "processing"), (2, at(5), "processing"), (2, at(5), "processing"), (3, at(1), "processing")],
        [(2, at(60), "completed"), (3, at(200), "failed"), (4, at(190), "processing")],
        [(5, at(400), "processing"), (4, at(195), "completed")],
        [(5, at(521), "processing"), (6, at(700), "view")],
        [(6, at(900), "view"), (1, at(2), "completed")],
    ]
    schema = "job long, at timestamp, state string"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = {(r.job, r.since, r.stale_at) for r in jobs.run_to_end(jobs.stale_jobs(events, 7200), "stale").collect()}
    assert found == {(1, at(0), at(120)), (3, at(1), at(121)), (5, at(400), at(520)), (5, at(521), at(641))}


def test_outbound_jobs(spark):
    rows = [(1, 1, "processing"), (1, 2, "completed"), (2, 1, "failed"), (2, 3, "delivered"), (3, 1, "completed"), (3, 2, "delivered"), (3, 4, "failed"), (4, 1, "approval_pending"), (5, 1, "approval_pending"), (5, 2, "approval_sent"), (6, 1, "completed"), (6, 2, "pending"), (7, 1, "delivered")]
    found = jobs.outbound(spark.createDataFrame(rows, "job int, at int, state string")).collect()
    assert sorted(map(tuple, found)) == [(1, "completed", 2), (3, "failed", 4), (4, "approval_pending", 1)]


def test_stage_seconds(spark):
    rows = [("a", START, "x"), ("a", START + timedelta(seconds=1.234), "y"), ("b", START, "x")]
    found = jobs.stage_seconds(spark.createDataFrame(rows, "key string, at timestamp, mark string"), "key", "at").collect()
    assert sorted((r.key, r.mark, r.seconds) for r in found if r.seconds) == [("a", "y", 1.23)] and len(found) == 3


def test_records(spark):
    rows = [(1, "chroma:document", "body", None), (1, "chroma:x", "y", None), (1, "n", None, 7), (1, "s", "t", 3), (1, "s", "a", None), (1, "none", None, None), (2, "k", None, 0), (3, "chroma:y", None, None)]
    found = {r.id: (r.doc, r.meta) for r in keys.records(spark.createDataFrame(rows, "id int, name string, s string, i int"), "id", ("s", "i")).collect()}
    assert found == {1: ("body", {"n": "7", "s": "a"}), 2: (None, {"k": "0"}), 3: (None, {})}
    assert spark.range(1).select(keys.as_texts(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int"))).alias("m")).head().m == {"a": "1", "b": ""}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,), (1,)], "x int")
    assert keys.same_rows(a, b) and not keys.same_rows(a, b.distinct())


def test_links(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (3, "k"), (2, "c")], "src int, dst string")
    known = spark.createDataFrame([("k",), ("k",)], "id string")
    assert sorted(map(tuple, grounding.outside_targets(edges, known).collect())) == [("a", 2, 1), ("b", 1, 2), ("c", 1, 3)]
    assert tuple(grounding.edge_totals(edges, known).head()) == (1, 4, 3, 3)
    cites = spark.createDataFrame([("2005.11401v2", "arXiv:2005.11401. ArXiv abs/2310.06116 CoRR, abs/1810.04805 arxiv.org/pdf/2005.11401v2 10.48550/arXiv.2310.06116 arXiv:2005.114011 arXiv:2023.12345 arXiv:1412.6980 arXiv:2005.1140"), ("x", None)], "paper_id string, content string")
    assert {tuple(r) for r in grounding.citation_edges(cites).collect()} == {("2005.11401", "2310.06116"), ("2005.11401", "1810.04805"), ("2005.11401", "1412.6980")}


def test_aligned_numbers(spark):
    conclusion = spark.createDataFrame([("p", "61.94"), ("p", "4.79"), ("p", "9.5"), ("q", "1.0")], "paper string, x string")
    body = spark.createDataFrame([("p", "61.85"), ("p", "4.79"), ("p", "9.51"), ("p", "9.52"), ("r", "1.0")], "paper string, x string")
    assert {(r.paper, r.x, r.aligned) for r in grounding.aligned_numbers(conclusion, body).collect()} == {("p", "61.94", "61.85"), ("p", "4.79", "4.79"), ("p", "9.5", "9.5"), ("q", "1.0", "1.0")}


def test_numbers_without_source(spark):
    rng = np.random.default_rng(4)
    bits = ["12", "12.5", "2024", "7", "x12", "3.25%", "125", "12.", "1,200", "a", "한12", "0.5"]
    rows = [(" ".join(rng.choice(bits, rng.integers(0, 6))), " ".join(rng.choice(bits, rng.integers(0, 6)))) for _ in range(200)]

    def missing(answer, source):
        found = dict.fromkeys(re.findall(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w]|\.\d)", answer, re.A))
        found = [n for n in found if len(n.replace(".", "")) >= 2 and not re.fullmatch(r"(19|20)\d\d", n)]
        return [n for n in found if source and not re.search(rf"(?<![0-9]){re.escape(n)}(?![0-9])", source)]

    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, s string")
    found = {r.i: r.m for r in made.select("i", grounding.unsupported(F.col("a"), F.col("s")).alias("m")).collect()}
    assert found == {i: missing(*r) for i, r in enumerate(rows)}


def test_collapsed_spans(spark):
    def collapse(x, low, high):
        if x is None or len(x) < 3 * low:
            return x
        out, i = [], 0
        while i < len(x):
            for size in range(min(high, (len(x) - i) // 2), low - 1, -1):
                if x.startswith(x[i : i + size], i + size):
                    end = i + size
                    while x.startswith(x[i : i + size], end) and end + size <= len(x):
                        end += size
                    out.append(x[i : i + size])
                    i = end
                    break
            else:
                out.append(x[i])
                i += 1
        return "".join(out)

    rng = np.random.default_rng(11)
    words = ["한국", "ab\n", "\U0001f600", "c", " long piece of text "]
    rows = ["".join(np.repeat(rng.choice(words, 12), rng.integers(1, 4, 12))) for _ in range(300)] + [None, "", "abc" * 40]
    made = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    for low, high in ((18, 420), (3, 7)):
        found = {r.i: r.y for r in made.select("i", text.collapsed_spans(F.col("x"), low, high).alias("y")).collect()}
        assert found == {i: collapse(x, low, high) for i, x in enumerate(rows)}
