"""Record functions and result shaping on odd values; plans that do not grow with hops."""

from pyspark.sql import functions as F

from engramix.functions import records as rf
from engramix.functions import sentences
from engramix.operators import graph, lifecycle, records, search


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_odd_values(spark):
    none = F.lit(None).cast("string")
    r = one(spark, sentences.topic(F.lit("")), sentences.topic(F.lit("é" * 80 + ". b")), rf.string_tags(none), rf.string_tags(F.lit('{"a": "b"}')), rf.session_date(F.lit("no date")), rf.dimension(F.lit("unknown")), rf.project_of_slug(F.lit("-a-b-")))
    assert r[0] == "" and r[1] == "é" * 28 + "..." and r[2] == [] and r[3] == [] and r[4] is None and r[5] is None and r[6] == ""
    r = one(spark, rf.facts(F.lit("not json")), rf.facts(F.lit("[]")), rf.facts(none), rf.category(none, none))
    assert all(x.flat == [] and x.structured == [] for x in r[:3]) and r[3] == "unknown"
    r = one(spark, rf.decisions(none, F.lit(2), ["fact"]), rf.decisions(F.lit("2 merge fact a b c\n0 drop fact"), F.lit(2), ["fact"]))
    assert [d.action for d in r[0]] == ["keep", "keep"] and tuple(r[1][1]) == (2, "merge", "fact", "a b c") and r[1][0].topic is None


def test_projection(spark):
    rows = spark.sql("select 1 as a, named_struct('x', 2, 'y', 3) as b, 4 as c")
    assert records.project(rows, ["b.y", "b.x.z", "b.q", "a", "nope"]).first().asDict(True) == {"b": {"y": 3}, "a": 1}
    assert records.project(rows, []).columns == ["a", "b", "c"] and records.project(rows, ["b.x", "b"]).first().asDict(True) == {"b": {"x": 2, "y": 3}}


def test_writes_to_empty_tables(spark):
    none = spark.createDataFrame([], "memory_id string, stability double, difficulty double, reinforcement_count long, last_reinforced_at timestamp")
    some = spark.createDataFrame([("a", 2.0)], "memory_id string, stability double")
    assert records.set_stability(none, some).collect()[0].stability == 2.0
    assert records.touched_implicitly(none, some).collect()[0].stability == 1.1
    assert records.touched_implicitly(none, some.limit(0)).collect() == []


def test_plans_are_linear_in_hops(spark):
    """One join a hop, and cycles end."""
    rows = spark.createDataFrame([("a", ["b"]), ("b", ["c", "a"]), ("c", ["d"]), ("d", None)], "id string, source_ids array<string>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert plan(graph.provenance(rows, 10)) == 9
    got = {(r.id, r.ancestor): r.hops for r in graph.provenance(rows).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "a"): 1, ("b", "c"): 1, ("b", "d"): 2, ("c", "d"): 1}
    edges = spark.createDataFrame([("a", "b", "p", None), ("b", "c", "p", None), ("c", "a", "p", None)], "subject_id string, object_id string, predicate string, invalid_at timestamp")
    near = graph.traverse(edges, spark.createDataFrame([("a",), ("z",)], "id string"), 4)
    assert {(r.seed, r.node, r.hops) for r in near.collect()} == {("a", "b", 1), ("a", "c", 1)} and plan(near) == 4


def test_caps(spark):
    rows = spark.range(50).select(F.col("id"), F.when(F.col("id") % 2 == 0, "merge").when(F.col("id") % 5 != 0, "flag").alias("action"))
    got = lifecycle.capped(rows, {"merge": 3, "flag": 1}).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in got} == {"merge": 3, "flag": 1, None: 5}


def test_queries_are_cut_as_texts_are(spark):
    rows = spark.createDataFrame([("a", "The end, of the line."), ("b", "of all")], "id string, content string")
    found = lambda q: sorted(r.id for r in search.text_hits(rows, q).collect())
    assert found("lines, end") == found("END-of-Line") == found("the end line") == ["a"] and found("") == found(" ,. ") == found("of the") == []


def test_single_column_writes_keep_other_rows(spark):
    rows = spark.sql("select 'a' as id, timestamp'2023-01-01' as event_time, 'month' as event_time_precision, 'x' as abstract_text, 'y' as overview_text, 'pending' as abstraction_status, timestamp'2023-01-01' as updated_at union all select 'b', timestamp'2022-01-01', 'year', 'p', 'q', 'complete', timestamp'2023-01-01'")
    written = spark.createDataFrame([("a", "2024-05-06", "day", 1), ("a", "2024-05-07", "day", 2), ("b", None, None, 1)], "id string, t string, precision string, at int").withColumn("time", F.to_timestamp("t")).drop("t")
    got = {r.id: (str(r.event_time)[:10], r.event_time_precision) for r in records.set_event_time(rows, written).collect()}
    assert got == {"a": ("2024-05-07", "day"), "b": ("2022-01-01", "year")}
    told = spark.createDataFrame([("a", "n1", "n2", "complete"), ("a", "n1", "n2", "complete"), ("c", "x", "x", "x")], "id string, abstract string, overview string, status string")
    out = records.set_abstraction(rows, told, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r.id, r.abstract_text, r.abstraction_status) for r in out) == [("a", "n1", "complete"), ("b", "p", "complete")]
