import glob
import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter, functions as F, types as T

from tallyhouse.operators.aggregates import distinct_profile, exact_quantiles
from tallyhouse.plans import claims as cl, envelope as env, mapping as mp, quality as q
from tallyhouse.plans.insights import SCHEMA, lookup
from tallyhouse.plans.semantic import FILTERS, MEASURES, enum_columns, metric_view
from tallyhouse.plans.firm import Firm
from tallyhouse.sources import sinks
from tallyhouse.sources.tables import inventory


def test_merge_updates_only_matches_that_pass(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (None, "a", 4)], "k int, c string, v int")
    s = spark.createDataFrame([(1, 10)], "k int, f int")
    out = sinks.merge_update(t, s, "k", F.col("c") == "a", {"v": F.col("v") * F.col("src_f")})
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, "a", 10), (1, "b", 2), (2, "a", 3), (None, "a", 4)], key=repr)


def test_replace_slices_leaves_others(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int")
    sinks.replace_slices(df, str(tmp_path / "t"), ["p"])
    sinks.replace_slices(spark.createDataFrame([("x", 9)], "p string, v int"), str(tmp_path / "t"), ["p"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("p", "v").collect()) == [("x", 9), ("y", 2)]


def test_table_modes_and_comments(spark, tmp_path):
    df = sinks.with_comments(spark.createDataFrame([(1,)], "v int"), {"v": "A value."})
    sinks.write_table(df, "t_modes", "overwrite", str(tmp_path / "m"))
    sinks.write_table(df, "t_modes", "append", str(tmp_path / "m"))
    assert spark.table("t_modes").count() == 2
    assert sinks.describe_columns(spark.table("t_modes"), "t_modes") == [("t_modes", "v", "int", "A value.")]
    spark.sql("DROP TABLE t_modes")


def test_shell_columns_and_backfill(spark):
    shell = sinks.empty_shell(spark, SCHEMA)
    assert shell.count() == 0 and len(shell.columns) == 21 and not shell.schema["persona"].nullable
    old = spark.createDataFrame([("a",)], "v string")
    new = sinks.backfill(sinks.add_columns(old, spark.createDataFrame([("b", "x")], "v string, axis string")), {"axis": "firmwide"})
    assert sorted(tuple(r) for r in new.collect()) == [("a", "firmwide"), ("b", "x")]


def test_null_fails_a_check_and_strict_raises(spark):
    res = q.evaluate(None, [q.Check("empty", lambda f: spark.createDataFrame([(None,)], "actual double"), None, 5), q.Check("ok", lambda f: spark.createDataFrame([(3.0,)], "actual double"), 1, 5)])
    assert {r["check"]: r["passed"] for r in res.collect()} == {"empty": False, "ok": True}
    with pytest.raises(AssertionError, match="empty"):
        q.require_all(res)


def test_bounds_lookup_and_default():
    b = q.Bounds({"a": {"b": {"c": [1, None]}}})
    assert b.at("a", "b", "c") == (1, None) and b.at("a", "x", default=(0, 9)) == (0, 9) and b.rows() == [("a.b.c", 1.0, None)]


def prose(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_claims_of_every_kind(spark):
    got = cl.extract_claims(prose(spark, "Up $1,234.50 to $2.5M, 12.5% and 3pp; DSO 40 days; 1,200 employees. v1.2.3% no")).collect()
    assert {(r["kind"], r["value"]) for r in got} == {("dollar", 1234.5), ("dollar", 2.5e6), ("percent", 12.5), ("points", 3.0), ("days", 40.0), ("count", 1200.0)}


def test_parts_scope_and_scale(spark):
    firm = spark.createDataFrame([("dso", 50.0, "days"), ("partners", 100.0, "count"), ("revenue_per_partner", 7.8e6, "dollar")], "name string, value double, kind string")
    p = prose(spark, "Headcount fell by 10 partners, distributed across Tech (3), Tax (2) and Audit (2).", "It fell by 7 partners, distributed across Tech (5) and Tax (2).",
              "DSO of 61 days now.", "DSO of 50.5 days now.", "Seoul DSO of 61 days.", "We earn $210K per partner.", "There are 140 active partners.")
    got = sorted((r["id"], r["type"]) for r in cl.audit(p, firm, ["Seoul"]).collect())
    assert got == [(0, "sum_of_parts_mismatch"), (2, "kpi_drift"), (5, "scale_mismatch"), (6, "subset_exceeds_total")]


def test_prose_against_table(spark):
    p = prose(spark, "Revenue $2.50M, up 12.3%, or 5%.\n| a | $2,501,000 |\n| g | 12.3% |", "Cost $9.00M.\n| a | $2.50M |", "No table $9.00M")
    assert [(r["id"], r["value"]) for r in cl.not_in_table(p).collect()] == [(1, 9e6)]


def test_best_candidates_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    cand = [(i, f"f_{i % 5}_x", rnd.normal(size=8).tolist()) for i in range(300)]
    targ = [(t, f"f_{t}_x", rnd.normal(size=8).tolist()) for t in range(4)]
    got = mp.best_candidates(spark.createDataFrame(targ, "target int, name string, vector array<double>"), spark.createDataFrame(cand, "candidate int, name string, vector array<double>").repartition(5), 5)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    def sim(a, b):
        x, y = set(a.split("_")), set(b.split("_"))
        return 1.0 if a == b else len(x & y) / len(x | y)

    for t, name, v in targ:
        want = [c for _, c in sorted((-(cos(v, w) + 0.4 * sim(name, n)), c) for c, n, w in cand)][:5]
        assert [r["candidate"] for r in got.where(F.col("target") == t).orderBy("rank").collect()] == want


def similar(a, b):
    x, y = set(a.split("_")), set(b.split("_"))
    return 1.0 if a == b else len(x & y) / len(x | y)


def test_every_pair_over_many_blocks(spark):
    """More rows than a block on both sides, null and zero vectors, repeated names, ties."""
    rnd = np.random.default_rng(5)
    vec = lambda i: None if i % 17 == 3 else [0.0] * 6 if i % 17 == 5 else [float(x) for x in rnd.integers(-2, 3, 6)]
    cand, targ = [(i, f"a_{i % 4}_b", vec(i)) for i in range(130)], [(t, f"a_{t % 6}", vec(t)) for t in range(40)]
    c = spark.createDataFrame(cand, "candidate int, name string, vector array<float>").repartition(3)
    t = spark.createDataFrame(targ, "target bigint, name string, vector array<double>").repartition(2)

    def cos(a, b):
        n = (np.linalg.norm(a) * np.linalg.norm(b)) if a and b else 0
        return float(np.dot(a, b)) / n if n else 0.0

    got = {(r.target, r.candidate): (r.score, r.similarity) for r in mp.pair_scores(t, c, block=16).collect()}
    want = {(i, j): (cos(v, w), similar(a, b)) for i, a, v in targ for j, b, w in cand}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    best = mp.best_candidates(t, c, 7, block=16).collect()
    for i in range(40):
        mine = sorted((r for r in best if r.target == i), key=lambda r: r.rank)
        top = sorted((want[i, j][0] + 0.4 * want[i, j][1] for j in range(130)), reverse=True)[:7]
        assert [r.rank for r in mine] == list(range(1, 8)) and np.allclose([r.blended for r in mine], top, atol=1e-9)
        assert all(a.blended > b.blended or a.candidate < b.candidate for a, b in zip(mine, mine[1:]))
    assert mp.best_candidates(t, c.limit(0), 3).count() == 0 and mp.best_candidates(t.limit(0), c, 3).count() == 0


def test_matching_makes_no_job_while_planned(spark):
    t = spark.createDataFrame([(1, "a", [1.0])], "target int, name string, vector array<double>")
    spark.sparkContext.setJobGroup("plan only", "")
    mp.best_candidates(t, t.withColumnRenamed("target", "candidate"), 1)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


ROWS = "table_name string, target int, position int, column_name string, type string"


def test_view_is_compiled_from_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "7")], "k int, v string")
    far = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    required = spark.createDataFrame([("t", i, i, c, kind) for i, (c, kind) in enumerate([("k", "bigint"), ("gap", "date"), ("odd", "int"), ("sum", "int"), ("w", "string"), ("lost", "decimal(9,2)"), ("v", "int")])], ROWS)
    decided = spark.createDataFrame([("t", 0, "one", "one", "k", "mapped"), ("t", 2, "one", "one", "k", "review: low confidence"), ("t", 4, "one", "two", "w", "review: different table"), ("t", 6, "one", "one", "v", "mapped")],
                                    "table_name string, target int, main_source string, source_table string, source_column string, status string")
    reviews = spark.createDataFrame([("t", 3, None, None, "main.k + 1"), ("t", 4, "two", "w", None), ("t", 5, "three", "z", None)], "table_name string, target int, source_table string, source_column string, expression string")
    joins = spark.createDataFrame([("t", "b", "two", "main.k = b.k", "left")], "table_name string, alias string, source_table string, on string, how string")
    rows, sources = mp.mapping_rows(required, decided, reviews), {"one": df, "two": far}
    assert {r.column_name: r.reason for r in mp.refused(rows, joins).collect()} == {"gap": "no source", "odd": "open: review: low confidence", "lost": "source is not joined"}
    with pytest.raises(ValueError, match="3 columns of t"):
        mp.compiled("t", rows, joins, sources)
    with pytest.raises(ValueError, match="no mapping"):
        mp.compiled("other", rows, joins, sources)
    view = mp.compiled("t", rows, joins, sources, allow_gaps=True)
    assert dict(view.dtypes) == {"k": "bigint", "gap": "date", "odd": "int", "sum": "int", "w": "string", "lost": "decimal(9,2)", "v": "int"}
    assert sorted(map(tuple, view.collect()), key=repr) == sorted([(1, None, None, 2, "x", None, None), (1, None, None, 2, "y", None, None), (2, None, None, 3, None, None, 7)], key=repr)


def test_lookup_falls_back_to_firmwide(spark):
    ins = spark.createDataFrame([("hr", "region", "ASIA", 1), ("hr", "firmwide", "all", 2)], "persona string, filter_axis string, filter_value string, v int")
    req = spark.createDataFrame([(1, "hr", "region", "ASIA"), (2, "hr", "region", "MARS")], "request_id int, persona string, filter_axis string, filter_value string")
    assert sorted((r["request_id"], r["v"]) for r in lookup(req, ins).collect()) == [(1, 1), (2, 2)]


def test_named_measures_refuse_wrong_table(spark, small):
    firm = Firm.sample(spark, small)
    assert len(FILTERS) == 15 and len(MEASURES) == 17
    with pytest.raises(ValueError, match="no hours_worked"):
        MEASURES["Utilization Rate"].on(firm.raw("nation"), firm)
    with pytest.raises(ValueError, match="no dimension"):
        metric_view(firm, ["colour"])


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def by_part(spark, path, rows):
    df = spark.createDataFrame(rows, "k int, v string, p string")
    sinks.rebuild(df, str(path), "p")
    return df.schema


def test_rebuild_without_rebalance_writes_rows_where_they_lie(spark, tmp_path):
    df = spark.range(0, 60, 1, 4).selectExpr("id", "id % 3 AS p")
    for rebalance, most in ((False, 12), (True, 3)):
        sinks.rebuild(df, str(tmp_path / str(rebalance)), "p", rebalance)
        assert len(files(tmp_path / str(rebalance))) == most
        assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / str(rebalance))).select("id").collect()) == list(range(60))


def test_files_of_a_dealt_table_do_not_grow_with_shuffle_partitions(spark, tmp_path):
    small = {sinks.TASK_SIZE: "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "40"}
    with sinks.session_set(spark, small):
        rows = spark.range(20000).groupBy((F.col("id") % 5000).alias("id")).agg(F.count("id").alias("n")).withColumn("p", F.col("id") % 3)
        sinks.rebuild(rows, str(tmp_path / "t"), "p", False)
        assert len(files(tmp_path / "t")) <= 3 * 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get(sinks.TASK_SIZE) == "1k"
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.count("id"), F.sum("n")).first()[:] == (5000, 20000)
    assert [sinks.byte_count(x) for x in ("7", "1k", "8m", "64MB", "67108864b", " 2 GiB ")] == [7, 1 << 10, 8 << 20, 64 << 20, 64 << 20, 2 << 30]


def test_tables_are_not_built_by_code_that_java_leaves_uncompiled(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(int(spark.conf.get(sinks.LONGEST_METHOD))), write(self, path)))
    before = spark.conf.get(sinks.LONGEST_METHOD)
    wide = spark.range(50).select("id", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))).alias(f"c{i}") for i in range(200)])
    for name, by in (("flat", None), ("parts", "p")):
        sinks.rebuild(wide.withColumn("p", F.col("id") % 2), str(tmp_path / name), by)
        got = spark.read.parquet(str(tmp_path / name)).where("id = 7").select("c0", "c199").first()
        assert tuple(got) == (hashlib.md5(b"70").hexdigest(), hashlib.md5(b"7199").hexdigest())
    with sinks.session_set(spark, {sinks.LONGEST_METHOD: "500"}):
        sinks.rebuild(spark.range(5), str(tmp_path / "less"))
    assert seen == [8000, 8000, 500] and spark.conf.get(sinks.LONGEST_METHOD) == before


def test_rebuilt_tables_are_packed_by_zstd(spark, tmp_path):
    df = spark.range(100).withColumn("m", F.col("id") % 2)
    for name, by in (("flat", None), ("parts", "m")):
        sinks.rebuild(df, str(tmp_path / name), by)
        written = list((tmp_path / name).rglob("*.parquet"))
        assert written and all(x.name.endswith(".zstd.parquet") for x in written)
        assert spark.read.parquet(str(tmp_path / name)).count() == 100


def test_rebuild_leaves_no_shuffle_files(spark, tmp_path):
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, conf = files(), spark.conf.get(sinks.DROP_SHUFFLES)
    rows = spark.range(5000).repartition(7).groupBy((F.col("id") % 5).alias("p")).agg(F.count("id").alias("n"))
    sinks.rebuild(rows, str(tmp_path / "t"), "p")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(sinks.DROP_SHUFFLES) == conf
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("p", "n").collect()) == [(p, 1000) for p in range(5)]


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "t"
    schema = by_part(spark, path, [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None)])
    before, opened = files(path), spark.read.schema(schema).parquet(str(path))
    opened.count()
    n = sinks.merge_into(spark, str(path), schema, spark.createDataFrame([(2, "B"), (4, "D"), (9, "no")], "k int, n string"), "k", F.lit(True), {"v": F.col("src_n")}, "p")
    after = files(path)
    assert n == 2 and {f for f in before if f.startswith("p=y")} == {f for f in after if f.startswith("p=y")} and not {f for f in before if f.startswith("p=x")} & after
    assert sorted(map(tuple, spark.read.schema(schema).parquet(str(path)).collect()), key=repr) == sorted([(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (4, "D", None)], key=repr)
    assert sinks.merge_into(spark, str(path), schema, spark.createDataFrame([(7, "n")], "k int, n string"), "k", F.lit(True), {"v": F.col("src_n")}, "p") == 0 and files(path) == after
    with pytest.raises(ValueError, match="partition column"):
        sinks.merge_into(spark, str(path), schema, opened, "k", F.lit(True), {"p": F.col("k")}, "p")


def test_table_is_whole_while_a_merge_fails(spark, tmp_path):
    path = tmp_path / "t"
    schema = by_part(spark, path, [(i, "a", "xy"[i % 2]) for i in range(20)])
    before = files(path)
    bad = F.raise_error(F.lit("no")).cast("string")
    with pytest.raises(Exception, match="no"):
        sinks.merge_into(spark, str(path), schema, spark.createDataFrame([(2, "n")], "k int, n string"), "k", F.lit(True), {"v": bad}, "p")
    assert files(path) == before and spark.read.schema(schema).parquet(str(path)).count() == 20


def test_upsert_moves_rows_between_partitions(spark, tmp_path):
    path = tmp_path / "t"
    schema = by_part(spark, path, [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z")])
    kept = {f for f in files(path) if f.startswith("p=x")}
    n = sinks.upsert_into(spark, str(path), schema, spark.createDataFrame([("Y", 3, "C"), ("z", 9, "i")], "p string, k int, v string"), ["k"], "p")
    assert n == 3 and {f for f in files(path) if f.startswith("p=x")} == kept and not (path / "p=y").exists()
    assert sorted(map(tuple, spark.read.schema(schema).parquet(str(path)).collect())) == [(1, "a", "x"), (2, "b", "x"), (3, "C", "Y"), (4, "d", "z"), (9, "i", "z")]


def test_hot_partition_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(200_000).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("p")).repartition(6)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.rebuild(df, path, "p")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len([f for f in files(tmp_path / "t") if f.startswith("p=hot")]) > 1


def test_stored_table_evolves_without_rewriting(spark, tmp_path):
    path = tmp_path / "t"
    sinks.append_evolving(spark.createDataFrame([(1, "a")], "k int, v string"), str(path))
    before = files(path)
    sinks.append_evolving(spark.createDataFrame([(2.5, 2, "b")], "w double, k int, v string"), str(path))
    sinks.append_evolving(spark.createDataFrame([(3,)], "k int"), str(path))
    schema = sinks.append_evolving(spark.createDataFrame([(4, "mine")], "k int, axis string"), str(path), {"axis": "firmwide"})
    assert before <= files(path) and [f.name for f in schema.fields] == ["k", "v", "w", "axis"]
    assert sorted(map(tuple, sinks.read_evolving(spark, str(path)).collect())) == [(1, "a", None, "firmwide"), (2, "b", 2.5, "firmwide"), (3, None, None, "firmwide"), (4, None, None, "mine")]
    with pytest.raises(ValueError, match="k is int, not string"):
        sinks.append_evolving(spark.createDataFrame([("x",)], "k string"), str(path))
    with pytest.raises(ValueError, match="not new: v"):
        sinks.append_evolving(spark.createDataFrame([(1,)], "k int"), str(path), {"v": "x"})


def test_comments_come_back_from_the_files(spark, tmp_path):
    sinks.with_comments(spark.createDataFrame([(1, "a")], "k int, v string"), {"k": "The key."}).write.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, sinks.stored_comments(spark, {"t": str(tmp_path / "t")}).collect())) == [("t", "k", "int", "The key."), ("t", "v", "string", "")]


def test_inventory_survives_broken_tables(spark, tmp_path):
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "good"))
    spark.range(50).repartition(2).write.parquet(str(tmp_path / "cut"))
    for part in list((tmp_path / "cut").glob("*.parquet")):
        part.write_bytes(part.read_bytes()[:40])
    (tmp_path / "empty").mkdir()
    got = {r.table_name: r.row_count for r in inventory(spark, {n: str(tmp_path / n) for n in ("good", "cut", "empty", "absent")}).collect()}
    assert got == {"good": 50, "cut": -1, "empty": -1, "absent": -1}


def test_quantiles_at_several_positions(spark):
    rnd = np.random.default_rng(1)
    values = [*rnd.normal(size=5000).tolist(), *[1.5] * 3000, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    places = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    got = exact_quantiles(df, "v", places).first()
    want = np.quantile([v for v in values if v is not None], list(places.values()))
    assert np.allclose([got[c] for c in places], want, rtol=0, atol=1e-12)
    assert tuple(exact_quantiles(df.limit(0), "v", places).first()) == (None,) * 6


def test_bound_without_a_value_fails_and_each_member_is_judged(spark):
    tree = {"s": {"one": [0, 5], "gone": [None, 1], "share": {"*": [10, 50], "a": [10, 20], "z": [1, 2]}, "none": {"*": [0, 1]}}}
    bounds = spark.createDataFrame(env.bound_rows(tree), env.LIMITS)
    actual = spark.createDataFrame([("s.one", "", 5.0), ("s.share", "a", 30.0), ("s.share", "b", 60.0), ("s.other", "", 1.0)], env.ROWS)
    got = sorted((r.path, r.member, r.lo, r.hi, r.actual, r.passed) for r in env.judged(bounds, actual).fillna({"lo": -1.0, "hi": -1.0, "actual": -1.0}).collect())
    assert got == sorted([("s.one", "", 0.0, 5.0, 5.0, True), ("s.gone", "", -1.0, 1.0, -1.0, False), ("s.share", "a", 10.0, 50.0, 30.0, True), ("s.share", "b", 10.0, 50.0, 60.0, False),
                          ("s.share", "a", 10.0, 20.0, 30.0, False), ("s.share", "z", 1.0, 2.0, -1.0, False), ("s.none", "*", 0.0, 1.0, -1.0, False)])


def test_enum_columns_come_from_the_schema(spark):
    n = 3000
    df = spark.range(n).select(*[F.concat(F.lit("v"), F.col("id") % k).alias(f"c{k}") for k in (1, 2, 3, 1023, 1024, 1025, 1100, 2000)], F.lit(None).cast("string").alias("nulls"), F.col("id").alias("number"), F.lit("x").alias("vendor_name"))
    got = enum_columns({"t": df, "none": spark.range(3)})
    assert {(r.table_name, r.column_name): r.distinct_values for r in got.collect()} == {("t", f"c{k}"): k for k in (2, 3, 1023, 1024)}
    assert {r.column_name: r.distinct_values for r in distinct_profile(df).collect()} == {**{f"c{k}": k for k in (1, 2, 3, 1023, 1024, 1025, 1100, 2000)}, "nulls": 0, "vendor_name": 1}
