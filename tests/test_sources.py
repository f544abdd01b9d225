import json

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave import scratch
from evalweave.operators import generations, lookup, scoring
from evalweave.sources import arrow_ipc, documents, json_files, tables
from evalweave.streaming import live_scores


def _table(n):
    return pa.table({"id": pa.array(range(n), pa.int64()), "solution": [f"s{i}" for i in range(n)], "unused": [1.0] * n})


def _write_file(path, table, rows):
    with pa.OSFile(str(path), "wb") as sink, ipc.new_file(sink, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=rows):
            writer.write_batch(batch)


def test_arrow_files_and_streams(spark, tmp_path):
    table = _table(100)
    _write_file(tmp_path / "a.arrow", table.slice(0, 60), 7)
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as sink, ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.slice(60), max_chunksize=7)
    (tmp_path / "_staged-x").write_text("left by a lost task")
    df = arrow_ipc.read_arrow(spark, str(tmp_path))
    assert df.columns == ["id", "solution", "unused"]
    assert sorted(r.id for r in df.collect()) == list(range(100))
    narrow = arrow_ipc.read_arrow(spark, str(tmp_path), "solution string, id bigint")
    assert {(r.id, r.solution) for r in narrow.collect()} == {(i, f"s{i}") for i in range(100)}


def test_arrow_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    _write_file(tmp_path / "a.arrow", _table(1000), 50)
    monkeypatch.setattr(arrow_ipc, "SPLIT_BYTES", 4096)
    df = arrow_ipc.read_arrow(spark, str(tmp_path), position=True)
    assert df.rdd.getNumPartitions() > 2
    rows = df.orderBy("file_name", "file_pos").collect()
    assert [r.id for r in rows] == list(range(1000))


def test_row_numbers_over_files(spark, tmp_path):
    table = _table(100)
    _write_file(tmp_path / "a.arrow", table.slice(0, 33), 10)
    _write_file(tmp_path / "b.arrow", table.slice(33, 1), 10)
    _write_file(tmp_path / "c.arrow", table.slice(34), 7)
    df = arrow_ipc.read_arrow(spark, str(tmp_path), position=True).withColumnRenamed("id", "value")
    numbered = arrow_ipc.number_rows(df)
    assert numbered.columns == ["value", "solution", "unused", "id"]
    assert all(r.id == r.value for r in numbered.collect())


def test_first_solution_of_an_arrow_file(spark, tmp_path):
    table = pa.table({"id": [2, 1, 2, 1], "solution": ["a", "b", "c", "d"]})
    _write_file(tmp_path / "a.arrow", table, 1)
    df = arrow_ipc.read_arrow(spark, str(tmp_path), position=True)
    firsts = lookup.first_solutions(df.withColumn("sol_idx", F.struct("file_name", "file_pos")))
    assert {r.id: r.solution for r in firsts.collect()} == {1: "b", 2: "a"}


def test_arrow_round_trip(spark, tmp_path):
    df = spark.range(500).withColumn("x", F.col("id").cast("string"))
    path = str(tmp_path / "out")
    arrow_ipc.write_arrow(df.repartition(3), path)
    arrow_ipc.write_arrow(df.filter("id < 0"), path)
    assert sorted(map(tuple, arrow_ipc.read_arrow(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_arrow_paths(spark, tmp_path, prefix):
    path = prefix + str(tmp_path / "out")
    arrow_ipc.write_arrow(spark.range(5), path)
    assert arrow_ipc.read_arrow(spark, path).count() == 5


def test_missing_arrow_folder(spark, tmp_path):
    with pytest.raises(Exception, match="nothing-here"):
        arrow_ipc.read_arrow(spark, str(tmp_path / "nothing-here")).collect()


def test_generation_files(spark, tmp_path):
    for task in (12, 7):
        entries = [{"generated_text": f"{task}-{i}\n"} for i in range(3)]
        (tmp_path / f"{task}_inference.json").write_text(json.dumps(entries, indent=1))
    df = documents.read_generation_files(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted((t, i, f"{t}-{i}\n") for t in (12, 7) for i in range(3))


def test_parsed_files_last_entry(spark, tmp_path):
    doc = [{"task_id": 1, "output": ["a", "b"]}, {"task_id": 2, "output": []}, {"task_id": 1, "output": ["c"]}]
    (tmp_path / "x.json").write_text(json.dumps(doc))
    entries = documents.read_parsed_files(spark, str(tmp_path))
    assert sorted(map(tuple, generations.last_entry_per_task(entries).collect())) == [(1, 0, "c")]


def test_hot_task_is_written_as_many_lines(spark, tmp_path):
    parsed = spark.range(2500).select(F.lit(1).cast("bigint").alias("task_id"), F.col("id").alias("gen_idx"), F.lit("x").alias("code"))
    path = str(tmp_path / "parsed")
    documents.write_parsed(parsed, path)
    assert spark.read.text(path).count() == 3
    assert sorted(map(tuple, documents.read_parsed(spark, path).collect())) == [(1, i, "x") for i in range(2500)]


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"task_id": 1, "gen_idx": 0, "generated_text": "x"}\n{"task_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.read_generations(spark, str(tmp_path)).collect()


def test_manifest_documents(spark, tmp_path):
    rows = [("g", 5, 0, 9, 1), ("g", 5, 0, 8, 0), ("g", 4, 1, None, None), ("h", 1, 0, 2, 0)]
    manifest = spark.createDataFrame(rows, "grp string, target_id bigint, target_pos int, context_id bigint, context_pos int")
    docs = {r.grp: json.loads(r.document) for r in documents.manifest_documents(manifest).collect()}
    assert docs["g"] == {"input_ids": [5, 4], "context_ids": {"5": [8, 9], "4": []}}
    path = str(tmp_path / "m")
    documents.write_manifest(manifest, path)
    back = documents.read_manifest(spark, path).select(*manifest.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("nested", [True, False])
def test_manifest_files(spark, tmp_path, nested):
    by_group = {"g": {"5": [8, 9], "4": []}, "h": {"1": [2]}}
    contexts = by_group if nested else {k: v for group in by_group.values() for k, v in group.items()}
    document = {"input_ids": {"g": [5, 4], "h": [1]}, "context_ids": contexts}
    (tmp_path / "whole.json").write_text(json.dumps(document, indent=4))
    rows = documents.read_manifest_files(spark, str(tmp_path / "whole.json"), nested, whole=True)
    want = [("g", 4, 1, None, None), ("g", 5, 0, 0, 8), ("g", 5, 0, 1, 9), ("h", 1, 0, 0, 2)]
    assert sorted(map(tuple, rows.collect()), key=repr) == want
    documents.write_manifest_files(rows, str(tmp_path / "lines"), nested)
    again = documents.read_manifest_files(spark, str(tmp_path / "lines"), nested)
    assert sorted(map(tuple, again.collect()), key=repr) == want


def test_sizes_are_measured_by_schema(spark):
    df = spark.sql("select id, repeat('x', 100) as t, array(1, 2) as a, struct(id as b) as s from range(10)")
    written = scratch.write(df, "sized", largest="id")
    assert (written.rows, written.largest) == (10, 9)
    assert written.bytes == 10 * (8 + 100 + 16 + len('{"s":{"b":0}}'))
    nothing = scratch.write(df.limit(0), "sized")
    assert (nothing.rows, nothing.bytes) == (0, 0)


def test_metrics_documents(spark):
    totals = spark.createDataFrame([(3, 2, 1, 0.25)], "task_id bigint, n bigint, c bigint, total double")
    positions = spark.createDataFrame([(3, 1, 0), (3, 0, 2)], "task_id bigint, test_idx int, n_passed bigint")
    doc = json.loads(documents.metrics_documents(totals, positions).first().metrics)
    assert doc == {
        "k_pass": {"pass@1": 0.5, "detail": {"pass@1": {"3": 0.5}}},
        "normalized_sum": {"tests": [2, 0], "total": 0.25},
    }
    every = json.loads(documents.metrics_documents(totals, positions, [1, 2, 3]).first().metrics)
    assert every["k_pass"] == {"pass@1": 0.5, "pass@2": 1.0, "detail": {"pass@1": {"3": 0.5}, "pass@2": {"3": 1.0}}}


def test_point_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "tests")
    spark.createDataFrame([(1, 0, "a", "b"), (2, 0, "c", "d")], "id bigint, test_idx int, input string, expected string").write.parquet(path)
    df = tables.read_tests(spark, path, problem_id=2)
    assert [r.input for r in df.collect()] == ["c"]
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in df._jdf.queryExecution().toString()


def test_renamed_columns_are_pruned_and_pushed(spark):
    names = {"id": "doc_id", "difficulty": "lang", "tags": "source", "input": "text"}
    df = tables.read_problems(spark, "/root/testdata/sf0.001/documents.parquet", names)
    plan = df.filter("difficulty = 'en'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_runs_are_appended(spark, tmp_path):
    path = str(tmp_path / "runs")
    one = spark.range(1)
    tables.append_runs(one, path)
    assert tables.append_runs(one, path).count() == 2


def test_verdicts_by_treatment(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    df = spark.createDataFrame([("no_context", 1), ("full_problem", 0)], "context_type string, verdict int")
    tables.write_verdicts(df, path)
    pruned = spark.read.parquet(path).filter("context_type = 'no_context'")
    assert len(pruned.inputFiles()) == 2 and pruned.count() == 1
    assert "PartitionFilters: [isnotnull(context_type" in pruned._jdf.queryExecution().toString()


def test_live_scores(spark, tmp_path):
    folder, log, checkpoint = (str(tmp_path / n) for n in ("results", "log", "checkpoint"))
    first = [(1, 0, [1, 1]), (1, 1, [1, 0]), (2, 0, [0])]
    second = [(1, 2, [-2]), (3, 0, [])]
    schema = live_scores.RESULTS
    for trigger, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        live_scores.start(live_scores.read_results(spark, folder), checkpoint, log).awaitTermination()
    logged = spark.read.parquet(log).collect()
    assert {(r.trigger, r.task_id) for r in logged} == {(0, 1), (0, 2), (1, 1), (1, 3)}
    latest = {r.task_id: r for r in sorted(logged, key=lambda r: r.trigger)}
    batch = live_scores.live_scores(spark.createDataFrame(first + second, schema)).collect()
    for r in batch:
        assert (r.n, r.c, r.pass_at_1, r.normalized_sum) == (
            latest[r.task_id].n,
            latest[r.task_id].c,
            latest[r.task_id].pass_at_1,
            latest[r.task_id].normalized_sum,
        )
    assert latest[1].normalized_sum == pytest.approx(3 / 6)
    now = {r.task_id: r.n for r in live_scores.latest_scores(spark, log).collect()}
    assert now == {1: 3, 2: 1, 3: 1}


def test_shared_folder_is_the_clusters(spark):
    assert scratch.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_text_between_values():
    steps = [None, ("a", "x"), ("a", "x"), ("a", "y"), ("b", "x", "1"), ("b", "x", "2"), ("c",), None]
    texts = [json_files.between(p, q) for p, q in zip(steps, steps[1:])]
    document = "".join(t + (str(i) if q else "") for i, (t, q) in enumerate(zip(texts, steps[1:])))
    assert json.loads(document) == {"a": {"x": [0, 1], "y": [2]}, "b": {"x": {"1": [3], "2": [4]}}, "c": [5]}
    assert json_files.between(None, ()) + "1" + json_files.between((), ()) + "2" + json_files.between((), None) == "[1,2]"
    with pytest.raises(ValueError):
        json_files.between(("a",), ("a", "b"))


def test_a_hot_task_is_one_file_of_many_tasks(spark, tmp_path):
    """A task with most generations is written in parts, which the commit joins in order."""
    sizes = {1: 3, 2: 4000, 3: 1, 4: 2, 5: 1}
    rows = [(t, i, f'"{t}"\n\\ é {i}') for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "task_id bigint, gen_idx bigint, generated_text string").repartition(5)
    path = tmp_path / "generations"
    documents.write_generation_files(df, str(path))
    files = {int(p.name.split("_")[0]): json.loads(p.read_text()) for p in path.glob("*.json")}
    assert files == {t: [{"generated_text": r[2]} for r in rows if r[0] == t] for t in sizes}
    assert {p.name for p in path.iterdir()} == {f"{t}_inference.json" for t in sizes}
    assert sorted(map(tuple, documents.read_generation_files(spark, str(path)).collect())) == sorted(rows)
    parsed = df.withColumnRenamed("generated_text", "code")
    documents.write_parsed_files(parsed, str(tmp_path / "parsed"))
    entries = documents.read_parsed_files(spark, str(tmp_path / "parsed"))
    assert sorted(map(tuple, generations.last_entry_per_task(entries).collect())) == sorted(rows)


@pytest.mark.parametrize("nested", [True, False])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_one_manifest_document(spark, tmp_path, nested, parts):
    rows = [(g, 10 * k + t, t, c, 100 + c) for k, g in enumerate("ghij") for t in range(5) for c in range(4)]
    rows += [('a "b"', 99, 0, None, None)]
    manifest = spark.createDataFrame(
        rows, "grp string, target_id bigint, target_pos int, context_pos int, context_id bigint"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    documents.write_manifest_document(manifest, str(tmp_path), nested)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    document = json.loads((tmp_path / "partition.json").read_text())
    assert document["input_ids"]["h"] == [10, 11, 12, 13, 14] and document["input_ids"]['a "b"'] == [99]
    of_target = document["context_ids"]["h"] if nested else document["context_ids"]
    assert of_target["12"] == [100, 101, 102, 103]
    back = documents.read_manifest_files(spark, str(tmp_path), nested, whole=True).select(*manifest.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_metrics_files_hold_the_results(spark, tmp_path):
    verdicts = spark.createDataFrame(
        [(7, 0, 0, 1), (7, 0, 1, 0), (7, 1, 0, 1), (7, 1, 1, 1), (9, 0, 0, -2)],
        "task_id bigint, gen_idx bigint, test_idx int, verdict int",
    )
    totals = scoring.normalized_sum(scoring.task_totals(verdicts))
    positions = scoring.tests_passed_by_position(verdicts)
    documents.write_metrics_files(totals, positions, scoring.collect_results(verdicts), str(tmp_path), [1])
    assert json.loads((tmp_path / "7_metrics.json").read_text()) == {
        "k_pass": {"pass@1": 0.5, "detail": {"pass@1": {"7": 0.5}}},
        "normalized_sum": {"tests": [2, 1], "total": 0.75},
        "results": {"7": [[1, 0], [1, 1]]},
    }
    back = documents.read_metrics_files(spark, str(tmp_path), [1])
    assert sorted((r.task_id, r.gen_pos, r.pass_at_1, r.verdicts) for r in back.collect()) == [
        (7, 0, 0.5, [1, 0]), (7, 1, 0.5, [1, 1]), (9, 0, 0.0, [-2])
    ]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    bad = spark.range(10).select(
        F.lit("x.json").alias("file"), F.lit("").alias("head"), F.lit("").alias("tail"),
        F.when(F.col("id") < 5, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("path"),
        F.col("id").cast("string").alias("value"), "id",
    )
    with pytest.raises(Exception, match="cannot be in one document"):
        json_files.write(bad.coalesce(1), str(tmp_path), ["id"])
    assert not list(tmp_path.glob("*.json"))


def _batches(spark, path, condition):
    """Record batches that a filtered read takes, of all there are."""
    schema = StructType.fromDDL("id bigint, name string, x double, day date")
    reader = arrow_ipc.ArrowIpcReader(path, schema)
    reader.pushFilters(condition)
    plans = reader.partitions()
    rows = [b for plan in plans for b in reader.read(plan)]
    return len(rows), sorted(v for b in rows for v in b.column(0).to_pylist())


def test_batches_that_no_row_can_be_in_are_skipped(spark, tmp_path, monkeypatch):
    import datetime

    from pyspark.sql import datasource as ds

    monkeypatch.setattr(arrow_ipc, "SPLIT_BYTES", 4096)
    monkeypatch.setattr(arrow_ipc, "FILE_BYTES", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    df = spark.range(100).select(
        "id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"),
        F.when(F.col("id") < 50, F.col("id") / 2).alias("x"),
        F.date_add(F.lit(datetime.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"),
    )
    path = str(tmp_path / "out")
    arrow_ipc.write_arrow(df.coalesce(1), path)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list((tmp_path / "out").iterdir())) > 1
    for condition, batches in [
        ([], 10), ([ds.EqualTo(("id",), 42)], 1), ([ds.GreaterThan(("id",), 69)], 3), ([ds.LessThanOrEqual(("id",), 10)], 2),
        ([ds.In(("id",), (5, 95, 500))], 2), ([ds.EqualTo(("name",), "n042")], 1), ([ds.StringStartsWith(("name",), "n04")], 1),
        ([ds.IsNull(("x",))], 5), ([ds.IsNotNull(("x",))], 5), ([ds.LessThan(("x",), 5.0)], 1),
        ([ds.EqualTo(("day",), datetime.date(2024, 1, 16))], 1), ([ds.EqualTo(("id",), -1)], 0),
        ([ds.GreaterThanOrEqual(("id",), 30), ds.LessThan(("id",), 50)], 2), ([ds.EqualTo(("unknown",), 1)], 10),
    ]:
        assert _batches(spark, path, condition)[0] == batches, condition
    got = arrow_ipc.read_arrow(spark, path).filter("id between 35 and 44 and name <> 'n040'")
    assert sorted(r.id for r in got.collect()) == [i for i in range(35, 45) if i != 40]


def test_plans_open_no_file(tmp_path, monkeypatch):
    for name in "ab":
        _write_file(tmp_path / f"{name}.arrow", _table(1000), 50)
    monkeypatch.setattr(arrow_ipc, "SPLIT_BYTES", 4096)
    monkeypatch.setattr(arrow_ipc.ipc, "open_file", None)
    reader = arrow_ipc.ArrowIpcReader(str(tmp_path), StructType.fromDDL("id bigint"))
    plans = reader.partitions()
    monkeypatch.undo()
    assert len(plans) > 4
    assert sorted(v for p in plans for b in reader.read(p) for v in b.column(0).to_pylist()) == sorted(2 * list(range(1000)))


def test_runs_logged_again_replace_themselves(spark, tmp_path):
    path, key = str(tmp_path / "log"), ["grp", "task_id"]
    schema = "grp string, task_id bigint, score double"
    rows = [(g, t, float(t)) for g in "ab" for t in range(100)]
    first = tables.log_runs(spark.createDataFrame(rows, schema), path, key)
    assert first.count() == 200
    again = [("a", 3, -1.0), ("b", 500, 5.0)]
    for _ in range(2):
        log = tables.log_runs(spark.createDataFrame(again, schema), path, key)
        want = {(g, t): s for g, t, s in rows} | {(g, t): s for g, t, s in again}
        assert sorted(map(tuple, log.collect())) == sorted((*k, s) for k, s in want.items())


def test_only_touched_parts_of_the_log_are_written(spark, tmp_path):
    path = tmp_path / "log"
    schema = "grp string, task_id bigint, score double"
    tables.log_runs(spark.createDataFrame([("a", t, 0.0) for t in range(500)], schema), str(path), ["grp", "task_id"])
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    tables.log_runs(spark.createDataFrame([("a", 7, 1.0)], schema), str(path), ["grp", "task_id"])
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len(before) > 30 and len(set(before.items()) & set(after.items())) == len(before) - 1


def test_stored_verdicts_are_aggregated_where_they_lie(spark, tmp_path):
    by = ("context_type", "task_id")
    rows = [(c, t, g, i, (t + g + i) % 2) for c in ("x", "y") for t in range(6) for g in range(4) for i in range(3)]
    verdicts = spark.createDataFrame(
        rows, "context_type string, task_id bigint, gen_idx bigint, test_idx int, verdict int"
    )
    path = str(tmp_path / "verdicts")
    tables.write_verdicts(verdicts, path, by, 4)
    stored = tables.read_verdicts(spark, path, verdicts.schema, by, 4)
    per_generation = scoring.generation_correct(stored, by)
    assert "Exchange" not in per_generation._jdf.queryExecution().executedPlan().toString()
    totals = scoring.task_totals(stored, by)
    # One exchange: of totals, which were combined before it.
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("partial_count")
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, scoring.task_totals(verdicts, by).collect()))
    # Another session finds the table by its path alone.
    spark.sql(f"drop table {tables._table(path)}")
    again = tables.read_verdicts(spark, path, verdicts.schema, by, 4)
    assert sorted(map(tuple, again.select(verdicts.columns).collect())) == sorted(rows)
    assert "Exchange" not in scoring.generation_correct(again, by)._jdf.queryExecution().executedPlan().toString()
