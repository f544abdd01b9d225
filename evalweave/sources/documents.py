"""JSON documents: generations, parsed code, manifests, metrics.

Large tables are exchanged as JSON lines, which split. The documents of single runs, an array
file per task and one document per manifest, are written and read too, one file per row.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.functions import passk
from evalweave.operators import skew
from evalweave.sources import json_files

KS = (1, 10, 100)

# Outputs per line of the parsed export: a hot task becomes many lines.
OUTPUTS_PER_LINE = 1000


def write_generations(generations: DataFrame, path: str) -> None:
    generations.select("task_id", "gen_idx", "generated_text").write.json(path)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GENERATIONS).option("mode", "FAILFAST").json(path)


def read_generation_files(spark: SparkSession, path: str) -> DataFrame:
    """Files named by task id, each holding one array of ``generated_text`` objects."""
    texts = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    entries = F.from_json("value", "array<struct<generated_text:string>>", {"mode": "FAILFAST"})
    return texts.select(
        F.regexp_extract(name, r"^(\d+)", 1).cast("bigint").alias("task_id"),
        F.posexplode(entries).alias("gen_idx", "entry"),
    ).select("task_id", F.col("gen_idx").cast("bigint").alias("gen_idx"), "entry.generated_text")


def _empty() -> Column:
    return F.array().cast("array<string>")


def write_generation_files(generations: DataFrame, path: str) -> None:
    """A file per task, named by its id: an array of ``generated_text`` objects by ``gen_idx``."""
    values = generations.select(
        F.concat(F.col("task_id").cast("string"), F.lit("_inference.json")).alias("file"),
        F.lit("").alias("head"),
        F.lit("").alias("tail"),
        _empty().alias("path"),
        F.to_json(F.struct("generated_text"), {"ignoreNullFields": "false"}).alias("value"),
        "gen_idx",
    )
    json_files.write(values, path, ["gen_idx"])


def write_parsed_files(parsed: DataFrame, path: str) -> None:
    """A file per task with one entry, ``[{"task_id", "output": [code]}]``, code by ``gen_idx``."""
    task = F.col("task_id").cast("string")
    values = parsed.select(
        F.concat(task, F.lit("_parsing.json")).alias("file"),
        F.concat(F.lit('[{"task_id":'), task, F.lit(',"output":')).alias("head"),
        F.lit("}]").alias("tail"),
        _empty().alias("path"),
        _json_text(F.col("code")).alias("value"),
        "gen_idx",
    )
    json_files.write(values, path, ["gen_idx"])


def _json_text(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Lines ``{"task_id", "part", "gens", "output"}`` with bounded lists.

    ``parsed`` has dense ``gen_idx`` or not; each line keeps the indices.
    """
    line = F.struct("gen_idx", "code")
    grouped = (
        parsed.withColumn("part", F.floor(F.col("gen_idx") / OUTPUTS_PER_LINE))
        .groupBy("task_id", "part")
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
    )
    grouped.select(
        "task_id", "part", F.col("lines.gen_idx").alias("gens"), F.col("lines.code").alias("output")
    ).write.json(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Long rows from the lines ``write_parsed`` makes."""
    lines = (
        spark.read.schema("task_id bigint, part bigint, gens array<bigint>, output array<string>")
        .option("mode", "FAILFAST")
        .json(path)
    )
    return lines.select("task_id", F.explode(F.arrays_zip("gens", "output")).alias("row")).select(
        "task_id", F.col("row.gens").alias("gen_idx"), F.col("row.output").alias("code")
    )


def read_parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``[{"task_id", "output": [code]}]`` as entries for ``last_entry_per_task``."""
    texts = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "array<struct<task_id:bigint,output:array<string>>>", {"mode": "FAILFAST"})
    opened = texts.select(F.posexplode(entries).alias("entry_pos", "entry"))
    return opened.select(
        F.col("entry.task_id").alias("task_id"),
        "entry_pos",
        F.posexplode("entry.output").alias("gen_idx", "code"),
    )


def _targets(manifest: DataFrame) -> DataFrame:
    """Per group, ``targets`` in order and ``contexts``, the ids of each by target.

    A row is as long as the manifest's sample of the group.
    """
    found = F.filter(
        F.sort_array(F.collect_list(F.struct("context_pos", "context_id"))),
        lambda x: x["context_id"].isNotNull(),
    )
    per_target = manifest.groupBy("grp", "target_id", "target_pos").agg(
        F.transform(found, lambda x: x["context_id"]).alias("ids")
    )
    per_group = per_target.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("target_pos", "target_id", "ids"))).alias("targets")
    )
    pairs = F.transform(
        "targets", lambda t: F.struct(t["target_id"].cast("string").alias("key"), t["ids"].alias("value"))
    )
    return per_group.select(
        "grp",
        F.transform("targets", lambda t: t["target_id"]).alias("targets"),
        F.map_from_entries(pairs).alias("contexts"),
    )


def _with_contexts(targets: DataFrame, by_target: str) -> DataFrame:
    ids = F.try_element_at(by_target, F.col("target_id").cast("string"))
    return targets.select(
        "grp", "target_id", "target_pos", F.posexplode_outer(ids).alias("context_pos", "context_id")
    )


def manifest_documents(manifest: DataFrame) -> DataFrame:
    """One document per group: its target ids and each target's context ids."""
    document = F.struct(F.col("targets").alias("input_ids"), F.col("contexts").alias("context_ids"))
    return _targets(manifest).select("grp", F.to_json(document).alias("document"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest_documents(manifest).write.json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Long manifest rows from the documents of ``write_manifest``."""
    lines = spark.read.schema("grp string, document string").option("mode", "FAILFAST").json(path)
    document = F.from_json(
        "document", "input_ids array<bigint>, context_ids map<string,array<bigint>>", {"mode": "FAILFAST"}
    )
    targets = lines.select("grp", document.alias("d")).select(
        "grp", F.posexplode("d.input_ids").alias("target_pos", "target_id"), "d.context_ids"
    )
    return _with_contexts(targets, "context_ids")


def write_manifest_files(manifest: DataFrame, path: str, nested: bool) -> None:
    """JSON lines of one group each: ``input_ids`` by group, ``context_ids`` by target.

    With ``nested`` the targets' contexts are listed under their group as well. A
    group must have a name.
    """
    contexts = F.create_map("grp", "contexts") if nested else F.col("contexts")
    document = F.struct(F.create_map("grp", "targets").alias("input_ids"), contexts.alias("context_ids"))
    _targets(manifest).select(F.to_json(document).alias("value")).write.text(path)


def write_manifest_document(manifest: DataFrame, path: str, nested: bool, name: str = "partition.json") -> None:
    """One document for the whole manifest, as ``read_manifest_files(whole=True)`` reads it.

    ``input_ids`` lists the targets of each group, ``context_ids`` the contexts by group and target
    if ``nested``, else by target: a target in two groups then needs ``nested``. Groups and
    targets come in their order; no group is held in a row.
    """
    target = F.col("target_id").cast("string")
    contexts = F.array(F.lit("context_ids"), *([F.col("grp")] if nested else []), target)
    targets = manifest.select(
        F.lit(0).alias("part"), "grp", "target_pos", F.lit(0).alias("context_pos"),
        F.array(F.lit("input_ids"), F.col("grp")).alias("path"), target.alias("value"),
    ).distinct()
    values = targets.unionByName(
        manifest.select(
            F.lit(1).alias("part"), "grp", "target_pos", "context_pos",
            contexts.alias("path"), F.col("context_id").cast("string").alias("value"),
        )
    )
    nothing = {"file": F.lit(name), "head": F.lit(""), "tail": F.lit("")}
    json_files.write(values.withColumns(nothing), path, ["part", "grp", "target_pos", "context_pos"])


def read_manifest_files(
    spark: SparkSession, path: str, nested: bool, whole: bool = False
) -> DataFrame:
    """Long manifest rows from documents with ``input_ids`` by group.

    ``context_ids`` are by group and target if ``nested``, else by target. With
    ``whole`` each file is one document of many lines, else each line is one.
    """
    kind = "map<string,array<bigint>>"
    contexts = f"map<string,{kind}>" if nested else kind
    document = F.from_json("value", f"input_ids {kind}, context_ids {contexts}", {"mode": "FAILFAST"})
    rows = spark.read.text(path, wholetext=whole).select(document.alias("d"))
    groups = rows.select(F.explode("d.input_ids").alias("grp", "ids"), "d.context_ids")
    by_target = F.try_element_at("context_ids", F.col("grp")) if nested else F.col("context_ids")
    targets = groups.select(
        "grp", F.posexplode("ids").alias("target_pos", "target_id"), by_target.alias("by_target")
    )
    return _with_contexts(targets, "by_target")


def metrics_documents(
    totals: DataFrame, positions: DataFrame, ks: Sequence[int] = KS
) -> DataFrame:
    """The metrics document of each task: pass@k with detail, sums per test, total.

    ``totals`` has task_id, n, c and total; ``positions`` the passed generations
    per test, one row per test of the task. A k above the task's n is left out.
    """
    scores = {k: F.when(F.col("n") >= k, passk.pass_at_k(F.col("n"), F.col("c"), F.lit(k))) for k in ks}
    sums = positions.groupBy("task_id").agg(
        F.sort_array(F.collect_list(F.struct("test_idx", "n_passed"))).alias("sums")
    )
    task = F.col("task_id").cast("string")
    detail = [
        F.when(score.isNotNull(), F.create_map(task, score)).alias(f"pass@{k}")
        for k, score in scores.items()
    ]
    k_pass = F.struct(
        *[score.alias(f"pass@{k}") for k, score in scores.items()],
        F.struct(*detail).alias("detail"),
    )
    normalized = F.struct(
        F.transform("sums", lambda x: x["n_passed"]).alias("tests"), F.col("total")
    )
    return totals.join(sums, "task_id", "left").select(
        "task_id",
        F.to_json(
            F.struct(k_pass.alias("k_pass"), normalized.alias("normalized_sum"))
        ).alias("metrics"),
    )


def write_metrics_files(
    totals: DataFrame, positions: DataFrame, results: DataFrame, path: str, ks: Sequence[int] = KS
) -> None:
    """A file per task: its metrics document with ``results``, the verdicts of every generation.

    ``totals`` and ``positions`` are as for ``metrics_documents``; ``results`` has ``task_id``,
    ``gen_idx`` and the array ``verdicts``. A task's metrics travel with its first generation only.
    """
    first = results.groupBy("task_id").agg(F.min("gen_idx").alias("gen_idx"))
    documents = metrics_documents(totals, positions, ks).join(first, "task_id")
    rows = skew.attach(results, documents, ["task_id", "gen_idx"], how="left")
    task = F.col("task_id").cast("string")
    opened = F.regexp_replace("metrics", r"\}$", ',"results":')
    values = rows.select(
        F.concat(task, F.lit("_metrics.json")).alias("file"),
        F.coalesce(opened, F.lit("")).alias("head"),
        F.lit("}").alias("tail"),
        F.array(task).alias("path"),
        F.to_json("verdicts").alias("value"),
        "gen_idx",
    )
    json_files.write(values, path, ["gen_idx"])


def read_metrics_files(spark: SparkSession, path: str, ks: Sequence[int] = KS) -> DataFrame:
    """pass@k, total and the verdicts of every generation, by its place, from one document per file."""
    scores = ", ".join(f"`pass@{k}`:double" for k in ks)
    value = F.from_json(
        "value",
        f"k_pass struct<{scores}>, normalized_sum struct<total:double>, results map<string,array<array<int>>>",
        {"mode": "FAILFAST"},
    )
    documents = spark.read.text(path, wholetext=True).select(value.alias("m"))
    tasks = documents.select("m", F.explode("m.results").alias("task_id", "results"))
    return tasks.select(
        F.col("task_id").cast("bigint").alias("task_id"),
        *[F.col(f"m.k_pass.`pass@{k}`").alias(f"pass_at_{k}") for k in ks],
        F.col("m.normalized_sum.total").alias("total"),
        F.posexplode("results").alias("gen_pos", "verdicts"),
    )


def write_metrics(documents: DataFrame, path: str) -> None:
    documents.write.json(path)


def read_metrics(spark: SparkSession, path: str, ks: Sequence[int] = KS) -> DataFrame:
    """pass@k, null where it was left out, and total of every stored metrics document."""
    scores = ", ".join(f"`pass@{k}`:double" for k in ks)
    lines = spark.read.schema("task_id bigint, metrics string").option("mode", "FAILFAST").json(path)
    value = F.from_json(
        "metrics",
        f"k_pass struct<{scores}>, normalized_sum struct<tests:array<bigint>,total:double>",
        {"mode": "FAILFAST"},
    )
    return lines.select("task_id", value.alias("m")).select(
        "task_id",
        *[F.col(f"m.k_pass.`pass@{k}`").alias(f"pass_at_{k}") for k in ks],
        F.size("m.normalized_sum.tests").alias("n_tests"),
        F.col("m.normalized_sum.total").alias("total"),
    )
