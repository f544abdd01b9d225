"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.functions import compare
from evalweave.operators import (
    generations,
    grid,
    judging,
    lookup,
    nearest,
    outcomes,
    prompts,
    report,
    sampling,
    scoring,
)
from evalweave.plans import experiment
from evalweave.sources import arrow_ipc, documents, tables
from evalweave.streaming import live_scores as live
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

PARTS = experiment.by_topic("MEDIUM", n_targets=5)
DOCS = experiment.by_topic("en", n_targets=5)
DOCS_BY_LANG = experiment.by_difficulty("src1", n_targets=5)
SCORE_DIGITS = 9
# Buckets of stored verdicts.
BUCKETS = 16
# Inverted lists of the vectors' index, and how many a target looks into first.
LISTS = 64
PROBES = 8

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Scores at 9 decimals, as engines add floats in different orders."""
    return df.withColumns({c: F.round(c, SCORE_DIGITS) for c in columns})


def _docs_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.manifest(fx.problems_docs(spark, sf), DOCS)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.verdicts_orders(spark, sf).drop("context_type")


def _stored_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """For queries that read the verdicts more than once."""
    return scratch.store(_verdicts(spark, sf), "verdicts")


# Sources and sinks


@query
def scan_problems(spark, sf):
    names = {"id": "doc_id", "difficulty": "lang", "tags": "source", "input": "text"}
    return tables.read_problems(spark, f"{sf}/documents.parquet", names)


@query
def scan_arrow_ipc(spark, sf):
    path = scratch.new_path(spark, "part-arrow")
    arrow_ipc.write_arrow(fx.table(spark, sf, "part"), path)
    return arrow_ipc.read_arrow(spark, path)


@query
def scan_arrow_filtered(spark, sf):
    """A filter of the scan that most record batches are skipped by: the filter is the feature."""
    path = scratch.new_path(spark, "part-arrow")
    arrow_ipc.write_arrow(fx.table(spark, sf, "part").repartitionByRange(8, "p_partkey"), path)
    return arrow_ipc.read_arrow(spark, path).filter(F.col("p_partkey").between(*fx.SOME_PARTS))


@query
def scan_solutions(spark, sf):
    path = scratch.new_path(spark, "solutions")
    fx.solutions_docs(spark, sf).write.parquet(path)
    return tables.read_solutions(spark, path)


def _tests_path(spark: SparkSession, sf: str) -> str:
    path = scratch.new_path(spark, "tests")
    cases = judging.test_cases(fx.samples_orders(spark, sf))
    cases.select("id", "test_idx", "input", "expected").write.parquet(path)
    return path


@query
def scan_tests(spark, sf):
    return tables.read_tests(spark, _tests_path(spark, sf))


@query
def scan_tests_one_id(spark, sf):
    """The tests of one problem: the filter is the feature."""
    return tables.read_tests(spark, _tests_path(spark, sf), fx.ONE_PROBLEM)


@query
def raw_samples(spark, sf):
    path = scratch.new_path(spark, "samples")
    stored = {"id": "problem", "input_output": "sample"}
    fx.samples_orders(spark, sf).withColumnsRenamed(stored).write.parquet(path)
    return tables.read_raw_samples(spark, path, stored)


@query
def read_generations(spark, sf):
    path = scratch.new_path(spark, "generations")
    documents.write_generations(fx.generations_conv(spark, sf), path)
    return documents.read_generations(spark, path)


@query
def load_generation_last_wins(spark, sf):
    """A task's user turns are its first entry, its assistant turns a later one."""
    parsed = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("task_id"),
        F.col("turn").alias("gen_idx"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("entry_pos"),
        F.col("text").alias("code"),
    )
    return generations.last_entry_per_task(parsed)


@query
def manifest_export(spark, sf):
    manifest = experiment.manifest(fx.problems_parts(spark, sf), PARTS)
    return documents.manifest_documents(manifest)


@query
def manifest_roundtrip(spark, sf):
    path = scratch.new_path(spark, "manifest-json")
    manifest = experiment.manifest(fx.problems_docs(spark, sf), DOCS_BY_LANG)
    documents.write_manifest(manifest, path)
    return documents.read_manifest(spark, path)


@query
def manifest_files_nested(spark, sf):
    path = scratch.new_path(spark, "manifest-nested")
    manifest = experiment.manifest(fx.problems_parts(spark, sf), PARTS)
    documents.write_manifest_files(manifest, path, nested=True)
    return documents.read_manifest_files(spark, path, nested=True)


@query
def manifest_files_flat(spark, sf):
    path = scratch.new_path(spark, "manifest-flat")
    manifest = experiment.manifest(fx.problems_docs(spark, sf), DOCS_BY_LANG)
    documents.write_manifest_files(manifest, path, nested=False)
    return documents.read_manifest_files(spark, path, nested=False)


@query
def manifest_document_nested(spark, sf):
    path = scratch.new_path(spark, "manifest-whole")
    manifest = experiment.manifest(fx.problems_parts(spark, sf), PARTS)
    documents.write_manifest_document(manifest, path, nested=True)
    return documents.read_manifest_files(spark, path, nested=True, whole=True)


@query
def manifest_document_flat(spark, sf):
    path = scratch.new_path(spark, "manifest-whole")
    manifest = experiment.manifest(fx.problems_docs(spark, sf), DOCS_BY_LANG)
    documents.write_manifest_document(manifest, path, nested=False)
    return documents.read_manifest_files(spark, path, nested=False, whole=True)


@query
def generation_files(spark, sf):
    path = scratch.new_path(spark, "generation-files")
    documents.write_generation_files(fx.generations_conv(spark, sf), path)
    return documents.read_generation_files(spark, path)


@query
def parsed_files(spark, sf):
    path = scratch.new_path(spark, "parsed-files")
    documents.write_parsed_files(generations.parse_generations(fx.generations_conv(spark, sf)), path)
    return generations.last_entry_per_task(documents.read_parsed_files(spark, path))


@query
def metrics_files(spark, sf):
    """A metrics document per user, with the verdicts of all its events."""
    path = scratch.new_path(spark, "metrics-files")
    verdicts = scratch.store(fx.events_gens(spark, sf), "verdicts")
    totals = scoring.normalized_sum(scoring.task_totals(verdicts))
    positions = scoring.tests_passed_by_position(verdicts)
    documents.write_metrics_files(totals, positions, scoring.collect_results(verdicts), path)
    rows = documents.read_metrics_files(spark, path).withColumn("verdicts", F.to_json("verdicts"))
    return _rounded(rows, *[f"pass_at_{k}" for k in documents.KS], "total")


@query
def parsed_export(spark, sf):
    path = scratch.new_path(spark, "parsed")
    documents.write_parsed(generations.parse_generations(fx.generations_conv(spark, sf)), path)
    return documents.read_parsed(spark, path)


@query
def metrics_roundtrip(spark, sf):
    path = scratch.new_path(spark, "metrics")
    verdicts = _stored_verdicts(spark, sf)
    totals = scoring.normalized_sum(scoring.task_totals(verdicts))
    positions = scoring.tests_passed_by_position(verdicts)
    documents.write_metrics(documents.metrics_documents(totals, positions), path)
    scores = [f"pass_at_{k}" for k in documents.KS]
    return _rounded(documents.read_metrics(spark, path), *scores, "total")


@query
def run_log(spark, sf):
    path = scratch.new_path(spark, "runs")
    durations = report.stage_durations(fx.stage_clock(spark, sf))
    log = report.run_log(_run_results(spark, sf), durations, [*fx.STAGES, "total"])
    return _rounded(tables.append_runs(log, path), "pass_at_1", "normalized_sum")


@query
def run_log_again(spark, sf):
    """Runs with their own seconds and index in the grid, logged a second time over a first."""
    path = scratch.new_path(spark, "run-log")
    durations = report.stage_durations(fx.run_clock(spark, sf), report.RUN_IN_GROUP)
    grid_rows = grid.run_grid(fx.group_targets(spark, sf))
    log = scratch.store(report.run_log(_run_results(spark, sf), durations, [*fx.STAGES, "total"], grid_rows), "log")
    early = log.filter(F.col("task_id") % 3 == 0).withColumn("pass_at_1", F.lit(-1.0))
    tables.log_runs(early, path, report.RUN_IN_GROUP)
    return _rounded(tables.log_runs(log, path, report.RUN_IN_GROUP), "pass_at_1", "normalized_sum")


@query
def scores_from_store(spark, sf):
    """Scores per run from stored verdicts, which are aggregated where they lie."""
    path = scratch.new_path(spark, "stored-verdicts")
    verdicts = fx.verdicts_orders(spark, sf)
    tables.write_verdicts(verdicts, path, report.RUN, BUCKETS)
    stored = tables.read_verdicts(spark, path, verdicts.schema, report.RUN, BUCKETS)
    scored = scoring.normalized_sum(scoring.task_totals(stored, report.RUN))
    return _rounded(scored.select(*report.RUN, "n", "c", "hits", "max_tests", "total"), "total")


# Filters, joins, lookups


@query
def filter_difficulty(spark, sf):
    return fx.problems_parts(spark, sf).filter(F.col("difficulty") == "MEDIUM")


@query
def lookup_input(spark, sf):
    ids = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return lookup.lookup_inputs(fx.problems_docs(spark, sf), ids)


@query
def context_members(spark, sf):
    manifest = _docs_manifest(spark, sf)
    return lookup.context_members(fx.problems_docs(spark, sf), manifest)


@query
def eligible_problems(spark, sf):
    return sampling.eligible_problems(
        fx.problems_parts(spark, sf), PARTS.group_col, PARTS.fixed, PARTS.min_count
    )


@query
def context_pairs(spark, sf):
    return lookup.context_pairs(
        fx.problems_docs(spark, sf), fx.solutions_docs(spark, sf), _docs_manifest(spark, sf)
    )


@query
def pairing_report(spark, sf):
    return generations.pairing_report(fx.generations_conv(spark, sf), fx.problems_docs(spark, sf))


# Aggregations, sorts


@query
def eligible_groups(spark, sf):
    return sampling.eligible_groups(
        fx.problems_parts(spark, sf), PARTS.group_col, PARTS.fixed, PARTS.min_count
    )


@query
def eligible_groups_by_difficulty(spark, sf):
    return sampling.eligible_groups(
        fx.problems_docs(spark, sf),
        DOCS_BY_LANG.group_col,
        DOCS_BY_LANG.fixed,
        DOCS_BY_LANG.min_count,
    )


@query
def n_eligible_tags(spark, sf):
    return eligible_groups(spark, sf).agg(F.count_distinct("grp").alias("n_tags"))


@query
def distinct_inputs(spark, sf):
    return lookup.distinct_inputs(fx.problems_docs(spark, sf))


@query
def first_solution(spark, sf):
    return lookup.first_solutions(fx.solutions_docs(spark, sf))


@query
def task_totals(spark, sf):
    return scoring.task_totals(_verdicts(spark, sf))


@query
def preview_head(spark, sf):
    return eligible_problems(spark, sf).orderBy("id").limit(5)


# Sampling and context selection


@query
def sample_targets(spark, sf):
    return experiment.targets(fx.problems_parts(spark, sf), PARTS)


@query
def sample_targets_by_difficulty(spark, sf):
    return experiment.targets(fx.problems_docs(spark, sf), DOCS_BY_LANG)


def _splits(spark: SparkSession, sf: str) -> list[DataFrame]:
    problems = fx.problems_parts(spark, sf)
    return [problems.filter(F.col("id") % 2 == k) for k in range(2)]


@query
def sample_targets_merged(spark, sf):
    """The same targets from the stored draws of two halves of the problems."""
    drawn = [
        scratch.store(sampling.bottom_draws(half, PARTS.group_col, PARTS.fixed, 20, PARTS.seed), "draws")
        for half in _splits(spark, sf)
    ]
    return sampling.merged_targets(drawn, PARTS.min_count, PARTS.n_targets)


@query
def n_tags_sketch(spark, sf):
    """How many tags are eligible, from stored sketches of two halves of the problems."""
    sketches = [
        scratch.store(sampling.group_sketches(half, PARTS.group_col, PARTS.fixed), "sketches")
        for half in _splits(spark, sf)
    ]
    return sampling.n_groups_sketch(sketches, PARTS.min_count)


@query
def sample_contexts(spark, sf):
    problems = fx.problems_parts(spark, sf)
    chosen = experiment.targets(problems, PARTS).drop("short")
    return sampling.sample_contexts(
        problems, chosen, PARTS.group_col, PARTS.fixed, PARTS.n_contexts, PARTS.seed
    )


@query
def sample_contexts_cross(spark, sf):
    """Targets from the labelled documents, contexts from the others."""
    docs = fx.problems_docs(spark, sf)
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    test, train = docs.join(labelled, "id", "left_semi"), docs.join(labelled, "id", "left_anti")
    chosen = experiment.targets(test, DOCS).drop("short")
    return sampling.sample_contexts(
        train, chosen, DOCS.group_col, DOCS.fixed, DOCS.n_contexts, DOCS.seed
    )


@query
def explicit_manifest(spark, sf):
    return sampling.explicit_manifest(fx.picks_orders(spark, sf))


@query
def context_cosine(spark, sf):
    rows = fx.vectors(spark, sf)
    chosen = sampling.sample_targets(rows, "label", {}, min_count=6, n_targets=5, seed=42)
    return sampling.nearest_contexts(rows, chosen, "label", n_contexts=4)


@query
def context_cosine_index(spark, sf):
    """The same contexts over inverted lists, those that the angles rule out left unread."""
    rows = fx.vectors(spark, sf)
    chosen = sampling.sample_targets(rows, "label", {}, min_count=6, n_targets=5, seed=42)
    index = nearest.fit(rows, lists=LISTS, probes=PROBES)
    return nearest.indexed_contexts(rows, chosen, "label", 4, index)


@query
def prompts_no_context(spark, sf):
    manifest = _docs_manifest(spark, sf)
    return prompts.no_context(prompts.gather(fx.problems_docs(spark, sf), manifest), manifest)


@query
def prompts_full_problem(spark, sf):
    manifest = _docs_manifest(spark, sf)
    texts = prompts.gather(fx.problems_docs(spark, sf), manifest, fx.solutions_docs(spark, sf))
    return prompts.full_problem(texts, manifest)


@query
def prompts_only_solutions(spark, sf):
    manifest = _docs_manifest(spark, sf)
    texts = prompts.gather(fx.problems_docs(spark, sf), manifest, fx.solutions_docs(spark, sf))
    return prompts.only_solutions(texts, manifest)


@query
def prompts_by_run(spark, sf):
    problems, solutions = fx.problems_docs(spark, sf), fx.solutions_docs(spark, sf)
    return experiment.all_prompts(problems, solutions, _docs_manifest(spark, sf))


@query
def run_grid(spark, sf):
    chosen = experiment.targets(fx.problems_parts(spark, sf), PARTS)
    return grid.run_grid(chosen, start=0, end=75, end_inclusive=True)


@query
def run_grid_by_difficulty(spark, sf):
    chosen = experiment.targets(fx.problems_docs(spark, sf), DOCS_BY_LANG)
    return grid.run_grid(chosen, start=0, end=45)


@query
def generation_requests(spark, sf):
    chosen = experiment.targets(fx.problems_parts(spark, sf), PARTS)
    return grid.generation_requests(grid.run_grid(chosen), n_generations=60, batch_size=25)


# Generations


@query
def extract_code(spark, sf):
    return generations.parse_generations(fx.generations_conv(spark, sf))


@query
def code_line_types(spark, sf):
    return generations.code_line_types(extract_code(spark, sf))


# Judging


@query
def test_cases(spark, sf):
    return judging.test_cases(fx.samples_orders(spark, sf))


@query
def unreadable_samples(spark, sf):
    return judging.unreadable_samples(fx.samples_orders(spark, sf))


@query
def quarantined_samples(spark, sf):
    """What no test can be taken from, after the one parse that also gives the tests."""
    return judging.stage_samples(fx.samples_with_lists(spark, sf)).quarantine


@query
def staged_tests(spark, sf):
    """The tests of the same parse, as they are run and compared."""
    tests = judging.stage_samples(fx.samples_with_lists(spark, sf)).tests
    return tests.select("id", "test_idx", "test_type", "input", "expected")


@query
def normalise_io(spark, sf):
    def listed(column: str):
        entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(F.sort_array(entries), ",").alias(column)

    cases = judging.test_cases(fx.samples_orders(spark, sf))
    return judging.normalise_io(cases).select(
        "id", "test_idx", "test_type", "input", "expected", listed("input_map"), listed("expected_map")
    )


@query
def resolve_attempts(spark, sf):
    return judging.resolve_attempts(fx.attempts_lines(spark, sf), "effective")


@query
def variant_fallback(spark, sf):
    return judging.variant_fallback(resolve_attempts(spark, sf))


@query
def broadcast_verdict(spark, sf):
    verdicts = _stored_verdicts(spark, sf)
    return judging.broadcast_verdict(verdicts, judging.expected_tests(verdicts))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    tests = judging.expected_tests(_verdicts(spark, sf))
    return experiment.judged(
        fx.generations_orders(spark, sf), fx.attempts_lines(spark, sf), tests, "effective", dealt=True
    )


@query
def verdict_codes(spark, sf):
    return outcomes.verdicts(_judged(spark, sf))


@query
def scores_from_attempts(spark, sf):
    """The whole evaluation: attempts, results by generation, per-task scores."""
    scored = scoring.normalized_sum(outcomes.task_totals(_judged(spark, sf)))
    estimate = scoring.passk.pass_at_k(F.col("n"), F.col("c"), F.lit(1))
    scores = scored.withColumn("pass_at_1", estimate).drop("hits", "max_tests")
    return _rounded(scores, "pass_at_1", "total")


def _treated(spark: SparkSession, sf: str) -> DataFrame:
    """Results of every generation under each of three treatments; tasks are in two groups."""
    attempts = fx.treated_attempts(spark, sf)
    tests = judging.expected_tests(attempts)
    return experiment.judged(
        fx.treated_generations(spark, sf), attempts, tests, "strict", report.RUN_IN_GROUP, dealt=True
    )


@query
def experiment_end_to_end(spark, sf):
    """From attempts under three treatments to their differences."""
    totals = outcomes.task_totals(_treated(spark, sf), report.RUN_IN_GROUP)
    delta = report.context_delta(report.results_of(totals))
    return _rounded(delta, *[c for c in delta.columns if c != "grp"])


@query
def experiment_pass_at_k(spark, sf):
    """Mean pass@k of every group and treatment, from the same attempts."""
    metrics = experiment.evaluate_judged(_treated(spark, sf), [1, 2], report.RUN_IN_GROUP)
    return _rounded(metrics.pass_at_k, "pass_at_k")


@query
def experiment_detail(spark, sf):
    """pass@1 and normalised sum of every run, from long verdicts."""
    verdicts = outcomes.verdicts(_treated(spark, sf), report.RUN_IN_GROUP)
    metrics = experiment.evaluate(scratch.store(verdicts, "treated"), [1], report.RUN_IN_GROUP)
    detail = metrics.detail.drop("hits", "max_tests").join(
        metrics.normalized_sum.select(*report.RUN_IN_GROUP, "total"), list(report.RUN_IN_GROUP)
    )
    return _rounded(detail, "pass_at_k", "total")


@query
def judged_problems(spark, sf):
    """Verdicts from the problems' own tests; the single one of a call-based program is copied."""
    samples = scratch.store(fx.samples_orders(spark, sf), "samples")
    generations, attempts = fx.problem_generations(spark, sf), fx.problem_attempts(spark, sf)
    return outcomes.verdicts(experiment.judge_problems(samples, generations, attempts))


def _compare(tier: str) -> Query:
    def build(spark, sf):
        return fx.pairs_lines(spark, sf).withColumn(
            "matched", compare.matches(tier, F.col("actual"), F.col("expected"))
        )

    return build


for _tier in compare.TIERS:
    QUERIES[f"compare_{_tier}"] = _compare(_tier)


@query
def compare_first_tier(spark, sf):
    pairs = fx.pairs_lines(spark, sf)
    actual, expected = F.col("actual"), F.col("expected")
    return pairs.withColumns(
        {f"{mode}_tier": compare.first_tier(actual, expected, mode) for mode in compare.MODES}
    )


@query
def compare_call(spark, sf):
    return judging.compare_calls(fx.calls_lines(spark, sf))


# Scoring


@query
def generation_correct(spark, sf):
    return scoring.generation_correct(_verdicts(spark, sf))


@query
def results_by_generation(spark, sf):
    vectors = scoring.collect_results(_verdicts(spark, sf))
    return vectors.withColumn("verdicts", F.to_json("verdicts"))


@query
def explode_results(spark, sf):
    return scoring.explode_results(scoring.collect_results(_verdicts(spark, sf)))


@query
def pass_at_k_detail(spark, sf):
    totals = scratch.store(scoring.task_totals(fx.events_gens(spark, sf)), "totals")
    detail = scoring.pass_at_k_detail(totals, [1, 10, 100])
    return _rounded(detail.select("task_id", "n", "c", "k", "pass_at_k"), "pass_at_k")


@query
def pass_at_k_detail_orders(spark, sf):
    totals = scratch.store(scoring.task_totals(_verdicts(spark, sf)), "totals")
    detail = scoring.pass_at_k_detail(totals, [1, 10, 100])
    return _rounded(detail.select("task_id", "n", "c", "k", "pass_at_k"), "pass_at_k")


@query
def pass_at_k(spark, sf):
    totals = scoring.task_totals(fx.events_gens(spark, sf))
    return _rounded(scoring.pass_at_k(totals, [1, 10, 100]), "pass_at_k")


@query
def tests_passed_by_position(spark, sf):
    return scoring.tests_passed_by_position(_verdicts(spark, sf))


@query
def normalized_sum(spark, sf):
    scored = scoring.normalized_sum(scoring.task_totals(_verdicts(spark, sf)))
    return _rounded(scored.select("task_id", "n", "max_tests", "hits", "total"), "total")


@query
def live_scores(spark, sf):
    """The same scores from a stream of judged generations, run until it is used up."""
    arrived, log, state = (scratch.new_path(spark, n) for n in ("arrived", "live-log", "live-state"))
    scoring.collect_results(_verdicts(spark, sf)).write.parquet(arrived)
    live.start(live.read_results(spark, arrived), state, log).awaitTermination()
    return _rounded(live.latest_scores(spark, log), "pass_at_1", "normalized_sum")


@query
def verdict_histogram(spark, sf):
    return scoring.verdict_histogram(_verdicts(spark, sf))


# Reporting


def _run_results(spark, sf):
    return report.run_results(fx.verdicts_orders(spark, sf), fx.task_groups(spark, sf))


@query
def run_results(spark, sf):
    return _rounded(_run_results(spark, sf), "pass_at_1", "normalized_sum")


@query
def context_delta(spark, sf):
    delta = report.context_delta(_run_results(spark, sf))
    return _rounded(delta, *[c for c in delta.columns if c != "grp"])


@query
def stage_durations(spark, sf):
    return report.stage_durations(fx.stage_clock(spark, sf))
