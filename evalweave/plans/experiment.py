"""The experiments: by topic, by difficulty, hand-picked; and their evaluation."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave import schemas, scratch
from evalweave.operators import grid, judging, outcomes, prompts, sampling, scoring, skew
from evalweave.operators.prompts import Template


@dataclass(frozen=True)
class Design:
    """Which problems take part and how many are drawn."""

    group_col: str
    min_count: int
    n_targets: int
    fixed: Mapping[str, object] = field(default_factory=dict)
    n_contexts: int = 4
    seed: int = 42


def by_topic(difficulty: str, n_targets: int, min_count: int = 6, seed: int = 42) -> Design:
    return Design("tags", min_count, n_targets, {"difficulty": difficulty}, seed=seed)


def by_difficulty(topic: str, n_targets: int, min_count: int = 5, seed: int = 42) -> Design:
    return Design("difficulty", min_count, n_targets, {"tags": topic}, seed=seed)


def targets(problems: DataFrame, design: Design) -> DataFrame:
    return sampling.sample_targets(
        problems, design.group_col, design.fixed, design.min_count, design.n_targets, design.seed
    )


def manifest(
    problems: DataFrame, design: Design, candidates: DataFrame | None = None
) -> DataFrame:
    """Targets with their contexts, written once so that later steps share it.

    ``candidates`` is the split contexts come from, if not the targets' own. A
    target with no candidate keeps one row without a context.
    """
    chosen = scratch.write(
        targets(problems, design).drop("short"), "targets", largest="n_problems"
    )
    contexts = sampling.sample_contexts(
        problems if candidates is None else candidates,
        chosen,
        design.group_col,
        design.fixed,
        design.n_contexts,
        design.seed,
    ).drop("target_pos")
    rows = chosen.df.drop("n_problems").join(contexts, list(sampling.TARGET_KEY), "left")
    return scratch.store(rows, "manifest")


def all_prompts(
    problems: DataFrame,
    solutions: DataFrame,
    manifest_rows: DataFrame,
    template: Template = Template(),
    treatments: Sequence[str] = schemas.TREATMENTS,
) -> DataFrame:
    """The prompt of every run: one row per target and treatment."""
    texts = prompts.gather(problems, manifest_rows, solutions)
    parts = [
        prompts.assemble(t, texts, manifest_rows, template).withColumn("context_type", F.lit(t))
        for t in treatments
    ]
    return reduce(DataFrame.unionByName, parts)


def requests(
    manifest_rows: DataFrame,
    n_generations: int,
    batch_size: int,
    start: int = 0,
    end: int | None = None,
    end_inclusive: bool = False,
) -> DataFrame:
    """What to ask the model for: the grid's slice times the generations per run."""
    chosen = manifest_rows.select("grp", "target_id", "target_pos").distinct()
    runs = grid.run_grid(chosen, start=start, end=end, end_inclusive=end_inclusive)
    return grid.generation_requests(runs, n_generations, batch_size)


def judged(
    generations: DataFrame,
    attempts: DataFrame,
    tests: DataFrame,
    mode: str = "strict",
    by: Sequence[str] = scoring.TASK,
    dealt: bool = False,
) -> DataFrame:
    """Recorded attempts as one row per generation, see ``operators.outcomes``.

    ``generations`` marks which ones compiled. ``by`` names the columns of a run, as
    ``report.RUN_IN_GROUP`` for experiments. ``dealt``: attempts come dealt by generation.
    """
    rows = outcomes.by_generation(generations, attempts, mode, by, dealt)
    return outcomes.settled(rows, tests, by, generations)


def judge(
    generations: DataFrame,
    attempts: DataFrame,
    tests: DataFrame,
    mode: str = "strict",
    by: Sequence[str] = scoring.TASK,
) -> DataFrame:
    """Verdicts from recorded attempts, one row per test; arguments as for ``judged``."""
    return outcomes.verdicts(judged(generations, attempts, tests, mode, by), by)


def judge_problems(
    samples: DataFrame,
    generations: DataFrame,
    attempts: DataFrame,
    mode: str = "strict",
    by: Sequence[str] = scoring.TASK,
) -> DataFrame:
    """``judged`` from the problems themselves: expected outputs, kinds and numbers of tests.

    ``samples`` has ``id`` and ``input_output``. ``attempts`` brings no expected output: it is
    the normalised one of its test. Attempts at a test that no readable sample has match nothing;
    a call-based generation with a single verdict has it for all tests of its problem.
    """
    staged = judging.stage_samples(samples)
    expected = staged.tests.select(F.col("id").alias("task_id"), "test_idx", "test_type", "expected")
    # A test has as many attempts as its problem has generations, or a few times as many.
    hot = skew.hot_keys(generations, ["task_id"])
    plain = attempts.drop("expected", "test_type")
    told = skew.spread(plain, expected, ["task_id", "test_idx"], ["gen_idx"], hot, "left", ["task_id"])
    return judged(generations, told, staged.sizes, mode, by)


@dataclass(frozen=True)
class Metrics:
    detail: DataFrame
    pass_at_k: DataFrame
    normalized_sum: DataFrame
    by_position: DataFrame


def _metrics(totals: DataFrame, verdicts: DataFrame, ks: Sequence[int], by: Sequence[str]) -> Metrics:
    stored = scratch.store(totals, "totals")
    within = [c for c in by if c not in scoring.TASK]
    return Metrics(
        detail=scoring.pass_at_k_detail(stored, ks, within),
        pass_at_k=scoring.pass_at_k(stored, ks, within),
        normalized_sum=scoring.normalized_sum(stored),
        by_position=scoring.tests_passed_by_position(verdicts, by),
    )


def evaluate(
    verdicts: DataFrame, ks: Sequence[int] = (1, 10, 100), by: Sequence[str] = scoring.TASK
) -> Metrics:
    """The metrics of every run. ``by`` names its columns, ``task_id`` among them.

    pass@k is averaged over the tasks that agree in the other columns: with
    ``report.RUN_IN_GROUP``, per group and treatment. Verdicts of several runs need the
    columns that tell them apart, or they count as one.
    """
    return _metrics(scoring.task_totals(verdicts, by), verdicts, ks, by)


def evaluate_judged(
    rows: DataFrame, ks: Sequence[int] = (1, 10, 100), by: Sequence[str] = scoring.TASK
) -> Metrics:
    """``evaluate`` of generations as ``judged`` gives them: scores without a row per test."""
    return _metrics(outcomes.task_totals(rows, by), outcomes.verdicts(rows, by), ks, by)
