"""Prompt assembly for the three context treatments."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import schemas, scratch
from evalweave.operators import lookup

TARGET = ("grp", "target_id", "target_pos")


@dataclass(frozen=True)
class Template:
    """Prompt wording. ``{group}``, ``{i}``, ``{question}``, ``{solution}`` are filled in."""

    task: str = "Solve this task with a Python program.\nTask:\n{question}\nProgram:\n"
    full_header: str = "Topic: {group}. Solved tasks come first.\n"
    full_example: str = "Task {i}:\n{question}\nProgram {i}:\n{solution}\n"
    solutions_header: str = "Topic: {group}. Programs for similar tasks come first.\n"
    solutions_example: str = "Program {i}:\n{solution}\n"


def _fill(wording: str, **values: Column) -> Column:
    """``wording`` with each placeholder replaced by a column, other text kept."""
    parts: list[Column] = []
    rest = wording
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in values]
        places = [p for p in places if p[0] >= 0]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class Texts:
    """The texts a manifest needs: ``inputs`` (id, input), ``solutions`` (id, solution).

    ``hot`` lists the contexts that very many targets have.
    """

    inputs: DataFrame
    solutions: DataFrame | None = None
    hot: scratch.Written | None = None


def gather(problems: DataFrame, manifest: DataFrame, solutions: DataFrame | None = None) -> Texts:
    """Fetch the texts of all ids in the manifest, scanning each table once.

    Without ``solutions`` only the targets are fetched. What is kept is bounded
    by the manifest; it is stored, as several joins read it.
    """
    if solutions is None:
        return Texts(lookup.inputs_by_id(problems, lookup.target_ids(manifest)))
    ids = scratch.write(lookup.all_ids(manifest), "ids")
    return Texts(
        scratch.store(lookup.inputs_by_id(problems, ids), "inputs"),
        scratch.store(lookup.first_solutions(solutions, ids), "solutions"),
        lookup.hot_contexts(manifest),
    )


def _questions(texts: Texts, manifest: DataFrame, template: Template) -> DataFrame:
    targets = manifest.select(*TARGET).distinct()
    return targets.join(texts.inputs.withColumnRenamed("id", "target_id"), "target_id").select(
        *TARGET, _fill(template.task, question=F.col("input")).alias("task_text")
    )


def _numbered(examples: Column, wording: str) -> Column:
    def line(example: Column, i: Column) -> Column:
        return _fill(wording, i=i, question=example["input"], solution=example["solution"])

    return F.array_join(F.transform(examples, line), "")


def no_context(texts: Texts, manifest: DataFrame, template: Template = Template()) -> DataFrame:
    return _questions(texts, manifest, template).withColumnRenamed("task_text", "prompt")


def full_problem(texts: Texts, manifest: DataFrame, template: Template = Template()) -> DataFrame:
    """Question and solution of each context, numbered from 0, before the task."""
    pairs = lookup.with_context(lookup.with_context(manifest, texts.inputs, texts.hot), texts.solutions, texts.hot)
    example = F.struct("context_pos", "input", "solution")
    examples = pairs.groupBy(*TARGET).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    body = _numbered(F.col("examples"), template.full_example)
    return _with_context(texts, manifest, template, examples, template.full_header, body)


def only_solutions(texts: Texts, manifest: DataFrame, template: Template = Template()) -> DataFrame:
    """Solutions of the contexts before the task; equal solutions appear once."""
    once = (
        lookup.with_context(manifest, texts.solutions, texts.hot)
        .groupBy(*TARGET, "solution")
        .agg(F.min("context_pos").alias("context_pos"))
    )
    example = F.struct("context_pos", F.lit("").alias("input"), "solution")
    examples = once.groupBy(*TARGET).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    body = _numbered(F.col("examples"), template.solutions_example)
    return _with_context(texts, manifest, template, examples, template.solutions_header, body)


def _with_context(
    texts: Texts,
    manifest: DataFrame,
    template: Template,
    examples: DataFrame,
    header: str,
    body: Column,
) -> DataFrame:
    """Header, examples, task. A target without examples keeps header and task."""
    written = examples.select(*TARGET, body.alias("body"))
    head = _fill(header, group=F.col("grp"))
    return (
        _questions(texts, manifest, template)
        .join(written, list(TARGET), "left")
        .select(*TARGET, F.concat(head, F.coalesce("body", F.lit("")), "task_text").alias("prompt"))
    )


TREATMENTS = {
    schemas.NO_CONTEXT: no_context,
    schemas.FULL_PROBLEM: full_problem,
    schemas.ONLY_SOLUTIONS: only_solutions,
}


def assemble(
    treatment: str, texts: Texts, manifest: DataFrame, template: Template = Template()
) -> DataFrame:
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment!r}")
    return TREATMENTS[treatment](texts, manifest, template)
