"""Fetching problem texts and solutions by id."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave import scratch
from evalweave.operators import skew

Ids = DataFrame | scratch.Written


def _one_each(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each id. Repeated rows differ in their text, so its hash decides."""
    ranked = Window.partitionBy("id").orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(ranked)).filter("_place = 1").drop("_place")


def inputs_by_id(problems: DataFrame, ids: Ids) -> DataFrame:
    """One ``input`` per wanted id; of an id listed under several tags, the first tag's.

    ``ids`` holds distinct ids. Only wanted texts are exchanged, and beyond the bound of
    ``skew.sift`` some others with them.
    """
    rows = problems.select("id", "input", F.coalesce("tags", F.lit("")).alias("tags"), F.xxhash64("input").alias("hash"))
    return _one_each(skew.fetch(rows, ids, ["id"]), "tags", "hash").select("id", "input")


def lookup_inputs(problems: DataFrame, ids: DataFrame) -> DataFrame:
    """Text of every id, with ``found`` false for ids that do not exist."""
    stored = scratch.write(ids, "ids")
    known = inputs_by_id(problems, stored).withColumn("found", F.lit(True))
    return stored.df.join(known, "id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def first_solutions(solutions: DataFrame, ids: Ids | None = None) -> DataFrame:
    """The first solution per problem, optionally for some ids only.

    The first place of each id is found without its texts; then those texts are fetched.
    """
    rows = solutions
    if ids is not None:
        ids = ids if isinstance(ids, scratch.Written) else scratch.write(ids, "ids")
        rows = skew.fetch(rows, ids, ["id"])
    first = rows.groupBy("id").agg(F.min("sol_idx").alias("sol_idx"))
    found = skew.fetch(rows, first, ["id", "sol_idx"]).withColumn("hash", F.xxhash64("solution"))
    return _one_each(found, "hash").select("id", "solution")


def distinct_inputs(problems: DataFrame) -> DataFrame:
    """Every text once. Texts are told apart by 128 bits of hashes, and only these are exchanged:
    the row that stands for a text is chosen by them and read again, where it lies.

    Rows that agree in id, tags and text have no row to choose; if there are any, their texts alone
    are brought together.
    """
    named = problems.select("input", F.xxhash64("id", "tags", "input").alias("row"))
    rows = named.withColumns({
        "low": F.xxhash64(F.lit(1), F.coalesce("input", F.lit(""))),
        "high": F.xxhash64(F.lit(2), F.coalesce("input", F.lit("")), F.col("input").isNull()),
    })
    counted = rows.groupBy("low", "high", "row").agg(F.count(F.lit(1)).alias("n"))
    stored = scratch.store(counted, "texts")
    first = stored.groupBy("low", "high").agg(F.min("row").alias("row"))
    chosen = skew.fetch(rows, first, ["low", "high", "row"])
    twice = scratch.write(stored.filter("n > 1").select("row"), "repeated")
    if twice.rows == 0:
        return chosen.select("input")
    once = skew.attach(chosen, twice, ["row"], how="left_anti").select("input")
    return once.unionAll(skew.attach(chosen, twice, ["row"], how="left_semi").select("input").distinct())


def context_ids(manifest: DataFrame) -> DataFrame:
    return (
        manifest.filter(F.col("context_id").isNotNull())
        .select(F.col("context_id").alias("id"))
        .distinct()
    )


def target_ids(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.col("target_id").alias("id")).distinct()


def all_ids(manifest: DataFrame) -> DataFrame:
    """Target and context ids in one pass."""
    ids = manifest.select(F.explode(F.array("target_id", "context_id")).alias("id"))
    return ids.filter(F.col("id").isNotNull()).distinct()


def hot_contexts(manifest: DataFrame) -> scratch.Written:
    return skew.hot_keys(manifest.filter(F.col("context_id").isNotNull()), ["context_id"])


def with_context(manifest: DataFrame, by_id: DataFrame, hot: scratch.Written) -> DataFrame:
    """Manifest rows whose context is in ``by_id``, with its columns.

    A context of many targets, one of ``hot_contexts``, has its text copied instead of
    all its targets brought together.
    """
    texts = by_id.withColumnRenamed("id", "context_id")
    return skew.spread(manifest, texts, ["context_id"], ["grp", "target_id"], hot)


def context_members(problems: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's contexts that exist, with their text."""
    texts = inputs_by_id(problems, context_ids(manifest))
    return with_context(manifest, texts, hot_contexts(manifest))


def context_pairs(problems: DataFrame, solutions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Question and first solution of every context that has both."""
    ids = scratch.write(context_ids(manifest), "context-ids")
    hot = hot_contexts(manifest)
    members = with_context(manifest, inputs_by_id(problems, ids), hot)
    return with_context(members, first_solutions(solutions, ids), hot)
