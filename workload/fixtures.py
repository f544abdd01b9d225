"""The driver's tables seen as problems, solutions, generations and verdicts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.operators import skew

# The stages that ``events`` logs.
STAGES = ("view", "click", "signup", "error", "purchase")

# The problem whose tests are looked up alone, and the parts that are.
ONE_PROBLEM = 1
SOME_PARTS = (20, 60)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Four narrow columns of every line, dealt evenly over the cores for the expensive comparisons."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").select(*keys)
    return rows.repartition(spark.sparkContext.defaultParallelism, *keys)


def problems_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("difficulty"),
        F.col("source").alias("tags"),
        F.col("text").alias("input"),
    )


def problems_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("difficulty"),
        F.col("p_brand").alias("tags"),
        F.col("p_name").alias("input"),
    )


def solutions_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a document are the solutions of a problem."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("sol_idx", "solution")
    )


def generations_conv(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns carry one code block, every third turn a second one."""
    two = F.concat(
        F.lit("```python\n"), "text", F.lit("\n```\nthen\n```python\nimport sys\nfrom os import *\n```")
    )
    one = F.concat(F.lit("Answer:\n```python\n  "), "text", F.lit("\n\n```"))
    is_code = F.col("role") == "assistant"
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("task_id"),
        F.col("turn").alias("gen_idx"),
        F.when(is_code & (F.col("turn") % 3 == 0), two)
        .when(is_code, one)
        .otherwise(F.col("text"))
        .alias("generated_text"),
    )


def line_tests(spark: SparkSession, sf: str) -> DataFrame:
    """One recorded test per row of ``lineitem``, numbered from 0 within its order."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_quantity").alias("quantity"),
        F.ascii("l_returnflag").alias("flag"),
    )
    numbered = skew.index_within(rows, ["l_orderkey"], rows.columns, "test_idx")
    return numbered.withColumn("test_idx", F.col("test_idx").cast("int"))


def _verdict(quantity: Column) -> Column:
    return F.when(quantity > 10, 1).when(quantity > 5, 0).when(quantity > 2, -1).otherwise(-3)


def verdicts_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Task = customer, generation = order; an order without lines did not compile."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tests = line_tests(spark, sf)
    treatment = (
        F.when(F.col("o_orderstatus") == "P", "no_context")
        .when(F.col("o_orderstatus") == "O", "full_problem")
        .otherwise("only_solutions")
    )
    return orders.join(tests, orders.o_orderkey == tests.l_orderkey, "left").select(
        F.col("o_custkey").alias("task_id"),
        F.col("o_orderkey").alias("gen_idx"),
        treatment.alias("context_type"),
        F.coalesce("test_idx", F.lit(0)).alias("test_idx"),
        F.when(F.col("l_orderkey").isNull(), -2).otherwise(_verdict(F.col("quantity"))).alias("verdict"),
    )


def task_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("grp")
    )


def events_gens(spark: SparkSession, sf: str) -> DataFrame:
    """One generation with one test per event."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("gen_idx"),
        F.lit(0).alias("test_idx"),
        F.when(kind == "purchase", 1)
        .when(kind == "view", 0)
        .when(kind == "click", -1)
        .when(kind == "error", -3)
        .otherwise(-2)
        .alias("verdict"),
    )


def attempts_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three attempts per test under two program variants; the second runs, but not for
    every tenth order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    tests = line_tests(spark, sf)
    base = (
        orders.join(tests, orders.o_orderkey == tests.l_orderkey)
        .withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("variant", F.explode(F.array(F.lit(1), F.lit(2))))
        .filter((F.col("variant") == 1) | (F.col("o_orderkey") % 10 != 3))
    )
    first = F.when(F.col("flag") == ord("R"), 0).when(F.col("flag") == ord("A"), 1).otherwise(2)
    code = (
        F.when(F.col("variant") == 2, 0)
        .when(F.col("attempt") == 1, first)
        .when(F.col("attempt") == 2, (F.col("suppkey") % 2).cast("int"))
        .otherwise((F.col("partkey") % 2).cast("int"))
    )
    return base.select(
        F.col("o_custkey").alias("task_id"),
        F.col("o_orderkey").alias("gen_idx"),
        "test_idx",
        "variant",
        "attempt",
        code.alias("exit_code"),
        ((F.col("attempt") == 1) & (F.col("l_linenumber") == 7)).alias("timed_out"),
        ((F.col("attempt") == 1) & (F.col("partkey") % 97 == 0)).alias("launch_error"),
        F.concat(((F.col("partkey") + F.col("attempt")) % 4).cast("string"), F.lit("\n")).alias("stdout"),
        (F.col("suppkey") % 4).cast("string").alias("expected"),
    )


def generations_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a generation; those of low priority did not compile."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("task_id"),
        F.col("o_orderkey").alias("gen_idx"),
        (F.col("o_orderpriority") != "5-LOW").alias("compiled"),
    )


def _treated(runs: DataFrame) -> DataFrame:
    """Every generation under each treatment, by the same number; odd ones in another group."""
    return runs.withColumns({
        "context_type": F.explode(F.array(*[F.lit(t) for t in schemas.TREATMENTS])),
        "grp": F.when(F.col("gen_idx") % 2 == 0, "even").otherwise("odd"),
    })


def treated_generations(spark: SparkSession, sf: str) -> DataFrame:
    return _treated(generations_orders(spark, sf))


def treated_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """First attempts; whole problems as context mend most outputs, solutions alone spoil all."""
    first = attempts_lines(spark, sf).filter("variant = 1 and attempt = 1")
    mended = (F.col("context_type") == schemas.FULL_PROBLEM) & (F.col("gen_idx") % 3 != 0)
    stdout = (
        F.when(F.col("context_type") == schemas.ONLY_SOLUTIONS, "none")
        .when(mended, F.col("expected"))
        .otherwise(F.col("stdout"))
    )
    return _treated(first).withColumn("stdout", stdout)


def samples_with_lists(spark: SparkSession, sf: str) -> DataFrame:
    """``samples_orders``, of which every tenth on standard input has a first input that is no text."""
    samples = samples_orders(spark, sf)
    listed = F.regexp_replace("input_output", r'^\{"inputs":\[("[^"]*"|\["[^"]*","[^"]*"\])', '{"inputs":[[7]')
    return samples.withColumn("input_output", F.when(F.col("id") % 10 == 1, listed).otherwise(F.col("input_output")))


# Programs recorded for each problem of ``samples_orders``.
PROGRAMS = 2


def _programs(orders: DataFrame) -> DataFrame:
    return orders.withColumn("gen_idx", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PROGRAMS)])))


def problem_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Two programs for every order as a problem; some second ones did not compile."""
    return _programs(table(spark, sf, "orders").select("o_orderkey")).select(
        F.col("o_orderkey").alias("task_id"),
        "gen_idx",
        ((F.col("gen_idx") == 0) | (F.col("o_orderkey") % 7 != 3)).alias("compiled"),
    )


def problem_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """One attempt per test, a call-based program's only at the first; no expected output.

    The second program's output is wrong for every third part.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    call = F.col("o_orderstatus") == "F"
    part, supp = F.col("partkey").cast("string"), F.col("suppkey").cast("string")
    right = F.when(call, F.format_string('{"%s": %s}', part, supp)).otherwise(F.concat(supp, F.lit("\n")))
    tests = line_tests(spark, sf)
    rows = orders.join(tests, orders.o_orderkey == tests.l_orderkey).filter(~call | (F.col("test_idx") == 0))
    return _programs(rows).select(
        F.col("o_orderkey").alias("task_id"),
        "gen_idx",
        F.lit(1).alias("variant"),
        "test_idx",
        F.lit(1).alias("attempt"),
        F.lit(0).alias("exit_code"),
        F.lit(False).alias("timed_out"),
        F.lit(False).alias("launch_error"),
        F.when((F.col("gen_idx") == 0) | (F.col("partkey") % 3 != 0), right).otherwise("x").alias("stdout"),
    )


def pairs_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Expected and actual output; the line number selects the deviation."""
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    line = F.col("l_linenumber")
    plain = F.concat_ws("\n", part, supp)
    actual = (
        F.when(line == 1, plain)
        .when(line == 2, F.concat(plain, F.lit("\n")))
        .when(line == 3, F.concat_ws("\n", supp, part))
        .when(line == 4, F.concat(F.lit("  "), part, F.lit(" \n\n"), supp, F.lit(" ")))
        .when(line == 5, F.concat(part, F.lit(".0\n"), supp, F.lit(".0")))
        .when(line == 6, F.concat(part, F.lit(".0000001\n"), supp))
        .otherwise(F.concat((F.col("l_partkey") + 1).cast("string"), F.lit("\n"), supp))
    )
    return _lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        plain.alias("expected"),
        actual.alias("actual"),
    )


def calls_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Call results as JSON; the line number selects how the two sides are written."""
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    line = F.col("l_linenumber")

    def text(pattern: str) -> Column:
        return F.format_string(pattern.replace("P", "%1$s").replace("S", "%2$s"), part, supp)

    expected = (
        F.when(line.isin(1, 2), text("[P,S]"))
        .when(line == 3, text('[[P,S],"x"]'))
        .when(line == 4, text('{"a":P,"b":[S,null]}'))
        .when(line == 5, text("[P]"))
        .when(line == 6, text('"P S"'))
        .otherwise(text('["P",S]'))
    )
    actual = (
        F.when(line == 1, text("[P, S]"))
        .when(line == 2, text("[P.0,Se0]"))
        .when(line == 3, text("[P,S]"))
        .when(line == 4, text('{"b": [S, null], "a": P}'))
        .when(line == 5, text("S"))
        .when(line == 6, text('"S P"'))
        .otherwise(text("[P,S]"))
    )
    return _lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        actual.alias("actual"),
        expected.alias("expected"),
    )


def samples_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Raw samples: one JSON document per order, at most one test per line number.

    Status F is call-based, with objects as expected values; status O has lists of
    strings, others plain strings. Every 50th document is cut off.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    tests = line_tests(spark, sf)
    call, listed = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    part, supp = F.col("partkey").cast("string"), F.col("suppkey").cast("string")
    given = (
        F.when(call, F.format_string('[{"%s":%s}]', supp, part))
        .when(listed, F.format_string('["%s","%s"]', part, supp))
        .otherwise(F.format_string('"%s\\n%s"', part, supp))
    )
    wanted = (
        F.when(call, F.format_string('{"%s":%s}', part, supp))
        .when(listed, F.format_string('["%s"]', supp))
        .otherwise(F.format_string('"%s"', supp))
    )
    gathered = (
        orders.join(tests, orders.o_orderkey == tests.l_orderkey)
        .groupBy("o_orderkey", "o_orderstatus")
        .agg(F.sort_array(F.collect_list(F.struct("test_idx", given.alias("i"), wanted.alias("o")))).alias("t"))
    )
    document = F.concat(
        F.lit('{"inputs":['),
        F.array_join("t.i", ","),
        F.lit('],"outputs":['),
        F.array_join("t.o", ","),
        F.when(call, F.lit('],"fn_name":"solve"}')).otherwise(F.lit("]}")),
    )
    return gathered.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit('{"inputs": [')).otherwise(document).alias("input_output"),
    )


def picks_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Hand-picked ids: an order's first part is the target, its other parts the contexts."""
    listed = line_tests(spark, sf).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("test_idx", "partkey"))).alias("t")
    )
    parts = F.col("t.partkey")
    return listed.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("grp"),
        F.get(parts, F.lit(0)).alias("target_id"),
        F.lit(0).alias("target_pos"),
        F.slice(parts, F.lit(2), F.size(parts)).alias("context_ids"),
    )


def stage_clock(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts"
    )


def run_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Logged stages of every run: a user's events are dealt to three treatments by their number."""
    names = F.array(*[F.lit(t) for t in schemas.TREATMENTS])
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"),
        F.get(names, (F.col("event_id") % 3).cast("int")).alias("context_type"),
        F.col("event_type").alias("stage"),
        "ts",
    )
    return events.join(task_groups(spark, sf), "task_id")


def group_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a target of its group, numbered in order."""
    rows = task_groups(spark, sf).select("grp", F.col("task_id").alias("target_id"))
    placed = skew.global_index(rows, ["grp", "target_id"], "place").df
    first = placed.groupBy("grp").agg(F.min("place").alias("first"))
    return placed.join(first, "grp").select("grp", "target_id", (F.col("place") - F.col("first")).alias("target_pos"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
