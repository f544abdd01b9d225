"""Declared schemas and the constants shared by every operator."""

from pyspark.sql import types as T

PROBLEMS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("input", T.StringType()),
    ]
)

SOLUTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sol_idx", T.IntegerType()),
        T.StructField("solution", T.StringType()),
    ]
)

EVALUATION_TESTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("test_idx", T.IntegerType()),
        T.StructField("input", T.StringType()),
        T.StructField("expected", T.StringType()),
    ]
)

RAW_SAMPLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("input_output", T.StringType()),
    ]
)

GENERATIONS = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("gen_idx", T.LongType()),
        T.StructField("generated_text", T.StringType()),
    ]
)

PARSED = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("gen_idx", T.LongType()),
        T.StructField("code", T.StringType()),
    ]
)

VERDICTS = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("gen_idx", T.LongType()),
        T.StructField("test_idx", T.IntegerType()),
        T.StructField("verdict", T.IntegerType()),
    ]
)

# Verdict codes and the status each one stands for.
PASSED = 1
FALSE = 0
TIMEOUT = -1
COMPILE_ERROR = -2
RUNTIME_ERROR = -3
STATUS_NAMES = {
    PASSED: "passed",
    FALSE: "false",
    TIMEOUT: "timeout",
    COMPILE_ERROR: "compile_error",
    RUNTIME_ERROR: "runtime_error",
}

# The three context treatments, in run order.
NO_CONTEXT = "no_context"
FULL_PROBLEM = "full_problem"
ONLY_SOLUTIONS = "only_solutions"
TREATMENTS = (NO_CONTEXT, FULL_PROBLEM, ONLY_SOLUTIONS)
