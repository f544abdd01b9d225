"""Evaluation experiments on generated code, as Spark jobs over whole tables."""
