"""The metric schema: names in order, types, and what may be unknown."""

from __future__ import annotations

from pyspark.sql import types as T

#: The metrics that every row has, then those that may be unknown, each with its type.
ALWAYS = {
    **dict.fromkeys("files sloc largest_file_sloc tokens_est tokens_est_with_tests internal_imports external_imports stdlib_imports fan_in fan_in_tests exported_symbols globals init_funcs max_nesting cognitive_total cognitive_p90 cyclomatic_total cyclomatic_p90 func_count dup_blocks".split(), "bigint"),
    "duplication_pct": "double", "test_files": "bigint", "test_funcs": "bigint", "has_tests": "boolean", "untested_exports": "bigint",
}
SOMETIMES = {
    **dict.fromkeys("internal_imports_descendants internal_imports_private dup_blocks_code duplicated_lines untested_exports_covered documented_exports dup_blocks_cross_pkg".split(), "bigint"),
    **dict.fromkeys("instability abstractness main_sequence_distance".split(), "double"), "uses_cgo": "boolean", "uses_reflect": "boolean",
    "generated_files": "bigint", "tokens_est_generated": "bigint", "coverage_pct": "double", "changed_func_cognitive_max": "bigint", "churn_commits": "bigint", "churn_authors": "bigint",
}
METRICS = {**ALWAYS, **SOMETIMES}
#: Upper bounds of the metrics that have one.
UPPER = {"duplication_pct": 100.0, "coverage_pct": 100.0, "instability": 1.0, "abstractness": 1.0, "main_sequence_distance": 1.0}

_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def row_schema() -> T.StructType:
    """package, role and every metric."""
    return T.StructType([T.StructField("package", T.StringType(), False), T.StructField("role", T.StringType()), *[T.StructField(m, _TYPES[t], m in SOMETIMES) for m, t in METRICS.items()]])


def names() -> list[str]:
    return list(METRICS)


def known(name: str) -> bool:
    return name in METRICS
