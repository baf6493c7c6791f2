"""Feature names and their display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 33 model inputs in model order (15 numerics, 14 function
# name dummies, 2 function type dummies, 2 input size dummies).
FEATURE_ORDER = (
    "memory_config_mb", "cold_start", "lines_of_code", "num_loops", "num_conditionals",
    "num_function_calls", "cyclomatic_complexity", "max_nesting_depth", "local_duration_ms",
    "local_cpu_percent", "local_memory_mb", "aws_duration_ms", "aws_memory_used_mb",
    "duration_ratio", "memory_efficiency",
    "function_name_array-operations", "function_name_bubble-sort", "function_name_csv-processor",
    "function_name_data-transform", "function_name_dict-builder", "function_name_fibonacci",
    "function_name_file-reader", "function_name_json-parser", "function_name_list-comprehension",
    "function_name_matrix-multiply", "function_name_prime-calculator",
    "function_name_simple-encryption", "function_name_string-concat",
    "function_name_url-validator",
    "function_type_io", "function_type_memory",
    "input_size_Medium", "input_size_Small",
)

# Readable labels of raw feature names.
FEATURE_LABELS = {
    "memory_config_mb": "Provisioned Memory (MB)",
    "cold_start": "Cold Start Event",
    "lines_of_code": "Source Lines of Code (LOC)",
    "num_loops": "Loop Instruction Count",
    "num_conditionals": "Conditional Branches",
    "num_function_calls": "Function Calls",
    "cyclomatic_complexity": "Cyclomatic Complexity",
    "max_nesting_depth": "Max Code Nesting Depth",
    "local_duration_ms": "Local Execution Time (ms)",
    "local_cpu_percent": "Local CPU Utilization (%)",
    "local_memory_mb": "Local Memory Footprint (MB)",
    "aws_duration_ms": "AWS Execution Duration (ms)",
    "aws_memory_used_mb": "AWS Max Memory Used (MB)",
    "duration_ratio": "AWS to Local Duration Ratio",
    "memory_efficiency": "Memory Config Efficiency",
    "calibration_ratio": "Calibration Ratio Constant",
    "function_name_array-operations": "Func: Array Operations",
    "function_name_bubble-sort": "Func: Bubble Sort",
    "function_name_csv-processor": "Func: CSV Processor",
    "function_name_data-transform": "Func: Data Transform",
    "function_name_dict-builder": "Func: Dictionary Builder",
    "function_name_fibonacci": "Func: Fibonacci",
    "function_name_file-reader": "Func: File Reader",
    "function_name_json-parser": "Func: JSON Parser",
    "function_name_list-comprehension": "Func: List Comprehension",
    "function_name_matrix-multiply": "Func: Matrix Multiply",
    "function_name_prime-calculator": "Func: Prime Calculator",
    "function_name_simple-encryption": "Func: Simple Encryption",
    "function_name_string-concat": "Func: String Concat",
    "function_name_url-validator": "Func: URL Validator",
    "function_type_io": "Type: I/O Bound",
    "function_type_memory": "Type: Memory Intensive",
    "input_size_Medium": "Input Size: Medium",
    "input_size_Small": "Input Size: Small",
}


def raw_feature_name(short: Column) -> Column:
    """``f<i>`` -> i-th model feature (null when out of range)."""
    idx = F.regexp_extract(short, r"^f(\d+)$", 1)
    arr = F.array(*[F.lit(x) for x in FEATURE_ORDER])
    i = F.when(idx != "", idx.cast("int"))
    return F.when((i >= 0) & (i < len(FEATURE_ORDER)), F.try_element_at(arr, i + 1))


def fallback_label(raw: Column) -> Column:
    """Dashes / underscores to spaces, first letter of each word upper-cased,
    the rest left as is (``initcap`` would lower-case the tail)."""
    words = F.split(F.regexp_replace(raw, "[_-]", " "), " ")
    cap = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.array_join(cap, " ")


def feature_label(raw: Column) -> Column:
    """Map lookup (a literal map: fixed, tiny) with the fallback rule."""
    m = F.create_map(*[x for kv in FEATURE_LABELS.items() for x in map(F.lit, kv)])
    return F.coalesce(F.try_element_at(m, raw), fallback_label(raw))
