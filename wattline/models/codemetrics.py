"""Static code metrics of Python sources, as a Spark job.

Each source file is parsed with the standard-library ``ast`` inside
``mapInArrow`` (one file per row, parsed where the row lives, in batches of
few bytes); bundle totals are an ordinary aggregation.  A file that does not parse keeps its
line count and contributes no syntax metrics.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_SCHEMA = ("bundle string, path string, loc long, num_loops long, num_conditionals long, "
               "num_function_calls long, max_nesting_depth long, cc_sum long, cc_blocks long, parsed boolean")

#: Bytes of an Arrow batch (a setting of the session): rows hold whole files,
#: and each worker of an executor holds a batch.
BATCH_BYTES = 4 << 20


# What raises complexity, and by how much (lists of parts of a node).
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTING = (ast.For, ast.While, ast.If)


def decisions(node: ast.AST) -> int:
    """Decision points of one node: branches, conditional expressions and
    assertions 1, boolean operators one per extra operand, loops 1 and 1 more
    for their ``else``, handlers 1 each and 1 for the ``else`` of a ``try``,
    comprehensions 1 and 1 per condition, cases 1 each but for ``case _``."""
    if isinstance(node, (ast.If, ast.IfExp, ast.Assert)):
        return 1
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, _LOOPS):
        return 1 + bool(node.orelse)
    if isinstance(node, (ast.Try, getattr(ast, "TryStar", ast.Try))):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.Match):
        rest = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in node.cases)
        return max(0, len(node.cases) - rest)
    return 0


def _scope(statements: list[ast.AST]) -> tuple[int, list[ast.AST]]:
    """(decision points, scopes) of statements; functions and classes among
    them are returned, not entered."""
    total, inner, todo = 0, [], list(reversed(statements))
    while todo:
        node = todo.pop()
        if isinstance(node, _SCOPES):
            inner.append(node)
            continue
        total += decisions(node)
        if not isinstance(node, ast.Assert):
            todo.extend(ast.iter_child_nodes(node))
    return total, inner


def blocks(tree: ast.Module) -> list[int]:
    """Complexities of the blocks of a module: its functions, its classes and
    their methods.  A function counts 1 and its own decisions, closures apart.
    A class without methods counts 1 and its decisions; with methods, the mean
    over them of all that, plus 1 where it has several."""
    out = []
    for scope in _scope(tree.body)[1]:
        if isinstance(scope, _FUNCTIONS):
            out.append(1 + _scope(scope.body)[0])
            continue
        own, inner = _scope(scope.body)
        methods = [1 + _scope(m.body)[0] for m in inner if isinstance(m, _FUNCTIONS)]
        real = 1 + own + sum(methods)
        out.append(int(real / len(methods)) + (len(methods) > 1) if methods else real)
        out += methods
    return out


def counts(tree: ast.AST) -> tuple[int, int, int, int]:
    """(loops, conditionals, calls, deepest nesting of loops and conditionals):
    one walk with an explicit stack of (node, depth)."""
    loops = ifs = calls = deepest = 0
    todo = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, _NESTING):
            depth += 1
            deepest = max(deepest, depth)
            loops += not isinstance(node, ast.If)
            ifs += isinstance(node, ast.If)
        calls += isinstance(node, ast.Call)
        todo.extend((child, depth) for child in ast.iter_child_nodes(node))
    return loops, ifs, calls, deepest


def file_metrics(content: str) -> tuple:
    """(LOC, loops, conditionals, calls, nesting, sum and number of block
    complexities, parsed).  A file that does not parse has only its LOC."""
    loc = sum(1 for ln in content.splitlines() if ln.strip() and not ln.strip().startswith("#"))
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return loc, 0, 0, 0, 0, 0, 0, False
    cc = blocks(tree)
    return (loc, *counts(tree), sum(cc), len(cc), True)


def source_metrics(sources: DataFrame, bundle: str = "bundle", path: str = "path", content: str = "content") -> DataFrame:
    """One row per source file with its metrics."""
    src = sources.select(F.col(bundle).cast("string").alias("bundle"), F.col(path).cast("string").alias("path"),
                         F.col(content).alias("content"))

    sources.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    types = [pa.int64()] * 7 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time as a Python object
            rows = [file_metrics(c.as_py() or "") for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("bundle"), batch.column("path"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]],
                                             names=["bundle", "path", "loc", "num_loops", "num_conditionals", "num_function_calls",
                                                    "max_nesting_depth", "cc_sum", "cc_blocks", "parsed"])

    return src.mapInArrow(run, FILE_SCHEMA)


def bundle_metrics(files: DataFrame) -> DataFrame:
    """Per bundle: summed LOC (at least 1), loops, conditionals and calls, the
    deepest nesting, and the mean complexity over all blocks (1.0 when the
    bundle has none)."""
    g = files.groupBy("bundle").agg(
        F.sum("loc").alias("loc"), F.sum("num_loops").alias("num_loops"),
        F.sum("num_conditionals").alias("num_conditionals"), F.sum("num_function_calls").alias("num_function_calls"),
        F.max("max_nesting_depth").alias("max_nesting_depth"), F.sum("cc_sum").alias("_cc"),
        F.sum("cc_blocks").alias("_blocks"), F.count(F.lit(1)).alias("files"))
    return g.select("bundle", F.greatest(F.col("loc"), F.lit(1)).alias("lines_of_code"), "num_loops",
                    "num_conditionals", "num_function_calls", "max_nesting_depth",
                    F.when(F.col("_blocks") > 0, F.col("_cc") / F.col("_blocks")).otherwise(F.lit(1.0))
                    .alias("cyclomatic_complexity"), "files")
