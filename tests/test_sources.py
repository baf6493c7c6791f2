"""File sources: glob of daily files with the day from the path; telemetry
CSV with True/False cold starts."""

import os
import tempfile

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wattline.sources import files as IO


def test_trace_glob_day_from_path_and_column_subset(spark):
    root = tempfile.mkdtemp(prefix="wattline-days-")
    for day, rows in ((1, "a,f1,10.0\nb,f2,20.0\n"), (2, "a,f1,30.0\n")):
        os.makedirs(f"{root}/day={day}")
        with open(f"{root}/day={day}/part.csv", "w") as f:
            f.write("HashApp,HashFunction,Average\n" + rows)
    schema = StructType([StructField("HashApp", StringType()), StructField("HashFunction", StringType()),
                         StructField("Average", DoubleType())])
    df, _ = IO.read_trace_glob(spark, f"{root}/day=*/*.csv", schema, ["HashFunction", "Average"])
    assert df.columns == ["HashFunction", "Average", "day"]
    assert sorted(tuple(r) for r in df.collect()) == [("f1", 10.0, 1), ("f1", 30.0, 2), ("f2", 20.0, 1)]


def test_telemetry_csv_cold_start_variants(spark):
    root = tempfile.mkdtemp(prefix="wattline-tel-")
    cols = [f.name for f in IO.TELEMETRY_SCHEMA.fields]
    lines = [",".join(cols)]
    for i, cs in enumerate(("True", "False", "1", "0", "junk")):
        vals = [f"fn{i}", "io", "Small"] + [cs if c == "cold_start" else "1.5" for c in cols[3:]]
        lines.append(",".join(vals))
    with open(f"{root}/t.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    rows, report = IO.read_telemetry_csv(spark, root)
    got = {r.function_name: r.cold_start for r in rows.collect()}
    assert spark.read.parquet(IO.write_report(report, f"{root}-out")).selectExpr("sum(bad_rows)").first()[0] == 0
    assert got == {"fn0": 1, "fn1": 0, "fn2": 1, "fn3": 0, "fn4": 0}


def test_columns_by_name_whatever_the_order(spark):
    """A leading extra column, another order, short rows, a file without the columns."""
    import warnings
    root = tempfile.mkdtemp(prefix="wattline-names-")
    files = {"day=1": "HashOwner,HashApp,HashFunction,Average,Count\no,a,f,1.5,2\no,a,g,x,3\n",
             "day=2": "Count,Average,HashFunction\n7,2.5,f\n8,3.5\n9,4.5,g,extra\n", "day=3": "Other\n1\n"}
    for d, text in files.items():
        os.makedirs(f"{root}/{d}")
        with open(f"{root}/{d}/p.csv", "w") as f:
            f.write(text)
    schema = StructType([StructField("HashFunction", StringType()), StructField("Average", DoubleType())])
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        got, glob_report = IO.read_trace_glob(spark, f"{root}/day=*/*.csv", schema, ["HashFunction", "Average"])
        rows, report = IO.read_csv_by_name(spark, f"{root}/day=*", {"HashFunction": "string", "Average": "double"})
    assert any("Average" in str(x.message) for x in w)
    assert sorted(((r.HashFunction, r.Average, r.day) for r in got.collect()), key=str) == [("f", 1.5, 1), ("f", 2.5, 2), ("g", None, 1)]
    rep = {r.file.split("/")[-2]: (r.status.split(":")[0], r.rows, r.bad_rows) for r in report.collect()}
    assert rep == {"day=1": ("read", 2, 0), "day=2": ("read", 3, 2), "day=3": ("skipped", 0, 0)}
    assert rows.count() == 3
    saved = spark.read.parquet(IO.write_report(glob_report, f"{root}-out")).collect()      # a planted bad row is reported
    assert sorted((r.rows, r.bad_rows) for r in saved) == [(0, 0), (2, 0), (3, 2)]


def test_sources_in_zip_archives(spark):
    import zipfile

    from wattline.models import codemetrics as CM
    root = tempfile.mkdtemp(prefix="wattline-zip-")
    with zipfile.ZipFile(f"{root}/fn-1.zip", "w") as z:
        z.writestr("handler.py", "def f(x):\n    if x:\n        return 1\n")
        z.writestr("lib/util.py", "class A:\n    def g(self):\n        for i in y:\n            pass\n        else:\n            pass\n")
        z.writestr("data.bin", b"\xff\xfe")
    b = CM.bundle_metrics(CM.source_metrics(IO.read_code_archives(spark, root))).first()
    # blocks: f 2, A 4 (1 + method's 3, one method), g 3
    assert (b.bundle, b.files, b.lines_of_code, b.num_loops, b.num_conditionals) == ("fn-1", 2, 9, 1, 1)
    assert b.cyclomatic_complexity == 3.0


def test_code_bundle_is_a_file_per_row_written_by_the_tasks(spark, monkeypatch):
    """The writer that names and renames each file through the job's commit is not used."""
    from pyspark.sql.readwriter import DataFrameWriter
    monkeypatch.setattr(DataFrameWriter, "text", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a commit per file")))
    from wattline.plans.modelling import src_code_bundle
    from wattline.sources.tables import Catalog
    sf = tempfile.mkdtemp(prefix="wattline-bundles-")
    texts = [(1, "a\nb", "x"), (1, "a\nb", "x"), (2, None, "x"), (3, "tail\n", "p=q r"), (4, "ü 中\r\n", None), (5, "", "")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    got = sorted((r.bundle, r.n_chars) for r in src_code_bundle(Catalog(spark, sf)).collect())
    none = "__HIVE_DEFAULT_PARTITION__"
    assert [x for x in got if x[0] in ("x", none)] == [(none, 0), (none, 5), ("x", 0), ("x", 3), ("x", 3)] and len(got) == 6
    root = tempfile.mkdtemp(prefix="wattline-bundles-")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert IO.write_code_bundle(docs, root, "source", "text") == 6 == IO.write_code_bundle(docs, root, "source", "text")
    assert sum(len(f) for _, _, f in os.walk(root)) == 6


def test_source_view_deals_one_row_group_over_tasks(spark):
    """Documents that one task reads are written and parsed by several; rows stay the same."""
    from collections import Counter

    from pyspark.sql import functions as F
    from wattline.models import codemetrics as CM
    from wattline.sources.tables import source_view
    docs = spark.range(400).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("doc_id"), F.lit("web").alias("source"),
                                   F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).coalesce(1)
    rows = source_view(docs).withColumn("task", F.spark_partition_id()).collect()
    tasks = Counter(r["task"] for r in rows)
    assert len(rows) == 400 and len(tasks) > 1 and max(tasks.values()) <= 200
    assert CM.source_metrics(source_view(docs)).count() == 400
