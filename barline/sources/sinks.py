"""Snapshots, CSV, JSON and text sinks, and stored models."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


DONE = "_SUCCESS"


def _published(spark: SparkSession, home: str) -> str | None:
    """The folder below ``home`` whose end marker is the oldest; of equally old ones the first by name."""
    files, target = _files(spark, f"{home}/*/{DONE}")
    found = files.globStatus(target) or []
    ends = [(f.getModificationTime(), f.getPath().getParent().getName()) for f in found]
    return f"{home}/{min(ends)[1]}" if ends else None


def _own_folder(home: str) -> str:
    return f"{home}/by-{uuid.uuid4().hex}"


def fingerprint(*parts: object) -> str:
    """Short stable hash of whatever identifies the input of a snapshot."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def file_key(spark: SparkSession, *paths: str) -> str:
    """Key of an input: changes if a file below ``paths`` is added, removed, rewritten or has another size.

    Spark lists the files and adds up their names, sizes and times; no content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    each = F.xxhash64("path", "length", "modificationTime")
    found = files.select("length", each.alias("file")).agg(F.count("file"), F.sum("length"), F.bit_xor("file")).first()
    return fingerprint(*found)


def snapshot(spark: SparkSession, compute: Callable[[], DataFrame], path: str, key: str) -> DataFrame:
    """Read the finished snapshot ``key`` below ``path``; compute and write one first if there is none.

    Writers that run at the same time write to folders of their own. Spark's marker at the end of a write
    publishes the folder; all readers take the folder finished first, and none is ever overwritten, so a reader
    keeps its files. A write cut short has no marker and is never read.
    """
    home = f"{path.rstrip('/')}/fp={key}"
    if _published(spark, home) is None:
        compute().write.parquet(_own_folder(home))
    found = _published(spark, home)
    if found is None:
        raise RuntimeError("the write left no end marker; set mapreduce.fileoutputcommitter.marksuccessfuljobs")
    return spark.read.parquet(found)


BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mark: bool = False) -> None:
    """CSV with header, one file per partition; with ``mark`` every file starts with a byte order mark."""
    if mark:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One JSON object per model: its name, its scores and, where the table has one, its ``architecture``."""
    scores = ["r2", "rmse", "mae", *(["architecture"] if "architecture" in metrics.columns else [])]
    metrics.select("model", F.struct(*scores).alias("scores")).write.mode("overwrite").json(path)


# Head of the classification report.
REPORT_TITLE = "# 验证集涨跌预测分类报告"
TITLE_RULE = "=" * 80


def write_report(report: DataFrame, path: str) -> None:
    """Title, then the text blocks, one per model in the order of their names, in one file.

    A report has one block per model, a number set by the trial list.
    """
    head = report.sparkSession.createDataFrame([("", f"{REPORT_TITLE}\n\n{TITLE_RULE}\n")], "model string, value string")
    blocks = report.select("model", F.col("block").alias("value"))
    head.unionByName(blocks).coalesce(1).sortWithinPartitions("model").select("value").write.mode("overwrite").text(path)


def fit_or_load(estimator: Estimator, train: DataFrame, path: str, key: str = "") -> Model:
    """Load the fitted pipeline of this estimator and input below ``path``; fit and save it if there is none.

    The folder carries a fingerprint of the estimator's class and parameters, of the columns of ``train``
    and of ``key``, which has to name the input (:func:`file_key`, say), so no other fit is loaded. Each fit is
    saved to a folder of its own and published, as a snapshot is, by an end marker after its last file.
    """
    spark = train.sparkSession
    parameters = sorted((p.name, repr(v)) for p, v in estimator.extractParamMap().items())
    home = f"{path.rstrip('/')}/fp={fingerprint(type(estimator).__name__, parameters, train.dtypes, key)}"
    found = _published(spark, home)
    if found:
        return PipelineModel.load(found)
    model = Pipeline(stages=[estimator]).fit(train)
    own = _own_folder(home)
    model.write().save(own)
    files, marker = _files(spark, f"{own}/{DONE}")
    files.create(marker, False).close()
    return PipelineModel.load(_published(spark, home))
