"""Saved models, research reports and settings."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Values under ``spark.pitframe.`` in a session's configuration, with defaults."""

    warehouse: str = "warehouse"
    models: str = "models"
    horizon: int = 10
    cost_bps: float = 10.0

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"spark.pitframe.{f.name}", None) for f in fields(cls)}
        kinds = {"horizon": int, "cost_bps": float}
        return cls(**{k: kinds.get(k, str)(v) for k, v in given.items() if v is not None})


def _at(spark: SparkSession, path: str):
    """A path and its file system, whichever Spark reads it by."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, files = _at(spark, path)
    return files.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    found, files = _at(spark, path)
    files.delete(found, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, for plans that read it often, to the folder of ``spark.checkpoint.dir``; without that setting, on one machine, to a temporary one."""
    sc = df.sparkSession.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pitframe-")
    df.write.parquet(path := f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def model_path(root: str, entity: str, horizon: int, kind: str = "clf") -> str:
    return f"{root}/{entity}_{kind}_h{horizon}"


def save_model(model: PipelineModel, root: str, entity: str, horizon: int, kind: str = "clf") -> str:
    path = model_path(root, entity, horizon, kind)
    model.write().overwrite().save(path)
    return path


def registry(spark: SparkSession, root: str) -> DataFrame:
    """``entity, kind, horizon_days, path, saved`` of every saved model, from file listings alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/*/metadata").select("path", F.col("modificationTime").alias("saved"))
    name = F.regexp_extract("path", "/([^/]+)/metadata/", 1)
    got = files.select(
        F.regexp_extract(name, "^(.*)_([a-z]+)_h([0-9]+)$", 1).alias("entity"), F.regexp_extract(name, "^(.*)_([a-z]+)_h([0-9]+)$", 2).alias("kind"),
        F.regexp_extract(name, "^(.*)_([a-z]+)_h([0-9]+)$", 3).try_cast("int").alias("horizon_days"), F.regexp_extract("path", "^(.*)/metadata/", 1).alias("path"), "saved",
    )
    return got.where("horizon_days is not null")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report(summary: DataFrame, title: str) -> tuple[str, str]:
    """A study's summary, which is a few rows, as JSON and as a Markdown table."""
    rows = [r.asDict() for r in summary.collect()]
    names = summary.columns
    shown = lambda x: "—" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    table = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(shown(r[c]) for c in names) + " |" for r in rows)]
    return json.dumps({"title": title, "rows": rows}, default=str, allow_nan=False), "\n".join([f"## {title}", "", *table, ""])


def splice(text: str, begin: str, end: str, new: str) -> str:
    """``text`` with what stands between the markers replaced; appended with markers where they are missing."""
    if begin in text and end in text.split(begin, 1)[1]:
        head, rest = text.split(begin, 1)
        return f"{head}{begin}\n{new}\n{end}{rest.split(end, 1)[1]}"
    return f"{text.rstrip()}\n\n{begin}\n{new}\n{end}\n"
