"""Fitted models as versioned tables: fit once, store, load in any session, forecast."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.forecast.tree import TreeModel
from seriesloom.session import materialize

_VERSIONS = "version bigint, kind string, folder string, meta string"
_TREES = {"GBTRegressionModel": GBTRegressionModel, "RandomForestRegressionModel": RandomForestRegressionModel}


@dataclass
class Stored:
    """A loaded model: a table of fits or a tree model, its version and what was noted when it was saved."""

    model: DataFrame | TreeModel
    version: int
    meta: dict


class ModelStore:
    """Models by name under one folder of any store that Spark writes to.

    Each save writes a folder of its own; a version counts once its row has been appended to the table of versions, which is a single
    committed write, so a reader sees the old version or the new one and a save that dies leaves no trace in it. One job at a time saves
    a name; of two saves at once the one with the larger folder name is taken as the later.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, name: str) -> DataFrame:
        """version, kind, folder and meta of every save of a name; empty for an unknown one."""
        try:
            return self.spark.read.schema(_VERSIONS).parquet(f"{self.path}/{name}/versions")
        except Exception as err:
            if "PATH_NOT_FOUND" in str(err):
                return self.spark.createDataFrame([], _VERSIONS)
            raise

    def _commit(self, name: str, kind: str, folder: str, meta: dict) -> int:
        version = (self.versions(name).agg(F.max("version")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(version, kind, folder, json.dumps(meta))], _VERSIONS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}/versions")
        return version

    def save_table(self, name: str, fits: DataFrame, **meta) -> int:
        """Store the fits of a model that are one row per series (``fit_arima``, ``fit_decomposable``); returns the version."""
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        fits.write.parquet(folder)
        return self._commit(name, "table", folder, meta)

    def save_tree(self, name: str, model: TreeModel, **meta) -> int:
        """Store a tree model with the names of its features and the levels of its series; returns the version."""
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        model.model.write().save(f"{folder}/trees")
        if model.levels is not None:
            model.levels.write.parquet(f"{folder}/levels")
        made = {k: getattr(model, k) for k in ("features", "delta", "span", "exog")} | {"lags": list(model.lags), "windows": list(model.windows)}
        return self._commit(name, type(model.model).__name__, folder, {"made": made, "grouped": model.levels is not None, "meta": meta})

    def load(self, name: str, version: int | None = None) -> Stored:
        """The latest version of a model, or the given one."""
        table = self.versions(name)
        if version is not None:
            table = table.where(F.col("version") == version)
        row = table.orderBy(F.desc("version"), F.desc("folder")).first()
        if row is None:
            raise KeyError(f"no version {version} of {name}" if version is not None else f"no model {name}")
        meta = json.loads(row["meta"])
        if row["kind"] == "table":
            return Stored(self.spark.read.parquet(row["folder"]), row["version"], meta)
        trees = _TREES[row["kind"]].load(f"{row['folder']}/trees")
        levels = materialize(self.spark.read.parquet(f"{row['folder']}/levels")) if meta["grouped"] else None
        return Stored(TreeModel(trees, levels=levels, **meta["made"]), row["version"], meta["meta"])
