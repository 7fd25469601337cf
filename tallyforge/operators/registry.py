"""Operators by name, for callers that choose them at run time; and the same operator over many projects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named functions from frames and parameters to a DataFrame."""

    def __init__(self):
        self.functions: dict[str, tuple[Callable[..., DataFrame], str]] = {}

    def register(self, name: str, function: Callable[..., DataFrame], description: str = "") -> None:
        if name in self.functions:
            raise ValueError(f"{name} is registered already")
        self.functions[name] = function, description

    def names(self) -> dict[str, str]:
        return {name: text for name, (_, text) in sorted(self.functions.items())}

    def run(self, name: str, *frames: DataFrame, **parameters) -> DataFrame:
        return self.functions[name][0](*frames, **parameters)


def in_projects(df: DataFrame, projects: list | None = None) -> DataFrame:
    """Rows of some projects (all by default): a filter on the partition column, so other projects aren't read."""
    return df if projects is None else df.filter(F.col("project_id").isin(*projects))


def copy_project(df: DataFrame, source, target) -> DataFrame:
    """A project's rows under another project's id."""
    return df.filter(F.col("project_id") == source).withColumn("project_id", F.lit(target).cast(df.schema["project_id"].dataType))


def merged_results(results: dict[str, DataFrame]) -> DataFrame:
    """Results of the same operator over several projects in one frame, each row with its project_id."""
    out = None
    for project, df in sorted(results.items()):
        one = df.drop("project_id").withColumn("project_id", F.lit(project))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("there are no results to merge")
    return out


def projects(df: DataFrame) -> DataFrame:
    """project_id and rows of every project."""
    return df.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"))


def without_project(df: DataFrame, project) -> DataFrame:
    """All rows but a project's; rows without a project stay."""
    return df.filter(~F.col("project_id").eqNullSafe(F.lit(project)))
