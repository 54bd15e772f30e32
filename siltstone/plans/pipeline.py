"""Pipelines of named steps: each writes its result once and is skipped when it is there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Step:
    name: str
    run: Callable[..., DataFrame]
    needs: list[str] = field(default_factory=list)


class Pipeline:
    """Steps run in the order of their needs; ``rebuild`` runs finished ones again."""

    def __init__(self, spark: SparkSession, root: str, steps: list[Step]):
        self.spark, self.root, self.steps = spark, root.rstrip("/"), {s.name: s for s in steps}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def order(self, goal: str) -> list[str]:
        seen: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in seen:
                return
            if name in open_:
                raise ValueError(f"{name} needs itself")
            open_.add(name)
            for n in self.steps[name].needs:
                visit(n)
            seen.append(name)

        visit(goal)
        return seen

    def run(self, goal: str, rebuild: bool = False) -> DataFrame:
        for name in self.order(goal):
            if rebuild or not self.done(name):
                step = self.steps[name]
                step.run(self.spark, *(self.spark.read.parquet(self.path(n)) for n in step.needs)).write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(goal))
