"""Functions called by name, fan-out over cases, and further kinds of nodes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.frames import Frames


def on_workers_path(spark: SparkSession) -> None:
    """This package on the path of workers that share the driver's disk; on a cluster it is installed or sent along."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


class Calls:
    """Functions that steps call by name, each on a pandas column of arguments (text) and giving one of results (text)."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[pd.Series], pd.Series]] = {}

    def register(self, function: Callable[[pd.Series], pd.Series]) -> Callable[[pd.Series], pd.Series]:
        if function.__name__ in self.known:
            raise ValueError(f"{function.__name__} is registered already")
        self.known[function.__name__] = function
        return function

    def run(self, steps: DataFrame) -> DataFrame:
        """node, result of steps (node, function, argument), batch by batch; an unknown name is an error."""
        known = dict(self.known)
        on_workers_path(steps.sparkSession)

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                if unknown := set(df["function"]) - known.keys():
                    raise ValueError(f"no function {sorted(map(str, unknown))}")
                parts = [pd.DataFrame({"node": part["node"], "result": known[name](part["argument"])}) for name, part in df.groupby("function")]
                yield pd.concat(parts) if parts else pd.DataFrame({"node": pd.Series([], dtype="int64"), "result": pd.Series([], dtype="object")})

        return steps.select("node", "function", "argument").mapInPandas(batches, "node long, result string")


def over_cases(steps: DataFrame, cases: DataFrame) -> DataFrame:
    """node, case, argument: a row per case of each script (node, script, template), where `{}` stands for the case; cases has
    script and case, and may be many."""
    return steps.join(cases, "script").select("node", "case", F.replace("template", F.lit("{}"), F.col("case")).alias("argument"))


class Kinds:
    """Kinds of nodes beside files, steps and trees, each with a frame of its own that hangs on the nodes."""

    def __init__(self) -> None:
        self.frames: dict[str, DataFrame] = {}

    def add(self, kind: str, frame: DataFrame, schema: str) -> None:
        if kind in ("root", "file", "step", "st") or kind in self.frames:
            raise ValueError(f"{kind} is taken")
        if frame.columns[:1] != ["node"] or StructType.fromDDL(schema).simpleString() != frame.schema.simpleString():
            raise ValueError(f"the frame of {kind} isn't ({schema}), its node first")
        self.frames[kind] = frame

    def violations(self, g: Frames) -> DataFrame:
        """kind, rule, i: rows that hang on no node of their kind, and such nodes without a row."""
        out = None
        for kind, frame in self.frames.items():
            n, f = g.node.filter(F.col("kind") == kind).select("i"), frame.select(F.col("node").alias("i"))
            one = f.join(n, "i", "left_anti").select(F.lit(kind).alias("kind"), F.lit("no node").alias("rule"), "i").unionByName(n.join(f, "i", "left_anti").select(F.lit(kind).alias("kind"), F.lit("no row").alias("rule"), "i"))
            out = one if out is None else out.unionByName(one)
        return out
