"""Builds of steps with gates that can be stopped and go on.

A step's result is a table named by what it is made of: its name, its revision and the keys of its inputs, which for
given tables are digests of their contents. The table is written aside, held against its gates, and only then gets its
name, so a table that has its name is finished; a build that is run again reads it and makes what is missing. When an
input changes, so do the keys of all that follows from it, and of nothing else.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from psephos.constraints import Constraint, check
from psephos.sources import commits
from psephos.sources.publish import content_version

MADE, REUSED = "made", "reused"


@dataclass(frozen=True)
class Step:
    """make(*needs) gives the rows, or the rows and constraints that they rest on. gates(rows, *needs) are looked at on what was
    written. revision is to be raised when what make does changes."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame | tuple[DataFrame, Sequence[Constraint]]]
    gates: Callable[..., Sequence[Constraint]] = lambda rows, *needs: ()
    revision: int = 1


@dataclass
class Build:
    """Tables under root. receipts has (step, key, rows or None if reused, what was done) in the order of the steps."""

    spark: SparkSession
    root: str
    inputs: dict[str, DataFrame]
    keys: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    receipts: list[tuple[str, str, int | None, str]] = field(default_factory=list)

    def _key(self, name: str) -> str:
        """Of an input: its columns and contents, whatever their order and partitions."""
        if name not in self.keys:
            df = self.inputs[name]
            said = ";".join(f"{c} {kind}" for c, kind in df.dtypes)
            self.keys[name] = f"{said}:{content_version(df, df.columns).head()['version']}"
        return self.keys[name]

    def run(self, steps: Sequence[Step]) -> dict[str, DataFrame]:
        """Tables by step, in the order given; a step may need inputs and steps before it. An error stops the build, and what is
        finished by then stays."""
        for step in steps:
            if step.name in self.inputs or step.name in self.tables:
                raise ValueError(f"two things are named {step.name!r}")
            self._step(step)
        return self.tables

    def _step(self, step: Step) -> None:
        unknown = [n for n in step.needs if n not in self.tables and n not in self.inputs]
        if unknown:
            raise ValueError(f"step {step.name!r} needs {unknown}, which no input or step before it gives")
        said = "\x1e".join([step.name, str(step.revision), *[self._key(n) for n in step.needs]])
        key = hashlib.sha256(said.encode()).hexdigest()
        table, rows = f"{self.root}/{step.name}-{key[:32]}", None
        done = REUSED if commits.complete(self.spark, table) else MADE
        if done == MADE:
            rows = self._made(step, table)
        self.keys[step.name] = key
        self.tables[step.name] = self.spark.read.parquet(table)
        self.receipts.append((step.name, key, rows, done))

    def _made(self, step: Step, table: str) -> int:
        needs = [self.tables[n] if n in self.tables else self.inputs[n] for n in step.needs]
        found = step.make(*needs)
        df, rests_on = found if isinstance(found, tuple) else (found, ())
        staged, told = f"{self.root}/_staged-{uuid.uuid4().hex}", Observation()
        try:
            df.observe(told, F.count(F.lit(1)).alias("rows")).write.parquet(staged)
            written = self.spark.read.schema(df.schema).parquet(staged)
            check(*rests_on, *step.gates(written, *needs))
            # Another build may have made the same table meanwhile; that one is as good.
            commits.moved_once(self.spark, staged, table)
        finally:
            commits.remove(self.spark, staged)
        return told.get["rows"]
