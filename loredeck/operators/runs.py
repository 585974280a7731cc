"""A run of stages that depend on one another, with a ledger: one that fails leaves the others' results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.sources.shared import exists

LEDGER = "attempt int, place int, stage string, status string, rows long, mark string, error string"


@dataclass(frozen=True)
class Stage:
    """What a stage does from a watermark on: rows done and the new watermark; and the stages it needs."""

    name: str
    action: Callable[[str | None], tuple[int, str | None]]
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ledger:
    """STM-05, REM-13: one row for each stage of each attempt, appended as soon as the stage is over."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], LEDGER)

    def append(self, *row) -> None:
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(self.path)

    def last(self) -> tuple[int, set[str], dict[str, str]]:
        """Number of the last attempt, the stages done if it has to be gone on with, and each stage's watermark."""
        rows = self.rows()
        newest = rows.agg(F.max("attempt").alias("n")).first().n or 0
        statuses = {r.stage: r.status for r in rows.filter(F.col("attempt") == newest).collect()}  # a row a stage
        broken = any(s in ("failed", "skipped") for s in statuses.values())
        marks = rows.filter("status = 'done'").groupBy("stage").agg(F.max_by("mark", "attempt").alias("mark")).collect()
        return newest, {s for s, x in statuses.items() if broken and x in ("done", "kept")}, {r.stage: r.mark for r in marks}


def run(stages: list[Stage], ledger: Ledger) -> bool:
    """One attempt at all stages, in order; whether none failed.

    A stage whose needs failed is skipped, one that fails is written down with its error, and the others go on. An
    attempt after a broken one goes on with it: what was done is kept. Each stage starts from its last watermark.
    """
    newest, done, marks = ledger.last()
    attempt, good = newest + 1, set()
    for place, stage in enumerate(stages):
        if stage.name in done:
            good.add(stage.name)
            ledger.append(attempt, place, stage.name, "kept", None, marks.get(stage.name), None)
        elif not set(stage.after) <= good:
            ledger.append(attempt, place, stage.name, "skipped", None, marks.get(stage.name), None)
        else:
            try:
                rows, mark = stage.action(marks.get(stage.name))
            except Exception as e:  # noqa: BLE001 - whatever it is, the other stages go on
                ledger.append(attempt, place, stage.name, "failed", None, marks.get(stage.name), str(e).splitlines()[0][:200] if str(e) else type(e).__name__)
            else:
                good.add(stage.name)
                ledger.append(attempt, place, stage.name, "done", rows, mark, None)
    return len(good) == len(stages)
