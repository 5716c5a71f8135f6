"""Journal of a run: what each stage wrote, and which contracts it broke, kept also when the run stops.

A stage's rows, properties and latest sale date are observed while the stage is written: they come with the write
itself, without a scan or count of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from valuary.operators.contracts import VIOLATION_SCHEMA, ContractError
from valuary.session import stage_table

STAGE_SCHEMA = "position int, stage string, rows bigint, unique_properties bigint, latest_sale_date date"


def stage_metrics(df: DataFrame) -> list[Column]:
    """Rows, distinct properties and latest sale date as aggregates that can be observed.

    Observed aggregates can't be distinct ones; a table with a history has one first sale a property, which counts
    the same. Null where the table has no such column.
    """
    latest = F.max("sale_date").try_cast("date") if "sale_date" in df.columns else F.max(F.lit(None).cast("date"))
    known = {"sale_sequence", "property_id"} <= set(df.columns)
    ids = F.count_if((F.col("sale_sequence") == 1) & F.col("property_id").isNotNull()) if known else F.max(F.lit(None).cast("long"))
    return [F.count(F.lit(1)).alias("rows"), ids.alias("unique_properties"), latest.alias("latest_sale_date")]


@dataclass
class RunJournal:
    """Stages in the order in which they were written, and the broken contracts of the run."""

    spark: SparkSession
    stages: list[tuple[int, str, int, int | None, date | None]] = field(default_factory=list)
    violations: list[tuple[str, str, int]] = field(default_factory=list)
    pending: list[tuple[str, Observation]] = field(default_factory=list)

    def observe(self, name: str, df: DataFrame) -> DataFrame:
        """The frame, its metrics noted when the next `write` that it is part of ends.

        The frame should reach that write without a shuffle: a task of the writing stage counts once however often
        it is retried, one of an earlier stage may run again when an executor is lost.
        """
        watch = Observation(f"{name}-{len(self.stages)}-{len(self.pending)}")
        self.pending.append((name, watch))
        return df.observe(watch, *stage_metrics(df))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Stage the frame as a table and note it; what was observed on the way is noted before it."""
        staged = stage_table(self.observe(name, df), name)
        for stage, watch in self.pending:
            self._note(stage, watch.get)
        self.pending = []
        return staged

    def note_table(self, name: str, stored: DataFrame) -> None:
        """Note a table as it stands in a sink: its metrics are read from it, properties counted one by one."""
        rows, _, latest = stage_metrics(stored)
        ids = F.count_distinct("property_id") if "property_id" in stored.columns else F.lit(None).cast("long")
        self._note(name, stored.agg(rows, ids.alias("unique_properties"), latest).first().asDict())

    def check(self, df: DataFrame, violations: DataFrame) -> None:
        """Keep the violations found in a stage and raise if there are any."""
        found = [(v["check"], v["message"], v["failed_rows"]) for v in violations.collect()]
        self.violations += found
        if found:
            lines = [f"- [{c}] {m} (failed_rows={n})" for c, m, n in found]
            raise ContractError("\n".join(["contract broken:", *lines]))

    def stage_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.stages, STAGE_SCHEMA)

    def violation_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.violations, VIOLATION_SCHEMA)

    def save(self, path: str, status: str) -> None:
        """Write the report (stages, violations and one row of status) as JSON lines under `path`."""
        self.stage_table().coalesce(1).write.mode("overwrite").json(f"{path}/stages")
        self.violation_table().coalesce(1).write.mode("overwrite").json(f"{path}/violations")
        ended = datetime.now(timezone.utc).isoformat()
        state = self.spark.createDataFrame([(status, len(self.violations), ended)], "status string, violations int, ended_at string")
        state.coalesce(1).write.mode("overwrite").json(f"{path}/run")

    def _note(self, name: str, metrics: dict) -> None:
        values = (metrics["rows"], metrics["unique_properties"], metrics["latest_sale_date"])
        self.stages.append((len(self.stages), name, *values))
