"""From raw sales to the enriched sales table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuary.operators import contracts
from valuary.operators.clean import clean_sales, to_canonical
from valuary.operators.features import engineer_features
from valuary.operators.identity import add_property_id, resale_history
from valuary.operators.impute import impute_missing_values
from valuary.operators.journal import RunJournal
from valuary.operators.tiers import assign_price_tiers, assign_proxy_tiers, assign_segments
from valuary.schemas import SALES_SCHEMA
from valuary.session import stage_table
from valuary.sources.sinks import load_run, read_runs, write_sales

# Columns a cleaned feed must have.
CLEAN_REQUIRED = (
    "sale_date",
    "sale_price",
    "bbl",
    "latitude",
    "longitude",
    "borough",
    "block",
    "lot",
    "building_class_category",
)


@dataclass(frozen=True)
class EtlResult:
    sales: DataFrame
    stages: DataFrame


class EtlError(contracts.ContractError):
    """A broken contract, with what the run had done so far: the stages written and the violations found."""

    def __init__(self, message: str, stages: DataFrame, violations: DataFrame):
        super().__init__(message)
        self.stages, self.violations = stages, violations


def enrich(cleaned: DataFrame, min_segment_rows: int = 800, cell_size: float = 0.01, as_of_year: int = 2025) -> DataFrame:
    """Identity, duplicate removal, history, segments, tiers, imputation, features and tier proxy of clean sales.

    The history and the features are written out once: every later step reads them again, each only a few columns.
    """
    df = stage_table(assign_segments(resale_history(add_property_id(cleaned))), "history")
    df = impute_missing_values(assign_price_tiers(df))
    df = stage_table(engineer_features(df, cell_size, as_of_year), "features")
    return assign_proxy_tiers(df, min_segment_rows=min_segment_rows)


def run_etl(
    raw: DataFrame,
    as_of: date,
    output: str | None = None,
    replace: bool = False,
    mapping: dict | None = None,
    max_freshness_days: int = 730,
    min_segment_rows: int = 800,
    run_id: str | None = None,
    report: str | None = None,
) -> EtlResult:
    """Full pass over a raw feed (with `row_order`) under its data contracts; writes the table when `output` is given.

    `mapping` selects the canonical profile. With a `run_id` the load can be repeated: it replaces the rows of that
    run and no others (`sinks.load_run`; `sinks.read_runs` reads such a table). A broken contract raises `EtlError`
    before the table is written; the error carries the stages and violations, and `report` names a folder to which
    they are written in every case.
    """
    journal = RunJournal(raw.sparkSession)
    status = "failed"
    try:
        result = _run(journal, raw, as_of, output, replace, mapping, max_freshness_days, min_segment_rows, run_id)
        status = "succeeded"
        return result
    except contracts.ContractError as broken:
        raise EtlError(str(broken), journal.stage_table(), journal.violation_table()) from broken
    finally:
        if report:
            journal.save(report, status)


def _run(
    journal: RunJournal,
    raw: DataFrame,
    as_of: date,
    output: str | None,
    replace: bool,
    mapping: dict | None,
    max_freshness_days: int,
    min_segment_rows: int,
    run_id: str | None,
) -> EtlResult:
    if mapping is not None:
        raw = journal.write("canonicalized", to_canonical(journal.observe("extract_raw", raw), mapping))
        journal.check(raw, contracts.canonical_violations(raw))
        cleaned = journal.write("cleaned", clean_sales(raw))
    else:
        cleaned = journal.write("cleaned", clean_sales(journal.observe("extract_raw", raw)))
    journal.check(cleaned, contracts.sales_violations(cleaned, as_of, CLEAN_REQUIRED, max_days=max_freshness_days))
    sales = journal.write("feature_engineered", enrich(cleaned, min_segment_rows, as_of_year=as_of.year))
    limits = contracts.FINAL_NULL_LIMITS
    journal.check(sales, contracts.sales_violations(sales, as_of, null_limits=limits, max_days=max_freshness_days))
    if output is None:
        journal.note_table("load_skipped", sales)
    elif run_id is None:
        write_sales(sales, output, replace)
        journal.note_table("loaded", sales.sparkSession.read.schema(SALES_SCHEMA).parquet(output))
    else:
        load_run(sales, output, run_id)
        journal.note_table("loaded", read_runs(sales.sparkSession, output).where(F.col("run_id") == run_id))
    return EtlResult(sales, journal.stage_table())
