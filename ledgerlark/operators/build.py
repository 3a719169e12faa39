"""The whole construction: raw filings to contexts, contexts to questions, questions to a validated, deduped, sampled set.

Every stage reads what the one before stored below the data folder, so that each can be run alone and a lost run goes on
from the last stage that ended: ``raw/`` (one file a company) or else ``collected/`` (what
``sources.collect`` stored), ``contexts/``, ``generated/``, ``final/questions/``, ``final/rejected/`` and ``final/stats.json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.operators import statements as S
from ledgerlark.operators import templates as G
from ledgerlark.operators import validate as V
from ledgerlark.scratch import discard, store
from ledgerlark.sources import io
from ledgerlark.sources.collect import load_collected

STAGES = ("2", "3", "4")
ORDER = ("edinet_code", "pos", "template_no")


def numbered(rows: DataFrame, order: tuple[str, ...], name: str, ranges: int | None = None) -> DataFrame:
    """Rows with their place (from 0, without gaps) in an order: ranges are sorted in parallel and counted, one row a range; so many
    ``ranges`` where that is given (``scratch.parts``), else the session's number."""
    own = (rows.repartitionByRange(*order) if ranges is None else rows.repartitionByRange(ranges, *order)).sortWithinPartitions(*order)
    own = store(own.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_own")))
    sizes = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def transform(spark: SparkSession, data: str) -> DataFrame:
    """Contexts of all filings below a data folder: of its raw files, or of what was collected where it has none."""
    raw = io.has_files(spark, f"{data}/raw")
    companies, filings, items = io.load_filings(spark, f"{data}/raw") if raw else load_collected(spark, f"{data}/collected")
    return S.contexts(S.labelled_items(items), companies.select("edinet_code", "name", "gaap"), filings.select("company", "year", "doc_id"))


def final_set(generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sampled questions with their ids, and ``id``-less rejected candidates with the ``reason``, from generated questions."""
    flat = generated.select("*", "qa.question", "qa.answer", "qa.program", "qa.gold_evidence").withColumnRenamed("pos", "context_pos")
    placed = numbered(flat, ("edinet_code", "context_pos", "template_no"), "pos")
    checked = store(V.validate(placed))
    rejected = checked.where("reason <> ''")
    kept = V.diverse(V.dedupe(checked.where("reason = ''")))
    names = ("id", "subtask", "company_name", "edinet_code", "source_doc_id", "filing_year", "accounting_standard", "scale", "pre_text", "post_text", "table", "qa")
    return V.with_ids(kept).select(*names), rejected.select("reason", *names[1:])


def stats(final: DataFrame, rejected: DataFrame) -> dict:
    """Statistics of the final set as JSON would hold them."""
    rows = V.final_stats(final.select("*", "qa.program"), rejected).orderBy("measure", "key").collect()  # a few rows
    out: dict = {}
    for r in rows:
        whole = int(r["value"]) if r["value"] == int(r["value"]) and r["measure"] != "avg_program_steps" else round(r["value"], 2)
        if r["key"] or r["measure"].startswith("by_"):
            out.setdefault(r["measure"], {})[r["key"]] = whole
        else:
            out[r["measure"]] = whole
    return out


def build(spark: SparkSession, data: str, stages: tuple[str, ...] = STAGES) -> None:
    """Run stages over the folder ``data``. Collecting (stage 1) needs the regulator's client: see ``statements.pick_filings``."""
    if unknown := [s for s in stages if s not in STAGES]:
        raise ValueError(f"unknown stage: {', '.join(unknown)}")
    if "2" in stages:
        io.write_rows(transform(spark, data), f"{data}/contexts")
    if "3" in stages:
        io.write_rows(G.questions(io.load_contexts(spark, f"{data}/contexts")), f"{data}/generated")
    if "4" in stages:
        final, rejected = final_set(io.load_generated(spark, f"{data}/generated"))
        final, rejected = store(final), store(rejected)
        io.write_rows(final, f"{data}/final/questions")
        io.write_rows(rejected, f"{data}/final/rejected")
        io.write_json(spark, f"{data}/final/stats.json", stats(final, rejected))
        discard(final, rejected)
