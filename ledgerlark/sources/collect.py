"""Collecting annual filings through a client: a row a company, kept once it has data and never asked for again.

A client is any object with

* ``search(company, first_day, last_day)``: the filings of a company filed on these days, as dicts with ``doc_id``,
  ``filing_date``, ``has_xbrl`` and whatever else is to be kept;
* ``fetch(filing)``: a dict with ``accounting_standard`` and the statements ``balance_sheet``, ``income_statement``,
  ``cash_flow_statement`` and ``summary``, each a list of line items.

What travels to the executors is a function that makes one, called once a task, so that connections never travel.
"""

from __future__ import annotations

import datetime
import json
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.statements import search_windows
from ledgerlark.scratch import discard, store
from ledgerlark.ship import by_value
from ledgerlark.sources import io

by_value(__name__)

STATEMENTS = ("balance_sheet", "income_statement", "cash_flow_statement", "summary")
#: A row a company and asking: ``value`` is its file as JSON, null where nothing was found; ``notes`` what went wrong.
STORED = "edinet_code string, value string, years int, notes array<string>"
#: Companies whose files a task hands over together, and filings of a catalog's bucket, about.
TOGETHER, BUCKET = 256, 50_000


def _day(year: int, month: int, day: int) -> datetime.date | None:
    try:
        return datetime.date(year, month, day)
    except ValueError:  # no such day in that year
        return None


def _asked(call: Callable, tries: int, pause: float, *arguments):
    """The answer to a request, tried several times; the last error is raised. Every request is followed by a pause."""
    for left in range(tries - 1, -1, -1):
        try:
            return call(*arguments)
        except Exception:
            if not left:
                raise
        finally:
            time.sleep(pause)


def annual_filing(client, company: str, year: int, windows: list[dict], tries: int, pause: float, notes: list[str]) -> dict | None:
    """From the first window that has a filing with data, the newest (ties: largest id). A search that fails counts as one without filings."""
    for w in windows:
        first, last = _day(year, w["from_month"], w["from_day"]), _day(year, w["to_month"], w["to_day"])
        if first is not None and last is not None and last < first:
            last = _day(year + 1, w["to_month"], w["to_day"])
        if first is None or last is None:
            continue
        try:
            found = [f for f in _asked(client.search, tries, pause, company, first, last) or () if f["has_xbrl"]]
        except Exception as e:
            notes.append(f"{year}, {first} to {last}: {type(e).__name__}: {e}")
            continue
        if found:
            return max(found, key=lambda f: (f["filing_date"], f["doc_id"]))
    return None


def company_file(client, company: dict, years: Sequence[str], windows: list[dict], tries: int, pause: float) -> dict:
    """A row of ``STORED``. A year whose filing can't be fetched is left out and noted."""
    code, filings, notes = company["edinet_code"], {}, []
    for year in years:
        filing = annual_filing(client, code, int(year), windows, tries, pause, notes)
        if filing is None:
            continue
        try:
            told = _asked(client.fetch, tries, pause, filing)
            filings[year] = {"filing": filing, "accounting_standard": told.get("accounting_standard"), **{s: told.get(s) or None for s in STATEMENTS}}
        except Exception as e:
            notes.append(f"{year}, {filing['doc_id']}: {type(e).__name__}: {e}")
    value = json.dumps({"company": company, "filings": filings}, ensure_ascii=False, default=str) if filings else None
    return {"edinet_code": code, "value": value, "years": len(filings), "notes": notes}


def collect(companies: DataFrame, years: Sequence[str], client: Callable[[], object], path: str, windows: DataFrame | None = None, wave: int = 1000, parallel: int = 1, tries: int = 3, pause: float = 0.0, near: Column | None = None) -> dict[str, int]:
    """Ask for the filings of all companies that have none stored at ``path``, and append what is found; counts of ``wanted``,
    ``cached``, ``collected`` and ``without`` companies.

    ``companies``: edinet_code, other columns are kept in the file; a null code is left out, of rows of one code the least
    stays. ``windows`` as ``search_windows``, by the companies' ``group`` if they have one. ``parallel`` tasks ask at a time, each in
    sequence, ``pause`` seconds apart. About ``wave`` companies are committed together: a run that dies loses the wave it was in,
    and a task that is run again asks again for its own companies of that wave. Companies without any filing are asked
    again by the next run. Companies of one value of ``near`` are in one wave and asked one after another by one task, for clients that
    hold some neighbours at a time.
    """
    spark = companies.sparkSession
    windows = search_windows(spark) if windows is None else windows
    group = F.coalesce("group", F.lit("")) if "group" in companies.columns else F.lit("")
    of_group = windows.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("window", "from_month", "from_day", "to_month", "to_day"))).alias("windows"))
    rows = companies.where("edinet_code IS NOT NULL").select(F.col("edinet_code").cast("string").alias("edinet_code"), F.struct(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("company"), group.alias("group")).alias("r"))
    rows = rows.groupBy("edinet_code").agg(F.min("r").alias("r")).select("edinet_code", "r.company", "r.group")
    wanted = store(rows)
    before = io.load_attempts(spark, path)
    left = wanted if before is None else wanted.join(before.where("value IS NOT NULL").select("edinet_code").distinct(), "edinet_code", "left_anti")
    todo = store(left.join(of_group, "group", "left"))  # now, as the waves below add to what is stored
    n_wanted, n_todo = wanted.count(), todo.count()
    asked_years = tuple(map(str, years))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = client()
        schema = pa.schema([("edinet_code", pa.string()), ("value", pa.string()), ("years", pa.int32()), ("notes", pa.list_(pa.string()))])
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                files = []
                for r in batch.slice(at, TOGETHER).to_pylist():
                    company = {**json.loads(r["company"]), "edinet_code": r["edinet_code"]}
                    files.append(company_file(own, company, asked_years, r["windows"] or [], tries, pause))
                yield pa.RecordBatch.from_pylist(files, schema)

    waves, collected = max(1, -(-n_todo // wave)), 0
    for k in range(waves if n_todo else 0):
        part = todo.withColumn("_near", F.col("edinet_code") if near is None else near).where(F.pmod(F.xxhash64("_near"), F.lit(waves)) == k)
        part = part.repartition(parallel, "_near").sortWithinPartitions("_near", "edinet_code")
        part.select("edinet_code", "company", "windows").mapInArrow(ask, STORED).write.mode("append").parquet(path)
    if n_todo:
        collected = io.load_attempts(spark, path).where("value IS NOT NULL").join(todo.select("edinet_code"), "edinet_code", "left_semi").count()
    discard(wanted, todo)
    return {"wanted": n_wanted, "cached": n_wanted - n_todo, "collected": collected, "without": n_todo - collected}


def load_collected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies, filings and line items of what ``collect`` stored, as ``io.load_filings`` has them. Nothing stored: no rows."""
    rows = io.load_attempts(spark, path)
    rows = spark.createDataFrame([], STORED) if rows is None else rows
    return io.filing_tables(rows.where("value IS NOT NULL").select(F.col("edinet_code").alias("file_stem"), "value"))


def catalog_buckets(n: int) -> int:
    """Buckets of a catalog of so many filings: a client holds one at a time."""
    return max(64, -(-n // BUCKET))


def catalog_bucket(company: str | Column, buckets: int = 64) -> Column:
    """A company's bucket: what ``collect`` takes as ``near`` for a ``CatalogClient``."""
    return F.crc32((F.col(company) if isinstance(company, str) else company).cast("binary")) % buckets


def write_catalog(filings: DataFrame, path: str, buckets: int = 64) -> None:
    """Filings as ``CatalogClient`` reads them: company, doc_id, filing_date, has_xbrl, ``told`` (JSON that ``fetch`` is to return), in folders by a hash of the company, sorted by it."""
    rows = filings.withColumn("bucket", catalog_bucket("company", buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "company").write.partitionBy("bucket").parquet(path)


class CatalogClient:
    """A client of filings in a folder that all executors reach. A bucket is read when one of its companies is first asked for; one is held at a time, so companies are best asked bucket by bucket."""

    def __init__(self, path: str, buckets: int = 64):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(path)
        self.buckets, self.bucket, self.company, self.rows = buckets, None, None, []
        self.table, self.places = None, {}

    def hold(self, bucket: int) -> None:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileType

        folder = f"{self.root.rstrip('/')}/bucket={bucket}"
        there = self.fs.get_file_info(folder).type == FileType.Directory
        self.table, self.places = pq.read_table(folder, filesystem=self.fs, partitioning=None) if there else None, {}
        for k, company in enumerate(self.table.column("company").to_pylist() if there else ()):
            self.places.setdefault(company, []).append(k)
        self.bucket = bucket

    def search(self, company: str, first: datetime.date, last: datetime.date) -> list[dict]:
        if company != self.company:
            if (bucket := zlib.crc32(company.encode()) % self.buckets) != self.bucket:
                self.hold(bucket)
            own = self.places.get(company)
            self.rows = self.table.take(own).to_pylist() if own else []
            self.company = company
        return [{k: v for k, v in r.items() if k != "told"} for r in self.rows if first <= r["filing_date"] <= last]

    def fetch(self, filing: dict) -> dict:
        return json.loads(next(r["told"] for r in self.rows if r["doc_id"] == filing["doc_id"]))
