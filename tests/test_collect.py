"""Collecting filings through a client: the same filings as the join picks, each asked for once, errors, retries, caching."""

import datetime
import json
import os
from collections import Counter
from pathlib import Path

import pytest

from ledgerlark.operators import statements
from ledgerlark.ship import by_value
from ledgerlark.sources import collect as C

by_value(__name__)
DAY = datetime.date


def filings(spark):
    rows = [
        ("E1", 1, DAY(2023, 6, 20), True), ("E1", 2, DAY(2023, 8, 31), True), ("E1", 3, DAY(2023, 9, 1), True), ("E1", 4, DAY(2024, 6, 1), False), ("E1", 5, DAY(2024, 5, 31), True),
        ("E2", 6, DAY(2023, 10, 5), True), ("E2", 7, DAY(2023, 10, 5), True), ("E2", 8, DAY(2024, 1, 9), True), ("E3", 9, DAY(2023, 7, 1), False), ("E4", 10, DAY(2024, 12, 31), True),
    ]
    told = json.dumps({"accounting_standard": "IFRS", "income_statement": [{"科目": "売上高", "当期": 5, "前期": 4}], "balance_sheet": []}, ensure_ascii=False)
    return spark.createDataFrame([(*r, told) for r in rows], "company string, doc_id bigint, filing_date date, has_xbrl boolean, told string")


class Recorded(C.CatalogClient):
    """Notes every fetch as a file; fails as told."""

    def __init__(self, path, seen, down=(), shaky=False):
        super().__init__(path)
        self.seen, self.down, self.shaky, self.failed = seen, down, shaky, set()

    def search(self, company, first, last):
        if self.shaky and (company, first) not in self.failed:
            self.failed.add((company, first))
            raise OSError("try again")
        if ("search", company) in self.down and first.month == 6:
            raise OSError("no such window")
        return super().search(company, first, last)

    def fetch(self, filing):
        open(os.path.join(self.seen, f"{filing['doc_id']}-{os.urandom(4).hex()}"), "w").close()
        if filing["doc_id"] in self.down:
            raise RuntimeError("broken")
        return super().fetch(filing)


def fetched(seen) -> Counter:
    return Counter(int(p.name.split("-")[0]) for p in Path(seen).iterdir())


@pytest.fixture
def folders(spark, tmp_path):
    root, seen = str(tmp_path / "catalog"), str(tmp_path / "seen")
    C.write_catalog(filings(spark), root)
    os.mkdir(seen)
    return root, seen, str(tmp_path / "collected")


def companies(spark, *codes):
    return spark.createDataFrame([(c, f"Company {c}", "x") for c in codes], "edinet_code string, name string, extra string")


def found(spark, path):
    return {(r.company, r.year, int(r.doc_id)) for r in C.load_collected(spark, path)[1].collect()}


@pytest.mark.parametrize("wave", [1, 1000])
def test_as_the_join_picks_and_asked_once(spark, folders, wave):
    root, seen, path = folders
    own = companies(spark, "E1", "E2", "E3", "E4", "E5", None, "E1")
    wanted = own.where("edinet_code IS NOT NULL").selectExpr("edinet_code AS company", "explode(array('2023', '2024')) AS year")
    expected = {(r.company, r.year, r.doc_id) for r in statements.pick_filings(filings(spark), wanted).collect()}
    told = C.collect(own.where("edinet_code = 'E1'"), ["2023", "2024"], lambda: Recorded(root, seen), path, wave=wave)
    assert told == {"wanted": 1, "cached": 0, "collected": 1, "without": 0}
    told = C.collect(own, ["2023", "2024"], lambda: Recorded(root, seen), path, wave=wave, parallel=3)
    assert told == {"wanted": 5, "cached": 1, "collected": 2, "without": 2}
    assert found(spark, path) == expected == {("E1", "2023", 2), ("E1", "2024", 5), ("E2", "2023", 7), ("E4", "2024", 10)}
    assert fetched(seen) == Counter({2: 1, 5: 1, 7: 1, 10: 1})
    told = C.collect(own, ["2023", "2024"], lambda: Recorded(root, seen), path, wave=wave)
    assert told == {"wanted": 5, "cached": 3, "collected": 0, "without": 2} and fetched(seen).total() == 4


def test_what_is_stored(spark, folders):
    root, seen, path = folders
    C.collect(companies(spark, "E1"), ["2023", "2024"], lambda: Recorded(root, seen), path)
    own, filed, items = C.load_collected(spark, path)
    assert [(r.file_stem, r.edinet_code, r.name) for r in own.collect()] == [("E1", "E1", "Company E1")]
    assert {(r.year, r.accounting_standard) for r in filed.collect()} == {("2023", "IFRS"), ("2024", "IFRS")}
    assert {(r.year, r.statement, r.label, r.value, r.previous) for r in items.collect()} == {(y, "income_statement", "売上高", 5.0, 4.0) for y in ("2023", "2024")}
    value = json.loads(spark.read.parquet(path).first().value)
    assert value["company"]["extra"] == "x" and value["filings"]["2023"]["balance_sheet"] is None


def test_errors_cost_no_more_than_their_own(spark, folders):
    root, seen, path = folders
    # a search that fails goes on with the next window, a year that can't be fetched is left out and noted
    told = C.collect(companies(spark, "E1", "E2"), ["2023", "2024"], lambda: Recorded(root, seen, down=(5, ("search", "E2"))), path, tries=1)
    assert told["collected"] == 2 and found(spark, path) == {("E1", "2023", 2), ("E2", "2023", 7)}
    notes = {r.edinet_code: r.notes for r in spark.read.parquet(path).collect()}
    assert len(notes["E1"]) == 1 and "broken" in notes["E1"][0] and all("no such window" in n for n in notes["E2"])
    # a company without any filing is asked for again, one with a filing isn't
    told = C.collect(companies(spark, "E1", "E4"), ["2023"], lambda: Recorded(root, seen), path)
    assert told == {"wanted": 2, "cached": 1, "collected": 0, "without": 1}
    assert C.collect(companies(spark, "E4"), ["2024"], lambda: Recorded(root, seen), path)["collected"] == 1


def test_requests_are_tried_again(spark, folders):
    root, seen, path = folders
    assert C.collect(companies(spark, "E1"), ["2023"], lambda: Recorded(root, seen, shaky=True), path, tries=1)["collected"] == 0
    assert C.collect(companies(spark, "E1"), ["2023"], lambda: Recorded(root, seen, shaky=True), path, tries=2)["collected"] == 1


def test_windows_by_group_over_the_turn_of_the_year(spark, folders):
    root, seen, path = folders
    windows = spark.createDataFrame([("late", 0, 12, 1, 1, 31), ("", 0, 2, 30, 6, 30), ("", 1, 6, 1, 8, 31)], "group string, window int, from_month int, from_day int, to_month int, to_day int")
    own = spark.createDataFrame([("E2", "late"), ("E1", None), ("E4", "none")], "edinet_code string, group string")
    C.collect(own, ["2023"], lambda: Recorded(root, seen), path, windows=windows)
    assert found(spark, path) == {("E2", "2023", 8), ("E1", "2023", 2)}


def test_nothing_to_ask(spark, folders):
    root, seen, path = folders
    assert C.collect(companies(spark), ["2023"], lambda: Recorded(root, seen), path) == {"wanted": 0, "cached": 0, "collected": 0, "without": 0}
    assert [t.count() for t in C.load_collected(spark, path)] == [0, 0, 0]


def test_a_bucket_is_read_once_for_all_its_companies(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    root, path = str(tmp_path / "catalog"), str(tmp_path / "collected")
    C.write_catalog(filings(spark), root, 2)
    reads, read = [], pq.read_table
    monkeypatch.setattr(pq, "read_table", lambda *a, **k: reads.append(a) or read(*a, **k))
    client = C.CatalogClient(root, 2)
    codes = [r.company for r in filings(spark).select("company", C.catalog_bucket("company", 2).alias("b")).distinct().orderBy("b", "company").collect()]
    got = {d["doc_id"] for c in codes for _ in range(2) for d in client.search(c, DAY(2023, 1, 1), DAY(2024, 12, 31))}
    assert got == set(range(1, 11)) and len(reads) <= 2
    told = C.collect(companies(spark, *codes, "E5"), ["2023", "2024"], lambda: C.CatalogClient(root, 2), path, wave=1, parallel=2, near=C.catalog_bucket("edinet_code", 2))
    assert told == {"wanted": 5, "cached": 0, "collected": 3, "without": 2} and found(spark, path) == {("E1", "2023", 2), ("E1", "2024", 5), ("E2", "2023", 7), ("E4", "2024", 10)}
