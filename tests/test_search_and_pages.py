import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from folioquarry.functions.columns import contains  # noqa: E402
from folioquarry.operators.paging import PageIndex, page, page_meta  # noqa: E402
from folioquarry.operators.search import gram_search, grams_of, write_grams  # noqa: E402
from folioquarry.sources import runs  # noqa: E402
from folioquarry.sources.catalog_csv import plan_import, read_files, read_rows, run_import  # noqa: E402


def test_grams_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: rng.choice([None, "", "ab", "".join(rng.choice("abcÉé %_") for _ in range(rng.randrange(14)))])
    rows = [(k if k else None, text(), text()) for k in range(400)] + [(1000, "The Long Title abcabc", None), (1001, "xabc", "abcy"), (1002, "abc", "bcd")]
    df = spark.createDataFrame(rows, "id long, title string, isbn string").withColumn("key", F.lit(1))
    write_grams(df, "id", ["title", "isbn"], str(tmp_path / "grams"))
    for q in (" ABC ", "long title", "a%c", "ab_c", "%", "ab", "bcé", "cab%bca", None, "zzz", "a\\\\%bc"):
        test = contains(q, "title", "isbn")
        want = sorted(r.id for r in (df if test is None else df.where(test)).where("id IS NOT NULL").collect())
        got = gram_search(df.where("id IS NOT NULL"), "id", ["title", "isbn"], q, str(tmp_path / "grams"))
        assert sorted(r.id for r in got.collect()) == want, q
    assert grams_of(" AbcD%xy_zab") == ["abc", "bcd", "zab"] and grams_of("a%b") == []
    plan = gram_search(df, "id", ["title", "isbn"], "abc", str(tmp_path / "grams"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_pages_of_an_index(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else k % 13, f"t{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, rank long, title string").repartition(5)
    order = [F.desc_nulls_last("rank"), F.col("id")]
    index = PageIndex.build(df, order, str(tmp_path / "index"), ranges=16)
    again = PageIndex(spark, str(tmp_path / "index"), order)
    for number, size in ((0, 20), (3, 100), (9, 100), (10, 100), (49, 20), (None, None), (333, 3), (-1, 500)):
        want = [tuple(r) for r in page(df, order, number, size).collect()]
        assert [tuple(r) for r in index.page(number, size).collect()] == want and [tuple(r) for r in again.page(number, size).collect()] == want
        assert index.meta(number or 0, size or 20).first() == page_meta(df, number or 0, size or 20).first()
    deep = index.page(40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "range" in deep and len({r for r, _ in index.sizes}) > 8
    assert PageIndex.build(df.limit(0), order, str(tmp_path / "empty")).page(0, 20).count() == 0


HEAD = "title,isbn,authors,category,barcode\n"


def tables(spark):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    return frame([("old-1",)], "barcode string"), frame([(7, "62", True), (9, "79", False)], "id long, isbn string, deleted boolean"), frame([(3, "Ben")], "id long, name string"), frame([(1, "maps")], "id long, name string")


def test_many_files_are_read_side_by_side(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    put("a.csv", "Title, ISBN ,authors,CATEGORY,barcode,language\n\"A, \"\"x\"\"\n2\",1,Ann|Ben,k,A1,fr\n\nB,2,Ann,,A2\n")
    put("b.csv", "﻿" + HEAD + "C,3,Cy, ,B1\nD,1,Cy,k,a1\n")
    for k in range(20):
        put(f"more-{k}.csv", HEAD + "".join(f"T{k},{100 + k},Ann,k,M-{k}-{j}\n" for j in range(5)))
    for name, text in (("bad-columns.csv", "title,isbn\nx,y\n"), ("bad-empty.csv", ""), ("bad-large.csv", HEAD + "x" * 3000), ("bad-rows.csv", HEAD + "A,1,a,k,b\n" * 9), ("bad-quote.csv", HEAD + '"A,1'), ("bad-bytes.csv", HEAD.encode() + b"\xff,1,a,k,b\n")):
        put(name, text)
    rows, refused = read_files(spark, str(tmp_path), most_rows=8, most_bytes=2000)
    assert sorted(Path(r.file).name for r in refused.collect()) == ["bad-bytes.csv", "bad-columns.csv", "bad-large.csv", "bad-quote.csv", "bad-rows.csv"]
    first = {(Path(r.file).name, r.row_number): r for r in rows.collect()}
    assert first["a.csv", 2].title == 'A, "x"\n2' and first["a.csv", 2].language == "fr" and first["a.csv", 3].category is None and ("a.csv", 4) not in first and len(first) == 104
    for name in ("a.csv", "b.csv"):
        own = sorted(map(tuple, rows.where(F.col("file").endswith(f"/{name}")).drop("file").select(sorted(rows.columns[1:])).collect()), key=str)
        assert own == sorted(map(tuple, read_rows(spark, str(tmp_path / name)).select(sorted(rows.columns[1:])).collect()), key=str)
    plan = plan_import(rows, *tables(spark))
    assert plan.summary.first().asDict() == {"total": 104, "success": 102, "failed": 2, "created_books": 22, "created_copies": 102}
    assert sorted((Path(r.file).name, r.row_number) for r in plan.errors.collect()) == [("a.csv", 2), ("b.csv", 3)]  # a barcode in two files
    assert sorted(r.id for r in plan.books.collect()) == list(range(10, 32)) and sorted(r.name for r in plan.authors.collect()) == ["Ann", "Cy"]


def test_life_cycle_of_an_import(spark, tmp_path):
    path, log = tmp_path / "a.csv", str(tmp_path / "log")
    path.write_text(HEAD + "A,1,Ann,k,A1\n")
    run_import(spark, str(path), log, "import", str(tmp_path / "copies"), *tables(spark), remove=True)
    assert not path.exists() and [r.status for r in spark.read.parquet(log).orderBy("at").collect()] == ["PENDING", "PROCESSING", "COMPLETED"]
    path.write_text("x\n")
    with pytest.raises(ValueError):
        run_import(spark, str(path), log, "import", str(tmp_path / "copies"), *tables(spark), remove=True)
    done = {r.status: r for r in runs.runs(spark.read.parquet(log)).collect()}
    assert not path.exists() and set(done) == {"COMPLETED", "FAILED"} and done["FAILED"].message and done["COMPLETED"].finished_at
    waiting = runs.runs(spark.read.parquet(log).where("status = 'PENDING'")).collect()
    assert {r.status for r in waiting} == {"PENDING"} and {r.finished_at for r in waiting} == {None}


def test_grams_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ab")], "id long, title string")
    write_grams(df, "id", ["title"], str(tmp_path / "grams"))
    assert gram_search(df, "id", ["title"], "abc", str(tmp_path / "grams")).count() == 0 and gram_search(df, "id", ["title"], "ab", str(tmp_path / "grams")).count() == 1
