import datetime

from tabloom.streaming.refresh import refresh, stale_cells, workbook_stream
from tests import workbooks


def test_changed_workbooks_are_read_again(spark, tmp_path):
    src, out, cp = (tmp_path / x for x in ("src", "out", "cp"))
    src.mkdir()
    workbooks.blocks(str(src / "a.xlsx"))
    (src / "bad.xlsx").write_bytes(b"no archive")
    refresh(workbook_stream(spark, str(src)), str(out), str(cp)).awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.where("formula IS NOT NULL").count() == 20
    assert got.where("sheet = 'E_CORRUPT'").count() == 1
    workbooks.model(str(src / "b.xlsx"))
    refresh(workbook_stream(spark, str(src)), str(out), str(cp)).awaitTermination()
    got = spark.read.parquet(str(out))
    assert got.select("workbook").distinct().count() == 3
    assert got.where("sheet = 'Calc'").count() == 24


def test_late_and_repeated_edits(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, 5, t), (1, 5, t + datetime.timedelta(minutes=1)), (1, 6, t)]
    spark.createDataFrame(rows, "sheet_id int, n int, at timestamp").write.parquet(str(tmp_path / "edits"))
    edits = spark.readStream.schema("sheet_id int, n int, at timestamp").parquet(str(tmp_path / "edits"))
    deps = spark.createDataFrame([(1, 5, 2, 7), (1, 5, 2, 8)], "sheet_id int, n int, stale_sheet_id int, stale_n int")
    q = stale_cells(edits, deps).writeStream.format("memory").queryName("stale").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r[0], r[1]) for r in spark.table("stale").collect()) == [(2, 7), (2, 8)]
