"""The `items` source: arrival order, admission, filters while reading."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from postlens.sources import items_source
from postlens.streaming import streams


def _page_file(spark, folder, name, ids, old=False):
    """One Parquet file of pages; with ``old`` its time lies before all others."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(folder, exist_ok=True)
    table = pa.table({"page_id": pa.array(ids, pa.int64()), "url": [f"https://a.org/{i}" for i in ids],
                      "html": [None if i % 7 == 3 else f"<p>Page {i}</p>" for i in ids]})
    pq.write_table(table, f"{folder}/{name}", row_group_size=5)
    if old:
        os.utime(f"{folder}/{name}", (1, 1))


def _stream(spark, folder, **options):
    return spark.readStream.format("items").options(path=folder, **options).load()


def test_late_files_with_smaller_names_are_read_once(spark, tmp_path):
    items_source.register(spark)
    folder = str(tmp_path / "in")
    log = {"log": str(tmp_path / "log")}
    for name, ids, old in (("m.parquet", range(0, 20), False), ("a.parquet", range(20, 30), False), ("z.parquet", range(30, 33), True)):
        _page_file(spark, folder, name, list(ids), old)
        by_log = streams.run_available(_stream(spark, folder, **log), base=str(tmp_path / "by_log"))
        by_time = streams.run_available(_stream(spark, folder), base=str(tmp_path / "by_time"))
    assert sorted(r.page_id for r in by_log.collect()) == list(range(33))
    assert sorted(r.page_id for r in by_time.collect()) == list(range(30))  # an older time than what was read: see the docstring


def test_admission_limit(spark, tmp_path):
    items_source.register(spark)
    folder = str(tmp_path / "in")
    for k in range(5):
        _page_file(spark, folder, f"{k}.parquet", [k])
    options = {"log": str(tmp_path / "log"), "maxFilesPerTrigger": "2"}
    sizes = [streams.run_available(_stream(spark, folder, **options), base=str(tmp_path / "q")).count() for _ in range(4)]
    assert sizes == [2, 4, 5, 5]
    with pytest.raises(ValueError, match="log"):
        items_source.ItemsStreamReader({"path": folder, "maxFilesPerTrigger": "2"})


def test_filters_reach_the_reader(spark, tmp_path):
    items_source.register(spark)
    folder = str(tmp_path / "in")
    _page_file(spark, folder, "p.parquet", list(range(50)))
    df = spark.read.format("items").option("path", folder).load()
    checks = [F.col("page_id") == 7, F.col("page_id").between(11, 17), F.col("page_id").isin(1, 3, 99), ~F.col("page_id").isin(1, 3),
              F.col("html").isNull(), F.col("html").isNotNull(), F.col("url").endswith("/4"), F.col("html").contains("ge 2"),
              F.col("url").startswith("https://a.org/3"), F.col("page_id") != 5, ~(F.col("html") == "<p>Page 4</p>"),
              F.col("html").eqNullSafe(F.lit(None))]
    whole = df.collect()
    plain = spark.createDataFrame(whole, df.schema)
    for c in checks:
        assert sorted(map(str, df.where(c).collect())) == sorted(map(str, plain.where(c).collect()))
    reader = items_source.ItemsReader({"path": folder})
    reader.pushFilters([ds.GreaterThan(("page_id",), 47)])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_empty_folder(spark, tmp_path):
    items_source.register(spark)
    os.makedirs(tmp_path / "none")
    assert spark.read.format("items").option("path", str(tmp_path / "none")).load().count() == 0
