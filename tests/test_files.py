"""Headerless replicate files: the bogus first line goes from every file, however the files are split."""

from pyspark.sql import types as T

from fidelis.sources import files as S


def test_bogus_first_line_per_file(spark, tmp_path):
    want = []
    for k in range(3):
        # data rows that look like the bogus row stay, unless they are the first line
        lines = ["0,1,2.0"] if k != 1 else []
        body = [f"{k},{i},v{i}" if i % 40 else "0,1,2" for i in range(1, 400)]
        (tmp_path / f"r{k}.csv").write_text("\n".join(lines + body) + "\n")
        want += [tuple(x.split(",")) for x in body]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = S.read_headerless_csv(spark, str(tmp_path))
            if size == "700":
                assert raw.select("_file", "_start").distinct().count() > 6
            got = S.drop_index_row_set_headers(raw, ["a", "b", "c"])
            assert got.columns == ["a", "b", "c"] and sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_replicates_are_numbered_from_the_list_of_files(spark, tmp_path):
    """F16: names are checked and numbers given per file, not by a pass over all rows and an expression per row."""
    for t, k, name, rows in (("real", 0, "a b%1.csv", 3), ("syn", 1, "x.csv", 2), ("syn", 1, "run_LOG.csv", 5), ("syn", 2, "x.csv", 0), ("syn", 3, "x.csv", 4)):
        (tmp_path / t / f"k={k}").mkdir(parents=True, exist_ok=True)
        (tmp_path / t / f"k={k}" / name).write_text("v\n" + "".join(f"{k}\n" for _ in range(rows)))
    schema = T.StructType([T.StructField("v", T.DoubleType())])
    got = S.scan_panel_files(spark, {"REAL": f"{tmp_path}/real/k=*", "S": f"{tmp_path}/syn/k=*"}, schema)
    counts = {tuple(r) for r in got.groupBy("technique", "replicate", "v").count().collect()}
    # the file without rows has no number, the log none either
    assert counts == {("REAL", 0, 0.0, 3), ("S", 1, 1.0, 2), ("S", 2, 3.0, 4)}
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan
