import pytest

from plumbline.sources.artifacts import bounded_query, export_evidence
from plumbline.sources.database import Partitioning, reader_options
from plumbline.sources.files import load_file
from plumbline.sources.snapshot import create_snapshot, load_snapshot, table_fingerprint, table_hash

ROWS = [(1, "a"), (2, "b"), (2, "b"), (3, None)]
SCHEMA = "id int, val string"


def test_csv_types_and_missing_values(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("date,revenue,customer_id,region\n2024-01-01,10.5,1,NA\n2024-01-02,,2,EU\n2024-01-03,7,3,NA\n")
    df = load_file(spark, str(path), view="loaded_csv")
    assert dict(df.dtypes) == {"date": "date", "revenue": "double", "customer_id": "int", "region": "string"}
    assert spark.sql("select count(revenue) from loaded_csv").first()[0] == 2


def test_tsv_with_schema(spark, tmp_path):
    path = tmp_path / "test.tsv"
    path.write_text("id\tval\n1\ta,b\n")
    assert load_file(spark, str(path), schema=SCHEMA).collect() == [(1, "a,b")]


def test_missing_file_and_unknown_suffix(spark, tmp_path):
    for name in ("absent.csv", "absent.parquet"):
        with pytest.raises(FileNotFoundError):
            load_file(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="no reader"):
        load_file(spark, str(tmp_path / "book.doc"))


def test_jdbc_options_split_the_read():
    options = reader_options("jdbc:postgresql://host/db", "orders", partitioning=Partitioning("id", 0, 1000, 8))
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id"
    assert "partitionColumn" not in reader_options("jdbc:postgresql://host/db", "nation")


def test_fingerprint_ignores_order_counts_copies_and_sees_changes(spark):
    base = spark.createDataFrame(ROWS, SCHEMA)
    digest = table_fingerprint(base).first()
    shuffled = spark.createDataFrame(list(reversed(ROWS)), SCHEMA).repartition(5)
    assert table_fingerprint(shuffled).first() == digest
    changed = spark.createDataFrame([*ROWS[:3], (3, "")], SCHEMA)
    fewer = spark.createDataFrame([ROWS[0], ROWS[1], ROWS[3]], SCHEMA)
    shifted = spark.createDataFrame([("1|a", "b"), ("1", "a|b")], "x string, y string")
    tiny = spark.createDataFrame([(1.0,)], "x double")
    assert table_hash(tiny) != table_hash(spark.createDataFrame([(1.0 + 1e-15,)], "x double"))
    assert len({table_hash(df) for df in (base, changed, fewer, shifted)}) == 4
    left = spark.createDataFrame([("1|a", "b")], "x string, y string")
    right = spark.createDataFrame([("1", "a|b")], "x string, y string")
    assert table_hash(left) != table_hash(right)


def test_fingerprint_of_empty_table_and_schema(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert table_fingerprint(empty).first()["data_hash"] == ""
    assert table_hash(empty) != table_hash(spark.createDataFrame([], "id bigint, val string"))


def test_snapshot_is_idempotent_and_complete(spark, tmp_path):
    base = spark.createDataFrame(ROWS, SCHEMA)
    other = spark.range(3)
    first = create_snapshot({"t": base, "u": other}, str(tmp_path))
    again = create_snapshot({"u": other, "t": base.repartition(3)}, str(tmp_path))
    assert first == again
    frames = load_snapshot(spark, str(tmp_path), first)
    assert sorted(frames) == ["t", "u"]
    assert sorted(frames["t"].collect(), key=str) == sorted(base.collect(), key=str)
    assert spark.sql("select count(*) from u").first()[0] == 3
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, str(tmp_path), "0" * 64)


def test_half_written_snapshot_is_written_again(spark, tmp_path):
    base = spark.createDataFrame(ROWS, SCHEMA)
    digest = create_snapshot({"t": base}, str(tmp_path))
    (tmp_path / digest / "t" / "_SUCCESS").unlink()
    create_snapshot({"t": base}, str(tmp_path))
    assert (tmp_path / digest / "t" / "_SUCCESS").exists()
    assert load_snapshot(spark, str(tmp_path), digest)["t"].count() == 4


def test_bounded_query_caps_and_reports(spark, tmp_path):
    spark.range(500).createOrReplaceTempView("numbers500")
    capped = bounded_query(spark, "SELECT id FROM numbers500 ORDER BY id", str(tmp_path / "a"), cap=300).first()
    assert (capped.status, capped.num_rows, capped.truncated, len(capped.preview)) == ("ok", 300, True, 200)
    assert capped.preview[0] == '{"id":0}'
    exact = bounded_query(spark, "SELECT id FROM numbers500 LIMIT 300 -- all", str(tmp_path / "d"), cap=300).first()
    assert (exact.num_rows, exact.truncated) == (300, False)
    own = bounded_query(spark, "WITH q AS (SELECT id FROM numbers500) SELECT * FROM q LIMIT 400 OFFSET 1;", str(tmp_path / "b")).first()
    assert (own.num_rows, own.truncated) == (400, False)


@pytest.mark.parametrize("query", ["DROP TABLE numbers500", "SELECT nope FROM numbers500", "INSERT INTO t VALUES (1)"])
def test_bounded_query_errors_become_records(spark, tmp_path, query):
    record = bounded_query(spark, query, str(tmp_path / "c")).first()
    assert record.status == "error" and record.error and record.num_rows is None


def test_export_one_run(spark, tmp_path):
    evidence = spark.createDataFrame([("r1", 1, {"p": 0.5}), ("r2", 1, {})], "run_id string, seq bigint, result map<string,double>")
    export_evidence(evidence, str(tmp_path / "out"), "r1")
    back = spark.read.schema(evidence.schema).json(str(tmp_path / "out"))
    assert back.collect() == evidence.where("run_id = 'r1'").collect()
