"""CSV files with line breaks in quoted fields, read by many tasks, against Spark's own reader of whole files."""

import csv
import random

import pytest

from basketry.sources.csv import SALES_SCHEMA, quoted_records, read_sales_csv, read_user_csv

HEADER = [f.name for f in SALES_SCHEMA.fields]


def write(path, n, seed, header=HEADER, long=0):
    rng = random.Random(seed)
    words = ["plain", 'with "quotes"', "two\nlines", "a, comma", "", '"', "\n", "x" * long + "\n\n" + "y" * long, "ends with\n"]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        for k in range(n):
            out.writerow([k, rng.choice(words), rng.choice(words), rng.randrange(9), "2011-01-01 10:00:00", 2.5, rng.randrange(5), rng.choice(words) or "UK"])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed, long", [(1, 3), (2, 2_000), (3, 40)])
def test_records_are_those_of_the_whole_file(spark, tmp_path, small_splits, seed, long):
    for k in range(3):
        write(f"{tmp_path}/f{k}.csv", 150, seed * 10 + k, long=long)
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8
    plain = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(SALES_SCHEMA).csv(str(tmp_path))
    got = read_sales_csv(spark, str(tmp_path), multi_line=True)
    assert got.columns == plain.columns and got.count() == 450
    assert rows(got) == rows(plain)


def test_a_header_of_several_splits(spark, tmp_path, small_splits):
    """Line breaks in the header's own fields, over three splits."""
    path = f"{tmp_path}/a.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "long " + "name\n" * 400])
        for k in range(200):
            out.writerow([k, f"a\n{k}"])
    got = [r.record for r in quoted_records(spark, path).collect()]
    assert sorted(got) == sorted(f'{k},"a\n{k}"' for k in range(200))


def test_files_without_records(spark, tmp_path):
    write(f"{tmp_path}/a.csv", 0, 1)
    write(f"{tmp_path}/b.csv", 2, 1)
    assert quoted_records(spark, str(tmp_path)).count() == 2 == read_sales_csv(spark, str(tmp_path), multi_line=True).count()


def test_surplus_fields_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,3,4\n')
    assert "more fields" in read_user_csv(spark, str(tmp_path), multi_line=True)["error"]
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2\n')
    assert [tuple(r) for r in read_user_csv(spark, str(tmp_path), multi_line=True)["data"].collect()] == [(1, "x\ny"), (2, None)]


def test_types_are_those_of_the_whole_file(spark, tmp_path, small_splits):
    header = ["id", "when", "note", "amount", "flag", "day", "gap"]
    with open(f"{tmp_path}/a.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        for k in range(120):
            out.writerow([k, f"2024-01-{k % 28 + 1:02d} 10:00:00", "a\nb" if k % 2 else 'q"q', "" if k % 9 == 0 else k / 4, k % 2 == 0, f"2024-02-{k % 28 + 1:02d}", "n/a" if k % 3 else 7])
    whole = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", True).csv(str(tmp_path))
    got = read_user_csv(spark, str(tmp_path), multi_line=True)["data"]
    assert got.dtypes[:6] == whole.dtypes[:6] and got.dtypes[6] == ("gap", "double")
    assert rows(got.drop("gap")) == rows(whole.drop("gap"))
