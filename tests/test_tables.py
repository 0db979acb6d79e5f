"""Schemas of tables are remembered as long as their files stay as they are."""

from basketry.sources import tables


def test_a_changed_table_is_read_anew(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    one = tables.table(spark, str(tmp_path), "t")
    assert tables.table(spark, str(tmp_path), "t").schema == one.schema
    spark.range(2).selectExpr("id AS a", "id * 2.5D AS b").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert tables.table(spark, str(tmp_path), "t").columns == ["a", "b"] and tables.table(spark, str(tmp_path), "t").count() == 2
