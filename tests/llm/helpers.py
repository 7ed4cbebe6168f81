"""Small tables for the tests of this folder."""

import duckdb

DATA = "/root/testdata"
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=""):
    """documents from (doc_id, text) or (doc_id, text, lang, source); two partitions."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, ROWS)
    return df.selectExpr("*", *([extra] if extra else [])).repartition(2)


def sql_rows(sf_dir, sql, tables):
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = db.execute(sql)
    return sorted(c[0] for c in result.description), result


def folder_of(df, tmp_path, name="documents"):
    """A table folder with one table."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
