"""Staging tables: one Parquet dataset per table, partitioned by upload, with a widening schema.

A table's columns and their first-seen types are kept next to it, because files of older uploads lack
newer columns and an upload may bring a column under another type. Every read states that schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.casts import coerce, storage_type
from ledgerloom.operators.numbering import numbered
from ledgerloom.operators.siblings import plain_snake
from ledgerloom.session import COMPRESSION, durable, observed

#: A row's position is the number of its upload times this, plus its place in the upload.
BATCH = 1 << 40


@dataclass
class Store:
    """A folder of tables ``<prefix><table>`` with the declared columns of each."""

    spark: SparkSession
    root: str
    prefix: str = "stg_"

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p)

    def _remove(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p) and fs.delete(p, True)

    def _children(self, name: str) -> list[str]:
        p, fs = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def data_path(self, table: str) -> str:
        return f"{self.root}/{self.prefix}{plain_snake(table)}"

    def _schema_path(self, table: str) -> str:
        return f"{self.root}/schemas/{self.prefix}{plain_snake(table)}"

    def tables(self) -> list[str]:
        n = len(self.prefix)
        return [c[n:] for c in self._children(f"{self.root}/schemas") if c.startswith(self.prefix)]

    def columns(self, table: str) -> dict[str, str]:
        """Declared columns in order with their declared type; empty for an unknown table."""
        path = self._schema_path(table)
        if not self._exists(path):
            return {}
        rows = self.spark.read.schema("position int, name string, type string").json(path).orderBy("position").collect()
        return {r["name"]: r["type"] for r in rows}

    def widen(self, table: str, types: dict[str, str]) -> list[str]:
        """Declare the columns that are new; returns their names. Known columns keep their type."""
        known = self.columns(table)
        added = [c for c in types if c not in known]
        if added or not known:
            declared = {**known, **{c: types[c] for c in added}}
            entries = [(i, c, t) for i, (c, t) in enumerate(declared.items())]
            listed = self.spark.createDataFrame(entries, "position int, name string, type string")
            listed.coalesce(1).write.mode("overwrite").json(self._schema_path(table))
        return added

    def all_columns(self) -> DataFrame:
        """``table_name, column_name`` of every table."""
        rows = [(t, c) for t in self.tables() for c in self.columns(t)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string")


class Staging(Store):
    """Staged uploads."""

    def schema(self, table: str) -> T.StructType:
        fields = [T.StructField("_row", T.LongType())]
        fields += [T.StructField(c, storage_type(t)) for c, t in self.columns(table).items()]
        return T.StructType([*fields, T.StructField("upload_id", T.StringType())])

    def write(self, table: str, rows: DataFrame, types: dict[str, str], upload_id: str) -> dict:
        """Replace this upload's rows; new columns widen the table. Running it twice changes nothing.

        ``rows`` has ``pos`` (order; a number from 0 up to 2^40, or anything that sorts) and the columns of ``types``. Values are converted to the type the
        table first declared for the column. Returns the stored name, the rows, the new columns, and the gaps of each
        column; the writing job counts them.
        """
        added = self.widen(table, types)
        declared = self.columns(table)
        have = {f.name: f.dataType for f in rows.schema.fields}
        values = [
            (coerce(F.col(c), t, have[c]) if c in have else F.lit(None).cast(storage_type(t))).alias(c) for c, t in declared.items()
        ]
        if isinstance(have["pos"], T.LongType):
            placed = rows.select(F.col("pos").alias("_row"), *values)
        else:
            # numbers by prefix sums over tasks follow any order
            named = rows.withColumnRenamed("pos", "_pos")
            placed = numbered(named, [F.asc("_pos")], "_row").select("_row", *values)
        path = self.data_path(table)
        blank = {c: F.count_if(F.col(c).isNull()) for c in declared}
        told = observed(
            placed.withColumn("upload_id", F.lit(upload_id)), {"rows": F.count(F.lit(1)), **{f"blank {c}": b for c, b in blank.items()}},
            lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path, compression=COMPRESSION),
        )
        if not told["rows"]:
            # an empty batch writes no file, so old ones are removed here
            self._remove(f"{path}/upload_id={upload_id}")
        return {"table": self.prefix + plain_snake(table), "rows": told["rows"], "added_columns": added, "blanks": {c: told[f"blank {c}"] for c in declared}}

    def read(self, table: str) -> DataFrame:
        """All uploads of a table with the declared columns; columns unknown to old files are NULL."""
        path = self.data_path(table)
        if not self._exists(path):
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(path)

    def read_table(self, table: str, limit: int | None = None) -> DataFrame:
        """Rows in order with ``_partition``, the upload they came from."""
        rows = self.read(table).withColumn("_partition", F.col("upload_id"))
        return rows if limit is None else rows.orderBy("upload_id", "_row").limit(limit)

    def list_tables(self) -> DataFrame:
        """``table_name, row_count, uploads, partitions``. Counts read no column."""
        out = None
        for t in self.tables():
            one = self.read(t).groupBy("upload_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "upload_id", "n")
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], "table_name string, row_count bigint, uploads int, partitions array<string>")
        named = F.when(F.coalesce("upload_id", F.lit("")) != "", F.col("upload_id"))
        ids = F.array_sort(F.collect_set(named))  # one entry per upload
        return out.groupBy("table_name").agg(F.sum("n").alias("row_count"), F.size(ids).alias("uploads"), ids.alias("partitions"))

    def harvest(self, columns: list[str] | None = None, tables: list[str] | None = None) -> DataFrame:
        """Rows of every table (or of ``tables``), with ``source_table`` and ``pos``; missing columns are NULL.

        ``pos`` is a number that orders rows by table, upload and place.
        A column that tables declare under different types comes as text, as does every column without a list.
        """
        kinds: dict[str, set] = {}
        for t in self.tables():
            for c, kind in self.columns(t).items():
                kinds.setdefault(c, set()).add(storage_type(kind).simpleString())
        batches, out = self.batches(), None
        for t in self.tables() if tables is None else tables:
            rows = self.read(t)
            picked = [c for c in rows.columns if c not in ("_row", "upload_id") and (columns is None or c in columns)]
            part = rows.select(
                F.lit(t).alias("source_table"), "upload_id", "_row",
                *[F.col(c).cast("string") if columns is None or len(kinds[c]) > 1 else F.col(c) for c in picked],
            )
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError(f"no staging table under {self.root}")
        return out.join(batches, ["source_table", "upload_id"]).withColumn("pos", F.col("batch") * F.lit(BATCH) + F.col("_row")).drop("batch", "_row")

    def batches(self) -> DataFrame:
        """``source_table, upload_id, batch``: staged uploads numbered by table, then upload. Reads no column."""
        out = None
        for t in self.tables():
            one = self.read(t).select(F.lit(t).alias("source_table"), "upload_id").distinct()
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], "source_table string, upload_id string, batch long")
        return durable(numbered(out, [F.asc("source_table"), F.asc("upload_id")], "batch"), "batches")

    def fact_tables(self) -> list[str]:
        """Tables that hold sales facts: named `sales...` or with an `amount` column."""
        return [t for t in self.tables() if t.startswith("sales") or "amount" in self.columns(t)]

    def delete_upload(self, upload_id: str) -> int:
        """Drop the upload's partition from every table; returns how many tables had one."""
        return sum(self._remove(f"{self.data_path(t)}/upload_id={upload_id}") for t in self.tables())
