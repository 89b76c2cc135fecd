"""The relational store: fixed schemas as Parquet tables of one database, and edits as rewrites.

Rows are never changed in place: an edit reads a table, writes the new rows next to it, and then overwrites the table from
there, so that an edit that fails halfway loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables and columns.
TABLES: dict[str, str] = {
    "sequencer": "id long, name string",
    "read": "id long, sequencer_id long, name string, sequence string",
    "paired_read": "id long, first_read long, second_read long",
    "read_range": "id long, read_id long, sequencer_id long, r_start long, r_end long, primary_alignment int, mapping_quality double",
    "read_selection": "read_id long",
    "sv_jump_run": "id long, name string, descr string, time_stamp long",
    "sv_jump": "id long, run_id long, read_id long, from_pos long, to_pos long, query_from long, query_to long, num_supporting_nt long, from_fwd boolean, to_fwd boolean, was_mirrored boolean",
    "sv_caller_run": "id long, name string, descr string, time_stamp long, sv_jump_run_id long",
    "sv_call": "id long, run_id long, x long, y long, w long, h long, from_fwd boolean, to_fwd boolean, inserted string, inserted_size long, supporting_reads long, supporting_nt long, ambiguity long, order_id long, ctg_order_id long, mirrored boolean",
    "sv_call_support": "call_id long, jump_id long",
    "call_desc": "call_id long, descr string",
    "coverage": "run_id long, bin_id long, bin_coverage long",
    "k_mer_filter": "sequencer_id long, k_mer string, num_occ long",
    "mm_filter": "sequencer_id long, hash long, num_occ long",
}
#: Columns by which large tables are partitioned on write.
PARTITIONS = {"sv_jump": "run_id", "sv_call": "run_id", "coverage": "run_id", "read": "sequencer_id", "k_mer_filter": "sequencer_id", "mm_filter": "sequencer_id"}


class Store:
    """One database of the tables above."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")

    def create(self, table: str) -> None:
        """Creates a table unless it is there."""
        by = f" PARTITIONED BY ({PARTITIONS[table]})" if table in PARTITIONS else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}.{table} ({TABLES[table]}) USING parquet{by}")

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[table])

    def read(self, table: str) -> DataFrame:
        self.create(table)
        return self.spark.table(f"{self.name}.{table}").select(self.schema(table).fieldNames())

    def append(self, table: str, rows: DataFrame) -> None:
        """Appends rows, matched by column name; missing columns are null."""
        self.create(table)
        fields = self.schema(table).fields
        shaped = rows.select([F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        order = self.spark.table(f"{self.name}.{table}").columns
        shaped.select(order).write.insertInto(f"{self.name}.{table}")

    def next_id(self, table: str) -> int:
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1

    def with_ids(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with ids that continue the table's: unique and increasing, with gaps between partitions."""
        return rows.withColumn("id", F.monotonically_increasing_id() + self.next_id(table))

    def rewrite(self, table: str, rows: DataFrame) -> None:
        """Replaces a table's rows by rows that may be read from it."""
        self.create(table)
        fresh = f"{self.name}.{table}__new"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        order = self.spark.table(f"{self.name}.{table}").columns
        rows.select(order).write.format("parquet").saveAsTable(fresh)
        self.spark.table(fresh).write.insertInto(f"{self.name}.{table}", overwrite=True)
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")

    def delete(self, table: str, condition: Column) -> None:
        """Deletes rows for which the condition is true; null conditions keep them."""
        self.rewrite(table, self.read(table).filter(~F.coalesce(condition, F.lit(False))))

    def update(self, table: str, condition: Column, values: dict[str, Column]) -> None:
        rows = self.read(table)
        hit = F.coalesce(condition, F.lit(False))
        self.rewrite(table, rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}))

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{table}")

    def drop_all(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")

    def calls(self) -> DataFrame:
        """Calls with what follows from their columns: score and mean support."""
        rows = self.read("sv_call")
        return rows.withColumn("score", F.when(F.col("ambiguity") == 0, 0.0).otherwise(F.col("supporting_reads") / F.col("ambiguity"))).withColumn(
            "avg_nt", F.col("supporting_nt") / F.greatest("supporting_reads", F.lit(1))
        )

    def delete_run(self, run_id: int) -> None:
        """A caller run with its calls and their support."""
        gone = self.read("sv_call").filter(F.col("run_id") == run_id).select(F.col("id").alias("call_id"))
        self.rewrite("sv_call_support", self.read("sv_call_support").join(gone, "call_id", "left_anti"))
        self.delete("sv_call", F.col("run_id") == run_id)
        self.delete("sv_caller_run", F.col("id") == run_id)

    def add_coverage(self, rows: DataFrame) -> None:
        """Adds counts (run_id, bin_id, bin_coverage) to those stored."""
        both = self.read("coverage").unionByName(rows.select("run_id", "bin_id", F.col("bin_coverage").cast("long").alias("bin_coverage")))
        self.rewrite("coverage", both.groupBy("run_id", "bin_id").agg(F.sum("bin_coverage").alias("bin_coverage")))

    def schemas(self) -> list[str]:
        return sorted(x.name for x in self.spark.catalog.listDatabases())


def insert_reads(store: Store, sequencer: str, records: DataFrame, coverage: int, k: int = 18) -> int:
    """Stores reads (name, seq) of a sequencer and the k-mers that occur more than `coverage` times; returns its id."""
    from ..operators.kmers import kmer_counts, spread

    number = store.next_id("sequencer")
    store.append("sequencer", store.spark.createDataFrame([(number, sequencer)], "id long, name string"))
    rows = store.with_ids("read", records.select(F.lit(number).alias("sequencer_id"), "name", F.col("seq").alias("sequence")))
    store.append("read", rows)
    stored = store.read("read").filter(F.col("sequencer_id") == number).select("id", F.col("sequence").alias("seq"))
    counts = kmer_counts(spread(stored), k, [], both_strands=True).filter(F.col("n") > coverage)
    store.append("k_mer_filter", counts.select(F.lit(number).alias("sequencer_id"), F.col("kmer").alias("k_mer"), F.col("n").alias("num_occ")))
    return number
