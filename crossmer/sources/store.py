"""Result store: a folder of Parquet tables.

``similarities`` is append-only: an insert writes only pairs not stored yet,
as one more folder. ``antigens`` and ``run_metadata`` are replaced as a whole:
a new version is written next to the old one and becomes current when its
write has succeeded, so a lost job never leaves a half-written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crossmer import constants as C
from crossmer.operators import tables as T
from crossmer.plans.screen import PAIR_COLUMNS

_SCHEMAS = {
    "antigens": "id string, sequence string, stripped string, tag_found int, length int",
    "similarities": ", ".join(f"{c} {T.PAIR_TYPES[c]}" for c in PAIR_COLUMNS),
    "run_metadata": "key string, value string",
}


class ResultStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- folders -------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self) -> bool:
        fs, target = self._fs(self.path)
        return bool(fs.exists(target))

    def _versions(self, table: str) -> list[int]:
        """Finished writes of a table, oldest first."""
        fs, target = self._fs(f"{self.path}/{table}")
        if not fs.exists(target):
            return []
        found = []
        for entry in fs.listStatus(target):
            name = entry.getPath().getName()
            done = self._fs(f"{self.path}/{table}/{name}/_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and done[0].exists(done[1]):
                found.append(int(name[1:]))
        return sorted(found)

    def _read(self, table: str) -> DataFrame:
        versions = self._versions(table)
        if table != "similarities":
            versions = versions[-1:]
        if not versions:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        folders = [f"{self.path}/{table}/v{n:06d}" for n in versions]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders)

    def _write(self, table: str, frame: DataFrame) -> None:
        number = (self._versions(table) or [0])[-1] + 1
        frame.write.mode("overwrite").parquet(f"{self.path}/{table}/v{number:06d}")

    # --- antigens --------------------------------------------------------------------

    @property
    def antigens(self) -> DataFrame:
        return self._read("antigens")

    def upsert_antigens(self, records: DataFrame, order: str = "ordinal") -> None:
        """Insert or replace (id, sequence, stripped, tag_found, <order>) records."""
        shaped = records.select(
            "id", "sequence", "stripped", F.col("tag_found").cast("int").alias("tag_found"),
            F.length("stripped").alias("length"), order)
        self._write("antigens", T.upsert(self.antigens, shaped, "id", order))

    def get_all_stripped(self) -> DataFrame:
        return self.antigens.select("id", "stripped").orderBy("id")

    def antigen_count(self) -> int:
        return self.antigens.count()

    def total_residues(self) -> int:
        return int(self.antigens.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])

    # --- similarities ------------------------------------------------------------------

    @property
    def similarities(self) -> DataFrame:
        """Stored pairs; columns missing in old writes come with their defaults."""
        return T.conform_pairs(self._read("similarities"))

    def insert_similarities(self, pairs: DataFrame) -> None:
        """Append pairs whose (query_id, target_id) is not stored; stored rows stay."""
        keys = ["query_id", "target_id"]
        shaped = T.conform_pairs(pairs)
        fields = [c for c in shaped.columns if c not in keys]
        numbered = shaped.withColumn("_place", F.monotonically_increasing_id())
        first = numbered.groupBy(*keys).agg(F.min_by(F.struct(*fields), "_place").alias("r")).select(*keys, "r.*")
        new = first.join(self.similarities.select(*keys), keys, "left_anti")
        self._write("similarities", new.select(*PAIR_COLUMNS))

    def similarity_count(self) -> int:
        return self.similarities.count()

    def completed_queries(self) -> DataFrame:
        return self.similarities.select("query_id").distinct()

    def query_similar(self, antigen_id: str, max_evalue: float = C.MAX_EVALUE,
                      top_n: int = C.LOOKUP_TOP_N) -> DataFrame:
        """Best stored partners of one antigen, either direction, best E-value first."""
        pairs = self.similarities.filter(
            (F.col("query_id") == antigen_id) | (F.col("target_id") == antigen_id))
        found = T.partners(pairs, None, max_evalue).filter(F.col("id") == antigen_id)
        return found.orderBy("evalue", "partner_id").limit(top_n)

    # --- metadata --------------------------------------------------------------------------

    def set_meta(self, **values: str) -> None:
        new = self.spark.createDataFrame(
            [(k, str(v), i) for i, (k, v) in enumerate(values.items())],
            "key string, value string, n int")
        self._write("run_metadata", T.upsert(self._read("run_metadata"), new, "key", "n"))

    def get_meta(self, key: str) -> str | None:
        row = self._read("run_metadata").filter(F.col("key") == key).first()
        return row["value"] if row else None

    # --- export ----------------------------------------------------------------------------

    def export_csv(self, output: str, max_evalue: float = C.EXPORT_MAX_EVALUE) -> int:
        """Write pairs with sequences as a folder of CSV parts in E-value order.

        Parts are ranges of the E-value, so that concatenating them by name
        gives the full order; nothing is gathered in one task.
        """
        rows = T.export_rows(self.similarities, self.antigens, max_evalue)
        rows.orderBy("evalue", "query_id", "target_id").write.mode("overwrite").option(
            "header", True).option("nullValue", "").option("emptyValue", "").csv(output)
        return self.spark.read.option("header", True).csv(output).count()

    def close(self) -> None:
        """Nothing is held open; the session belongs to the caller."""

    def __enter__(self) -> ResultStore:
        return self

    def __exit__(self, *_args) -> None:
        self.close()
