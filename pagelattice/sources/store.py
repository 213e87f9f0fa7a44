"""Tables of chunk vectors and of state, kept as Parquet and JSON folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, page_id string, chunk_index int, chunk_text string, heading_path string, vector array<float>, part int"
#: Folders of a table, and about how many rows a file has.
PARTS, FILE_ROWS = 64, 1 << 20


class VectorStore:
    """Chunk vectors by page. Pages are hashed into PARTS folders; an upsert rewrites only the folders of its pages.

    ``root`` is a shared folder. New files of a part are complete before the old ones go (dynamic partition overwrite), so a
    reader never sees half an upsert of a part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.root)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def upsert(self, chunks: DataFrame) -> None:
        """All rows of the pages in ``chunks`` replaced. An empty input changes nothing; a vector of another length than the rest, or a page id of other characters than letters, digits, ``-_.``, is an error."""
        new = chunks.select("page_id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text", "heading_path", F.col("vector").cast("array<float>").alias("vector"))
        new = new.withColumn("chunk_id", F.concat_ws("#", "page_id", F.col("chunk_index").cast("string"))).withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int"))
        seen = new.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size("vector")).alias("sizes"), F.sum((~F.col("page_id").rlike(r"^[\p{L}\p{N}_.-]{1,256}$")).cast("int")).alias("bad"), F.collect_set("part").alias("parts")).first()
        if not seen.n:
            return
        old = self.read().where(F.col("part").isin(seen.parts))
        known = self.rows().select(F.size("vector").alias("s")).limit(1).first()
        sizes = {*seen.sizes, *([known.s] if known else [])}
        if len(sizes) > 1 or -1 in sizes:
            raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
        if seen.bad:
            raise ValueError(f"{seen.bad} rows with unfit page ids")
        self._write(old.join(new.select("page_id").distinct(), "page_id", "left_anti").unionByName(new))

    def delete_pages(self, pages: DataFrame) -> None:
        """All rows of the pages removed; unknown pages and a missing table are no error."""
        parts = [r[0] for r in pages.select(F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).cast("int")).distinct().collect()]
        old = self.read().where(F.col("part").isin(parts)) if parts else None
        if old is None or not old.limit(1).count():
            return
        left = old.join(pages.select("page_id").distinct(), "page_id", "left_anti")
        # a part that loses all its rows is not overwritten by any: it gets a row that no reader keeps
        marks = self.spark.createDataFrame([(p,) for p in parts], "part int").select(*[F.lit(None).alias(c) for c in ("chunk_id", "page_id", "chunk_index", "chunk_text", "heading_path", "vector")], "part")
        self._write(left.unionByName(marks.select(*[F.col(c).cast(left.schema[c].dataType).alias(c) for c in left.columns])))

    def rows(self) -> DataFrame:
        return self.read().where("chunk_id IS NOT NULL")

    def count(self) -> int:
        return self.rows().count()

    def _write(self, df: DataFrame) -> None:
        from pagelattice.session import shared_checkpoint

        whole = shared_checkpoint(df.select("chunk_id", "page_id", "chunk_index", "chunk_text", "heading_path", "vector", "part"))
        # a part of many rows is written by several tasks, a page's rows by one of them
        files = F.pmod(F.xxhash64(F.lit(1), "page_id"), F.lit(max(1, -(-whole.count() // (PARTS * FILE_ROWS)))))
        whole.repartition("part", files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.root)


def save_state(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State as rows; none if it was never saved. Lines that can't be read are left out here and given by ``unreadable_state``."""
    return _state(spark, path, schema).where("_line IS NULL").drop("_line")


def unreadable_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``line``: what ``load_state`` had to leave out, so that a loss is seen."""
    return _state(spark, path, schema).where("_line IS NOT NULL").select(F.col("_line").alias("line"))


def _state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    whole = f"{schema}, _line string"
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
        return lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}).alias("x")).select("x.*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], whole)
        raise


def kept_messages(messages: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` messages of each conversation, which is what a saved conversation keeps."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
