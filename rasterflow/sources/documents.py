"""Documents at rest: fingerprints, stores as tables, imports with receipts, layers of a document as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193


def _fnv(units: Column) -> Column:
    """FNV-1a of an array of numbers."""
    return F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))


def _code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv_utf8(text: Column) -> Column:
    """FNV-1a over a text's UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return _fnv(F.transform(at, lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("long")))


def fnv_utf16(text: Column) -> Column:
    """FNV-1a over a text's UTF-16 units: the hash of fingerprints, another one than fnv_utf8."""
    halves = lambda c: F.when(c > 0xFFFF, F.array(0xD800 + F.shiftright(c - 0x10000, 10), 0xDC00 + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))).otherwise(F.array(c))
    return _fnv(F.flatten(F.transform(_code_points(text), halves)))


def fingerprints(documents: DataFrame) -> DataFrame:
    """documents (path, name, id) with path_hash, unsaved and key. Paths are compared in lower case, with slashes; an unsaved
    document is told by its id and name."""
    path = F.lower(F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")))
    virtual = F.concat(F.lit("unsaved://"), F.coalesce(F.col("id").cast("string"), F.lit("unknown")), F.lit("/"), F.lower(F.coalesce("name", F.lit(""))))
    unsaved = path == ""
    named = documents.withColumn("path_hash", F.lower(F.lpad(F.hex(fnv_utf16(F.when(unsaved, virtual).otherwise(path))), 8, "0"))).withColumn("unsaved", unsaved)
    safe = F.regexp_replace(F.when(F.coalesce("name", F.lit("")) == "", "unnamed").otherwise(F.col("name")), r"[^A-Za-z0-9_.\-]", "_")
    return named.withColumn("key", F.concat(F.lit("doc-"), F.col("path_hash"), F.lit("-"), safe, F.lit(".film.json")))


def same_document(a: str, b: str) -> Column:
    """Whether the fingerprints under two aliases are one document's: unsaved ones need the same id."""
    c = lambda side, n: F.col(f"{side}.{n}")
    same = (c(a, "path_hash") == c(b, "path_hash")) & c(a, "name").eqNullSafe(c(b, "name"))
    return same & (~(c(a, "unsaved") | c(b, "unsaved")) | c(a, "id").eqNullSafe(c(b, "id")))


def import_plan(incoming: DataFrame, store: DataFrame, overwrite: DataFrame) -> DataFrame:
    """incoming with `action`: written (new key), overwritten (held, and in overwrite) or preserved (held otherwise)."""
    held = incoming.join(store.select("key").distinct().withColumn("_held", F.lit(True)), "key", "left")
    asked = held.join(overwrite.select("key").distinct().withColumn("_asked", F.lit(True)), "key", "left")
    action = F.when(F.col("_held").isNull(), "written").when(F.col("_asked").isNotNull(), "overwritten").otherwise("preserved")
    return asked.withColumn("action", action).drop("_held", "_asked")


class DocumentStore:
    """A store of documents as a Spark table path: one row per key, the newest import last; receipts make imports idempotent."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        """key, document: what was saved last under each key."""
        rows = self._read("documents", "key string, document string, version long, removed boolean")
        last = rows.groupBy("key").agg(F.max_by(F.struct("document", "removed"), "version").alias("l"))
        return last.where("not l.removed").select("key", "l.document")

    def _append(self, rows: DataFrame, removed: bool) -> None:
        version = self._read("documents", "key string, document string, version long, removed boolean").agg(F.max("version")).first()[0] or 0
        rows.select("key", "document", F.lit(version + 1).cast("long").alias("version"), F.lit(removed).alias("removed")).write.mode("append").parquet(f"{self.path}/documents")

    def save(self, rows: DataFrame) -> None:
        self._append(rows, False)

    def remove(self, keys: DataFrame) -> None:
        self._append(keys.select("key", F.lit(None).cast("string").alias("document")), True)

    def imported(self, crc32: int) -> bool:
        return self._read("receipts", "crc32 long, imported long, overwritten long, preserved long").where(F.col("crc32") == crc32).limit(1).count() > 0

    def take(self, incoming: DataFrame, overwrite: DataFrame, crc32: int) -> dict | None:
        """Import a bundle's rows (key, document) once; its receipt, or None if it has been imported before."""
        if self.imported(crc32):
            return None
        plan = import_plan(incoming, self.documents(), overwrite)
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        self.save(plan.where("action <> 'preserved'"))
        receipt = {"crc32": crc32, "imported": counts.get("written", 0) + counts.get("overwritten", 0), "overwritten": counts.get("overwritten", 0), "preserved": counts.get("preserved", 0)}
        self.spark.createDataFrame([receipt], "crc32 long, imported long, overwritten long, preserved long").write.mode("append").parquet(f"{self.path}/receipts")
        return receipt


def resolve_bindings(layers: DataFrame, bindings: DataFrame) -> DataFrame:
    """bindings (document, id, name) with layer: the one of that id if its name fits or none is asked for, else the only one of the name.

    layers: document, layer, name of every layer at any depth. Null where nothing fits or a name is ambiguous. Other columns
    of bindings stay.
    """
    by_id = layers.select("document", F.col("layer").alias("id"), F.col("name").alias("_found"), F.col("layer").alias("_by_id"))
    by_name = layers.groupBy("document", "name").agg(F.count("*").alias("_n"), F.min("layer").alias("_by_name"))
    out = bindings.join(by_id, ["document", "id"], "left").join(by_name, ["document", "name"], "left")
    exact = F.col("_by_id").isNotNull() & (F.col("name").isNull() | (F.col("_found") == F.col("name")))
    return out.select(*bindings.columns, F.when(exact, F.col("_by_id")).when(F.col("_n") == 1, F.col("_by_name")).alias("layer"))
