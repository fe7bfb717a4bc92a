"""API snapshots and keyed diffs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import signature_hash

LOCATION = "struct<path:string,line:bigint,column:bigint>"
SCHEMA = (
    f"crate_name string, no_std boolean, functions array<struct<fq_name:string,sig_hash:string,signature:string,location:{LOCATION}>>,"
    f" exports array<struct<exported_as:string,source_path:string,location:{LOCATION}>>, imports array<string>"
)


@dataclass
class Snapshot:
    """functions, exports: with file_ord and ord; imports: distinct paths."""

    crate: str
    no_std: DataFrame
    functions: DataFrame
    exports: DataFrame
    imports: DataFrame

    @classmethod
    def of(cls, corpus) -> Snapshot:
        functions = corpus.functions_df.select("fq_name", signature_hash(F.col("signature")).alias("sig_hash"), "signature", "location", "file_ord", "ord")
        exports = corpus.exports.select("exported_as", "source_path", "location", "file_ord", "ord")
        return cls(corpus.crate, corpus.no_std(), functions, exports, corpus.imports_df.select("full_path").distinct())

    def diff(self, old: Snapshot, key: tuple[str, ...] = ("fq_name",)) -> DataFrame:
        """entity, change, key, old, new for everything added, removed or changed since old.

        Functions are compared by key and the last of each key counts; ("path", "fq_name") tells
        equal names in different files apart. Exports keep their repeats.
        """
        a, b = _last(self.functions, key), _last(old.functions, key)
        names = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("_key",)]
        both = a.alias("n").join(b.alias("o"), names, "full_outer")
        change = F.when(F.col("o._key").isNull(), "added").when(F.col("n._key").isNull(), "removed").when(F.col("n.sig_hash") != F.col("o.sig_hash"), "changed")
        functions = both.select(F.lit("function").alias("entity"), change.alias("change"), F.coalesce("n._key", "o._key").alias("key"), F.col("o.signature").alias("old"), F.col("n.signature").alias("new")).where("change is not null")
        return functions.unionByName(_exports(self.exports, old.exports)).unionByName(_imports(self.imports, old.imports))

    def row(self) -> DataFrame:
        """The whole snapshot as one row; for sinks, as its arrays hold every fact."""
        listed = lambda df, *cols: df.agg(F.transform(F.sort_array(F.collect_list(F.struct("file_ord", "ord", F.struct(*cols).alias("r")))), lambda x: x["r"]).alias("a"))
        functions = listed(self.functions, "fq_name", "sig_hash", "signature", "location").withColumnRenamed("a", "functions")
        exports = listed(self.exports, "exported_as", "source_path", "location").withColumnRenamed("a", "exports")
        imports = self.imports.agg(F.sort_array(F.collect_list("full_path")).alias("imports"))
        one = self.no_std.select(F.lit(self.crate).alias("crate_name"), "no_std")
        return one.crossJoin(functions).crossJoin(exports).crossJoin(imports)  # one row each

    def to_json(self) -> str:
        return json.dumps(json.loads(self.row().toJSON(use_unicode=True).first()), indent=2, ensure_ascii=False)

    def write(self, path: str) -> None:
        """To a local path, or to a URI by Spark's file systems."""
        text = self.to_json()
        if "://" not in path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            return
        spark = self.functions.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Snapshot:
        """From a JSON file; fields that it lacks are null."""
        one = spark.read.schema(SCHEMA).json(path, multiLine=True)
        crate = one.select("crate_name").first()[0]
        functions = one.select(F.posexplode("functions").alias("ord", "f")).select("f.*", F.lit(0).cast("long").alias("file_ord"), F.col("ord").cast("long").alias("ord"))
        exports = one.select(F.posexplode("exports").alias("ord", "e")).select("e.*", F.lit(0).cast("long").alias("file_ord"), F.col("ord").cast("long").alias("ord"))
        return cls(crate, one.select("no_std"), functions, exports, one.select(F.explode("imports").alias("full_path")).distinct())


def _last(functions: DataFrame, key: tuple[str, ...]) -> DataFrame:
    parts = {"path": F.col("location.path")}
    named = functions.withColumn("_key", F.concat_ws(" ", *[parts.get(k, F.col(k)) for k in key]))
    order = Window.partitionBy("_key").orderBy(F.desc("file_ord"), F.desc("ord"))
    return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_key", "sig_hash", "signature")


def _exports(new: DataFrame, old: DataFrame) -> DataFrame:
    by = ["exported_as", "source_path"]
    none = F.lit(None).cast("string")
    added = new.join(old, by, "left_anti").select(F.lit("export").alias("entity"), F.lit("added").alias("change"), F.col("exported_as").alias("key"), none.alias("old"), F.col("source_path").alias("new"))
    removed = old.join(new, by, "left_anti").select(F.lit("export").alias("entity"), F.lit("removed").alias("change"), F.col("exported_as").alias("key"), F.col("source_path").alias("old"), none.alias("new"))
    return added.unionByName(removed)


def _imports(new: DataFrame, old: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    added = new.subtract(old).select(F.lit("import").alias("entity"), F.lit("added").alias("change"), F.col("full_path").alias("key"), none.alias("old"), F.col("full_path").alias("new"))
    removed = old.subtract(new).select(F.lit("import").alias("entity"), F.lit("removed").alias("change"), F.col("full_path").alias("key"), F.col("full_path").alias("old"), none.alias("new"))
    return added.unionByName(removed)
