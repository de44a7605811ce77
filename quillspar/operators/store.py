"""Versioned tables: each publication is a new folder, and one small file names the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables below a folder that all executors share. A version is written whole before the manifest names it, so readers see the old or the
    new one, and a run that breaks off leaves the old one in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict[str, str]:
        rows = self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).first() if self._fs.exists(self._path(f"{self.root}/manifest.json")) else None
        return json.loads(rows.value) if rows else {}

    def read(self, table: str) -> DataFrame:
        """The current version of a table."""
        return self.spark.read.option("mergeSchema", True).parquet(self._manifest()[table])

    def exists(self, table: str) -> bool:
        return table in self._manifest()

    def publish(self, **tables: DataFrame) -> None:
        """Write new versions of the tables and show them all at once."""
        new = {}
        for name, df in tables.items():
            new[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(new[name])
        manifest = json.dumps(self._manifest() | new)
        draft = self._path(f"{self.root}/_draft.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(manifest.encode()))
        out.close()
        target = self._path(f"{self.root}/manifest.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(draft), context.makeQualified(target), options)

    def staged(self, df: DataFrame) -> DataFrame:
        """The same rows from a table that no manifest names: what a run makes once and reads again. ``sweep`` removes such tables."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Remove staged tables and versions that the manifest doesn't name, when no run is on."""
        named = set(self._manifest().values())
        self._fs.delete(self._path(f"{self.root}/_staged"), True)
        for table in {v.rsplit("/", 1)[0] for v in named}:
            for found in self._fs.listStatus(self._path(table)):
                if not any(str(found.getPath()).endswith(v.removeprefix("file://")) for v in named):
                    self._fs.delete(found.getPath(), True)

    def delete(self, keys: DataFrame, key: str, *tables: str) -> None:
        """Remove the rows of these keys from all the tables at once."""
        self.publish(**{t: self.read(t).join(keys.select(key), key, "left_anti") for t in tables})
