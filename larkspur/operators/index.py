"""An equality index: a side table of (value, row key), sorted by value, so that a lookup reads a few row groups of it.

The keys that a lookup finds become a filter of the table's scan, which reads the row groups that hold them; where they are more
than ``MOST_KEYS``, the scan by value alone is as good, and the index isn't used. The predicate is checked again; rows that came
after the index was built aren't found, so that a table that changes needs a new version. An index whose table, field, version or layout differ from what is asked for,
or that cannot be read, is not used: the lookup scans and says so in the log.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import application_folder

log = logging.getLogger(__name__)
MOST_KEYS = 1000


@dataclass
class EqualityIndex:
    path: str
    table: str
    field_: str
    keys: list[str] = field(default_factory=list)
    version: str = ""
    layout: str = ""

    def _stamp(self) -> str:
        return json.dumps({"table": self.table, "field": self.field_, "keys": self.keys, "version": self.version, "layout": self.layout})

    @staticmethod
    def build(df: DataFrame, table: str, field_: str, keys: list[str], version: str, layout: str = "", path: str | None = None) -> EqualityIndex:
        """Writes the index; any number, text or date column that is no key. Without a path it lives as long as the application."""
        spark = df.sparkSession
        shared = path or application_folder(spark)
        index = EqualityIndex(f"{shared.rstrip('/')}/index-{table}-{field_}-{uuid.uuid4().hex}", table, field_, list(keys), version, layout)
        rows = df.select(F.col(f"`{field_}`").alias("value"), *keys).where("value IS NOT NULL")
        rows.repartitionByRange("value", *keys).sortWithinPartitions("value").withColumn("stamp", F.lit(index._stamp())).write.parquet(index.path)
        return index

    def _probe(self, df: DataFrame, on_index: Column, on_table: Column) -> DataFrame:
        try:
            rows = df.sparkSession.read.parquet(self.path)
            first = rows.select("stamp").first()
            if first is not None and first.stamp != self._stamp():
                raise ValueError("the index was built for another table, field, version or layout")
            found = rows.where(on_index).select(*self.keys).distinct().limit(MOST_KEYS + 1).collect()
        except Exception as why:  # noqa: BLE001  an index only speeds up: whatever is wrong with it, a scan is right
            log.warning("index %s is not used: %s", self.path, str(why).split("\n")[0])
            return df.where(on_table)
        if len(found) > MOST_KEYS:
            log.info("index %s has more than %d keys: the table is scanned", self.path, MOST_KEYS)
            return df.where(on_table)
        for key in self.keys:
            values = {r[key] for r in found}
            df = df.where(F.col(f"`{key}`").isin(list(values)) if values and None not in values else F.lit(bool(values)))
        return df.where(on_table)

    def find(self, df: DataFrame, value) -> DataFrame:
        return self._probe(df, F.col("value") == F.lit(value), F.col(f"`{self.field_}`") == F.lit(value))

    def find_range(self, df: DataFrame, low, high) -> DataFrame:
        """Values from low to high, both included."""
        return self._probe(df, F.col("value").between(low, high), F.col(f"`{self.field_}`").between(low, high))
