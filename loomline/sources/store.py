"""Tables that are changed a little at a time: a base, small files of changes, and one commit for several tables together.

A commit is one file of the log, named by its number. It holds the whole state: for each table the folder of its base and
those of its changes in order, and for each streaming query the last batch applied. So a reader opens the newest file
only, a commit takes effect in all tables or in none, and a batch that comes again is passed over. Changes are merged when
they are read; where they have grown past a share of the base, a table is written anew.

One writer at a time: of two that commit the same number the second fails, and its files are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GONE, _AT = "__gone", "__at"


class Conflict(RuntimeError):
    """Another writer has committed this number."""


@dataclass
class Change:
    """Rows that come or replace those of their key, and keys (a table with the key column) that go. A key in both comes."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


@dataclass
class _State:
    number: int = -1
    tables: dict[str, dict] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Store:
    """Tables by name below ``root``; ``keys`` gives the key column and ``schemas`` the columns of each. Null is a key like others."""

    def __init__(self, spark: SparkSession, root: str, keys: Mapping[str, str], schemas: Mapping[str, str], share: float = 0.2):
        self.spark, self.root, self.keys, self.schemas, self.share = spark, root.rstrip("/"), dict(keys), dict(schemas), share

    # --- the log

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> _State:
        path, fs = self._path("log")
        if not fs.exists(path):
            return _State()
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))
        if not names:
            return _State()
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/log/{names[-1]}").first()[0]
        return _State(**json.loads(text))

    def _commit(self, state: _State) -> None:
        path, fs = self._path(f"log/{state.number:012d}.json")
        own, _ = self._path(f"log/{state.number:012d}-{uuid.uuid4().hex}.tmp")
        out = fs.create(own)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(own, path):  # the file is whole before it has its name
            fs.delete(own, False)
            raise Conflict(f"commit {state.number} is there already")

    # --- reading

    def _merged(self, name: str, table: dict) -> DataFrame:
        key, schema = self.keys[name], self.schemas[name]
        read = lambda *folders, more="": self.spark.read.schema(schema + more).parquet(*[f"{self.root}/{name}/{f}" for f in folders])
        base = read(table["base"]) if table.get("base") else self.spark.createDataFrame([], schema)
        if not table.get("changes"):
            return base
        changes = read(*[c["folder"] for c in table["changes"]], more=f", {_GONE} boolean, {_AT} long")
        columns = base.columns
        last = changes.groupBy(key).agg(F.max_by(F.struct(_GONE, *columns), _AT).alias("r"))
        touched = last.select(F.col(key).alias("__key"))
        kept = base.join(touched, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        return kept.unionByName(last.filter(~F.col(f"r.{_GONE}")).select("r.*").select(*columns))

    def read(self, name: str) -> DataFrame:
        """The table as of the newest commit: its base without the keys that changed, and their last rows."""
        return self._merged(name, self._state().tables.get(name, {}))

    # --- writing

    def apply(self, changes: Mapping[str, Change], query: str | None = None, batch: int | None = None) -> bool:
        """Commit changes of several tables together; False if this batch of this query is there already (batches of a query come in order).

        Of several rows of a key in one change the greatest one stays, by all its columns. What is written are the rows and keys of the change.
        """
        state = self._state()
        if query is not None and state.applied.get(query, -1) >= batch:
            return False
        number = state.number + 1
        tables = {k: {"base": v.get("base"), "rows": v.get("rows", 0), "changes": list(v.get("changes", []))} for k, v in state.tables.items()}
        for name, change in changes.items():
            table = tables.setdefault(name, {"base": None, "rows": 0, "changes": []})
            folder = f"change-{number:012d}-{uuid.uuid4().hex[:8]}"
            rows = self._change(name, change, number)
            rows.write.parquet(f"{self.root}/{name}/{folder}")
            n = self.spark.read.parquet(f"{self.root}/{name}/{folder}").count()  # from the files' footers
            table["changes"].append({"folder": folder, "rows": n})
            if sum(c["rows"] for c in table["changes"]) > self.share * table["rows"]:
                base = f"base-{number:012d}-{uuid.uuid4().hex[:8]}"
                self._merged(name, table).write.parquet(f"{self.root}/{name}/{base}")
                tables[name] = {"base": base, "rows": self.spark.read.parquet(f"{self.root}/{name}/{base}").count(), "changes": []}
        self._commit(_State(number, tables, state.applied | ({query: batch} if query is not None else {})))
        return True

    def _change(self, name: str, change: Change, number: int) -> DataFrame:
        key, schema = self.keys[name], self.schemas[name]
        empty = self.spark.createDataFrame([], schema)
        rows = empty if change.rows is None else change.rows.select(*empty.columns)
        come = rows.groupBy(key).agg(F.max(F.struct(*empty.columns)).alias("r")).select("r.*").withColumn(_GONE, F.lit(False))
        if change.gone is not None:
            gone = change.gone.select(F.col(key).alias("__key")).distinct().join(rows.select(key), F.col("__key").eqNullSafe(F.col(key)), "left_anti")
            others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col("__key").alias(key) for f in empty.schema]
            come = come.unionByName(gone.select(*others, F.lit(True).alias(_GONE)))
        return come.withColumn(_AT, F.lit(number).cast("long"))

    def vacuum(self) -> int:
        """Remove folders and log files that the newest commit doesn't hold; returns their number. Call it when no reader of an older commit is left."""
        state, n = self._state(), 0
        for name in self.schemas:
            path, fs = self._path(name)
            table = state.tables.get(name, {})
            held = {table.get("base"), *(c["folder"] for c in table.get("changes", []))}
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in held:
                    n += fs.delete(s.getPath(), True)
        path, fs = self._path("log")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() != f"{state.number:012d}.json" and not s.getPath().getName().startswith("."):
                n += fs.delete(s.getPath(), True)
        return n
