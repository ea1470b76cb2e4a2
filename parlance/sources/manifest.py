"""Which stage tables of a run folder are whole, and what each was made from.

The manifest is an append-only table of records in the folder. A table gets a
``started`` record before it is overwritten and a ``committed`` one afterwards,
with its version, the run, the number of rows, and as parent the version of the
table it was made from. A table counts as current while its last record is a
commit and each of its ancestors, up to the root table, is the last commit of
its own name; so nothing is read that was made from data replaced since, or that
a lost driver left half written. One job at a time writes to a folder.

The records are a few per stage and run, each a small JSON file that the driver
writes through Spark's file system; it reads them all. One that a lost driver
left unreadable counts as not written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parlance.sources.tables import exists, save_counted

RECORD = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("parent", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("rows", T.LongType()),
])
STARTED, COMMITTED = "started", "committed"


@dataclass(frozen=True)
class Record:
    seq: int
    name: str
    version: str
    parent: str | None
    run_id: str
    state: str
    rows: int | None


class Manifest:
    """Records of the stage tables below ``folder``; ``root`` is the table at which lineage ends."""

    def __init__(self, spark: SparkSession, folder: str, root: str):
        self.spark, self.folder, self.root = spark, folder, root
        self.path = f"{folder}/manifest"

    def table(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(self.path)

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def records(self) -> list[Record]:
        jvm, path, files = self._files()
        out = []
        for status in files.listStatus(path) if files.exists(path) else []:
            stream = files.open(status.getPath())
            try:
                out.append(Record(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            except ValueError:
                continue
            finally:
                stream.close()
        return sorted(out, key=lambda r: r.seq)

    def _append(self, name: str, version: str, parent: str | None, run_id: str, state: str, rows: int | None) -> None:
        seq = max((r.seq for r in self.records()), default=0) + 1
        record = Record(seq, name, version, parent, run_id, state, rows)
        jvm, _, files = self._files()
        # A second writer of the same number fails here instead of losing a record.
        stream = files.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{seq:010d}.json"), False)
        stream.write(bytearray(json.dumps(asdict(record)).encode()))
        stream.close()

    def save(self, name: str, df: DataFrame, run_id: str, parent: str | None) -> tuple[DataFrame, int, str]:
        """Overwrite a table and commit it: the table, its rows and its version."""
        version = uuid.uuid4().hex
        self._append(name, version, parent, run_id, STARTED, None)
        table, rows = save_counted(df, f"{self.folder}/{name}")
        self._append(name, version, parent, run_id, COMMITTED, rows)
        return table, rows, version

    def current(self, names: list[str]) -> Record | None:
        """The newest table among ``names`` whose whole lineage is current."""
        records = self.records()
        last = {r.name: r for r in records}
        made = {r.version: r for r in records if r.state == COMMITTED}

        def whole(record: Record) -> bool:
            if record.state != COMMITTED or last[record.name] is not record:
                return False
            if record.name == self.root or record.parent is None:
                return record.name == self.root
            return record.parent in made and whole(made[record.parent])

        found = [last[n] for n in names if n in last and whole(last[n])]
        return max(found, key=lambda r: r.seq, default=None)
