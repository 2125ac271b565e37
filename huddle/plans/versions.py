"""Written tables: of one run, or as versions that readers switch to at once.

A ``Build`` writes the tables of a run under one folder and registers those bucketed by
league in the session's catalog. ``close`` drops the entries, and the files unless
they were committed.

``Versions`` keeps builds under a shared root:

    <root>/claims/<number>            made by the build that has the number, atomically
    <root>/data/<number>/<table>/     the files of its tables
    <root>/manifests/<number>.json    schema and buckets of each table

A manifest is written under another name and renamed, after all tables are whole: a
reader takes the highest one, so it sees the tables of one build, all or none, and a run
that is killed on the way leaves the version before in place. A commit deletes what is older than the last
``keep`` versions, and the folders of lower numbers that never got a manifest (killed runs; a run overtaken by a
later one is given up too). Readers of a version may go on until ``keep`` more are committed.

``Build.replace`` writes a table in parts and, given what changed since a version, only the parts concerned; the
manifest refers to the older version's folders for the others, which stay as long as a kept version needs them.

Names of tables are those of the caller; an empty table is a table; a root without a version
has no current one (``None``), and reading from it raises ``LookupError``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from huddle.files import Folder
from huddle.session import scratch_path

BUCKET_BYTES = 128 << 20
KEEP = 2
PART = "_part"
PARTS = 256             # folders of a table whose parts are replaced one by one


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


def buckets_for(spark: SparkSession, path: str) -> int:
    """Buckets for what is read from ``path``: one for each 128 MB, and at least as many
    as shuffle partitions."""
    return max(shuffle_partitions(spark), -(-Folder(spark, path).size() // BUCKET_BYTES))


def part_of(keys: list[str], buckets: int, parts: int) -> Column:
    """The part of a row: its bucket's number, folded to ``parts`` folders. A bucket lies in one part."""
    return F.pmod(F.pmod(F.hash(*keys), F.lit(buckets)), F.lit(parts)).cast("int")


def _catalog_table(spark: SparkSession, path: str, schema: StructType, buckets: int, keys: list[str],
                   parts: dict[int, str] | None = None) -> str:
    """Registers files as a bucketed table: readers know that rows are hash-partitioned by the keys.

    ``parts``: the folder of each part, of whichever version wrote it."""
    name = f"huddle_{uuid.uuid4().hex[:12]}"
    ddl = lambda s: spark._jvm.org.apache.spark.sql.types.DataType.fromJson(s.json()).toDDL()
    split = "" if parts is None else f"PARTITIONED BY ({PART})"
    columns = ddl(schema) + ("" if parts is None else f", {PART} INT")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {split} CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    if parts:
        spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION ({PART}={p}) LOCATION '{at}'" for p, at in sorted(parts.items())))
    return name


class Build:
    """The tables of one run. Use as a context, or call ``close``."""

    def __init__(self, spark: SparkSession, path: str | None = None, versions: Versions | None = None, number: int = 0):
        self.spark, self.path = spark, path or scratch_path(spark, "run")
        self.versions, self.number = versions, number
        self.tables: dict[str, dict] = {}
        self._rows: dict[str, Observation] = {}
        self._catalog: list[str] = []
        self.notes: dict = {}
        self.committed = False

    def materialize(self, df: DataFrame, name: str, bucket_by: str | list[str] | None = None,
                    buckets: int | None = None, exchange: bool = False) -> DataFrame:
        """Writes ``df`` and returns the table read back, which cuts the lineage.

        Bucketed by league, later windows and aggregates keyed by league (plus more) run
        without a shuffle. An input that is already hash-partitioned by the keys into the same number
        of partitions writes one file per bucket; any other needs ``exchange``, or each
        task writes a file into every bucket.
        """
        keys = [bucket_by] if isinstance(bucket_by, str) else list(bucket_by or [])
        path = f"{self.path}/{name}"
        rows = Observation(f"{name}_rows")   # counted while writing, no extra job
        df = df.observe(rows, F.count(F.lit(1)).alias("rows"))
        self._rows[name] = rows
        n = (buckets or shuffle_partitions(self.spark)) if keys else 0
        if not keys:
            df.write.parquet(path)
            self.tables[name] = {"schema": df.schema.json(), "keys": [], "buckets": 0}
            return self.spark.read.schema(df.schema).parquet(path)
        if exchange:
            df = df.repartition(n, *keys)
        table = f"huddle_{name}_{uuid.uuid4().hex[:12]}"
        df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
        self._catalog.append(table)
        self.tables[name] = {"schema": df.schema.json(), "keys": keys, "buckets": n}
        return self.spark.table(table)

    def replace(self, df: DataFrame, name: str, keys: list[str], buckets: int, changed: DataFrame | None = None,
                old: int | None = None, on: str = "league_id", exchange: bool = True) -> DataFrame:
        """Writes a table in parts, each a folder with a share of the buckets, and returns its rows of ``df``.

        With ``changed`` (the values of ``on`` whose rows ``df`` holds, whole) and the version ``old``, only the
        parts that hold or get such rows are read and written anew: their other rows are taken over from
        ``old``, and the manifest refers to the folders of ``old`` for all other parts. ``exchange``
        as for ``materialize``; rows that are taken over are always moved to their buckets.
        """
        parts = min(buckets, PARTS)
        of = part_of(keys, buckets, parts)
        held: dict[str, int] = {}
        touched = None
        if changed is not None:
            held = dict(self.versions.tables(old)[name]["parts"])
            before = self.versions.read(name, old, with_part=True)
            if keys == [on]:
                gone = changed.select(of.alias(PART))
            else:
                gone = before.join(changed, on, "left_semi").select(PART).unionByName(df.select(of.alias(PART)))
            touched = sorted(r[0] for r in gone.distinct().collect())       # at most PARTS numbers
            rest = before.filter(F.col(PART).isin(touched)).drop(PART).join(changed, on, "left_anti")
            df, exchange = df.unionByName(rest.select(df.columns)), True
        rows = Observation(f"{name}_rows")
        out = (df.repartition(buckets, *keys) if exchange else df).observe(rows, F.count(F.lit(1)).alias("rows")).withColumn(PART, of)
        self._rows[name] = rows
        path = f"{self.path}/{name}"
        written = f"huddle_{name}_{uuid.uuid4().hex[:12]}"
        out.write.format("parquet").partitionBy(PART).bucketBy(buckets, *keys).option("path", path).saveAsTable(written)
        self._catalog.append(written)
        here = {n.split("=")[1]: self.number for n in Folder(self.spark, path).names() if n.startswith(f"{PART}=")}
        for p in touched or []:
            held.pop(str(p), None)                  # a part may have lost its last rows
        self.tables[name] = {"schema": df.schema.json(), "keys": keys, "buckets": buckets, "parts": {**held, **here}}
        whole = self.spark.table(written).drop(PART)
        return whole if changed is None else whole.join(changed, on, "left_semi")

    def row_counts(self) -> dict[str, int]:
        """Rows written to each table (of one replaced in part: those of the parts written)."""
        return {name: o.get["rows"] for name, o in self._rows.items()}

    def commit(self) -> int:
        """Makes the tables the current version, and deletes what no version needs any more."""
        if self.versions is None:
            raise ValueError("a run outside of versions has nothing to commit to")
        counts = self.row_counts()
        tables = {name: {**t, "rows": counts[name]} for name, t in self.tables.items()}
        self.versions.root.put(f"manifests/{self.number:012d}.json", json.dumps({"tables": tables, "notes": self.notes}))
        self.committed = True
        self.versions.prune()
        return self.number

    def close(self) -> None:
        for table in self._catalog:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._catalog = []
        if not self.committed:
            Folder(self.spark, self.path).delete()

    def __enter__(self) -> Build:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class Versions:
    """Versions of a set of tables under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP):
        self.spark, self.root, self.keep = spark, Folder(spark, root), max(1, keep)
        self._catalog: list[str] = []

    def numbers(self) -> list[int]:
        """The committed versions, oldest first."""
        return sorted(int(n[:-5]) for n in self.root.names("manifests") if n.endswith(".json"))

    def current(self) -> int | None:
        return max(self.numbers(), default=None)

    def build(self) -> Build:
        """A new build, with a number of its own above all others."""
        taken = [int(n) for n in self.root.names("claims") if n.isdigit()] + self.numbers()
        number = max(taken, default=0) + 1
        while not self.root.claim(f"claims/{number:012d}"):
            number += 1
        self.root._fs.mkdirs(self.root._at("manifests"))
        return Build(self.spark, f"{self.root.path}/data/{number:012d}", self, number)

    def _manifest(self, number: int | None) -> dict:
        number = self.current() if number is None else number
        if number is None:
            raise LookupError(f"no version under {self.root.path}")
        return json.loads(self.root.get(self.spark, f"manifests/{number:012d}.json"))

    def tables(self, number: int | None = None) -> dict[str, dict]:
        return self._manifest(number)["tables"]

    def notes(self, number: int | None = None) -> dict:
        """What the build of a version noted about itself."""
        return self._manifest(number).get("notes", {})

    def read(self, name: str, number: int | None = None, with_part: bool = False) -> DataFrame:
        """A table of a version (the current one), bucketed as it was written."""
        number = self.current() if number is None else number
        t = self.tables(number)[name]
        path, schema = f"{self.root.path}/data/{number:012d}/{name}", StructType.fromJson(json.loads(t["schema"]))
        if not t["keys"]:
            return self.spark.read.schema(schema).parquet(path)
        parts = t.get("parts")
        if parts is not None:
            parts = {int(p): f"{self.root.path}/data/{n:012d}/{name}/{PART}={p}" for p, n in parts.items()}
        table = _catalog_table(self.spark, path, schema, t["buckets"], t["keys"], parts)
        self._catalog.append(table)
        rows = self.spark.table(table)
        return rows if parts is None or with_part else rows.drop(PART)

    def prune(self) -> None:
        """Deletes versions before the last ``keep``, and what killed runs left.

        Of an older version the parts that a kept one refers to stay."""
        have = self.numbers()
        if not have:
            return
        kept, last = set(have[-self.keep:]), have[-1]
        used: dict[int, set[tuple[str, str]]] = {}
        for n in kept:
            for name, t in self.tables(n).items():
                for p, at in (t.get("parts") or {}).items():
                    used.setdefault(at, set()).add((name, f"{PART}={p}"))
        for kind in ("data", "claims"):
            for n in self.root.names(kind):
                if n.isdigit() and int(n) < last and int(n) not in kept:
                    if kind == "data" and int(n) in used:
                        self._prune_parts(f"data/{n}", used[int(n)])
                    else:
                        self.root.delete(f"{kind}/{n}")
        for n in have:
            if n not in kept:
                self.root.delete(f"manifests/{n:012d}.json")

    def _prune_parts(self, path: str, used: set[tuple[str, str]]) -> None:
        for name in self.root.names(path):
            if name not in {t for t, _ in used}:
                self.root.delete(f"{path}/{name}")
                continue
            for part in self.root.names(f"{path}/{name}"):
                if part.startswith(f"{PART}=") and (name, part) not in used:
                    self.root.delete(f"{path}/{name}/{part}")

    def close(self) -> None:
        """Drops the session's entries of tables that were read; the files stay."""
        for table in self._catalog:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._catalog = []
