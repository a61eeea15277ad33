"""Tables that change as a whole: what a commit writes lies in folders of its own, and one small file, swapped last, says which count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import saved
from tessera.operators.retrieve import small


class Conflict(Exception):
    """Another writer was faster, again and again."""


class Pointer:
    """Numbered states of a folder, each a small JSON file that is put in place by a rename that fails if it is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/_states")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.folder.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """A state and its number: the last one, if none is asked for; (0, {}) before the first."""
        held = self.numbers()
        if number is None:
            number = held[-1] if held else 0
        if not number:
            return 0, {}
        if number not in held:
            raise KeyError(f"{self.path} has no state {number}")
        return number, json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/_states/{number:012d}.json").values().first())

    def swap(self, number: int, state: dict) -> bool:
        """Put a state in place as that number; False if there is one already."""
        Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs.mkdirs(self.folder)
        draft = Path(self.folder, f".{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self.context.rename(draft, Path(self.folder, f"{number:012d}.json"), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self.fs.delete(draft, False)
                return False
            raise

    def commit(self, change: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Swap in what `change` makes of the last state, anew if another writer came first; nothing is swapped where it gives None."""
        for _ in range(tries):
            number, state = self.read()
            new = change(json.loads(json.dumps(state)))
            if new is None:
                return number
            if self.swap(number + 1, new):
                return number + 1
        raise Conflict(self.path)

    def forget(self, keep: int, folders: Callable[[dict], set[str]], below: str = "data") -> list[str]:
        """Delete all states but the last `keep`, and the folders that none of these names; no writer may be at work meanwhile."""
        numbers = self.numbers()
        used = set().union(*(folders(self.read(n)[1]) for n in numbers[-keep:])) if numbers else set()
        Path = self.jvm.org.apache.hadoop.fs.Path
        for n in numbers[:-keep]:
            self.fs.delete(Path(self.folder, f"{n:012d}.json"), False)
        data = Path(f"{self.path}/{below}")
        gone = [f.getPath().getName() for f in self.fs.listStatus(data)] if self.fs.exists(data) else []
        gone = sorted(set(gone) - used)
        for name in gone:
            self.fs.delete(Path(data, name), True)
        return gone


class Units:
    """Tables of units of work (a document's chunks, tables, images, jobs ...) that readers see whole or not at all.

    Each commit writes a layer: the rows of some units in some tables, and the
    list of these units. The rows of a unit are those of the last layer that
    lists it, in every table; a layer that lists a unit without rows removes it.
    A reader that holds a state's number keeps seeing that state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)

    def commit(self, parts: dict[str, DataFrame], units: DataFrame, check: Callable[[str, DataFrame], DataFrame] | None = None) -> int:
        """Replace the rows of the units (unit) by those of the parts, which all have a column unit; the new state's number.

        `check` gives, for a table and its rows, the rows that are wrong; if
        there are any, nothing is written at all. Rows of units that are not
        listed are an error, too.
        """
        units = units.select(F.col("unit").cast("string").alias("unit")).distinct()
        for name, rows in parts.items():
            stray = rows.select(F.col("unit").cast("string").alias("unit")).join(units, "unit", "left_anti").limit(1).collect()
            if stray:
                raise ValueError(f"{name}: unit {stray[0]['unit']} is not listed")
            wrong = check(name, rows).limit(3).collect() if check else []
            if wrong:
                raise ValueError(f"{name}: {len(wrong)} or more rows are wrong, as {wrong[0]}")
        layer = uuid.uuid4().hex
        units.write.parquet(f"{self.path}/data/{layer}/_units")
        for name, rows in parts.items():
            rows.withColumn("unit", F.col("unit").cast("string")).write.parquet(f"{self.path}/data/{layer}/{name}")

        def add(state: dict) -> dict:
            layers = state.get("layers", [])
            return {"layers": [*layers, {"id": layer, "order": max((x["order"] for x in layers), default=0) + 1, "tables": sorted(parts)}]}

        return self.pointer.commit(add)

    def _layers(self, state: int | None) -> list[dict]:
        return self.pointer.read(state)[1].get("layers", [])

    def _last(self, layers: list[dict]) -> DataFrame:
        """(unit, order): the last layer of each unit."""
        out = None
        for x in layers:
            rows = self.spark.read.parquet(f"{self.path}/data/{x['id']}/_units").withColumn("order", F.lit(x["order"]))
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy("unit").agg(F.max("order").alias("order"))

    def read(self, name: str, state: int | None = None) -> DataFrame:
        """A table in the last state, or in an earlier one; columns that a layer lacks are null."""
        layers = self._layers(state)
        rows = self._rows(name, layers)
        if rows is None:
            raise KeyError(f"{self.path} has no table {name}")
        if len(layers) == 1:
            return rows.drop("order")
        return rows.join(small(self._last(layers)), ["unit", "order"], "left_semi").drop("order")

    def _rows(self, name: str, layers: list[dict]) -> DataFrame | None:
        out = None
        for x in layers:
            if name in x["tables"]:
                rows = self.spark.read.parquet(f"{self.path}/data/{x['id']}/{name}").withColumn("order", F.lit(x["order"]))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def merge(self) -> int:
        """All layers as one: the same rows, read faster."""
        number, state = self.pointer.read()
        layers = state.get("layers", [])
        if len(layers) < 2:
            return number
        layer, held = uuid.uuid4().hex, {x["id"] for x in layers}
        self._last(layers).select("unit").write.parquet(f"{self.path}/data/{layer}/_units")
        names = sorted({t for x in layers for t in x["tables"]})
        for name in names:
            self.read(name, number).write.parquet(f"{self.path}/data/{layer}/{name}")
        merged = {"id": layer, "order": max(x["order"] for x in layers), "tables": names}

        def put(state: dict) -> dict | None:
            now = state["layers"]
            # layers that came meanwhile stay; if another merge was faster, this one is of no use
            return {"layers": [merged, *(x for x in now if x["id"] not in held)]} if held <= {x["id"] for x in now} else None

        return self.pointer.commit(put)

    def forget(self, keep: int = 1) -> list[str]:
        return self.pointer.forget(keep, lambda state: {x["id"] for x in state.get("layers", [])})


def wrong_dimension(dimension: int) -> Callable[[str, DataFrame], DataFrame]:
    """A check for commit: in tables with a column vector, the rows whose vector has another length or is null."""

    def check(name: str, rows: DataFrame) -> DataFrame:
        if "vector" not in rows.columns:
            return rows.limit(0)
        return rows.filter(F.coalesce(F.size("vector") != dimension, F.lit(True)))

    return check


def replace_documents(store: Units, docs: DataFrame) -> int:
    """Take in documents (document_id, text), new ones and new texts of old ones, as one commit.

    Each gets a document row with its checksum, its versions so far and a next
    one, and a queued job; all of that, or nothing, is seen by readers. Documents
    whose text is that of their last version are left as they are. Of several
    texts of a document the last in order counts; null ids are an error.
    """
    if docs.filter("document_id IS NULL").limit(1).count():
        raise ValueError("a document has no id")
    new = docs.groupBy("document_id").agg(F.max("text").alias("text")).select(F.col("document_id").cast("string").alias("unit"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    _, state = store.pointer.read()
    if state:
        old = store.read("documents").select("unit", "checksum")
        new = new.join(old, ["unit", "checksum"], "left_anti")
        versions = store.read("versions").join(new.select("unit"), "unit", "left_semi")
    else:
        versions = new.sparkSession.createDataFrame([], "unit string, version int, checksum string")
    new = saved(new)
    number = new.select("unit", "checksum").join(versions.groupBy("unit").agg(F.max("version").alias("last")), "unit", "left").select("unit", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "checksum")
    parts = {
        "documents": new,
        "versions": saved(versions.select("unit", "version", "checksum").unionByName(number)),
        "jobs": number.select("unit", "version", F.lit("queued").alias("status")),
    }
    return store.commit(parts, new.select("unit"))
