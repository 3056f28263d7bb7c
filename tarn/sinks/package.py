"""Packages: tables as files with a hashed manifest, written beside their place and moved there, verified, loaded, hydrated.

Spark writes and hashes the files, of any size; the driver handles the manifest, which has a row for each file: MOST_FILES
at most. A package takes its place by one rename, which is atomic where the file system's is. Where it isn't, as on object
stores, a package is written as one generation of many (``write_generation``): a folder of its own that never changes, and
a numbered pointer to it, written last and only if nobody else has written that number. Readers pin a generation.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.numbers import canonical_integer, canonical_logical
from tarn.sinks.text import redacted_view, write_csv
from tarn.sources.delimited import read_strict
from tarn.sources.files import digests
from tarn.storage import stored

MANIFEST = "manifest.json"
#: Files of a package at most (fixed value): its manifest is one document.
MOST_FILES = 10_000
FORMS = ("parquet", "csv")
#: How Parquet is written: nothing in a file depends on how values repeat or how a writer compresses them, and a file of up to 256 MiB is one row group.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(256 << 20), "parquet.writer.version": "v1"}


class Place:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.full = self._fs.makeQualified(self._path).toString()

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def remove(self) -> None:
        self._fs.delete(self._path, True)

    def move_to(self, other: Place) -> None:
        if not self._fs.rename(self._path, other._path):
            raise OSError(f"{self.path} can't become {other.path}")

    def copy_from(self, source: str, name: str) -> None:
        """One file of any file system, under another name."""
        own = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        origin = own.Path(source)
        own.FileUtil.copy(origin.getFileSystem(conf), origin, self._fs, own.Path(self._path, name), False, conf)

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self._path, name), True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def create_text(self, name: str, text: str) -> bool:
        """Writes a file unless it is there already; whether it was written. Of several writers one succeeds.

        Local files get their name once they are whole; elsewhere the file system's own create-if-absent decides, and a
        reader may meet the file before it is whole.
        """
        if self._fs.getScheme() == "file":
            folder = unquote(self._path.toUri().getPath())
            os.makedirs(folder, exist_ok=True)
            with tempfile.NamedTemporaryFile("w", dir=folder, prefix=".", delete_on_close=False) as file:
                file.write(text)
                file.close()
                try:
                    os.link(file.name, f"{folder}/{name}")
                except FileExistsError:
                    return False
            return True
        try:
            out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self._path, name), False)
            out.write(bytearray(text, "utf-8"))
            out.close()
        except Py4JJavaError:
            if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path, name)):
                return False
            raise
        return True

    def names(self) -> list[str]:
        """What stands in the folder, by name; nothing if it isn't there."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path)) if self.exists() else []

    def read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()["value"]


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path (relative to the package), bytes and sha256 of every data file below it."""
    name = F.substring(F.col("path"), len(Place(spark, path).full) + 2, 1 << 20)
    return digests(spark, path).select(name.alias("path"), "bytes", "sha256").where((F.col("path") != MANIFEST) & ~F.col("path").rlike(r"(^|/)[._]"))


def write_package(spark: SparkSession, path: str, tables: dict[str, DataFrame], metadata: dict | None = None, replace: bool = False, form: str = "parquet", optional: Sequence[str] = ()) -> None:
    """Writes tables and their manifest; nothing is seen at ``path`` before all is there.

    ``form`` is parquet (microsecond times, without compression or dictionaries: equal rows in equal order give equal bytes) or csv (canonical texts). Files of ``optional`` tables may
    be taken away later without the package becoming invalid. An existing package is an error, or is replaced: it is moved aside first and put back if the new one can't take its place.
    """
    if form not in FORMS or (unknown := set(optional) - set(tables)):
        raise ValueError(f"form is one of {FORMS}, and optional names tables" if form not in FORMS else f"no tables {sorted(unknown)}")
    place = Place(spark, path)
    if place.exists() and not replace:
        raise FileExistsError(path)
    staged = Place(spark, f"{place.path}.staged-{uuid.uuid4().hex}")
    try:
        for name, df in tables.items():
            if form == "csv":
                write_csv(df, f"{staged.path}/{name}")
            else:
                df.write.options(**PLAIN).parquet(f"{staged.path}/{name}")
        files = [r.asDict() for r in inventory(spark, staged.path).orderBy("path").limit(MOST_FILES + 1).collect()]
        if len(files) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files: write fewer, larger ones")
        manifest = {"version": 1, "form": form, "metadata": metadata or {}, "optional": sorted(optional), "tables": {n: json.loads(df.schema.json()) for n, df in tables.items()}, "files": files}
        staged.write_text(MANIFEST, json.dumps(manifest, sort_keys=True, indent=1))
        if verify_package(spark, staged.path).where("status <> 'verified'").count():
            raise OSError("what was written isn't what was meant")
    except BaseException:
        staged.remove()
        raise
    aside = Place(spark, f"{place.path}.aside-{uuid.uuid4().hex}")
    had = place.exists()
    if had:
        place.move_to(aside)
    try:
        staged.move_to(place)
    except BaseException:
        if had:
            aside.move_to(place)
        raise
    if had:
        aside.remove()


POINTERS = "pointers"


def generations(spark: SparkSession, path: str) -> dict[int, str]:
    """The generations of a package, number to folder. A pointer that is still being written isn't one yet."""
    place, found = Place(spark, f"{path}/{POINTERS}"), {}
    for name in place.names():
        if name.isdigit():
            text = place.read_text(name)
            if text and text.endswith("\n"):
                found[int(name)] = f"{path}/{text.strip()}"
    return found


def write_generation(spark: SparkSession, path: str, tables: dict[str, DataFrame], metadata: dict | None = None, form: str = "parquet", optional: Sequence[str] = (), after: int | None = None) -> int:
    """Writes tables as the next generation of the package at ``path``; returns its number.

    The files get a folder of their own. The pointer with the number after ``after`` (the latest, if none is given) comes
    last and is written only if it isn't there: of two writers that start from one generation one succeeds, and the other
    gets FileExistsError and leaves nothing behind. What readers have pinned stays as it is.
    """
    latest = max(generations(spark, path), default=0) if after is None else after
    own = f"generation-{uuid.uuid4().hex}"
    write_package(spark, f"{path}/{own}", tables, metadata, form=form, optional=optional)
    if not Place(spark, f"{path}/{POINTERS}").create_text(f"{latest + 1:08d}", own + "\n"):
        Place(spark, f"{path}/{own}").remove()
        raise FileExistsError(f"generation {latest + 1} of {path} is another writer's")
    return latest + 1


def pinned(spark: SparkSession, path: str, generation: int | None = None) -> str:
    """The folder of a generation, the latest by default: every function that takes a package's path takes it."""
    known = generations(spark, path)
    if not known or generation is not None and generation not in known:
        raise FileNotFoundError(f"no generation {'' if generation is None else generation} of {path}")
    return known[max(known) if generation is None else generation]


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes the files of all but the latest ``keep`` generations, whose numbers it returns; pointers stay, so numbers aren't used again."""
    if keep < 1:
        raise ValueError("the latest generation stays")
    old = sorted(generations(spark, path).items())[:-keep]
    gone = [(n, Place(spark, folder)) for n, folder in old]
    removed = [n for n, place in gone if place.exists()]
    for _, place in gone:
        place.remove()
    return removed


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(Place(spark, path).read_text(MANIFEST))


def verify_package(spark: SparkSession, path: str) -> DataFrame:
    """Every file that is listed or there: path and status (verified, altered, missing, absent_optional, unlisted)."""
    schema = "path string, listed_bytes long, listed_sha256 string"
    manifest = manifest_of(spark, path)
    listed = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in manifest["files"]], schema)
    both = listed.join(inventory(spark, path), "path", "full")
    same = (F.col("listed_sha256") == F.col("sha256")) & (F.col("listed_bytes") == F.col("bytes"))
    optional = F.split_part("path", F.lit("/"), F.lit(1)).isin(*manifest.get("optional", []))
    gone = F.when(optional, F.lit("absent_optional")).otherwise(F.lit("missing"))
    return both.select("path", F.when(F.col("listed_sha256").isNull(), F.lit("unlisted")).when(F.col("sha256").isNull(), gone).when(same, F.lit("verified")).otherwise(F.lit("altered")).alias("status"))


def verification(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, verified, absent_optional, broken, and the package's status: verified, verified_with_optional_absences or failed."""
    found = verify_package(spark, path)
    counted = found.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "absent_optional").alias("absent_optional"))
    broken = F.col("files") - F.col("verified") - F.col("absent_optional")
    status = F.when(broken > 0, F.lit("failed")).when(F.col("absent_optional") > 0, F.lit("verified_with_optional_absences")).otherwise(F.lit("verified"))
    return counted.select("*", broken.alias("broken"), status.alias("status"))


def load_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The verified tables of a package, under the schemas of its manifest. Of an optional table without files nothing is returned."""
    found = verify_package(spark, path)
    if bad := found.where("status NOT IN ('verified', 'absent_optional')").orderBy("path").limit(5).collect():
        raise ValueError(f"not verified: {[tuple(r) for r in bad]}")
    absent = {r["t"] for r in found.where("status = 'absent_optional'").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("t")).distinct().collect()}  # optional tables at most
    manifest = manifest_of(spark, path)
    out = {}
    for name, fields in manifest["tables"].items():
        schema = T.StructType.fromJson(fields)
        if name in absent:
            continue
        if manifest.get("form") == "csv":
            texts, problems = read_strict(spark, f"{path}/{name}")
            if bad := problems.limit(5).collect():
                raise ValueError(f"no canonical records: {[tuple(r) for r in bad]}")
            out[name] = hydrated(texts, schema)
        else:
            out[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
    return out


#: The tables of a catalog (fixed values).
CATALOG = ("sites", "datasets", "problems", "requests")


def write_snapshot(spark: SparkSession, path: str, catalog: dict[str, DataFrame], replace: bool = False) -> None:
    """A catalog as canonical CSV texts: datasets are required, the other tables of a catalog may be left out."""
    if "datasets" not in catalog or (unknown := set(catalog) - set(CATALOG)):
        raise ValueError("a snapshot has datasets" if "datasets" not in catalog else f"no tables of a catalog: {sorted(unknown)}")
    write_package(spark, path, catalog, {"kind": "catalog_snapshot"}, replace, form="csv")


def catalog_view(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalog's tables of a package or snapshot."""
    return {n: df for n, df in load_package(spark, path).items() if n in CATALOG}


def exported_requests(spark: SparkSession, path: str) -> DataFrame:
    """The requests that a package records, in order of their ids, without users, queries and fragments of their URLs."""
    tables = load_package(spark, path)
    if "requests" not in tables:
        raise ValueError("the package records no requests")
    return redacted_view(tables["requests"]).orderBy("request_id")


def replayed(spark: SparkSession, path: str, **hashes: str) -> dict[str, DataFrame]:
    """The tables of a package for offline use, if it was made from what ``hashes`` name; its files are verified before and again after they are read."""
    if not lineage_matches(spark, path, **hashes):
        raise ValueError("the package was made from something else")
    tables = {n: stored(df, "replayed") for n, df in load_package(spark, path).items()}
    if verification(spark, path).first()["status"] == "failed":
        raise ValueError("the package changed while it was read")
    return tables


def hydrated(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """All-text columns to the types of ``schema``: empty is null, and a text that isn't its value's canonical form is null too."""
    out = []
    for f in schema:
        text = F.nullif(F.col(f.name), F.lit(""))
        match f.dataType:
            case T.IntegerType():
                value = canonical_integer(text)
            case T.BooleanType():
                value = canonical_logical(text)
            case T.TimestampType():
                value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"), F.try_to_timestamp(text))
            case T.StringType():
                value = text
            case kind:
                value = text.try_cast(kind)
        out.append(value.alias(f.name))
    return rows.select(*out)


def lineage_matches(spark: SparkSession, path: str, **hashes: str) -> bool:
    """Whether a package's metadata names these hashes of what it was made from."""
    known = manifest_of(spark, path)["metadata"]
    return all(known.get(k) == v for k, v in hashes.items())


def frictionless(spark: SparkSession, path: str) -> str:
    """A data package descriptor of a package's tables."""
    kinds = {"string": "string", "integer": "integer", "long": "integer", "double": "number", "boolean": "boolean", "timestamp": "datetime", "date": "date"}
    manifest = manifest_of(spark, path)
    resources = []
    for name, schema in sorted(manifest["tables"].items()):
        fields = [{"name": f["name"], "type": kinds.get(f["type"] if isinstance(f["type"], str) else "", "any")} for f in schema["fields"]]
        own = [f for f in manifest["files"] if f["path"].startswith(f"{name}/")]
        resources.append({"name": name, "path": [f["path"] for f in own], "format": manifest.get("form", "parquet"), "bytes": sum(f["bytes"] for f in own), "schema": {"fields": fields}})
    return json.dumps({"profile": "data-package", "resources": resources}, sort_keys=True)
