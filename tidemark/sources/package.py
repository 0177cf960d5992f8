"""Sinks: partitioned tables, bundles with a manifest, and versioned model packages with checksums."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_meters(df: DataFrame, folder: str, key: str = "meter") -> None:
    """A table partitioned by entity, each entity's rows in order of time."""
    df.repartition(key).sortWithinPartitions(key, "ts").write.mode("overwrite").partitionBy(key).parquet(folder)


def write_bundle(tables: dict[str, DataFrame], folder: str, meta: dict) -> None:
    """One table per name and a manifest of schemas and meta.json beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark: SparkSession = next(iter(tables.values())).sparkSession
    manifest = {"meta": meta, "tables": {n: json.loads(df.schema.json()) for n, df in tables.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def without_personal(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the columns that may leave the house, in their order."""
    return df.select(*[c for c in allowed if c in df.columns])


def _digest(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def write_package(root: str, name: str, version: str, files: dict[str, bytes], parameters: dict) -> Path:
    """A version of a package: its files and package.json with their checksums. An existing version is never overwritten."""
    at = Path(root, name, version)
    at.mkdir(parents=True, exist_ok=False)
    for f, content in files.items():
        (at / f).write_bytes(content)
    (at / "package.json").write_text(json.dumps({"name": name, "version": version, "parameters": parameters, "files": {f: _digest(at / f) for f in sorted(files)}}, indent=1, sort_keys=True))
    return at


def read_package(root: str, name: str, version: str | None = None) -> dict:
    """parameters and files of a version (the current one unless named); a file that changed is an error."""
    at = Path(root, name, version or current(root, name))
    info = json.loads((at / "package.json").read_text())
    if bad := [f for f, d in info["files"].items() if not (at / f).exists() or _digest(at / f) != d]:
        raise ValueError(f"files of {at} have changed: {bad}")
    return {**info, "content": {f: (at / f).read_bytes() for f in info["files"]}}


def set_current(root: str, name: str, version: str) -> None:
    if not Path(root, name, version, "package.json").exists():
        raise FileNotFoundError(version)
    Path(root, name, "current").write_text(version)


def current(root: str, name: str) -> str:
    at = Path(root, name, "current")
    return at.read_text() if at.exists() else max(p.parent.name for p in Path(root, name).glob("*/package.json"))


def packages(root: str) -> list[dict]:
    return [{"name": i["name"], "version": i["version"], "files": len(i["files"])} for p in sorted(Path(root).glob("*/*/package.json")) for i in [json.loads(p.read_text())]]
