"""Publishing a corpus: staged Parquet tables, a manifest, atomic install with rollback, bundles."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FORMAT_VERSION = 1


def build(tables: dict[str, DataFrame], target: str, version: str, revision: int = 1) -> dict:
    """Writes the tables beside ``target``, checks that they load, then swaps the folders; the old one comes back on failure."""
    staging, old = f"{target}.staging", f"{target}.old"
    for p in (staging, old):
        shutil.rmtree(p, ignore_errors=True)
    os.makedirs(staging)
    rows = {}
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}", compression="zstd")
        rows[name] = df.sparkSession.read.parquet(f"{staging}/{name}").count()
    manifest = {"format_version": FORMAT_VERSION, "version": version, "revision": revision, "rows": rows}
    write_atomic(f"{staging}/manifest.json", json.dumps(manifest, sort_keys=True))
    moved = os.path.exists(target)
    if moved:
        os.replace(target, old)
    try:
        os.replace(staging, target)
    except OSError:
        if moved:
            os.replace(old, target)
        raise
    shutil.rmtree(old, ignore_errors=True)
    return manifest


def write_atomic(path: str, text: str) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = json.loads(Path(path, "manifest.json").read_text())
    if manifest["format_version"] != FORMAT_VERSION:
        raise ValueError("the corpus has another format; build it again")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["rows"]}


def pack(path: str, bundle: str) -> dict:
    """tar.zst of a corpus, and its size and SHA-256."""
    import zstandard

    with open(bundle, "wb") as raw, zstandard.ZstdCompressor(level=10).stream_writer(raw) as z, tarfile.open(fileobj=z, mode="w|") as tar:
        tar.add(path, arcname=".")
    return {"asset": os.path.basename(bundle), "size": os.path.getsize(bundle), "sha256": hashlib.sha256(Path(bundle).read_bytes()).hexdigest()}


def unpack(bundle: str, target: str, expected: dict | None = None) -> None:
    """Refuses a bundle of another size or hash, and absolute or climbing paths."""
    import zstandard

    if expected and (os.path.getsize(bundle) != expected["size"] or hashlib.sha256(Path(bundle).read_bytes()).hexdigest() != expected["sha256"]):
        raise ValueError("the bundle isn't the one that its manifest describes")
    with open(bundle, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as z, tarfile.open(fileobj=z, mode="r|") as tar:
        for member in tar:
            if member.name.startswith("/") or ".." in Path(member.name).parts:
                raise ValueError(f"unsafe path in bundle: {member.name}")
            tar.extract(member, target, filter="data")


def dependency_features(manifest: str, package: str, workspace: str | None = None) -> tuple[list[str], bool] | None:
    """Features and default-features of a dependency in TOML, through aliases, targets and workspace inheritance."""
    doc = tomllib.loads(manifest)
    groups = [doc.get(k, {}) for k in ("dependencies", "dev-dependencies", "build-dependencies")]
    groups += [t.get("dependencies", {}) for t in doc.get("target", {}).values()]
    for group in groups:
        for name, spec in group.items():
            spec = {"version": spec} if isinstance(spec, str) else spec
            if spec.get("package", name) != package:
                continue
            base: dict = {}
            if spec.get("workspace") and workspace:
                base = tomllib.loads(workspace).get("workspace", {}).get("dependencies", {}).get(name, {})
                base = {"version": base} if isinstance(base, str) else base
            features = list(dict.fromkeys([*base.get("features", []), *spec.get("features", [])]))
            return features, spec.get("default-features", base.get("default-features", True))
    return None


def locked_versions(lock: str, package: str) -> list[str]:
    return sorted({p["version"] for p in tomllib.loads(lock).get("package", []) if p.get("name") == package})
