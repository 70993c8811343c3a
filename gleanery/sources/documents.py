"""JSON documents, API catalogs out of documentation JSON, and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_json(spark: SparkSession, paths: list[str], schema: T.StructType | str, required: bool = True) -> DataFrame:
    """One document a file, of files and of folders' *.json in order of name. A bad
    document fails the read; no document fails it if required."""
    files = [str(q) for p in map(Path, paths) for q in (sorted(p.glob("*.json")) if p.is_dir() else [p])]
    if not files:
        if required:
            raise FileNotFoundError(f"no JSON documents in {paths}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(files)


def type_text(t) -> str:
    """A documentation type as text."""
    if t is None:
        return "()"
    (kind, x), = t.items() if isinstance(t, dict) else ((str(t), None),)
    if kind in ("primitive", "generic"):
        return x
    if kind == "resolved_path":
        args = ((x.get("args") or {}).get("angle_bracketed") or {}).get("args") or []
        inner = [type_text(a["type"]) for a in args if "type" in a]
        name = x.get("name") or x.get("path") or "?"
        return name + (f"<{', '.join(inner)}>" if inner else "")
    if kind == "borrowed_ref":
        return "&" + ("mut " if x.get("is_mutable") or x.get("mutable") else "") + type_text(x["type"])
    if kind == "tuple":
        return f"({', '.join(map(type_text, x))})"
    if kind == "slice":
        return f"[{type_text(x)}]"
    if kind == "array":
        return f"[{type_text(x['type'])}; {x.get('len')}]"
    if kind == "impl_trait":
        return "impl " + " + ".join(b["trait_bound"]["trait"].get("name") or b["trait_bound"]["trait"].get("path") for b in x if "trait_bound" in b)
    if kind == "qualified_path":
        return f"<{type_text(x['self_type'])}>::{x['name']}"
    return kind


def catalog(spark: SparkSession, path: str, package: str, version: str) -> DataFrame:
    """(package, version, path, kind, signature) out of a documentation file: public
    free functions, and the methods of traits; the functions of impls are neither."""
    doc = json.loads(Path(path).read_text())
    index, paths = doc["index"], doc.get("paths", {})
    inside = {str(i) for item in index.values() for i in (item.get("inner", {}).get("impl") or {}).get("items", [])}
    of_trait = {str(i): k for k, item in index.items() for i in (item.get("inner", {}).get("trait") or {}).get("items", [])}

    def signature(f: dict) -> str:
        d = f.get("sig") or f.get("decl") or {}
        return f"({', '.join(type_text(t) for _, t in d.get('inputs', []))}) -> {type_text(d.get('output'))}"

    rows = []
    for k, item in index.items():
        f = item.get("inner", {}).get("function")
        if f is None or k in inside or item.get("crate_id", 0) != 0:
            continue
        owner = paths.get(of_trait.get(k, k), {}).get("path")
        if not owner:
            continue
        full = "::".join(owner) + (f"::{item['name']}" if k in of_trait else "")
        rows.append((package, version, full, "method" if k in of_trait else "function", signature(f)))
    return spark.createDataFrame(sorted(rows), "package string, version string, path string, kind string, signature string")


def reachable(entries: DataFrame, private_modules: DataFrame) -> DataFrame:
    """Entries (path, ...) in no private module (module). A path is looked up by each
    of the modules it lies in, so the joins are on equal keys."""
    parts = F.split("path", "::")
    modules = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("::", F.slice(parts, F.lit(1), i)))
    inside = entries.where(F.size(parts) > 1).select("path", F.explode(modules).alias("module")).join(private_modules.select("module").distinct(), "module", "left_semi")
    return entries.join(inside.select("path").distinct(), "path", "left_anti")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
