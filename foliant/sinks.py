"""Writers."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def write_shards(df: DataFrame, path: str, shard_rows: int, overwrite: bool = False) -> None:
    """Parquet files of at most ``shard_rows`` rows; an existing target is an error unless overwritten."""
    if shard_rows <= 0:
        raise ValueError("a shard needs at least one row")
    df.write.option("maxRecordsPerFile", shard_rows).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_named_shards(df: DataFrame, path: str, stem: str, shard_rows: int, clean: bool = False) -> list[str]:
    """Shards named ``<stem>_<i>_of_<total>.parquet``; shards that exist are an error unless they are cleaned."""
    if shard_rows <= 0:
        raise ValueError("a shard needs at least one row")
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    join = spark._jvm.org.apache.hadoop.fs.Path
    old = [x.getPath() for x in files.globStatus(join(place, f"{stem}_*_of_*.parquet")) or ()] if files.exists(place) else []
    if old and not clean:
        raise FileExistsError(f"shards of {stem} exist in {path}")
    parts = join(place, f"_{stem}_parts")
    total = max(1, -(-df.count() // shard_rows))
    df.repartition(total).write.mode("overwrite").parquet(parts.toString())
    for gone in old:
        files.delete(gone, False)
    names = []
    for at, found in enumerate(sorted(x.getPath().getName() for x in files.globStatus(join(parts, "part-*.parquet")))):
        names.append(f"{stem}_{at:02d}_of_{total:02d}.parquet")
        files.rename(join(parts, found), join(place, names[-1]))
    files.delete(parts, True)
    return names


def write_joined(left: DataFrame, right: DataFrame, on: Sequence[str], path: str, how: str = "left") -> None:
    """A join written straight to Parquet."""
    left.join(right, list(on), how).write.mode("errorifexists").parquet(path)


def write_files(df: DataFrame, path: str, files: int, overwrite: bool = False) -> None:
    """Exactly ``files`` Parquet files, where there are as many rows."""
    if files <= 0:
        raise ValueError("at least one file is needed")
    df.repartition(files).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_json(df: DataFrame, path: str, indent: int = 4, most: int = 100_000) -> None:
    """A small result as one indented JSON array; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them as lines")
    _write_text(df.sparkSession, json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=indent, default=str), path)


def yaml_text(value: object, depth: int = 0) -> str:
    """Nested mappings and lists as YAML; texts that could be read as something else are quoted."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "\n".join(f"{pad}{k}:" + (f"\n{yaml_text(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {yaml_text(v)}") for k, v in value.items())
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}-" + (f"\n{yaml_text(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {yaml_text(v)}") for v in value)
    if isinstance(value, str):
        plain = re.fullmatch(r"[A-Za-z_][\w ./-]*", value) and value.lower() not in ("null", "true", "false", "yes", "no", "on", "off") and not value.endswith(" ")
        return value if plain else json.dumps(value, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False, default=str)


def write_yaml(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small result as a YAML list of records."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them as lines")
    _write_text(df.sparkSession, yaml_text([r.asDict(recursive=True) for r in rows]) if rows else "[]", path)


def _write_text(spark, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> dict[str, int]:
    """JSON lines per split and the splits' sizes; the sizes are returned and also written."""
    df.write.partitionBy(split).mode("overwrite").json(f"{path}/data")
    sizes = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = df.sparkSession
    _write_text(spark, json.dumps({"splits": sizes}, ensure_ascii=False, sort_keys=True), f"{path}/dataset_info")
    return sizes


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def node_link(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """A graph as lines of node-link JSON: ``kind`` (node or link) and its object ``item``.

    Lines stay distributed; a small graph becomes one object with ``node_link_object``.
    """
    told = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col(node).alias("id"), *[c for c in nodes.columns if c != node])).alias("item"))
    links = edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col(source).alias("source"), F.col(target).alias("target"), *[c for c in edges.columns if c not in (source, target)])).alias("item"))
    return told.unionByName(links)


def node_link_object(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str, most: int = 100_000) -> dict:
    """A small graph as ``{"nodes": [...], "links": [...]}``."""
    rows = node_link(nodes, edges, node, source, target).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} nodes and links")
    return {name: [json.loads(r["item"]) for r in rows if r["kind"] == kind] for name, kind in (("nodes", "node"), ("links", "link"))}


def document_objects(df: DataFrame, key: str, properties: Sequence[str], vectors: Mapping[str, str] | None = None) -> DataFrame:
    """Objects of a document store: a deterministic id, properties with empty texts as nulls, and named vectors."""
    from foliant.functions.ids import sha_uuid

    kinds = dict(df.dtypes)
    named = [F.struct(*[F.col(c).alias(name) for name, c in vectors.items()]).alias("vectors")] if vectors else []
    return df.select(sha_uuid(F.col(key)).alias("uuid"), F.col(key), *[(F.nullif(F.col(p), F.lit("")) if kinds[p] == "string" else F.col(p)).alias(p) for p in properties], *named)


def chunk_objects(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunk objects with the constants of plain content."""
    from foliant.functions.ids import sha_uuid

    return chunks.withColumns({
        "uuid": sha_uuid(F.col(key), F.col("chunk_id")), "segment_type": F.lit("content"), "confidence_score": F.lit(1.0),
        "cited_references": F.lit(""), "tags": F.lit(""), "parent_segment_id": F.col(key),
    })


def _small(df: DataFrame, most: int) -> list:
    """All rows of a result that is meant to be small; more than ``most`` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them to files")
    return rows


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error."""
    rows = _small(df, most)
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def latex_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a LaTeX table; more than ``most`` rows are an error."""
    marks = {c: f"\\{c}" for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    cell = lambda v: "" if v is None else "".join(marks.get(c, c) for c in str(v))
    line = lambda values: " & ".join(cell(v) for v in values) + r" \\"
    rows = _small(df, most)
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", line(df.columns), r"\midrule", *[line(r) for r in rows], r"\bottomrule", r"\end{tabular}"])
