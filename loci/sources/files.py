"""Reading project folders and conversation folders."""

from __future__ import annotations

import json

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators import chunking, classify, saving
from loci.sources import chat
from loci.sources.gitignore import kept_files, parse_rules


_BATCH_BYTES = 8 * 1024 * 1024


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder: (path relative to it, uri); ``load`` adds the bytes.

    Spark's own readers hide names that start with a dot or an underscore, so
    the listing goes through Arrow's file systems, a task per top-level entry.
    """
    uri = root if "://" in root else "file://" + root
    uri = uri.rstrip("/")
    fs, base = pafs.FileSystem.from_uri(uri)
    top = [(i.path, i.type == pafs.FileType.Directory) for i in fs.get_file_info(pafs.FileSelector(base))]

    def walk(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            for path, is_dir in zip(pdf["path"], pdf["is_dir"]):
                infos = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if is_dir else [fs.get_file_info(path)]
                found = [i.path[len(base):].lstrip("/") for i in infos if i.type == pafs.FileType.File]
                yield pd.DataFrame({"path": found, "uri": [f"{uri}/{p}" for p in found]}, dtype=object)

    entries = spark.createDataFrame(top, "path string, is_dir boolean")
    return entries.repartition(max(1, len(top))).mapInPandas(walk, "path string, uri string")


def load(files: DataFrame) -> DataFrame:
    """Add the bytes of listed files (path, uri), read where the task runs."""
    if "content" in files.columns:
        return files

    def read(batches):
        for pdf in batches:
            rows, size = [], 0
            for path, uri in zip(pdf["path"], pdf["uri"]):
                fs, name = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(name) as stream:
                    rows.append((path, uri, stream.read()))
                size += len(rows[-1][2])
                if size > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "uri", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "uri", "content"])

    return files.select("path", "uri").mapInPandas(read, "path string, uri string, content binary")


def as_text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def ignore_files(tree: DataFrame) -> DataFrame:
    own = load(tree.where(tx.basename(F.col("path")) == ".gitignore"))
    base = F.regexp_replace("path", r"/?\.gitignore$", "")
    return own.select(base.alias("base"), as_text(F.col("content")).alias("content"))


def scan_project(tree: DataFrame, respect_gitignore: bool = True, include_ignored=None) -> DataFrame:
    """Readable files of a project, minus skipped and ignored ones."""
    rules = parse_rules(ignore_files(tree)) if respect_gitignore else None
    return kept_files(
        tree, rules, extensions=fixed.READABLE_EXTENSIONS, skip_dirs=(*fixed.PROJECT_SKIP_DIRS, ".loci"),
        skip_names=fixed.PROJECT_SKIP_FILENAMES, include=include_ignored,
    )


def scan_convos(tree: DataFrame) -> DataFrame:
    found = kept_files(tree, None, extensions=fixed.CONVO_EXTENSIONS, skip_dirs=(*fixed.CONVO_SKIP_DIRS, ".loci"))
    return found.where(~F.col("path").endswith(".meta.json"))


def scan_for_detection(tree: DataFrame, max_files: int | None = None) -> DataFrame:
    """Prose files; other readable ones fill up when there are under three.  All of them, or the first ``max_files``."""
    found = kept_files(tree, None, extensions=(*fixed.PROSE_EXTENSIONS, *fixed.DETECT_EXTENSIONS), skip_dirs=(*fixed.DETECT_SKIP_DIRS, ".loci"))
    prose = tx.extension(F.col("path")).isin(list(fixed.PROSE_EXTENSIONS))
    enough = found.agg(F.count_if(prose) >= 3).scalar()
    usable = found.withColumn("_prose", prose).where(F.col("_prose") | ~enough)
    if max_files is not None:
        usable = usable.orderBy(F.desc("_prose"), "path").limit(max_files)
    return usable.drop("_prose")


def unfiled(files: DataFrame, drawers: DataFrame, path: str = "path") -> DataFrame:
    """Files none of whose chunks are stored yet."""
    return files.join(drawers.select(F.col("source_file").alias(path)).distinct(), path, "left_anti")


def mine_project(tree: DataFrame, *, wing: str, rooms: list[dict], palace: str, now: str, version: int = 1, agent: str = "loci",
                 respect_gitignore=True, include_ignored=None, limit: int = 0) -> DataFrame:
    """Drawer log rows of a project: scan, room, chunks, ids, vectors."""
    files = scan_project(tree, respect_gitignore, include_ignored)
    if limit:
        files = files.orderBy("path").limit(limit)
    docs = load(files).select("path", tx.strip(as_text(F.col("content"))).alias("document"))
    docs = docs.where(F.length("document") >= fixed.CHUNK_MIN)
    docs = docs.withColumn("_room", classify.detect_room(F.col("path"), F.col("document"), rooms))
    cut = chunking.chunk_text(docs)
    return saving.file_chunks(cut, wing=F.lit(wing), room=F.col("_room"), palace=F.lit(palace), version=version, now=now, agent=agent)


def mine_convos(tree: DataFrame, *, wing: str, palace: str, now: str, version: int = 1, agent: str = "loci", mode: str = "exchange",
                drawers: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """Drawer log rows of conversation files, by exchange or by memory type."""
    files = scan_convos(tree)
    if drawers is not None:
        files = unfiled(files, drawers)
    if limit:
        files = files.orderBy("path").limit(limit)
    docs = load(files).select("path", as_text(F.col("content")).alias("content"))
    docs = chat.normalize(docs).select("path", F.col("transcript").alias("document"))
    docs = docs.where(F.length(tx.strip(F.col("document"))) >= fixed.EXCHANGE_MIN)
    if mode == "general":
        cut = classify.extract_memories(docs, key="path")
        room = F.col("memory_type")
    else:
        docs = docs.withColumn("_room", classify.convo_room(F.col("document")))
        cut, room = chunking.chunk_exchanges(docs), F.col("_room")
    return saving.file_chunks(
        cut, wing=F.lit(wing), room=room, palace=F.lit(palace), version=version, now=now, agent=agent,
        ingest_mode="convos", extract_mode=mode,
    )


def mining_summary(log: DataFrame) -> DataFrame:
    """Per room: files and drawers (also the dry-run report)."""
    return log.groupBy("room").agg(F.countDistinct("source_file").alias("files"), F.count("*").alias("drawers")).orderBy(F.desc("files"), "room")


def read_room_config(folder: str) -> tuple[str, list[dict]]:
    """Wing and rooms from a project's loci.json (or loci.yaml, where yaml is installed)."""
    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    for name in ("loci.json", "loci.yaml"):
        if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
            continue
        with fs.open_input_stream(f"{base}/{name}") as stream:
            text = stream.read().decode("utf-8")
        if name.endswith("json"):
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
        return data.get("wing"), data.get("rooms") or [{"name": "general", "description": "All project files"}]
    raise FileNotFoundError(f"No loci.json or loci.yaml in {folder}")
