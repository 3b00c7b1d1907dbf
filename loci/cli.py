"""Command line: python -m loci <init|mine|search|illuminate|split|repair|status> ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from loci.api import Memory, utc_now
from loci.operators import classify, entities, memory, transcripts
from loci.session import build_session
from loci.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loci", description="Long-term textual memory on Spark.")
    p.add_argument("--path", default=os.environ.get("LOCI_PATH", "loci-memory"), help="folder of the memory")
    p.add_argument("--palace", default=os.environ.get("LOCI_PALACE", "default"))
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="find rooms and entities of a project")
    c.add_argument("dir")
    c = sub.add_parser("mine", help="file a folder of documents or conversations")
    c.add_argument("dir")
    c.add_argument("--mode", choices=("files", "convos"), default="files")
    c.add_argument("--wing")
    c.add_argument("--no-gitignore", action="store_true")
    c.add_argument("--include-ignored", default="")
    c.add_argument("--agent", default="loci")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--extract", choices=("exchange", "general"), default="exchange")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--wing")
    c.add_argument("--room")
    c.add_argument("-n", type=int, default=5)
    for name in ("illuminate", "wake-up"):
        c = sub.add_parser(name)
        c.add_argument("--wing")
        c.add_argument("--context")
    c = sub.add_parser("split", help="cut files with several sessions")
    c.add_argument("dir")
    c.add_argument("--output-dir")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--min-sessions", type=int, default=2)
    sub.add_parser("repair")
    sub.add_parser("status")
    return p


def _wing(folder: str) -> str:
    return os.path.basename(os.path.abspath(folder)).lower().replace("-", "_").replace(" ", "_")


def main(argv=None, spark=None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or build_session("loci")
    if args.command == "init":
        tree = files.read_tree(spark, os.path.abspath(args.dir))
        paths = tree.select(F.lit(_wing(args.dir)).alias("project"), "path")
        dirs = paths.select("project", F.regexp_replace("path", r"/?[^/]*$", "").alias("path")).where("path <> ''")
        # Every ancestor folder counts, not only those that hold files.
        parts = F.split("path", "/")
        dirs = dirs.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
        rooms = [r.asDict() for r in classify.detect_rooms(dirs, paths).drop("project", "source").orderBy("name").collect()]
        found = entities.detect_entities(entities.corpus_text(files.load(files.scan_for_detection(tree, 10))))
        people = [r["name"] for r in entities.best_entities(found).where("type = 'person'").collect()]
        with open(os.path.join(args.dir, "loci.json"), "w", encoding="utf-8") as out:
            json.dump({"wing": _wing(args.dir), "rooms": rooms, "people": people}, out, indent=2, ensure_ascii=False)
        print(f"wing {_wing(args.dir)}: {len(rooms)} rooms, people: {', '.join(people) or '(none)'}")
        return 0
    if args.command == "split":
        tree = files.read_tree(spark, os.path.abspath(args.dir)).where(F.col("path").endswith(".txt"))
        texts = files.load(tree).select("path", files.as_text(F.col("content")).alias("content"))
        sessions = transcripts.split_sessions(texts, min_sessions=args.min_sessions)
        sessions.select("path", "part", "line_count", "file_name").orderBy("path", "part").show(1 << 30, truncate=False)
        if not args.dry_run:
            # One text row per session, in a folder per file name.
            out = args.output_dir or os.path.join(args.dir, "sessions")
            sessions.select("file_name", "content").write.mode("overwrite").partitionBy("file_name").text(out, lineSep="\n")
        return 0

    store = Memory(spark, os.path.abspath(args.path))
    if args.command == "mine":
        tree = files.read_tree(spark, os.path.abspath(args.dir))
        version, now = store.table.next_version(), utc_now()
        if args.mode == "convos":
            log = files.mine_convos(
                tree, wing=args.wing or _wing(args.dir), palace=args.palace, now=now, version=version, agent=args.agent,
                mode=args.extract, drawers=None if args.dry_run else store.drawers(), limit=args.limit,
            )
        else:
            wing, rooms = files.read_room_config(os.path.abspath(args.dir))
            log = files.mine_project(
                tree, wing=args.wing or wing, rooms=rooms, palace=args.palace, now=now, version=version, agent=args.agent,
                respect_gitignore=not args.no_gitignore, include_ignored=[x for x in args.include_ignored.split(",") if x], limit=args.limit,
            )
        files.mining_summary(log).show(1 << 30, truncate=False)
        if not args.dry_run:
            store.table.append(log)
    elif args.command == "search":
        hits, _ = store.search(args.query, args.n, args.wing, args.room, args.palace)
        hits.orderBy("rank").select("rank", "similarity", "wing", "room", "source_file", "text").show(args.n, truncate=200)
    elif args.command in ("illuminate", "wake-up"):
        for row in store.illuminate(args.context, args.wing).collect():
            text = f"{row['l0_identity']}\n\n{row['l1_essential']}"
            print(f"~{len(text) // 4} tokens\n{text}")
    elif args.command == "repair":
        store.repair()
    elif args.command == "status":
        memory.wing_rooms(store.drawers(args.palace)).show(1 << 30, truncate=False)
    return 0
