"""Commands over files: ``python -m strobila dump|info|samples|find|edit|fragment|aac2mp4 ...``.

Paths are Spark's, so folders, globs and any store that Spark reads will do; results go to standard output, or below
``--out`` as files of their own.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strobila", description=__doc__)
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *extra: tuple) -> None:
        p = sub.add_parser(name, help=text)
        p.add_argument("path")
        for flags, options in extra:
            p.add_argument(*flags, **options)

    out = (("--out",), {"required": True, "help": "folder for the files that are written"})
    command("dump", "boxes as indented lines or JSON", (("--json",), {"action": "store_true"}), (("--entries",), {"action": "store_true", "help": "table entries too"}))
    command("info", "files, tracks and codecs")
    command("samples", "samples of static tables and fragments")
    command("find", "a box's fields by path", (("box",), {"help": "moov/trak[1]/tkhd"}))
    command("edit", "remove, insert or replace boxes", (("--remove",), {"action": "append", "default": []}), (("--insert",), {"action": "append", "default": [], "metavar": "PARENT:FILE"}), (("--replace",), {"action": "append", "default": [], "metavar": "PATH:FILE"}), out)
    command("fragment", "fragments of static files", (("--seconds",), {"type": float, "default": 2.0}), out)
    command("aac2mp4", "audio streams as files", out)
    return top


def rows(df: DataFrame) -> None:
    """Tab-separated, a partition at a time."""
    print("\t".join(df.columns))
    for r in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def save(files: DataFrame, folder: str, suffix: str) -> None:
    """(file, content) as files of a local folder, one at a time."""
    os.makedirs(folder, exist_ok=True)
    for r in files.toLocalIterator():
        name = os.path.splitext(os.path.basename(r["file"]))[0] + suffix
        with open(os.path.join(folder, name), "wb") as f:
            f.write(bytes(r["content"]))
        print(os.path.join(folder, name))


def edits(args: argparse.Namespace) -> list[tuple]:
    def content(pair: str) -> tuple[str, bytes]:
        path, _, name = pair.rpartition(":")
        with open(name, "rb") as f:
            return path, f.read()

    return [("remove", p) for p in args.remove] + [("insert", *content(p)) for p in args.insert] + [("replace", *content(p)) for p in args.replace]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from strobila.operators import tools
    from strobila.sources import boxes, media, writers

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.master(args.master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    files = spark.read.format("binaryFile").load(args.path).select("path", "content")
    if args.command == "aac2mp4":
        save(tools.mux(*tools.aac_to_samples(files)), args.out, ".mp4")
        return 0
    atoms = boxes.atoms(files, entries=getattr(args, "entries", False))
    if args.command == "dump":
        for r in (boxes.dump_json(atoms) if args.json else boxes.dump_text(atoms)).orderBy("file", "atom_id").toLocalIterator():
            print(r["line"])
    elif args.command == "info":
        rows(boxes.files_of(atoms).withColumn("brands", F.array_join("brands", " ")))
        rows(media.tracks(atoms).join(media.codec_names(atoms).drop("coding"), ["file", "track_id"], "left").orderBy("file", "track_id"))
    elif args.command == "samples":
        columns = ["file", "track_id", "sample_index", "offset", "size", "duration", "dts", "cts_delta", "is_sync"]
        rows(media.static_samples(atoms).select(*columns).unionByName(media.moving_samples(atoms).select(*columns)).orderBy(*columns[:3]))
    elif args.command == "find":
        rows(boxes.find(atoms, args.box).select("file", "path", "size", F.to_json("fields").alias("fields")))
    elif args.command == "edit":
        save(boxes.write_tree(boxes.edit(atoms, edits(args)), files), args.out, ".mp4")
    elif args.command == "fragment":
        scales = media.tracks(atoms).select("file", "track_id", "timescale")
        samples = media.sample_data(media.static_samples(atoms), files).join(scales, ["file", "track_id"])
        cut = samples.withColumn("segment_index", F.floor(F.col("dts") / (F.col("timescale") * args.seconds)).cast("long"))
        parts = writers.write_fragments(cut, 0)
        save(parts.select(F.concat_ws("-", F.regexp_replace("file", r"\.[^.]*$", ""), "track_id", "sequence").alias("file"), "content"), args.out, ".m4s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
