"""Command line: describe the media files below some paths."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mediafold.functions.text import path_order
from mediafold.operators.endpoint import MODALITIES, PREFIX, Overrides, number, resolve
from mediafold.operators.merge import first_error
from mediafold.operators.ordered import FRAMES, laid_out, write_document
from mediafold.operators.render import document, document_blocks, json_records, markdown_blocks, text_blocks
from mediafold.operators.taggers import TOWERS, Tagger, TaggerUnavailable, cache_dir, load_tagger
from mediafold.operators.vocabulary import parse_labels
from mediafold.plans.describe import ASK, Settings, describe
from mediafold.shipping import ship
from mediafold.sources.listing import InputError, walk
from mediafold.sources.media import MIN_SECONDS
from mediafold.sources.sidecars import SUFFIX, write_sidecars

OK, ROW_ERRORS, NO_ENDPOINT, USAGE, NO_TAGGER = 0, 2, 3, 4, 5


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mediafold", description=__doc__)
    p.add_argument("paths", nargs="*")
    form = p.add_mutually_exclusive_group()
    form.add_argument("-f", "--format", choices=("json", "markdown", "text"))
    for name, value in (("--json", "json"), ("--md", "markdown"), ("--text", "text")):
        form.add_argument(name, dest="format", action="store_const", const=value)
    p.add_argument("--no-llm", action="store_true", help="no endpoint is asked")
    p.add_argument("--no-vision", action="store_true", help="images and frames aren't sent")
    p.add_argument("--audio", action="store_true", help="sounds are sent, as MP3")
    p.add_argument("--clip", action="store_true", help="images and videos are tagged by a local model")
    p.add_argument("--clap", action="store_true", help="sounds are tagged by a local model")
    p.add_argument("--labels", help="comma-separated labels for the taggers")
    p.add_argument("--labels-file", help="the same, a label a line; # begins a comment")
    p.add_argument("--ask", help="the prompt")
    p.add_argument("--ask-file", help="a file with the prompt; goes before --ask")
    p.add_argument("--frames", type=int, default=4, help="frames of a video that are sent")
    p.add_argument("-c", "--concurrency", type=int, help="how many tasks share the files")
    p.add_argument("--sidecar", action="store_true", help=f"also write a file{SUFFIX} beside each file")
    p.add_argument("-o", "--output", help="a file for the document, written by the tasks; nothing is printed")
    p.add_argument("--strict", action="store_true", help="exit with 2 if a file has an error")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-u", "--url")
    p.add_argument("-m", "--model")
    for m in MODALITIES:
        p.add_argument(f"--{m}-url")
        p.add_argument(f"--{m}-model")
    p.add_argument("--doctor", action="store_true", help="say what is installed and set")
    return p


def overrides(args: argparse.Namespace) -> Overrides:
    of = lambda what: {m: v for m in MODALITIES if (v := getattr(args, f"{m}_{what}"))}
    return Overrides(args.url, args.model, of("url"), of("model"))


def doctor(flags: Overrides) -> str:
    lines = [f"{x}: {'found' if shutil.which(x) else 'missing'}" for x in ("ffmpeg", "ffprobe", "exiftool")]
    for m in MODALITIES:
        ep = resolve(m, flags)
        lines.append(f"{m} endpoint: {f'{ep.url}, {ep.model}, key {'set' if ep.key else 'none'}' if ep else 'none'}")
    for kind, tower in TOWERS.items():
        model = cache_dir() / tower.model_file
        lines.append(f"{kind} tagger: {model if model.exists() else f'missing ({model})'}")
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, load: Callable[[str, list[str] | None], Tagger] = load_tagger) -> int:
    args = parser().parse_args(argv)
    say = (lambda _: None) if args.quiet else (lambda text: print(text, file=sys.stderr))
    flags = overrides(args)
    if args.doctor:
        print(doctor(flags))
        return OK
    try:
        labels = parse_labels(args.labels, Path(args.labels_file).read_text() if args.labels_file else None)
        if labels and not (args.clip or args.clap):
            raise ValueError("labels are for --clip and --clap")
        paths = walk(args.paths)
        ask = Path(args.ask_file).read_text() if args.ask_file else args.ask or ASK
    except (ValueError, OSError, InputError) as e:
        say(str(e))
        return USAGE
    if not paths:
        say("no files")
        return USAGE
    endpoints = {} if args.no_llm else {m: ep for m in MODALITIES if (ep := resolve(m, flags))}
    if not args.no_llm and not endpoints:
        say("no endpoint: give --url and --model, or --no-llm")
        return NO_ENDPOINT
    try:
        taggers = [load(kind, labels) if wanted else None for kind, wanted in (("image", args.clip), ("audio", args.clap))]
    except TaggerUnavailable as e:
        say(str(e))
        return NO_TAGGER
    spark = spark or SparkSession.builder.appName("mediafold").getOrCreate()
    ship(spark)
    settings = Settings(
        *taggers, endpoints, ask, vision=not args.no_vision, audio=args.audio, frames=args.frames,
        min_seconds=number(os.environ, f"{PREFIX}_MIN_SECONDS", MIN_SECONDS), tasks=args.concurrency and min(max(args.concurrency, 1), len(paths)),
    )
    rows = describe(spark, paths, settings).persist()
    if not args.quiet:
        known = {r["path"] for r in rows.select("path").toLocalIterator()}
        for path in paths:
            if path not in known:
                say(f"skipped: {path}")
    if args.sidecar:
        say(f"{write_sidecars(rows)} sidecars")
    form = args.format or ("text" if sys.stdout.isatty() else "json")
    single = len(paths) == 1
    if args.output and not (single and form == "json"):
        write_document(laid_out(document_blocks(rows, form), [path_order(F.col("path"))], "block", FRAMES[form]), args.output, FRAMES[form])
    else:
        blocks = {"json": json_records, "markdown": markdown_blocks, "text": text_blocks}[form](rows)
        whole = document(blocks, form, single)
        if args.output:
            Path(args.output).write_text(whole)
        else:
            try:
                print(whole, flush=True)
            except BrokenPipeError:
                os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
                return OK
    if args.strict and (bad := first_error(rows).collect()):
        say(f"{bad[0]['path']}: {bad[0]['error']}")
        return ROW_ERRORS
    return OK


if __name__ == "__main__":
    sys.exit(main())
