"""Command line: count, pretokenize, raw-count, tokenize, encode, decode."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable, Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .api import Splitter
from .functions.codepoints import escape
from .operators.codecs import Codec, han_cutter
from .operators.counting import raw_count
from .operators.learners import train
from .session import session, ship
from .sources.model import METHODS, Model, NormalizerSpec
from .sources.text import first_sentences, read_dictionary, read_lines, read_ordered_lines, write_counts_file

log = logging.getLogger("sparkloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("count", help="learn a vocabulary")
    c.add_argument("--method", choices=METHODS, default="bytepiece")
    c.add_argument("--input", action="append", required=True)
    c.add_argument("--model", default="vocabulary", help="prefix of the model file")
    c.add_argument("--vocab-size", type=int, default=8000)
    c.add_argument("--normalize", default="no")
    c.add_argument("--cpu", type=int, default=4)
    c.add_argument("--max-sentences", type=int, default=0)
    c.add_argument("--min-count", type=int, default=32)
    c.add_argument("--max-piece-size", type=int, default=18)
    c.add_argument("--cn-dict", default="")
    c.add_argument("--cut", type=int, default=0)
    c.add_argument("--reconstruct", action="store_true")
    for name in ("pretokenize", "raw-count"):
        c = sub.add_parser(name)
        c.add_argument("--normalize", default="no")
        c.add_argument("--cut", type=int, default=0)
        c.add_argument("--reconstruct", action="store_true")
        c.add_argument("--input", action="append", required=name == "raw-count")
        if name == "raw-count":
            c.add_argument("--output", default="")
            c.add_argument("--max-piece-size", type=int, default=0)
            c.add_argument("--cpu", type=int, default=4)
    for name in ("tokenize", "encode", "decode"):
        c = sub.add_parser(name)
        c.add_argument("--model", required=True)
        c.add_argument("--input", default="")
        c.add_argument("--cn-dict", default="")
    return p


def _dictionary(name: str):  # noqa: ANN202
    if name in ("", "no"):
        return name or None
    return {r["word"].encode(): r["freq"] for r in read_dictionary(session(1), name).collect()}


def _stdin():  # noqa: ANN202
    for line in sys.stdin:
        yield line.rstrip("\n")


def _print_lines(paths: list[str], shown: Callable[[Column], Column], out: TextIO) -> None:
    """Lines of files through a column, in order: computed by all tasks, streamed through the driver."""
    lines = read_ordered_lines(session(), paths)
    for r in lines.select("file_no", "line_no", shown(F.col("value")).alias("shown")).orderBy("file_no", "line_no").toLocalIterator(prefetchPartitions=True):
        print(r["shown"], file=out)


def shown_tokens(codec: Codec, line: str) -> str:
    return " ".join(escape(t) for t in codec.tokenize(line))


def shown_pairs(codec: Codec, line: str) -> str:
    """A line for each piece with its id, and an empty one."""
    return "".join(f"{piece.decode('utf-8', 'replace')}\t{i}\n" for piece, i in codec.encode(line))


def shown_text(codec: Codec, line: str) -> str:
    return codec.decode([int(x) for x in line.split()]).decode("utf-8", "replace")


def coded_lines(text: Column, model: Model, show: Callable[[Codec, str], str], cutter: Callable[[str], list[str]] | None) -> Column:
    shared = ship(SparkSession.active()).sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value, cutter, naive_normalize=False)
        for s in batches:
            yield pa.array([show(codec, x) for x in s.to_pylist()], pa.string())

    return run(text)


def main(argv: list[str] | None = None) -> int:
    a, _ = parser().parse_known_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    out = sys.stdout
    if a.command == "count":
        spark = session(a.cpu)
        lines = read_ordered_lines(spark, a.input)
        if a.max_sentences and a.method in ("piece", "sentencepiece"):
            lines = first_sentences(lines, a.max_sentences, ["file_no", "line_no"])
        model = train(lines, a.method, a.vocab_size, NormalizerSpec(a.normalize, cut=a.cut, reconstruct=a.reconstruct), _dictionary(a.cn_dict), ("file_no", "line_no"), "value", min_count=a.min_count, max_piece_size=a.max_piece_size)
        model.save(f"{a.model}.model")
        log.info("saved %s.model with %d pieces", a.model, len(model))
    elif a.command == "raw-count":
        lines = read_lines(session(a.cpu), a.input)
        pre = Splitter(a.normalize, a.cut, a.reconstruct)
        if a.normalize == "no":
            counts = raw_count(lines, a.cut, a.reconstruct, a.max_piece_size, "value")
        else:
            tokens = lines.select(F.explode(pre.tokenize(F.col("value"))).alias("token"))
            tokens = tokens.where(F.octet_length("token") <= a.max_piece_size) if a.max_piece_size else tokens
            counts = tokens.groupBy("token").agg(F.count("*").alias("freq"))
        counts = counts.persist()  # the texts are split once
        if a.output:
            write_counts_file(counts, a.output)
        print(f"lines={lines.count()} tokens={counts.count()}", file=out)
        counts.unpersist()
    elif a.command == "pretokenize":
        pre = Splitter(a.normalize, a.cut, a.reconstruct)
        if a.input:
            _print_lines(a.input, lambda c: F.array_join(pre.tokenize(c), " "), out)
        else:
            for line in _stdin():
                print(" ".join(pre.tokenize(line)), file=out)
    else:
        model = Model.load(a.model)
        words = _dictionary(a.cn_dict)
        cutter = None if words is None else (lambda run: list(run)) if words == "no" else han_cutter(words)
        cutter = cutter if model.counter.method == "piece" else None
        show = {"tokenize": shown_tokens, "encode": shown_pairs, "decode": shown_text}[a.command]
        if a.input:
            _print_lines([a.input], lambda c: coded_lines(c, model, show, cutter), out)
        else:
            codec = Codec(model, cutter, naive_normalize=False)
            for line in _stdin():
                print(show(codec, line), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
