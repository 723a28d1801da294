"""Command line: ``python -m quillbit compress --layer ppm:d=5 --base polya_stoken [file]``.

One file (or standard input) is packed, measured, unpacked or listed as tokens without a
Spark session; ``serve`` runs one such command for each line it reads; ``score`` runs files
by algorithms as a Spark job and prints the table.
"""

from __future__ import annotations

import argparse
import shlex
import sys
from typing import BinaryIO

from quillbit.functions import symbols as S
from quillbit.plans.score import compress, decompress, measure
from quillbit.plans.spec import BASES, parse


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillbit", description="Text compression by stacks of adaptive models")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("compress", "pack"), ("decompress", "unpack"), ("measure", "print the bits that packing takes")):
        one = commands.add_parser(name, help=about)
        one.add_argument("--layer", action="append", default=[], help="a layer with parameters, innermost first: crp, ppm, lzw, lzwEscape")
        one.add_argument("--base", default="uniform_byte", help=f"a base: {', '.join(BASES)}")
        one.add_argument("file", nargs="?", help="standard input where none is given")
    tokens = commands.add_parser("tokens", help="list the tokens of UTF-8 text, also of malformed bytes")
    tokens.add_argument("--alphabet", choices=("detailed", "simple"), default="detailed")
    tokens.add_argument("--show", choices=("identity", "info"), default="info", help="info: one token a line; identity: the bytes they stand for")
    tokens.add_argument("file", nargs="?")
    commands.add_parser("serve", help="run one command for each line of standard input")
    score = commands.add_parser("score", help="files by algorithms, as a Spark job")
    score.add_argument("--algorithm", action="append", required=True)
    score.add_argument("--timeout", type=float)
    score.add_argument("--show", choices=("bits", "per", "size"), default="bits")
    score.add_argument("files", nargs="+", help="globs")
    return parser


def _read(name: str | None, stdin: BinaryIO) -> bytes:
    if name is None:
        return stdin.read()
    with open(name, "rb") as f:
        return f.read()


def _tokens(data: bytes, detailed: bool, identity: bool) -> bytes:
    found = (S.decode_detailed if detailed else S.decode_simple)(data)
    if identity:
        return S.encode_tokens(found)
    return "".join(S.token_name(*t) + "\n" for t in found).encode()


def _score(args: argparse.Namespace) -> bytes:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quillbit.plans.score import grid
    from quillbit.sources.tables import console

    spark = SparkSession.builder.getOrCreate()
    files = spark.read.format("binaryFile").load(args.files).select(F.col("path").alias("file"), "content")
    return (console(grid(files, args.algorithm, timeout=args.timeout).collect(), args.show, args.algorithm) + "\n").encode()


def run(line: list[str], stdin: BinaryIO, stdout: BinaryIO) -> int:
    """One command; what it says goes to ``stdout``."""
    args = _arguments().parse_args(line)
    if args.command == "serve":
        for text in stdin:
            try:
                run(shlex.split(text.decode()), stdin, stdout)
            except (ValueError, OSError, SystemExit) as e:  # the next line is a command of its own
                stdout.write(f"error: {e}\n".encode())
            stdout.flush()
        return 0
    if args.command == "score":
        stdout.write(_score(args))
        return 0
    data = _read(args.file, stdin)
    if args.command == "tokens":
        stdout.write(_tokens(data, args.alphabet == "detailed", args.show == "identity"))
        return 0
    spec = parse(args.layer, args.base)
    if args.command == "measure":
        stdout.write(f"{measure(data, spec)}\n".encode())
    else:
        stdout.write((compress if args.command == "compress" else decompress)(data, spec))
    return 0


def main() -> int:
    return run(sys.argv[1:], sys.stdin.buffer, sys.stdout.buffer)
