"""The vocabulary model: specs, pieces, its text file and its table form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.codepoints import byte_to_piece, escape, unescape
from ..functions.text import SENTINEL, UNK_CHAR

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE_SCHEMA = "id int, piece binary, score float, type int, u binary, v binary"
METHODS = ("naive", "piece", "sentencepiece", "bytepiece")


@dataclass(frozen=True)
class CounterSpec:
    method: str = "bytepiece"
    vocab_size: int = 8000
    character_coverage: float = 0.9995
    min_count: int = 32
    max_piece_size: int = 18
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    pad_id: int = -1
    unk_unicode: int = ord(UNK_CHAR)
    unk_piece: str = "<unk>"
    bos_piece: str = "<s>"
    eos_piece: str = "</s>"
    pad_piece: str = "<pad>"


@dataclass(frozen=True)
class NormalizerSpec:
    name: str = "no"
    space: str = SENTINEL
    cut: int = 0
    reconstruct: bool = False


@dataclass(frozen=True)
class Piece:
    piece: bytes
    score: float = 0.0
    type: int = NORMAL
    u: bytes = b""
    v: bytes = b""


def _line(x: object) -> str:
    if isinstance(x, bool):
        return str(int(x))
    return f"{x:g}" if isinstance(x, float) else escape(str(x).encode())


def spec_lines(spec: CounterSpec | NormalizerSpec) -> list[str]:
    return [f"{f.name}={_line(getattr(spec, f.name))}" for f in fields(spec)]


def parse_spec(kind: type, lines: Iterable[str]):  # noqa: ANN201
    known = {f.name: f.type for f in fields(kind)}
    values: dict[str, object] = {}
    for line in lines:
        key, eq, value = line.partition("=")
        if eq and key in known:
            t = known[key]
            values[key] = bool(int(value)) if t == "bool" else int(value) if t == "int" else float(value) if t == "float" else unescape(value).decode()
    return kind(**values)


@dataclass
class Model:
    counter: CounterSpec = field(default_factory=CounterSpec)
    normalizer: NormalizerSpec = field(default_factory=NormalizerSpec)
    pieces: list[Piece] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.pieces)

    def to_text(self) -> str:
        rows = [f"{i}\t{escape(p.piece)}\t{p.score:g}\t{p.type}\t{escape(p.u)}\t{escape(p.v)}" for i, p in enumerate(self.pieces)]
        return "\n".join(["[CounterSpec]", *spec_lines(self.counter), "", "[NormalizerSpec]", *spec_lines(self.normalizer), "", "[Pieces]", f"size={len(rows)}", *rows, ""])

    @classmethod
    def from_text(cls, text: str) -> Model:
        """Rows that cannot be read are skipped; a number of pieces other than ``size`` is an error."""
        sections: dict[str, list[str]] = {}
        name = ""
        for line in text.split("\n"):
            if line.startswith("[") and line.endswith("]") and "\t" not in line:
                name = line[1:-1]
                sections.setdefault(name, [])
            elif line:
                sections.setdefault(name, []).append(line)
        rows = sections.get("Pieces", [])
        size = next((int(r[5:]) for r in rows if r.startswith("size=") and "\t" not in r), None)
        pieces = []
        for r in rows:
            part = r.split("\t")
            if len(part) >= 4:
                part += [""] * (6 - len(part))
                try:
                    int(part[0])
                    pieces.append(Piece(unescape(part[1]), float(part[2]), int(part[3]), unescape(part[4]), unescape(part[5])))
                except ValueError:
                    continue
        if size is not None and size != len(pieces):
            raise ValueError(f"the model says size={size} and has {len(pieces)} pieces")
        return cls(parse_spec(CounterSpec, sections.get("CounterSpec", [])), parse_spec(NormalizerSpec, sections.get("NormalizerSpec", [])), pieces)

    def save(self, path: str) -> None:
        Path(path).write_bytes(self.to_text().encode())

    @classmethod
    def load(cls, path: str) -> Model:
        return cls.from_text(Path(path).read_bytes().decode())

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(p.piece), p.score, p.type, bytearray(p.u), bytearray(p.v)) for i, p in enumerate(self.pieces)], PIECE_SCHEMA)

    @classmethod
    def from_table(cls, df: DataFrame, counter: CounterSpec | None = None, normalizer: NormalizerSpec | None = None) -> Model:
        """From the rows of a vocabulary table (its size is the vocabulary's)."""
        rows = df.orderBy("id").collect()
        return cls(counter or CounterSpec(), normalizer or NormalizerSpec(), [Piece(bytes(r["piece"]), r["score"], r["type"], bytes(r["u"] or b""), bytes(r["v"] or b"")) for r in rows])

    def with_specs(self, **changes: object) -> Model:
        return Model(replace(self.counter, **changes), self.normalizer, self.pieces)


def meta_pieces(spec: CounterSpec, with_bytes: bool) -> dict[int, Piece]:
    """Special pieces by id; with 256 byte pieces after them for the methods that fall back to bytes."""
    out = {}
    for i, text, kind in ((spec.unk_id, spec.unk_piece, UNKNOWN), (spec.bos_id, spec.bos_piece, CONTROL), (spec.eos_id, spec.eos_piece, CONTROL), (spec.pad_id, spec.pad_piece, CONTROL)):
        if i >= 0:
            out[i] = Piece(text.encode(), 0.0, kind)
    if with_bytes:
        first = len(out)
        if first + 256 > spec.vocab_size:
            raise ValueError(f"vocab_size must be {first + 256} at least")
        for b in range(256):
            out[first + b] = Piece(byte_to_piece(b).encode(), 0.0, BYTE)
    return out


def assemble(spec: CounterSpec, normalizer: NormalizerSpec, meta: dict[int, Piece], learned: list[Piece], size: int | None = None) -> Model:
    """Learned pieces in order around the special ones; a smaller vocabulary if they run out."""
    out: list[Piece] = []
    rest = iter(learned)
    limit = size if size is not None else len(meta) + len(learned)
    for i in range(limit):
        p = meta.get(i) or next(rest, None)
        if p is None:
            if not any(k > i for k in meta):
                break
            continue
        out.append(p)
    return Model(spec, normalizer, out)
