"""User-facing classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from .functions.charsmap import CharsMap, normalize
from .functions.text import split_text
from .operators import codecs
from .operators.learners import train
from .sources.model import Model, NormalizerSpec

__all__ = ["Splitter", "Vocabulary", "train"]


class Splitter:
    """Normalisation and splitting of texts or text columns."""

    def __init__(self, normalize: str = "no", cut: int = 0, reconstruct: bool = False):
        self.spec = NormalizerSpec(name=normalize, cut=cut, reconstruct=reconstruct)

    def tokenize(self, text: str | Column) -> list[str] | Column:
        if isinstance(text, Column):
            return split_text(normalize(text, CharsMap.named(self.spec.name), self.spec.reconstruct), self.spec.cut)
        return codecs.split_python(codecs.normalize_python(text, self.spec).decode(), self.spec.cut)


class Vocabulary:
    """A loaded model. Texts give lists; columns give columns."""

    def __init__(self, model: Model, cutter: Callable[[str], list[str]] | None = None):
        self.model = model
        self.cutter = cutter if model.counter.method == "piece" else None
        self.codec = codecs.Codec(model, self.cutter)
        self.first = {p: i for i, p in reversed(list(enumerate(self.codec.pieces)))}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(Model.load(path))

    @property
    def method(self) -> str:
        return self.model.counter.method

    @property
    def vocab_size(self) -> int:
        return len(self.model)

    def encode(self, text: str | Column) -> list[tuple[bytes, int]] | Column:
        return codecs.encode(text, self.model, self.cutter) if isinstance(text, Column) else self.codec.encode(text)

    def encode_as_ids(self, text: str | Column) -> list[int] | Column:
        return codecs.encode_ids(text, self.model, self.cutter) if isinstance(text, Column) else [i for _, i in self.codec.encode(text)]

    def encode_as_pieces(self, text: str | Column) -> list[bytes] | Column:
        return codecs.tokenize(text, self.model, self.cutter) if isinstance(text, Column) else self.codec.tokenize(text)

    def decode(self, ids: list[int] | list[tuple[bytes, int]] | Column) -> str | Column:
        if isinstance(ids, Column):
            return codecs.decode(ids, self.model)
        return self.codec.decode([x[1] if isinstance(x, tuple) else x for x in ids]).decode("utf-8", "replace")

    def piece_to_id(self, piece: bytes | str) -> int:
        """Byte-piece models give the first id or -1, others the last or the unknown id (-1 for naive)."""
        p = piece.encode() if isinstance(piece, str) else piece
        if self.method == "bytepiece":
            return self.first.get(p, -1)
        return self.codec.id.get(p, -1 if self.method == "naive" else self.codec.unk)

    def id_to_piece(self, i: int) -> bytes:
        if not 0 <= i < len(self.model):
            raise IndexError(i)
        return self.codec.pieces[i]
