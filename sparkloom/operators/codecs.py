"""Encoding, tokenising and decoding with a model, as column functions and on the driver.

Sequential decoding is a state machine, so it runs in Arrow UDFs with the model broadcast once. A text
is encoded in parts where no piece can reach across: a boundary of pre-tokens whose two bytes stand
next to each other in no piece of the model. No merge and no lattice edge crosses such a place, so the
result is that of the whole text, and parts that were seen before come from a bounded cache.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.charsmap import NAMES, CharsMap, normalize_offsets
from ..functions.codepoints import byte_to_piece, char_length, piece_to_byte
from ..functions.text import DIGIT, HAN, LETTER, SENTINEL, split_text
from ..session import ship
from ..sources.model import BYTE, CONTROL, NORMAL, UNKNOWN, Model, NormalizerSpec
from .unigram import Unigram

ENCODED = "array<struct<piece: binary, id: int>>"
CACHED_PARTS = 200_000
CACHED_WORDS = 400_000
SHORT = 64  # bytes of a word that is encoded without cutting it further


def _python(ranges: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", ranges)


_L, _H, _D = _python(LETTER), _python(HAN), _python(DIGIT)
_SPLIT = (
    re.compile(f"[^{_L}{_H}{_D}]?[{_L}]+|[{_H}]+|[{_D}]+|{SENTINEL}?[^{_L}{_H}{_D}{SENTINEL}]+|{SENTINEL}"),
    re.compile(f"[{_L}]+(?:'[{_L}]+)*|[{_H}]+|[{_D}]+|[^{_L}{_H}{_D}]"),
)
_IS_HAN = re.compile(f"[{_H}]")


def split_python(text: str, cut: int = 0) -> list[str]:
    """The pre-tokens of a normalised text, for use inside UDFs."""
    return _SPLIT[1 if cut == 1 else 0].findall(text)


_RUNS = re.compile(" +")


def normalize_python(text: str | bytes, spec: NormalizerSpec, charsmap: CharsMap | None = None) -> bytes:
    if isinstance(text, str) and spec.name not in NAMES and spec.space == SENTINEL:
        if spec.reconstruct:
            return text.replace(" ", SENTINEL).encode("utf-8", "surrogatepass")
        text = text.lstrip(" ")
        return (_RUNS.sub(" ", text) if "  " in text else text).replace(" ", SENTINEL).rstrip(SENTINEL).encode("utf-8", "surrogatepass")
    raw = text.encode() if isinstance(text, str) else bytes(text)
    return normalize_offsets(raw, charsmap or CharsMap.named(spec.name), spec.reconstruct, spec.space)[0]


_MARK = SENTINEL.encode()


class Cached(dict):
    """Values that ``make`` gives for keys, of at most CACHED_WORDS."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Spelling(dict):
    """What ids decode to; ``other`` for those out of range."""

    other = b""

    def __missing__(self, key: int) -> bytes:
        return self.other


class Codec:
    """Encoder and decoder of one model. ``cutter``: for 'piece' only, cuts runs of Han characters before encoding."""

    def __init__(self, model: Model, cutter: Callable[[str], list[str]] | None = None, naive_normalize: bool = True):
        self.model = model
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.method = model.counter.method
        self.map = CharsMap.named(model.normalizer.name)
        self.id = {p: i for i, p in enumerate(self.pieces)}  # the last of equal pieces
        self.unk = next((i for i in range(len(self.types) - 1, -1, -1) if self.types[i] == UNKNOWN), -1)
        self.cutter = cutter
        self.naive_normalize = naive_normalize
        self.byte_id = [self.id.get(byte_to_piece(b).encode(), self.unk) for b in range(256)]
        if self.method == "naive":
            self.merges = [(self.id.get(p.u, -1), self.id.get(p.v, -1), i) for i, p in enumerate(model.pieces) if i >= 256 and p.u and p.v]
        elif self.method == "piece":
            self.rank = {(self.id.get(p.u, -1), self.id.get(p.v, -1)): i for i, p in enumerate(model.pieces) if p.u and p.v}
            self.single = [self.id.get(bytes([b]), self.unk) for b in range(256)]
        elif self.method == "bytepiece":
            self.unk = model.counter.unk_id
            weights = {}
            for p in model.pieces:
                if p.type == NORMAL:
                    weights[p.piece] = p.score
            self.unigram = Unigram(weights)
        self.inner = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.cache: dict[bytes, list[tuple[bytes, int]]] = {}
        self.spelling: dict[int, bytes] | None = None
        mark = SENTINEL.encode()
        held = bytes(b for b in range(256) if bytes([b]) + mark[:1] in self.inner)  # a piece may reach from these across a space
        self.held = re.compile(b"(?<=[" + b"".join(b"\\x%02x" % b for b in held) + b"])" + mark) if held else None
        self.heads, self.tails = Cached(self.packed_word), Cached(lambda w: self.packed_word(mark + w))

    def parts(self, s: bytes) -> list[bytes]:
        """Cut a normalised text where no piece can reach across."""
        out: list[bytes] = []
        held = b""
        for t in split_python(s.decode("utf-8", "surrogatepass"), 1):
            b = t.encode("utf-8", "surrogatepass")
            if held and held[-1:] + b[:1] not in self.inner:
                out.append(held)
                held = b
            else:
                held += b
        return [*out, held] if held else out

    def whole(self, s: bytes, encode: Callable[[bytes], list[tuple[bytes, int]]]) -> list[tuple[bytes, int]]:
        """``encode`` of the parts of a text, joined."""
        out: list[tuple[bytes, int]] = []
        for part in self.parts(s):
            got = self.cache.get(part)
            if got is None:
                if len(self.cache) >= CACHED_PARTS:
                    self.cache.clear()
                got = self.cache[part] = encode(part)
            out += got
        return out

    def packed_word(self, word: bytes) -> bytes:
        """Ids of a stretch between spaces, as 32-bit numbers."""
        word = word.replace(b"\xff", SENTINEL.encode())
        encode = {"piece": self._piece, "sentencepiece": self._agenda}.get(self.method, self._lattice)
        return np.array([i for _, i in (encode(word) if len(word) <= SHORT else self.whole(word, encode))], np.int32).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of :meth:`encode` as 32-bit numbers. Words are looked up in a bounded cache; spaces that a piece may span don't part words."""
        if self.method == "naive" or self.cutter is not None:
            return np.array([i for _, i in self.encode(text)], np.int32).tobytes()
        s = self.normalize(text)
        if self.held is not None:
            s = self.held.sub(b"\xff", s)
        words = s.split(_MARK)
        head = self.heads[words[0]] if words[0] else b""
        del words[0]
        return head + b"".join(map(self.tails.__getitem__, words))

    def normalize(self, text: str | bytes) -> bytes:
        return normalize_python(text, self.model.normalizer, self.map)

    def encode(self, text: str | bytes) -> list[tuple[bytes, int]]:
        if self.method == "naive" and not self.naive_normalize:
            return self._naive(text.encode() if isinstance(text, str) else bytes(text))
        s = self.normalize(text)
        if self.method == "naive":
            return self._naive(s)
        if not s:
            return []
        if self.method == "piece":
            if self.cutter is None:
                return self.whole(s, self._piece)
            out = []
            for t in split_python(s.decode(), self.model.normalizer.cut):
                for part in self.cutter(t) if _IS_HAN.match(t) else [t]:
                    out += self._piece(part.encode())
            return out
        return self.whole(s, self._agenda if self.method == "sentencepiece" else self._lattice)

    def tokenize(self, text: str | bytes) -> list[bytes]:
        return [p for p, _ in self.encode(text)]

    def _naive(self, s: bytes) -> list[tuple[bytes, int]]:
        ids = list(s)
        for a, b, new in self.merges:
            if len(ids) < 2:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == a and ids[k + 1] == b:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return [(self.pieces[i], i) for i in ids]

    def _piece(self, s: bytes) -> list[tuple[bytes, int]]:
        """Merge the pair of the lowest rank, leftmost first, while there is one."""
        ids: list[int | None] = [self.single[b] for b in s]
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.rank[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else -1
            if ids[i] is None or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            if (k := prev[i]) >= 0 and (p := (ids[k], r)) in self.rank:
                heapq.heappush(heap, (self.rank[p], k, *p))
            if (k := nxt[i]) >= 0 and (p := (r, ids[k])) in self.rank:
                heapq.heappush(heap, (self.rank[p], i, *p))
        return [(self.pieces[i], i) for i in ids if i is not None and 0 <= i < len(self.pieces)]

    def _agenda(self, s: bytes) -> list[tuple[bytes, int]]:
        """Merge the neighbours whose joined piece has the best score, leftmost first."""
        sym: list[bytes] = []
        at = 0
        while at < len(s):
            k = char_length(s[at])
            sym.append(s[at : at + k])
            at += k
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.id.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-self.model.pieces[k].score, i, j, len(sym[i]) + len(sym[j])))

        for i in range(1, n):
            offer(i - 1, i)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = b""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(prev[i], i)
            offer(i, nxt[i])
        return self._with_bytes(x for x in sym if x)

    def _lattice(self, s: bytes) -> list[tuple[bytes, int]]:
        return self._with_bytes(self.unigram.tokenize(s))

    def _with_bytes(self, tokens) -> list[tuple[bytes, int]]:  # noqa: ANN001
        out = []
        for t in tokens:
            i = self.id.get(t, self.unk)
            if i == self.unk:
                out += [(byte_to_piece(b).encode(), self.byte_id[b]) for b in t]
            else:
                out.append((t, i))
        return out

    def spelled(self, i: int) -> bytes:
        """What an id within range decodes to."""
        p, kind = self.pieces[i], self.types[i]
        if kind == BYTE:
            b = piece_to_byte(p)
            return bytes([b]) if b >= 0 else p
        return b"" if kind in (UNKNOWN, CONTROL) else p

    def decode(self, ids: list[int]) -> bytes:
        if self.method == "naive":
            return b"".join(self.pieces[i] for i in ids if 0 <= i < len(self.pieces))
        if self.spelling is None:
            other = self.pieces[self.unk] if self.unk >= 0 else b""
            self.spelling = Spelling({i: self.spelled(i) for i in range(len(self.pieces))})
            self.spelling.other = other
        out = b"".join(map(self.spelling.__getitem__, ids))
        space = self.model.normalizer.space.encode()
        return out.replace(space, b" ") if space else out


_KEPT: list[Codec] = []


def kept_codec(model: Model) -> Codec:
    """The codec of a broadcast model, kept with its cache for the worker's next task."""
    if not _KEPT or _KEPT[0].model is not model:
        _KEPT[:] = [Codec(model)]
    return _KEPT[0]


def _encoder(text: Column, model: Model, cutter: Callable[[str], list[str]] | None, kind: str, build: Callable) -> Column:
    spark = ship(SparkSession.active())
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value, cutter)
        for s in batches:
            rows = [None if x is None else codec.encode(x) for x in s.to_pylist()]
            off = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r or ()) for r in rows], out=off[1:])
            off_ = pa.array(off, mask=np.array([*(r is None for r in rows), False]))
            yield pa.ListArray.from_arrays(off_, build([x for r in rows if r for x in r]))

    return run(text)


def encode(text: Column, model: Model, cutter: Callable[[str], list[str]] | None = None) -> Column:
    """ARRAY<STRUCT<piece, id>> of a text column; null stays null."""
    return _encoder(text, model, cutter, ENCODED, lambda x: pa.StructArray.from_arrays([pa.array([p for p, _ in x], pa.binary()), pa.array([i for _, i in x], pa.int32())], names=["piece", "id"]))


def encode_ids(text: Column, model: Model, cutter: Callable[[str], list[str]] | None = None) -> Column:
    spark = ship(SparkSession.active())
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = kept_codec(shared.value) if cutter is None else Codec(shared.value, cutter)
        for s in batches:
            rows = [None if x is None else codec.packed(x) for x in s.to_pylist()]
            off = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r or b"") // 4 for r in rows], out=off[1:])
            off_ = pa.array(off, mask=np.array([*(r is None for r in rows), False]))
            yield pa.ListArray.from_arrays(off_, pa.array(np.frombuffer(b"".join([r for r in rows if r]), np.int32)))

    return run(text)


def tokenize(text: Column, model: Model, cutter: Callable[[str], list[str]] | None = None) -> Column:
    return _encoder(text, model, cutter, "array<binary>", lambda x: pa.array([p for p, _ in x], pa.binary()))


def decode(ids: Column, model: Model) -> Column:
    """Decoded text (invalid UTF-8 as replacement characters) of an array of ids."""
    spark = ship(SparkSession.active())
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = kept_codec(shared.value)
        for s in batches:
            at, ids = s.offsets.to_pylist(), s.values.fill_null(-1).to_numpy().tolist()
            yield pa.array([None if empty else codec.decode(ids[a:b]).decode("utf-8", "replace") for a, b, empty in zip(at, at[1:], s.is_null().to_pylist())], pa.string())

    return run(ids)


def han_cutter(weights: dict[bytes, float]) -> Callable[[str], list[str]]:
    unigram = Unigram.cutter(weights)
    return lambda run: [t.decode() for t in unigram.tokenize(run.encode())]


def cut_column(text: Column, cut: int, weights: dict[bytes, float]) -> Column:
    """Pre-tokens of normalised texts with Han runs cut by a dictionary."""
    spark = ship(SparkSession.active())
    shared = spark.sparkContext.broadcast(Unigram.cutter(weights))

    @F.arrow_udf("array<string>")
    def run(s: pa.Array) -> pa.Array:
        u = shared.value
        return pa.array([None if row is None else [x for t in row for x in ([b.decode() for b in u.tokenize(t.encode())] if _IS_HAN.match(t) else [t])] for row in s.to_pylist()], pa.list_(pa.string()))

    return run(split_text(text, cut))


def unigram_tokenize(text: Column, weights: dict[str, float], fallback: float = -10.0) -> Column:
    """Tokens of the best dictionary path."""
    spark = ship(SparkSession.active())
    shared = spark.sparkContext.broadcast(Unigram({w.encode(): f for w, f in weights.items()}, fallback))

    @F.arrow_udf("array<string>")
    def run(s: pa.Array) -> pa.Array:
        u = shared.value
        return pa.array([None if x is None else [t.decode("utf-8", "replace") for t in u.tokenize(x.encode())] for x in s.to_pylist()], pa.list_(pa.string()))

    return run(text)
