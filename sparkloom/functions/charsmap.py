"""Character-map normalisation with longest-prefix rules, and byte offsets into the original."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codepoints import decode_one
from .text import SENTINEL
from .text import normalize as plain

_SPACES = re.compile(" +")
MAX_PREFIXES = 32  # of one source that are sources themselves
NAMES = ("NFKC", "NMT_NFKC", "NFKC_CF", "NMT_NFKC_CF")
_NMT_DELETE = {*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, 0x8F, 0x9F, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF}
_NMT_SPACE = {0x9, 0xA, 0xC, 0xD, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x85, 0xA0}


def _standard(text: str, name: str) -> str:
    if name.startswith("NMT"):
        text = "".join(" " if ord(c) in _NMT_SPACE else c for c in text if ord(c) not in _NMT_DELETE)
    text = unicodedata.normalize("NFKC", text)
    return unicodedata.normalize("NFKC", text.casefold()) if name.endswith("_CF") else text


class CharsMap:
    """Rewrite rules (text -> text); at each position the longest matching source wins."""

    def __init__(self, rules: dict[str, str] | None = None, name: str = "no"):
        self.rules = dict(rules or {})
        self.name = name
        self.longest = max(map(len, self.rules), default=0)
        for source in self.rules:
            if sum(source[:n] in self.rules for n in range(1, len(source) + 1)) > MAX_PREFIXES:
                raise ValueError(f"more than {MAX_PREFIXES} sources begin {source!r}")
        self.seen: dict[str, str] = {}
        longest_first = sorted(filter(None, self.rules), key=len, reverse=True)
        self.sources = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def rewrite(self, text: str) -> str:
        """All rules over a whole text, from left to right."""
        return self.sources.sub(lambda m: self.rules[m[0]], text) if self.sources else text

    @classmethod
    def named(cls, name: str) -> CharsMap:
        """The standard map of that name; the identity for 'no', 'none' and any unknown name."""
        return cls({}, name if name in NAMES else "no")

    @classmethod
    def from_table(cls, df: DataFrame) -> CharsMap:
        """From rows (source, target) on the driver; a map is a small, fixed table."""
        return cls({r["source"]: r["target"] for r in df.select("source", "target").collect()}, "custom")

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The rules as rows (source, target), in order."""
        return spark.createDataFrame(sorted(self.rules.items()), "source string, target string")

    def to_blob(self) -> bytes:
        return json.dumps({"name": self.name, "rules": self.rules}, ensure_ascii=False, sort_keys=True).encode()

    @classmethod
    def from_blob(cls, blob: bytes) -> CharsMap:
        d = json.loads(blob)
        return cls(d["rules"], d["name"])

    def step(self, text: str, at: int) -> tuple[str, int]:
        """(replacement, source characters used) at a position."""
        for n in range(min(self.longest, len(text) - at), 0, -1):
            hit = self.rules.get(text[at : at + n])
            if hit is not None:
                return hit, n
        if self.name in NAMES:
            n = 1
            while at + n < len(text) and unicodedata.combining(text[at + n]):
                n += 1
            part = text[at : at + n]
            hit = self.seen.get(part)
            if hit is None:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                hit = self.seen[part] = _standard(part, self.name)
            return hit, n
        return text[at], 1


def normalize_offsets(raw: bytes, charsmap: CharsMap, reconstruct: bool = False, space: str = SENTINEL) -> tuple[bytes, list[int]]:
    """(normalised text, for each of its bytes the byte offset in the original, and the end offset last)."""
    text, size = [], []
    at = 0
    while at < len(raw):
        c, n = decode_one(raw, at)
        text.append(chr(c))
        size.append(n)
        at += n
    s = "".join(text)
    begin = [0]
    for n in size:
        begin.append(begin[-1] + n)
    out, back, i = bytearray(), [], 0
    if not s:
        return b"", []
    after_space = not reconstruct
    if not reconstruct:
        while i < len(s) and (p := charsmap.step(s, i))[0] == " ":
            i += p[1]
        if i == len(s):
            return b"", []
    sp = space.encode()
    while i < len(s):
        t, n = charsmap.step(s, i)
        if not reconstruct and after_space:
            t = t.lstrip(" ")
        for c in t:
            b = sp if c == " " else c.encode()
            out += b
            back += [begin[i]] * len(b)
        if t:
            after_space = t[-1] == " "
        i += n
    end = begin[-1]
    if not reconstruct:
        while sp and out.endswith(sp):
            end = back[len(out) - len(sp)]
            del out[-len(sp) :], back[-len(sp) :]
    return bytes(out), [*back, end]


def normalize_text(text: str, charsmap: CharsMap, reconstruct: bool = False, space: str = SENTINEL) -> str:
    """The text of :func:`normalize_offsets`; a standard map, or rules alone, run over the whole string at once."""
    standard = charsmap.name in NAMES
    if charsmap.rules and (standard or any("  " in x for x in charsmap.rules.values())):  # spaces inside of one target are kept
        return normalize_offsets(text.encode(), charsmap, reconstruct, space)[0].decode()
    t = _standard(text, charsmap.name) if standard else charsmap.rewrite(text)
    if reconstruct:
        return t.replace(" ", space)
    t = _SPACES.sub(" ", t).strip(" ").replace(" ", space)
    while space and t.endswith(space):
        t = t[: -len(space)]
    return t


def normalize(text: Column, charsmap: CharsMap | str = "no", reconstruct: bool = False) -> Column:
    """Normalised text. The identity map is a JVM expression; other maps take an iterator pandas UDF."""
    charsmap = CharsMap.named(charsmap) if isinstance(charsmap, str) else charsmap
    if charsmap.name == "no" and not charsmap.rules:
        return plain(text, reconstruct)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            yield pa.array([None if x is None else normalize_text(x, charsmap, reconstruct) for x in s.to_pylist()], pa.string())

    return run(text)


def normalize_with_offsets(text: Column, charsmap: CharsMap | str = "no", reconstruct: bool = False) -> Column:
    """STRUCT<text, offsets>, offsets of bytes."""
    charsmap = CharsMap.named(charsmap) if isinstance(charsmap, str) else charsmap

    @F.pandas_udf("struct<text: string, offsets: array<int>>")
    def run(s: pd.Series) -> pd.DataFrame:
        both = [(None, None) if x is None else normalize_offsets(x.encode(), charsmap, reconstruct) for x in s]
        return pd.DataFrame({"text": [None if t is None else t.decode() for t, _ in both], "offsets": [o for _, o in both]})

    return run(text)
