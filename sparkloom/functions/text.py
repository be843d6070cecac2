"""Normalisation and pre-tokenisation as column expressions.

Everything here stays in the JVM. The same pattern text runs in Java and in RE2, which is how the
tests compare with DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "▁"
UNK_CHAR = "▅"

# Character classes as regex ranges.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
DIGIT = r"0-9\x{FF10}-\x{FF19}"
LETTER = (
    r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{85F}\x{900}-\x{1FFF}\x{2E80}-\x{2FFF}\x{3040}-\x{33FF}"
    r"\x{4DC0}-\x{4DFF}\x{A000}-\x{D7FF}\x{FB00}-\x{FDFF}\x{FE70}-\x{FEFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FFDC}\x{10000}-\x{10FFF}"
)
WORD = LETTER + HAN + DIGIT
SPACES = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRIPPED = SPACES + r"\x{1C}-\x{1F}"  # white space as cleaning and sentence splitting see it
_S = r"\x{2581}"
_NOT = f"[^{WORD}]"
_P = f"[^{WORD}{_S}]"

PATTERN_0 = f"{_NOT}?[{LETTER}]+|[{HAN}]+|[{DIGIT}]+|{_S}?{_P}+|{_S}"
PATTERN_1 = f"[{LETTER}]+(?:'[{LETTER}]+)*|[{HAN}]+|[{DIGIT}]+|{_NOT}"


def pattern(cut: int = 0) -> str:
    """The split pattern; any cut but 1 is 0."""
    return PATTERN_1 if cut == 1 else PATTERN_0


def normalize(text: Column, reconstruct: bool = False) -> Column:
    """Identity-map normalisation: spaces become the sentinel; unless reconstructing, runs collapse and the ends are stripped."""
    if reconstruct:
        return F.replace(text, F.lit(" "), F.lit(SENTINEL))
    t = F.regexp_replace(text, "^ +", "")
    t = F.regexp_replace(t, " +", SENTINEL)
    return F.regexp_replace(t, f"{SENTINEL}+\\z", "")


def replace_space(text: Column) -> Column:
    return F.replace(text, F.lit(SENTINEL), F.lit(" "))


def split_text(text: Column, cut: int = 0) -> Column:
    """Pre-tokens of a normalised text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern(cut)), F.lit(0))


def split_text_cn(text: Column, cut: int = 0, cutter=None) -> Column:  # noqa: ANN001
    """Pre-tokens with runs of Han characters cut further: one token a character, or as ``cutter`` (column -> array column) says."""
    cutter = cutter or (lambda p: F.split(p, ""))
    return F.flatten(F.transform(split_text(text, cut), lambda p: F.when(p.rlike(f"^[{HAN}]"), cutter(p)).otherwise(F.array(p))))


def pretokenize(text: Column, cut: int = 0, reconstruct: bool = False) -> Column:
    return split_text(normalize(text, reconstruct), cut)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def chars(text: Column) -> Column:
    """Code points as strings ('' for an empty text gives no element)."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_digit_token(c: Column) -> Column:
    return c.rlike(f"^[{DIGIT}]+\\z")


def is_han(c: Column) -> Column:
    return c.rlike(f"^[{HAN}]\\z")


def is_word_char(c: Column) -> Column:
    return c.rlike(f"^[{WORD}]\\z")


def is_whitespace(c: Column) -> Column:
    return c.rlike(f"^[{SPACES}]\\z")


def is_punctuation(c: Column) -> Column:
    """One code point that is no word character, white space or control."""
    return c.rlike(f"^[^{WORD}{SPACES}\\x{{0}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]\\z")


def char_class(c: Column) -> Column:
    """'space', 'han', 'digit', 'letter' or 'other' of one code point, as the splitter sees it."""
    return (
        F.when(c == SENTINEL, "space").when(c.rlike(f"^[{HAN}]\\z"), "han").when(c.rlike(f"^[{DIGIT}]\\z"), "digit").when(c.rlike(f"^[{LETTER}]\\z"), "letter").otherwise("other")
    )


def byte_to_piece(byte: Column) -> Column:
    return F.format_string("<0x%02X>", byte.cast("int"))


def piece_to_byte(piece: Column) -> Column:
    """The byte of a <0xHH> piece, -1 for anything else."""
    hit = F.regexp_extract(piece, r"^<0x([0-9A-F]{2})>\z", 1)
    return F.when(hit == "", F.lit(-1)).otherwise(F.conv(hit, 16, 10).cast("int"))


def strip_headings(text: Column) -> Column:
    """Delete Markdown heading lines. Only a line feed ends a line."""
    return F.regexp_replace(text, f"(?md)^#+[{STRIPPED}]+.*$", "")


def strip(text: Column) -> Column:
    """Without white space at the ends, that of all scripts."""
    return F.regexp_replace(text, f"^[{STRIPPED}]+|[{STRIPPED}]+\\z", "")


def clean_text(text: Column) -> Column:
    """Headings deleted, ends trimmed, runs of white space (of all scripts) made one space."""
    return F.trim(F.regexp_replace(strip_headings(text), f"[{STRIPPED}]+", " "))


def simplify_chinese(text: Column, mapping: dict[str, str]) -> Column:
    """Character-wise mapping to simplified Chinese with a supplied table."""
    keys = list(mapping)
    return F.translate(text, "".join(keys), "".join(mapping[k] for k in keys)) if keys else text


def split_sentences(text: Column) -> Column:
    """Sentences: lines cut after full-width enders, or after .!? before white space or the end; trimmed, without empty ones."""
    t = F.regexp_replace(text, f"([.!?])(?=[{STRIPPED}]|\\z)|([。！？])", "$1$2\n")
    return F.filter(F.transform(F.split(t, "[\r\n]"), strip), lambda s: s != "")


def is_english_token(token: Column) -> Column:
    return token.rlike("^[A-Za-z]{2,}\\z")
