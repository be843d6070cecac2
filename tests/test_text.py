"""Vectors of the splitter, the normaliser and the character classes."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.api import Splitter
from sparkloom.functions import codepoints as cp
from sparkloom.functions import text as tx
from sparkloom.functions.charsmap import CharsMap, normalize, normalize_offsets, normalize_with_offsets
from sparkloom.operators.codecs import split_python

SPLIT_0 = {
    "hello▁world": ["hello", "▁world"], "a▁▁b": ["a", "▁", "▁b"], "a▁▁▁b": ["a", "▁", "▁", "▁b"], "hello▁,": ["hello", "▁,"],
    "hello,world": ["hello", ",world"], "hello,,world": ["hello", ",,", "world"], "▁,a": ["▁,", "a"], "hello123world": ["hello", "123", "world"],
    "year▁2024": ["year", "▁", "2024"], "你好世界": ["你好世界"], "你好，世界": ["你好", "，", "世界"], "▁你好": ["▁", "你好"],
    "hello你好world": ["hello", "你好", "world"], "hi🙂bye": ["hi", "🙂bye"], "$100": ["$", "100"], "$hello": ["$hello"], "▁$100": ["▁$", "100"],
    "100%": ["100", "%"], "▁24h": ["▁", "24", "h"], "they'll": ["they", "'ll"], "hello▁,world": ["hello", "▁,", "world"],
}
SPLIT_1 = {"▁Hello,▁World!": ["▁", "Hello", ",", "▁", "World", "!"], "▁don't": ["▁", "don't"], "▁你好，世界。": ["▁", "你好", "，", "世界", "。"], "hello123你好": ["hello", "123", "你好"]}
SPLIT_CN = {"Tom▁他是英国人Bat": ["Tom", "▁", "他", "是", "英", "国", "人", "Bat"], "你好▁world": ["你", "好", "▁world"], "a▁▁世界": ["a", "▁", "▁", "世", "界"], "hello▁world": ["hello", "▁world"]}


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(("vectors", "cut"), [(SPLIT_0, 0), (SPLIT_1, 1)])
def test_split_vectors(spark, vectors, cut):
    assert column(spark, vectors, lambda c: tx.split_text(c, cut)) == list(vectors.values())
    assert [split_python(t, cut) for t in vectors] == list(vectors.values())


def test_split_cn_vectors(spark):
    assert column(spark, SPLIT_CN, tx.split_text_cn) == list(SPLIT_CN.values())


def test_char_classes(spark):
    han, no_han = "中鿿㐀\U00020000豈", "a5あ가，"
    word, no_word = "aZ5中あ가éαА", " ,，。×🙂"
    assert column(spark, han + no_han, tx.is_han) == [True] * len(han) + [False] * len(no_han)
    assert column(spark, word + no_word, tx.is_word_char) == [True] * len(word) + [False] * len(no_word)
    assert column(spark, ["12", "１", "a1", ""], tx.is_digit_token) == [True, True, False, False]
    assert column(spark, [",", "，", " ", "a", "\t", "ab"], tx.is_punctuation) == [True, True, False, False, False, False]
    assert column(spark, [" ", "　", "x"], tx.is_whitespace) == [True, True, False]


END = "Hello, World! don't 你好，世界。123abc"


@pytest.mark.parametrize(
    ("cut", "reconstruct", "text", "tokens"),
    [
        (0, False, END, ["Hello", ",", "▁World", "!", "▁don", "'t", "▁", "你好", "，", "世界", "。", "123", "abc"]),
        (1, False, END, ["Hello", ",", "▁", "World", "!", "▁", "don't", "▁", "你好", "，", "世界", "。", "123", "abc"]),
        (0, True, "  Hello   World  ", ["▁", "▁Hello", "▁", "▁", "▁World", "▁", "▁"]),
        (0, True, "  Hello  ", ["▁", "▁Hello", "▁", "▁"]),
        (0, False, "", []),
        (0, False, "   ", []),
    ],
)
def test_end_to_end(spark, cut, reconstruct, text, tokens):
    assert column(spark, [text], lambda c: tx.pretokenize(c, cut, reconstruct)) == [tokens]
    assert Splitter(cut=cut, reconstruct=reconstruct).tokenize(text) == tokens


def test_charsmap_vectors(spark):
    assert column(spark, ["①②③"], lambda c: normalize(c, "NMT_NFKC")) == ["123"]
    assert column(spark, ["HELLO", None], lambda c: normalize(c, "NFKC_CF")) == ["hello", None]
    rules = CharsMap({"a": "x", "ab": "yz", "ab c": "q"}, "custom")
    assert normalize_offsets(b"abab cd", rules) == ("yzqd".encode(), [0, 0, 2, 6, 7])
    again = CharsMap.from_blob(rules.to_blob())
    assert (again.rules, again.name) == (rules.rules, rules.name)


def test_offsets(spark):
    got = column(spark, [" a  b "], normalize_with_offsets)[0]
    assert got["text"] == "a▁b"
    assert got["offsets"] == [1, 2, 2, 2, 4, 5]


def test_invalid_utf8():
    assert cp.replace_invalid(b"\xed\xa0\x80a\xc3") == "���a�"
    assert cp.decode("é中🙂".encode()) == [0xE9, 0x4E2D, 0x1F642]
    assert cp.encode([0xE9, 0x4E2D]) == "é中".encode()
    assert not cp.is_valid(b"\xff")
    assert [cp.char_length(x) for x in (0x41, 0x80, 0xC3, 0xE4, 0xF0)] == [1, 1, 2, 3, 4]


@pytest.mark.parametrize(("kind", "value"), [("f", 1.5), ("d", 2.25), ("h", -3), ("i", 7), ("q", 1 << 40)])
def test_scalar_bytes(kind, value):
    b = cp.encode_pod(kind, value)
    assert cp.decode_pod(kind, b) == value
    assert cp.decode_pod(kind, b + b"x") is None


@given(st.binary(max_size=40))
def test_escape_round_trip(b):
    s = cp.escape(b)
    assert not set("\t\n\r") & set(s)
    assert cp.unescape(s) == b


@settings(max_examples=300)
@given(st.text(alphabet="ab'1１中é。,▁ \t\n🙂়﻿", max_size=30))
def test_split_keeps_all(t):
    for cut in (0, 1):
        assert "".join(split_python(t, cut)) == t


def test_jvm_and_python_split_agree(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abZ'19１中国é。,.▁ \t🙂̀ߟ؀ࡠ") for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for cut in (0, 1):
        assert column(spark, texts, lambda c, cut=cut: tx.split_text(c, cut)) == [split_python(t, cut) for t in texts]
    plain = column(spark, texts, tx.normalize)
    assert plain == [normalize_offsets(t.encode(), CharsMap())[0].decode() for t in texts]


def test_text_helpers(spark):
    assert column(spark, ["# T\n\n a \t b\n## U v\nc"], tx.clean_text) == ["a b c"]
    assert column(spark, ["A b. C d!Ok? 你好。再见"], tx.split_sentences) == [["A b.", "C d!Ok?", "你好。", "再见"]]
    assert column(spark, ["漢字x"], lambda c: tx.simplify_chinese(c, {"漢": "汉"})) == ["汉字x"]
    assert column(spark, ["ab", "a", "a1"], tx.is_english_token) == [True, False, False]
    assert column(spark, ["<0x0A>", "<0xFF>", "<0xfg>", ""], tx.piece_to_byte) == [10, 255, -1, -1]


def test_white_space_of_all_scripts(spark):
    """As Python's own patterns and str.strip see it."""
    import re

    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    rng = random.Random(8)
    texts = ["".join(rng.choice([*spaces, "a", "#", ".", "!", "\u3002", "\n", "b", "\u200b"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]

    def cleaned(t):
        return re.sub(r"\s+", " ", re.sub(r"^#+\s+.*$", "", t, flags=re.MULTILINE).strip())

    def sentences(t):
        out = []
        for line in re.split("[\r\n]", t):
            at = 0
            for m in re.finditer(r"[\u3002\uff01\uff1f]|[.!?](?=\s|$)", line):
                out.append(line[at : m.end()].strip())
                at = m.end()
            out.append(line[at:].strip())
        return [x for x in out if x]

    assert column(spark, texts, tx.clean_text) == [cleaned(t) for t in texts]
    assert column(spark, texts, tx.split_sentences) == [sentences(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB 1\u2460\uff21\u00e9e\u0301\u00df\u3000\t\u4e2d\ufb01", max_size=12), st.booleans(), st.sampled_from(["NFKC", "NMT_NFKC", "NFKC_CF", "NMT_NFKC_CF", "no"]))
def test_whole_string_normalisation_equals_the_one_with_offsets(t, reconstruct, name):
    from sparkloom.functions.charsmap import normalize_text

    m = CharsMap.named(name)
    assert normalize_text(t, m, reconstruct) == normalize_offsets(t.encode(), m, reconstruct)[0].decode()


def test_maps_with_too_many_prefixes(spark):
    CharsMap({"a" * n: "b" for n in range(1, 33)})
    with pytest.raises(ValueError, match="32"):
        CharsMap({"a" * n: "b" for n in range(1, 34)})
    m = CharsMap({"x": "y", "ab": ""})
    assert CharsMap.from_table(m.to_table(spark)).rules == m.rules


@pytest.mark.parametrize("reconstruct", [False, True])
def test_rules_over_whole_texts_equal_the_steps(reconstruct, monkeypatch):
    """Rules that overlap, that give or take spaces, and that give nothing; only a target with two spaces goes step by step."""
    import random

    from sparkloom.functions import charsmap

    rng = random.Random(3)
    rules = {"th": "T", "the": "D", "e": "3", "er": "R", "x": "", "y": " ", " z": "q ", "é": "▁", "": "never", ".": "a.b"}
    texts = ["".join(rng.choice(["th", "e", "r", " ", "x", "y", " z", "é", ".", "▁", "a"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    for m in (CharsMap(rules), CharsMap(rules | {"a": "b  c"})):
        want = [normalize_offsets(t.encode(), m, reconstruct)[0].decode() for t in texts]
        assert [charsmap.normalize_text(t, m, reconstruct) for t in texts] == want
    monkeypatch.setattr(charsmap, "normalize_offsets", None)
    assert charsmap.normalize_text("the other", CharsMap(rules), reconstruct) == "D▁oDr"
