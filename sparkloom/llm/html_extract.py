"""Operator 7: main text of web pages by two-pass block rules.

Pass 1 labels each block by itself (Pomikalek's rules): bad if more than ``LINKS`` of its characters
are in links; short if under ``LOW`` characters (bad if it then has any link); good if its stop-word
density reaches ``STOP_HIGH`` and it has over ``HIGH`` characters; near good if the density reaches
``STOP_LOW``; otherwise bad. Pass 2: short and near-good blocks inherit from the nearest decided block
on each side (the edges of the page count as bad): both alike, that label; else the nearer one's, and
at equal distance good for near-good and bad for short blocks.

The stop words are those of 14 languages together. In blocks that are mostly Chinese or Japanese, the density is
twice the share of function characters. In blocks mostly of a script without a list (Thai, Hindi, Korean and
others) there is no density to test: over ``HIGH`` characters with a sentence mark are good, the rest near good.

Defined results: a null or empty page has no block and empty text; unclosed tags, scripts and
comments run to the end of the page; any tag name is a tag, custom (my-tag) and namespaced (o:p) ones
are inline; a link that is never closed runs on; text inside head, script, style, noscript, template, svg
and comments is no block; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, ship

LINKS, LOW, HIGH, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.12, 0.2
_STOP = """
the of and to a in is that it for was on are as with be by this or from at an not have has but which they you we his her had were been their
der die das und in den von zu mit ist auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war nur oder aber vor zur bis mehr durch man
le la les de des du et en un une est que qui dans pour pas au aux sur par ce il elle ne se plus avec sont son ou mais comme leur été cette
el los las y en que un una por con no para es se lo su al más como pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde
"""
_STOP += """
il di che e è per un in una sono con non si da come le al più del della nel alla ma anche gli lo questo dei delle
o de que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das à seu sua ou ser quando muito há nos já está eu também
het een van en dat te zijn op met voor niet aan er om ook dan maar bij nog naar heeft uit zo wordt
och att det som en på är av för med den till inte har de ett om han men var jag sig från vi så kan när år
i w nie na się że do to jest z co jak ale po tym od przez za dla są tak już być oraz
ve bir bu da de için ile çok daha olarak gibi var ne sonra kadar olan en ama her değil
και το η ο να της την του με για που από είναι δεν στο θα τα οι στην ένα
и в не на что я с он как это по но они к у из за от так же вы мы то все она для бы был его до или о при
و في من على أن إلى هذا التي الذي عن مع كان ما لا هو هي أو قد كل بعد
ו של את על לא הוא זה עם כי גם היא אני יש או כל מה אם
"""
STOP_WORDS = frozenset(_STOP.split())
FUNCTION_CHARACTERS = frozenset("的了是在和有不这我他人们个来就也说地到你得着都之会对の は に を た が で て と し れ さ る も な い".replace(" ", ""))
BLOCK_TAGS = "address|article|aside|blockquote|body|br|canvas|caption|center|col|colgroup|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|legend|li|main|nav|ol|optgroup|option|p|pre|section|summary|table|tbody|td|textarea|tfoot|th|thead|tr|ul"
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)", re.I | re.S)
_REST = r"(?:[\s/](?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*>))*)?>"
_OPENS = re.compile(rf"<a{_REST}", re.I)
_CLOSES = re.compile(rf"</a{_REST}", re.I)
_BREAKS = re.compile(rf"</?(?:{BLOCK_TAGS}){_REST}", re.I)
_OTHERS = re.compile(rf"</?[a-zA-Z][a-zA-Z0-9:._-]*{_REST}")
# marks that stand for tags while a page is cut; they are taken out of pages first
OPEN, CLOSE, BREAK = "\ue000", "\ue001", "\ue002"
_MARKS = re.compile(r"[\ue000-\ue002]|&#(?:[xX]0*[eE]00[012]|0*5734[456])(?![0-9a-fA-F]);?")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_LISTED = re.compile(r"[A-Za-z\u00aa-\u024f\u0370-\u052f\u0590-\u06ff\u1e00-\u1fff]+")
_SENTENCE = re.compile(r"[.!?\u0964\u061f\u17d4\u3002\uff01\uff1f]")


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, characters in links) of each block with text, in order. A page is cut by whole-page patterns, not tag by tag."""
    html = _SKIPPED.sub("", _MARKS.sub("", html))
    html = _OTHERS.sub("", _BREAKS.sub(BREAK, _CLOSES.sub(CLOSE, _OPENS.sub(OPEN, html))))
    if "&" in html:
        html = unescape(html)
    out: list[tuple[str, int]] = []
    linked = False
    for part in html.split(BREAK):
        links = 0
        if linked or OPEN in part or CLOSE in part:
            pieces = []
            for k, piece in enumerate(part.replace(CLOSE, OPEN + CLOSE).split(OPEN)):
                if k:
                    linked = not piece.startswith(CLOSE)
                piece = piece.removeprefix(CLOSE)
                pieces.append(piece)
                if linked:
                    links += len("".join(piece.split()))
            part = "".join(pieces)
        text = " ".join(part.split())
        if text:
            out.append((text, links))
    return out


def density_of(text: str) -> float | None:
    """Share of stop words, or twice that of function characters; None where no list fits the script."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0.0
    letters = 0 if text.isascii() else sum(map(len, words))
    if letters and 2 * sum(map(len, _LISTED.findall(text))) < letters:
        cjk = _CJK.findall(text)
        if 2 * len(cjk) < letters:
            return None
        return min(1.0, 2 * sum(c in FUNCTION_CHARACTERS for c in cjk) / len(cjk))
    return len([w for w in words if w in STOP_WORDS]) / len(words)


def first_label(text: str, links: int) -> str:
    size = len(text)
    share = links / max(1, size - text.count(" "))
    if share > LINKS or "\xa9" in text:
        return "bad"
    if size < LOW:
        return "bad" if links else "short"
    density = density_of(text)
    if density is None:
        return "good" if size > HIGH and _SENTENCE.search(text) else "near"
    if density >= STOP_HIGH:
        return "good" if size > HIGH else "near"
    return "near" if density >= STOP_LOW else "bad"


def final_labels(labels: list[str]) -> list[bool]:
    """Whether each block is kept."""
    n = len(labels)
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    out, k = [], 0
    for i, label in enumerate(labels):
        while k < len(decided) and decided[k] < i:
            k += 1
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        before, after = (decided[k - 1] if k else -1), (decided[k] if k < len(decided) else n)
        left, right = before >= 0 and labels[before] == "good", after < n and labels[after] == "good"
        if left == right:
            out.append(left)
        elif i - before != after - i:
            out.append(left if i - before < after - i else right)
        else:
            out.append(label == "near")
    return out


def extract(html: str | None) -> tuple[str, int, int]:
    """(main text with a line for each kept block, blocks, kept blocks)."""
    found = blocks(html or "")
    keep = final_labels([first_label(*b) for b in found])
    kept = [t for (t, _), k in zip(found, keep) if k]
    return "\n".join(kept), len(found), len(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of each of ``pages(page_id, html)``: page_id, text, n_blocks, n_kept."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for a in range(0, n, 256):
                part = batch.slice(a, 256)
                rows = [extract(x.as_py()) for x in part.column(1)]
                text, total, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(total, pa.int32()), pa.array(kept, pa.int32())], names=["page_id", "text", "n_blocks", "n_kept"])

    return pick(pages, "page_id", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_blocks int, n_kept int")
