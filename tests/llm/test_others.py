"""Operators 1, 3, 4, 6, 7, 8, 10."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import decontaminate, html_extract, knn, langid, lm_scoring, packing, toxicity
from sparkloom.llm._tokens import Words, normal_mask, string_buffers

from .conftest import prose


def texts_of(df):
    """doc_id -> text by position, as a clashing column may be called TEXT."""
    return {r[0]: r[1] for r in df.toDF(*[f"c{i}" for i in range(len(df.columns))]).collect()}


# 3: decontamination


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(501, 30)), (2, "Five little Words, only HERE"), (3, "too short item"), (4, None), (5, ""), (6, prose(501, 30)), (None, prose(502, 12))]
    return spark.createDataFrame(items, "item_id long, text string")


def contaminated_rows():
    item = prose(501, 30)
    return [
        (1, prose(1, 100) + "\n" + item.upper().replace(" ", " — ") + "\n" + prose(2, 90)), (2, item), (3, prose(3, 60)), (4, "say five, little: words only here! " + prose(4, 40)),
        (5, " ".join(item.split()[:7]) + " " + prose(5, 50)), (6, " ".join(item.split()[3:11]) + " " + prose(6, 50)), (7, None), (8, ""), (9, "too short item"), (None, prose(502, 12) + " " + prose(9, 50)),
    ]


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_GRAMS, 3])
def test_contamination(make, bench, limit):
    docs = make(contaminated_rows())
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench, max_broadcast_grams=limit).collect()), key=str)
    assert got == sorted([(1, 100, 130, 23, 1, "span"), (2, 0, 30, 23, 1, "document"), (4, 1, 6, 1, 2, "span"), (6, 0, 8, 1, 1, "span"), (None, 0, 12, 5, None, "span")], key=str)
    out = decontaminate.decontaminate(docs, bench, max_broadcast_grams=limit)
    assert out.columns == docs.columns
    new, old = texts_of(out), dict(contaminated_rows())
    assert 2 not in new
    assert new[1] == prose(1, 100) + "\n" + prose(2, 90)
    assert new[4] == "say " + prose(4, 40)
    assert new[6] == prose(6, 50)
    assert new[None] == prose(9, 50)
    assert all(new[i] == old[i] for i in (3, 5, 7, 8, 9))


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_GRAMS, 0])
def test_contamination_of_nothing(make, bench, edge, limit):
    """Empty tables and edge cases, with the set broadcast and with the shuffled join."""
    many = {"max_broadcast_grams": limit}
    assert decontaminate.contamination(make([]), bench, **many).count() == 0
    assert decontaminate.decontaminate(make([]), bench, **many).count() == 0
    none = bench.where("false")
    assert decontaminate.contamination(edge, none, **many).count() == 0
    assert decontaminate.decontaminate(edge, none, **many).count() == edge.count()
    assert decontaminate.decontaminate(edge, bench, **many).count() == edge.count()
    long = make([(1, prose(5, 30_000) + " " + prose(501, 30)), (1, prose(5, 30_000) + " " + prose(501, 30)), (2, None), (3, ""), (None, "x" * 200_000)])
    got = [(r["doc_id"], r["start_token"], r["end_token"], r["n_hits"]) for r in decontaminate.contamination(long, bench, **many).collect()]
    assert got == [(1, 30_000, 30_030, 23)] * 2
    assert decontaminate.decontaminate(long, bench, **many).count() == 5


# 4: packing


def brute_cost(sizes, ends, capacity, truncation, split):
    best = [0] + [math.inf] * len(sizes)
    for j in range(1, len(sizes) + 1):
        for i in range(j):
            s = sum(sizes[i:j])
            c = capacity - s if s <= capacity else truncation * (s - capacity)
            best[j] = min(best[j], best[i] + c + (0 if ends[j - 1] else split))
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 25)
        sizes, ends = [rng.randint(1, 14) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        ends[-1] = True
        capacity, truncation, split = rng.randint(3, 25), rng.choice([1, 2, 8]), rng.choice([0, 2, 5])
        i = cost = 0
        for j in packing.best_cuts(sizes, ends, capacity, truncation, split):
            s = sum(sizes[i:j])
            cost += (capacity - s if s <= capacity else truncation * (s - capacity)) + (0 if ends[j - 1] else split)
            i = j
        assert i == n
        assert cost == brute_cost(sizes, ends, capacity, truncation, split)


def test_packing_keeps_words_and_order(make, edge):
    rows = [(i, prose(i, 3 + 37 * i % 200)) for i in range(40)] + [(None, "lost one. Two"), (70, None), (71, ""), (72, "w " * 300), (600, "next stream")]
    out = packing.pack(make(rows), capacity=64).orderBy("stream", "window").collect()
    cut = sum(r["truncated"] for r in out)
    texts = dict(rows)
    total = sum(len((t or "").split()) for _, t in rows)
    assert sum(r["n_tokens"] for r in out) + cut == total
    for r in out:
        assert r["n_tokens"] + r["padding"] == 64
        assert r["text"].split() == [w for d, a, b in zip(r["doc_ids"], r["starts"], r["ends"]) for w in texts[d].split()[a:b]]
    ids = [d for r in out for d in r["doc_ids"]]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert {r["stream"] for r in out} == {0}
    assert packing.pack(make([])).count() == 0
    wide = packing.pack(edge).collect()
    assert sum(r["n_tokens"] + r["truncated"] for r in wide) == sum(len((r["text"] or "").split()) for r in edge.toDF(*["doc_id", "text", *[f"c{i}" for i in range(8)]]).collect())


def test_streams_follow_the_mass_of_the_text(make, spark):
    """Any values of doc_id pack alike; a doc_id, or none, of a third of all rows is spread over streams."""
    rng = random.Random(4)
    texts = [prose(i, 40) for i in range(120)]
    hashed = [rng.randrange(-(1 << 62), 1 << 62) for _ in texts]
    windows = {}
    for name, ids in (("dense", list(range(120))), ("hashed", sorted(hashed)), ("one", [i if i % 3 else 7 for i in range(120)]), ("none", [i if i % 3 else None for i in range(120)])):
        rows = list(zip(ids, texts))
        rng.shuffle(rows)
        docs = make(rows + rows[:1] * 40)
        out = packing.pack(docs.repartition(5), capacity=64, stream_bytes=4000).orderBy("stream", "window").collect()
        seen = [d for r in out for d in r["doc_ids"]]
        assert seen == sorted(seen, key=lambda i: (i is None, i or 0))
        assert sorted(w for r in out for w in r["text"].split()) == sorted(w for _, t in rows + rows[:1] * 40 for w in t.split())
        by = {}
        for r in out:
            by[r["stream"]] = by.get(r["stream"], 0) + len(r["text"])
        assert len(by) > 5
        assert max(by.values()) < 6000
        windows[name] = len(out)
    assert max(windows.values()) - min(windows.values()) <= 4


def test_every_word_is_in_one_window(make):
    rows = [(1, prose(1, 50)), (2, " ".join(f"w{i}" for i in range(300)) + " the end. One more."), (3, prose(3, 90)), (4, " ".join(f"v{i}" for i in range(129))), (5, prose(5, 400))]
    out = packing.pack(make(rows), capacity=64).orderBy("window").collect()
    assert [w for r in out for w in r["text"].split()] == [w for _, t in rows for w in t.split()]
    assert all(r["truncated"] == 0 and r["n_tokens"] == len(r["text"].split()) <= 64 for r in out)


def test_cuts_without_overflow_are_optimal():
    rng = random.Random(18)
    for _ in range(300):
        n = rng.randint(1, 25)
        sizes, ends, inside = [rng.randint(1, 9) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]
        capacity, truncation, split = rng.randint(9, 25), rng.choice([1, 2, 8]), rng.choice([0, 2, 5])
        price = [(0 if e else split) + (truncation if x else 0) for e, x in zip(ends, inside)]
        best = [0] + [math.inf] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + capacity - sum(sizes[i:j]) + price[j - 1] for i in range(j) if sum(sizes[i:j]) <= capacity)
        i = cost = 0
        for j in packing.best_cuts(sizes, ends, capacity, truncation, split, inside):
            assert sum(sizes[i:j]) <= capacity
            cost += capacity - sum(sizes[i:j]) + price[j - 1]
            i = j
        assert i == n
        assert cost == best[-1]


def test_sentences():
    text = "One two. Three\nfour five！ six? seven"
    raw, off = string_buffers(pa.array([text, "", "a b"]))
    w = Words(raw, off)
    assert packing.sentence_ends(w).tolist() == [False, True, True, False, True, True, True, False, True]


# 6: nearest neighbours


@pytest.mark.parametrize(("shard_rows", "every", "nearest", "max_queries"), [(10_000, 1, 4, 1000), (40, 1, 4, 1000), (12, 3, 2, 20)])
def test_top_k_is_exact(spark, shard_rows, every, nearest, max_queries):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1, (60, 5)) for c in (0, 3, 9)])
    x[5] = x[6] = x[7]
    x[60:90] = x[60]  # more equal vectors than neighbours
    x[100] = [0.0] * 5
    x[101] = [-0.0] * 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6, x[6].tolist()), (None, x[9].tolist()), (900, None), (901, []), (902, [1.0, None, 2.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [1.0, 2.0]), (905, [1.5, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in rows], "vec_id long, embedding array<double>, shard int, VEC_ID string")
    got = [tuple(r) for r in knn.top_k(df, 4, shard_rows, every, nearest, max_queries).collect()]
    live = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for a, (i, v) in enumerate(live):
        if i is None or i % every:
            continue
        others = sorted((round(float(((v - u) ** 2).sum()), 12), j is None, j or 0, j) for b, (j, u) in enumerate(live) if a != b and len(u) == len(v))
        want += [(i, r + 1, o[3], round(math.sqrt(o[0]), 6)) for r, o in enumerate(others[:4])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert knn.top_k(df.where("false")).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    tree = knn.Tree(x, 32)
    seen = []
    gap = tree.lo.copy()
    assert (tree.hi >= gap).all()
    rows = tree.order[:16]
    norm = tree.norm
    tree.norm = type("N", (), {"max": norm.max, "__getitem__": lambda s, at: (seen.append(len(at)), norm[at])[1]})()
    tree.search(x[rows], np.arange(len(x)), np.arange(len(x)), 3, np.full(len(rows), np.inf))
    assert sum(seen) < 800


# 7: pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a href=y>More of the news</a></nav>
<script>var t="</p><p>the script is not text";</script><!-- <p>the comment</p> --><h1>A title of it</h1><p>{long}</p><p>It is a short one.</p><p>{long} &amp; more</p>
<div>Short at the foot</div><footer>&copy; example</footer></body></html>"""
LONG = "the story of a man who was in the house and it is for you that he has gone " * 4


def test_blocks_and_labels():
    text, n, kept = html_extract.extract(PAGE.replace("{long}", LONG))
    lines = text.split("\n")
    assert n == 7
    assert lines == [LONG.strip(), "It is a short one.", LONG.strip() + " & more"] if kept == 3 else lines[0] == "A title of it"
    assert "script" not in text
    assert "comment" not in text
    assert html_extract.first_label("x" * 300, 0) == "bad"
    assert html_extract.first_label("the one", 3) == "bad"
    assert html_extract.first_label("the one", 0) == "short"


def test_blocks_equal_a_parser():
    """Blocks, their texts and characters in links against the standard library's parser, on random nested pages."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.parts, self.links, self.a, self.skip = [], [], 0, False, 0

        def close_block(self):
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append((text, self.links))
            self.parts, self.links = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head", "svg")
            self.a = self.a or tag == "a"
            if not self.skip and tag in html_extract.BLOCK_TAGS.split("|"):
                self.close_block()

        def handle_endtag(self, tag):
            if not self.skip and tag in html_extract.BLOCK_TAGS.split("|"):
                self.close_block()
            self.skip -= tag in ("script", "style", "head", "svg")
            if tag == "a":
                self.a = False

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)
                if self.a:
                    self.links += len("".join(data.split()))

    rng = random.Random(31)

    def node(depth):
        if depth == 0 or rng.random() < 0.35:
            return rng.choice(["plain words here ", "a &lt;b&gt; &amp; c ", "é 中文 ", " ", "x<br>y", "<!-- no <p> -->", "<script>if (a<b) c()</script>", "1 > 0 "])
        tag = rng.choice(["p", "div", "a", "b", "span", "li", "o:p", "my-tag", "H2", "td"])
        attrs = rng.choice(["", " class=x", ' title="a > b"', " data-a='<p>'", ' href="/q?a=1"'])
        return f"<{tag}{attrs}>" + "".join(node(depth - 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"

    for _ in range(600):
        html = "<html><head><title>t</title></head><body>" + "".join(node(4) for _ in range(4)) + "</body></html>"
        reader = Reader()
        reader.feed(html)
        reader.close()
        reader.close_block()
        assert html_extract.blocks(html) == reader.out, html


def test_first_labels_equal_brute_force():
    rng = random.Random(32)
    for _ in range(500):
        words = [rng.choice(["the", "of", "und", "la", "blorf", "snark", "zwick", "42"]) for _ in range(rng.randint(1, 70))]
        text, links = " ".join(words), rng.choice([0, 0, 3, 40])
        real = [w for w in words if w != "42"]
        density = sum(w in ("the", "of", "und", "la") for w in real) / len(real) if real else 0
        if links / len("".join(words)) > 0.2:
            want = "bad"
        elif len(text) < 70:
            want = "bad" if links else "short"
        elif density >= 0.2:
            want = "good" if len(text) > 200 else "near"
        else:
            want = "near" if density >= 0.12 else "bad"
        assert html_extract.first_label(text, links) == want


def test_other_languages_and_tags():
    kept = lambda body: html_extract.extract(f"<html><body><nav><a href=x>{'link ' * 20}</a></nav><p>{body}</p></body></html>")[0]
    for body in (
        "他说这是一个很好的故事，我们在家里看了很久，也有人不同意。" * 9, "これはとても長い話で、彼はその家に住んでいたと言われています。" * 8, "она сказала что это не так и мы все были в доме на горе для того чтобы он не был один. " * 4,
        "यह एक लंबी कहानी है और हम सब घर में थे। " * 9, "이것은 아주 긴 이야기이고 우리는 모두 집에 있었다. " * 9,
    ):
        assert kept(body) == body.strip()
    assert kept("中文链接目录首页产品") == ""
    assert html_extract.blocks("<p>hello <o:p>x</o:p> <my-tag a=1>y</my-tag> 2 < 3</p>") == [("hello x y 2 < 3", 0)]
    assert html_extract.blocks("a&#xE002;b\ue002c") == [("abc", 0)]


def test_context_labels_equal_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        labels = [rng.choice(["good", "bad", "short", "near"]) for _ in range(rng.randint(0, 9))]
        want = []
        for i, x in enumerate(labels):
            if x in ("good", "bad"):
                want.append(x == "good")
                continue
            left = next(((i - j, labels[j]) for j in range(i - 1, -1, -1) if labels[j] in ("good", "bad")), (i + 1, "bad"))
            right = next(((j - i, labels[j]) for j in range(i + 1, len(labels)) if labels[j] in ("good", "bad")), (len(labels) - i, "bad"))
            if left[1] == right[1]:
                want.append(left[1] == "good")
            elif left[0] != right[0]:
                want.append(min(left, right)[1] == "good")
            else:
                want.append(x == "near")
        assert html_extract.final_labels(labels) == want


def test_pages_of_all_kinds(spark):
    pages = [(1, "u", PAGE.replace("{long}", LONG)), (2, "u", None), (3, None, ""), (3, None, ""), (4, "u", "<p" * 1000), (5, "u", "<script>" + "x" * 100_000), (None, "u", "<b>" * 5000 + LONG * 100), (6, "u", LONG)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, HTML string")
    got = html_extract.main_text(df).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] == by[3]["text"] == by[5]["text"] == ""
    assert by[6]["n_kept"] == by[None]["n_kept"] == 1
    assert html_extract.main_text(df.where("false")).count() == 0


# 8: toxicity


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = ("scum", "idiot", "loser", "moron", "stupid", "trash", "worthless", "disgusting", "dégoûté", "абвгдежзи")
LEXICON = toxicity.Lexicon(TERMS, frozenset({"loses"}), frozenset({"trash"}))


def test_automaton_equals_levenshtein():
    rng = random.Random(6)
    words = set()
    for t in TERMS:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcidstéгя1")
                w[k : k + rng.randint(0, 1)] = rng.choice([[c], []])
            words.add("".join(w) or "x")
    words = sorted(words)
    raw, off = string_buffers(pa.array([" ".join(words)]))
    hit, term, cost = toxicity.match(Words(raw, off, normal_mask(raw)), toxicity.automaton(TERMS))
    got = {words[h]: (int(k), int(t)) for h, t, k in zip(hit, term, cost)}
    want = {}
    for w in words:
        best = min(((e, i) for i, t in enumerate(TERMS) if (e := levenshtein(w, t)) <= toxicity.edits_of(t)), default=None)
        if best:
            want[w] = best
    assert got == want


def test_toxic_documents(make, edge):
    rows = [
        (1, "what an idiot and a moron you are"), (2, prose(1, 300)), (3, "a stupd lady and a stupd man"), (4, 'he was "an idiot" she said of the word'), (5, "he loses and loses, she loses"), (6, prose(2, 900) + " scum " + prose(3, 900)),
        (7, "one stupd thing"), (None, "disgusting worthless scum"), (8, None), (9, ""), (1, "what an idiot and a moron you are"), (10, "trash it"), (11, "trash, stupd trash"), (12, "un DÉGOÛTÉ dégouté"), (13, "stupd " + "x " * 250 + " stupd"),
    ]
    got = [(r["doc_id"], r["n_hits"], r["n_misspelled"], r["n_quoted"]) for r in toxicity.toxic_documents(make(rows), LEXICON).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 0, 0), (1, 2, 0, 0), (3, 2, 2, 0), (6, 1, 0, 0), (None, 3, 0, 0), (11, 3, 1, 0), (12, 2, 1, 0)], key=str)
    assert toxicity.toxic_documents(edge, LEXICON).count() == 0
    assert toxicity.toxic_documents(make([]), LEXICON).count() == 0
    assert toxicity.toxic_documents(make(rows), toxicity.Lexicon(())).count() == 0


def invented(seed, n, toxic, terms):
    """Texts of random syllables; toxic ones hold some of the terms."""
    rng = random.Random(seed)
    out = ["".join(rng.choice("ba ce di fo gu la me ni po ru sa té vi".split()) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    for _ in range(4 * toxic):
        out[rng.randrange(n)] = rng.choice(terms)
    return " ".join(out)


def labelled_corpus(spark):
    terms = {"en": ["blorf", "snarkle", "grumpfish"], "fr": ["zwéquille", "zwéquette"]}
    docs, labels = [], []
    for i in range(400):
        lang, toxic = ("en", "fr")[i % 2], int(i % 7 == 0)
        copy = invented(0, 80, 1, ["blorf"]) if i % 70 == 0 else None  # copies prove nothing
        docs.append((i, copy or invented(i, 80, toxic, terms[lang]), lang, 1))
        labels.append((i, 1, toxic, "x"))
    docs += [(None, "blorf", "en", 1), (900, None, "en", 1), (901, "", None, 1), (902, "blorf here", None, 1)]
    labels += [(None, 1, 1, "x"), (900, 1, 1, "x"), (901, 1, None, "x"), (950, 1, 1, "x"), (3, 1, 2, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, word int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, TEXT string"), terms


def test_lexicon_is_learned_and_holds_on_other_rows(spark):
    docs, labels, terms = labelled_corpus(spark)
    lex = toxicity.learn(docs.where("doc_id is null or doc_id < 300 or doc_id > 800"), labels)
    assert lex.terms == tuple(sorted(t for x in terms.values() for t in x))
    held = docs.where("doc_id >= 300 and doc_id < 800")
    found = {r["doc_id"] for r in toxicity.toxic_documents(held, lex).collect()}
    assert found == {r["doc_id"] for r in labels.where("toxic = 1 and doc_id >= 300 and doc_id < 800").collect()}
    # the bound on rows, and nothing to learn from
    assert toxicity.labelled(docs, labels, 10).groupBy("lang", "toxic").count().where("count > 10").count() == 0
    assert toxicity.learn(docs, labels.where("false")) == toxicity.Lexicon(())
    assert toxicity.learn(docs.where("false"), labels) == toxicity.Lexicon(())
    assert toxicity.learn(docs, labels.where("toxic = 0")) == toxicity.Lexicon(())


def test_evidence_equals_brute_force(spark):
    docs, labels, _ = labelled_corpus(spark)
    rows = toxicity.labelled(docs, labels)
    want = {}
    for r in rows.collect():
        words = (r["text"] or "").lower().split()
        for before, w in zip(["", *words], words):
            if len(w) >= toxicity.LETTERS:
                want.setdefault((r["lang"], w), set()).add((r["toxic"], before))
    got = {(r["lang"], r["word"]): (r["t"], r["c"]) for r in toxicity.word_evidence(rows).collect()}
    assert got == {k: (sum(t for t, _ in v), sum(1 - t for t, _ in v)) for k, v in want.items()}


def test_quotation_lowers_the_score():
    def rate(text):
        raw, off = string_buffers(pa.array([text]))
        w = Words(raw, off, normal_mask(raw))
        hit, _, cost = toxicity.match(w, toxicity.automaton(TERMS))
        return toxicity.context_score(w, int(hit[0]), 0, len(w.starts), 0, len(raw), int(cost[0]))

    assert rate("an idiot here") == (10_000, False)
    assert rate('"an idiot" here') == rate("“an idiot” here") == rate("«idiot»") == rate("in 'such idiot' here") == (2_500, True)
    assert rate("don't idiot don't") == (10_000, False)
    assert rate('"a" idiot "b"') == (10_000, False)
    assert rate("you idiot") == (15_000, False)
    assert rate('she said "idiot" of it') == (1_250, True)


def test_stretch_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        at = sorted(rng.sample(range(900), rng.randint(1, 8)))
        hits = [(i, rng.randint(0, 2), rng.randint(0, 1), rng.choice([2500, 6000, 10000]), False) for i in at]
        best = max(sum(x[3] for x in hits if h[0] - toxicity.STRETCH < x[0] <= h[0]) for h in hits)
        assert toxicity.judge(hits) == best


# 1: languages

EN, DE = "the house of the man is in the old town and it was good ", "das haus von dem mann ist in der alten stadt und es war gut "


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        base = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(rng.choice(base) for _ in range(rng.randint(20, 90))), "en" if i % 2 else "de", f"src{i % 3}", 5, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, own int")


def test_language_of_documents_and_pages(spark, tongues):
    pages = spark.createDataFrame(
        [
            (1, "http://a.b.de/x", f"<html lang='de'><p>{DE * 3}</p></html>", 1), (2, "https://a.b.com:80/x?y", f"<html><script>{DE * 9}</script><p>{EN * 3}</p>", 1), (3, None, None, 1), (4, "x", "<p></p>", 1),
            (5, "http://a.b.de/", f"<html lang=de-AT>{EN * 5}", 1), (6, "http://a.b.de/z", "<p>12345 6789</p>", 1), (None, "", DE, 1),
        ],
        "page_id long, url string, html string, host int",
    )
    assert langid.identify(tongues, pages.where("false")).count() == tongues.count()
    assert langid.identify(tongues.where("false"), pages).where("lang <> 'und'").count() == 0
    got = langid.identify(tongues, pages)
    by = {r["page_id"]: r for r in got.where("kind = 'page'").collect()}
    assert [by[i]["lang"] for i in (1, 2, 3, 4, 5, 6, None)] == ["de", "en", "und", "und", "en", "und", "de"]
    assert not by[3]["accepted"]
    assert by[2]["accepted"]
    docs = {r["doc_id"]: r["lang"] for r in got.where("kind = 'document'").collect()}
    truth = {r["doc_id"]: r["lang"] for r in tongues.collect()}
    assert docs == truth


def test_every_language_is_fitted(spark, tongues):
    rare = [(1000 + i, "lo que hay en la casa del pueblo viejo era muy bueno " * 3, "es", "s", 0, 1) for i in range(3)]
    docs = tongues.union(spark.createDataFrame(rare, tongues.schema))
    m = langid.fit_documents(docs, 4)
    assert m["langs"] == ["de", "en", "es"]
    # the same as a fit on the least hashes of each language
    rows = docs.selectExpr("lang", "text", "xxhash64(doc_id) AS h").collect()
    least = [(r["lang"], r["text"]) for lang in m["langs"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["h"])[:4]]
    want = langid.fit(least)
    assert np.array_equal(m["logp"], want["logp"])
    assert np.allclose(m["least"], want["least"])
    kept = {r["doc_id"] for r in langid.filter_language(docs, 4).collect()}
    assert {1000, 1001, 1002} <= kept


def test_filter_language(make, tongues, edge, spark):
    odd = spark.createDataFrame([(100, None, "en", "s", 0, 1), (101, "", None, None, 0, 1), (102, "中文的句子没有别的文字" * 9, None, "s", 0, 1), (103, EN * 2000, None, None, 0, 1), (None, DE, "en", "s", 0, 1), (103, EN * 2000, None, None, 0, 1)], tongues.schema)
    out = langid.filter_language(tongues.union(odd))
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == tongues.columns
    assert sorted(kept, key=str) == sorted([*range(60), None, 103, 103], key=str)
    assert langid.filter_language(tongues.where("false")).count() == 0
    assert langid.filter_language(edge).columns == edge.columns


def test_held_out_accuracy(tongues):
    rows = [(r["lang"], r["text"]) for r in tongues.collect()]
    m = langid.fit(rows[:40])
    right = 0
    for lang, text in rows[40:]:
        t = langid.trigrams(np.frombuffer(text.encode(), np.uint8))
        right += m["langs"][int(m["logp"][:, t].sum(1).argmax())] == lang
    assert right == 20


def test_scores_equal_brute_force(tongues):
    m = langid.fit([(r["lang"], r["text"]) for r in tongues.collect()][:20])
    texts = {r["doc_id"]: r["text"] for r in tongues.collect()}
    for r in langid.scored(tongues.select("doc_id", "text"), m).collect():
        t = langid.trigrams(np.frombuffer(texts[r["doc_id"]].encode(), np.uint8))
        t = t[t != langid.NO_TRIGRAM]
        want = m["logp"][:, t].astype(np.float64).mean(1) * min(len(t), langid.EFFECTIVE)
        assert np.allclose(r["lls"], want)


def test_fused_posterior_equals_brute_force(spark, tongues):
    """Language, confidence and acceptance of every row, from the likelihoods and counts by Bayes' rule in plain loops."""
    rng = random.Random(12)
    m = langid.fit([(r["lang"], r["text"]) for r in tongues.collect()][:30])
    rows = []
    for i in range(150):
        base = rng.choice([EN, DE, EN + DE]).split()
        text = " ".join(rng.choice(base) for _ in range(rng.choice([1, 3, 40]))) if i % 20 else rng.choice([None, "", "12 34", "中文的句子没有别的文字"])
        rows.append((i, text, rng.choice([None, "en", "DE"]), rng.choice(["de", "com", "uk"]), rng.choice(["a.x.de", "b.x.de", "www.y.co.uk", "z.co.uk", None])))
    df = spark.createDataFrame(rows, "id long, text string, markup string, suffix string, host string")
    fit = {r["id"]: (r["lls"], r["fits"]) for r in langid.scored(df.select("id", "text"), m).collect()}
    domain = {"a.x.de": "x.de", "b.x.de": "x.de", "www.y.co.uk": "y.co.uk", "z.co.uk": "z.co.uk", "": ""}
    info = {i: ((mk or "").lower(), sx, h or "", domain[h or ""]) for i, _, mk, sx, h in rows}
    own = {}
    for i, (lls, fits) in fit.items():
        if lls is not None and fits and abs(lls[0] - lls[1]) >= langid.CLEAR:
            own[i] = lls.index(max(lls))
    kinds = [len({info[i][k] for i in own}) for k in range(2)]
    got = {r["id"]: r for r in langid.identified(df, m).collect()}
    assert len(got) == len(rows)
    for i, (lls, fits) in fit.items():
        if lls is None:
            assert (got[i]["lang"], got[i]["confidence"], got[i]["accepted"]) == ("und", 0.0, False)
            continue

        def n(k, lang, i=i):
            return sum(x == lang and (k is None or info[j][k] == info[i][k]) for j, x in own.items() if j != i)

        post = []
        for lang in range(2):
            p = (n(None, lang) + 1) / (n(None, 0) + n(None, 1) + 2)
            for k in (3, 2):
                p = (n(k, lang) + langid.STRENGTH * p) / (n(k, 0) + n(k, 1) + langid.STRENGTH)
            for k in range(2):
                p *= (n(k, lang) + 1) / (n(None, lang) + kinds[k] + 1)
            post.append(p * math.exp(lls[lang]))
        conf = max(post) / sum(post)
        assert got[i]["lang"] == m["langs"][post.index(max(post))]
        assert got[i]["confidence"] == pytest.approx(conf, abs=1e-4)
        assert got[i]["accepted"] == (fits and round(conf, 4) >= langid.ACCEPT)


# 10: language model


@pytest.fixture(scope="module")
def patterned(spark):
    """Texts with a strong order of words, for which a model of it beats unigrams."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        w, out = rng.randrange(30), []
        for _ in range(rng.randint(60, 120)):
            w = (w + 1) % 30 if rng.random() < 0.8 else rng.randrange(30)
            out.append(f"w{w}")
        rows.append((i, " ".join(out), "z"))
    return spark.createDataFrame(rows, "doc_id long, text string, word string")


OPTIONS = {"singles": 20, "groups": 9, "group_size": 4, "hashed": 7, "dim": 16, "rounds": 6, "batch": 128, "noise": 16, "rate": 0.3, "shard_tokens": 20_000}


def test_model_learns(spark, patterned):
    train, held = patterned.where("doc_id < 350").repartition(2).cache(), patterned.where("doc_id >= 350")
    m = lm_scoring.model(train, **OPTIONS)
    got = lm_scoring.score(held, m).agg({"log_prob": "sum", "n_tokens": "sum"}).first()
    cross = -got["sum(log_prob)"] / got["sum(n_tokens)"]
    assert cross < 0.85 * math.log(30)


def test_probabilities_are_normalised(patterned):
    m = lm_scoring.model(patterned.limit(50), **OPTIONS)
    p = np.exp(m["pair"][:, None, :] + m["skip"][None, :, :] - m["z"][:, :, None]).sum(2)
    assert np.allclose(p, 1, atol=1e-3)


def test_probabilities_are_normalised_over_words(spark):
    """Of all words after the same two words: known ones, rare ones and an unseen one in each hashed class."""
    rng = random.Random(4)
    texts = [" ".join(f"r{int(600 * rng.random() ** 3)}" for _ in range(50)) for _ in range(80)]
    n = {}
    for w in " ".join(texts).split():
        n[w] = n.get(w, 0) + 1
    m = lm_scoring.model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **OPTIONS)
    unseen = {}
    for i in range(1000):
        unseen.setdefault(lm_scoring.hash_of(f"new{i}") % 7, f"new{i}")
    words = [*n, *unseen.values()]
    for before in ("r0 r1 ", "r77 ", ""):
        rows = [(i, before + w) for i, w in enumerate(words)] + [(-1, before.strip())]
        got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
        assert len(got) == len(rows)
        assert sum(math.exp(got[i] - got[-1]) for i in range(len(words))) == pytest.approx(1, abs=2e-3)


def test_log_prob_equals_brute_force(spark, patterned):
    """log_prob of whole texts, token by token from the parameters."""
    texts = [r["text"] for r in patterned.orderBy("doc_id").limit(60).collect()]
    texts = [t + f" rare{i}" for i, t in enumerate(texts)]
    m = lm_scoring.model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **OPTIONS | {"singles": 8, "groups": 5})
    n = {}
    for w in " ".join(texts).split():
        n[w] = n.get(w, 0) + 1
    ranked = sorted(n, key=lambda w: (-n[w], lm_scoring.hash_of(w)))
    ranked = [w for w in ranked if n[w] > n[ranked[28]]]
    p, begin = m["p"], 8 + 5 + 7

    def class_of(w):
        if w in ranked:
            r = ranked.index(w)
            return r if r < 8 else 8 + (r - 8) // 4
        return 13 + lm_scoring.hash_of(w) % 7

    def token(w, v, u):
        q = p["c"][0] * p["R"][v] + p["c"][1] * p["R"][u]
        s = p["Q"] @ q + p["b"]
        out = s[class_of(w)] - np.log(np.exp(s).sum())
        if w in ranked[8:]:
            r = ranked.index(w) - 8
            s = p["W"][r // 4 * 4 : r // 4 * 4 + 4] @ q[: lm_scoring.INNER_DIM] + p["a"][r // 4 * 4 : r // 4 * 4 + 4]
            out += s[r % 4] - np.log(np.exp(s).sum())
        elif w not in ranked:
            same = [x for x in n if x not in ranked and class_of(x) == class_of(w)]
            out += math.log((n.get(w, 0) + 0.5) / (sum(n[x] for x in same) + 0.5 * (len(same) + 1)))
        return out

    asked = [*texts[:12], "w1 never seen w2", "w3"]
    got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), m).collect()}
    for i, text in enumerate(asked):
        ws = text.split()
        cs = [begin, begin, *map(class_of, ws)]
        assert got[i] == pytest.approx(sum(token(w, cs[k + 1], cs[k]) for k, w in enumerate(ws)), rel=1e-3)


def test_model_does_not_depend_on_the_split(spark, patterned):
    one = lm_scoring.train(patterned.coalesce(1).select("text"), lm_scoring.vocabulary(patterned.select("text"), 20, 9, 4, 7)[0], 8, 2, 128, 8, 4, 0.3, 5000)
    many = lm_scoring.train(patterned.repartition(7).select("text"), lm_scoring.vocabulary(patterned.select("text"), 20, 9, 4, 7)[0], 8, 2, 128, 8, 4, 0.3, 5000)
    assert all(np.array_equal(one[k], many[k]) for k in one)


def test_scores_of_edge_cases(make, edge):
    m = lm_scoring.model(edge.toDF(*["doc_id", "text", *[f"c{i}" for i in range(8)]]), **OPTIONS)
    plain = edge.toDF(*["doc_id", "text", *[f"c{i}" for i in range(8)]])
    rows = lm_scoring.score(plain, m).collect()
    assert len(rows) == edge.count()
    assert all((r["perplexity"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((r["text"] or "").split()) for r in plain.collect())
    none = make([])
    assert lm_scoring.lm_scores(none).count() == 0


def test_gradient_of_the_objective():
    rng = np.random.default_rng(0)
    voc = {"size": 12, "unigram": np.full(12, 1 / 12)}
    one, two, w, noise = (rng.integers(0, 12, n).astype(np.int32) for n in (5, 5, 5, 4))
    log_kp = np.log(4 * voc["unigram"]).astype(np.float32)

    def objective(p):
        q = p["c"][0] * p["R"][one] + p["c"][1] * p["R"][two]
        s = (q * p["Q"][w]).sum(1) + p["b"][w] - log_kp[w]
        f = q @ p["Q"][noise].T + p["b"][noise] - log_kp[noise]
        return -np.log1p(np.exp(-s)).sum() - np.log1p(np.exp(f)).sum()

    voc["inner"] = np.full((2, 4), 0.25)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.initial(voc, 3).items()}
    for name, at in (("R", (int(one[0]), 1)), ("Q", (int(w[0]), 2)), ("Q", (int(noise[0]), 0)), ("b", (int(w[1]),)), ("c", (1, 2))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (objective(up) - objective(down)) / 2e-5
        new = {k: v.astype(np.float32) for k, v in p.items()}
        g2 = {k: np.full(v.shape, 1e12, np.float32) for k, v in p.items()}
        lm_scoring.nce_step(new, g2, one, two, w, noise, log_kp, 64e6)
        step = (new[name][at] - p[name][at])
        assert step == pytest.approx(slope, rel=0.05, abs=2e-3)


def test_least_count(spark):
    rng = random.Random(3)
    for k in (1, 5, 40, 200, 500):
        n = [int(1.03 ** rng.randrange(300)) for _ in range(300)]
        got = lm_scoring.least_count(spark.createDataFrame([(f"w{i}", x) for i, x in enumerate(n)], "word string, n long"), k)
        want = next(t for t in sorted({0, *n}) if sum(x > t for x in n) <= k)
        assert got == want


def test_gradient_of_words_in_groups():
    rng = np.random.default_rng(1)
    voc = {"size": 6, "unigram": np.full(6, 1 / 6), "inner": np.full((3, 4), 0.25)}
    one, two = (rng.integers(0, 6, 5).astype(np.int32) for _ in range(2))
    w = rng.integers(0, 12, 5)
    noise = w[:, None] // 4 * 4 + rng.integers(0, 4, (5, 3))
    log_kp = np.log(3 * voc["inner"].ravel()).astype(np.float32)

    def objective(p):
        q = p["c"][0] * p["R"][one] + p["c"][1] * p["R"][two]
        q = q[:, : p["W"].shape[1]]
        s = (q * p["W"][w]).sum(1) + p["a"][w] - log_kp[w]
        f = np.einsum("nd,nkd->nk", q, p["W"][noise]) + p["a"][noise] - log_kp[noise]
        return -np.log1p(np.exp(-s)).sum() - np.log1p(np.exp(f)).sum()

    p = {k: v.astype(np.float64) for k, v in lm_scoring.initial(voc, 3).items()}
    for name, at in (("W", (int(w[0]), 1)), ("W", (int(noise[1, 0]), 0)), ("a", (int(w[2]),))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (objective(up) - objective(down)) / 2e-5
        new = {k: v.astype(np.float32) for k, v in p.items()}
        lm_scoring.inner_step(new, {k: np.full(v.shape, 1e12, np.float32) for k, v in p.items()}, one, two, w, noise, log_kp, 8e6)
        assert new[name][at] - p[name][at] == pytest.approx(slope, rel=0.05, abs=2e-3)
