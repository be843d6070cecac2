"""DuckDB SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from ._tokens import NORMAL_CLASS
from .toxicity import ADDRESS, CONTEXT, EDIT_POINTS, LETTERS, MARGIN, ODDS, QUOTES, REPORTING, SCORE, STRETCH, TERMS, UNIT

WORDS = r"string_split_regex({text}, '[ \t\n\r\f\x0B]+')"


def _words(text: str) -> str:
    return f"list_filter({WORDS.format(text=text)}, lambda x: x <> '')"


def _windows(n: int) -> str:
    return f"""t AS (SELECT doc_id, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM t WHERE len(w) >= {n})),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win),
rep AS (SELECT doc_id, p, r, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g WHERE n > 1)"""


GRAM_PARTS = "\n".join(
    f"{'UNION ALL ' if n > 5 else ''}SELECT {n} AS width, array_to_string(w[i:i + {n - 1}], ' ') AS gram, item_id FROM (SELECT item_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM items WHERE len(w) {'>=' if n == 8 else '='} {n})" for n in (5, 6, 7, 8)
)
HIT_PARTS = "\n".join(
    f"{'UNION ALL ' if n > 5 else ''}SELECT doc_id, {n} AS width, i - 1 AS p, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM docs WHERE len(w) >= {n} AND {n} IN (SELECT width FROM grams))" for n in (5, 6, 7, 8)
)

OTHER_CLASS = "[^" + NORMAL_CLASS[1:]
ACCENTS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"  # one byte for each, as levenshtein compares bytes; other letters are #


def _bytes(text: str) -> str:
    return f"regexp_replace(translate({text}, '{ACCENTS}', '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ!$%&()*'[: len(ACCENTS)]}'), '[^\\x00-\\x7F]', '#', 'g')"


def _strings(values: frozenset[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


QUOTED = " OR ".join(f"(contains(after, {_text(mark)}) AND regexp_matches(before, {_text(pattern)}))" for pattern, mark in QUOTES)

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": f"""WITH {_windows(50)}
SELECT doc_id, min(p)::INTEGER AS start_token, (max(p) + 50)::INTEGER AS end_token, count(*)::INTEGER AS repeated_windows, (count(*) FILTER (r = 1))::INTEGER AS first_windows FROM rep GROUP BY doc_id, island""",
    "op3_decontamination": f"""WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '{NORMAL_CLASS}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(text), '{NORMAL_CLASS}') AS w FROM benchmark),
grams AS (SELECT width, gram, min(item_id) AS item_id FROM ({GRAM_PARTS}) GROUP BY width, gram),
hits AS (SELECT h.doc_id, h.p, h.p + h.width AS e, g.item_id FROM ({HIT_PARTS}) AS h JOIN grams AS g USING (width, gram)),
marked AS (SELECT *, CASE WHEN p <= max(e) OVER (PARTITION BY doc_id ORDER BY p, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT doc_id, min(p) AS s, max(e) AS e, count(*) AS n, min(item_id) AS item_id FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p, e ROWS UNBOUNDED PRECEDING) AS k FROM marked) GROUP BY doc_id, k)
SELECT doc_id, s::INTEGER AS start_token, e::INTEGER AS end_token, n::INTEGER AS n_hits, item_id, CASE WHEN sum(e - s) OVER (PARTITION BY doc_id) >= 0.5 * len(w) THEN 'document' ELSE 'span' END AS removal FROM spans JOIN docs USING (doc_id)""",
    "op5_substring_dedup": f"""WITH {_windows(50)}
SELECT doc_id, min(p)::INTEGER AS start_token, (max(p) + 50)::INTEGER AS end_token, (count(*) + 49)::INTEGER AS n_tokens FROM rep GROUP BY doc_id, island""",
    "op6_exact_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM d)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(sqrt(d), 6) AS distance FROM r WHERE rank <= 10""",
    "op9_minhash_dedup": f"""WITH RECURSIVE t AS (SELECT doc_id, {_words('lower(text)')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE both_ >= 0.5 * (p.n + q.n - both_)),
e AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach AS r JOIN e ON r.y = e.x)
SELECT x AS doc_id, min(y) AS class_id, any_value(k) AS links FROM reach JOIN (SELECT x, count(*) AS k FROM e GROUP BY x) USING (x) GROUP BY x""",
    # all labelled rows are fitted: at sf0.01 no language reaches the bound FIT_ROWS
    "op8_toxicity": f"""WITH lab AS (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic IN (0, 1) AND doc_id IS NOT NULL),
src AS (SELECT coalesce(lang, '') AS lang, toxic, regexp_extract_all(lower(text), '{NORMAL_CLASS}') AS w FROM documents JOIN lab USING (doc_id)),
each_ AS (SELECT DISTINCT lang, toxic, word, before FROM (SELECT lang, toxic, unnest(w) AS word, unnest(list_prepend('', w[1:len(w) - 1])) AS before FROM src) WHERE length(word) >= {LETTERS} AND NOT regexp_matches(word, '[0-9]')),
evid AS (SELECT lang, word, sum(toxic)::DOUBLE AS t, sum(1 - toxic)::DOUBLE AS c FROM each_ GROUP BY lang, word),
sums AS (SELECT lang, count(*) AS v, sum(t) AS tt, sum(c) AS cc FROM evid GROUP BY lang),
gains AS (SELECT lang, word, c, CASE WHEN t > 0 THEN t * ln(t * (tt + cc) / ((t + c) * tt)) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c * (tt + cc) / ((t + c) * cc)) ELSE 0 END AS gain, v FROM evid JOIN sums USING (lang)
  WHERE t > 0 AND cc > 0 AND ln((t + 0.5) / (tt + 1)) - ln((c + 0.5) / (cc + 1)) >= {ODDS}),
best AS (SELECT word, c FROM gains WHERE gain > ln(v) + {MARGIN} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY gain DESC, word) <= {TERMS}),
lex AS (SELECT word AS term, {_bytes('word')} AS code, row_number() OVER (ORDER BY word) AS idx, CASE WHEN length(word) < 5 THEN 0 WHEN length(word) < 9 THEN 1 ELSE 2 END AS k, sum(c) > 0 AS doubtful FROM best GROUP BY word),
p AS (SELECT doc_id, regexp_extract_all(lower(text), '{NORMAL_CLASS}|{OTHER_CLASS}') AS x FROM documents),
f AS (SELECT doc_id, x, CASE WHEN regexp_matches(x[1], '^{NORMAL_CLASS}') THEN 1 ELSE 2 END AS f FROM p WHERE len(x) > 0),
pieces AS (SELECT doc_id, f, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS j FROM f),
words AS (SELECT s, {_bytes('s')} AS code FROM (SELECT DISTINCT s FROM pieces WHERE (j - f) % 2 = 0)),
near AS (SELECT s, term, idx, doubtful, levenshtein(words.code, lex.code) AS d, k FROM words JOIN lex ON abs(length(words.code) - length(lex.code)) <= k),
cand AS (SELECT s, term, idx, doubtful, d FROM (SELECT * FROM near WHERE d <= k QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, idx) = 1) WHERE d = 0 OR s NOT IN (SELECT word FROM evid WHERE c > 0)),
spots AS (SELECT q.doc_id, q.j, (q.j - q.f) // 2 AS n, c.term, c.idx, c.d, c.doubtful FROM pieces AS q JOIN cand AS c ON q.s = c.s WHERE (q.j - q.f) % 2 = 0),
ctx AS (SELECT s.*, array_to_string(x[CASE WHEN n <= {CONTEXT} THEN 1 ELSE j - {2 * CONTEXT} END:j - 1], '') AS before, array_to_string(x[j + 1:j + {2 * CONTEXT + 1}], '') AS after,
  x[greatest(j - {2 * CONTEXT}, 1):j + {2 * CONTEXT}] AS near FROM spots AS s JOIN f USING (doc_id)),
rated AS (SELECT doc_id, n, term, idx, d, q, ([{', '.join(map(str, EDIT_POINTS))}][greatest(d, doubtful::INTEGER) + 1] * CASE WHEN q THEN 1 ELSE 4 END * CASE WHEN list_has_any(near, {_strings(REPORTING)}) THEN 1 ELSE 2 END
  * CASE WHEN list_has_any(near, {_strings(ADDRESS)}) THEN 3 ELSE 2 END) // 16 AS points FROM (SELECT *, ({QUOTED}) AS q FROM ctx)),
best_ AS (SELECT doc_id, max(points) AS top FROM (SELECT doc_id, sum(points) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN {STRETCH - 1} PRECEDING AND CURRENT ROW) AS points FROM rated) GROUP BY doc_id)
SELECT doc_id, top::DOUBLE / {UNIT} AS score, count(*)::INTEGER AS n_hits, (count(*) FILTER (d > 0))::INTEGER AS n_misspelled, (count(*) FILTER (q))::INTEGER AS n_quoted,
  string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM rated JOIN best_ USING (doc_id) WHERE top::DOUBLE / {UNIT} >= {SCORE} GROUP BY doc_id, top""",
}
