"""DuckDB SQL of the learners and encoders: plain restatements that recount everything at every step.

Pieces are spelled in hex, a word is a string of atoms <68><65> or a list of them. A learner is a recursion
over whole word tables; an encoder merges, in every word at once, the best pair of each word until none is left.
"""

from __future__ import annotations

import math

PAIRS = "SELECT t[i] AS a, t[i + 1] AS b, freq FROM (SELECT t, freq, unnest(range(1, len(t))) AS i FROM ({src}) WHERE len(t) > 1)"
META = "SELECT 0 AS id, '<unk>' AS piece, 2 AS type UNION ALL SELECT 1, '<s>', 3 UNION ALL SELECT 2, '</s>', 3"
BYTE_META = META + " UNION ALL SELECT i + 3, printf('<0x%02X>', i), 6 FROM range(256) AS r(i)"
GRID = "1073741824.0::DOUBLE"  # log-probabilities are multiples of 2**-30, so that their sums are exact
PIECE_ROW = "id::INTEGER AS id, piece, score::FLOAT AS score, type::INTEGER AS type, u, v"


def piece_learner(words: str, size: int, least: int) -> str:
    """CTEs ending in vocab(id, piece, score, type, u, v): 256 bytes, then the most frequent pair at each step, ties by left and right."""
    return f"""{words},
st AS (SELECT 0 AS step, regexp_replace(hex(encode(word)), '(..)', '<\\1>', 'g') AS s, freq, '' AS a, '' AS b FROM words WHERE freq >= {least}
  UNION ALL SELECT st.step + 1, replace(st.s, p.a || p.b, '<' || substr(p.a, 2, length(p.a) - 2) || substr(p.b, 2, length(p.b) - 2) || '>'), st.freq, p.a, p.b
  FROM st, (SELECT a, b FROM ({PAIRS.format(src="SELECT regexp_extract_all(s, '<[^>]+>') AS t, freq FROM st")}) WHERE length(a) + length(b) - 4 <= 36 GROUP BY a, b ORDER BY sum(freq) DESC, substr(a, 2, length(a) - 2), substr(b, 2, length(b) - 2) LIMIT 1) AS p
  WHERE st.step < {size - 256}),
steps AS (SELECT DISTINCT step, substr(a, 2, length(a) - 2) AS u, substr(b, 2, length(b) - 2) AS v FROM st WHERE step > 0),
vocab AS MATERIALIZED (SELECT id, hex(encode(piece)) AS piece, 0 AS score, type, '' AS u, '' AS v FROM ({META})
  UNION ALL SELECT i + 3, printf('%02X', i), -i, 1, '', '' FROM range(256) AS r(i) UNION ALL SELECT step + 258, u || v, -(step + 255), 1, u, v FROM steps)"""


def char_learner(words: str, size: int, least: int, coverage: float = 0.9995) -> str:
    """CTEs ending in vocab: merges of characters (ties: fewer characters, then the string; a string is merged once), then the required characters."""
    return f"""{words}, trained AS (SELECT word, freq FROM words WHERE freq >= {least}),
chars AS (SELECT ch, sum(freq)::BIGINT AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM trained) WHERE ch <> '' GROUP BY ch),
cover AS (SELECT ch, cnt, coalesce(sum(cnt) OVER (ORDER BY cnt DESC, unicode(ch) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(cnt) OVER () AS before FROM chars),
required AS MATERIALIZED (SELECT ch, hex(encode(ch)) AS piece, row_number() OVER (ORDER BY cnt DESC, unicode(ch)) AS r FROM cover WHERE before::FLOAT < {coverage}::FLOAT),
room AS MATERIALIZED (SELECT {size} - count(*) AS n FROM required),
spelled AS MATERIALIZED (SELECT word, freq, string_agg('<' || CASE WHEN required.ch IS NULL THEN 'E29685' ELSE piece END || '>', '' ORDER BY i) AS s
  FROM (SELECT word, freq, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS i FROM trained) AS e LEFT JOIN required USING (ch) GROUP BY word, freq),
st AS (SELECT 0 AS step, s, freq, '' AS a, '' AS b FROM spelled
  UNION ALL SELECT step, CASE WHEN freq < 0 THEN s ELSE replace(s, '<' || a || '><' || b || '>', '<' || a || b || '>') END, freq, a, b FROM (
    SELECT st.step + 1 AS step, st.s, st.freq, p.a, p.b FROM st, (
      SELECT a, b FROM (SELECT substr(a, 2, length(a) - 2) AS a, substr(b, 2, length(b) - 2) AS b, freq FROM ({PAIRS.format(src="SELECT regexp_extract_all(s, '<[^>]+>') AS t, freq FROM st WHERE freq > 0")}))
      WHERE a <> 'E29685' AND b <> 'E29685' AND length(a) + length(b) <= 36 AND a || b NOT IN (SELECT s FROM st WHERE freq < 0)
      GROUP BY a, b ORDER BY sum(freq) DESC, length(decode(unhex(a || b))), a || b LIMIT 1) AS p WHERE st.step < (SELECT n FROM room)
    UNION ALL SELECT st.step + 1, p.a || p.b, -1, p.a, p.b FROM (SELECT DISTINCT step FROM st) AS st, (
      SELECT a, b FROM (SELECT substr(a, 2, length(a) - 2) AS a, substr(b, 2, length(b) - 2) AS b, freq FROM ({PAIRS.format(src="SELECT regexp_extract_all(s, '<[^>]+>') AS t, freq FROM st WHERE freq > 0")}))
      WHERE a <> 'E29685' AND b <> 'E29685' AND length(a) + length(b) <= 36 AND a || b NOT IN (SELECT s FROM st WHERE freq < 0)
      GROUP BY a, b ORDER BY sum(freq) DESC, length(decode(unhex(a || b))), a || b LIMIT 1) AS p WHERE st.step < (SELECT n FROM room))),
steps AS (SELECT DISTINCT step, a || b AS piece FROM st WHERE step > 0),
vocab AS MATERIALIZED (SELECT id, hex(encode(piece)) AS piece, 0 AS score, type, '' AS u, '' AS v FROM ({BYTE_META})
  UNION ALL SELECT step + 258, piece, 1 - step, 1, '', '' FROM steps
  UNION ALL SELECT (SELECT count(*) FROM steps) + r + 258, piece, 1 - r - (SELECT count(*) FROM steps), 1, '', '' FROM required)"""


def encoder(pairs: str, atoms: str) -> str:
    """CTEs ending in coded(word, l): ``pairs`` gives (a, b, rank), ``atoms`` the list of a word's atoms in hex."""
    return f"""ranks AS MATERIALIZED ({pairs}),
enc AS (SELECT 0 AS turn, word, {atoms} AS l, true AS live FROM words
  UNION ALL SELECT enc.turn + 1, enc.word, CASE WHEN m.i IS NULL THEN enc.l ELSE list_concat(list_concat(enc.l[1:m.i - 1], [enc.l[m.i] || enc.l[m.i + 1]]), enc.l[m.i + 2:len(enc.l)]) END, m.i IS NOT NULL
  FROM enc LEFT JOIN (SELECT word, arg_min(i, rank * 100000 + i) AS i FROM (SELECT word, l[i] AS a, l[i + 1] AS b, i FROM (SELECT word, l, unnest(range(1, len(l))) AS i FROM enc WHERE live)) JOIN ranks USING (a, b) GROUP BY word) AS m USING (word)
  WHERE enc.live),
coded AS (SELECT word, l FROM enc WHERE NOT live)"""


def train_piece(words: str, size: int, least: int) -> str:
    return f"WITH RECURSIVE {piece_learner(words, size, least)} SELECT {PIECE_ROW} FROM vocab"


def train_chars(words: str, size: int, least: int) -> str:
    return f"WITH RECURSIVE {char_learner(words, size, least)} SELECT {PIECE_ROW} FROM vocab"


def encode_piece(words: str, size: int, least: int) -> str:
    code = encoder("SELECT u AS a, v AS b, min(id) AS rank FROM vocab WHERE u <> '' GROUP BY u, v", "regexp_extract_all(hex(encode(word)), '..')")
    return f"""WITH RECURSIVE {piece_learner(words, size, least)}, {code},
each_ AS (SELECT word, unnest(l) AS piece, unnest(range(1, len(l) + 1)) AS i FROM coded)
SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM each_ JOIN (SELECT piece, max(id) AS id FROM vocab WHERE type = 1 GROUP BY piece) USING (piece) GROUP BY word"""


def encode_chars(words: str, size: int, least: int) -> str:
    splits = "SELECT substr(piece, 1, 2 * k) AS a, substr(piece, 2 * k + 1) AS b, -score AS rank FROM (SELECT piece, score, unnest(range(1, length(piece) // 2)) AS k FROM vocab WHERE type = 1)"
    code = encoder(splits, "list_transform(list_filter(string_split(word, ''), lambda c: c <> ''), lambda c: hex(encode(c)))")
    return f"""WITH RECURSIVE {char_learner(words, size, least)}, {code},
each_ AS (SELECT word, unnest(l) AS piece, unnest(range(1, len(l) + 1)) AS i FROM coded),
found AS (SELECT word, i, 0 AS k, id FROM each_ JOIN vocab ON vocab.piece = each_.piece AND type = 1
  UNION ALL SELECT word, i, k, ('0x' || substr(piece, 2 * k + 1, 2))::INTEGER + 3 FROM (SELECT word, i, piece, unnest(range(0, length(piece) // 2)) AS k FROM each_ WHERE piece NOT IN (SELECT piece FROM vocab WHERE type = 1)))
SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY i, k) AS ids FROM found GROUP BY word"""


def best_paths(name: str, items: str, weights: str, fallback: float = -10.0) -> str:
    """CTEs ending in {name}(word, t): the tokens of the best path of each row of ``items`` (word) through ``weights`` (w, p).

    Position by position, of the edges that end there the first best one.
    """
    return f"""{name}_spots AS (SELECT word, unnest(range(0, length(word))) AS a FROM {items}),
{name}_edges AS (SELECT word, a, a + 1 AS e, {fallback!r}::DOUBLE AS p, 0 AS o FROM {name}_spots UNION ALL SELECT word, a, a + k, p, 1
  FROM (SELECT word, a, k, substr(word, a + 1, k) AS w FROM {name}_spots, (SELECT DISTINCT length(w) AS k FROM {weights}) WHERE a + k <= length(word)) JOIN {weights} USING (w)),
{name}_into AS MATERIALIZED (SELECT word, e, list(a ORDER BY a, o) AS a, list(p ORDER BY a, o) AS p FROM {name}_edges GROUP BY word, e),
{name}_path AS (SELECT word, 0 AS e, [0.0::DOUBLE] AS score, [0::BIGINT] AS came FROM {items}
  UNION ALL SELECT word, e, list_append(score, list_max(c)), list_append(came, a[list_position(c, list_max(c))]) FROM (
    SELECT q.word, i.e, q.score, q.came, i.a, list_transform(range(1, len(i.a) + 1), lambda k: q.score[i.a[k] + 1] + i.p[k]) AS c FROM {name}_path AS q JOIN {name}_into AS i ON i.word = q.word AND i.e = q.e + 1)),
{name}_back AS (SELECT word, came, e AS stop, []::VARCHAR[] AS t FROM {name}_path WHERE e = length(word)
  UNION ALL SELECT word, came, came[stop + 1], list_prepend(substr(word, came[stop + 1] + 1, stop - came[stop + 1]), t) FROM {name}_back WHERE stop > 0),
{name} AS MATERIALIZED (SELECT word, t FROM {name}_back WHERE stop = 0)"""


def unigram(words: str, weights: dict[str, float], fallback: float = -10.0) -> str:
    """Best dictionary path of each word: (word, tokens, freq)."""
    values = ", ".join(f"('{w}', {f!r}::DOUBLE)" for w, f in weights.items())
    total = math.fsum(weights.values())
    return f"""WITH RECURSIVE {words}, dict AS (SELECT w, round((ln(f) - ln({total!r}::DOUBLE)) * {GRID}) / {GRID} AS p FROM (VALUES {values}) AS d(w, f)),
{best_paths('best', 'words', 'dict', fallback)}
SELECT word, array_to_string(t, '|') AS tokens, freq FROM best JOIN words USING (word)"""


def byte_piece_learner(words: str, grams: str, size: int, least: int, rounds: int) -> str:
    """CTEs ending in vocab: n-gram model, segmentation of all words where its best path has no context, pruning, then the most frequent pieces.

    A path has a state for each byte, the bytes of context before it (5: five or more). ``grams`` gives grams(n, gram, cnt).
    Pruning stops by itself where a round changes nothing; ``rounds`` must be enough for that.
    """
    ninf = "'-inf'::DOUBLE"
    grow = ", ".join(f"CASE WHEN {j} >= greatest(here, before + 1, 1) AND {j} <= pos AND now[{j}] > {ninf} AND ins[pos - {j} + 1] = 0 THEN now[{j}] + g[{j + 1}] ELSE {ninf} END" for j in range(1, 5))
    stay = f"CASE WHEN pos < 5 OR top <= {ninf} THEN {ninf} ELSE top + g[6] END"
    prune = []
    for r in range(1, rounds + 1):
        prune.append(f"""w{r} AS MATERIALIZED (SELECT word AS w, round((ln(cnt) - ln((SELECT sum(cnt)::DOUBLE FROM keep{r - 1}))) * {GRID}) / {GRID} AS p FROM keep{r - 1}),
{best_paths(f'cut{r}', 'bad' if r == 1 else f'keep{r - 1}', f'w{r}')},
keep{r} AS MATERIALIZED (SELECT word, sum(cnt) AS cnt FROM ({'SELECT word, cnt FROM keep0 UNION ALL ' if r == 1 else ''}SELECT unnest(c.t) AS word, s.cnt FROM cut{r} AS c JOIN {'bad' if r == 1 else f'keep{r - 1}'} AS s USING (word)) GROUP BY word)""")
    return f"""{words}, {grams},
ones AS (SELECT printf('%02X', b) AS gram, cnt FROM range(256) AS r(b) LEFT JOIN (SELECT gram, cnt FROM grams WHERE n = 1) AS g ON g.gram = printf('%02X', b)),
full_ AS MATERIALIZED (SELECT n, gram, cnt FROM grams WHERE n > 1 AND cnt >= {least} UNION ALL SELECT 1, gram, coalesce(cnt, 1) FROM ones
  UNION ALL SELECT 0, '', (SELECT coalesce(sum(cnt), 0) FROM grams WHERE n = 0) + (SELECT count(*) FROM ones WHERE cnt IS NULL)),
logp AS MATERIALIZED (SELECT g.n, g.gram, round((ln(g.cnt) - coalesce(ln(p.cnt), 0)) * {GRID}) / {GRID} AS p FROM full_ AS g LEFT JOIN full_ AS p ON p.n = g.n - 1 AND p.gram = substr(g.gram, 1, (g.n - 1) * 2) WHERE g.n > 0),
spell AS MATERIALIZED (SELECT word, hx, list_transform(range(1, len(b) + 1), lambda i: CASE WHEN b[i][1] NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN b[i - 1][1] NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN b[i - 2][1] NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END) AS ins
  FROM (SELECT word, hex(encode(word)) AS hx, regexp_extract_all(hex(encode(word)), '..') AS b FROM words)),
ends_ AS (SELECT word, hx, unnest(range(0, length(hx) // 2)) AS pos FROM spell),
tails AS (SELECT word, pos, n, CASE WHEN pos + 1 >= n THEN substr(hx, (pos + 1 - n) * 2 + 1, n * 2) END AS gram FROM ends_, range(1, 7) AS k(n)),
scores AS MATERIALIZED (SELECT word, pos, list(coalesce(p, {ninf}) ORDER BY tails.n) AS g FROM tails LEFT JOIN logp ON logp.n = tails.n AND logp.gram = tails.gram GROUP BY word, pos),
walk AS (SELECT word, ins, 0 AS pos, [g[1], {ninf}, {ninf}, {ninf}, {ninf}, {ninf}] AS now, []::BIGINT[][] AS routes FROM scores JOIN spell USING (word) WHERE pos = 0
  UNION ALL SELECT word, ins, pos, [CASE WHEN here = 0 THEN list_max(now[before + 1:6]) + g[1] ELSE {ninf} END, {grow}, {stay}],
    list_append(routes, [CASE WHEN here = 0 AND list_max(now[before + 1:6]) > {ninf} THEN before + list_position(now[before + 1:6], list_max(now[before + 1:6])) - 1 ELSE 0 END, 0, 1, 2, 3, who]) FROM (
      SELECT *, CASE WHEN now[6] > held THEN now[6] ELSE held END AS top, CASE WHEN now[6] > held THEN 5 ELSE 4 END AS who FROM (
        SELECT q.word, q.ins, s.pos, q.now, q.routes, s.g, q.ins[s.pos + 1] AS here, q.ins[s.pos] AS before, CASE WHEN s.pos >= 5 AND q.ins[s.pos] < 5 AND q.ins[s.pos - 4] = 0 THEN q.now[5] ELSE {ninf} END AS held
        FROM walk AS q JOIN scores AS s ON s.word = q.word AND s.pos = q.pos + 1))),
done_ AS MATERIALIZED (SELECT word, ins, pos, routes, list_max(now[ins[pos + 1] + 1:6]) AS best, ins[pos + 1] + list_position(now[ins[pos + 1] + 1:6], list_max(now[ins[pos + 1] + 1:6])) - 1 AS state FROM walk WHERE pos = len(ins) - 1),
trace AS (SELECT word, ins, routes, pos, CASE WHEN best > {ninf} THEN state ELSE 0 END AS state, []::BIGINT[] AS cuts FROM done_
  UNION ALL SELECT word, ins, routes, pos - 1, routes[pos][state + 1], CASE WHEN state = 0 AND ins[pos + 1] = 0 THEN list_prepend(pos, cuts) ELSE cuts END FROM trace WHERE pos > 0),
cutting AS (SELECT word, cuts FROM trace WHERE pos = 0),
segments AS (SELECT word, freq, unnest(list_transform(range(1, len(cuts) + 2), lambda i: decode(unhex(substr(hex(encode(word)), coalesce(cuts[i - 1], 0) * 2 + 1, (coalesce(cuts[i], strlen(word)) - coalesce(cuts[i - 1], 0)) * 2))))) AS piece FROM cutting JOIN words USING (word)),
pieces AS MATERIALIZED (SELECT piece AS word, sum(freq) AS cnt FROM segments GROUP BY piece),
keep0 AS MATERIALIZED (SELECT * FROM pieces WHERE strlen(word) <= 18 AND cnt >= {least}), bad AS MATERIALIZED (SELECT * FROM pieces WHERE strlen(word) > 18 OR cnt < {least}),
{', '.join(prune)},
chosen AS (SELECT word, cnt FROM keep{rounds} ORDER BY strlen(word) > 1, cnt DESC, strlen(word) DESC, word LIMIT {size}),
vocab AS MATERIALIZED (SELECT id, hex(encode(piece)) AS piece, 0 AS score, type, '' AS u, '' AS v FROM ({BYTE_META})
  UNION ALL SELECT 258 + row_number() OVER (ORDER BY cnt DESC, strlen(word) DESC, word), hex(encode(word)), cnt, 1, '', '' FROM chosen)"""


def train_byte_pieces(words: str, grams: str, size: int, least: int, rounds: int = 5) -> str:
    return f"WITH RECURSIVE {byte_piece_learner(words, grams, size, least, rounds)} SELECT {PIECE_ROW} FROM vocab"


def encode_byte_pieces(words: str, grams: str, size: int, least: int, rounds: int = 5) -> str:
    return f"""WITH RECURSIVE {byte_piece_learner(words, grams, size, least, rounds)},
dict AS MATERIALIZED (SELECT decode(unhex(piece)) AS w, round((ln(score) - ln((SELECT sum(score)::DOUBLE FROM vocab WHERE type = 1))) * {GRID}) / {GRID} AS p, id FROM vocab WHERE type = 1),
{best_paths('best', 'words', 'dict')},
each_ AS (SELECT word, unnest(t) AS piece, unnest(range(1, len(t) + 1)) AS i FROM best),
found AS (SELECT word, i, 0 AS k, id FROM each_ JOIN dict ON dict.w = each_.piece
  UNION ALL SELECT word, i, k, ('0x' || substr(hex(encode(piece)), 2 * k + 1, 2))::INTEGER + 3 FROM (SELECT word, i, piece, unnest(range(0, strlen(piece))) AS k FROM each_ WHERE piece NOT IN (SELECT w FROM dict)))
SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY i, k) AS ids FROM found GROUP BY word"""


def text_learner(size: int) -> str:
    """CTEs ending in steps(step, u, v, piece): merges over the whole benchmark as one text; the first most frequent pair, while it occurs twice."""
    return f"""whole AS (SELECT string_agg(regexp_replace(hex(encode(text || chr(10))), '(..)', '<\\1>', 'g'), '' ORDER BY item_id) AS s FROM (SELECT item_id, text FROM benchmark WHERE text <> '')),
st AS (SELECT 0 AS step, s, '' AS a, '' AS b FROM whole
  UNION ALL SELECT step + 1, replace(s, p.a || p.b, '<' || substr(p.a, 2, length(p.a) - 2) || substr(p.b, 2, length(p.b) - 2) || '>'), p.a, p.b
  FROM st, (SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM (SELECT regexp_extract_all(s, '<[^>]+>') AS t FROM st)) GROUP BY a, b HAVING count(*) > 1 ORDER BY count(*) DESC, min(i) LIMIT 1) AS p WHERE step < {size - 256}),
steps AS MATERIALIZED (SELECT step, substr(a, 2, length(a) - 2) AS u, substr(b, 2, length(b) - 2) AS v FROM st WHERE step > 0)"""


def train_text(size: int) -> str:
    return f"""WITH RECURSIVE {text_learner(size)}, vocab AS (SELECT i AS id, printf('%02X', i) AS piece, 0 AS score, 6 AS type, '' AS u, '' AS v FROM range(256) AS r(i)
  UNION ALL SELECT step + 255, u || v, 1 - step, 1, u, v FROM steps) SELECT {PIECE_ROW} FROM vocab"""


def encode_text(size: int, normal: str) -> str:
    """Merges of the model one after the other over each line; ``normal`` is its normalised text."""
    return f"""WITH RECURSIVE {text_learner(size)}, parts AS (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark), raw AS (SELECT item_id, unnest(range(0, len(l)))::BIGINT AS n, unnest(l) AS line FROM parts), lines AS (SELECT item_id, n, {normal} AS line FROM raw),
enc AS (SELECT 0 AS turn, item_id, n, line, regexp_replace(hex(encode(line)), '(..)', '<\\1>', 'g') AS s FROM lines
  UNION ALL SELECT turn + 1, item_id, n, line, replace(s, '<' || u || '><' || v || '>', '<' || u || v || '>') FROM enc JOIN steps ON step = turn + 1),
each_ AS (SELECT item_id, n, line, unnest(list_append(regexp_extract_all(s, '[0-9A-F]+'), '')) AS piece, unnest(range(0, len(regexp_extract_all(s, '[0-9A-F]+')) + 1)) AS i FROM enc WHERE turn = (SELECT max(step) FROM steps)),
ids AS (SELECT printf('%02X', i) AS piece, i AS id FROM range(256) AS r(i) UNION ALL SELECT u || v, step + 255 FROM steps)
SELECT item_id, n, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY i), '') AS ids, line AS text FROM each_ LEFT JOIN (SELECT piece, max(id) AS id FROM ids GROUP BY piece) USING (piece) GROUP BY item_id, n, line"""
