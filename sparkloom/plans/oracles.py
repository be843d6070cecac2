"""DuckDB SQL of the queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..functions.text import DIGIT, HAN, LETTER, PATTERN_0, PATTERN_1, SPACES, WORD
from . import learner_sql as sql
from .dictionary import UNIGRAM_WORDS


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '^ +', ''), ' +', '▁', 'g'), '▁+$', '')"


R0, R1 = _q(PATTERN_0), _q(PATTERN_1)
LINES = """lines AS (
  SELECT doc_id, (i - 1)::BIGINT AS line_no, l[i] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE l[i] <> '')"""


def _count(pattern: str = R0, norm: str = _norm("line"), source: str = LINES) -> str:
    return f"""{source}, counts AS (
  SELECT token, count(*)::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all({norm}, '{pattern}')) AS token FROM lines) GROUP BY token)"""


def _words(least: int = 0) -> str:
    return _count() + f", words AS (SELECT token AS word, freq FROM counts WHERE freq >= {least})"


CHARS = "chars AS (SELECT ch, sum(freq)::BIGINT AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM words) WHERE ch <> '' GROUP BY ch)"
COVER = """cover AS (
  SELECT ch, cnt, unicode(ch)::BIGINT AS cp,
    coalesce(sum(cnt) OVER (ORDER BY cnt DESC, unicode(ch) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (sum(cnt) OVER ())::BIGINT AS total FROM chars)"""
GRAMS = """h AS (SELECT hex(encode(word)) AS h, freq FROM words),
spots AS (SELECT h, freq, unnest(range(0, length(h) // 2)) AS i FROM h),
grams AS (SELECT n, gram, sum(freq)::BIGINT AS cnt FROM (
  SELECT n::INTEGER AS n, substr(h, i * 2 + 1, n * 2) AS gram, freq FROM (SELECT h, freq, i, unnest(range(0, least(6, length(h) // 2 - i) + 1)) AS n FROM spots)) GROUP BY n, gram)"""
PAIR_OF = "SELECT t[i] AS a, t[i + 1] AS b, freq FROM (SELECT t, freq, unnest(range(1, len(t))) AS i FROM ({src}) WHERE len(t) > 1)"


def _merges(k: int) -> str:
    parts = [_words(), "s0 AS (SELECT regexp_replace(hex(encode(word)), '(..)', '<\\1>', 'g') AS s, freq FROM words)"]
    for i in range(1, k + 1):
        src = f"SELECT regexp_extract_all(s, '<[^>]+>') AS t, freq FROM s{i - 1}"
        parts.append(f"""m{i} AS MATERIALIZED (SELECT a, b, sum(freq)::BIGINT AS cnt FROM ({PAIR_OF.format(src=src)})
  WHERE length(a) + length(b) - 4 <= 36 GROUP BY a, b ORDER BY cnt DESC, substr(a, 2, length(a) - 2), substr(b, 2, length(b) - 2) LIMIT 1)""")
        parts.append(f"s{i} AS MATERIALIZED (SELECT replace(s, m.a || m.b, '<' || substr(m.a, 2, length(m.a) - 2) || substr(m.b, 2, length(m.b) - 2) || '>') AS s, freq FROM s{i - 1}, m{i} AS m)")
    rows = " UNION ALL ".join(f"SELECT {i}::INTEGER AS step, substr(a, 2, length(a) - 2) AS a, substr(b, 2, length(b) - 2) AS b, cnt FROM m{i}" for i in range(1, k + 1))
    return f"WITH {', '.join(parts)} {rows}"


VOCAB = """vocab AS (
  SELECT 0::INTEGER AS id, '<unk>' AS piece, 0::FLOAT AS score, 2::INTEGER AS type UNION ALL SELECT 1, '<s>', 0, 3 UNION ALL SELECT 2, '</s>', 0, 3
  UNION ALL SELECT (i + 3)::INTEGER, printf('<0x%02X>', i), 0, 6 FROM range(256) AS r(i)
  UNION ALL SELECT (rk + 258)::INTEGER, piece, (1 - rk)::FLOAT, 1 FROM (SELECT piece, row_number() OVER (ORDER BY cnt DESC, strlen(piece) DESC, piece) AS rk FROM tops) WHERE rk <= 1000)"""
SPELLED = f"SELECT doc_id, line_no, replace({_norm('line')}, '▁', ' ') AS text FROM lines"

# white space as Python's str methods and patterns define it, written out from that definition
PY_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HEADED = "chr(12288) || '# no title' || chr(10) || '##' || chr(160) || 'Title' || chr(10) || '# ' || chr(10) || 'Title' || chr(10) || " + "replace(replace(text, '. ', '.' || chr(160) || chr(12288)), ', ', ',' || chr(31) || chr(8195)) || chr(28) || chr(160) || chr(133)"


def _spaced(x: str) -> str:
    return f"replace(replace({x}, '. ', '.' || chr(160) || chr(12288)), ', ', ',' || chr(31) || chr(8195))"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{PY_SPACE}]+', ''), '[{PY_SPACE}]+$', '')"


def _clean(x: str) -> str:
    """Headings, then the ends, then runs of white space."""
    headless = f"regexp_replace({x}, '(?m)^#+[{PY_SPACE}]+.*$', '', 'g')"
    return f"regexp_replace({_strip(headless)}, '[{PY_SPACE}]+', ' ', 'g')"


ODD = f"CASE doc_id % 14 WHEN 0 THEN chr(9) || chr(12288) || chr(28) || chr(10) WHEN 7 THEN '# ' || chr(160) || 'only a title' ELSE {_spaced('text')} END"

ORACLES: dict[str, str] = {
    "raw_count_cut0": f"WITH {_count()} SELECT * FROM counts",
    "raw_count_cut1": f"WITH {_count(R1)} SELECT * FROM counts",
    "raw_count_maxlen": f"WITH {_count()} SELECT * FROM counts WHERE strlen(token) <= 8",
    "raw_count_reconstruct": f"WITH {_count(norm="replace(line, ' ', '▁')")} SELECT * FROM counts",
    "raw_count_topk": f"WITH {_count()} SELECT * FROM counts ORDER BY freq DESC, token LIMIT 100",
    "raw_count_all_text": f"WITH {_count(source="lines AS (SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT unnest(string_split(text, chr(10))) FROM conversations) WHERE line <> '')")} SELECT * FROM counts",
    "pretokenize_docs": f"WITH {LINES} SELECT doc_id, line_no, array_to_string(t, '|') AS tokens, len(t)::BIGINT AS n_tokens FROM (SELECT doc_id, line_no, regexp_extract_all({_norm('line')}, '{R0}') AS t FROM lines)",
    "pretokenize_benchmark_cn": f"""SELECT item_id, array_to_string(flatten(list_transform(regexp_extract_all({_norm("text || ' 他是英国人Bat 你好，世界。'")}, '{R0}'),
  lambda p: CASE WHEN regexp_matches(p, '^[{HAN}]') THEN string_split(p, '') ELSE [p] END)), '|') AS tokens FROM benchmark""",
    "token_lengths": f"""WITH {LINES} SELECT doc_id, sum(n)::BIGINT AS n_tokens, sum(c)::BIGINT AS n_characters, round(sum(c) / sum(n), 4) AS fertility
  FROM (SELECT doc_id, len(regexp_extract_all({_norm('line')}, '{R0}')) AS n, length(line) AS c FROM lines) GROUP BY doc_id""",
    "filter_english": f"WITH {_count(R1)} SELECT * FROM counts WHERE regexp_full_match(token, '[A-Za-z]{{2,}}')",
    "clean_text": f"SELECT doc_id, {_clean(HEADED)} AS text FROM documents",
    "split_sentences": f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY l, k) - 1)::BIGINT AS i, sentence FROM (
  SELECT doc_id, l, k, {_strip('s[k]')} AS sentence FROM (
    SELECT doc_id, l, s, unnest(range(1, len(s) + 1)) AS k FROM (
      SELECT doc_id, l, string_split(regexp_replace(regexp_replace(regexp_replace(line, '([.!?])([{PY_SPACE}])', '\\1' || chr(10) || '\\2', 'g'), '([.!?])$', '\\1' || chr(10)), '([。！？])', '\\1' || chr(10), 'g'), chr(10)) AS s FROM (
        SELECT doc_id, l, t[l] AS line FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS l FROM (
          SELECT doc_id, string_split(replace({_spaced('text')} || '。One.' || chr(160) || 'Two.' || chr(12288) || 'Three！4.5 U.S.A. end?' || chr(13) || 'next!' || chr(160), chr(13), chr(10)), chr(10)) AS t FROM documents))))))
  WHERE sentence <> ''""",
    "char_class_histogram": f"""WITH {_words(1)}, {CHARS} SELECT class, is_space, is_punctuation, sum(cnt)::BIGINT AS cnt, count(*)::BIGINT AS n_chars FROM (
  SELECT CASE WHEN ch = '▁' THEN 'space' WHEN regexp_matches(ch, '^[{HAN}]$') THEN 'han' WHEN regexp_matches(ch, '^[{DIGIT}]$') THEN 'digit' WHEN regexp_matches(ch, '^[{LETTER}]$') THEN 'letter' ELSE 'other' END AS class,
    regexp_matches(ch, '^[{SPACES}]$') AS is_space, regexp_matches(ch, '^[^{WORD}{SPACES}\\x{{0}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]$') AS is_punctuation, cnt FROM chars) GROUP BY ALL""",
    "word_table_min_count": f"WITH {_words(4)} SELECT * FROM words",
    "char_counts": f"WITH {_words()}, {CHARS} SELECT * FROM chars",
    "char_coverage": f"WITH {_words()}, {CHARS}, {COVER} SELECT ch, cnt, cp, before, total, (before::DOUBLE / total)::FLOAT < 0.9995::FLOAT AS required FROM cover",
    "rare_char_replace": f"""WITH {_words()}, {CHARS}, {COVER}, rare AS MATERIALIZED (SELECT ch FROM cover WHERE (before::DOUBLE / total)::FLOAT >= 0.99::FLOAT),
  each_ AS (SELECT word, freq, unnest(string_split(word, '')) AS ch, unnest(range(1, length(word) + 1)) AS i FROM words)
  SELECT word, string_agg(CASE WHEN rare.ch IS NULL THEN each_.ch ELSE '▅' END, '' ORDER BY i) AS replaced, freq FROM each_ LEFT JOIN rare USING (ch) GROUP BY word, freq""",
    "byte_ngrams": f"WITH {_words()}, {GRAMS} SELECT * FROM grams WHERE n <= 1 OR cnt >= 2",
    "ngram_logprob": f"""WITH {_words()}, {GRAMS},
  ones AS (SELECT printf('%02X', b) AS gram, cnt FROM range(256) AS r(b) LEFT JOIN (SELECT gram, cnt FROM grams WHERE n = 1) AS g ON g.gram = printf('%02X', b)),
  full_ AS (SELECT n, gram, cnt FROM grams WHERE n > 1 AND cnt >= 32 UNION ALL SELECT 1, gram, coalesce(cnt, 1) FROM ones
    UNION ALL SELECT 0, '', (SELECT coalesce(sum(cnt), 0) FROM grams WHERE n = 0) + (SELECT count(*) FROM ones WHERE cnt IS NULL))
  SELECT g.n::INTEGER AS n, g.gram, g.cnt::BIGINT AS cnt, round(ln(g.cnt) - coalesce(ln(p.cnt), 0), 8) AS logp
  FROM full_ AS g LEFT JOIN full_ AS p ON p.n = g.n - 1 AND p.gram = substr(g.gram, 1, (g.n - 1) * 2)""",
    "pair_counts_bytes": f"WITH {_words()} SELECT a, b, sum(freq)::BIGINT AS cnt FROM ({PAIR_OF.format(src="SELECT regexp_extract_all(hex(encode(word)), '..') AS t, freq FROM words")}) GROUP BY a, b",
    "pair_counts_chars": f"WITH {_words()} SELECT a, b, sum(freq)::BIGINT AS cnt FROM ({PAIR_OF.format(src="SELECT string_split(word, '') AS t, freq FROM words")}) WHERE a <> '▅' AND b <> '▅' GROUP BY a, b",
    "bpe_merge_1": _merges(1),
    "bpe_merges_8": _merges(8),
    "vocab_ids": f"WITH {_words()}, tops AS (SELECT word AS piece, freq AS cnt FROM words), {VOCAB} SELECT * FROM vocab",
    "byte_pieces": "SELECT i::INTEGER AS byte, printf('<0x%02X>', i) AS piece, i::INTEGER AS back FROM range(256) AS r(i)",
    "piece_lookup": f"WITH {_count()}, tops AS (SELECT token AS piece, freq AS cnt FROM counts), {VOCAB} SELECT c.token AS piece, c.freq, coalesce(max(v.id), 0)::INTEGER AS id FROM counts AS c LEFT JOIN vocab AS v ON v.piece = c.token GROUP BY c.token, c.freq",
    "decode_ids": f"""WITH {_words()}, tops AS (SELECT word AS piece, freq AS cnt FROM words), {VOCAB},
  t AS (SELECT doc_id, line_no, i, p[i] AS piece FROM (SELECT doc_id, line_no, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, line_no, regexp_extract_all({_norm('line')}, '{R0}') AS p FROM lines)))
  SELECT doc_id, line_no, replace(string_agg(t.piece, '' ORDER BY i), '▁', ' ') AS text FROM t JOIN vocab AS v ON v.piece = t.piece WHERE v.type NOT IN (2, 3) GROUP BY doc_id, line_no""",
    "jsonl_text": f"SELECT doc_id, {ODD} AS text FROM documents WHERE {_strip(ODD)} <> ''",
    "jsonl_articles": f"SELECT doc_id, {_clean(ODD)} AS text FROM documents WHERE {_clean(ODD)} <> ''",
    "stream_raw_count": f"WITH {_count()} SELECT * FROM counts",
    "roundtrip_piece": f"WITH {LINES} {SPELLED}",
    "roundtrip_sentencepiece": f"WITH {LINES} {SPELLED}",
    "roundtrip_bytepiece": f"WITH {LINES} {SPELLED}",
    "encode_unigram": sql.unigram(_words(), UNIGRAM_WORDS),
    "train_piece": sql.train_piece(_words(), 8000, 32),
    "train_sentencepiece": sql.train_chars(_words(), 8000, 32),
    "encode_piece": sql.encode_piece(_words(), 8000, 32),
    "encode_sentencepiece": sql.encode_chars(_words(), 8000, 32),
    "train_bytepiece": sql.train_byte_pieces(_words(), GRAMS, 8000, 32),
    "encode_bytepiece": sql.encode_byte_pieces(_words(), GRAMS, 8000, 32),
    "train_naive": sql.train_text(300),
    "encode_naive": sql.encode_text(300, _norm("line")),
    "model_file": sql.train_piece(_words(), 8000, 32),
    "normalize_nfkc_cf": f"""WITH {LINES}, folded AS (SELECT doc_id, line_no, replace(lower(nfc_normalize(line)), 'ß', 'ss') || ' 123 hello fi strasse å' AS line FROM lines)
  SELECT doc_id, line_no, {_norm('line')} AS text FROM folded""",
    "normalize_custom_map": f"""WITH {LINES} SELECT doc_id, line_no, {_norm("replace(replace(replace(replace(line, 'the', 'D'), 'th', 'T'), 'er', 'R'), 'e', '3')")} AS text FROM lines""",
    "normalize_offsets": r"""WITH c AS (SELECT item_id, string_split('  ' || replace(text, ' ', '  ') || ' ', '') AS c FROM benchmark),
  spots AS (SELECT item_id, c, unnest(range(1, len(c) + 1)) AS i FROM c),
  bytes AS (SELECT item_id, i, c[i] AS ch, i > 1 AND c[i - 1] = ' ' AS after_space, sum(strlen(c[i])) OVER (PARTITION BY item_id ORDER BY i) - strlen(c[i]) AS pos FROM spots),
  kept AS (SELECT item_id, i, ch, pos FROM bytes WHERE NOT (ch = ' ' AND (after_space OR pos = 0))),
  words AS (SELECT item_id, max(i) FILTER (ch <> ' ') AS last FROM kept GROUP BY item_id),
  marked AS (SELECT k.item_id, i, last, CASE WHEN ch = ' ' THEN '▁' ELSE ch END AS ch, pos FROM kept AS k JOIN words USING (item_id))
  SELECT item_id, string_agg(ch, '' ORDER BY i) FILTER (i <= last) AS text,
    string_agg(rtrim(repeat(pos::BIGINT::VARCHAR || ' ', strlen(ch))), ' ' ORDER BY i) FILTER (i <= last) || ' ' || (min(pos) FILTER (i > last))::BIGINT::VARCHAR AS offsets FROM marked GROUP BY item_id""",
    "utf8_lengths": f"WITH {_count()} SELECT token, strlen(token)::BIGINT AS n_bytes, length(token)::BIGINT AS n_chars, hex(encode(token)) AS bytes FROM counts",
    "cut_han_dictionary": f"""SELECT item_id, array_to_string(regexp_extract_all({_norm('text')}, '{R0}'), '|') || '|▁|我们|在|学习|未|知|▁|人工智能|end' AS tokens FROM benchmark""",
    "text_files": f"WITH {LINES} SELECT line, count(*)::BIGINT AS n FROM lines GROUP BY line",
    "counts_as_dictionary": f"WITH {_count()} SELECT token AS word, freq::DOUBLE AS freq FROM counts",
    "id_lookup": f"WITH {_words()}, tops AS (SELECT word AS piece, freq AS cnt FROM words), {VOCAB} SELECT i::INTEGER AS id, piece, type FROM range(-2, 3000, 7) AS r(i) LEFT JOIN vocab ON vocab.id = i",
    "stream_windows": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, token, count(*)::BIGINT AS freq FROM (SELECT ts, unnest(regexp_extract_all({_norm('event_type')}, '{R0}')) AS token FROM events) GROUP BY ALL""",
}
