"""The queries of ``queries`` as SQL for an independent engine (DuckDB dialect)."""

from __future__ import annotations

from timedtext.functions import fixed

NL = "chr(10)"
MARK = "chr(30)"
BUDGET = fixed.REQUEST_CHARS


def values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


def stand_in(text: str) -> str:
    return f"replace(replace({text}, 'e', 'ee'), ';', '{fixed.CHINESE_COMMA}')"


# --- common table expressions -----------------------------------------------

DOCS = """docs AS (
  SELECT doc_id AS file_id, text, lang AS src_lang, source,
    CASE lang WHEN 'en' THEN 'zh-CN' WHEN 'fr' THEN 'en' WHEN 'de' THEN 'ja' ELSE 'fr' END AS tgt_lang
  FROM documents)"""

WORD_CUES = f"""{DOCS},
words AS (
  SELECT file_id, src_lang, tgt_lang, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) AS pos FROM docs),
cues AS (
  SELECT file_id, src_lang, tgt_lang, CAST((pos - 1) // 8 + 1 AS BIGINT) AS cue,
    string_agg(word, ' ' ORDER BY pos) AS content
  FROM words GROUP BY ALL)"""

TURN_CUES = """cues AS (
  SELECT conv_id AS file_id, CAST(turn + 1 AS BIGINT) AS cue, text AS content FROM conversations)"""

OFFSETS = """offsets AS (
  SELECT file_id, cue, CAST(SUM(length(content) + 1) OVER (PARTITION BY file_id ORDER BY cue) AS BIGINT) AS cue_end
  FROM cues)"""

DOC_TEXT = f"""texts AS (
  SELECT doc_id AS file_id, regexp_replace(replace(text, {NL}, ' '), '\\s+$', '') AS t FROM documents)"""

TURN_TEXT = f"""texts AS (
  SELECT conv_id AS file_id,
    regexp_replace(string_agg(replace(text, {NL}, ' '), ' ' ORDER BY turn), '\\s+$', '') AS t
  FROM conversations GROUP BY conv_id)"""


def sentence_cte(profile: str = "v1") -> str:
    """Every white-space character after a terminator is marked, then the marks of the
    exceptions are taken away again; what is left between marks are the sentences."""
    word = r"[\p{L}\p{N}_]"
    ends = "[.?!]" if profile == "v1" else "[.?]"
    t = f"regexp_replace(t, '({ends})(\\s)', '\\1' || {MARK} || '\\2', 'g')"
    t = f"regexp_replace({t}, '({word}\\.{word}{ends})' || {MARK}, '\\1', 'g')"
    t = f"regexp_replace({t}, '([A-Z][a-z]\\.)' || {MARK}, '\\1', 'g')"
    if profile == "v1":
        t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z]\\.)' || {MARK}, '\\1\\2', 'g')"
    kept = "list_filter(l, lambda x: regexp_matches(x, '\\S'))" if profile == "v1" else "l"
    return f"""parts AS (
  SELECT file_id, list_transform(string_split({t}, {MARK}),
    lambda x, i: CASE WHEN i > 1 THEN substr(x, 2) ELSE x END) AS l FROM texts),
raw_sentences AS (
  SELECT file_id, unnest({kept}) AS sentence, generate_subscripts({kept}, 1) AS sen FROM parts),
sentences AS (
  SELECT file_id, CAST(sen AS BIGINT) AS sen, sentence, sen_end - length(sentence) - 1 AS sen_start, sen_end
  FROM (SELECT *, CAST(SUM(length(sentence) + 1) OVER (PARTITION BY file_id ORDER BY sen) AS BIGINT) AS sen_end
        FROM raw_sentences))"""


SENTENCES = sentence_cte()

ALIGNED = """aligned AS (
  SELECT c.file_id, s.sen, c.cue, c.cue_end - s.sen_start AS rel
  FROM offsets c ASOF LEFT JOIN sentences s ON c.file_id = s.file_id AND c.cue_end <= s.sen_end)"""

DOC_ALIGNED = f"{WORD_CUES}, {OFFSETS}, {DOC_TEXT}, {SENTENCES}, {ALIGNED}"
TURN_ALIGNED = f"{TURN_CUES}, {OFFSETS}, {TURN_TEXT}, {SENTENCES}, {ALIGNED}"

# Every seventh cue is empty; the text is put together from the cues that are left.
GAP_ALIGNED = f"""{WORD_CUES.replace('cues AS (', 'all_cues AS (')},
cues AS (
  SELECT file_id, cue, CASE WHEN cue % 7 <> 0 THEN content ELSE '' END AS content FROM all_cues),
texts AS (
  SELECT file_id, regexp_replace(string_agg(replace(content, {NL}, ' '), ' ' ORDER BY cue), '\\s+$', '') AS t
  FROM cues GROUP BY file_id),
{OFFSETS}, {SENTENCES}, {ALIGNED}"""

SENTENCE_SQL = "SELECT file_id, sen, sentence, sen_start, sen_end FROM sentences"

ALIGNMENT_SQL = """SELECT file_id, sen, cue, rel,
  CASE WHEN sen IS NOT NULL THEN row_number() OVER (PARTITION BY file_id, sen ORDER BY cue) END AS ord,
  CASE WHEN sen IS NOT NULL THEN count(*) OVER (PARTITION BY file_id, sen) END AS n_in_sen,
  CASE WHEN sen IS NULL THEN 'unaligned' ELSE 'aligned' END AS status
FROM aligned"""

WIDE = "4294967296::BIGINT"

SNAP = {
    "none": "cut0",
    # the smallest distance first; of two, the even number is the left one's
    "space": f"""coalesce(least(2 * (cut0 - lft) * {WIDE} + lft + 1,
      (2 * (rgt - cut0) + 1) * {WIDE} + rgt + 1) % {WIDE}, cut0)""",
    "space_v0": f"""CASE WHEN rgt IS NULL THEN cut0
      ELSE least(2 * (cut0 - coalesce(lft, -1)) * {WIDE} + coalesce(lft, -1) + 1,
        (2 * (rgt - cut0) + 1) * {WIDE} + rgt + 1) % {WIDE} END""",
    "words": f"""CASE WHEN length(t) = 0 THEN cut0 ELSE greatest(cut0, 1)
      + CASE WHEN substr(t, greatest(cut0, 1) + 1, 1) = '{fixed.CHINESE_COMMA}' THEN 1 ELSE 0 END END""",
}
SNAP["languages"] = f"CASE WHEN tgt_lang IN ('en', 'fr') THEN {SNAP['space']} ELSE cut0 END"


def pieces_cte(snap: str, alone: str = "substr(t, 1, rel)") -> str:
    """``pieces`` from ``aligned`` and ``translated(file_id, sen, tgt_lang, t)``."""
    return f"""spans AS (
  SELECT a.file_id, a.sen, a.cue, a.rel, s.t, s.tgt_lang,
    max(a.rel) OVER w AS whole, count(*) OVER w AS n,
    row_number() OVER (PARTITION BY a.file_id, a.sen ORDER BY a.cue) AS k
  FROM aligned a JOIN translated s ON a.file_id = s.file_id AND a.sen = s.sen
  WINDOW w AS (PARTITION BY a.file_id, a.sen)),
raw_cuts AS (SELECT *, (length(t) * rel) // whole AS cut0 FROM spans),
letters AS (
  SELECT file_id, sen, unnest(string_split(t, '')) AS letter, unnest(range(0, length(t))) AS p FROM translated),
blanks AS (SELECT file_id, sen, p FROM letters WHERE letter = ' '),
near AS (
  SELECT r.*, l.p AS lft, g.p AS rgt FROM raw_cuts r
  ASOF LEFT JOIN blanks l ON r.file_id = l.file_id AND r.sen = l.sen AND r.cut0 > l.p
  ASOF LEFT JOIN blanks g ON r.file_id = g.file_id AND r.sen = g.sen AND r.cut0 <= g.p),
cuts AS (SELECT *, {SNAP[snap]} AS cut FROM near),
bounds AS (
  SELECT *, coalesce(lag(cut) OVER (PARTITION BY file_id, sen ORDER BY cue), 0) AS prev,
    CASE WHEN k = n THEN length(t) ELSE cut END AS upto
  FROM cuts),
pieces AS (
  SELECT file_id, sen, cue, tgt_lang,
    CASE WHEN n = 1 THEN {alone} ELSE substr(t, prev + 1, greatest(upto - prev, 0)) END AS piece
  FROM bounds)"""


WHOLE_PIECES = """all_pieces AS (
  SELECT file_id, sen, cue, tgt_lang, piece FROM pieces
  UNION ALL
  SELECT e.file_id, e.sen, c.cue, e.tgt_lang, e.t
  FROM (SELECT s.file_id, s.sen, s.sen_end, x.t, x.tgt_lang
        FROM sentences s JOIN translated x ON s.file_id = x.file_id AND s.sen = x.sen
        WHERE NOT EXISTS (SELECT 1 FROM aligned a WHERE a.file_id = s.file_id AND a.sen = s.sen)) e
  ASOF JOIN offsets c ON e.file_id = c.file_id AND e.sen_end <= c.cue_end),
joined AS (
  SELECT file_id, cue, CASE WHEN any_value(tgt_lang) = 'zh-CN' THEN string_agg(piece, '' ORDER BY sen)
    ELSE string_agg(piece, ' ' ORDER BY sen) END AS translated
  FROM all_pieces GROUP BY file_id, cue)"""

ALL_TRANSLATED = f"""translated AS (
  SELECT file_id, sen, 'fr' AS tgt_lang, {stand_in('sentence')} AS t FROM sentences)"""

MEMORY = f"""spoken AS (
  SELECT s.*, d.src_lang, d.tgt_lang FROM sentences s JOIN docs d ON s.file_id = d.file_id),
memory AS (
  SELECT DISTINCT src_lang, tgt_lang, sentence AS text, {stand_in('sentence')} AS translated
  FROM spoken WHERE NOT contains(sentence, ','))"""

MEMORY_TRANSLATED = f"""{MEMORY},
translated AS (
  SELECT s.file_id, s.sen, s.tgt_lang, coalesce(m.translated, '') AS t
  FROM spoken s LEFT JOIN memory m
  ON s.src_lang = m.src_lang AND s.tgt_lang = m.tgt_lang AND s.sentence = m.text)"""


def projection(snap: str) -> str:
    return f"""WITH {DOC_ALIGNED}, {ALL_TRANSLATED}, {pieces_cte(snap)}
SELECT file_id, cue, sen, piece FROM pieces"""


def timed(content: str, translated: str) -> str:
    return f"""SELECT c.file_id, c.cue, (c.cue - 1) * 3000 AS start_ms, (c.cue - 1) * 3000 + 2500 AS end_ms,
  {content} AS content,
  CASE WHEN p.file_id IS NULL THEN 'unaligned' ELSE 'aligned' END AS status
FROM cues c LEFT JOIN {translated} p ON c.file_id = p.file_id AND c.cue = p.cue"""


LINES = f"""lines AS (
  SELECT file_id, sen AS line_no, sentence AS line,
    CAST(SUM(length(sentence)) OVER (PARTITION BY file_id ORDER BY sen) AS BIGINT) AS upto
  FROM sentences)"""


def batch_cte(strict: bool = False) -> str:
    """From cut to cut: one step of the recursion finds the next cut of every file."""
    base = "arg_min(l.upto - length(l.line), l.line_no)" if strict else "arg_min(l.upto, l.line_no)"
    return f"""{DOC_TEXT}, {SENTENCES}, {LINES},
steps AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS batch_no, CAST(0 AS BIGINT) AS first_line, CAST(0 AS BIGINT) AS base
  FROM lines
  UNION ALL
  SELECT s.file_id, s.batch_no + CASE WHEN min(l.line_no) > 1 THEN 1 ELSE 0 END, min(l.line_no), {base}
  FROM steps s JOIN lines l
  ON l.file_id = s.file_id AND l.line_no > s.first_line AND l.upto > s.base + {BUDGET}
  GROUP BY s.file_id, s.batch_no),
batched AS (
  SELECT l.file_id, l.line_no, l.line, s.batch_no
  FROM lines l ASOF JOIN steps s ON l.file_id = s.file_id AND l.line_no >= s.first_line)"""


BATCH_TEXTS = f"""batch_texts AS (
  SELECT file_id, batch_no, min(line_no) AS first_line, max(line_no) AS last_line,
    string_agg(line, {NL} ORDER BY line_no) AS text
  FROM batched GROUP BY file_id, batch_no)"""

TRANSLATED_TEXTS = f"""{TURN_CUES}, texts AS (
  SELECT conv_id AS file_id, replace(regexp_replace(
    string_agg(replace(text, {NL}, '|'), ' ' ORDER BY turn), '\\s+$', ''), '|', {NL}) AS t
  FROM conversations GROUP BY conv_id),
given AS (
  SELECT file_id, unnest(string_split(t, {NL})) AS translated,
    generate_subscripts(string_split(t, {NL}), 1) AS line_no FROM texts),
counts AS (
  SELECT c.file_id, n_cues, n_lines FROM
    (SELECT file_id, count(*) AS n_cues FROM cues GROUP BY file_id) c JOIN
    (SELECT file_id, count(*) AS n_lines FROM given GROUP BY file_id) g ON c.file_id = g.file_id)"""

ATTACHED = """SELECT c.file_id, c.cue AS line_no, coalesce(g.translated, '') AS translated
FROM cues c LEFT JOIN given g ON c.file_id = g.file_id AND c.cue = g.line_no"""


def legal(content: str) -> str:
    return (
        f"regexp_replace(regexp_replace({content}, '^\\n+|\\n+$', '', 'g'), '\\n\\n+', {NL}, 'g')"
    )


def clock(ms: str) -> str:
    return (
        f"printf('%02d:%02d:%02d,%03d', ({ms}) // 3600000, (({ms}) // 60000) % 60,"
        f" (({ms}) // 1000) % 60, ({ms}) % 1000)"
    )


def undefined_bytes(name: str) -> str:
    """The bytes a single-byte codec does not define, as hexadecimal alternatives."""
    bad = []
    for byte in range(256):
        try:
            bytes([byte]).decode(name)
        except UnicodeDecodeError:
            bad.append(f"{byte:02X}")
    return "|".join(bad)


def detection(min_chars: int = fixed.MIN_DETECT_CHARS) -> str:
    """Candidates in order: UTF-8, then single-byte codecs up to the first that defines
    every byte. A codec fits if the file is long enough and has no undefined byte."""
    cases = []
    for name in fixed.ENCODINGS[2:]:
        bad = undefined_bytes(name)
        test = f"AND NOT regexp_matches(hex, '^(?:..)*(?:{bad})')" if bad else ""
        cases.append(f"WHEN length(hex) > {2 * min_chars} {test} THEN '{name}'")
        if not bad:
            break
    return f"""WITH forms AS (
  SELECT 'in/' || doc_id || '-utf-8.srt' AS path, length(text) > {min_chars} AS utf8,
    hex(encode(text)) AS hex FROM documents
  UNION ALL
  SELECT 'in/' || doc_id || '-iso8859-1.srt',
    length(text) > {min_chars} AND NOT regexp_matches(text, '[^\\x00-\\x7F]'),
    array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02X', ord(c))), '') FROM documents
  UNION ALL
  SELECT 'in/' || doc_id || '-utf-16.srt', false,
    'FFFE' || array_to_string(list_transform(string_split(text, ''),
      lambda c: printf('%02X%02X', ord(c) % 256, ord(c) // 256)), '') FROM documents)
SELECT path, CASE WHEN utf8 THEN 'utf-8' {' '.join(cases)} END AS encoding FROM forms"""


def ascii_text(text: str = "text") -> str:
    return f"regexp_replace({text}, '[^\\x00-\\x7F]', '?', 'g')"


LATIN1_HEX = """array_to_string(list_transform(string_split(text, ''),
    lambda c: CASE WHEN ord(c) < 256 THEN printf('%02X', ord(c)) ELSE '3F' END), '')"""

RECOMMENDED_ROWS = ", ".join(
    f"('{lang}', {rank}, '{name}')"
    for lang, names in (*fixed.RECOMMENDED.items(), ("*", fixed.RECOMMENDED_DEFAULT))
    for rank, name in enumerate(names, 1)
)

LEDGERS = """old_rows AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'success' WHEN toxic = 1 THEN 'rate_limited' ELSE 'error' END AS status,
    1000 AS updated_at, 0 AS newer FROM labels),
new_rows AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'success' ELSE 'error' END AS status,
    CASE WHEN lang = 'fr' THEN 500 ELSE 2000 END AS updated_at, 1 AS newer FROM documents)"""

TURN_TRANSLATED = f"""WITH {TURN_ALIGNED}, {ALL_TRANSLATED}, {pieces_cte('space', 't')}, {WHOLE_PIECES},
composed AS (
  SELECT c.file_id, c.cue, coalesce(p.translated, '') || {NL} || replace(c.content, {NL}, ' ') AS content
  FROM cues c LEFT JOIN joined p ON c.file_id = p.file_id AND c.cue = p.cue)
SELECT file_id, cue, (cue - 1) * 3000 AS start_ms, (cue - 1) * 3000 + 2500 AS end_ms,
  {legal('content')} AS content FROM composed"""

ORACLES: dict[str, str] = {
    "flatten_glue": f"""SELECT conv_id AS file_id, CAST(turn + 1 AS BIGINT) AS cue,
  replace(text, {NL}, ' ') AS flat, replace(text, {NL}, '') AS glued,
  NOT regexp_matches(text, '\\S') AS blank FROM conversations""",
    "cue_offsets": f"WITH {WORD_CUES}, {OFFSETS} SELECT file_id, cue, cue_end FROM offsets",
    "document_text": f"WITH {DOC_TEXT} SELECT file_id, t AS plain_text FROM texts",
    "turn_text": f"WITH {TURN_TEXT} SELECT file_id, t AS plain_text FROM texts",
    "sentences": f"WITH {DOC_TEXT}, {SENTENCES} {SENTENCE_SQL}",
    "split_sentences": f"WITH {DOC_TEXT}, {SENTENCES} {SENTENCE_SQL}",
    "turn_sentences": f"WITH {TURN_TEXT}, {SENTENCES} {SENTENCE_SQL}",
    "sentences_v0": f"""WITH texts AS (SELECT doc_id AS file_id, replace(text, {NL}, ' ') AS t FROM documents),
{sentence_cte('v0')} {SENTENCE_SQL}""",
    "align_cues": f"WITH {DOC_ALIGNED} {ALIGNMENT_SQL}",
    "align_gaps": f"""WITH {GAP_ALIGNED}
SELECT * REPLACE (cue * 3 + cue % 2 AS cue) FROM ({ALIGNMENT_SQL})
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 'unplaced' FROM documents""",
    "turn_alignment": f"WITH {TURN_ALIGNED} {ALIGNMENT_SQL}",
    "align_offsets": f"""WITH {DOC_ALIGNED} SELECT file_id, sen, cue, rel,
  CASE WHEN sen IS NULL THEN 'unaligned' ELSE 'aligned' END AS status FROM aligned""",
    "alignment_audit": f"""WITH {DOC_ALIGNED},
per_sentence AS (
  SELECT s.file_id, s.sen, count(a.cue) AS n FROM sentences s
  LEFT JOIN aligned a ON s.file_id = a.file_id AND s.sen = a.sen GROUP BY s.file_id, s.sen),
per_file AS (
  SELECT file_id, count(*) AS sentences, count(*) FILTER (n = 0) AS sentences_without_cue,
    count(*) FILTER (n = 1) AS single_cue_sentences FROM per_sentence GROUP BY file_id),
per_cue AS (
  SELECT file_id, count(*) AS cues, count(*) FILTER (sen IS NULL) AS unaligned_cues FROM aligned GROUP BY file_id)
SELECT c.file_id, coalesce(sentences, 0) AS sentences, cues, coalesce(sentences_without_cue, 0) AS sentences_without_cue,
  coalesce(single_cue_sentences, 0) AS single_cue_sentences, unaligned_cues
FROM per_cue c LEFT JOIN per_file f ON c.file_id = f.file_id""",
    "project_compat": projection("none"),
    "project_space": projection("space"),
    "project_space_v0": projection("space_v0"),
    "project_words": projection("words"),
    "project_lossless": f"""WITH {DOC_ALIGNED}, {ALL_TRANSLATED}, {pieces_cte('space', 't')}, {WHOLE_PIECES}
SELECT file_id, cue, translated FROM joined""",
    "translate_split_compat": f"""WITH {DOC_ALIGNED}, {MEMORY_TRANSLATED}, {pieces_cte('languages')}
{timed(f"coalesce(p.piece, '') || {NL} || replace(c.content, {NL}, ' ')", 'pieces')}""",
    "translate_split_lossless": f"""WITH {DOC_ALIGNED}, {MEMORY_TRANSLATED}, {pieces_cte('languages', 't')}, {WHOLE_PIECES}
{timed("coalesce(p.translated, '')", 'joined')}""",
    "translate_naive": f"""WITH {WORD_CUES},
lines AS (SELECT file_id, cue, content, replace(content, {NL}, '') AS line FROM cues)
SELECT file_id, cue, (cue - 1) * 3000 AS start_ms, (cue - 1) * 3000 + 2500 AS end_ms,
  CASE WHEN NOT regexp_matches(line, '\\S') THEN '' WHEN contains(line, ',') THEN line
    ELSE {stand_in('line')} END || {NL} || replace(content, {NL}, ' ') AS content,
  'aligned' AS status FROM lines""",
    "lookup_translations": f"""WITH {DOCS}, {DOC_TEXT}, {SENTENCES}, {MEMORY}
SELECT s.file_id, s.sen AS line_no, m.translated FROM spoken s LEFT JOIN memory m
ON s.src_lang = m.src_lang AND s.tgt_lang = m.tgt_lang AND s.sentence = m.text""",
    "memory_misses": f"""WITH {DOCS}, {DOC_TEXT}, {SENTENCES}, {MEMORY}
SELECT DISTINCT src_lang, tgt_lang, sentence AS text FROM spoken
WHERE NOT EXISTS (SELECT 1 FROM memory m WHERE m.src_lang = spoken.src_lang
  AND m.tgt_lang = spoken.tgt_lang AND m.text = spoken.sentence)""",
    "attach_lines": f"WITH {TRANSLATED_TEXTS} {ATTACHED}",
    "attach_lines_skip": f"""WITH {TRANSLATED_TEXTS} {ATTACHED}
WHERE c.file_id IN (SELECT file_id FROM counts WHERE n_cues = n_lines)""",
    "count_guard": f"""WITH {TRANSLATED_TEXTS} SELECT file_id, n_cues, n_lines,
  CASE WHEN n_cues = n_lines THEN 'success' ELSE 'error' END AS status,
  CASE WHEN n_cues <> n_lines THEN n_lines || ' lines for ' || n_cues || ' cues' END AS message
FROM counts""",
    "compose_content": f"""SELECT conv_id AS file_id, CAST(turn + 1 AS BIGINT) AS cue,
  {stand_in(f"replace(text, {NL}, '')")} || {NL} || replace(text, {NL}, ' ') AS content FROM conversations""",
    "batch_lines": f"WITH RECURSIVE {batch_cte()} SELECT file_id, line_no, batch_no FROM batched",
    "batch_lines_strict": f"WITH RECURSIVE {batch_cte(True)} SELECT file_id, line_no, batch_no FROM batched",
    "batch_text": f"""WITH RECURSIVE {batch_cte()}, {BATCH_TEXTS}
SELECT file_id, batch_no, first_line, last_line, text FROM batch_texts""",
    "progress": f"""WITH RECURSIVE {batch_cte()}, {BATCH_TEXTS}
SELECT b.file_id, b.batch_no, b.last_line AS current_index, n.total_items,
  CAST(b.last_line AS DOUBLE) * 100.0::DOUBLE / n.total_items AS progress
FROM batch_texts b JOIN (SELECT file_id, count(*) AS total_items FROM lines GROUP BY file_id) n
ON b.file_id = n.file_id WHERE regexp_matches(b.text, '\\S')""",
    "translate_hook": f"""WITH {DOC_TEXT}, {SENTENCES}
SELECT file_id, sen AS line_no, {stand_in('sentence')} AS translated, 'success' AS status,
  CAST(NULL AS VARCHAR) AS message FROM sentences""",
    "translate_misses": f"""WITH {DOCS}, {DOC_TEXT}, {SENTENCES}, {MEMORY}
SELECT DISTINCT src_lang, tgt_lang, sentence AS text, {stand_in('sentence')} AS translated FROM spoken
WHERE NOT EXISTS (SELECT 1 FROM memory m WHERE m.src_lang = spoken.src_lang
  AND m.tgt_lang = spoken.tgt_lang AND m.text = spoken.sentence)""",
    "extract_responses": f"""WITH turns AS (
  SELECT conv_id * 100 + turn AS request_id, text, replace(text, {NL}, '') AS glued FROM conversations)
SELECT request_id, 'array' AS layout, glued AS translated, 'success' AS status, CAST(NULL AS VARCHAR) AS message FROM turns
UNION ALL SELECT request_id, 'array_all', glued || 'tail', 'success', NULL FROM turns
UNION ALL SELECT request_id, 'sentences', glued, 'success', NULL FROM turns
UNION ALL SELECT request_id, 'cloud', text, 'success', NULL FROM turns
UNION ALL SELECT request_id, 'array', NULL, 'error', 'Not JSON' FROM turns
UNION ALL SELECT request_id, 'cloud', NULL, 'error', 'No translation in the response' FROM turns""",
    "compose_srt": f"""WITH {WORD_CUES},
written AS (
  SELECT file_id, cue, content, row_number() OVER (PARTITION BY file_id ORDER BY cue) AS number
  FROM cues WHERE regexp_matches(content, '\\S'))
SELECT file_id, string_agg(number || {NL} || {clock('(cue - 1) * 3000')} || ' --> ' ||
  {clock('(cue - 1) * 3000 + 2500')} || {NL} || {legal('content')} || {NL} || {NL}, '' ORDER BY number) AS text
FROM written GROUP BY file_id""",
    "parse_srt": f"""SELECT conv_id AS file_id, CAST(turn + 1 AS BIGINT) AS cue, turn * 3000 AS start_ms,
  turn * 3000 + 2500 AS end_ms, {legal('text')} AS content, '' AS proprietary,
  CAST(turn + 1 AS BIGINT) AS index FROM conversations""",
    "parse_large_file": """SELECT row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id, turn) AS place,
  CAST(turn + 1 AS BIGINT) AS index, conv_id AS file_id, text AS content FROM conversations""",
    "snapshot_roundtrip": f"""SELECT conv_id AS file_id, CAST(turn + 1 AS BIGINT) AS cue, turn * 3000 AS start_ms,
  turn * 3000 + 2500 AS end_ms, text AS content, '' AS proprietary, CAST(turn + 1 AS BIGINT) AS index,
  CASE WHEN contains(text, {NL}) THEN replace(text, {NL}, '') END AS translated_content FROM conversations""",
    "language_flags": f"""WITH {DOCS} SELECT file_id AS doc_id, tgt_lang,
  tgt_lang IN ('fr', 'en', 'de', 'es', 'it', 'pt', 'ru') AS space,
  tgt_lang IN ('zh-CN', 'zh-TW') AS chinese FROM docs""",
    "output_names": f"""WITH {DOCS} SELECT file_id AS doc_id,
  'show.s' || file_id || '_' || src_lang || '_' || tgt_lang || '_both.srt' AS both_name,
  'show.s' || file_id || '_' || src_lang || '_' || tgt_lang || '_only.srt' AS only_name FROM docs""",
    "encoded_names": f"""WITH tails(name) AS (VALUES {values(fixed.ENCODINGS)})
SELECT doc_id, '-' || upper(name) AS tail, 'file' || doc_id || '-cp874.srt' AS name
FROM documents CROSS JOIN tails""",
    "recommended_encodings": f"""WITH {DOCS},
langs AS (SELECT src_lang AS lang FROM docs UNION SELECT tgt_lang FROM docs),
known(lang, rank, encoding) AS (VALUES {RECOMMENDED_ROWS}),
keyed AS (
  SELECT lang, CASE WHEN lang IN (SELECT lang FROM known) THEN lang
    WHEN split_part(lang, '-', 1) IN (SELECT lang FROM known) THEN split_part(lang, '-', 1) ELSE '*' END AS key
  FROM langs)
SELECT k.lang, CAST(r.rank AS BIGINT) AS rank, r.encoding FROM keyed k JOIN known r ON k.key = r.lang""",
    "detect_encoding": detection(),
    "detect_lossless": detection(-1)
    + " UNION ALL SELECT 'in/' || doc_id || '-bom.srt', 'utf-8-sig' FROM documents",
    "encode_detected": """SELECT 'text' || doc_id || '-utf-8.srt' AS name,
  CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents""",
    "ledger_two_pairs": """SELECT DISTINCT conv_id AS file_id, tgt_lang, 'success' AS status, 100.0::DOUBLE AS progress
FROM conversations, (VALUES ('fr'), ('de')) t(tgt_lang)
UNION ALL SELECT NULL, tgt_lang, 'error', 0.0::DOUBLE FROM (VALUES ('fr'), ('de')) t(tgt_lang)""",
    "ledger_mixed": "SELECT DISTINCT conv_id AS file_id, 1::BIGINT AS n_rows FROM conversations",
    "translate_all_missed": """SELECT DISTINCT conv_id AS file_id, 'fr' AS tgt_lang, 'error' AS status,
  0.0::DOUBLE AS progress, true AS no_output FROM conversations UNION ALL SELECT NULL, 'fr', 'error', 0.0::DOUBLE, true""",
    "same_name_inputs": "SELECT DISTINCT folder, conv_id AS file_id FROM conversations, (VALUES ('a'), ('b')) t(folder)",
    "translate_parts": TURN_TRANSLATED,
    "translate_directory_hook": TURN_TRANSLATED,
    "translate_directory_naive": f"""SELECT conv_id AS file_id, CAST(turn + 1 AS BIGINT) AS cue,
  turn * 3000 AS start_ms, turn * 3000 + 2500 AS end_ms,
  {legal(stand_in(f"replace(text, {NL}, '')") + f" || {NL} || replace(text, {NL}, ' ')")} AS content FROM conversations""",
    "same_output_two_runs": """SELECT first, file_id, CASE WHEN first AND file_id IS NOT NULL THEN 'success' ELSE 'error' END AS status,
  first AND file_id IS NOT NULL AS written
FROM (SELECT DISTINCT conv_id AS file_id FROM conversations UNION ALL SELECT NULL) f, (VALUES (true), (false)) t(first)""",
    "hook_called_once": f"""WITH {TURN_TEXT}, {SENTENCES}
SELECT sentence AS text, 1::BIGINT AS n_calls, {stand_in('sentence')} AS translated
FROM (SELECT DISTINCT sentence FROM sentences)""",
    "transcode_ascii": f"""SELECT 'in/' || doc_id || '-UTF-8.srt' AS path, true AS success,
  length({ascii_text()}) AS n_bytes, md5({ascii_text()}) AS digest FROM documents""",
    "transcode_latin1": f"""SELECT 'in/' || doc_id || '-UTF-8.srt' AS path, true AS success,
  length(text) AS n_bytes, md5(unhex({LATIN1_HEX})) AS digest FROM documents""",
    "transcode_fanout": f"""WITH targets(target) AS (VALUES {values(fixed.FANOUT_TARGETS)}),
rows AS (
  SELECT doc_id, target, CASE target WHEN 'utf-8' THEN NULL WHEN 'utf-8-sig' THEN chr(65279) || text
    ELSE {ascii_text()} END AS body FROM documents CROSS JOIN targets)
SELECT 'in/' || doc_id || '-UTF-8.srt' AS path, 'utf-8' AS source, target,
  'out/' || doc_id || '-' || target || '.srt' AS output_path, true AS success, target = 'utf-8' AS skipped,
  CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes, md5(body) AS digest FROM rows""",
    "conversion_summary": """WITH targets(target, good) AS (VALUES ('utf-8', 1), ('cp1252', 1), ('no-such-codec', 0))
SELECT target, CAST(sum(good) AS BIGINT) AS converted, count(*) AS attempted
FROM documents CROSS JOIN targets GROUP BY target""",
    "pending_files": f"""WITH {LEDGERS}
SELECT 'in/' || doc_id || '.srt' AS path FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM old_rows WHERE status = 'success')""",
    "ledger_merge": f"""WITH {LEDGERS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, newer DESC) AS r
  FROM (SELECT * FROM old_rows UNION ALL SELECT * FROM new_rows))
SELECT 'in/' || doc_id || '.srt' AS path, 'en' AS src_lang, 'fr' AS tgt_lang, status,
  CASE WHEN status <> 'success' THEN 'bad ' || status END AS message,
  CASE WHEN status = 'success' THEN 'out/' || doc_id END AS output,
  CASE WHEN status = 'success' THEN 100.0 ELSE 0.0 END::DOUBLE AS progress,
  CAST(updated_at AS BIGINT) AS updated_at FROM ranked WHERE r = 1""",
    "status_summary": f"""WITH {LEDGERS}
SELECT 'en' AS src_lang, 'fr' AS tgt_lang, count(*) FILTER (status = 'success') AS success,
  count(*) FILTER (status = 'rate_limited') AS rate_limited, count(*) FILTER (status = 'error') AS error,
  count(*) AS total FROM old_rows""",
    "translate_directory": TURN_TRANSLATED,
    "stream_files": TURN_TRANSLATED,
    "translate_ledger": """SELECT DISTINCT conv_id AS file_id, 'success' AS status, 100.0::DOUBLE AS progress
FROM conversations UNION ALL SELECT NULL, 'error', 0.0::DOUBLE""",
    "encode_directory": f"""WITH targets(target) AS (VALUES ('utf-8-sig'), ('cp1252')),
rows AS (
  SELECT 'text' || doc_id || '-' || target || '.srt' AS name, target, text FROM documents CROSS JOIN targets)
SELECT name,
  CAST(CASE WHEN target = 'cp1252' THEN length(text) ELSE octet_length(encode(text)) + 3 END AS BIGINT) AS n_bytes,
  CASE WHEN target = 'cp1252' THEN md5(unhex({LATIN1_HEX})) ELSE md5(chr(65279) || text) END AS digest FROM rows""",
}
