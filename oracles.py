"""DuckDB SQL with the result of each registered query.

Model answers are spelled out from the rules of ``parlance.scripted``. Queries
over whole documents that need a longest common subsequence of every pair, or
a stemmer, have no SQL; the tests compare those with plain loops.
"""

from __future__ import annotations

import re

from parlance.functions.prompts import DEFAULT, FOLLOWUPS, PROBED_ASPECTS, RATED_ASPECTS
from parlance.functions.stem import IRREGULAR, STEP_2, STEP_3, STEP_4

SEED = 7


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fill(template: str, **slots: str) -> str:
    """SQL text of a prompt template with its slots replaced by expressions."""
    pieces = re.split(r"\{([a-z_0-9]+)\}", template)
    return " || ".join(f"CAST({slots[p]} AS VARCHAR)" if i % 2 else lit(p) for i, p in enumerate(pieces) if i % 2 or p)


def values(rows: list[tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows) + ")"


DIALOGUES = """dialogues AS (
  SELECT CAST(conv_id AS VARCHAR) AS dialogue_id,
         string_agg('#' || role || '#: ' || text, chr(10) ORDER BY turn) AS dialogue
  FROM conversations GROUP BY conv_id)"""

PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS a, b.text AS b
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

LISTS = """lists AS (
  SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS names
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

ROWS = """rows_ AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS dialogue,
         string_split(text, chr(10))[-1] AS summary, string_split(text, chr(10))[1] AS predicted_summary
  FROM documents)"""

EXAMPLES = f"""{ROWS}, examples AS (
  SELECT list({{'dialogue': dialogue, 'summary': summary}} ORDER BY id) AS e
  FROM (SELECT * FROM rows_ ORDER BY md5('{SEED}/' || id) LIMIT 4))"""


def words(text: str) -> str:
    plain = f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"
    return f"list_filter(string_split({plain}, ' '), lambda w: w <> '')"


def lcs(source: str, keys: str) -> str:
    """CTEs turning ``source`` (keys, ta, tb) into lcs (keys, n, na, nb), row by row of the table."""
    return f"""dp AS (
  SELECT {keys}, ta, tb, 0 AS i, list_transform(range(len(tb) + 1), lambda z: CAST(0 AS BIGINT)) AS r FROM {source}
  UNION ALL
  SELECT {keys}, ta, tb, i + 1,
    list_reduce(list_transform(range(1, len(tb) + 1), lambda j: [j]),
      lambda acc, j: list_append(acc, CASE WHEN tb[j[1]] = ta[i + 1] THEN r[j[1]] + 1
                                           ELSE greatest(r[j[1] + 1], acc[len(acc)]) END), [CAST(0 AS BIGINT)])
  FROM dp WHERE i < len(ta)),
lcs AS (SELECT {keys}, r[len(r)] AS n, len(ta) AS na, len(tb) AS nb FROM dp WHERE i = len(ta))"""


F_MEASURE = "CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * n / (na + nb) END"


def strip_punctuation(text: str) -> str:
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return f"translate(lower({text}), {lit(marks)}, '')"


def normal_words(text: str) -> str:
    blanks = f"regexp_replace({strip_punctuation(text)}, '\\s+', ' ', 'g')"
    return f"list_filter(string_split({blanks}, ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def example_texts(template: str, count: int) -> str:
    shown = fill(template, k="k", dialogue="e[k].dialogue", summary="e[k].summary")
    return f"array_to_string(list_transform(range(1, {count + 1}), lambda k: {shown}), chr(10) || chr(10))"


ORACLES: dict[str, str] = {}

# ------------------------------------------------------------ sources and sinks

ORACLES["topic_source"] = "SELECT s_name AS base_topic FROM supplier"
ORACLES["seed_source"] = f"WITH {ROWS} SELECT md5(dialogue) AS id, dialogue, summary FROM rows_"
ORACLES["csv_roundtrip"] = f"WITH {ROWS} SELECT id, dialogue, summary FROM rows_"
ORACLES["folder_scan"] = f"""
WITH {ROWS} SELECT lang || '.csv' AS file_name, CASE WHEN lang <> 'fr' THEN id END AS id, dialogue, summary
FROM rows_ JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE lang IN ('en', 'de', 'fr')"""
ORACLES["folder_errors"] = """
SELECT lang || '.csv' AS file_name, CAST(count(*) AS BIGINT) AS records,
  CASE lang WHEN 'fr' THEN 'no column id' WHEN 'es' THEN 'no column dialogue' END AS error
FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang"""
ORACLES["corpus_split"] = ORACLES["csv_roundtrip"]
ORACLES["stage_save"] = """
SELECT lang, count(*) AS rows, CAST(sum(n_chars + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS BIGINT) AS n_chars
FROM documents GROUP BY lang"""
ORACLES["metric_report"] = """
SELECT run_id, source, metric, round(avg(value), 6) AS mean FROM (
  SELECT source, unnest(['quality', 'toxic']) AS metric, unnest([CAST(quality AS DOUBLE), toxic]) AS value
  FROM labels JOIN documents USING (doc_id)), (VALUES ('one'), ('two')) r(run_id)
GROUP BY run_id, source, metric"""
ORACLES["question_store"] = f"""
SELECT doc_id, lang,
  (CASE WHEN lang = 'en' THEN 'first ' ELSE 'second ' END) || length({fill(DEFAULT.to_ask_about, dialogue='text')}) AS response
FROM documents"""
ORACLES["file_labels"] = """
SELECT page_id, base, 'some_org_model_x_' || base AS label
FROM (SELECT page_id, split_part(string_split(url, '/')[-1], '_', 1) AS base FROM pages)"""

# --------------------------------------------- filters, samples, set operations

ORACLES["first_k_per_file"] = """
SELECT lang, doc_id, CAST(pos AS INTEGER) AS pos FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) WHERE pos < 200"""
ORACLES["truncate_lists"] = f"WITH {LISTS} SELECT l_orderkey, array_to_string(names[1:3], '|') AS names FROM lists"
ORACLES["seed_sample"] = f"SELECT doc_id, text FROM documents ORDER BY md5('{SEED}/' || doc_id) LIMIT 4"
ORACLES["size_matched_sample"] = f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (ORDER BY md5('{SEED}/' || doc_id)) AS r FROM documents)
WHERE r <= (SELECT count(*) FROM labels)"""
ORACLES["append_results"] = """
SELECT kind, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters FROM (
  SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'turn', text FROM conversations) GROUP BY kind"""


def split_dialogue(source: str) -> str:
    return f"""(SELECT id, array_to_string(l[1:len(l) - 1], chr(10)) AS context, l[-1] AS response
  FROM (SELECT id, string_split(dialogue, chr(10)) AS l FROM {source}) WHERE len(l) >= 2)"""


ORACLES["context_response"] = f"WITH {ROWS} SELECT id, context, response FROM {split_dialogue('rows_')}"
ORACLES["train_test_pairs"] = f"""
WITH {DIALOGUES}, generated AS (SELECT dialogue_id AS id, dialogue FROM dialogues),
corpus AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS dialogue FROM documents),
held AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS dialogue FROM benchmark),
syn AS {split_dialogue('generated')}, dom AS {split_dialogue('corpus')}, test AS {split_dialogue('held')},
matched AS (SELECT id, context, response FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42/' || id)) AS r FROM dom) WHERE r <= (SELECT count(*) FROM syn)),
both_ AS (
  SELECT 'synthetic' AS dataset, 'train' AS split, * FROM syn UNION ALL
  SELECT 'in_domain', 'train', * FROM matched UNION ALL
  SELECT 'synthetic', 'test', * FROM test UNION ALL SELECT 'in_domain', 'test', * FROM test)
SELECT dataset, split, id, md5(context) AS context, response FROM both_"""

# ------------------------------------------------------------------------ joins

ORACLES["few_shot_attach"] = f"""
WITH {EXAMPLES}
SELECT conv_id, turn,
  (SELECT md5({fill(DEFAULT.summary, examples=example_texts(DEFAULT.summary_example, 2))}) FROM examples) AS system,
  {fill(DEFAULT.to_summarize, dialogue='text')} AS user
FROM conversations"""
ORACLES["persona_pairs"] = f"""
WITH {LISTS}, items AS (
  SELECT l_orderkey, unnest(names) AS name, unnest(range(len(names))) AS pos FROM lists)
SELECT a.l_orderkey, CAST(a.pos AS INTEGER) AS pos_1, CAST(b.pos AS INTEGER) AS pos_2,
       a.name AS persona_1, b.name AS persona_2
FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos"""

FOLLOWUP_ROWS = values([
    (metric, polarity, utterance)
    for metric, sides in FOLLOWUPS.items() for polarity, rows in sides.items() for utterance in rows
]) + " f(metric, polarity, utterance)"

ORACLES["criteria_grid"] = f"""
WITH {DIALOGUES} SELECT dialogue_id, metric, polarity, utterance FROM dialogues, {FOLLOWUP_ROWS}"""
ORACLES["qa_alignment"] = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(unnest(range(len(ll))) AS INTEGER) AS pos, unnest(ll) AS left_lines, unnest(rl) AS right_lines
FROM (SELECT a.doc_id, a.l AS ll, b.l AS rl FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1
      JOIN labels ON labels.doc_id = a.doc_id WHERE len(a.l) = len(b.l))"""

# ----------------------------------------------------------------- aggregation

# All part names have two distinct words, no two of them share a stem; so the
# common subsequence is 2 for equal names, 1 when a word is shared, otherwise 0.
NAME_SCORE = "CASE WHEN a.p_name = b.p_name THEN 1.0 WHEN list_has_any(a.w, b.w) THEN 0.5 ELSE 0.0 END"
ORACLES["diversity_rouge_names"] = f"""
WITH names AS (
  SELECT p_brand, p_partkey AS r, p_name, string_split(p_name, ' ') AS w FROM part),
best AS (
  SELECT a.p_brand, a.r, max(CASE WHEN a.r <> b.r THEN {NAME_SCORE} END) AS m
  FROM names a JOIN names b ON a.p_brand = b.p_brand GROUP BY a.p_brand, a.r)
SELECT p_brand, count(*) AS rows, round(avg(m), 6) AS diversity_rouge FROM best GROUP BY p_brand"""
ORACLES["diversity_cosine"] = """
WITH v AS (
  SELECT label, vec_id AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
best AS (
  SELECT a.label, a.r, max(CASE WHEN a.r <> b.r THEN list_cosine_similarity(a.e, b.e) END) AS m
  FROM v a JOIN v b ON a.label = b.label GROUP BY a.label, a.r)
SELECT label, round(avg(m), 6) AS diversity_cosine FROM best GROUP BY label"""
ORACLES["chunked_mean"] = """
SELECT chunk, round(sum(value) / 3, 6) AS mean FROM (
  SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 3 AS chunk FROM events) GROUP BY chunk"""
ORACLES["mean_by_document"] = "SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY user_id"

# ----------------------------------------------------------------- near copies

# Two-word names reach 0.5 exactly when they share a word.
ORACLES["greedy_filter_lists"] = f"""
WITH RECURSIVE {LISTS}, walk AS (
  SELECT l_orderkey, names, 0 AS i, CAST([] AS VARCHAR[]) AS kept FROM lists
  UNION ALL
  SELECT l_orderkey, names, i + 1,
    CASE WHEN len(list_filter(kept, lambda k: list_has_any(string_split(k, ' '), string_split(names[i + 1], ' ')))) = 0
         THEN list_append(kept, names[i + 1]) ELSE kept END
  FROM walk WHERE i < len(names))
SELECT l_orderkey, array_to_string(kept, '|') AS names FROM walk WHERE i = len(names)"""
ORACLES["greedy_filter_names"] = """
WITH RECURSIVE lists AS (
  SELECT p_brand, list(p_name ORDER BY p_partkey) AS names, list(p_partkey ORDER BY p_partkey) AS keys
  FROM part GROUP BY p_brand),
walk AS (
  SELECT p_brand, 0 AS i, CAST([] AS VARCHAR[]) AS kept, CAST([] AS BIGINT[]) AS spots FROM lists
  UNION ALL
  SELECT w.p_brand, i + 1,
    CASE WHEN fresh THEN list_append(kept, name) ELSE kept END, CASE WHEN fresh THEN list_append(spots, i) ELSE spots END
  FROM (SELECT w.*, l.names[i + 1] AS name,
          len(list_filter(kept, lambda k: list_has_any(string_split(k, ' '), string_split(l.names[i + 1], ' ')))) = 0
            AS fresh
        FROM walk w JOIN lists l USING (p_brand) WHERE i < len(l.names)) w),
done AS (SELECT w.p_brand, w.spots FROM walk w JOIN lists l USING (p_brand) WHERE w.i = len(l.names)),
flat AS (SELECT p_brand, unnest(spots) AS i FROM done)
SELECT f.p_brand, l.keys[f.i + 1] AS p_partkey, l.names[f.i + 1] AS p_name
FROM flat f JOIN lists l USING (p_brand)"""

ORACLES["greedy_filter_rounds"] = ORACLES["greedy_filter_names"]

# ------------------------------------------------------------------------ text

ORACLES["rouge_l_pairs"] = f"""
WITH RECURSIVE {PAIRS}, tok AS (SELECT conv_id, turn, {words('a')} AS ta, {words('b')} AS tb FROM pairs),
{lcs('tok', 'conv_id, turn')}
SELECT conv_id, turn, round({F_MEASURE}, 6) AS rouge_l FROM lcs"""


def cut(n: int) -> str:
    """The word without its last letters."""
    return f"left(w, length(w) - {n})"


def letters(stem: str) -> str:
    """A stem in which every y that counts as a vowel is an i: those after a consonant."""
    return f"regexp_replace(regexp_replace({stem}, '([^aeiouy])y', '\\1i', 'g'), 'yy', 'yi', 'g')"


def has(stem: str, pattern: str) -> str:
    return f"regexp_matches({letters(stem)}, '{pattern}')"


def above(stem: str, m: int) -> str:
    """Whether a stem holds more than ``m`` (0 or 1) runs of vowels followed by consonants."""
    return has(stem, "[aeiou][^aeiou]" if m == 0 else "[aeiou][^aeiou]+[aeiou]+[^aeiou]")


def short_end(word: str) -> str:
    return f"CASE WHEN length({word}) = 2 THEN {has(word, '^[aeiou][^aeiou]$')} ELSE {has(word, '[^aeiou][aeiou][^aeiouwxy]$')} END"


def swapped(rules: list[tuple[str, str]]) -> str:
    cases = " ".join(
        f"WHEN w LIKE '%{old}' THEN CASE WHEN {above(cut(len(old)), 0)} THEN {cut(len(old))} || '{new}' ELSE w END" for old, new in rules
    )
    return f"CASE {cases} ELSE w END"


def stems(source: str) -> str:
    """CTEs ending in stems (t, s): the Porter stem of each distinct token t of ``source``, step by step."""
    once = f"{above('p', 0)} AND NOT {above('p', 1)}"
    stripped = f"""CASE WHEN p IS NULL OR NOT {has('p', '[aeiou]')} THEN w
      WHEN p LIKE '%at' OR p LIKE '%bl' OR p LIKE '%iz' THEN p || 'e'
      WHEN length(p) > 1 AND p[-1] = p[-2] AND {has('p', '[^aeiou]$')} THEN
        CASE WHEN p[-1] IN ('l', 's', 'z') THEN p ELSE left(p, length(p) - 1) END
      WHEN {once} AND {short_end('p')} THEN p || 'e' ELSE p END"""
    steps = [
        """CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN left(w, 3) WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
           WHEN w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w
           WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END""",
        f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
           WHEN w LIKE '%eed' THEN CASE WHEN {above(cut(3), 0)} THEN {cut(1)} ELSE w END ELSE {stripped} END""",
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND {has(cut(1), '[^aeiou]$')} THEN {cut(1)} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {above(cut(4), 0)} THEN {cut(2)} ELSE w END",
        f"CASE WHEN w LIKE '%logi' THEN CASE WHEN {above(cut(3), 0)} THEN {cut(1)} ELSE w END ELSE {swapped(STEP_2)} END",
        swapped(STEP_3),
        "CASE " + " ".join(
            f"WHEN w LIKE '%{old}' THEN CASE WHEN {above(cut(len(old)), 1)}"
            + (f" AND {cut(3)}[-1] IN ('s', 't')" if old == "ion" else "") + f" THEN {cut(len(old))} ELSE w END"
            for old in STEP_4) + " ELSE w END",
        f"CASE WHEN w LIKE '%e' AND ({above(cut(1), 1)} OR ({above(cut(1), 0)} AND NOT {short_end(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {above(cut(1), 1)} THEN {cut(1)} ELSE w END",
    ]
    ending = "CASE WHEN w LIKE '%ed' THEN left(w, length(w) - 2) WHEN w LIKE '%ing' THEN left(w, length(w) - 3) END"
    irregular = values(list(IRREGULAR.items()))
    ctes = [f"w0 AS (SELECT DISTINCT unnest(ts) AS t FROM ({source}))", f"irregular(t, s) AS (FROM {irregular})",
            "v0 AS (SELECT t, t AS w FROM w0 WHERE length(t) > 3 AND t NOT IN (SELECT t FROM irregular))"]
    for i, step in enumerate(steps):
        ctes.append(f"v{i + 1} AS (SELECT t, {step} AS w FROM (SELECT t, w, {ending} AS p FROM v{i}))")
    ctes.append(f"""stems AS (
  SELECT t, w AS s FROM v{len(steps)} UNION ALL
  SELECT t, coalesce(s, t) FROM w0 LEFT JOIN irregular USING (t) WHERE length(t) <= 3 OR s IS NOT NULL)""")
    return ",\n".join(ctes)


def stemmed(keys: str, tokens: str) -> str:
    """keys, ts: the token list ``tokens`` of each row of tok, stemmed."""
    return f"""(SELECT {keys}, coalesce(list(s ORDER BY place), []) AS ts FROM (
    SELECT {keys}, unnest({tokens}) AS t, generate_subscripts({tokens}, 1) AS place FROM tok) JOIN stems USING (t) GROUP BY {keys})"""


ORACLES["rouge_l_stem_pairs"] = f"""
WITH RECURSIVE {PAIRS}, tok AS (SELECT conv_id, turn, {words('a')} AS ta, {words('b')} AS tb FROM pairs),
{stems('SELECT ta AS ts FROM tok UNION ALL SELECT tb FROM tok')},
both_ AS (
  SELECT conv_id, turn, coalesce(a.ts, []) AS ta, coalesce(b.ts, []) AS tb FROM tok
  LEFT JOIN {stemmed('conv_id, turn', 'ta')} a USING (conv_id, turn) LEFT JOIN {stemmed('conv_id, turn', 'tb')} b USING (conv_id, turn)),
{lcs('both_', 'conv_id, turn')}
SELECT conv_id, turn, round({F_MEASURE}, 6) AS rouge_l FROM lcs"""
# Every word of the documents and its stem.
ORACLES["token_stems"] = f"""
WITH tok AS (SELECT {words('text')} AS ts FROM documents UNION ALL SELECT {words('text')} FROM conversations),
{stems('SELECT ts FROM tok')} SELECT t AS token, s AS stem FROM stems"""
ORACLES["answer_normalize"] = f"""
SELECT doc_id, array_to_string(w, ' ') AS normal, CAST(len(w) AS INTEGER) AS tokens
FROM (SELECT doc_id, {normal_words('text')} AS w FROM documents)"""
ORACLES["token_f1"] = f"""
WITH {PAIRS}, tok AS (SELECT conv_id, turn, {normal_words('a')} AS ta, {normal_words('b')} AS tb FROM pairs),
ca AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(ta) AS w FROM tok) GROUP BY ALL),
cb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(tb) AS w FROM tok) GROUP BY ALL),
same AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS n FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, round(CASE
  WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 WHEN same.n IS NULL THEN 0.0
  ELSE CAST(2.0 * same.n / (len(ta) + len(tb)) AS DOUBLE) END, 6) AS f1
FROM tok LEFT JOIN same USING (conv_id, turn)"""
ORACLES["parse_lists"] = """
SELECT p_partkey,
  CASE p_partkey % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN p_name || '!' ELSE p_name || '|' || p_brand END AS items,
  CASE p_partkey % 6 WHEN 3 THEN 'not a list' WHEN 4 THEN 'item is not text' END AS error
FROM part"""
ORACLES["extract_sections"] = f"""
WITH {PAIRS}, k AS (SELECT *, (conv_id + turn) % 5 AS kind FROM pairs)
SELECT conv_id, turn,
  CASE kind WHEN 0 THEN '<dialogue>' || b || '</dialogue>' || a WHEN 1 THEN a || b
            WHEN 3 THEN 'x & y' || a ELSE a END AS cot,
  CASE kind WHEN 1 THEN a || b ELSE b END AS dialogue,
  CASE WHEN kind IN (0, 1) THEN 'search' ELSE 'markup' END AS extraction_path
FROM k"""
ORACLES["judge_scores"] = """
SELECT conv_id, turn, CAST(CASE WHEN turn % 4 <> 3 AND turn + conv_id % 14 BETWEEN 1 AND 10
                                THEN turn + conv_id % 14 END AS DOUBLE) AS score
FROM conversations"""
SPEAKERS = "regexp_extract_all(dialogue, '(#.*?#):', 1)"
FIRST_SEEN = "list_filter(s, lambda x, i: list_position(s, x) = i)"
ORACLES["speakers"] = f"""
WITH {DIALOGUES}
SELECT dialogue_id, array_to_string(s, '|') AS speakers, array_to_string({FIRST_SEEN}, '|') AS names
FROM (SELECT dialogue_id, {SPEAKERS} AS s FROM dialogues)"""


def followup(utterance: str) -> str:
    return f"""dialogue || CASE WHEN len(u) >= 2
    THEN chr(10) || '    ' || CASE WHEN s[-1] = u[2] THEN u[1] ELSE u[2] END || ': ' || {utterance}
    ELSE chr(10) || ' ' || {utterance} END"""


SPOKEN = f"""spoken AS (SELECT *, {FIRST_SEEN} AS u FROM (SELECT *, {SPEAKERS} AS s FROM dialogues))"""
ORACLES["followup_turn"] = f"""
WITH {DIALOGUES}, {SPOKEN} SELECT dialogue_id, {followup(lit('Tell me more.'))} AS dialogue FROM spoken"""
ORACLES["dialogue_text"] = f"WITH {DIALOGUES} SELECT dialogue_id, dialogue FROM dialogues"

# --------------------------------------------------------------------- prompts

ORACLES["sub_topic_prompts"] = f"""
SELECT s_name, md5({fill(DEFAULT.sub_topics, n='6')}) AS system, {fill(DEFAULT.subject, topic='s_name')} AS user FROM supplier"""
ORACLES["persona_prompts"] = f"""
SELECT p_partkey, md5({fill(DEFAULT.personas, n='5')}) AS system, {fill(DEFAULT.subject, topic='p_name')} AS user FROM part"""


def dialogue_prompt(template: str, count: int) -> str:
    shown = f"(SELECT {example_texts(DEFAULT.example, count)} FROM examples)"
    return f"""
WITH {EXAMPLES}
SELECT s_suppkey, md5({fill(template, examples=shown, persona_1='s_name', persona_2='n_name')}) AS system,
  {fill(DEFAULT.talk_about, topic="n_name || ' and ' || s_name")} AS user
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


ORACLES["dialogue_prompts"] = dialogue_prompt(DEFAULT.dialogue_with_reasoning, 4)
ORACLES["dialogue_prompts_plain"] = dialogue_prompt(DEFAULT.dialogue_plain, 2)
ORACLES["judge_prompts"] = f"""
SELECT conv_id, turn, md5({lit(DEFAULT.judge)}) AS system,
  {fill(DEFAULT.to_assess, topic='role', persona_1='conv_id', persona_2='turn', dialogue='text')} AS user
FROM conversations"""
ORACLES["question_prompts"] = f"""
WITH {DIALOGUES} SELECT dialogue_id, md5({fill(DEFAULT.questions, n='4')}) AS system,
  {fill(DEFAULT.to_ask_about, dialogue='dialogue')} AS user FROM dialogues"""
ORACLES["answer_prompts"] = f"""
WITH {PAIRS} SELECT conv_id, turn, md5({lit(DEFAULT.answers)}) AS system,
  {fill(DEFAULT.to_answer_from, passage='a', questions='to_json(string_split(b, chr(10)))')} AS user FROM pairs"""
PROBES = values(list(PROBED_ASPECTS.items())) + " q(metric, question)"
PROBE_TEXT = fill(DEFAULT.probe, question="question", dialogue="dialogue")
ORACLES["probe_prompts"] = f"""
WITH {DIALOGUES} SELECT dialogue_id, metric, md5({PROBE_TEXT}) AS system, {lit(DEFAULT.probe_reply)} AS assistant
FROM dialogues, {PROBES}"""
RATED = values(list(RATED_ASPECTS.items())) + " q(metric, aspect)"
ORACLES["rubric_prompts"] = f"""
WITH {DIALOGUES} SELECT dialogue_id, metric, md5({fill(DEFAULT.rubric, aspect='aspect')}) AS system, dialogue AS user
FROM dialogues, {RATED}"""

# --------------------------------------------------------- vectors and metrics

ORACLES["cosine_pairs"] = """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLES["embedding_match_f1"] = """
WITH v AS (SELECT vec_id, vec_id // 8 AS s, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT a.s, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS c
         FROM v a JOIN v b ON b.s = a.s + 1),
p AS (SELECT s, avg(m) AS p FROM (SELECT s, i, max(c) AS m FROM sims GROUP BY s, i) GROUP BY s),
r AS (SELECT s, avg(m) AS r FROM (SELECT s, j, max(c) AS m FROM sims GROUP BY s, j) GROUP BY s)
SELECT s AS sentence, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1
FROM p JOIN r USING (s)"""
ORACLES["yes_probability"] = """
SELECT vec_id, round(exp(e[label + 1]) / list_sum(list_transform(e, lambda x: exp(x))), 6) AS probability
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
ORACLES["last_yes_position"] = """
SELECT doc_id, CAST(CASE WHEN p > 0 AND len(t) - p - 1 >= 0 THEN len(t) - p - 1 END AS DOUBLE) AS position
FROM (SELECT doc_id, t, list_position(list_reverse(t), 3) AS p
      FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) % 7) AS t FROM documents))"""
ORACLES["expected_rating"] = """
SELECT vec_id, round((exp(x) + 2 * exp(y) + 3 * exp(z)) / (exp(x) + exp(y) + exp(z)), 6) AS rating
FROM (SELECT vec_id, list_sum(list_filter(e, lambda v, i: i % 3 = 1)) AS x,
             list_sum(list_filter(e, lambda v, i: i % 3 = 2)) AS y, list_sum(list_filter(e, lambda v, i: i % 3 = 0)) AS z
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""

FED_ROWS = f"""fed AS (
  SELECT dialogue_id, metric,
    coalesce(avg(loss) FILTER (polarity = 'negative'), 0) - coalesce(avg(loss) FILTER (polarity = 'positive'), 0) AS value
  FROM (SELECT dialogue_id, metric, polarity, length({followup('utterance')}) / 100.0 AS loss FROM spoken, {FOLLOWUP_ROWS})
  GROUP BY dialogue_id, metric)"""
ORACLES["fed_score"] = f"""
WITH {DIALOGUES}, {SPOKEN}, {FED_ROWS}
SELECT dialogue_id, {", ".join(
    f"CAST(round(max(value) FILTER (metric = {lit(m)}), 6) AS DOUBLE) AS {m.replace(' ', '_')}" for m in FOLLOWUPS)}
FROM fed GROUP BY dialogue_id"""
GPT_ROWS = f"""gpt AS (
  SELECT dialogue_id, metric, exp(((p * 8) % 11) / 10.0)
    / list_sum(list_transform(range(1, 9), lambda v: exp(((p * v) % 11) / 10.0))) AS value
  FROM (SELECT dialogue_id, metric, len(string_split({PROBE_TEXT}, ' ')) - 1 AS p FROM dialogues, {PROBES}))"""
ORACLES["gpt_score"] = f"""
WITH {DIALOGUES}, {GPT_ROWS} SELECT dialogue_id, metric, round(value, 6) AS value FROM gpt"""
RATING = "exp((n % 3) / 2.0) AS x, exp((n % 5) / 2.0) AS y, exp((n % 7) / 2.0) AS z"
EVAL_ROWS = f"""rated AS (
  SELECT dialogue_id, metric, (x + 2 * y + 3 * z) / (x + y + z) AS value FROM (
    SELECT dialogue_id, metric, {RATING} FROM (
      SELECT dialogue_id, metric, length(dialogue) AS n FROM dialogues, {RATED})))"""
ORACLES["g_eval"] = f"""
WITH {DIALOGUES}, {EVAL_ROWS} SELECT dialogue_id, metric, round(value, 6) AS value FROM rated"""
ORACLES["quality_metrics"] = f"""
WITH {DIALOGUES}, {SPOKEN}, {FED_ROWS}, {GPT_ROWS}, {EVAL_ROWS}
SELECT family, metric, round(avg(value), 5) AS mean FROM (
  SELECT 'fed' AS family, metric, CAST(value AS DOUBLE) AS value FROM fed
  UNION ALL SELECT 'gpt_score', metric, value FROM gpt UNION ALL SELECT 'g_eval', metric, value FROM rated)
GROUP BY family, metric"""

# A dialogue fails in the first run where its length divides by seven; the second client rates all 2.
ORACLES["score_ledger"] = f"""
WITH {DIALOGUES}, {EVAL_ROWS}, one AS (SELECT dialogue_id, round(value, 6) AS coherence FROM rated WHERE metric = 'coherence'),
runs(run) AS (VALUES ('first'), ('second'), ('third'))
SELECT run, dialogue_id,
  CASE WHEN length(dialogue) % 7 <> 0 THEN coherence WHEN run <> 'first' THEN CAST(2.0 AS DOUBLE) END AS coherence,
  CASE WHEN length(dialogue) % 7 = 0 AND run = 'first' THEN 'RuntimeError: overloaded' END AS error
FROM dialogues JOIN one USING (dialogue_id), runs"""
ORACLES["score_counts"] = f"""
WITH {DIALOGUES}, n AS (
  SELECT count(*) FILTER (length(dialogue) % 7 <> 0) AS good, count(*) FILTER (length(dialogue) % 7 = 0) AS bad FROM dialogues)
SELECT 'first' AS run, metric, good AS scored, bad AS missing FROM n, {RATED}
UNION ALL SELECT 'all', 'rows', good + bad, bad FROM n"""
ORACLES["vector_ledger"] = """
SELECT conv_id, turn, CAST((length(text) - length(replace(text, 'e', ''))) * CASE role WHEN 'user' THEN 1 ELSE 2 END AS DOUBLE) AS e,
  16 AS size FROM conversations"""


def match(a: str, b: str) -> str:
    """Cosine of two token vectors (length of the word, 1)."""
    return f"(({a}) * ({b}) + 1) / (sqrt(({a}) * ({a}) + 1) * sqrt(({b}) * ({b}) + 1))"


# An answer is a question word and how often the passage has it.
QA_ROWS = f"""{ROWS}, asked AS (
  SELECT id, dialogue, predicted_summary, list_filter(string_split(dialogue, ' '), lambda w: w <> '')[1:3] AS qs
  FROM rows_),
readable AS (SELECT * FROM asked WHERE len(list_filter(qs, lambda q: contains(q, ']'))) = 0),
q AS (
  SELECT id, pos, list_transform(string_split(q || ' ' || ((length(dialogue) - length(replace(dialogue, q, ''))) // length(q)), ' '), lambda w: CAST(length(w) AS DOUBLE)) AS d,
         list_transform(string_split(q || ' ' || ((length(predicted_summary) - length(replace(predicted_summary, q, ''))) // length(q)), ' '), lambda w: CAST(length(w) AS DOUBLE)) AS s
  FROM (SELECT id, dialogue, predicted_summary, unnest(qs) AS q, unnest(range(len(qs))) AS pos FROM readable)),
pr AS (
  SELECT id, pos,
    list_avg(list_transform(s, lambda x: list_max(list_transform(d, lambda y: {match('x', 'y')})))) AS p,
    list_avg(list_transform(d, lambda x: list_max(list_transform(s, lambda y: {match('x', 'y')})))) AS r
  FROM q),
qa AS (SELECT id, pos, 2 * p * r / (p + r) AS score FROM pr)"""
ORACLES["qags"] = f"WITH {QA_ROWS} SELECT id, round(avg(score), 6) AS qags FROM qa GROUP BY id"
ORACLES["qags_chunked"] = f"""
WITH {QA_ROWS} SELECT chunk, round(sum(score) / 3, 6) AS mean FROM (
  SELECT score, (row_number() OVER (ORDER BY CAST(id AS BIGINT), pos) - 1) // 3 AS chunk FROM qa) GROUP BY chunk"""

# Scores of the first line (predicted) against the last line of a document.
# Equal lines are their own common subsequence, and the best partner of a token
# only depends on which word lengths occur.
TEXT_SCORES = f"""tok AS (SELECT id, {words('summary')} AS ta, {words('predicted_summary')} AS tb FROM rows_),
unequal AS (SELECT * FROM tok WHERE ta <> tb),
{lcs('unequal', 'id')},
overlap AS (SELECT id, n, na, nb FROM lcs UNION ALL SELECT id, len(ta), len(ta), len(tb) FROM tok WHERE ta = tb),
wl AS (SELECT id,
    list_transform(string_split(predicted_summary, ' '), lambda w: CAST(length(w) AS DOUBLE)) AS pw,
    list_transform(string_split(summary, ' '), lambda w: CAST(length(w) AS DOUBLE)) AS sw FROM rows_),
wd AS (SELECT id, pw, sw, list_distinct(pw) AS pd, list_distinct(sw) AS sd FROM wl),
bs AS (SELECT id,
    list_avg(list_transform(pw, lambda x: list_max(list_transform(sd, lambda y: {match('x', 'y')})))) AS p,
    list_avg(list_transform(sw, lambda x: list_max(list_transform(pd, lambda y: {match('x', 'y')})))) AS r FROM wd),
scores AS (
  SELECT id, 'rouge_l' AS metric, CAST({F_MEASURE} AS DOUBLE) AS value FROM overlap
  UNION ALL SELECT id, 'bert_score', 2 * p * r / (p + r) FROM bs)"""
TURN_ROWS = f"""{DIALOGUES}, {PAIRS}, rows_ AS (
  SELECT conv_id || '-' || turn AS id, dialogue, b AS summary, a AS predicted_summary
  FROM pairs JOIN dialogues ON dialogue_id = CAST(conv_id AS VARCHAR))"""
# Two runs predict the first and the last line of a dialogue; its second line is the reference.
RUN_ROWS = f"""{DIALOGUES}, runs(run) AS (VALUES ('first'), ('last')), rows_ AS (
  SELECT run || '/' || dialogue_id AS id, dialogue, string_split(dialogue, chr(10))[2] AS summary,
    string_split(dialogue, chr(10))[CASE run WHEN 'first' THEN 1 ELSE -1 END] AS predicted_summary FROM dialogues, runs)"""
ORACLES["summary_scores"] = f"""
WITH RECURSIVE {QA_ROWS.replace(ROWS, TURN_ROWS)}, {TEXT_SCORES}
SELECT id, metric, round(value, 6) AS value FROM scores
UNION ALL SELECT id, 'qags', round(avg(score), 6) FROM qa GROUP BY id"""
ORACLES["prediction_file_scores"] = f"""
WITH RECURSIVE {TURN_ROWS}, {TEXT_SCORES} SELECT metric, round(avg(value), 5) AS mean FROM scores GROUP BY metric"""
ORACLES["summary_predictions"] = f"""
WITH {RUN_ROWS} SELECT split_part(id, '/', 1) AS run_id, split_part(id, '/', 2) AS id, predicted_summary FROM rows_"""
ORACLES["summary_run_scores"] = f"""
WITH RECURSIVE {QA_ROWS.replace(ROWS, RUN_ROWS)}, {TEXT_SCORES},
all_ AS (SELECT id, metric, value FROM scores UNION ALL SELECT id, 'qags', avg(score) FROM qa GROUP BY id)
SELECT split_part(id, '/', 1) AS run_id, metric, round(avg(value), 5) AS mean, count(value) AS scored,
  count(*) - count(value) AS missing FROM all_ GROUP BY ALL"""
ORACLES["response_predictions"] = f"""
WITH {ROWS}, c AS {split_dialogue('rows_')}
SELECT 'first_line' AS run_id, id, md5(string_split(context, chr(10))[1]) AS predicted_response FROM c
UNION ALL SELECT 'whole', id, md5(context) FROM c"""

# The stand-in's lists, after the near copies in them are dropped.
ORACLES["generation_run"] = f"""
WITH subs AS (
  SELECT s_name AS t, unnest(['price trends of ' || s_name, 'delivery delays at ' || s_name]) AS s FROM supplier),
people AS (
  SELECT t, s, ['A buyer new to the trade', 'The clerk counting ' || length(s) || ' crates at night',
                'Someone else entirely'] AS p FROM subs),
pairs AS (
  SELECT t, s, p[ij[1]] AS p1, p[ij[2]] AS p2
  FROM (SELECT t, s, p, unnest([[1, 2], [1, 3], [2, 3]]) AS ij FROM people)),
said AS (
  SELECT *, '#A#: I think about ' || s || '.' || chr(10) || '#B#: So does ' || p2 || '.' AS d FROM pairs),
judged AS (
  SELECT *, length({fill(DEFAULT.to_assess, topic='s', persona_1='p1', persona_2='p2', dialogue='d')}) % 12 AS n FROM said)
SELECT t AS base_topic, s AS sub_topic, p1 AS persona_1, p2 AS persona_2, d AS dialogue, s AS cot,
  'A talk of ' || length(d) || ' characters' AS summary,
  CAST(CASE WHEN n BETWEEN 1 AND 10 THEN n END AS DOUBLE) AS llm_judge_score
FROM judged"""

# Two runs with one sub-topic and three personas, of which the second is like the first: one pair of people a topic.
TWO_RUNS = f"""said AS (
  SELECT s_suppkey % 2 = 0 AS even, 'price trends of ' || s_name AS s, 'A buyer new to the trade' AS p1,
    'The clerk counting ' || length('price trends of ' || s_name) || ' crates at night' AS p2 FROM supplier),
talks AS (SELECT *, '#A#: I think about ' || s || '.' || chr(10) || '#B#: So does ' || p2 || '.' AS d FROM said)"""
JUDGED = f"""
WITH {TWO_RUNS}, n AS (
  SELECT *, length({fill(DEFAULT.to_assess, topic='s', persona_1='p1', persona_2='p2', dialogue='d')}) % 12 AS n FROM talks WHERE even)
SELECT s AS sub_topic, p1 AS persona_1, p2 AS persona_2, 'A talk of ' || length(d) || ' characters' AS summary,
  CAST(CASE WHEN n BETWEEN 1 AND 10 THEN n END AS DOUBLE) AS llm_judge_score FROM n"""
ORACLES["stage_summary"] = ORACLES["stage_judge"] = JUDGED
ORACLES["stage_metrics"] = f"""
WITH {TWO_RUNS}, rated AS (SELECT s, p2, {RATING} FROM (SELECT s, p2, length(d) AS n FROM talks WHERE even))
SELECT s AS sub_topic, p2 AS persona_2, round((x + 2 * y + 3 * z) / (x + y + z), 6) AS coherence, false AS judged FROM rated"""
ORACLES["stage_manifest"] = """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (s_suppkey % 2 = 0) AS e FROM supplier),
steps(name, made_from, starts) AS (VALUES ('sub_topics', NULL, ''), ('personas', 'sub_topics', ''),
  ('dialogues', 'personas', 'summary'), ('summaries', 'dialogues', 'llm_judge,metrics'), ('judged', 'summaries', ''))
SELECT 'one' AS run_id, name, made_from, a AS rows, '' AS starts FROM steps, n
UNION ALL SELECT 'two', name, made_from, e, starts FROM steps, n WHERE name <> 'judged'"""
# Three personas stay of four; a name ending in 2 loses the pair (buyer, clerk).
ODD_TOPICS = """topics AS (
  SELECT s_name AS t, CAST(s_name[-1] AS INTEGER) % 2 = 1 AS odd, s_name[-1] = '2' AS two FROM supplier)"""
ORACLES["drop_scope"] = f"""
WITH {ODD_TOPICS} SELECT t AS base_topic, count(*) * 6 AS dialogues FROM topics WHERE NOT odd AND NOT two GROUP BY t"""
ORACLES["progress_counts"] = f"""
WITH {ODD_TOPICS}, n AS (
  SELECT count(*) AS a, count(*) FILTER (odd) AS o, count(*) FILTER (two) AS w FROM topics)
SELECT unnest(['errors/sub_topics', 'sub_topics', 'errors/personas', 'personas', 'errors/dialogues', 'dialogues', 'errors/summary', 'summaries']) AS name,
  unnest([0, 2 * a, 2 * o, 2 * (a - o), 2 * w, 6 * (a - o) - 2 * w, 0, 6 * (a - o) - 2 * w]) AS rows FROM n"""
ORACLES["persona_groups"] = """
WITH subs AS (
  SELECT n_name || ' port ' || s_suppkey % 40 AS s, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s)
SELECT s AS sub_topic, repeat('A buyer new to the trade|The clerk counting ' || length(s) || ' crates at night|Someone else entirely|', n)[:-2] AS personas
FROM subs"""
