"""DuckDB SQL of the operators that SQL can express."""

from persona_spark.llm.common import UPPER
from persona_spark.llm.merkle_sql import merkle_sql, spelling_sql
from persona_spark.llm.license_scan import GRAM, MIN_SHARE, PHRASES, SLACK, TEMPLATES
from persona_spark.llm.quality_rules import MEASURES, STOP_WORDS, THRESHOLDS

_WHITE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _rules() -> str:
    tests = []
    for t in THRESHOLDS:
        if t.least is not None:
            tests.append(f"coalesce({t.measure} >= {t.least}, true)")
        if t.most is not None:
            tests.append(f"coalesce({t.measure} <= {t.most}, true)")
    return " AND ".join(tests)


def _stop_share() -> str:
    cases = " ".join(
        f"WHEN '{lang}' THEN list_filter(words, lambda w: lower(w) IN ({', '.join(repr(x) for x in words)}))"
        for lang, words in STOP_WORDS.items()
    )
    return f"len(CASE lang {cases} END) / nullif(n_words, 0)::DOUBLE"


def quality_sql(table: str) -> str:
    """A query for the columns of `table` and those of the quality rules."""
    return rf"""
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_rules()} AS kept
FROM (
  SELECT *, word_chars / nullif(n_words, 0)::DOUBLE AS mean_word_length,
    n_symbols / nullif(n_words, 0)::DOUBLE AS symbols_per_word,
    (length(body) - length(replace(body, '!', ''))) / nullif(n_words, 0)::DOUBLE AS exclamations_per_word,
    {_stop_share()} AS stop_word_share,
    n_dup_lines / nullif(len(lines), 0)::DOUBLE AS duplicate_line_share
  FROM (
    SELECT *, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce((SELECT sum(least(8, coalesce(nxt - i, 8))) FROM (
        SELECT i, lead(i) OVER (ORDER BY i) AS nxt FROM (
          SELECT i, count(*) OVER (PARTITION BY w) AS n FROM (
            SELECT unnest(range(1, len(words) - 6)) AS i,
              unnest(list_transform(range(1, len(words) - 6), lambda k: array_to_string(words[k:k + 7], ' '))) AS w
          )) WHERE n > 1)), 0)::BIGINT AS n_repeat_words
    FROM (
      SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(body, chr(10)), lambda l: trim(l, {_WHITE}) <> '') AS lines
      FROM (SELECT *, coalesce(text, '') AS body FROM {table}))))
"""


def license_sql() -> str:
    def words(text):
        low = f"translate({text}, '{UPPER}', '{UPPER.lower()}')"
        return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def grams(table, keys, positions):
        return f"""SELECT {keys}, unnest(range(1, len(words) - {GRAM - 2})) AS {positions},
          unnest(list_transform(range(1, len(words) - {GRAM - 2}),
            lambda k: array_to_string(words[k:k + {GRAM - 1}], ' '))) AS gram FROM {table}"""

    texts = [(label, text) for label, all_texts in TEMPLATES.items() for text in all_texts]
    values = ", ".join(f"('{label}', {n}, '{text}')" for n, (label, text) in enumerate(texts))
    starts = ", ".join(
        f"list_filter(range(1, len(words) + 1), lambda i: words[i:i + {len(phrase.split()) - 1}] = "
        f"{phrase.split()}) AS s{n}"
        for n, phrase in enumerate(PHRASES)
    )
    every = " || ".join(f"s{n}" for n in range(len(PHRASES)))
    labels = ", ".join(f"CASE WHEN len(s{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
    joined = "coalesce(array_to_string(list_sort(list_distinct({})), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS words FROM documents),
t AS (SELECT label, template, {words("text")} AS words FROM (VALUES {values}) v(label, template, text)),
hits AS (SELECT doc_id, template, p - q AS diagonal, p FROM ({grams("d", "doc_id", "p")}) JOIN
  ({grams("t", "template", "q")}) USING (gram)),
votes AS (SELECT doc_id, template, diagonal, min(p) AS a, max(p) AS b FROM hits GROUP BY ALL),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {SLACK} THEN 0 ELSE 1 END AS step FROM votes
  WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
spans AS (SELECT doc_id, template, min(a) AS a, max(b) + {GRAM - 1} AS b FROM (
  SELECT *, sum(step) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM steps)
  GROUP BY doc_id, template, span),
good AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM (
  SELECT doc_id, label, len(list_intersect(list_distinct(d.words[a:b]), list_distinct(t.words)))
    / len(list_distinct(t.words))::DOUBLE AS share
  FROM spans JOIN d USING (doc_id) JOIN t USING (template)) WHERE share >= {MIN_SHARE} GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  {joined.format("base")} AS base_labels, {joined.format("base || coalesce(labels, [])")} AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM (SELECT *, {every} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base
  FROM (SELECT *, {starts} FROM d)) LEFT JOIN good USING (doc_id)
"""


CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(13 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C')) + length(replace(replace(text, '%', '%25'), '<', '%3C')))
    OVER (o ROWS UNBOUNDED PRECEDING) AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, max(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples
FROM t GROUP BY conv_id
"""


def line_dedup_sql(table: str) -> str:
    """doc_id, n_lines, n_dropped, kept text. Holds for tables whose doc_id is unique."""
    key = f"translate(trim(line, {_WHITE}), '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH l AS (SELECT doc_id, i, line, {key} AS k FROM (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}))),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '') AS kept
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""


ORACLES = {
    "op5_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({line_dedup_sql('documents')})",
    "op6_chat_format": CHAT_SQL,
    "op10_license_scan": license_sql(),
    "op12_spelling_variants": spelling_sql("documents"),
    "op13_merkle_manifest": merkle_sql("documents"),
    "op8_quality_rules": "SELECT doc_id, "
    + ", ".join([*MEASURES, *[t.measure for t in THRESHOLDS]])
    + f", base_failed, kept FROM ({quality_sql('documents')})",
}
