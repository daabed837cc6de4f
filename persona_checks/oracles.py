"""The same results in SQL for DuckDB, written apart from the Spark code."""

from string import Formatter

from persona_checks.queries import CAP_LEN, EXTRA_TEMPLATE, PACK_LEN, TAIL_LINES
from persona_checks.views import VIEWS
from persona_checks.wording import PERSONA_TEMPLATE, POOL, STRUCTURE
from persona_spark.functions import values as V


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **columns: str) -> str:
    """SQL for a template with columns in place of its fields."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if name:
            parts.append(f"({columns[name]})")
    return " || ".join(parts)


PERSONA_COLUMNS = {f: f"coalesce({f}, {text('the user' if f == 'name' else '')})" for f in V.PERSONA_FIELDS}
PROMPT = filled(PERSONA_TEMPLATE, **PERSONA_COLUMNS)
PROMPT_STRUCTURED = f"{PROMPT} || {text(chr(10) * 2 + STRUCTURE)}"
BLANKS = r"E' \t\n\r'"

DAY = "try_cast(substr(created_time, 1, 10) AS DATE)"


def _pool() -> str:
    always = [
        *map(text, POOL.identity),
        *[filled(p, title="lower(title)") for p in POOL.about_title],
        *map(text, POOL.open_ended),
        *map(text, POOL.greetings),
    ]
    dated = [filled(p, date=f"strftime({DAY}, '%B %d, %Y')") for p in POOL.about_date]
    both = ", ".join(always)
    return f"CASE WHEN {DAY} IS NULL THEN [{both}] ELSE [{both}, {', '.join(dated)}] END"


# Common table expressions on top of the views, in order of use.
EXTRA = {
    "usable": f"""
SELECT id, persona_id, title, CASE WHEN coalesce(content, '') <> '' THEN content ELSE alt_content END AS content,
  created_time, ingest_pos FROM memories
WHERE trim(coalesce(CASE WHEN coalesce(content, '') <> '' THEN content ELSE alt_content END, ''), {BLANKS}) <> ''""",
    "titled": "SELECT id, persona_id, coalesce(title, 'Memory') AS title, created_time, ingest_pos FROM memories",
    "pooled": f"SELECT *, {_pool()} AS candidates FROM titled",
    "picked": "SELECT *, candidates[1 + ('0x' || substr(md5(id || ':3407'), 1, 8))::BIGINT % len(candidates)] AS user_prompt FROM pooled",
    "prompts": f"SELECT persona_id, {PROMPT_STRUCTURED} AS system_prompt FROM personas",
    "built": """
SELECT u.id, u.persona_id, u.ingest_pos, p.system_prompt, k.user_prompt, u.content
FROM usable u JOIN picked k ON k.id = u.id JOIN prompts p ON p.persona_id = u.persona_id""",
    "rendered": f"""
SELECT *, '<start_of_turn>user' || chr(10) || trim(system_prompt, {BLANKS}) || chr(10) || chr(10) || trim(user_prompt, {BLANKS})
  || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || trim(content, {BLANKS}) || '<end_of_turn>' || chr(10) AS text
FROM built""",
    "labelled": f"""
SELECT *, {DAY} AS day, title || CASE WHEN {DAY} IS NULL THEN '' ELSE ' (' || strftime({DAY}, '%b %d, %Y') || ')' END AS label
FROM titled""",
    "label_ids": """
SELECT persona_id, label, id FROM labelled
QUALIFY row_number() OVER (PARTITION BY persona_id, label ORDER BY day NULLS FIRST, ingest_pos DESC) = 1""",
    "note_pages": f"""
SELECT d.doc_id, 'm' || d.doc_id AS id, d.doc_id % 150 AS persona_id, d.text, d.doc_id AS ingest_pos,
  CASE WHEN d.doc_id % 7 = 0 THEN 'Page ' || right('m' || d.doc_id, 8)
       WHEN d.doc_id % 5 = 0 THEN d.source || ' by ' || d.lang ELSE 'Note ' || d.source END AS shown_title,
  CASE WHEN d.doc_id % 7 <> 0 AND d.doc_id % 5 = 0 THEN ' ' || d.source ELSE 'Memory' END AS title,
  CASE WHEN d.doc_id % 11 = 0 OR d.doc_id % 13 = 0 THEN NULL ELSE CAST(e.ts AS DATE) END AS day,
  CASE WHEN d.doc_id % 11 = 0 THEN 'not a date' WHEN d.doc_id % 13 = 0 THEN NULL
       ELSE CAST(CAST(e.ts AS DATE) AS VARCHAR) || 'T23:30:00-05:00' END AS created_time
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "page_labels": """
SELECT *, shown_title || CASE WHEN day IS NULL THEN '' ELSE ' (' || strftime(day, '%b %d, %Y') || ')' END AS label
FROM note_pages""",
    "fetched": """
SELECT n.doc_id // 50 AS dump_id, n.doc_id // 50 AS event_no, n.*, n.text AS fetched_text FROM note_pages n
UNION ALL
SELECT 1000000 + n.doc_id // 50 AS dump_id, 100 + n.doc_id // 50 AS event_no, n.*,
  CASE WHEN l.doc_id IS NULL THEN n.text ELSE 'v2 ' || n.text END AS fetched_text
FROM note_pages n LEFT JOIN labels l ON l.doc_id = n.doc_id""",
    "listed": """
SELECT f.dump_id, f.dump_id % 150 AS dump_persona, f.id, f.created_time, f.fetched_text,
  f.dump_id * 134217728 + ((f.doc_id % 50) // 10) * 1024 + f.doc_id % 10 AS listed_pos
FROM fetched f JOIN events e ON e.event_id = f.event_no WHERE e.event_type <> 'error'""",
    "newest": """
SELECT id, dump_persona AS persona_id, fetched_text AS alt_content, listed_pos AS ingest_pos FROM listed
QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_pos DESC) = 1""",
    "upserted": """
SELECT id, content, ingest_pos FROM store_old o WHERE NOT EXISTS (SELECT 1 FROM store_new n WHERE n.id = o.id)
UNION ALL
(SELECT id, content, ingest_pos FROM store_new WHERE id <> ''
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_pos DESC) = 1)""",
    "plans": """
SELECT run_id, CASE WHEN trim(custom_model) <> '' THEN trim(custom_model) ELSE selected_model END AS model_id,
  contains(mode, 'Full Fine-tune') AS full_tuning,
  CASE WHEN contains(mode, 'Full Fine-tune') THEN 'merged_16bit' ELSE 'lora' END AS save_method,
  './outputs/' || output_name AS output_dir,
  array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
  coalesce(CAST(CAST(trunc(nullif(age, 0)) AS BIGINT) AS VARCHAR), '') AS age
FROM run_requests""",
    "rules": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({text(s)}, {text(k)}, {text(kind)}, {text(d)}, {'NULL' if m is None else m}::DOUBLE)"
        for s, k, kind, d, m in V.SETTING_RULES
    )
    + ") r(section, key, kind, default_value, minimum)",
    "defaults": "SELECT * FROM (VALUES "
    + ", ".join(f"({text(s)}, {text(k)}, {text(v)})" for s, k, v in V.DEFAULT_SETTINGS)
    + ") d(section, key, value)",
    "asked": f"""
SELECT q.question_id, q.message,
  CASE WHEN coalesce(q.system_prompt, '') <> '' THEN q.system_prompt
       WHEN p.persona_id IS NULL THEN {text(PERSONA_TEMPLATE)} ELSE p.system_prompt END AS system_text
FROM questions q LEFT JOIN prompts p ON p.persona_id = q.persona_id
WHERE trim(coalesce(q.message, ''), {BLANKS}) <> ''""",
}


def with_views(body: str, *names: str) -> str:
    """`body` behind the views and expressions it names; it may add more with a leading comma."""
    sources = {**VIEWS, **EXTRA}
    return "WITH " + ",\n".join(f"{n} AS ({sources[n].strip()})" for n in names) + "\n" + body.strip()


BUILT = ("memories", "personas", "usable", "titled", "pooled", "picked", "prompts", "built")
LISTED = ("note_pages", "fetched", "listed")

# A walk along the cursors from the first response of each dump whose cursors are told apart.
CHAINS = f"""
WITH RECURSIVE cursor_turns AS ({VIEWS["cursor_turns"]}),
r AS (SELECT *, coalesce('=' || start_cursor, '') AS asked, CASE WHEN has_more THEN '=' || next_cursor END AS nxt FROM cursor_turns),
odd AS (
  SELECT DISTINCT dump_id, 'fork' AS fault FROM r GROUP BY dump_id, asked HAVING count(*) > 1
  UNION SELECT dump_id, 'join' FROM r WHERE nxt IS NOT NULL GROUP BY dump_id, nxt HAVING count(*) > 1
  UNION SELECT dump_id, 'gap' FROM r WHERE nxt IS NOT NULL AND (dump_id, nxt) NOT IN (SELECT (dump_id, asked) FROM r)
  UNION SELECT dump_id, 'loose' FROM r WHERE asked <> '' AND (dump_id, asked) NOT IN (SELECT (dump_id, nxt) FROM r WHERE nxt IS NOT NULL)
  UNION SELECT dump_id, 'no start' FROM r GROUP BY dump_id HAVING count(*) FILTER (WHERE asked = '') = 0
  UNION SELECT dump_id, 'open' FROM r WHERE has_more AND next_cursor IS NULL),
walk AS (
  SELECT dump_id, asked, nxt, 0::BIGINT AS response_no, turn, text FROM r WHERE asked = '' AND dump_id NOT IN (SELECT dump_id FROM odd)
  UNION ALL SELECT r.dump_id, r.asked, r.nxt, response_no + 1, r.turn, r.text FROM walk w JOIN r ON r.dump_id = w.dump_id AND r.asked = w.nxt),
faults AS (SELECT * FROM odd UNION ALL SELECT dump_id, 'loop' FROM r WHERE dump_id NOT IN (SELECT dump_id FROM odd) GROUP BY dump_id
  HAVING count(*) > (SELECT count(*) FROM walk WHERE walk.dump_id = r.dump_id))
"""

ORACLES = {
    "number_responses": f"{CHAINS} SELECT dump_id, response_no, turn, text FROM walk WHERE dump_id NOT IN (SELECT dump_id FROM faults)",
    "chain_faults": f"{CHAINS} SELECT dump_id, fault FROM faults",
    "page_responses": with_views(
        "SELECT dump_id, dump_persona AS persona_id, listed_pos AS ingest_pos, id, created_time FROM listed", *LISTED
    ),
    "object_split": with_views("SELECT id, object || 's' AS part FROM entries", "entries"),
    "store_read": with_views(
        "SELECT o.*, s.pos FROM store_old o JOIN selection s ON s.id = o.id", "store_old", "selection"
    ),
    "store_upsert": with_views("SELECT * FROM upserted", "store_old", "store_new", "upserted"),
    "store_upsert_on_disk": with_views("SELECT * FROM upserted", "store_old", "store_new", "upserted"),
    "store_fetch_on_disk": with_views(
        "SELECT u.*, s.pos FROM upserted u JOIN selection s ON s.id = u.id", "store_old", "store_new", "selection", "upserted"
    ),
    "store_export_json": with_views("SELECT * FROM memories", "memories"),
    "training_set_sink": with_views(
        "SELECT id, persona_id, 3::BIGINT AS n_messages, text FROM rendered", *BUILT, "rendered"
    ),
    "log_read": "SELECT event_id, event_id || chr(9) || props AS line, 0::BIGINT AS off_by FROM events",
    "flatten_blocks": "SELECT 'm' || doc_id AS id, text AS content FROM documents",
    "display_title": with_views("SELECT id, shown_title AS display_title FROM note_pages", "note_pages"),
    "prompt_title": with_views("SELECT id, title FROM note_pages", "note_pages"),
    "prompt_title_plain": with_views("SELECT id, title FROM titled", "memories", "titled"),
    "created_date": with_views(f"SELECT id, strftime({DAY}, '%Y-%m-%d') AS created_date FROM memories", "memories"),
    "display_label": with_views("SELECT id, label FROM page_labels", "note_pages", "page_labels"),
    "first_truthy": with_views(
        "SELECT id, coalesce(nullif(content, ''), alt_content) AS content, created_time FROM memories", "memories"
    ),
    "drop_blank": with_views("SELECT id, persona_id, content FROM usable", "memories", "usable"),
    "persona_prompt": with_views("SELECT * FROM prompts", "personas", "prompts"),
    "persona_prompt_extras": with_views(
        f"SELECT persona_id, {filled(EXTRA_TEMPLATE, **PERSONA_COLUMNS, segment='upper(hobbies)')} AS system_prompt FROM personas",
        "personas",
    ),
    "prompt_candidates": with_views(
        "SELECT id, len(candidates)::BIGINT AS n, array_to_string(candidates, '|') AS candidates FROM pooled",
        "memories", "titled", "pooled",
    ),
    "pick_prompt": with_views("SELECT id, user_prompt FROM picked", "memories", "titled", "pooled", "picked"),
    "select_memories": with_views(
        "SELECT id, persona_id, content FROM memories WHERE id IN (SELECT id FROM selection)", "memories", "selection"
    ),
    "attach_persona": with_views(
        f"SELECT u.id, u.persona_id, {PROMPT} AS system_prompt, u.content FROM usable u JOIN personas p ON p.persona_id = u.persona_id",
        "memories", "usable", "personas",
    ),
    "to_conversation": with_views(
        """SELECT id, persona_id, system_prompt AS system_text, user_prompt AS user_text, content AS assistant_text,
        'system,user,assistant' AS roles FROM built WHERE id IN (SELECT id FROM selection)""",
        *BUILT, "selection",
    ),
    "render_chat": with_views("SELECT id, text FROM rendered", *BUILT, "rendered"),
    "render_template_text": with_views(
        f"""SELECT id, text, text || '<|im_start|>assistant' || chr(10) AS prompt FROM (SELECT id, {' || '.join(
            f"'<|im_start|>{role}' || chr(10) || trim({column}, {BLANKS}) || '<|im_end|>' || chr(10)"
            for role, column in (("system", "system_prompt"), ("user", "user_prompt"), ("assistant", "content"))
        )} AS text FROM built)""",
        *BUILT,
    ),
    "supervised_spans": with_views(
        f"""SELECT id, 0::BIGINT AS span_no, trim(content, {BLANKS}) || '<end_of_turn>' || chr(10) AS span_text,
        length(trim(content, {BLANKS}) || '<end_of_turn>' || chr(10))::BIGINT AS n_chars FROM usable""",
        "memories", "usable",
    ),
    "token_labels": with_views(
        r"""SELECT id, asked + answered AS n_tokens, answered AS n_learned, asked AS first_learned, true AS labels_are_ids FROM (
        SELECT id, len(regexp_extract_all(left(text, opened), '[^ \t\n\r\v\f]+'))::BIGINT AS asked,
          len(regexp_extract_all(substr(text, opened + 1), '[^ \t\n\r\v\f]+'))::BIGINT AS answered
        FROM (SELECT id, text, instr(text, '<start_of_turn>model' || chr(10)) + length('<start_of_turn>model') AS opened FROM rendered))""",
        *BUILT, "rendered",
    ),
    "cap_length": rf"""SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t[1:{CAP_LEN}], ' ') AS tokens
        FROM (SELECT doc_id, string_split_regex(trim(text, {BLANKS}), '\s+') AS t FROM documents)""",
    "pack_sequences": with_views(
        rf"""
, tok AS (SELECT persona_id, id, ingest_pos, string_split_regex(trim(content, {BLANKS}), '\s+') AS t FROM usable),
off AS (SELECT *, len(t) AS n, CAST(coalesce(sum(len(t)) OVER (PARTITION BY persona_id ORDER BY ingest_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM tok),
blk AS (SELECT *, unnest(range(o // {PACK_LEN}, (o + n - 1) // {PACK_LEN} + 1)) AS b FROM off),
pieces AS (SELECT *, greatest(b * {PACK_LEN} - o, 0) AS s, least((b + 1) * {PACK_LEN} - o, n) AS e FROM blk)
SELECT persona_id, b::BIGINT AS block_id, string_agg(id, ',' ORDER BY ingest_pos) AS members, sum(e - s)::BIGINT AS n_tokens,
  string_agg(array_to_string(t[s + 1:e], ' '), ' ' ORDER BY ingest_pos) AS text
FROM pieces GROUP BY persona_id, b""",
        "memories", "usable",
    ),
    "map_examples": rf"SELECT doc_id, len(string_split_regex(trim(text, {BLANKS}), '\s+'))::BIGINT AS n_words FROM documents",
    "training_schedule": with_views(
        """
, sizes AS (SELECT persona_id, ((count(*) + 7) // 8)::BIGINT AS steps FROM usable GROUP BY persona_id),
seen AS (SELECT u.persona_id, u.id, steps, unnest(range(0, ((60 + steps - 1) // steps)::BIGINT)) AS epoch
  FROM usable u JOIN sizes s ON s.persona_id = u.persona_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY persona_id, epoch ORDER BY md5(id || ':' || epoch || ':3407')) - 1 AS pos FROM seen)
SELECT persona_id, epoch, epoch * steps + pos // 8 AS step, pos // 2 AS micro_batch, id FROM placed
WHERE epoch * steps + pos // 8 < 60""",
        "memories", "usable",
    ),
    "training_schedule_one_run": with_views(
        """
, seen AS (SELECT id, unnest(range(0, 2)) AS epoch, (SELECT (count(*) + 7) // 8 FROM usable) AS steps FROM usable),
placed AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(id || ':' || epoch || ':3407')) - 1 AS pos FROM seen)
SELECT epoch, epoch * steps + pos // 8 AS step, pos AS micro_batch, id FROM placed""",
        "memories", "usable",
    ),
    "run_schedules": with_views(
        """
, sized AS (SELECT r.*, n, batch_size * accumulation AS per_step, (n + batch_size * accumulation - 1) // (batch_size * accumulation) AS steps
  FROM persona_runs r JOIN (SELECT persona_id, count(*) AS n FROM usable GROUP BY persona_id) USING (persona_id)),
planned AS (SELECT *, CASE WHEN max_steps > 0 THEN max_steps ELSE steps * num_epochs END AS most,
  CASE WHEN max_steps > 0 THEN (max_steps + steps - 1) // steps ELSE num_epochs END AS epochs FROM sized),
all_steps AS (SELECT *, unnest(range(0, least(most, epochs * steps)::BIGINT)) AS step FROM planned),
filled AS (SELECT *, step // steps AS epoch, least(per_step, n - (step % steps) * per_step) AS k FROM all_steps)
SELECT run_id, epoch::BIGINT AS epoch, step, k::BIGINT AS n_examples, k::BIGINT AS n_ids, ((k + batch_size - 1) // batch_size)::BIGINT AS n_micro_batches,
  ((step % steps) * accumulation)::BIGINT AS first_micro_batch FROM filled""",
        "memories", "usable", "persona_runs",
    ),
    "inference_requests": with_views(
        f"""SELECT question_id, CASE WHEN trim(system_text) = '' THEN 'user' ELSE 'system,user' END AS roles,
        CASE WHEN trim(system_text) <> '' THEN system_text END AS system_text,
        '<bos><start_of_turn>user' || chr(10) || CASE WHEN trim(system_text) = '' THEN '' ELSE trim(system_text, {BLANKS}) || chr(10) || chr(10) END
          || trim(message, {BLANKS}) || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt FROM asked""",
        "personas", "prompts", "questions", "asked",
    ),
    "sampling_params": with_views(
        """SELECT request_id, CASE WHEN temperature <= 0.1 THEN 1.0::DOUBLE ELSE temperature END AS temperature,
        coalesce(nullif(top_p, 0), 0.95::DOUBLE) AS top_p, coalesce(nullif(top_k, 0), 64) AS top_k,
        coalesce(nullif(repetition_penalty, 0), 1.0::DOUBLE) AS repetition_penalty FROM sampling""",
        "sampling",
    ),
    "extract_response": with_views(f"SELECT gen_id, trim(expected, {BLANKS}) AS response FROM generations", "generations"),
    "extract_response_header": with_views(
        f"SELECT gen_id, CASE WHEN contains(raw_header, '<|') THEN trim(expected, {BLANKS}) ELSE raw_header END AS response FROM generations",
        "generations",
    ),
    "validate_personas": with_views(
        r"""SELECT persona_id, concat_ws(',',
          CASE WHEN trim(coalesce(name, '')) = '' THEN 'name_missing' END,
          CASE WHEN age <> '' AND NOT regexp_full_match(trim(age), '[+-]?[0-9]+(_[0-9]+)*') THEN 'age_not_integer' END,
          CASE WHEN age <> '' AND regexp_full_match(trim(age), '[+-]?[0-9]+(_[0-9]+)*')
            AND NOT coalesce(try_cast(replace(replace(trim(age), '_', ''), '+', '') AS DOUBLE) BETWEEN 0 AND 150, false) THEN 'age_out_of_range' END,
          CASE WHEN name <> '' AND length(name) < 2 THEN 'name_too_short' END,
          CASE WHEN length(name) > 100 THEN 'name_too_long' END) AS errors FROM persona_forms""",
        "persona_forms",
    ),
    "validate_model_names": with_views(
        r"""SELECT model_no, CASE WHEN coalesce(model_name, '') = '' THEN 'empty'
          WHEN NOT contains(model_name, '/') THEN 'no_separator'
          WHEN len(string_split(model_name, '/')) <> 2 THEN 'too_many_separators'
          WHEN starts_with(model_name, '/') OR ends_with(model_name, '/') THEN 'empty_half'
          WHEN NOT regexp_full_match(model_name, '[a-zA-Z0-9][-a-zA-Z0-9_.]*/[a-zA-Z0-9][-a-zA-Z0-9_.]*') THEN 'illegal_characters' END AS error
        FROM model_names""",
        "model_names",
    ),
    "sanitize_name": r"""SELECT doc_id, substr(regexp_replace(replace(regexp_replace(text, '[<>:"/\\|?*]', '', 'g'), ' ', '_'), '_{2,}', '_', 'g'), 1, 200)
        AS file_name FROM documents""",
    "resolve_runs": with_views("SELECT * FROM plans", "run_requests", "plans"),
    "clamp_settings": with_views(
        """SELECT s.run_id, s.section, s.key, CASE WHEN r.kind IS NULL THEN s.value
          WHEN r.kind = 'bool' THEN CASE WHEN coalesce(s.value, '') = '' OR lower(s.value) = 'false' OR coalesce(try_cast(trim(s.value) AS DOUBLE), 1) = 0
            THEN 'false' ELSE 'true' END
          WHEN r.kind IN ('text', 'stripped') THEN CASE WHEN coalesce(s.value, '') = '' THEN r.default_value
            WHEN r.kind = 'stripped' THEN trim(s.value) ELSE s.value END
          WHEN coalesce(try_cast(trim(s.value) AS DOUBLE), 0) = 0 THEN r.default_value
          WHEN r.kind = 'float' THEN trim(s.value)
          ELSE CAST(greatest(trunc(try_cast(trim(s.value) AS DOUBLE))::BIGINT, r.minimum::BIGINT) AS VARCHAR) END AS value
        FROM settings s LEFT JOIN rules r ON r.section = s.section AND r.key = s.key""",
        "settings", "rules",
    ),
    "resolve_selection": with_views(
        """
, choices AS (SELECT DISTINCT persona_id, label FROM labelled WHERE id IN (SELECT 'm' || doc_id FROM labels)
  UNION ALL SELECT item_id, 'No such ' || item_id FROM benchmark)
SELECT c.persona_id, c.label, l.id FROM choices c LEFT JOIN label_ids l ON l.persona_id = c.persona_id AND l.label = c.label""",
        "memories", "titled", "labelled", "label_ids",
    ),
    "fetch_by_ids": with_views(
        """SELECT r.pos, r.id, o.content FROM (SELECT id, pos FROM selection UNION ALL SELECT id, pos + 1000000 FROM selection) r
        LEFT JOIN store_old o ON o.id = r.id""",
        "selection", "store_old",
    ),
    "model_lookup": with_views(
        """SELECT p.run_id, p.model_id, coalesce(r.name, string_split(p.model_id, '/')[-1]) AS model_name,
        coalesce(r.description, 'Custom model') AS description, coalesce(r.vram, 'Unknown') AS vram, coalesce(r.params, 'Unknown') AS params
        FROM plans p LEFT JOIN registry r ON r.id = p.model_id""",
        "run_requests", "plans", "registry",
    ),
    "effective_settings": with_views(
        f"""
, layers AS (SELECT run_id, d.section, d.key, d.value, 0 AS rank FROM user_settings CROSS JOIN defaults d
  UNION ALL SELECT run_id, section, key, value, 1 FROM user_settings
  UNION ALL SELECT run_id, split_part(name, '.', 1), substr(name, instr(name, '.') + 1), value, 2 FROM updates WHERE contains(name, '.'))
, settled AS (SELECT run_id, section, key, value FROM layers
  QUALIFY row_number() OVER (PARTITION BY run_id, section, key ORDER BY rank DESC) = 1)
, own AS (SELECT s.* FROM settled s JOIN plans p USING (run_id) WHERE NOT (p.full_tuning AND s.section = 'lora'))
, stacked AS (SELECT *, 0 AS rank FROM own
  UNION ALL SELECT run_id, 'training', key, value, 1 FROM own WHERE section = 'unsloth'
  UNION ALL SELECT a.run_id, 'lora', t.key, CASE WHEN u.run_id IS NULL THEN t.value ELSE u.value END, 2
    FROM (SELECT DISTINCT run_id FROM own WHERE section = 'lora') a
    JOIN (SELECT DISTINCT run_id FROM own WHERE section = 'unsloth') b USING (run_id)
    CROSS JOIN (VALUES {', '.join(f"({text(k)}, {text(v)})" for k, v in V.ADAPTER_TAKES)}) t(key, value)
    LEFT JOIN own u ON u.run_id = a.run_id AND u.section = 'unsloth' AND u.key = t.key)
SELECT run_id, section, key, value FROM stacked
QUALIFY row_number() OVER (PARTITION BY run_id, section, key ORDER BY rank DESC) = 1""",
        "user_settings", "updates", "run_requests", "defaults", "plans",
    ),
    "layered_settings": with_views(
        """
, layers AS (SELECT run_id, d.section, d.key, d.value, 0 AS rank FROM user_settings CROSS JOIN defaults d
  UNION ALL SELECT run_id, section, key, value, 1 FROM user_settings
  UNION ALL SELECT run_id, split_part(name, '.', 1), substr(name, instr(name, '.') + 1), value, 2 FROM updates WHERE contains(name, '.'))
SELECT run_id, section, key, value FROM layers
QUALIFY row_number() OVER (PARTITION BY run_id, section, key ORDER BY rank DESC) = 1""",
        "user_settings", "updates", "defaults",
    ),
    "source_fallback": with_views(
        """
, stored AS (SELECT * FROM memories WHERE id IN (SELECT id FROM selection) AND persona_id % 3 > 0)
SELECT id, persona_id, ingest_pos, 'store' AS origin FROM stored
UNION ALL
SELECT id, persona_id, ingest_pos, 'fresh' AS origin FROM memories
WHERE persona_id NOT IN (SELECT persona_id FROM stored) AND id IN (SELECT id FROM selection)""",
        "memories", "selection",
    ),
    "store_membership": with_views(
        "SELECT DISTINCT id, id IN (SELECT id FROM store_old) AS is_cached FROM selection", "selection", "store_old"
    ),
    "store_stats": with_views(
        """SELECT persona_id, count(*) AS total_memories, sum(coalesce(strlen(content), 0))::BIGINT AS size_bytes,
        round(sum(coalesce(strlen(content), 0))::BIGINT / 1048576, 2) AS size_mb, count(*) > 0 AS has_cache, max(ingest_pos) AS last_updated
        FROM memories GROUP BY persona_id""",
        "memories",
    ),
    "workspace_summary": with_views(
        """SELECT workspace_id, count(*) FILTER (object = 'page') AS pages, count(*) FILTER (object = 'database') AS databases,
        count(*) AS total_items FROM entries GROUP BY workspace_id""",
        "entries",
    ),
    "build_stats": with_views(
        """SELECT m.persona_id, count(*) AS total, count(*) FILTER (m.id IN (SELECT id FROM selection)) AS selected,
        count(*) FILTER (m.id IN (SELECT id FROM selection) AND m.id IN (SELECT id FROM usable)) AS examples
        FROM memories m GROUP BY m.persona_id""",
        "memories", "usable", "selection",
    ),
    "run_summary": with_views(
        """SELECT run_id, current_step, loss, learning_rate, last_seen_loss, max_steps, current_step / steps_per_epoch::DOUBLE AS current_epoch,
        total_epochs FROM (SELECT run_id, max(step) AS current_step, coalesce(arg_max_null(loss, step), 0) AS loss,
          coalesce(arg_max_null(learning_rate, step), 0) AS learning_rate,
          arg_max(loss, step) FILTER (loss IS NOT NULL) AS last_seen_loss FROM run_log GROUP BY run_id)
        LEFT JOIN (SELECT run_id, steps_per_epoch, CASE WHEN max_steps > 0 THEN max_steps ELSE steps_per_epoch * num_epochs END::BIGINT AS max_steps,
          CASE WHEN max_steps > 0 THEN ceil(max_steps / steps_per_epoch) ELSE num_epochs END::BIGINT AS total_epochs
          FROM (SELECT *, ceil(n_examples / (batch_size * accumulation))::BIGINT AS steps_per_epoch FROM run_plans)) USING (run_id)""",
        "run_log", "run_plans",
    ),
    "display_order": with_views(
        f"""SELECT persona_id, id, row_number() OVER (PARTITION BY persona_id ORDER BY {DAY} DESC NULLS LAST, ingest_pos) AS display_rank
        FROM memories""",
        "memories",
    ),
    "label_lookup": with_views("SELECT * FROM label_ids", "memories", "titled", "labelled", "label_ids"),
    "log_tail": with_views(
        f"""SELECT file, line_no, line, count(*) OVER (PARTITION BY file) > {TAIL_LINES} AS truncated FROM log_lines
        QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) <= {TAIL_LINES}""",
        "log_lines",
    ),
    "newest_log": with_views(
        "SELECT file, strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS modified FROM log_lines GROUP BY file ORDER BY max(modified) DESC, file LIMIT 3",
        "log_lines",
    ),
    "union_pages": with_views(
        """SELECT * FROM store_old UNION ALL SELECT * FROM store_new
        UNION ALL SELECT id, content, NULL AS ingest_pos FROM store_old""",
        "store_old", "store_new",
    ),
    "stored_ids": with_views(
        "SELECT id FROM store_old UNION SELECT id FROM store_new", "store_old", "store_new"
    ),
    "refresh_stream": with_views("SELECT * FROM newest", *LISTED, "newest"),
    "ingest_memories": with_views("SELECT * FROM newest", *LISTED, "newest"),
    "browse_list": with_views(
        """SELECT persona_id, id, label,
        row_number() OVER (PARTITION BY persona_id ORDER BY day DESC NULLS LAST, ingest_pos) AS display_rank FROM page_labels""",
        "note_pages", "page_labels",
    ),
    "build_training_set": with_views(
        "SELECT id, persona_id, ingest_pos, text FROM rendered WHERE id IN (SELECT id FROM selection)",
        *BUILT, "rendered", "selection",
    ),
    "ask_and_answer": with_views(
        f"SELECT question_id, trim(message, {BLANKS}) AS response FROM asked", "personas", "prompts", "questions", "asked"
    ),
}
