"""Views that map the given tables onto the shapes the operators take.

The same SQL runs in Spark and in DuckDB. Every view covers the whole of its tables. A third of the
memories belong to one persona, as a stand-in for a very large one.
"""

MEMORIES = """
SELECT concat('m', CAST(d.doc_id AS STRING)) AS id,
  CASE WHEN d.doc_id % 3 = 0 THEN 0 ELSE d.doc_id % 150 END AS persona_id,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('Note ', d.source) END AS title,
  CASE WHEN d.doc_id % 17 = 0 THEN '  ' WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END AS content,
  CASE WHEN d.doc_id % 5 = 0 THEN d.text END AS alt_content,
  CASE WHEN d.doc_id % 11 = 0 THEN 'not a date' WHEN d.doc_id % 13 = 0 THEN NULL
       ELSE concat(CAST(CAST(e.ts AS DATE) AS STRING), 'T00:00:00.000Z') END AS created_time,
  d.doc_id AS ingest_pos
FROM documents d JOIN events e ON e.event_id = d.doc_id
"""

PERSONAS = """
SELECT c.c_custkey AS persona_id, c.c_name AS name, CAST(18 + c.c_custkey % 60 AS STRING) AS age,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
  r.r_name AS country, n.n_name AS location, lower(c.c_mktsegment) AS hobbies,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE n.n_name END AS favorites,
  CASE WHEN c.c_custkey % 6 = 0 THEN 'Likes {age} literally' ELSE concat('Segment ', c.c_mktsegment) END AS bio
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
"""

SELECTION = """
SELECT concat('m', CAST(doc_id AS STRING)) AS id, doc_id AS pos FROM labels WHERE quality = 1
UNION ALL
SELECT concat('missing', CAST(item_id AS STRING)) AS id, -1 - item_id AS pos FROM benchmark
"""

STORE_OLD = """
SELECT concat('m', CAST(doc_id AS STRING)) AS id, text AS content, doc_id AS ingest_pos FROM documents
"""

# Every labelled document again with a changed text, the good ones twice, new rows and rows without an id.
STORE_NEW = """
SELECT concat('m', CAST(d.doc_id AS STRING)) AS id, concat('v2 ', d.text) AS content,
  1000000000 + 2 * d.doc_id AS ingest_pos
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
UNION ALL
SELECT concat('m', CAST(d.doc_id AS STRING)) AS id, concat('v3 ', d.text) AS content,
  1000000001 + 2 * d.doc_id AS ingest_pos
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1
UNION ALL
SELECT CASE WHEN item_id % 4 = 0 THEN '' ELSE concat('b', CAST(item_id AS STRING)) END AS id, text AS content,
  2000000000 + item_id AS ingest_pos
FROM benchmark
"""

# Conversations as paged listings: a turn is a response, asked with a cursor of its own. Some lack a turn, hold one twice, lead
# back to an earlier one, go round in a circle or announce more than there is.
CURSOR_TURNS = """
SELECT conv_id AS dump_id, CASE WHEN turn > 0 THEN concat('c', CAST(turn AS STRING)) END AS start_cursor,
  CASE WHEN turn = last_turn AND conv_id % 11 = 5 THEN 'c1' WHEN turn = last_turn AND conv_id % 23 = 6 THEN 'c2'
       WHEN turn = last_turn AND conv_id % 19 = 3 THEN NULL ELSE concat('c', CAST(turn + 1 AS STRING)) END AS next_cursor,
  CASE WHEN turn = last_turn THEN conv_id % 11 = 5 OR conv_id % 19 = 3 OR (conv_id % 23 = 6 AND turn > 1)
       ELSE NOT (conv_id % 23 = 6 AND turn = 1) END AS has_more, turn, text
FROM (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) c
WHERE conv_id % 13 <> 4 OR turn <> 1
UNION ALL
SELECT conv_id AS dump_id, concat('c', CAST(turn AS STRING)) AS start_cursor, NULL AS next_cursor, false AS has_more, turn, text
FROM conversations WHERE conv_id % 17 = 2 AND turn = 1
"""

ENTRIES = """
SELECT concat('m', CAST(doc_id AS STRING)) AS id, 'page' AS object, doc_id % 150 AS workspace_id FROM documents
UNION ALL
SELECT concat('c', CAST(c_custkey AS STRING)) AS id, 'database' AS object, c_custkey AS workspace_id FROM customer
"""

QUESTIONS = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS question_id,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 150 END AS persona_id,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN '  ' ELSE text END AS message,
  CASE WHEN conv_id % 7 = 0 THEN 'Be brief.' WHEN conv_id % 7 = 1 THEN ' ' WHEN conv_id % 7 = 2 THEN '' END AS system_prompt
FROM conversations WHERE role = 'user'
"""

# Known answers in five wrappings.
GENERATIONS = """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS gen_id, text AS expected,
  concat('Asked in ', role, ': ') AS prompt,
  CASE (conv_id + turn) % 5
    WHEN 0 THEN concat('<bos><start_of_turn>user q<end_of_turn> <start_of_turn>model ', text, '<end_of_turn>')
    WHEN 1 THEN concat('Q Assistant: no Assistant: ', text)
    WHEN 2 THEN concat('<|user|>q<|end|><|assistant|> ', text, '<|eot_id|>')
    WHEN 3 THEN concat('Asked in ', role, ': ', text, '<|end|>')
    ELSE text END AS raw,
  CASE (conv_id + turn) % 2
    WHEN 0 THEN concat('<|start_header_id|>user<|end_header_id|>q<|eot_id|><|start_header_id|>assistant<|end_header_id|> ',
                       text, ' <|eot_id|>')
    ELSE concat(' ', text) END AS raw_header
FROM conversations
"""

SAMPLING = """
SELECT event_id AS request_id, value / 100 AS temperature,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE value / 600 END AS top_p,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id % 100 END AS top_k,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE 1 + value / 1000 END AS repetition_penalty
FROM events
"""

PERSONA_FORMS = """
SELECT c_custkey AS persona_id,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN 'X'
    WHEN 4 THEN repeat(c_name, 6) ELSE c_name END AS name,
  CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'ten' WHEN 3 THEN '-1' WHEN 4 THEN '151'
    WHEN 5 THEN ' 25 ' WHEN 6 THEN '1_00' WHEN 7 THEN '3.5' WHEN 8 THEN '99999999999999999999999999999999999999999999'
    ELSE '+7' END AS age
FROM customer
"""

MODEL_NAMES = """
SELECT p_partkey AS model_no,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_name WHEN 3 THEN concat('a/', p_name, '/c')
    WHEN 4 THEN '/x' WHEN 5 THEN 'me/' WHEN 6 THEN 'me/-x' WHEN 7 THEN 'm e/x' ELSE concat('me/x-1_', CAST(p_partkey AS STRING)) END AS model_name
FROM part
"""

RUN_LOG = """
SELECT user_id AS run_id, event_id AS step, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS loss,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(0.0002 AS DOUBLE) * (event_id % 60) END AS learning_rate
FROM events
"""

# Plans of most runs, every other one with a number of steps.
RUN_PLANS = """
SELECT user_id AS run_id, 3 * count(*) AS n_examples, 2 AS batch_size, 1 + user_id % 8 AS accumulation,
  CASE WHEN user_id % 2 = 0 THEN 60 WHEN user_id % 3 = 0 THEN -1 END AS max_steps, 1 + user_id % 3 AS num_epochs
FROM events WHERE user_id % 10 <> 9 GROUP BY user_id
"""

# Runs over the memories of a persona: two for some, with numbers of their own, and some without memories.
PERSONA_RUNS = """
SELECT c_custkey AS run_id, c_custkey % 170 AS persona_id, 1 + c_custkey % 3 AS batch_size, 1 + c_custkey % 4 AS accumulation,
  CASE WHEN c_custkey % 2 = 0 THEN 1 + c_custkey % 50 WHEN c_custkey % 5 = 0 THEN -1 END AS max_steps,
  1 + c_custkey % 3 AS num_epochs, 3407 + c_custkey % 2 AS seed
FROM customer
"""

LOG_LINES = """
SELECT concat(event_type, '.log') AS file, event_id AS line_no, ts AS modified, props AS line FROM events
"""

RUN_REQUESTS = """
SELECT c_custkey AS run_id,
  CASE WHEN c_custkey % 12 = 10 THEN 'acme/unknown-1b' ELSE concat('org/model-', CAST(c_custkey % 30 AS STRING)) END AS selected_model,
  CASE WHEN c_custkey % 9 = 0 THEN '  me/custom  ' ELSE '  ' END AS custom_model,
  CASE WHEN c_custkey % 2 = 0 THEN 'LoRA Fine-tune' ELSE 'Full Fine-tune (slow)' END AS mode,
  concat('run_', CAST(c_custkey AS STRING)) AS output_name, 'a, b,, c ' AS tags,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 70 + 0.75 END AS age
FROM customer
"""

REGISTRY = """
SELECT concat('org/model-', CAST(n_nationkey AS STRING)) AS id, n_name AS name, 'From the list' AS description,
  concat('~', CAST(n_regionkey + 4 AS STRING), 'GB') AS vram, concat(CAST(n_nationkey AS STRING), 'B') AS params
FROM nation
"""

SETTINGS = """
SELECT event_id AS run_id,
  CASE event_id % 7 WHEN 0 THEN 'system' WHEN 1 THEN 'model' WHEN 2 THEN 'model' WHEN 3 THEN 'own' WHEN 4 THEN 'unsloth' ELSE 'training' END AS section,
  CASE event_id % 7 WHEN 0 THEN 'gpu_ids' WHEN 1 THEN 'max_seq_length' WHEN 2 THEN 'temperature' WHEN 3 THEN 'key'
    WHEN 4 THEN 'packing' WHEN 5 THEN 'batch_size' ELSE 'optimizer' END AS key,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN ' 7.9 ' WHEN 4 THEN event_type
    ELSE CAST(value AS STRING) END AS value
FROM events
"""

USER_SETTINGS = """
SELECT c_custkey AS run_id, 'training' AS section,
  CASE c_custkey % 3 WHEN 0 THEN 'batch_size' WHEN 1 THEN 'max_steps' ELSE 'own_key' END AS key,
  CAST(c_custkey % 40 AS STRING) AS value
FROM customer
"""

UPDATES = """
SELECT c_custkey AS run_id,
  CASE c_custkey % 4 WHEN 0 THEN 'training.batch_size' WHEN 1 THEN 'model.top_k' WHEN 2 THEN 'undotted' ELSE 'own.a.b' END AS name,
  c_mktsegment AS value
FROM customer
"""

VIEWS = {
    "memories": MEMORIES,
    "personas": PERSONAS,
    "selection": SELECTION,
    "store_old": STORE_OLD,
    "store_new": STORE_NEW,
    "cursor_turns": CURSOR_TURNS,
    "entries": ENTRIES,
    "questions": QUESTIONS,
    "generations": GENERATIONS,
    "sampling": SAMPLING,
    "persona_forms": PERSONA_FORMS,
    "model_names": MODEL_NAMES,
    "run_log": RUN_LOG,
    "persona_runs": PERSONA_RUNS,
    "run_plans": RUN_PLANS,
    "log_lines": LOG_LINES,
    "run_requests": RUN_REQUESTS,
    "registry": REGISTRY,
    "settings": SETTINGS,
    "user_settings": USER_SETTINGS,
    "updates": UPDATES,
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
