"""The given tables as DataFrames, the views on them, and note pages made from the documents."""

import re

from pyspark.sql import DataFrame, SparkSession

from persona_checks.views import TABLES, VIEWS

# A page per document: a block per line, blocks of other kinds around them, three kinds of titles.
PAGE_STRUCT = """
named_struct(
  'id', id, 'object', 'page', 'created_time', created_time,
  'properties', named_struct(
    'Tags', named_struct('type', 'multi_select', 'title', CAST(NULL AS ARRAY<STRUCT<plain_text STRING>>)),
    'title', CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN named_struct('type', 'title', 'title',
       array(named_struct('plain_text', concat(' ', source)), named_struct('plain_text', concat(' by ', lang, ' ')))) END,
    'Name', CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN named_struct('type', 'title', 'title',
       array(named_struct('plain_text', concat('Note ', source)))) END),
  '_blocks', concat(
    array(named_struct('type', 'divider', 'divider', named_struct('color', 'gray'),
      'paragraph', CAST(NULL AS STRUCT<rich_text ARRAY<STRUCT<plain_text STRING>>>),
      'heading_1', CAST(NULL AS STRUCT<rich_text ARRAY<STRUCT<plain_text STRING>>>))),
    transform(split(text, '\\n'), (line, i) -> named_struct(
      'type', CASE WHEN i % 3 = 1 THEN 'heading_1' ELSE 'paragraph' END,
      'divider', CAST(NULL AS STRUCT<color STRING>),
      'paragraph', CASE WHEN i % 3 <> 1 THEN named_struct('rich_text', array(named_struct('plain_text', line))) END,
      'heading_1', CASE WHEN i % 3 = 1 THEN named_struct('rich_text', array(
         named_struct('plain_text', left(line, 7)), named_struct('plain_text', substr(line, 8)))) END))))
"""

PAGE_SOURCE = """
SELECT d.doc_id, concat('m', CAST(d.doc_id AS STRING)) AS id, d.source, d.lang, d.text, d.doc_id % 150 AS persona_id,
  CASE WHEN d.doc_id % 11 = 0 THEN 'not a date' WHEN d.doc_id % 13 = 0 THEN NULL
       ELSE concat(CAST(CAST(e.ts AS DATE) AS STRING), 'T23:30:00-05:00') END AS created_time
FROM documents d JOIN events e ON e.event_id = d.doc_id
"""

# Dumps of 50 documents in responses of 10. A dump whose number is that of an error event broke off
# before its last response. The documents are fetched a second time, the labelled ones changed.
# What a response says besides its pages is settled on numbers alone; the texts then meet it once, by tens of documents,
# and serve both fetches from there.
RESPONSES = f"""
WITH timed AS (
  SELECT i.doc_id, collect_list(struct(e.ts)) AS times
  FROM (SELECT DISTINCT doc_id FROM documents) i JOIN events e ON e.event_id = i.doc_id GROUP BY i.doc_id
), marked AS (
  SELECT doc_id, count(*) AS n_labels FROM labels GROUP BY doc_id
), tens AS (
  SELECT t.doc_id div 10 AS ten, map_from_entries(collect_list(struct(t.doc_id, struct(t.times, l.n_labels)))) AS known
  FROM timed t LEFT JOIN marked l ON l.doc_id = t.doc_id GROUP BY t.doc_id div 10
), listed AS (
  SELECT ten, 1 AS fetch, ten div 5 AS dump_id, ten % 5 AS response_no, ten div 5 AS event_no FROM tens
  UNION ALL
  SELECT ten, 2 AS fetch, 1000000 + ten div 5 AS dump_id, ten % 5 AS response_no, 100 + ten div 5 AS event_no FROM tens
), last AS (
  SELECT dump_id, max(response_no) AS last_no FROM listed GROUP BY dump_id
), heads AS (
  SELECT ten, collect_list(struct(fetch, dump_id, response_no, response_no < last_no OR coalesce(e.event_type = 'error', false) AS has_more,
    CASE WHEN response_no < last_no THEN concat('after-', CAST(response_no AS STRING)) END AS next_cursor)) AS heads
  FROM listed JOIN last USING (dump_id) LEFT JOIN events e ON e.event_id = listed.event_no GROUP BY ten
), guide AS (
  SELECT ten, known, heads FROM tens JOIN heads USING (ten)
), known_pages AS (
  SELECT /*+ MERGE(g) */ g.ten, g.heads, d.doc_id, d.source, d.lang, d.text, g.known[d.doc_id] AS k
  FROM documents d JOIN guide g ON g.ten = d.doc_id div 10
), fetched AS (
  SELECT ten, heads, fetch, doc_id, concat('m', CAST(doc_id AS STRING)) AS id, source, lang,
    CASE WHEN fetch = 2 AND k.n_labels > 0 THEN concat('v2 ', text) ELSE text END AS text,
    CASE WHEN doc_id % 11 = 0 THEN 'not a date' WHEN doc_id % 13 = 0 THEN NULL
         ELSE concat(CAST(CAST(e.ts AS DATE) AS STRING), 'T23:30:00-05:00') END AS created_time
  FROM known_pages LATERAL VIEW inline(k.times) e AS ts
  LATERAL VIEW explode(concat(array(1), array_repeat(2, CAST(coalesce(k.n_labels, 1) AS INT)))) f AS fetch
), responses AS (
  SELECT ten, fetch, any_value(heads) AS heads, transform(array_sort(collect_list(struct(doc_id, {PAGE_STRUCT} AS page))), p -> p.page) AS results
  FROM fetched GROUP BY ten, fetch
)
SELECT h.dump_id, h.dump_id % 150 AS persona_id, h.response_no, r.results, h.has_more, h.next_cursor
FROM responses r LATERAL VIEW inline(filter(r.heads, h -> h.fetch = r.fetch)) h AS fetch, dump_id, response_no, has_more, next_cursor
"""


class Tables:
    """The given tables of one scale as Spark views, and the derived views by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._seen: set[str] = set()

    def _register(self, names: set[str]) -> None:
        for name in names - self._seen:
            self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        self._seen |= names

    def __getitem__(self, name: str) -> DataFrame:
        return self.sql(VIEWS.get(name, f"SELECT * FROM {name}"))

    def sql(self, text: str) -> DataFrame:
        self._register(set(re.findall(r"(?:FROM|JOIN) (\w+)", text)) & set(TABLES))
        return self.spark.sql(text)

    def pages_json(self) -> DataFrame:
        """(doc_id, persona_id, value): every document as the JSON of a note page."""
        return self.sql(f"SELECT doc_id, persona_id, to_json({PAGE_STRUCT}) AS value FROM ({PAGE_SOURCE})")

    def responses(self) -> DataFrame:
        return self.sql(RESPONSES)
