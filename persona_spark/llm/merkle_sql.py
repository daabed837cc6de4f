"""DuckDB SQL for the manifest and for spelling variants, which share a checksum worked out in SQL."""

from persona_spark.llm.common import UPPER
from persona_spark.llm.spelling import LEAST_COUNT, LEAST_LENGTH, MISSPELL, RATIO, RUN

#: The reflected polynomial of the checksum that zip files use.
_POLYNOMIAL = 0xEDB88320
_TABLE = (
    "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], list_transform(range(8), lambda k: 0::BIGINT)), "
    f"lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END)) AS crc_table"
)


def _crc32(text: str) -> str:
    """Checksum of a text of characters below U+0800, given a column crc_table."""
    utf8 = (
        f"flatten(list_transform(string_split({text}, ''), "
        "lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [192 + (ord(ch) >> 6), 128 + (ord(ch) & 63)]::BIGINT[] END))"
    )
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {utf8}), "
        "lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])), 4294967295)"
    )


def spelling_sql(table: str) -> str:
    return f"""
WITH RECURSIVE tab AS ({_TABLE}),
runs AS (SELECT d, w, count(*) AS k FROM (
  SELECT doc_id::VARCHAR AS d, translate(unnest(regexp_extract_all(text, '{RUN}{{{LEAST_LENGTH},}}')), '{UPPER}', '{UPPER.lower()}') AS w FROM {table}
) GROUP BY d, w),
hashed AS (SELECT w, k, {_crc32("coalesce(d, '') || ':' || w")} AS h FROM runs, tab),
cut AS (SELECT CASE WHEN h % {MISSPELL} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
gaps AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word FROM gaps g JOIN v ON v.word = g.rest
  UNION SELECT v.word, g.word FROM gaps g JOIN v ON v.word = g.rest),
best AS (SELECT near.word, near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
  row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS place FROM near JOIN v ON v.word = near.near),
chosen AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * v.n THEN near END AS form,
  CASE WHEN near_n >= {RATIO} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
chain AS (SELECT word, word AS root, 0 AS steps FROM v
  UNION ALL SELECT chain.word, chosen.form, steps + 1 FROM chain JOIN chosen ON chosen.word = chain.root WHERE chosen.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)
"""


def merkle_sql(table: str, levels: int = 18, crown: int = 8) -> str:
    """Levels are written out one by one: `levels` inside a source, `crown` above the subroots."""

    def framed(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(framed, ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text])) + ")"

    run = "PARTITION BY tree, idx // 3 ORDER BY idx"
    parts = [
        f"tab AS ({_TABLE})",
        f"docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, "
        f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS found FROM {table}, tab)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs)",
        "n0 AS (SELECT tree, idx, leaf AS h FROM placed)",
        "f0 AS (SELECT row_id, tree, idx, found AS h, '' AS proof FROM placed)",
    ]

    def climb(k: int) -> None:
        parts.append(
            f"s{k} AS (SELECT * FROM (SELECT *, coalesce(lag(h, 2) OVER r, '') || coalesce(lag(h) OVER r, '') AS before, "
            "coalesce(lead(h) OVER r, '') || coalesce(lead(h, 2) OVER r, '') AS after, count(*) OVER (PARTITION BY tree) AS size "
            f"FROM n{k} WINDOW r AS ({run})) WHERE size > 1)"
        )
        parts.append(
            f"n{k + 1} AS (SELECT tree, idx // 3 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM s{k} GROUP BY tree, idx // 3 "
            f"UNION ALL SELECT * FROM n{k} WHERE tree NOT IN (SELECT tree FROM s{k}))"
        )
        parts.append(
            f"f{k + 1} AS (SELECT row_id, f.tree, f.idx // 3 AS idx, CASE WHEN s.h IS NULL THEN f.h ELSE sha256(before || f.h || after) END AS h, "
            f"proof || coalesce(before || after, '') AS proof FROM f{k} f LEFT JOIN s{k} s ON s.tree = f.tree AND s.idx = f.idx)"
        )

    for k in range(levels):
        climb(k)
    top = levels + 1
    parts += [
        f"subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM n{levels})",
        f"n{top} AS (SELECT '' AS tree, place AS idx, subroot AS h FROM subroots)",
        f"f{top} AS (SELECT row_id, '' AS tree, place AS idx, h, proof FROM f{levels} JOIN subroots USING (tree))",
    ]
    for k in range(top, top + crown):
        climb(k)
    last = top + crown
    return (
        "WITH "
        + ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
        + f"\nSELECT doc_id, leaf, subroot, n.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = n.h AS verified "
        f"FROM f{last} f JOIN docs USING (row_id) JOIN subroots ON subroots.tree = docs.tree, n{last} n"
    )
