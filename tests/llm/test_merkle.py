"""Merkle manifests against trees built by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from persona_spark import prefix
from persona_spark.llm import merkle as M

DOCS = "doc_id long, source string, lang string, n_chars int, text string, tree string, id int, leaf string, path int, block string, top int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, text=...):
    return H(*map(framed, [*d[:4], d[4] if text is ... else text]))


def climb(nodes):
    """(root, siblings of each node as (before, after), lowest first)."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for o in owners[k + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H(*run))
            above_owners.append(sum(owners[k : k + 3], []))
        nodes, owners = above, above_owners
    return nodes[0], paths


def plain(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        rows = sorted(groups[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        built.append((rows, *climb([leaf(d) for d in rows])))
    root, tops = climb([b[1] for b in built])
    out = []
    for (rows, sub, paths), top in zip(built, tops):
        for d, path in zip(rows, paths):
            path = path + top
            h = leaf(d, d[4] and d[4].replace("\n", "") if d[0] is not None and d[0] % 2 == 0 else ...)
            for before, after in path:
                h = H(before, h, after)
            out.append((d[0], leaf(d), sub, root, H(*[b + a for b, a in path]), h, h == root))
    return sorted(out, key=str)


def manifest(rows, docs):
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    frame = rows(DOCS, *[(*d, "t", 1, "l", 2, "b", 3) for d in docs])
    return sorted((tuple(r) for r in M.merkle_manifest(frame, tampered).collect()), key=str)


def doc(i, source="a", text="one\ntwo"):
    return (i, source, "en", 3, text)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 243, 244, 730])
def test_sizes_of_one_tree(rows, n):
    docs = [doc(7 * i - 50) for i in range(n)]
    assert manifest(rows, docs) == plain(docs)


def test_many_trees_nulls_and_far_ids(rows):
    sources = [None, "", "a", "ä", "z", "日", "=", *[f"s{k}" for k in range(260)]]
    docs = [doc(i * 2**40 - 2**45, sources[i * i % len(sources)], None if i % 5 == 0 else f"t{i}\n") for i in range(700)]
    docs += [(None, None, None, None, None), doc(2**63 - 1, "a", ""), doc(-(2**63), "a", "")]
    assert manifest(rows, docs) == plain(docs)


def test_repeated_ids_and_rows(rows):
    docs = [doc(i // 3, "a", f"t{i % 2}\n") for i in range(300)] + [doc(5)] * 40 + [(None, "a", "en", 1, f"n{i}") for i in range(30)]
    assert manifest(rows, docs) == plain(docs)


def test_small_buckets_of_the_directory(rows, monkeypatch):
    monkeypatch.setattr(prefix.prefix_sums, "__defaults__", ("before", 4, None))
    docs = [doc(i * 64, "ab"[i % 2]) for i in range(120)] + [doc(64)] * 9
    assert manifest(rows, docs) == plain(docs)


def test_very_long_text(rows):
    docs = [doc(0, "a", "long line\n" * 300_000), doc(2, "b", "x")]
    found = manifest(rows, docs)
    assert found == plain(docs) and {r[0]: r[6] for r in found} == {0: False, 2: True}


def test_empty_table(rows):
    assert manifest(rows, []) == []


def test_without_tampering_all_is_verified(rows):
    docs = rows(DOCS, *[(*doc(i), "t", 1, "l", 2, "b", 3) for i in range(20)])
    assert all(r.verified for r in M.merkle_manifest(docs).collect())
