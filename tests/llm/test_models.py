"""Kneser-Ney classifier, nearest neighbours, URL filter, Jaccard join and pipeline against plain versions."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from persona_spark.llm import collision_ann, jaccard_join, kneser_ney, url_filter
from persona_spark.llm.common import read
from persona_spark.llm.components import components
from persona_spark.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class PlainModel:
    """The same model by dictionaries."""

    def __init__(self, texts):
        codes = [tuple(kneser_ney.codes_of(t).tolist()) for t in texts]
        self.counts = {4: Counter(c[i : i + 4] for c in codes for i in range(len(c) - 3))}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.off, self.total, self.weight = {}, defaultdict(Counter), {}
        for n, table in self.counts.items():
            self.off[n] = kneser_ney.discounts(Counter(table.values()))
            lost = Counter()
            for g, c in table.items():
                self.total[n][g[:-1]] += c
                lost[g[:-1]] += self.off[n][min(c, 3) - 1]
            self.weight[n] = {h: lost[h] / t for h, t in self.total[n].items()}

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.counts[1]) + 1)
        below = self.p(g[1:])
        if n > 1 and g[:-1] not in self.weight[n]:
            return below
        c = self.counts[n].get(g, 0)
        seen = (c - self.off[n][min(c, 3) - 1]) / self.total[n][g[:-1]] if c else 0.0
        return seen + self.weight[n][g[:-1]] * below

    def log_perplexity(self, text):
        c = tuple(kneser_ney.codes_of(text).tolist())
        return -sum(math.log(self.p(c[max(0, i - 3) : i + 1])) for i in range(len(c))) / len(c)


class TestKneserNey:
    def docs(self, rows):
        chance = random.Random(3)
        words = ["the", "cat", "sat", "on", "a", "mat", "with", "seven", "Dogs", "2024"]
        texts = [" ".join(chance.choice(words) for _ in range(40)) for _ in range(30)]
        texts += ["q#z" * 30, "ab", "", None, "😀 the cat"]
        return texts, rows("doc_id long, text string, lang string, trusted string, _block int", *[(i, t, "en" if i % 2 else None, "x", 1) for i, t in enumerate(texts)])

    def test_perplexities_equal_those_of_dictionaries(self, rows, monkeypatch):
        monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 2_000)
        monkeypatch.setattr(kneser_ney, "RUN_CHARS", 300)
        texts, docs = self.docs(rows)
        labels = rows("doc_id long, quality int, toxic int", *[(i, 1, 0) for i in range(20)], (20, 1, 1), (21, 0, 0), (5, 1, 0), (None, 1, 0))
        found = {r.doc_id: r for r in kneser_ney.kneser_ney(docs, labels).collect()}
        held = [i for i in range(20) if found[i].text_hash % kneser_ney.HELD_OUT == 0]
        assert 2 <= len(held) <= 10
        model = PlainModel([texts[i] for i in range(20) if i not in held])
        for i, text in enumerate(texts):
            if text:
                assert found[i].perplexity == pytest.approx(math.exp(model.log_perplexity(text)), rel=1e-9)
            else:
                assert found[i].perplexity is None and found[i].kept
        assert not found[30].kept and all(found[i].kept for i in held)
        logs = {i: math.log(found[i].perplexity) for i in held}
        english = sorted(logs[i] for i in held if i % 2)  # the others have no language
        own = english[(len(english) - 1) // 2] + max(english) - english[(len(english) - 1) // 2]
        for i in range(30):
            assert math.log(found[i].threshold) == pytest.approx(own if i % 2 else max(logs.values()))
            assert found[i].kept == (found[i].perplexity <= found[i].threshold)
        assert kneser_ney.keep_likely(docs, labels).columns == docs.columns
        assert kneser_ney.keep_likely(docs, labels).count() == sum(r.kept for r in found.values())

    def test_no_trusted_texts_keep_all_and_empty_tables(self, rows):
        _, docs = self.docs(rows)
        labels = rows("doc_id long, quality int, toxic int", (1, None, 0), (2, 1, 0), (2, 0, 0))
        assert [r.kept for r in kneser_ney.kneser_ney(docs, labels).collect()] == [True] * 35
        assert kneser_ney.kneser_ney(docs.limit(0), labels).collect() == []

    def test_labelled_junk_goes_and_good_texts_stay(self, spark):
        found = QUERIES["op2_kneser_ney"](spark, SF_DIR).join(read(spark, SF_DIR, "labels"), "doc_id").toPandas()
        assert found[found.quality == 1].kept.mean() > 0.95
        assert not found[(found.quality == 0) & (found.perplexity > 20)].kept.any()


class TestNearest:
    def plain(self, vectors, queries, k):
        out = []
        for q, x in queries:
            scores = sorted((-float(np.dot(np.array(y, float), np.array(x, float))), v) for v, y in vectors if v != q)
            out += [(q, n, v) for n, (_, v) in enumerate(scores[:k], 1)]
        return out

    def test_recall_on_the_given_vectors(self, spark):
        table = read(spark, SF_DIR.replace("sf0.001", "sf0.01"), "embeddings")
        rows = [(r.vec_id, r.embedding) for r in table.collect()]
        found = collision_ann.collision_ann(table, table.filter("vec_id % 20 = 0"), verified=0.1).collect()
        want = self.plain(rows, [r for r in rows if r[0] % 20 == 0], 20)
        got = {(r.query_id, r.vec_id) for r in found}
        assert len(found) == len(want)
        assert sum((q, v) in got for q, _, v in want) >= 0.9 * len(want)

    def test_recall_where_few_are_verified(self, spark, rows, monkeypatch):
        monkeypatch.setattr(collision_ann, "VERIFIED_LEAST", 20)
        chance = np.random.default_rng(1)
        x = chance.normal(size=(3000, 24)) + 2 * chance.normal(size=(10, 24))[chance.integers(0, 10, 3000)]
        data = [(i, v.tolist()) for i, v in enumerate(x)]
        table = rows("vec_id long, embedding array<double>", *data)
        found = collision_ann.collision_ann(table, table.filter("vec_id % 100 = 0"), k=10, block_vectors=1000, block_queries=16).collect()
        want = self.plain(data, data[::100], 10)
        got = {(r.query_id, r.vec_id) for r in found}
        assert sum((q, v) in got for q, _, v in want) >= 0.9 * len(want)

    def test_ties_odd_vectors_and_empty_tables(self, rows):
        data = [(3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [0.0, -1.0]), (None, [1.0, 1.0])]
        table = rows("vec_id long, embedding array<double>, rank int, score string", *[(*d, 1, "x") for d in data])
        found = collision_ann.collision_ann(table, table.filter("vec_id IN (1, 4, 9)")).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
            (1, 1, 2, 2.0), (1, 2, 3, 2.0), (1, 3, 9, 0.0), (9, 1, 1, 0.0), (9, 2, 2, 0.0), (9, 3, 3, 0.0)
        ]
        assert collision_ann.collision_ann(table.limit(0), table).collect() == []
        assert collision_ann.collision_ann(table, table.limit(0)).collect() == []


    def test_a_block_of_more_rows_than_two_bytes_count(self):
        import numpy as np

        block = collision_ann.Block(np.zeros((3, 70_000)))
        low, high = np.zeros(3, np.int64), np.full(3, 70_000)
        assert (block.collisions(low, high) == 3).all()
        assert (block.collisions(low, low + 69_999) == 3).sum() == 69_999


class TestUrlFilter:
    def test_rules_and_parts(self, rows):
        urls = ["http://A.Example.NET/en/x?q", "http://example.net/de/", "xnet://net/", "http://www.Example.com/de/#a", "https://a.org/fr/1", "http://net", "http://knet/x", "no scheme", None, "a://b://c/d"]
        pages = rows("page_id long, url string, html string, host string, rule int", *[(i, u, None, "h", 1) for i, u in enumerate(urls)])
        found = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
        assert [(found[i].host, found[i].path, found[i].rule) for i in range(10)] == [
            ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/de/", "net/"), ("net", "/", "net/"),
            ("www.example.com", "/de/", "example.com/de/"), ("a.org", "/fr/1", "org/fr/"), ("net", "", None),
            ("knet", "/x", None), ("", "", None), ("", "", None), ("b:", "//c/d", None)
        ]
        assert [found[i].verdict for i in (0, 1, 3, 4, 6, 7)] == ["allow", "block", "block", "allow", "allow", "allow"]
        assert url_filter.url_filter(pages.limit(0)).collect() == []

    def test_ranks_equal_a_matrix_iteration(self, rows):
        hosts = ["good.org", "spam.net", "a.com", "b.com", "c.com", "d.com"]
        links = {"good.org": ["a.com", "a.com", "b.com"], "a.com": ["b.com"], "c.com": ["spam.net", "SPAM.net"], "d.com": ["c.com", "b.com"], "spam.net": ["d.com"]}
        pages = []
        for i, h in enumerate(hosts):
            html = "".join(f'<a href="http://{t}/x">' for t in links.get(h, [])) + '<a href="/own"><img src=//good.org/i.png>'
            pages.append((i, f"http://{h}/{'fr/' if h == 'good.org' else ''}", html))
            links.setdefault(h, [])
            links[h] = [t.lower() for t in links[h]] + ([] if h == "good.org" else ["good.org"])
        found = {r.host: r for r in url_filter.url_filter(rows("page_id long, url string, html string", *pages)).collect()}
        n = len(hosts)
        m = np.array([[links[a].count(b) for b in hosts] for a in hosts], float)
        trust, distrust = np.eye(n)[0], np.eye(n)[1]
        for _ in range(url_filter.ITERATIONS):
            out, back = m.sum(1), m.sum(0)
            trust = 0.15 * np.eye(n)[0] + 0.85 * (trust / np.where(out, out, 1)) @ m
            distrust = 0.15 * np.eye(n)[1] + 0.85 * (distrust / np.where(back, back, 1)) @ m.T
        for i, h in enumerate(hosts):
            assert (found[h].trust, found[h].distrust) == (pytest.approx(trust[i]), pytest.approx(distrust[i]))
        assert found["c.com"].verdict == "block" and found["b.com"].verdict == "allow"


def plain_components(texts):
    """component of each id by comparing every two documents."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(low)).split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low_group, high = sorted((group[a], group[b]))
                group = {i: low_group if g == high else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i]) for i in texts}


class TestJaccardJoin:
    def texts(self):
        chance = random.Random(11)
        words = [f"w{k}" for k in range(400)]
        texts, n = {}, 0
        for base in range(8):
            whole = [chance.choice(words) for _ in range(chance.choice([3, 6, 12, 15, 60, 120]))]
            for _ in range(chance.choice([2, 9, 25])):
                copy = list(whole)
                for _ in range(chance.choice([0, 0, 1, 1, 2, 3, 5])):
                    copy[chance.randrange(len(copy))] = chance.choice(words)
                if chance.random() < 0.3:
                    copy = copy[: -chance.randrange(1, 4)] or copy
                texts[n] = " ".join(copy).upper() if chance.random() < 0.2 else "\t".join(copy)
                n += 1
        passage = " ".join(chance.choice(words) for _ in range(40))
        for _ in range(30):
            texts[n] = passage + " " + " ".join(chance.choice(words) for _ in range(30))
            n += 1
        return texts | {n: None, n + 1: "", n + 2: " \n", n + 3: "one", n + 4: "ONE", n + 5: "one two"}

    @pytest.mark.parametrize("frequent_from", [1, 5, 1000])
    def test_components_equal_all_pairs(self, rows, monkeypatch, frequent_from):
        monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent_from)
        texts = self.texts()
        docs = rows("doc_id long, text string, n string, sig string, key int", *[(i, t, "x", "y", 1) for i, t in texts.items()])
        found = jaccard_join.jaccard_join(docs).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(texts)
        kept = jaccard_join.keep_one_of_each(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {c for n, c in plain_components(texts).values()}

    def test_families_in_a_group_of_over_32_near_copies(self, rows):
        """Two of each family link by their edit alone; the third, with more text, is in the same lists."""
        chance, texts = random.Random(2), {}
        for family in range(24):
            whole = [f"w{k}" for k in range(100)]
            edit, *filled = chance.sample(range(8, 92, 8), 3)
            whole[edit] = f"edit{family}"
            for member in range(3):
                own = [f"own{family}.{member}.{k}" if k in filled else w for k, w in enumerate(whole)]
                more = [f"more{family}.{k}" for k in range(11)] if member == 2 else []
                texts[len(texts)] = " ".join(own + more)
        found = jaccard_join.jaccard_join(rows("doc_id long, text string", *texts.items())).collect()
        expected = plain_components(texts)
        assert len(texts) - len({c for _, c in expected.values()}) == 24
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected

    def test_small_sets_have_no_more_subsets_than_allowed(self):
        assert jaccard_join.size_boundary(0) >= 1
        for mean in (0, 10, 1e3, 1e9):
            assert jaccard_join.n_subsets(jaccard_join.size_boundary(mean)) <= jaccard_join.MAX_SUBSETS

    def test_repeats_null_ids_and_empty_tables(self, rows):
        text = "a b c d e f g"
        docs = rows("doc_id long, text string", (5, text), (5, text), (None, text), (9, text), (None, None), (7, "z"))
        found = sorted(jaccard_join.jaccard_join(docs).collect(), key=str)
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
        assert jaccard_join.jaccard_join(docs.limit(0)).collect() == []

    def test_components_of_chains_stars_and_loops(self, rows):
        links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5), (300, 300)]
        found = {r.node: r.component for r in components(rows("a long, b long", *links)).collect()}
        assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
        assert components(rows("a long, b long", (1, 1))).collect() == []


def test_pipeline_stages(spark):
    docs = read(spark, SF_DIR, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        sizes.append(docs.count())
        if name == "jaccard_join":
            texts = {r.doc_id: r.text for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert sizes == sorted(sizes[:5], reverse=True) + sizes[5:]
    assert all(n == 0 or c == i for i, (n, c) in plain_components(texts).items())
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(texts)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
