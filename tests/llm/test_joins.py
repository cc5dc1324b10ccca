"""Near-duplicates, benchmark tiles, vectors, components and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cropspark.llm import covertree, decontaminate, jaccard
from cropspark.llm.graph import components

from .conftest import SF, words


def components_of(vertices, links):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def shingles(text, length):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[k : k + length]) for k in range(len(w) - length + 1)} if len(w) >= length else {tuple(w)} if w else set()


def brute_components(rows, length, percent):
    sets = {i: shingles(t, length) for i, t in rows}
    common, where = Counter(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])
    links = [p for p, n in common.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return sets, components_of(sets, links)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(5, 5)] + [(900, k) for k in range(800, 850)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == components_of({v for e in links for v in e}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("length", "percent"), [(3, 90), (5, 80)])
def test_similar_documents(corpus, length, percent):
    sets, expected = brute_components({(r.doc_id, r.text) for r in corpus.collect()}, length, percent)
    got = jaccard.similar_documents(corpus, length, percent).collect()
    assert len(got) == corpus.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id]), r
    assert len({v for k, v in expected.items()}) < len(expected) - 20


def test_families_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 3000)
    rng, rows = random.Random(11), []
    for family in range(12):
        base = words(rng, rng.choice([12, 40, 90, 200]), 2000).split()
        for _ in range(rng.choice([3, 30])):
            text = list(base)
            for k in rng.sample(range(len(text)), rng.choice([0, 1, 1, 2, 3, 5])):
                text[k] = f"n{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for short in (32, 2):
        monkeypatch.setattr(jaccard, "SHORT", short)
        for length, percent in ((3, 90), (5, 80), (1, 70)):
            _, expected = brute_components(rows, length, percent)
            got = {r.doc_id: r.component_id for r in jaccard.similar_documents(df, length, percent).collect()}
            assert got == expected


def test_one_of_each(corpus, spark, no_docs):
    _, expected = brute_components({(r.doc_id, r.text) for r in corpus.collect()}, 5, 80)
    kept = jaccard.one_of_each(corpus, 5, 80)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))
    assert jaccard.one_of_each(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert jaccard.one_of_each(nulls).count() == 3
    assert sorted(jaccard.similar_documents(nulls, 3, 90).collect(), key=str) == sorted([(None, 1, None), (None, 1, None), (1, 0, 1)], key=str)


def plain_tiles(doc, item, least):
    """Textbook greedy tiling: the longest match of unmarked words, first places first, again and again."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for t in range(len(item)):
                k = 0
                while p + k < len(doc) and t + k < len(item) and doc[p + k] == item[t + k] and p + k not in used_d and t + k not in used_i:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        if best[0] < least:
            return out
        k, p, t = best
        out.append((p, t, k))
        used_d.update(range(p, p + k))
        used_i.update(range(t, t + k))


def test_tiles_equal_plain_tiling():
    rng = random.Random(6)
    for _ in range(150):
        doc, item = ([rng.choice("abc") for _ in range(rng.randint(3, 40))] for _ in range(2))
        seeds = [(p, t) for p in range(len(doc) - 2) for t in range(len(item) - 2) if doc[p : p + 3] == item[t : t + 3]]
        if seeds:
            got, expected = decontaminate.tiles(np.array(seeds), 3), plain_tiles(doc, item, 3)
            assert sorted(x[2] for x in got)[-1] == expected[0][2]
            assert got[0] == expected[0]
            assert len({p + k for p, _, n in got for k in range(n)}) == sum(n for *_, n in got) == len({t + k for _, t, n in got for k in range(n)})
            left_d, left_i = (set(range(len(x))) - {s[j] + k for s in got for k in range(s[2])} for x, j in ((doc, 0), (item, 1)))
            assert not any({p, p + 1, p + 2} <= left_d and {t, t + 1, t + 2} <= left_i for p, t in seeds)


def test_contamination(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(20, 60), 3000)) for i in range(30)] + [(50, "too short"), (51, None), (52, "")]
    docs, expected = [], set()
    for i, text in items[:30]:
        w = text.split()
        cut = len(w) // 2
        docs.append((len(docs), f"{words(rng, 50)} {text.upper()} {words(rng, 50)}"))
        docs.append((len(docs), f"{' '.join(w[cut:])}, {words(rng, 20)}; {' '.join(w[:cut])}"))
        expected |= {(len(docs) - 2, i), (len(docs) - 1, i)}
        docs.append((len(docs), f"{words(rng, 30)} {' '.join(w[: len(w) // 3])} {words(rng, 30)}"))
        docs.append((len(docs), words(rng, 100, 3000)))
    docs += [(900, None), (901, ""), (902, "x " * 20_000), (902, docs[0][1])]
    expected.add((902, 0))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.contaminated(df, bench)
    assert {(r.doc_id, r.item_id) for r in whole.collect()} == expected and whole.filter("coverage < 0.9").count() == 0
    kept = decontaminate.without_benchmark(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(expected)
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 100)
    assert sorted(decontaminate.contaminated(df, bench).collect()) == sorted(whole.collect())
    assert decontaminate.without_benchmark(df, bench).count() == kept.count()
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def brute_vectors(rows, threshold):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = {i: 0 for i, _ in rows if i is not None}, []
    for k, (i, v) in enumerate(sound):
        for j, w in sound[:k]:
            if len(v) == len(w) and np.dot(np.float64(v), np.float64(w)) / np.linalg.norm(np.float64(v)) / np.linalg.norm(np.float64(w)) >= threshold:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    return n, components_of(n, links)


@pytest.mark.parametrize("block", [4096, 40])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "FANOUT", 3)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 8))
    vectors = [(centres[rng.integers(9)] + s * rng.normal(size=8)).astype("float32").tolist() for s in rng.choice([0.01, 0.2, 0.5, 2.0], 250)]
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]], None, [], [0.0] * 8, [float("nan")] * 8, [float("inf"), *[0.0] * 7], [None, *[1.0] * 7], [1.0, 0.0], [1.0, 0.01]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n int").repartition(3)
    n, expected = brute_vectors(rows, 0.9)
    got = covertree.linked_vectors(df, 0.9).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], expected[r.vec_id], expected[r.vec_id] == r.vec_id)
    assert covertree.linked_vectors(df.limit(0)).count() == 0


def test_tree_covers_its_points():
    rng = np.random.default_rng(2)
    tree = covertree.Tree(covertree.unit(rng.normal(size=(20, 3))[rng.integers(20, size=300)] + 0.05 * rng.normal(size=(300, 3))))
    for k, (starts, centres, radius, parents) in enumerate(tree.levels):
        ends = np.append(starts[1:], len(tree.points))
        for s, e, c, r in zip(starts, ends, centres, radius, strict=True):
            assert s <= c < e and np.linalg.norm(tree.points[s:e] - tree.points[c], axis=1).max() <= r + 1e-6
        assert k == 0 or (np.diff(parents) >= 0).all()


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from cropspark.llm.common import table

    docs = table(spark, SF, "documents")
    before, columns = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        texts = {r.doc_id: r.text for r in before.collect()}
        if name == "language":
            assert ids == set(texts)
        elif name == "near_duplicates":
            assert ids == set(brute_components(texts.items(), 5, 80)[1].values())
        elif name == "personal_data":
            assert ids == set(texts) and not any("@mail" in (r.text or "") for r in after.collect())
        else:
            items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in table(spark, SF, "benchmark").collect()]
            whole = {i for i, t in texts.items() for w in [" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))] if any(" ".join(x) in w for x in items)}
            assert set(texts) - ids == whole
        before = after
    packed = pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_queries_on_other_tables(spark):
    from cropspark.llm import queries

    for name, f in queries.QUERIES.items():
        assert f(spark, SF).columns, name
