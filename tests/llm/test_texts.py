"""Language, licenses, personal data, urls."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cropspark.llm import language, license, nbsvm, pii, urls


def test_codewords():
    for k in (1, 2, 3, 4, 7, 40):
        code = language.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert k == 1 or (abs(code.sum(axis=0)) < k).all()


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    kinds = {"aa": "bado kilu ramo", "bb": "strüm fächt lönz", "cc": "élour çaive nèque", "dd": "qwixz vjopf hkryp", "ee": "mmm nnnu ooou"}
    rows = [(i, " ".join(rng.choices(kinds[k].split(), k=rng.randint(2, 30))), k) for i, k in enumerate(rng.choices(list(kinds), k=600))]
    return spark.createDataFrame([*rows, (700, None, "aa"), (701, "", None), (702, "12 34 !?", "bb"), (703, "🙂", None), (None, "bado kilu", "aa"), *rows[:3]], "doc_id long, text string, lang string")


def test_language_on_held_out_rows(tongues):
    got = language.predict(tongues).collect()
    assert len(got) == tongues.count()
    truth = {r.doc_id: (r.text, r.lang) for r in tongues.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and all(r.lang_pred == truth[r.doc_id][1] and not r.ambiguous for r in held)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id is not None and r.doc_id >= 700)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_anything_to_learn(tongues, no_docs):
    assert {r.lang_pred for r in language.predict(tongues.withColumn("lang", tongues["lang"].substr(1, 0)).filter("false")).collect()} == set()
    assert language.predict(no_docs).count() == 0
    none = tongues.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {(r.lang_pred, r.score) for r in language.predict(none).collect()} == {("und", 0.0)}
    one = tongues.filter("lang = 'aa'")
    assert {r.lang_pred for r in language.predict(one).filter("doc_id < 600").collect()} == {"aa"}


def test_ambiguous_texts_are_rejected(tongues, spark):
    """What no codeword fits better than chance goes; every real text, short or in two languages, stays."""
    model = language.fit(tongues)
    mixed = [(800, "bado kilu ramo strüm fächt lönz"), (801, "ramo nnnu"), (802, "kilu")]
    strange = [(900, "ЖЖЖЖ"), (901, "ЖЖ ЖЖЖ")]
    assert not any(model.odds[language.trigrams([t.encode()])[0]].any() for _, t in strange)
    more = spark.createDataFrame([(i, t, None) for i, t in [*mixed, *strange]], tongues.schema)
    docs = tongues.unionAll(more)
    kept = language.known_language(docs.withColumn("score", docs["lang"]), model)
    assert kept.columns == [*tongues.columns, "score"]
    gone = docs.exceptAll(kept.drop("score")).collect()
    assert sorted(r.doc_id for r in gone) == [700, 701, 702, 703, 900, 901]
    assert {r.doc_id for r in language.identify(docs, model).filter("ambiguous").collect()} >= {900, 901}


def plain_prediction(rows, texts):
    """Counts, log-odds, weights and losses by loops over texts and bits."""
    def grams(text):
        data = b" " + text.encode() + b" "
        fold = [b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in data]
        return [((fold[i] * 0x9E3779B1 + fold[i + 1] * 0x85EBCA77 + fold[i + 2] * 0xC2B2AE3D) % 2**32) >> 19 for i in range(len(fold) - 2)]

    names = sorted({lang for _, lang in rows})
    code = language.codewords(len(names))
    counts = {n: Counter(g for t, lang in rows if lang == n for g in grams(t)) for n in names}
    totals = {n: sum(c.values()) + 0.5 * language.FEATURES for n, c in counts.items()}
    seen = set().union(*counts.values())
    share = lambda n, g: (counts[n][g] + 0.5) / totals[n]

    def margins(text):
        out = []
        for bit in range(code.shape[1]):
            ones, zeros = ([n for k, n in enumerate(names) if code[k, bit] == v] for v in (1, -1))
            odds = [math.log(sum(share(n, g) for n in ones) / len(ones)) - math.log(sum(share(n, g) for n in zeros) / len(zeros)) if g in seen else 0 for g in grams(text)]
            out.append(max(-30, min(30, sum(odds) / math.sqrt(len(odds)))) if odds else 0)
        return out

    right = [[1.0] * code.shape[1] for _ in names]
    n = Counter(lang for _, lang in rows)
    for t, lang in rows:
        for bit, m in enumerate(margins(t)):
            right[names.index(lang)][bit] += m * code[names.index(lang), bit] > 0
    weights = [[x / (n[names[k]] + 2) for x in r] for k, r in enumerate(right)]
    weights = [[x / sum(r) for x in r] for r in weights]
    found = []
    for t in texts:
        m = margins(t)
        loss = [sum(w * math.log1p(math.exp(-x * c)) for w, x, c in zip(weights[k], m, code[k], strict=True)) for k in range(len(names))]
        best = min(range(len(names)), key=loss.__getitem__)
        found.append((names[best], 1 / sum(math.exp(loss[best] - x) for x in loss)))
    return found


def test_language_against_loops(tongues, spark, monkeypatch):
    rows = [r for r in tongues.collect() if r.doc_id is not None and r.doc_id < 700]
    learned = [(r.text, r.lang) for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2][:120]
    df = spark.createDataFrame([(k * 4, t, lang) for k, (t, lang) in enumerate(learned) if zlib.crc32(str(k * 4).encode()) % 4 != 2], "doc_id long, text string, lang string")
    learned = [(r.text, r.lang) for r in df.collect()]
    asked = [r.text for r in rows[:60]] + ["kilu ramo fächt", "Bado"]
    expected = plain_prediction(learned, asked)
    for piece in (1 << 18, 7):  # long texts, taken piece by piece, come to the same
        monkeypatch.setattr(language, "PIECE", piece)
        model = language.fit(df)
        best, score, *_ = model.decode(model.margins([t.encode() for t in asked]))
        for k, (lang, share) in enumerate(expected):
            assert model.languages[best[k]] == lang and abs(score[k] - share) < 1e-5


def test_very_long_text_in_a_bounded_process():
    """One text of 64 MB under a limit of memory that holds it a few times only."""
    code = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from cropspark.llm import language
model = language.Model(list("abcdefgh"), np.random.default_rng(1).integers(0, 50, (8, language.FEATURES)).astype(float))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = language._judged(pa.array(["bado kilu " * 6_700_000]), model)
assert found[0][0] and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code.format(root=root)], check=True, timeout=300)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    clean = "la mer est calme ce soir et le vent tombe sur les vagues".split()
    noise = "$$$ BUY!! now*** now*** WIN### %%%".split()
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        docs.append((i, " ".join(rng.choices(clean, k=rng.randint(6, 60)) + ([] if good else rng.choices(noise, k=4))), 9.0, "q"))
        labels += [(i, int(good), 0)] if rng.random() < 0.8 else []
    docs += [(600, None, 0.0, ""), (601, "", 0.0, ""), (602, "e" * 3_000_000, 0.0, ""), (None, "calme", 0.0, ""), docs[3], docs[3]]
    labels += [(600, 1, 0), (601, None, 0), (604, 7, 0), (None, 1, 0), labels[0]]
    documents = spark.createDataFrame(docs, "doc_id long, text string, score double, quality string").repartition(4)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = nbsvm.predict(documents, given).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, q, _ in labels if i is not None and i < 500}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and min(s for s, q in held if q) > max(s for s, q in held if not q)
    scores = {r.doc_id: r.score for r in got}
    assert scores[600] == scores[601] and [r.doc_id for r in nbsvm.predict(documents, given.filter("false")).filter("score <> 0.5").collect()] == []
    assert nbsvm.predict(documents.limit(0), given).count() == 0
    assert {r.score > 0.99 for r in nbsvm.predict(documents, given.filter("quality = 1")).collect()} == {True}


def test_indicators_against_loops(monkeypatch):
    monkeypatch.setattr(nbsvm, "STRETCH", 40)
    texts = ["Of Of Of of x", "", None, "A!! b|  c9\n\tZZ.", "é" * 33, "one two three four five six seven eight nine ten eleven twelve"]

    def mixed(values, salt):
        h = (salt * 0x27D4EB2F) & 0xFFFFFFFF
        for v, f in zip(values, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
            h = ((h ^ ((v + 1) * f & 0xFFFFFFFF)) * 0x2C1B3C6D) & 0xFFFFFFFF
            h ^= h >> 15
        return h >> 16

    def shape(word, before):
        kinds = {("1" if b >= 128 or 97 <= b <= 122 else "2" if 65 <= b <= 90 else "4" if 48 <= b <= 57 else "8" if 33 <= b <= 126 else "1") for b in word}
        code = sum(map(int, kinds)) | (65 <= word[0] <= 90) << 4 | (33 <= word[-1] <= 126 and not chr(word[-1]).isalnum()) << 5 | (word.lower() == (before or b"").lower()) << 6
        return code | sum(len(word) >= n for n in (2, 4, 8, 16)) << 7

    for k, text in enumerate(texts):
        expected = set()
        for piece in nbsvm.stretches((text or "").encode()):
            data = b"\n\n" + piece + b"\n\n\n\n"
            expected |= {mixed(data[i : i + n], n) for n in (1, 2, 3) for i in range(len(piece) + 4)}
            words = piece.split()
            shapes = [shape(w, words[i - 1] if i else None) for i, w in enumerate(words)]
            expected |= {mixed(shapes[i : i + n], 3 + n) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}
        (_, marks), = nbsvm.indicators(pa.array([text, "other text"]))
        assert set(marks[0].nonzero()[0].tolist()) == expected, k
    assert b"".join(nbsvm.stretches(b"ab " * 40)) == b"ab " * 40 and max(map(len, nbsvm.stretches(b"x" * 99))) == 40


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(60, 5))
    signs = np.where(dense[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(5), x) for x in dense]
    primal = lambda w: w @ w / 2 + np.maximum(0, 1 - signs * (dense @ w[:5])).sum()
    weights = nbsvm.descend(rows, signs)
    least = primal(weights)
    assert all(primal(weights + np.pad(d, (0, nbsvm.FEATURES - 5))) > least - 0.05 for d in rng.normal(scale=0.05, size=(200, 5)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places, labels = WORD.findall(lowered), [], set()
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_phrases(spark):
    rng = random.Random(9)
    parts = ["cc", "by", "CC BY", "cc-by", "General Public", "license", "Licence", "all rights", "reserved", ".", "\n", "é", "x", "ccby", "  ", "Ünder", "7"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + [None, "", "cc by " * 4000, "a" * 40_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(4)
    for r in license.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "accepted"), [
    ("a b c", True), ("a b x c", True), ("a b x y c", True), ("a b x y z c", False), ("a c", False), ("a opt b c", True), ("a opt in b c", True), ("a in b c", False), ("zz a b c", True), ("a b", False)])
def test_automaton(text, accepted):
    automaton = license.Automaton("a <<optional>>opt <<optional>>in<</optional>><</optional>> b <<any:2>> c")
    words = text.encode().split()
    assert any(automaton.match(words, i)[0] for i in range(len(words))) == accepted


def test_license_templates(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "licensed under the\nApache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3.", "Copyright 2020 Some One. All rights reserved", "Permission to use, copy, modify, and/or distribute this software for any purpose"]
    got = [r.labels for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["cc-by,cc-by-nc-4.0", "apache-2.0", "gpl,gpl-3.0", "reserved", ""]


def test_license_lines_of_the_tables(spark):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit-notice", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "All rights reserved.": "reserved", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0"}
    got = license.scan(spark.createDataFrame([(i, f"Some prose. {line}\nMore of it.") for i, line in enumerate(lines)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in got] == [(label, 1.0) for label in lines.values()]


@pytest.mark.parametrize("verb", ["Licensed", "Released", "distributed", "Available", "published"])
def test_license_verbs(spark, verb):
    names = {"the MIT License": "mit-notice", "the terms of the MIT license": "mit-notice", "the Apache License, Version 2.0": "apache-2.0", "CC BY-SA 4.0": "cc-by,cc-by-sa-4.0", "the terms of the GNU General Public License, version 2": "gpl,gpl-2.0", "the GNU Lesser General Public License": "gpl,lgpl", "the sun, but no license": "", "mit": ""}
    got = license.scan(spark.createDataFrame([(i, f"It is {verb} under {name}.") for i, name in enumerate(names)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(names.values())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out, counts = [], []
    for kind, pattern in PATTERNS.items():
        n = len(out)
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            out += [f"{kind}:{m.start()}:{m.end()}"] if fine else []
        counts.append(len(out) - n)
    return counts, out


def test_personal_data(spark):
    rng = random.Random(2)
    parts = ["1", "22", "4111111111111111", "5500 0000 0000 0004", "378282246310005", " ", "-", ".", "@", "a", "b.c", "+1", "(555)", "+49 30 123456", "é", "🙂", "_", "0", "255", "256", "1.2.3.4", "192.168.0.1", "x@y.z", "ann [at] mail.com", "call 212 555 0187", "\n", "%"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", "9" * 3000, "a." * 3000, "a@" + "b." * 20000 + "c", "+1" + "(" * 20000, "1 " * 20000, "a" * 3000 + "@"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, _base string").repartition(4)
    extra = 0
    for r in pii.find(df).collect():
        counts, spans = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id]
        found = [s for s in r.spans.split(",") if s]
        assert set(spans) <= set(found)
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in set(found) - set(spans))
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False))
        extra += len(places)
    assert extra > 50


def test_very_long_runs(spark):
    texts = ["a" * 300_000 + "@", "1." * 100_000, "9" * 300_000, "+1-" * 50_000, "1 " * 100_000, "x@y.z " * 2000]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [0] * 5 + [2000] and got[1].n_ip == 25_000


def test_redaction(spark, no_docs):
    df = spark.createDataFrame([(1, "mail x@y.z now 1.2.3.4 ok", 25, "é"), (2, "clean é", 7, None), (3, None, 0, "x"), (4, "+49 30 123456🙂", 14, "")], "doc_id long, text string, n_chars long, _t string")
    got = {r.doc_id: (r.text, r.n_chars, r._t) for r in pii.redact(df).collect()}
    assert got == {1: ("mail <EMAIL> now <IP> ok", 24, "é"), 2: ("clean é", 7, None), 3: (None, 0, "x"), 4: ("<PHONE>🙂", 8, "")}
    assert pii.redact(no_docs).columns == no_docs.columns and pii.redact(no_docs).count() == 0


def test_reliabilities_and_classifier():
    rng, counts = random.Random(1), Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda right: (1 if true else -1) * (1 if rng.random() < right else -1)  # noqa: E731, B023
        counts[1 if true and rng.random() < 0.5 else 0, vote(0.9), vote(0.8), vote(0.55)] += 1
    rows = sorted(counts.items())
    prior, told, true = pii.estimate(rows)
    assert abs(prior - 0.4) < 0.05 and abs(told[1][1][1] - 0.9) < 0.05 and abs(told[2][0][-1] - 0.8) < 0.06
    weights = pii.classifier([(c[1:], n) for c, n in rows], true)
    assert weights[1] > weights[2] > weights[3]


def test_urls_follow_rules_and_aliases(spark):
    import duckdb

    rows = [(1, None), (2, ""), (3, "x"), (4, "http://"), (5, "HTTP://Org/ES"), (6, "a://ORG"), (7, "b://x.example.ORG:80/en/1"), (8, "q://example.org/en/1?x"), (9, "q://b.example.org/en/1"), (None, "q://com/fr/"), (11, "q://xcom/fr/"), (12, "q://a.com/fr/\n"), (13, "q://n.net/p?1"), (14, "q://n.net/p?2"), (15, "q://n.net/p"), (15, "q://n.net/p"), (16, "q://" + "a." * 3000 + "com/de/x"), (17, "q://ÉX.example.org/es/É")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    con = duckdb.connect()
    frame = pages.toPandas()
    frame["page_id"] = frame["page_id"].astype("Int64")
    con.register("pages", frame)
    assert sorted(map(tuple, urls.judge_urls(pages).collect()), key=str) == sorted(con.execute(urls.ORACLE_SQL).fetchall(), key=str)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    keys = spark.range(20_000).selectExpr("CAST(id AS STRING) AS key")
    listed = keys.filter("CAST(key AS INT) % 7 = 0").unionAll(spark.createDataFrame([("absent",)], "key string"))
    cascade = urls.Cascade(keys, listed)
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.holds(keys["key"]) != (keys["key"].cast("int") % 7 == 0)).count() == 0
    assert keys.filter(urls.Cascade(keys, listed.limit(0)).holds(keys["key"])).count() == 0
    pages = spark.createDataFrame([(i, f"u://n.net/{i % 50}?{i % 100}") for i in range(300)], "page_id long, url string")
    small = sorted(map(tuple, urls.judge_urls(pages).collect()), key=str)
    monkeypatch.setattr(urls, "MOST_LISTED", 0)
    assert sorted(map(tuple, urls.judge_urls(pages).collect()), key=str) == small and sum(r[4] == "block" for r in small) == 150
