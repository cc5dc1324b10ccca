"""Token ids: Huffman corpus, packing, shards."""

import random
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
import pytest

from cropspark.llm import huffman, packing
from cropspark.llm.sharding import byte_shards
from cropspark.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_same_ids(plain):
    rng = random.Random(3)
    parts = [*" \n\t    é×aZ1.,'s\"-\u0085\x1c\x00¿日🙂", " a", " é", "'ll", " 12", "\r\n", "word.\nNext", "\u2003", "\u00a0 "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["", None, "   ", "a" * 5000]
    ids, bounds = Encoder(default_tokenizer())(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain(t), t


def test_added_tokens_give_their_ids(plain):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "<", *" \n\té×aZ1.'s日", "  ", " a", "'ll", " \n", "one", " two"]
    texts = ["one two<|endoftext|>three", "<|endof", "text|> over two texts", "<|endoftext|>", None, "", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    ids, bounds = Encoder(default_tokenizer())(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain(t), t
    assert ids[: bounds[1]].tolist() == [505, 734, 50256, 15542, 2]
    sliced, bounds = Encoder(default_tokenizer(), None)(pa.array(texts).slice(3, 40))
    for i, t in enumerate(texts[3:43]):
        assert sliced[bounds[i] : bounds[i + 1]].tolist() == plain(t)[:-1], t


def test_added_tokens_that_take_their_surroundings(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    tokenizer, path = Tokenizer.from_file(default_tokenizer()), str(tmp_path / "tokenizer.json")
    tokenizer.add_special_tokens([AddedToken("<|pad|>", lstrip=True, rstrip=True), AddedToken("<|pad|>>", normalized=False), AddedToken("mid", single_word=True)])
    tokenizer.add_tokens([AddedToken("e<|", normalized=True)])
    tokenizer.save(path)
    rng = random.Random(6)
    parts = ["<|pad|>", "<|pad|>>", "<|endoftext|>", "mid", "<|", " ", "  ", "\n", " a", "one", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    ids, bounds = Encoder(path, None)(pa.array(texts))
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_queries_keep_added_tokens(spark, plain):
    texts = ["one two<|endoftext|>three", "one two", "<|endoftext|>" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = huffman.encoded_ids(docs).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(plain(t)), crc(plain(t))) for i, t in enumerate(texts)]
    pieces = packing.pieces(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.length, r.ids_crc32) for r in pieces] == [(i, len(plain(t)), crc(plain(t))) for i, t in enumerate(texts)]


def test_encoder_beyond_its_memory(plain, monkeypatch):
    monkeypatch.setattr("cropspark.llm.tokens.REMEMBERED", 50)
    encoder, rng = Encoder(default_tokenizer()), random.Random(1)
    for _ in range(5):
        texts = [" ".join(f"q{rng.randrange(300)}" for _ in range(40)) for _ in range(10)]
        ids, bounds = encoder(pa.array(texts))
        assert all(ids[bounds[i] : bounds[i + 1]].tolist() == plain(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("counts", [[0, 5], [1, 1], [1] * 17, [2**k for k in range(30)], [10**9, 1, 1, 1], []])
def test_code_lengths_are_a_full_prefix_code(counts):
    lengths = huffman.code_lengths(np.array(counts, np.int64), 16).astype(int)
    used = lengths[lengths > 0]
    assert (used > 0).sum() == sum(c > 0 for c in counts) and (used <= 16).all()
    assert len(used) < 2 or sum(2.0**-x for x in used) == 1


def test_length_limited_codes_are_optimal():
    counts = [1, 1, 2, 3, 5, 8, 13]
    free = huffman.code_lengths(np.array(counts), 16).astype(int)
    assert int((free * counts).sum()) == 78
    limited = huffman.code_lengths(np.array(counts), 3).astype(int)
    assert max(limited) == 3 and int((limited * counts).sum()) == min(
        sum(a * b for a, b in zip(combo, counts, strict=True)) for combo in _all_codes(7, 3))


def _all_codes(n, limit):
    def grow(prefix, budget):
        if len(prefix) == n:
            if budget == 0:
                yield prefix
            return
        for size in range(1, limit + 1):
            if budget >= 2 ** (limit - size):
                yield from grow([*prefix, size], budget - 2 ** (limit - size))

    return grow([], 2**limit)


def test_corpus_round_trip(corpus, plain, spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 3000)
    got = huffman.encoded_ids(corpus).collect()
    rows = sorted(((r.doc_id, plain(r.text)) for r in corpus.collect()), key=lambda r: r[0])
    expected, start = [], 0
    for i, ids in rows:
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in got)


def test_corpus_of_nothing_and_of_missing_ids(no_docs, spark):
    assert huffman.encoded_ids(no_docs).count() == 0
    got = huffman.encoded_ids(spark.createDataFrame([(None, "a b"), (5, None), (-3, "x")], "doc_id long, text string")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -3, 5] and got[2].n_tokens == 1


def test_plan_places_everything_once():
    rng = random.Random(5)
    for capacity in (10, 37, 1024):
        for _ in range(100):
            lengths = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 200)))
            bins, seen = defaultdict(list), Counter()
            for length, first, end, base, each, at in packing.plan(lengths, capacity):
                for i in range(first, end):
                    bins[base + (i - first) // each].append((at + (i - first) % each * length, length))
                    seen[length] += 1
            assert seen == lengths
            for held in bins.values():
                place = 0
                for offset, length in sorted(held):
                    assert offset == place
                    place += length
                assert place <= capacity and sum(3 * length > capacity for _, length in held) <= 2


def test_plan_is_tight():
    assert len({r[3] for r in packing.plan({700: 4, 324: 4}, 1024)}) == 1
    rng = random.Random(2)
    lengths = Counter(rng.randint(1, 1024) for _ in range(20_000))
    rows = packing.plan(lengths, 1024)
    used = 1 + max(base + (end - first - 1) // each for _, first, end, base, each, _ in rows)
    assert used <= 1.02 * ceil(sum(k * v for k, v in lengths.items()) / 1024)


def test_pack(corpus, plain):
    got = packing.pack(corpus, 64).collect()
    texts, bins, docs = {r.doc_id: r.text for r in corpus.collect()}, defaultdict(list), defaultdict(list)
    for r in got:
        ids = plain(texts[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 64
    for i, pieces in docs.items():
        whole = plain(texts[i])
        many = 3 if i == 3 else 1
        assert sum(n for *_, n in pieces) == len(whole) * many and all(n == 64 for p, _, n in pieces if p)
    assert packing.pack(corpus.limit(0), 64).count() == 0


def test_shards(corpus):
    rows = byte_shards(corpus, 4).orderBy("start").collect()
    sizes = [len((t or "").encode()) + 1 for _, t in sorted(((r.doc_id, r.text) for r in corpus.collect()), key=lambda r: r[0])]
    assert [r.size for r in rows] == sizes and [r.start for r in rows] == [sum(sizes[:k]) for k in range(len(sizes))]
    assert [r.shard for r in rows] == [min(3, (2 * r.start + r.size) * 4 // (2 * sum(sizes))) for r in rows]
    for shard in range(4):
        assert [r.slot for r in rows if r.shard == shard] == list(range(sum(r.shard == shard for r in rows)))
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert byte_shards(corpus.limit(0), 4).count() == 0
