"""Exact Jaccard join of documents on word shingles with a token-group matrix.

1. Shingle sets become sorted 64-bit hashes; documents with equal sets form a class and go on as one.
2. Tokens get one global order, from rare to frequent: frequent ones are found by counting, where any miscount changes the cost but never the
   result. If two sets link, the rarest tokens of each (its prefix) have ``MATCHES`` in common, and the places of these bound their overlap.
   A document without a partner that shares so many is done; only the others' sets are written.
3. Partition: documents with a common minimum hash meet the most typical of them (fewest rare tokens). Those that link with it form
   a group around it, with the largest distance as its radius; all others are groups of their own.
4. Token-group matrix: for each group the union of its members' prefix tokens, each with the sizes of its members and the
   largest partner that the token's place in their order allows. The number of tokens that two groups share bounds what any member of
   one shares with any of the other; group pairs below the number that a link needs are never opened.
5. Centres of the remaining pairs are compared. They link, or the triangle inequality of the Jaccard distance rules out every pair of
   members, or the pair is opened: members that share a token with a sufficient bound are compared. Only pairs of groups in different
   components are opened, since a link inside a component changes nothing.

Sets are compared exactly. No group is expanded into its pairs; a group of near copies costs one comparison for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import mix, shingle_hashes, steps, tidy, word_hashes, written
from cropspark.llm.graph import components

#: Tokens counted at once when looking for frequent ones; those seen less often than ``LEAST`` among them are taken for rare.
COUNTED, LEAST = 2_000_000, 3
#: Most frequent tokens that are told apart in the order; the others count as equally rare.
FREQUENT = 1 << 20
KEYS = 2
#: Common tokens that two linked sets must have in their prefixes (or as many as the overlap they need, if that is less). Each prefix is
#: longer by as many tokens less one.
MATCHES = 4
#: Posting lists up to this length tell which documents have a partner at all; in a longer one all documents may.
SHORT = 32


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in steps(batch, "text"):
            yield part, *shingle_hashes(*word_hashes(part.column("text")), shingle)


def frequent_tokens(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their counts; a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted():
            tokens, many = np.unique(np.concatenate(held), return_counts=True)
            often = many >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(many[often])], ["token", "n"])

        for _, tokens, _ in _sets(batches, shingle):
            held.append(tokens)
            n += len(tokens)
            if n >= COUNTED:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()

    found = texts.select("text").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > LEAST)
    top = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def signatures(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n, s1, s2, light, keys, prefix``: size and checksums of the set, share of rare tokens, minimum hashes, rarest tokens."""
    frequent, counts = frequent_tokens(texts, shingle)
    salts = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(KEYS)]
    low, top = np.uint64((1 << 24) - 1), np.uint64((1 << 24) - 1)
    marks = np.unique((frequent & low).astype(np.int64))
    schema = "doc_id long, n long, s1 long, s2 long, light double, keys array<long>, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << 24, bool)
        marked[marks] = True
        for part, tokens, ends in _sets(batches, shingle):
            sets = [np.unique(tokens[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            own, at = np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(n)])
            mixed, often = mix(own), np.zeros(len(own), np.uint64)
            maybe = np.flatnonzero(marked[(own & low).astype(np.int64)])
            if len(maybe):
                place = np.minimum(np.searchsorted(frequent, own[maybe]), len(frequent) - 1)
                known = frequent[place] == own[maybe]
                often[maybe[known]] = counts[place[known]].astype(np.uint64)
            rank = (np.minimum(often, top) << np.uint64(40)) | (mixed >> np.uint64(24))  # equal ranks: in order of tokens
            rare = np.concatenate([[0], np.cumsum(often == 0)])
            salted = [mixed * s for s in salts]
            sums, keys, prefixes = np.zeros((len(sets), 2), np.uint64), [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if a == b:
                    keys.append(np.zeros(0, np.int64))
                    prefixes.append(np.zeros(0, np.int64))
                    continue
                sums[i] = own[a:b].sum(), mixed[a:b].sum()
                keys.append(np.array([x[a:b].min() for x in salted], np.uint64).view(np.int64))
                length = b - a - -(-percent * (b - a) // 100) + MATCHES
                prefixes.append(own[a:b][np.argsort(rank[a:b], kind="stable")[:length]].view(np.int64))
            both = sums.view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.diff(rare[at]) / np.maximum(n, 1)), _lists(keys), _lists(prefixes)], [c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(tidy(run), schema)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def token_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, size, tokens`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, ends in _sets(batches, shingle):
            own = [np.unique(tokens[a:b]).view(np.int64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(o) for o in own], pa.int64()), _lists(own)], ["id", "size", "tokens"])

    return texts.mapInArrow(tidy(run), "id long, size long, tokens array<long>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact Jaccard similarity as ``common`` over ``joint`` to pairs ``a, b``."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("_tb"))
    common = F.size(F.array_intersect("_ta", "_tb")).cast("long")
    return pairs.join(left, "a").join(right, "b").withColumn("common", common).withColumn("joint", F.size("_ta") + F.size("_tb") - F.col("common")).drop("_ta", "_tb")


def _reach(n: Column, pos: Column, percent: int) -> Column:
    """Largest partner of a set of ``n`` tokens if the token at ``pos`` of its order is one of the first MATCHES common ones: the overlap is
    at most the tokens from there on and the common ones before, and percent / (100 + percent) of both sizes are needed."""
    return F.floor(F.least(n, n - pos + MATCHES - 1) * (100 + percent) / percent + 1e-9) - n


def _enough(n1: str, n2: str, percent: int) -> Column:
    """Common prefix tokens that sets of at least these sizes must have."""
    return F.least(F.lit(MATCHES), F.ceil((F.col(n1) + F.col(n2)) * percent / (100 + percent) - 1e-9))


def similar_documents(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents link when 100 * common >= percent * joint shingles.

    Words are separated by white space, A-Z lower-cased. A text with fewer words than a shingle is one shingle, a missing or empty one
    has none and links with nothing. Rows with equal ``doc_id`` are one document; rows without one link with nothing and have no
    component. ``component_id`` is the smallest ``doc_id`` that links lead to.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(texts, shingle, percent))
    return _joined(texts, signed, shingle, percent)


def _joined(texts: DataFrame, signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"], "left_semi").withColumnRenamed("doc_id", "id")
    postings = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("id", "n", "token", _reach(F.col("n"), F.col("pos"), percent).alias("u")).repartition("token")
    lengths = postings.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1")
    postings = written(postings.join(lengths, "token"))
    fits = "n <= u_b AND n_b <= u"
    other = postings.select(F.col("id").alias("b"), "token", F.col("n").alias("n_b"), F.col("u").alias("u_b"))
    few, many = postings.filter(F.col("many") <= SHORT), postings.filter(F.col("many") > SHORT)
    held = many.groupBy("id", "n").agg(F.count("*").alias("h"))
    pairs = few.join(other, "token").filter(f"id < b AND {fits}").groupBy("id", "b", "n", "n_b").agg(F.count("*").alias("m"))
    pairs = pairs.join(held.select("id", "h"), "id", "left").join(held.select(F.col("id").alias("b"), F.col("h").alias("h_b")), "b", "left")
    partnered = pairs.filter(F.col("m") + F.least(F.coalesce("h", F.lit(0)), F.coalesce("h_b", F.lit(0))) >= _enough("n", "n_b", percent)).select(F.explode(F.array("id", "b")).alias("id"))
    crowded = held.filter(F.col("h") >= F.least(F.lit(MATCHES), F.ceil(F.col("n") * percent / 100 - 1e-9))).select("id")
    active = written(partnered.union(crowded).distinct())
    postings = written(postings.drop("many").join(active.hint("shuffle_hash"), "id", "left_semi"))
    sets = written(token_sets(texts.join(active.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi"), shingle))

    # Groups: those that link with the most typical document of a common minimum hash.
    keyed = written(reps.join(active.hint("shuffle_hash"), "id", "left_semi").select("id", "n", "light", F.posexplode("keys").alias("k", "key")))
    centre = keyed.groupBy("k", "key").agg(F.min(F.struct("light", F.col("id").alias("b"), F.col("n").alias("nb"))).alias("c"), F.count("*").alias("m")).filter("m > 1").select("k", "key", "c.b", "c.nb")
    met = keyed.join(centre, ["k", "key"]).filter((F.col("id") != F.col("b")) & (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent))
    met = met.select(F.col("id").alias("a"), "b").distinct()
    own = postings.select(F.col("id").alias("a"), "token", "n", "u")
    other = postings.select(F.col("id").alias("b"), "token", F.col("n").alias("n_b"), F.col("u").alias("u_b"))
    met = met.join(own, "a").join(other, ["b", "token"]).filter(fits).groupBy("a", "b", "n", "n_b").count().filter(F.col("count") >= _enough("n", "n_b", percent)).select("a", "b")
    links = written(compared(met, sets).filter(f"100 * common >= {percent} * joint"))
    member = links.groupBy("a").agg(F.min(F.struct(F.col("b").alias("g"), (1 - F.col("common") / F.col("joint")).alias("d"))).alias("g")).select(F.col("a").alias("id"), "g.g", "g.d")
    grouped = written(active.join(member, "id", "left").select("id", F.coalesce("g", "id").alias("g"), F.coalesce("d", F.lit(0.0)).alias("d")))
    radius = grouped.groupBy("g").agg(F.max("d").alias("r"))

    # Matrix of tokens and groups; pairs of groups whose bound allows a link.
    placed = postings.join(grouped.select("id", "g"), "id")
    matrix = written(placed.groupBy("token", "g").agg(F.max("u").alias("u"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    one = matrix.select("token", F.col("g").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("u", "lo", "hi")])
    two = matrix.select("token", F.col("g").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("u", "lo", "hi")])
    bound = (F.col("a") < F.col("b")) & (F.col("lo_a") <= F.col("u_b")) & (F.col("lo_b") <= F.col("u_a"))
    bound = bound & (F.col("hi_a") * 100 >= F.col("lo_b") * percent) & (F.col("hi_b") * 100 >= F.col("lo_a") * percent)
    met = one.join(two, (one["token"] == two["token"]) & bound).groupBy("a", "b").agg(F.count("*").alias("m"), F.min("lo_a").alias("lo_a"), F.min("lo_b").alias("lo_b"))
    opened = met.filter(F.col("m") >= _enough("lo_a", "lo_b", percent)).select("a", "b")
    judged = compared(opened, sets).join(radius.select(F.col("g").alias("a"), F.col("r").alias("r_a")), "a").join(radius.select(F.col("g").alias("b"), F.col("r").alias("r_b")), "b")
    judged = written(judged.withColumn("linked", F.expr(f"100 * common >= {percent} * joint")))
    found = links.select("a", "b").union(judged.filter("linked").select("a", "b"))
    near = judged.filter(f"NOT linked AND r_a + r_b > 0 AND 1 - common / joint <= {1 - percent / 100} + r_a + r_b + 1e-9").select("a", "b")
    labels = components(found)

    # Members of pairs that the bounds can't decide and that no link has joined yet.
    if not near.isEmpty():
        label_a, label_b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
        apart = near.join(label_a, "a", "left").join(label_b, "b", "left").filter("coalesce(c_a, a) <> coalesce(c_b, b)").select(F.col("a").alias("ga"), F.col("b").alias("gb"))
        # Only tokens that both groups hold with a sufficient bound, then only the members that hold them.
        both = apart.join(one.select(F.col("a").alias("ga"), "token", "u_a", "lo_a"), "ga").join(two.select(F.col("b").alias("gb"), "token", "u_b", "lo_b"), ["gb", "token"])
        both = both.filter("lo_a <= u_b AND lo_b <= u_a").select("ga", "gb", "token")
        member_a = placed.select(F.col("g").alias("ga"), F.col("id").alias("a"), "token", "n", "u")
        member_b = placed.select(F.col("g").alias("gb"), F.col("id").alias("b"), "token", F.col("n").alias("n_b"), F.col("u").alias("u_b"))
        pairs = both.join(member_a, ["ga", "token"]).join(member_b, ["gb", "token"]).filter(fits).groupBy("a", "b", "n", "n_b").count().filter(F.col("count") >= _enough("n", "n_b", percent)).select("a", "b")
        more = written(compared(pairs, sets).filter(f"100 * common >= {percent} * joint").select("a", "b"))
        if not more.isEmpty():
            labels = components(found.union(more))

    named = classes.join(labels, classes["rep"] == labels["id"], "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    lone = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(named, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(lone)


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id, once if its row is repeated."""
    joined = written(similar_documents(docs, shingle, percent).filter("doc_id IS NOT NULL").select("doc_id", "component_id"))
    stays = joined.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_many"))
    kept = docs.join(stays.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
    if not stays.filter("_many > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(docs.filter("doc_id IS NULL"))


__all__ = ["one_of_each", "similar_documents"]
