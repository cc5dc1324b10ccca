"""Personal data by weak supervision, in DataFrame functions alone.

1. The base patterns give spans that always count: email, ip, card, phone.
2. Wider patterns give further candidates, such as spelled-out addresses or phone numbers without a country code.
3. Labelers vote on every candidate: +1, -1 or 0 (no opinion). The regex labeler knows the base form, the gazetteers know top-level domains,
   reserved networks, issuers' first digits and area codes, the context labeler reads the words before the span, the shape labeler its
   separators. Votes are counted over all documents; a kind has at most ``3 ** 4`` combinations.
4. Expectation-maximisation over these counts estimates how often each labeler is right on true and on false candidates, and with that how
   likely each candidate is true.
5. A logistic classifier of votes and shape is trained on these probabilities and decides, as a column expression, which further
   candidates become spans. Spans never overlap: base spans come first, then the earliest candidate.

Positions are code points, ends are exclusive. A missing text counts as empty; it and texts without matches have no spans. Rows are
judged one by one, repeated rows give repeated results. Patterns are written so that their work and stack stay in proportion to a text
of any length. The driver sees only counts of vote combinations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import written

KINDS = ["email", "ip", "card", "phone"]

# The contract's patterns. Where a run of characters can only match from its beginning, a look-behind says so; \G lets a match begin
# where the last one ended. Possessive quantifiers stand where nothing could be given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# Further candidates.
WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|<at>) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|<dot>|\.) ?[A-Za-z0-9-]{1,63}+){1,8}+"
WIDE_PHONE = r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])"

# Gazetteers and context words: fixed values.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "example", "test"]
NETWORKS = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
CONTEXT = {
    "email": r"(e-?mail|mail|contact|write|reach|correo|courriel|schreib)[^\n]{0,12}$", "ip": r"(ip|address|server|host|login|from)[^\n]{0,12}$",
    "card": r"(card|visa|master|amex|credit|payment|tarjeta|carte|karte)[^\n]{0,12}$", "phone": r"(phone|tel|call|mobile|fax|cell|llama|appel|ruf)[^\n]{0,12}$"}
AGAINST = r"(version|isbn|issn|order|invoice|total|id|serial|token|password|sha|key|ref)[^A-Za-z0-9\n]{0,6}$"
SPAN = "array<struct<kind:int,s:bigint,e:bigint,m:string>>"
LABELERS = ["regex", "gazetteer", "context", "shape"]


def _none() -> Column:
    return F.array().cast(SPAN)


def located(found: Column, pieces: Column, kind: int) -> Column:
    """Places of the matches ``found`` of a pattern, measured by the ``pieces`` of text between them."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("out"))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.get(pieces, i))
        end = begin + F.length(F.get(found, i))
        span = F.struct(F.lit(kind).alias("kind"), begin.cast("bigint").alias("s"), end.cast("bigint").alias("e"), F.get(found, i).alias("m"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, spans).otherwise(_none())


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    figures = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2 == 1).alias("second")))
    total = F.aggregate(figures, F.lit(0), lambda s, x: s + F.when(x["second"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare).between(1, 3), bare.cast("int")).otherwise(0) <= 255)

    return F.forall(F.split(m, r"\."), small)


#: Pattern, kind, a text that must occur, and the check of a match.
SEARCHES = {
    "email": (EMAIL, 0, "@", None), "ip": (IP, 1, ".", _octets), "card": (CARD, 2, None, _luhn), "phone": (PHONE, 3, "+", lambda m: F.length(_digits(m)).between(9, 15)),
    "wide_email": (WIDE_EMAIL, 0, "at", None), "wide_phone": (WIDE_PHONE, 3, None, None)}


def _passing(spans: Column, check) -> Column:
    return F.filter(spans, lambda x: check(x["m"]))


def _of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _searched(docs: DataFrame) -> DataFrame:
    """Add ``_b`` and ``_w``: base spans by kind, then start, and further candidates. Each step is a column of its own, since what a
    lambda refers to is computed again for each element."""
    out = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    needed = lambda hint: F.lit(True) if hint is None else F.contains("_t", F.lit(hint))
    out = out.withColumns({f"_f_{n}": F.when(needed(hint), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for n, (p, _, hint, _) in SEARCHES.items()})
    out = out.withColumns({f"_p_{n}": F.when(F.size(f"_f_{n}") > 0, F.split("_t", p, -1)) for n, (p, *_) in SEARCHES.items()})
    out = out.withColumns({f"_s_{n}": located(F.col(f"_f_{n}"), F.col(f"_p_{n}"), kind) for n, (_, kind, *_) in SEARCHES.items()})
    kept = {n: F.col(f"_s_{n}") if check is None else _passing(F.col(f"_s_{n}"), check) for n, (*_, check) in SEARCHES.items()}
    out = out.withColumns({"_b": F.concat(*[kept[k] for k in KINDS]), "_w": F.concat(kept["wide_email"], kept["wide_phone"])})
    return out.drop(*[f"_{x}_{n}" for x in "fps" for n in SEARCHES])


def _by_kind(kind: Column, email: Column, ip: Column, card: Column, phone: Column) -> Column:
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def _voted(text: Column, span: Column, is_base: bool) -> Column:
    """A span with its votes (-1, 0, 1) and whether it is a base span."""
    kind, m = span["kind"], span["m"]
    sign = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    before = F.lower(F.substr(text, F.greatest(span["s"] - 29, F.lit(1)).cast("int"), F.least(span["s"], F.lit(30)).cast("int")))
    last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    digits = _digits(m)
    gazetteer = _by_kind(kind, sign(last.isin(DOMAINS), ~last.rlike("^[a-z]{2,12}$")), sign(~m.rlike(NETWORKS), m.rlike(NETWORKS)), sign(digits.rlike(ISSUERS), digits.rlike("^0")), sign(~digits.rlike("^(00)?[01]{3}") & ~digits.rlike("^(.)\\1+$"), digits.rlike("^(.)\\1+$")))
    told = _by_kind(kind, *[before.rlike(CONTEXT[k]) for k in KINDS])
    shape = _by_kind(kind, sign(F.length(m).between(6, 80), F.length(m) > 120), sign(~m.rlike(r"(^|\.)0[0-9]")), sign(~m.rlike("[ -]") | m.rlike("^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$"), m.rlike("[ -]")), sign(m.rlike(r"[ ().-]"), ~m.rlike(r"[ ().-]")))
    votes = [F.lit(1 if is_base else 0), gazetteer, sign(told, before.rlike(AGAINST)), shape]
    return F.struct(kind.alias("kind"), span["s"].alias("s"), span["e"].alias("e"), F.lit(is_base).alias("base"), *[v.cast("int").alias(n) for v, n in zip(votes, LABELERS, strict=True)])


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add ``_base`` and ``_wide``: voted spans; a wide one that overlaps a base span is dropped."""
    found, text = _searched(docs), F.col("_t")
    apart = F.filter("_w", lambda w: ~F.exists("_b", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    found = found.withColumn("_a", apart)
    voted = found.withColumns({"_base": F.transform("_b", lambda x: _voted(text, x, True)), "_wide": F.transform("_a", lambda x: _voted(text, x, False))})
    return voted.drop("_b", "_w", "_a", "_t")


@dataclass
class Model:
    """Weights of the final classifier for each kind: bias, then one for each labeler but the regex one, whose vote says only whether a
    span is a base span; ``reliability`` has, for each kind and labeler, how often it is right when it votes."""

    weights: dict[int, list[float]]
    reliability: dict[tuple[int, str], float]
    priors: dict[int, float]

    def accepts(self, span: Column) -> Column:
        score = lambda w: F.lit(w[0]) + sum((F.lit(x) * span[n] for x, n in zip(w[1:], LABELERS[1:], strict=True)), F.lit(0.0))
        return _by_kind(span["kind"], *[score(self.weights.get(k, [-1.0, 0.0, 0.0, 0.0])) for k in range(4)]) > 0


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[list[dict[int, float]]], list[float]]:
    """EM over counted vote combinations: share of true candidates, each labeler's vote probabilities given false and true, and the
    probability that each combination is true. A vote of the first labeler, the base form with its checks, settles a candidate; else the two
    classes could change places. The other labelers begin as somewhat better than chance."""
    k = len(counts[0][0])
    prior = 0.5
    votes = [[{-1: 0.5, 0: 0.3, 1: 0.2}, {-1: 0.2, 0: 0.3, 1: 0.5}] for _ in range(k)]
    true = [0.5] * len(counts)
    for _ in range(rounds):
        for i, (combo, _) in enumerate(counts):
            yes = prior * math.prod(votes[j][1][v] for j, v in enumerate(combo))
            no = (1 - prior) * math.prod(votes[j][0][v] for j, v in enumerate(combo))
            true[i] = 1.0 if combo[0] == 1 else yes / (yes + no)
        total = sum(n for _, n in counts)
        prior = min(0.99, max(0.01, (sum(n * t for (_, n), t in zip(counts, true, strict=True)) + 1) / (total + 2)))
        for j in range(k):
            for side in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}  # one made-up vote of each kind keeps every probability above 0
                for (combo, n), t in zip(counts, true, strict=True):
                    mass[combo[j]] += n * (t if side else 1 - t)
                whole = sum(mass.values())
                votes[j][side] = {v: x / whole for v, x in mass.items()}
    return prior, votes, true


def classifier(counts: list[tuple[tuple[int, ...], int]], true: list[float], rounds: int = 300) -> list[float]:
    """Logistic regression on votes with the estimated probabilities as soft labels, by gradient steps with a small penalty."""
    total = sum(n for _, n in counts)
    weights = [0.0] * (1 + len(counts[0][0]))
    for _ in range(rounds):
        slope = [0.01 * w for w in weights]
        for (combo, n), t in zip(counts, true, strict=True):
            x = (1, *combo)
            gap = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True)))) - t
            slope = [s + n / total * gap * v for s, v in zip(slope, x, strict=True)]
        weights = [w - 0.5 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(candidates: DataFrame) -> Model:
    """Learn from ``_base`` and ``_wide`` of all documents; a kind without candidates accepts none."""
    votes = candidates.select(F.explode(F.concat("_base", "_wide")).alias("c")).groupBy("c.kind", *[F.col(f"c.{n}").alias(n) for n in LABELERS]).count().collect()  # 4 * 81 rows at most
    weights, reliability, priors = {}, {}, {}
    for kind in sorted({r["kind"] for r in votes}):
        counts = sorted((tuple(r[n] for n in LABELERS), r["count"]) for r in votes if r["kind"] == kind)
        prior, told, true = estimate(counts)
        priors[kind] = prior
        for name, (no, yes) in zip(LABELERS, told, strict=True):
            right, wrong = prior * yes[1] + (1 - prior) * no[-1], prior * yes[-1] + (1 - prior) * no[1]
            reliability[kind, name] = right / (right + wrong)
        weights[kind] = classifier([(c[1:], n) for c, n in counts], true)
    return Model(weights, reliability, priors)


def chosen(model: Model) -> Column:
    """All spans of a row: base ones and accepted wide ones that don't overlap an earlier one, by kind, then start."""
    wide = F.array_sort(F.filter("_wide", model.accepts), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(b["e"] - a["e"]).cast("int"))
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    kept = F.aggregate(F.transform(wide, bare), F.array().cast("array<struct<kind:int,s:bigint,e:bigint>>"), lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["e"] > x["s"]), out).otherwise(F.concat(out, F.array(x))))
    kept = F.when(F.size(wide) > 0, kept).otherwise(F.array().cast("array<struct<kind:int,s:bigint,e:bigint>>"))
    return F.array_sort(F.concat(F.transform("_base", bare), kept))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document; the counts and the digest are of base spans."""
    slim = written(with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    model = fit(slim)
    counts = [F.size(_of_kind("_base", k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return slim.select("doc_id", *counts, F.sha2(spelled(F.array_sort("_base")).cast("binary"), 256).alias("base_sha256"), spelled(chosen(model)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; ``n_chars``, where there is one, follows the text. Texts without a
    span, missing ones among them, stay as they are."""
    marked = with_candidates(docs.select(F.struct("*").alias("_row"), "text"))
    model = fit(marked)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.array_sort(chosen(model), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise((a["e"] - b["e"]).cast("int")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap, F.get(names, x["kind"])).alias("out"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    out = marked.withColumn("_spans", spans).withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(F.col("text")))
    columns = {c: F.col("_row").getField(c) for c in docs.columns}
    columns["text"] = F.col("_clean")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("_spans") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])
