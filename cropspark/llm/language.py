"""Language identification by error-correcting output codes over binary n-gram classifiers.

Each language has a codeword; for each bit a classifier, trained on the counts of all training rows, tells languages with a 1 from those
with a 0 by the log-odds of byte trigrams (A-Z lower-cased, ASCII other than letters as a space). A text's margins are decoded with the
logistic loss, weighted by how often each bit was right for each language on the training rows. The nearest codeword wins; where a
second one is nearly as near (``AMBIGUOUS``), or the nearest is no better than chance (``CHANCE``), the row is flagged.

Training counts and weights come from all training rows, summed on the executors; only ``languages x FEATURES`` sums reach the driver.
Long texts are taken piece by piece.
Missing texts, and texts without a letter, are ``und`` with score 0, as is everything when there is nothing to learn from. Languages
that no training row has are never predicted. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm.common import steps, tidy

FEATURES = 1 << 13
#: A text is flagged if its two nearest codewords differ in loss by less than this share of its mean margin. Texts in two languages are.
AMBIGUOUS = 0.05
#: Weighted margin in favour of the nearest codeword up to which it is no better than chance: such texts are flagged, too, and ``known_language``
#: drops them, and only them. A text in two languages has margins in favour of both and stays, however near they are to each other.
CHANCE = 1e-9
#: Bytes of text in a step of a task, and in a piece whose trigrams are held at a time; a longer text is taken piece by piece.
STEP, PIECE = 2 << 20, 1 << 18

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _features(data: np.ndarray) -> np.ndarray:
    mixed = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    return (mixed >> np.uint32(32 - 13)).astype(np.int32)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, each with a space at both ends, and how many each text has (its bytes)."""
    features = _features(_FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)])
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    keep = np.ones(len(features), bool)
    between = np.cumsum(n + 2)[:-1] - 2
    keep[between], keep[between + 1] = False, False
    return features[keep], n


def pieces(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The trigrams of all texts in turn, at most ``PIECE`` at a time: the first text's place, the features, and how many of them each text has."""
    at = 0
    while at < len(texts):
        if (size := len(texts[at])) > PIECE:
            for i in range(0, size, PIECE):
                part = texts[at][max(0, i - 1) : i + PIECE + 1]
                part = b" " * (i == 0) + part + b" " * (i + PIECE >= size)
                yield at, _features(_FOLD[np.frombuffer(part, np.uint8)]), np.array([min(PIECE, size - i)])
            at += 1
            continue
        end, total = at, 0
        while end < len(texts) and total + len(texts[end]) <= PIECE:
            total += len(texts[end])
            end += 1
        yield at, *trigrams(texts[at:end])
        at = end


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code up to four languages, beyond that the widest of a few pseudo-random ones."""
    if k <= 4:
        bits = max(1, 2 ** (k - 1) - 1)
        rows = [[1] * bits] + [[-1 if (b >> (k - 1 - i)) & 1 else 1 for b in range(1, bits + 1)] for i in range(1, k)]
        return np.array(rows[:k])
    bits, best, gap = int(np.ceil(10 * np.log2(k))), None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((k, bits)) < 0.5, -1, 1)
        code[0, np.abs(code.sum(axis=0)) == k] *= -1
        apart = (bits - code @ code.T) // 2
        least = int(apart[~np.eye(k, dtype=bool)].min())
        if least > gap:
            best, gap = code, least
    return best


class Model:
    """Languages, codewords, the bits' log-odds (FEATURES x bits) and the weight of each bit for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        ones, zeros = self.code.T > 0, self.code.T < 0
        self.odds = np.stack([np.log(shares[a].mean(axis=0)) - np.log((shares[b] if b.any() else shares).mean(axis=0)) for a, b in zip(ones, zeros, strict=True)], axis=1).astype(np.float32)
        self.odds[counts.sum(axis=0) == 0] = 0  # what no training row has speaks for no language
        self.odds = np.asfortranarray(self.odds)  # bit by bit
        self.weights = np.full(self.code.shape, 1.0 / self.code.shape[1])

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Each text's mean log-odds, scaled by the root of its length."""
        out = np.zeros((len(texts), self.odds.shape[1]))
        for first, features, n in pieces(texts):
            some = np.flatnonzero(n)
            if len(some):
                starts = (np.cumsum(n) - n)[some]
                for bit, odds in enumerate(self.odds.T):
                    out[first + some, bit] += np.add.reduceat(odds[features], starts, dtype=np.float64)
        lengths = np.fromiter(map(len, texts), np.float64, len(texts))
        return np.clip(out / np.sqrt(np.maximum(lengths, 1))[:, None], -30, 30)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its probability among all, whether another is as near, and whether its margins don't speak for it at all."""
        loss = np.stack([(np.logaddexp(0, -margins * c) * w).sum(axis=1) for c, w in zip(self.code, self.weights, strict=True)], axis=1)
        best = loss.argmin(axis=1)
        least = loss[np.arange(len(loss)), best]
        shares = np.exp(least[:, None] - loss)
        scale = np.maximum(np.abs(margins).mean(axis=1), 1e-12)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        chance = ((margins * self.code[best] * self.weights[best]).sum(axis=1) <= CHANCE) & (len(self.languages) > 1)
        return best, 1 / shares.sum(axis=1), (second - least) / scale < AMBIGUOUS, chance


def training_rows() -> Column:
    """True for the rows a model may learn from."""
    return F.col("lang").isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def _texts(column: pa.Array) -> list[bytes]:
    return pc.cast(pc.fill_null(column, ""), pa.binary()).to_pylist()


def fit(docs: DataFrame) -> Model | None:
    """Learn from all training rows; None if there are none."""
    rows = docs.filter(training_rows()).select(F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text", STEP):
                coded = part.column("lang").dictionary_encode()
                names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                for name in names:
                    sums.setdefault(name, np.zeros(FEATURES, np.int64))
                for first, features, n in pieces(_texts(part.column("text"))):
                    own = np.repeat(which[first : first + len(n)], n)
                    for k in np.unique(own):
                        sums[names[k]] += np.bincount(features[own == k], minlength=FEATURES)
        for name, row in sums.items():
            at = np.concatenate([[0], np.flatnonzero(row)])  # feature 0 always, so that a language of empty texts is known, too
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(np.where(np.arange(len(at)), row[at], 0))], ["lang", "feature", "n"])

    counted = rows.mapInArrow(tidy(count), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"), F.max("n").alias("m")).toArrow()
    languages = sorted(set(counted["lang"].to_pylist()))
    if not languages:
        return None
    counts = np.zeros((len(languages), FEATURES))
    np.add.at(counts, (np.searchsorted(languages, counted["lang"].to_pylist()), counted["feature"].to_numpy()), counted["n"].to_numpy())
    model = Model(languages, counts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(model.code.shape), np.zeros(len(languages))
        for batch in batches:
            for part in steps(batch, "text", STEP):
                lang = np.searchsorted(languages, part.column("lang").to_pylist())
                np.add.at(right, lang, model.margins(_texts(part.column("text"))) * model.code[lang] > 0)
                np.add.at(seen, lang, 1)
        at = np.argwhere(np.ones_like(right, bool))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(right.ravel()), pa.array(np.repeat(seen, right.shape[1]))], ["lang", "bit", "ok", "n"])

    judged = rows.mapInArrow(tidy(judge), "lang long, bit long, ok double, n double").groupBy("lang", "bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect()
    for r in judged:
        model.weights[r["lang"], r["bit"]] = (r["ok"] + 1) / (r["n"] + 2)
    model.weights /= model.weights.sum(axis=1, keepdims=True)
    return model


def _judged(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, ...]:
    """For each text: whether it has a letter and there is a model, and what ``decode`` tells."""
    if model is None:
        return np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts)), *np.zeros((2, len(texts)), bool)
    letters = np.fromiter((any(map(str.isalpha, t)) if t else False for t in texts.to_pylist()), bool, len(texts))
    return letters, *model.decode(model.margins(_texts(texts)))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                letters, best, score, close, chance = _judged(part.column("text"), model)
                names = [model.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array((close | chance) & letters)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row, learned from the training rows of the same table."""
    model = fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def known_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and whose nearest codeword is better than chance. Columns stay as they are; only the text goes
    through Python, and a flag comes back."""

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = []
            for part in steps(pa.RecordBatch.from_arrays([column], ["text"]), "text", STEP):
                letters, *_, chance = _judged(part.column("text"), model)
                found.append(letters & ~chance)
            yield pa.array(np.concatenate([np.zeros(0, bool), *found]))

    @F.arrow_udf("boolean")
    def flags(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(judge)(columns)

    return docs.filter(flags("text"))
