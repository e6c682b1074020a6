"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word stems is counted over all labelled training documents: terms that toxic
documents use far more often than others.  Every document then has a dense vector: lexicon densities
(plain, and found only after undoing look-alike characters), how near lexicon words stand to words of
address, capitals, shouting, punctuation, stretched and obfuscated words.  Trees are fitted on a
bounded sample of labelled rows and calibrated on a fold that neither they nor the lexicon saw.

Rows of a fold are told by crc32(doc_id as text) mod 5: 0 is held out, 1 calibrates, 2 to 4 train.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, small_side
from routelens.llm.trees import Boosted, fit_boosted, isotonic
from routelens.session import materialize

#: Bounds of the model: labelled rows the trees are fitted on, terms of the lexicon, candidates counted.
MAX_TRAIN_ROWS = 100_000
LEXICON_TERMS = 2_000
CANDIDATES = 20_000
STEMS = (4, 5, 6, 7, 8)
#: A term of the lexicon occurs in this share of the toxic training documents at least.
LEAST_SHARE = 0.01

# Words of address in English, German, French and Spanish; look-alike characters.
ADDRESS = frozenset("""you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous
votre vos tú ti usted ustedes vosotros tus su""".split())
LOOKALIKE = str.maketrans("013457@$!*+", "oieastasiit")
MASKED = re.compile(r"[013457@$!*+]|(.)\1\1", re.DOTALL)
EDGES = ".,;:!?\"'()[]{}<>|-_/\\«»¿¡…*#$%&@+="

HIT, MILD, UNMASKED, YOU, SHOUT, ODD, LOUD, STRETCHED = (1 << i for i in range(8))


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


def unmasked(word: str) -> str:
    """``word`` with look-alikes as letters and stretches of a letter shortened; itself if nothing is odd."""
    if not MASKED.search(word):
        return word
    plain = word.translate(LOOKALIKE)
    return "".join(c for i, c in enumerate(plain) if i < 2 or not c == plain[i - 1] == plain[i - 2])


def terms_of(word: str) -> tuple[str, ...]:
    """The word itself and its stems (a star after the first letters)."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


class Codes(dict):
    """Flags of a word as it is written, worked out once per spelling while it is in use: of two generations
    of at most ``limit`` spellings each, the older one goes when the younger is full."""

    def __init__(self, strong: frozenset, mild: frozenset, limit: int = 250_000):
        super().__init__()
        self.terms = {**dict.fromkeys(mild, MILD), **dict.fromkeys(strong, HIT)}
        self.older: dict[str, int] = {}
        self.limit = limit

    def listed(self, word: str) -> int:
        """HIT if the word or one of its stems is a strong term, else MILD if one is a mild term, else 0."""
        found, n = self.terms.get(word, 0), len(word)
        for stem in STEMS:
            if n <= stem or found & HIT:
                break
            found |= self.terms.get(word[:stem] + "*", 0)
        return HIT if found & HIT else found

    def __missing__(self, word: str) -> int:
        code = self.older.get(word)
        if code is None:
            code = self.flags(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = code
        return code

    def flags(self, word: str) -> int:
        code, low = 0, bare(word)
        letters = low.isalpha()
        if low:
            code |= self.listed(low)
            if low in ADDRESS:
                code |= YOU
            plain = unmasked(low)
            if plain != low:
                if not code & HIT and self.listed(plain) & HIT:
                    code |= HIT | UNMASKED
                if letters:
                    code |= STRETCHED
        if len(low) > 2 and word.isupper():
            code |= SHOUT
        if low and not letters and any(c.isalpha() for c in low) and not low.isalnum() or \
                low[:1].isalpha() and any(c.isdigit() for c in low):
            code |= ODD
        if word[-1:] == "!":
            code |= LOUD
        return code


FEATURES = ("log_words", "hits", "mild", "log_hits", "log_mild", "unmasked", "densest", "you", "you_near", "you_gap",
            "shout", "odd", "loud", "stretched", "upper", "digits", "marks", "bangs", "queries", "letters")


def features(text: str | None, codes: Codes) -> list[float]:
    """The dense vector of a whole text; an empty text has all zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.frombuffer(bytes(map(codes.__getitem__, words)), dtype=np.uint8)
    share = [int(np.count_nonzero(c & flag)) for flag in (HIT, MILD, UNMASKED, YOU, SHOUT, ODD, LOUD, STRETCHED)]
    hits = np.flatnonzero(c & HIT)
    densest = near = gap = 0.0
    if len(hits):
        densest = float((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max())
        you = np.flatnonzero(c & YOU)
        if len(you):
            at = np.searchsorted(you, hits)
            apart = np.minimum(np.abs(hits - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hits))
            near, gap = float((apart <= 5).mean()), 1.0 / (1.0 + float(apart.min()))
    raw = text.encode()
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / len(raw)
    upper, digits, marks = by[65:91].sum(), by[48:58].sum(), by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    return [np.log1p(n), share[0] / n, share[1] / n, np.log1p(share[0]), np.log1p(share[1]), share[2] / n, densest,
            share[3] / n, near, gap, share[4] / n, share[5] / n, share[6] / n, share[7] / n, float(upper), float(digits),
            float(marks), float(by[33]), float(by[63]), len(raw) / n]


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, y and fold of the labelled documents that are not held out.  A doc_id labelled
    twice is 1 if any of its labels is; null labels and ids are no labels."""
    y = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
         .groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
         .withColumn("fold", fold_of(F.col("__id"))).where("fold <> 0"))
    y = small_side(materialize(y, "labels"), 24)
    return bounded_batches(docs).select("doc_id", "text").join(y, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y", "fold")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of this task with the term."""
    seen: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            words = {bare(w) for w in (t.as_py() or "").split()}
            seen.update({term for w in words if w for term in terms_of(w)})
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["term", "n"])


def _count_known(known: frozenset):
    """(term, n) of the ``known`` terms only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Found(dict):
            def __missing__(self, word: str) -> tuple[str, ...]:
                if len(self) > 100_000:
                    self.clear()
                got = self[word] = tuple(t for t in terms_of(bare(word)) if t in known)
                return got

        seen, found = Counter(), Found()
        for batch in batches:
            for t in batch.column(0):
                got = set().union(*map(found.__getitem__, set((t.as_py() or "").split())))
                seen.update(got)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
    return run


def _sketch(texts: pd.Series) -> pd.Series:
    """The smallest hashes of a text's word pairs in each of eight classes, which copies share, near copies
    mostly, and different texts hardly ever; the lower-cased words themselves if a class has no pair."""
    def low(t: str | None) -> str:
        words = (t or "").lower().encode().split()
        least: dict[int, int] = {}
        for a, b in zip(words, words[1:], strict=False):
            h = zlib.crc32(a + b" " + b)
            least[h & 7] = min(h, least.get(h & 7, h))
        if len(least) < 8:
            return "=" + hashlib.md5(b" ".join(words)).hexdigest()
        return ",".join(str(least[i]) for i in range(8))
    return texts.map(low).astype(object)


def learn_lexicon(train: DataFrame) -> tuple[frozenset, frozenset]:
    """Strong and mild terms by document counts over all of ``train`` (text, y).  Of toxic texts with
    one sketch, one counts, so that (near) copies don't make their words a lexicon.  A stem must occur
    in clearly more documents than any single word that has it."""
    toxic = materialize(train.where("y = 1").select("text").withColumn("sketch", F.pandas_udf(_sketch, "string")("text"))
                        .groupBy("sketch").agg(F.min("text").alias("text")).select("text"), "lexicon-toxic")
    sizes = {1: toxic.count(), 0: train.where("y = 0").count()}
    counted = materialize(toxic.mapInArrow(_count_terms, "term string, n long")
                          .groupBy("term").agg(F.sum("n").alias("toxic_docs")), "lexicon-terms")
    least = max(3, int(LEAST_SHARE * sizes[1]))
    top = (counted.where(F.col("toxic_docs") >= least).orderBy(F.desc("toxic_docs"), "term").limit(CANDIDATES).collect())
    known = {r["term"]: r["toxic_docs"] for r in top}
    clean = {r["term"]: r["n"] for r in train.where("y = 0").select("text")
             .mapInArrow(_count_known(frozenset(known)), "term string, n long")
             .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    word_docs: dict[str, int] = {}
    for t, k in known.items():
        if not t.endswith("*"):
            for stem in terms_of(t)[1:]:
                word_docs[stem] = max(word_docs.get(stem, 0), k)
    known = {t: k for t, k in known.items() if not t.endswith("*") or k > 1.3 * word_docs.get(t, 0)}
    n1, n0 = max(1, sizes[1]), max(1, sizes[0])
    odds = {t: np.log((k + 0.5) / n1) - np.log((clean.get(t, 0) + 0.5) / n0) for t, k in known.items()}
    best = sorted(odds, key=lambda t: (-odds[t] * np.sqrt(known[t]), t))[:LEXICON_TERMS]
    return frozenset(t for t in best if odds[t] > 3.0), frozenset(t for t in best if 1.5 < odds[t] <= 3.0)


@dataclass
class ToxicityModel:
    """Scores whole texts; small enough (a few hundred kB) to travel inside a task."""
    strong: frozenset = frozenset()
    mild: frozenset = frozenset()
    trees: Boosted | None = None
    knots: tuple = ((0.0,), (0.0,))
    prior: float = 0.0
    _codes: Codes | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_codes": None}

    def vectors(self, texts) -> np.ndarray:
        if self._codes is None:
            self._codes = Codes(self.strong, self.mild)
        return np.array([features(t, self._codes) for t in texts], dtype=float).reshape(-1, len(FEATURES))

    def scores(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.trees.margin(self.vectors(texts)), *self.knots)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """The model of ``label`` from the labelled rows that are not held out.  Lexicon counts cover all of
    them; trees and calibration see at most about ``max_rows``, chosen by a hash of the doc_id.
    Without labels of both classes every score is the share of ones (0 without any)."""
    rows = labelled(docs, labels, label)
    counts = {(r["y"], r["fold"]): r["n"] for r in
              rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, ones = sum(counts.values()), sum(n for (y, _), n in counts.items() if y)
    if not 0 < ones < total:
        return ToxicityModel(prior=ones / total if total else 0.0)
    strong, mild = learn_lexicon(rows.where("fold <> 1"))
    model = ToxicityModel(strong, mild)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.vectors(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())),
                 b.column(1), b.column(2), b.column(3)], ["x", "y", "fold", "doc_id"])

    share = int(min(1.0, max_rows / total) * (1 << 20))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("text", "y", "fold", "doc_id")
    got = sample.mapInArrow(run, "x array<double>, y int, fold long, doc_id long").toPandas().sort_values("doc_id")
    x, y, fold = np.stack(got["x"].to_list()), got["y"].to_numpy(float), got["fold"].to_numpy()
    train, held = fold != 1, fold == 1
    if not 0 < y[train].sum() < train.sum():
        train = np.ones(len(y), dtype=bool)
    model.trees = fit_boosted(x[train], y[train])
    if not 0 < y[held].sum() < held.sum():
        held = np.ones(len(y), dtype=bool)
    model.knots = isotonic(model.trees.margin(x[held]), y[held])
    return model


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    """The calibrated score of a text column."""
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.scores(t.to_list()))

    return score(F.col(text))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any other columns) that score below ``threshold``."""
    model = fit(docs, labels)
    return docs.where(score_column(model) < threshold)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null text scores as empty, a null doc_id is
    not held out."""
    model = fit(docs, labels)
    return (docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                        score_column(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
