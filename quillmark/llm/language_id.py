"""Language ID by hierarchical discrimination.

One-versus-one linear support vector machines first choose a language family,
then others, trained within the family alone, choose the language. Features are
hashed letter bigrams and trigrams of the whole text, square-rooted and
of unit length. Training takes a bounded sample of labelled rows; everything else covers
all rows, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import map_texts

# Families by ISO 639-1 code; a language of no family here is in the family "other".
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "sa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

UNDETERMINED = "und"
BINS = 1 << 12
#: Documents of a language in the training sample at most (drawn by a hash of id and text), and of all languages.
SAMPLE_PER_LANGUAGE = 400
SAMPLE = 12_000
#: Labels that are learned: the commonest, first ones on ties. It bounds the pairs of one family.
MOST_LANGUAGES = 100
EPOCHS = 12
PENALTY = 10.0
#: Steepness of the logistic that turns a margin into a score.
STEEPNESS = 4.0

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def text_features(text: str | None, bins: int = BINS) -> np.ndarray | None:
    """A vector of unit length, or None for a null text or one without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    c = np.where(is_letter, points, np.uint32(32))
    # one space for each run of other characters, and one at either end
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - (bins.bit_length() - 1))
    counts = np.bincount(two * np.uint32(0x165667B1) >> shift, minlength=bins) + np.bincount(three >> shift, minlength=bins)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.float32(np.sqrt(np.dot(x, x)))


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY) -> np.ndarray:
    """Weights (with the intercept last) of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1."""
    rng = np.random.default_rng(0)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    size = np.array([penalty * len(y) / (2 * max(1, (y == s).sum())) for s in y])  # classes weigh alike
    diagonal = (x * x).sum(1) + 0.5 / size
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = max(0.0, alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / size[i]) / diagonal[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


@dataclass(frozen=True)
class OneVersusOne:
    """Classes and a weight vector for each pair of them."""

    classes: tuple[str, ...]
    weights: np.ndarray  # (pairs, features + 1)

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        classes = tuple(sorted(set(labels)))
        rows = []
        for a, b in combinations(classes, 2):
            at = (labels == a) | (labels == b)
            rows.append(train_svm(x[at], np.where(labels[at] == a, 1.0, -1.0)))
        return OneVersusOne(classes, np.array(rows, np.float32).reshape(len(rows), x.shape[1] + 1))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class (by votes, then margins, then order) and its least pairwise score, for each row."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        # one product a row: a matrix product's last digits would depend on the rows beside it
        margins = np.array([[w[:-1] @ row + w[-1] for w in self.weights] for row in x])
        votes, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for p, (a, b) in enumerate(combinations(range(n), 2)):
            m = margins[:, p].astype(np.float64)
            for c, own in ((a, m), (b, -m)):
                votes[:, c] += (own > 0) if c == a else (own >= 0)
                sums[:, c] += np.tanh(own)
                least[:, c] = np.minimum(least[:, c], own)
        best = np.argmax(votes + sums / (2 * n), axis=1)
        return best, 1 / (1 + np.exp(-STEEPNESS * least[np.arange(len(x)), best]))


@dataclass(frozen=True)
class Model:
    """A family classifier, and one for each family's languages."""

    families: OneVersusOne | None
    languages: dict[str, OneVersusOne]
    bins: int = BINS

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Model:
        if not len(labels):
            return Model(None, {})
        family = np.array([FAMILY_OF.get(code, "other") for code in labels])
        return Model(OneVersusOne.fit(x, family), {f: OneVersusOne.fit(x[family == f], labels[family == f]) for f in set(family)}, x.shape[1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self.families is None:
            return found, scores
        for first in range(0, len(texts), 512):  # bounds memory
            rows = [(i, v) for i in range(first, min(first + 512, len(texts))) if (v := text_features(texts[i], self.bins)) is not None]
            if not rows:
                continue
            at, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
            family, sure = self.families.choose(x)
            for f, name in enumerate(self.families.classes):
                mine = family == f
                if mine.any():
                    language, own = self.languages[name].choose(x[mine])
                    for i, c, s in zip(at[mine], language, own * sure[mine], strict=True):
                        found[i], scores[i] = self.languages[name].classes[c], float(s)
        return found, scores


def held_out(key: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, bins: int = BINS, most_languages: int = MOST_LANGUAGES, sample_rows: int = SAMPLE) -> Model:
    """Learns from at most ``per_language`` documents of each language among those that are not held out.

    Of more labels than ``most_languages`` the commonest are learned; where they would have more
    than ``sample_rows`` documents together, each has fewer. Rows are drawn by a hash of id and
    text, and equal rows count once, so the sample is bounded however many rows share an
    id. Features are made on the executors; the driver gets ``bins`` numbers a
    document of the sample.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    commonest = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in commonest.collect()}
    if not counts:
        return Model(None, {}, bins)
    per_language = max(1, min(per_language, sample_rows // len(counts)))
    scale = 1 << 30
    chance = F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, min(scale, round(scale * 1.2 * per_language / n)))))
    drawn = F.pmod(F.xxhash64(F.lit(7), "key", "text"), F.lit(scale))
    sample = labelled.withColumn("drawn", drawn).where(F.col("drawn") < chance[F.col("lang")]).dropDuplicates(["lang", "drawn"])

    def work():
        def do(texts):
            rows = [text_features(t, bins) for t in texts]
            at = [None if v is None else np.flatnonzero(v).astype(np.int32) for v in rows]
            return [at, [None if v is None else v[i] for v, i in zip(rows, at, strict=True)]]

        return do

    got = map_texts(sample, work, "at array<int>, values array<float>", keep=["key", "lang", "drawn"]).where("at is not null")
    rows = sorted(got.toArrow().to_pylist(), key=lambda r: (r["lang"], r["drawn"]))
    kept = [r for i, r in enumerate(rows) if i < per_language or rows[i - per_language]["lang"] != r["lang"]]
    x = np.zeros((len(kept), bins), np.float32)
    for i, r in enumerate(kept):
        x[i, r["at"]] = r["values"]
    return Model.fit(x, np.array([r["lang"] for r in kept], object))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), or columns of other ``names``, replaced if there.

    ``und`` with score 0 for a null text or one without a letter, and for every
    text where nothing was labelled. Equal texts get equal answers. Only the
    text decides. The model is a few weight vectors of fixed length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda: lambda texts: list(shared.value.predict(texts)), f"{names[0]} string, {names[1]} double", text=text, keep=keep)
