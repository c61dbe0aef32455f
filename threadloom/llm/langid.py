"""Language ID by hierarchical discrimination: family first, then one-versus-one linear SVMs within the family.

Texts become L2-normalised counts of hashed byte 1- to 3-grams of the lower-cased text. One-versus-one linear support
vector machines, trained by dual coordinate descent, vote for the family; those between the family's languages then
vote for the language. Training takes a bounded sample of labelled rows; prediction is a narrow pass over all rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import unused

# Language families of ISO 639-1 codes; other labels form the family "other".
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

UND = "und"
DIMS = 1 << 13
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], "other")


def features(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-gram counts over the whole text's lower-cased UTF-8 bytes, square-rooted and L2-normalised."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    one = b * np.uint32(2654435761)
    two = (b[:-1] * np.uint32(65599) + b[1:]) * np.uint32(2246822519)
    three = ((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]) * np.uint32(3266489917)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.bincount(three >> shift, minlength=DIMS).astype(np.float32)
    counts += np.bincount(two >> shift, minlength=DIMS)
    counts += np.bincount(one >> shift, minlength=DIMS)
    np.sqrt(counts, out=counts)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of what is not zero."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16), x[at]


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 8.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent with a bias feature, on sparse rows; y holds -1 and 1. Fixed order."""
    n = len(y)
    w, bias, alpha = np.zeros(DIMS, dtype=np.float64), 0.0, np.zeros(n)
    norms = [float(np.dot(v, v)) + 1.0 for _, v in rows]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n).tolist():
            at, value = rows[i]
            slope = y[i] * (float(np.dot(w[at], value)) + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if (step := new - alpha[i]) != 0.0:
                w[at] += step * y[i] * value
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w.astype(np.float32), float(bias)


@dataclass
class Duel:
    """One-versus-one machines over a set of classes; the most votes win, then the larger sum of margins."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), dtype=np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray) -> Duel:
        machines = []
        for a, b in itertools.combinations(self.classes, 2):
            rows = np.flatnonzero((names == a) | (names == b))
            machines.append(fit_svm([x[i] for i in rows.tolist()], np.where(names[rows] == a, 1.0, -1.0)))
        if machines:
            self.weights = np.stack([w for w, _ in machines])
            self.biases = np.array([b for _, b in machines])
        return self

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The winning class and a likelihood in (0, 1]: the product of its pairwise logistic scores."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights @ x + self.biases
        votes = {c: [0, 0.0, 1.0] for c in self.classes}
        for (a, b), m in zip(itertools.combinations(self.classes, 2), margins, strict=True):
            won, lost = (a, b) if m >= 0 else (b, a)
            votes[won][0] += 1
            for c, signed in ((won, abs(m)), (lost, -abs(m))):
                votes[c][1] += signed
                votes[c][2] *= 1.0 / (1.0 + np.exp(-2.0 * signed))
        best = max(self.classes, key=lambda c: (votes[c][0], votes[c][1]))
        return best, float(votes[best][2])


@dataclass
class Model:
    families: Duel
    within: dict[str, Duel]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families.classes or not _LETTER.search(text):
            return UND, 0.0
        x = features(text)
        family, p = self.families.predict(x)
        lang, q = self.within[family].predict(x)
        return lang, p * q


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """The model of sparse feature rows and their languages."""
    if not rows:
        return Model(Duel([]), {})
    names = np.array(langs, dtype=object)
    fams = np.array([family_of(lang) for lang in langs], dtype=object)
    within = {f: Duel(sorted(set(names[fams == f]))).fit(rows, np.where(fams == f, names, "")) for f in sorted(set(fams))}
    return Model(Duel(sorted(within)).fit(rows, fams), within)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str, classes: int | None = None) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, places, values) of at most per_language labelled texts with a letter of each language, by the smallest
    id hashes. Features are made in the executors: what comes to the driver is bounded by DIMS a text, however long.
    classes bounds the languages, the most frequent first; None takes them all."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col)
    counts = (counts if classes is None else counts.limit(classes)).collect()
    spread = 1 << 30
    share = None
    for lang, count in counts:
        limit = spread if count <= per_language else int(spread * min(1.0, 1.3 * per_language / count))
        rule = F.when(F.col(lang_col) == lang, F.lit(limit))
        share = rule if share is None else share.when(F.col(lang_col) == lang, F.lit(limit))
    if share is None:
        return []

    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            made = [sparse(features(t)) if _LETTER.search(t) else (np.zeros(0, np.uint16), np.zeros(0, np.float32)) for t in part]
            yield pd.Series([at.tobytes() + value.astype(np.float32).tobytes() for at, value in made], dtype=object)

    order = F.pmod(F.xxhash64(id_col, text_col), F.lit(spread))
    some = rows.where(order < share).select(order.alias("o"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.pandas_udf(make, "binary")(F.col(text_col)).alias("x"))
    out = []
    for lang, group in itertools.groupby(sorted(some.collect(), key=lambda r: (r.lang, r.o, r.h)), key=lambda r: r.lang):
        for r in itertools.islice(group, per_language):
            n = len(r.x) // 6
            if n:
                out.append((lang, np.frombuffer(r.x, dtype=np.uint16, count=n), np.frombuffer(bytes(r.x[2 * n :]), dtype=np.float32)))
    return out


def identify(
    docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: str | None = None,
    classes: int | None = None,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, by a model fitted on rows that are not held out.

    per_language bounds the labelled texts taken of each language for training (documented sample bound), classes the
    number of languages (none by default); everything is predicted, from whole texts. Null texts and texts without a letter
    (Unicode's category L; digits such as ½ or ① are none) are `und` with score 0; without labelled rows all are `und`.
    Null and repeated ids are kept as rows; an empty table gives no rows; other columns are dropped. With keep, docs' own
    columns come back with a struct of that name (lang_pred, score) instead.
    """
    sample = training_rows(docs, per_language, id_col, text_col, lang_col, classes)
    model = docs.sparkSession.sparkContext.broadcast(fit([(at, value) for _, at, value in sample], [lang for lang, _, _ in sample]))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([model.value.predict(t) for t in part], columns=["lang_pred", "score"])

    predicted = F.pandas_udf(predict, "lang_pred string, score double")
    if keep:  # as nondeterministic, so that a filter on the result does not predict a second time
        return docs.withColumn(keep, predicted.asNondeterministic()(F.col(text_col)))
    named = predicted(F.col("text"))
    return rows.withColumn("_p", named).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kwargs) -> DataFrame:
    """The rows whose text is in a language, with lang set to the one identified. Rows that are `und` go."""
    (found,) = unused(docs, "_p")
    named = identify(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, keep=found, **kwargs)
    return named.where(F.col(f"{found}.lang_pred") != UND).withColumn(lang_col, F.col(f"{found}.lang_pred")).drop(found)
