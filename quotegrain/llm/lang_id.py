"""Language identification with string kernels: blended-spectrum presence kernels, Nyström landmarks, kernel ridge.

A text's spectrum is the set of its character n-grams, n from 1 to 3 together, hashed to ``DIMS`` features. The kernel
of two texts is the number of shared features over the geometric mean of their sizes. Landmark texts give the Nyström
map; on it, one-versus-rest ridge regression has a closed form. Scoring is a product of two matrices per batch of
texts: presence by landmark, then landmark by language. There is no shuffle at prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

DIMS = 1 << 15
ORDERS = 3
#: The classifier is fitted on at most so many labelled texts per language, those of least hashed id...
PER_LANGUAGE = 400
#: ... and of these the first of each language, so many in all, are landmarks.
LANDMARKS = 128
RIDGE = 1e-3
#: Sharpness of the score: softmax of ridge outputs times this.
SHARPNESS = 6.0
_BATCH = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h & np.uint32(DIMS - 1)


def mark(text: str, row: np.ndarray) -> None:
    """Sets the features of a whole text in ``row``; runs of white space count as one space, case does not count."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, len(text), 1 << 18):
        codes = np.frombuffer(text[at : at + (1 << 18) + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = codes * np.uint32(0x9E3779B1)
        row[_mixed(h)] = 1
        for n in range(1, ORDERS):
            if len(codes) <= n:
                break
            h = (h[:-1] ^ np.uint32(n)) * np.uint32(0x85EBCA77) + codes[n:] * np.uint32(0xC2B2AE3D)
            row[_mixed(h)] = 1


def has_letter(text: str | None) -> bool:
    """A letter in Unicode's sense: marks, digits, fractions and circled numbers are none."""
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    languages: list[str]
    features: np.ndarray  # those that any landmark has
    landmarks: np.ndarray  # features x landmarks, columns scaled to unit length
    weights: np.ndarray  # landmarks x languages, Nyström map and ridge in one

    def scores(self, presence: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(presence.sum(1), 1))
        kernel = (presence[:, self.features] @ self.landmarks) / sizes[:, None]
        return kernel @ self.weights


def _presence(spectra: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(spectra), DIMS), np.float32)
    for row, on in zip(out, spectra, strict=True):
        row[on] = 1
    return out


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``rows``: language and distinct feature numbers, in a fixed order. Only landmarks and one batch of rows are
    held as dense rows at a time."""
    languages = sorted({lang for lang, _ in rows})
    spectra = [on for _, on in rows]
    sizes = np.sqrt(np.array([max(len(on), 1) for on in spectra], np.float32))[:, None]
    by_lang = [[i for i, (lang, _) in enumerate(rows) if lang == x] for x in languages]
    chosen = [group[k] for k in range(max(map(len, by_lang), default=0)) for group in by_lang if k < len(group)][: max(landmarks, len(languages))]
    dense = _presence([spectra[i] for i in chosen])
    features = np.flatnonzero(dense.any(0))
    marks = np.ascontiguousarray((dense[:, features] / sizes[chosen]).T)
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([_presence(spectra[at : at + _BATCH])[:, features] @ marks for at in range(0, len(rows), _BATCH)]) / sizes
    phi = kernel.astype(np.float64) @ nystrom
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    # each language weighs the same, however many texts it has
    count = np.array([len(by_lang[languages.index(lang)]) for lang, _ in rows], float)
    scaled = phi / count[:, None]
    beta = np.linalg.solve(phi.T @ scaled + ridge * np.eye(phi.shape[1]), scaled.T @ target)
    return Model(languages, features, marks.astype(np.float32), (nystrom @ beta).astype(np.float32))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fits on texts with a letter and a language; None if there is none. What reaches the driver is bounded:
    ``per_language`` rows of at most ``DIMS`` feature numbers for each language, those of least hashed id and text.
    Rows with one id and different texts count each; repeated rows of one id, text and language count once."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    named = named.withColumn("key", F.xxhash64("text"))
    # repeated rows share a rank, so as many different ones as asked for are ranked
    ranked = named.select("doc_id", "lang", "key").withColumn("k", F.dense_rank().over(order))
    chosen = ranked.where(F.col("k") <= per_language).distinct()

    def spectra(batches):
        for batch in batches:
            kept, on = [], []
            for i, text in enumerate(batch.column(0)):
                text = text.as_py()
                if has_letter(text):
                    row = np.zeros(DIMS, bool)
                    mark(text, row)
                    kept.append(i)
                    on.append(np.flatnonzero(row).astype("<i4").tobytes())
            some = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(on, pa.binary())], ["lang", "k", "features"])

    met = named.join(F.broadcast(chosen), ["doc_id", "lang", "key"])
    once = met.groupBy("lang", "k").agg(F.min("text").alias("text"))
    rows = once.select("text", "lang", "k").mapInArrow(spectra, "lang string, k int, features binary")
    found = sorted((r.lang, r.k, bytes(r.features)) for r in rows.toLocalIterator())
    return fit([(lang, np.frombuffer(on, "<i4")) for lang, _, on in found], landmarks) if found else None


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``df`` with lang_pred and score (0 to 1) after it.

    A null text, or one without a letter, is ``und`` with score 0, as is any text if there is no model. Columns that
    are named lang_pred or score already are replaced. Rows with the same id are predicted each; an empty table gives
    an empty result. The whole text counts.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = kept.index(text_col)

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in range(0, batch.num_rows, _BATCH):
                some = batch.slice(part, _BATCH)
                texts = some.column(at).to_pylist()
                named = np.array([m is not None and has_letter(t) for t in texts], bool)
                langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
                if named.any():
                    presence = np.zeros((len(texts), DIMS), np.float32)
                    for i in np.flatnonzero(named):
                        mark(texts[i], presence[i])
                    out = m.scores(presence[named]).astype(np.float64) * SHARPNESS
                    out = np.exp(out - out.max(1, keepdims=True))
                    out /= out.sum(1, keepdims=True)
                    langs[named] = np.array(m.languages, object)[out.argmax(1)]
                    scores[named] = out.max(1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(langs, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*(F.col(f"`{c}`") for c in kept)).dtypes)
    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
