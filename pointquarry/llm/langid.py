"""Languages by the nearest of several centroids per language."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.llm.common import UPPER, staged

#: Bytes of letters stay, A-Z lower-cased; all else in ASCII is a blank.
LETTER_BYTES = bytes(ord(chr(b).lower()) if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: Bytes of a text whose n-grams are counted at once, up to the next blank.
PIECE = 1 << 20


def pieces_of(text: bytes) -> Iterator[np.ndarray]:
    """Sequences of three bytes within and at the edges of words, as numbers, of one piece after another."""
    letters, begin, before = text.translate(LETTER_BYTES), 0, b" "
    while begin < len(letters):
        end = letters.find(b" ", begin + PIECE)
        end = len(letters) if end < 0 else end
        words = letters[begin:end].split()
        begin = end
        if words:
            # A piece begins with the last letter of the one before, and the blank.
            spaced = b" ".join([before + words[0], *words[1:], b""])
            b, before = np.frombuffer(spaced, np.uint8).astype(np.int32), spaced[-2:]
            yield b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def ngram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, sorted, and their counts. There are fewer than 2^24."""
    parts = [np.unique(x, return_counts=True) for x in pieces_of(text)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def vector(text: bytes, grams: np.ndarray, idf: np.ndarray, unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's n-grams among the sorted ``grams``, and their weights in the unit vector of all its
    n-grams: those that the sample has not count for the length."""
    found, counts = ngram_counts(text)
    if not len(found):
        return found, np.zeros(0)
    at = np.minimum(np.searchsorted(grams, found), max(0, len(grams) - 1))
    known = grams[at] == found if len(grams) else np.zeros(len(found), bool)
    w = (1 + np.log(counts)) * np.where(known, idf[at] if len(grams) else 0, unseen)
    return at[known], w[known] / np.sqrt((w * w).sum())


@dataclass
class Centroids:
    """Language names, the sample's n-grams with their inverse document frequencies (``unseen`` for others), a column of
    ``matrix`` per centroid with its language's number, and for each language the cosine below which a text is too far from it."""

    names: list[str]
    grams: np.ndarray
    idf: np.ndarray
    unseen: float
    matrix: np.ndarray
    language: np.ndarray
    floor: np.ndarray


def clustered(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit rows, by k-means under the cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(lang: list[str], grams: list[np.ndarray], counts: list[np.ndarray], k: int, far: float, seed: int) -> Centroids:
    """Centroids of a sample, given the n-grams of each of its texts."""
    known, df = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int32), return_counts=True)
    idf, names = np.log((1 + len(lang)) / (1 + df)) + 1, sorted(set(lang))
    columns, language, floor = [], [], []
    for i, name in enumerate(names):
        texts = [j for j, x in enumerate(lang) if x == name]
        own = np.unique(np.concatenate([grams[j] for j in texts]))
        x, places = np.zeros((len(texts), len(own)), np.float32), np.searchsorted(known, own)
        for row, j in zip(x, texts, strict=True):
            at = np.searchsorted(own, grams[j])
            row[at] = (1 + np.log(counts[j])) * idf[places[at]]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = clustered(x, k, seed)
        wide = np.zeros((len(c), len(known)), np.float32)
        wide[:, places] = c
        columns.append(wide)
        language += [i] * len(c)
        floor.append(float(np.quantile((x @ c.T).max(axis=1), far)) / 2)
    matrix = np.concatenate(columns).T if columns else np.zeros((len(known), 0))
    return Centroids(names, known, idf, math.log(1 + len(lang)) + 1, np.ascontiguousarray(matrix, np.float32), np.array(language, np.int64), np.array(floor))


def sampled_ngrams(sample: DataFrame) -> pa.Table:
    """(lang, draw, grams, counts) of the sample, counted in tasks: the driver gets no text."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                grams, counts = ngram_counts(text.as_buffer().to_pybytes())
                columns = [batch.column("lang").slice(i, 1), batch.column("draw").slice(i, 1)]
                columns += [pa.array([grams], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "draw", "grams", "counts"])

    return sample.select("lang", "draw", "text").mapInArrow(of_task, "lang string, draw long, grams array<int>, counts array<long>").toArrow()


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text, modulo 5, is 0; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify_languages(
    docs: DataFrame,
    centroids: int = 4,
    per_language: int = 400,
    max_sample: int = 4000,
    far: float = 0.01,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Predict the language of each whole text.

    Learnt from a bounded sample of documents with a language that aren't held out:
    ``per_language`` of each language, ``max_sample`` in all, by the smallest hashes of ids. From it
    come the inverse document frequencies of its n-grams, each for itself, and ``centroids`` clustered
    centroids for each language. The n-grams are counted in tasks; the driver gets at most 2^24 of a text.
    Of more than ``max_sample`` languages the most frequent ones are learnt, and no others predicted. Every text is compared with all centroids by cosine and gets
    the language of the nearest. It is ``rejected`` if it is farther than half the
    cosine of the sample's ``far`` quantile; the nearest language is named nevertheless.
    Texts of any length are read whole once more for prediction and not shuffled.

    Returns the id, ``held_out``, ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``.

    Null texts and those without a letter are ``und`` with score 0, as is any text where no
    language could be learnt. Rows are independent and may repeat; an empty table gives an empty one.
    """
    text = F.col(text_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & text.rlike(r"\p{L}") & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("draw"), text.alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_sample).collect()}
    each = max(1, min(per_language, max_sample // max(1, len(sizes))))
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (1.5 * each + 20) / n))]) if sizes else F.lit(None).cast("map<string,double>")
    drawn = known.where(F.pmod("draw", F.lit(1 << 32)) < rate[F.col("lang")] * float(1 << 32))
    best = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
    sample = drawn.withColumn("place", best).where(F.col("place") <= each).select("lang", "draw", "text")
    drawn = sampled_ngrams(staged(sample, "languages")).to_pydict() if sizes else {"lang": [], "draw": [], "grams": [], "counts": []}
    by = sorted(range(len(drawn["lang"])), key=lambda i: (drawn["lang"][i], drawn["draw"][i], drawn["grams"][i], drawn["counts"][i]))
    c = fit([drawn["lang"][i] for i in by], [np.array(drawn["grams"][i], np.int32) for i in by], [np.array(drawn["counts"][i]) for i in by], centroids, far, seed)
    sent = docs.sparkSession.sparkContext.broadcast((c.names, c.grams, c.idf, c.unseen, c.matrix, c.language, c.floor))

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        c = Centroids(*sent.value)

        def of(t: pa.Scalar) -> dict:
            at, w = vector(t.as_buffer().to_pybytes(), c.grams, c.idf, c.unseen) if t.is_valid and c.names else ((), ())
            if not t.is_valid or not c.names:
                return {"lang": "und", "score": 0.0, "rejected": True}
            cosines = w @ c.matrix[at]
            j = int(np.argmax(cosines))
            lang, cos = int(c.language[j]), float(cosines[j])
            return {"lang": c.names[lang], "score": min(1.0, max(0.0, cos)), "rejected": cos < c.floor[lang]}

        return pa.array([of(t) for t in texts], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    # Only texts with a letter are sent.
    lettered = F.when(text.rlike(r"\p{L}"), text)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(lettered).alias("p"))
    return out.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
