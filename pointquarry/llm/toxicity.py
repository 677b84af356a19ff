"""Toxicity by the nearest labelled examples under TF-IDF cosine."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import plain, staged
from pointquarry.llm.decontam import words_of

#: Bytes of the beginnings of words that are terms beside the words themselves, where the word goes on; whole letters only.
STEMS = (6,)
#: Words of which a task remembers the terms, and documents that are scored at once.
REMEMBERED, BATCH = 1 << 18, 128
#: Documents of the labelled sample that are added, at the overall rates, to those seen with a term.
SMOOTHING = 5.0

#: The place of a word that no example has, and of a beginning that no example has or that is the word.
UNSEEN, NONE = -1, -2

#: Terms and weights of a vector; and of several queries their number and, sorted by query, the query, term and weight of each entry.
Vector = tuple[np.ndarray, np.ndarray]
Queries = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def term_hashes(word: bytes) -> tuple[int, ...]:
    """A hash of the word and of each of its beginnings."""
    return (xxhash.xxh64_intdigest(word, 0), *(xxhash.xxh64_intdigest(stem_of(word, n), n) for n in STEMS if len(word) > n))


def stem_of(word: bytes, n: int) -> bytes:
    """The first ``n`` bytes, less those of a letter that goes on behind them."""
    while n and word[n] & 0xC0 == 0x80:
        n -= 1
    return word[:n]


class Remembered(dict):
    """The terms of a word, computed when it is first seen."""

    def __init__(self, of_word: Callable[[bytes], tuple[int, ...]]):
        super().__init__()
        self.of_word = of_word

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = self.of_word(word)
        return found


class Numbered(dict):
    """A number for each word, given when it is first seen; ``places`` has by number the places of the word and its beginnings among the hashes ``vocabulary``."""

    def __init__(self, vocabulary: np.ndarray):
        super().__init__()
        self.place = {h: i for i, h in enumerate(vocabulary.tolist())}
        self.places = np.empty((1 << 12, 1 + len(STEMS)), np.int64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.places):
            self.places = np.concatenate([self.places, np.empty_like(self.places)])
        whole, *stems = term_hashes(word)
        self.places[n] = (self.place.get(whole, UNSEEN), *(self.place.get(h, NONE) for h in stems), *[NONE] * (len(STEMS) - len(stems)))
        return n

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number, count) of the distinct words of whole texts, sorted."""
        if len(self) > REMEMBERED:
            self.clear()
        words = [words_of(t.as_buffer().to_pybytes()) if t.is_valid else [] for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, lengths.sum())
        distinct, n = np.unique(np.repeat(np.arange(len(words)), lengths) * len(self) + number, return_counts=True)
        return *np.divmod(distinct, max(1, len(self))), n


def counted(text: pa.Scalar, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of a whole text, sorted, and how often each stands there."""
    words = Counter(words_of(text.as_buffer().to_pybytes())) if text.is_valid else {}
    found = [known[w] for w in words]
    terms = np.fromiter(chain.from_iterable(found), np.uint64)
    n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, found), np.int64, len(found)))
    distinct, place = np.unique(terms, return_inverse=True)
    return distinct, np.bincount(place, n, len(distinct))


def asked(texts: pa.Array, known: Numbered, factor: np.ndarray, unseen: float) -> Queries:
    """The unit vectors of whole texts, without the words that have no place: each of these has the weight ``unseen`` times 1 + log of its count."""
    doc, number, n = known.counts(texts)
    places = known.places[number]
    alone = places[:, 0] == UNSEEN
    length = np.bincount(doc[alone], (unseen * (1 + np.log(n[alone]))) ** 2, len(texts))
    held = places >= 0
    width = max(1, len(factor))
    terms, at = np.unique(np.repeat(doc, held.sum(axis=1)) * width + places[held], return_inverse=True)
    doc, term = np.divmod(terms, width)
    weight = (1 + np.log(np.bincount(at, np.repeat(n, held.sum(axis=1)), len(terms)))) * factor[term]
    length = length + np.bincount(doc, weight * weight, len(texts))
    return len(texts), doc, term, weight / np.sqrt(length[doc])


def together(vectors: list[Vector]) -> Queries:
    """Vectors as queries."""
    doc = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    return len(vectors), doc, np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])


def spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, one range after another, and the number of each one's range."""
    n = ends - begins
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begins[which], which


class BlockMaxIndex:
    """Postings of normalised example vectors by term and block of examples, with the
    largest weight of each term in each block.

    Terms of a sixteenth of the examples or more have one posting for every example (a dense row), and their part of all cosines
    comes from one product. A block's bound is the largest such part in it and the query times the largest weights of the other terms. A
    query first visits the ``FIRST`` blocks of the largest bounds, and then each block whose
    bound reaches its k-th cosine there; no other block can hold one of the k nearest, so they are exact.
    """

    FIRST = 4

    def __init__(self, vectors: list[Vector], terms: int, block: int = 64):
        n = self.n = len(vectors)
        lengths = np.array([len(v[0]) for v in vectors], np.int64)
        term = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if n else np.zeros(0)
        example = np.repeat(np.arange(n), lengths)
        seen = np.bincount(term, minlength=terms)
        common = np.flatnonzero(seen >= max(2, n / 16))
        # Examples with the same heaviest common term, and of like weights of it, share blocks: their bounds are near their cosines.
        heavy = np.where(np.isin(term, common), weight, 0)
        by = np.lexsort((heavy, example))
        last = np.cumsum(lengths)[lengths > 0] - 1
        lead, top = np.zeros(n, np.int64), np.zeros(n)
        lead[example[by][last]], top[example[by][last]] = term[by][last], heavy[by][last]
        self.order = np.lexsort((np.arange(n), top, lead))
        at = np.empty(n, np.int64)
        at[self.order] = np.arange(n)
        place = at[example]
        self.block, self.blocks = block, -(-n // block)
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.dense = np.zeros((len(common), self.blocks * block))
        self.dense[self.row[term[dense]], place[dense]] = weight[dense]
        term, place, weight = term[~dense], place[~dense], weight[~dense]
        by = np.lexsort((place, term))
        term, self.place, self.weight = term[by], place[by], weight[by]
        cell = term * max(1, self.blocks) + self.place // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_end = np.append(first, len(cell))
        self.cell_block = self.place[first] // block
        self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_end = np.searchsorted(term[first], np.arange(terms + 1))

    def cosines(self, queries: Queries | list[Vector], k: int, without: np.ndarray | None = None) -> np.ndarray:
        """A row of cosines for each query, in the index's order of examples: of its k nearest, all
        that tie with the k-th, and perhaps more; the others are zero. ``without`` names an example that each query leaves out."""
        q, doc, term, weight = together(queries) if isinstance(queries, list) else queries
        blocks, block = self.blocks, self.block
        if not self.n:
            return np.zeros((q, 0))
        row = self.row[term]
        often, rare = row >= 0, row < 0
        ask = np.zeros((q, len(self.dense)))
        ask[doc[often], row[often]] = weight[often]
        scores = ask @ self.dense
        doc, term, weight = doc[rare], term[rare], weight[rare]
        cell, which = spread(self.term_end[term], self.term_end[term + 1])
        doc, weight = doc[which], weight[which]
        of_block = doc * blocks + self.cell_block[cell]
        bounds = scores.reshape(q, blocks, block).max(axis=2) + np.bincount(of_block, weight * self.cell_most[cell], q * blocks).reshape(q, blocks)
        left_out = None if without is None else (np.arange(q), np.argsort(self.order)[without])

        def visit(go: np.ndarray) -> None:
            kept = np.flatnonzero(go.ravel()[of_block])
            at, of = spread(self.cell_end[cell[kept]], self.cell_end[cell[kept] + 1])
            to = (doc[kept] * scores.shape[1])[of] + self.place[at]
            scores.ravel()[:] += np.bincount(to, weight[kept][of] * self.weight[at], scores.size)
            if left_out:
                scores[left_out] = 0

        first = np.zeros((q, blocks), bool)
        best = np.argpartition(-bounds, min(self.FIRST, blocks) - 1, axis=1)[:, : self.FIRST]
        np.put_along_axis(first, best, True, axis=1)
        visit(first)
        kth = self.kth(np.take_along_axis(scores.reshape(q, blocks, block), best[:, :, None], axis=1).reshape(q, -1), k)
        rest = (bounds >= kth[:, None] - 1e-9) & (bounds > 0) & ~first
        visit(rest)
        scores.reshape(q, blocks, block)[~(first | rest)] = 0
        return scores[:, : self.n]

    @staticmethod
    def kth(scores: np.ndarray, k: int) -> np.ndarray:
        k = min(k, scores.shape[1])
        return np.partition(scores, -k, axis=1)[:, -k] if k else np.zeros(len(scores))


class Votes:
    """Shares of toxic examples among the nearest ones, weighted by distance, and the evidence."""

    def __init__(self, vectors: list[Vector], toxic: np.ndarray, names: list[str], terms: int, prior: float, k: int):
        self.index, self.k, self.prior = BlockMaxIndex(vectors, terms), k, prior
        self.toxic = toxic[self.index.order] if len(toxic) else toxic
        self.names = [names[i] for i in self.index.order]

    def of(self, queries: Queries, without: np.ndarray | None = None, evidence: bool = True) -> tuple[np.ndarray, list[list[str]]]:
        """The k nearest vote, with all that tie with the k-th, by 1 / (1.05 - cosine); the prior has one vote of weight 1."""
        if not self.index.n:
            return np.full(queries[0], self.prior), [[] for _ in range(queries[0])]
        cos = np.round(np.minimum(self.index.cosines(queries, self.k, without), 1.0), 12)
        near = (cos >= self.index.kth(cos, self.k)[:, None]) & (cos > 0)
        weight = np.where(near, 1 / (1.05 - cos), 0)
        share = (weight @ self.toxic + self.prior) / (weight.sum(axis=1) + 1)
        found = []
        for i in range(queries[0] if evidence else 0):
            at = np.flatnonzero(near[i])
            found.append([self.names[j] for j in sorted(at.tolist(), key=lambda j: (-cos[i, j], self.names[j]))[:5]])
        return share, found


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def curve(share: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the votes of examples to their labels."""
    if not len(share) or toxic.min() == toxic.max():
        return 1.0, 0.0
    x, a, b = logit(share), 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = p * (1 - p)
        h = np.array([[(r * x * x).sum() + 1, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, [((toxic - p) * x).sum() + (1 - a), (toxic - p).sum()])
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def weighed(terms: np.ndarray, counts: np.ndarray, factor: np.ndarray) -> Vector:
    """The unit vector of an example."""
    w = (1 + np.log(counts)) * factor[terms]
    return terms, w / np.sqrt((w * w).sum()) if len(w) else w


#: What a worker has made of a broadcast: the index and the table of words are built once, not in each task.
BUILT: dict[str, tuple] = {}


def built(key: str, make: Callable[[], tuple]) -> tuple:
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = make()
    return BUILT[key]


def fitting(sizes: list[tuple[str, int]], most: int) -> list[str]:
    """Names of the texts that together have at most ``most`` bytes: in the given order, each that still fits. One that
    doesn't is left out, and those after it are not."""
    taken, total = [], 0
    for name, size in sizes:
        if total + size <= most:
            taken.append(name)
            total += size
    return taken


def example_terms(sample: DataFrame) -> pa.Table:
    """(id, toxic, h, tf): hashed terms of each labelled example, and their counts."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(term_hashes)
        for batch in batches:
            terms = [counted(t, known) for t in batch.column("text")]
            h = pa.array([x.view(np.int64) for x, _ in terms], pa.list_(pa.int64()))
            tf = pa.array([n.astype(np.int32) for _, n in terms], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), h, tf], ["id", "toxic", "h", "tf"])

    return sample.select(F.col("id").cast("string").alias("id"), "toxic", "text").mapInArrow(of_task, "id string, toxic int, h array<long>, tf array<int>").toArrow()


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents. A task counts its
    own ones first, so no more than the vocabulary is shuffled from each."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, width = Numbered(sent.value), 0, len(sent.value)
        df = np.zeros(width, np.int64)
        for batch in batches:
            n += len(batch)
            for i in range(0, len(batch), BATCH):
                doc, number, _ = known.counts(batch.column("text")[i : i + BATCH])
                places = known.places[number]
                held = places >= 0
                df += np.bincount(np.unique(np.repeat(doc, held.sum(axis=1)) * width + places[held]) % width, minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    found = docs.select("text").mapInArrow(of_task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    neighbours: int = 15,
    max_examples: int = 2048,
    max_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    whole: bool = False,
    relevance: bool = True,
) -> DataFrame:
    """Score each whole text by the labelled examples nearest to it.

    Examples are a bounded sample of the labelled documents that aren't held out: those of the smallest
    hashes of ids, at most ``max_examples`` with ``max_bytes`` of text together (a text that does not fit any more is left out,
    later ones that do are not). Terms are all words, and the beginnings of words that examples have. A vector holds
    (1 + log tf) * idf, normalised over all terms of the whole text: words that no example has count for
    its length as words of one document. The document frequencies of the examples' terms are counted over all documents. With
    ``relevance`` a term has a further factor log2(1 + lift), where the lift is how many times as often it stands in toxic examples as
    in others (smoothed; 1 for a term without bearing), that of supervised TF-IDF.
    Each document's nearest examples by exact cosine come from a block-max
    inverted index, which has the bounds of the sample and goes to each task. Votes weighted
    by 1 / (1.05 - cosine) are calibrated by a logistic curve fitted to the examples, each
    without itself. A document that shares no term with any example gets the calibrated share of toxic examples.

    Texts are read once for the sample, once for the frequencies and once for the scores; they
    are neither shuffled nor written. The id, source and language are no inputs.

    Returns the id, ``held_out``, ``score`` and ``evidence`` (ids of the nearest examples); with
    ``whole`` the columns of ``docs`` and ``__score``, row by row without a join.

    Null and empty texts have no terms; texts of any length are scored whole. Documents labelled several times have the
    rounded mean label; null labels and labels without a document are ignored. Of labelled rows of one id the
    smallest text is the example. Without labels of both kinds the score is the share
    of toxic ones, or 0. Rows are independent and may repeat; an empty table gives an empty one. Columns of
    ``docs`` that begin with two underscores are left out.
    """
    key = F.col(id_col)
    rated = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & ~held_out(id_col)).groupBy(key.alias("id")).agg(F.round(F.avg(label_col)).cast("int").alias("toxic"))
    rated = staged(rated.withColumn("draw", F.xxhash64("id")), "toxic-labels")
    n = rated.count()
    near_enough = F.pmod("draw", F.lit(1 << 32)) < int(min(1.0, 1.2 * max_examples / max(n, 1)) * (1 << 32))
    chosen = staged((rated.where(near_enough) if n > 2 * max_examples else rated).orderBy("draw", "id").limit(max_examples), "toxic-sample")
    docs = plain(docs)
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    texts = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"), *row)
    own = texts.join(F.broadcast(chosen), "id").groupBy("draw", "id", "toxic").agg(F.min("text").alias("text"))
    own = staged(own, "toxic-texts")
    sizes = own.select(F.col("id").cast("string").alias("name"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("draw", "id")
    fits = fitting([(r["name"], r["size"]) for r in sizes.collect()], max_bytes)
    drawn = example_terms(own.where(F.col("id").cast("string").isin(fits))).sort_by("id")
    toxic, names = drawn.column("toxic").to_numpy().astype(float), drawn.column("id").to_pylist()
    bad, good = toxic.sum(), (1 - toxic).sum()
    lengths = drawn.column("h").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(int)
    hashes, tf = (drawn.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "tf"))
    vocabulary, terms = np.unique(hashes.view(np.uint64), return_inverse=True)
    slope, shift, unseen, prior = 1.0, 0.0, 0.0, float(bad / (bad + good)) if bad + good else 0.0
    if not bad or not good:
        vocabulary, votes = vocabulary[:0], ([], toxic[:0], [])
        factor = np.zeros(0)
    else:
        df, rows = document_frequencies(texts, vocabulary)
        a, both = np.bincount(terms, np.repeat(toxic, lengths), len(vocabulary)), np.bincount(terms, minlength=len(vocabulary))
        lift = ((a + SMOOTHING * prior) / bad) / ((both - a + SMOOTHING * (1 - prior)) / good)
        factor = (np.log((1 + rows) / (1 + df)) + 1) * (np.log2(1 + lift) if relevance else 1.0)
        unseen = float(np.log((1 + rows) / 2) + 1)
        ends = np.cumsum(lengths)
        vectors = [weighed(terms[e - m : e], tf[e - m : e], factor) for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
        votes = (vectors, toxic, names)
    sent, key = docs.sparkSession.sparkContext.broadcast((vocabulary, factor, votes)), uuid.uuid4().hex

    def ready() -> tuple[Votes, Numbered]:
        """What a task needs; a worker makes it once."""
        vocabulary, _, votes = sent.value
        return built(key, lambda: (Votes(*votes, len(vocabulary), prior, neighbours), Numbered(vocabulary)))

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in batch.column("id").to_pylist():
                vectors = sent.value[2][0][begin : begin + BATCH]
                share = ready()[0].of(together(vectors), np.arange(begin, begin + len(vectors)), evidence=False)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(vectors))), pa.array(share)], ["i", "share"])

    if bad and good:
        shares = docs.sparkSession.range(0, len(toxic), BATCH).mapInArrow(own_votes, "i long, share double").toArrow().sort_by("i")
        slope, shift = curve(shares.column("share").to_numpy(), toxic)

    @F.arrow_udf("struct<score:double,evidence:array<string>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (vocabulary, factor, _), (ballot, known) = sent.value, ready()
        kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.string()))])
        for texts in batches:
            shares, near = [np.zeros(0)], []
            for i in range(0, len(texts), BATCH):
                found = ballot.of(asked(texts[i : i + BATCH], known, factor, unseen))
                shares.append(found[0])
                near += found[1]
            share = np.concatenate(shares)
            p = 1 / (1 + np.exp(-np.clip(slope * logit(share) + shift, -30, 30))) if len(vocabulary) else share
            yield pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(near, pa.list_(pa.string()))], fields=list(kind))

    out = texts.withColumn("s", score("text"))
    if whole:
        return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("s.score").alias("__score"))
    return out.select(F.col("id").alias(id_col), "held_out", F.col("s.score").alias("score"), F.col("s.evidence").alias("evidence"))
