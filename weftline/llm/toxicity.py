"""Toxicity scores from class-conditional Kneser-Ney models.

Two models of the letters (UTF-8 bytes) of words, one of labelled toxic documents and one of ordinary ones, give each
word its log-likelihood ratio. Orders ``HIGH`` down to ``SHARED`` + 1 are counted for each class. Both classes back off to
the same orders ``SHARED`` to 1, which are counted over the words of all documents, labelled or not, so an expression that is
rare in both classes has nearly the same probability in both. All orders are interpolated modified Kneser-Ney: the top order
of a class has raw counts, as have strings that begin a word; all others have continuation counts (how many different bytes
come before); a count of 1, 2 or more has its own discount, estimated from the counts of that order and never greater than
the count; what is discounted in a context is what the next lower order gets, so each context sums to 1. Below order 1
all 256 bytes are alike. A document's evidence is its log-likelihood ratio a word, and the same of what exceeds a margin,
which a few strong words in a long text still move. A logistic fit over rows that the models haven't seen turns both into
a score.

Labels are used of at most ``MAX_LABELLED`` documents, those with the least hash of their id, and of so many of these, in parts by another
hash, that their texts have at most ``MAX_CHARS`` characters: documented bounds, and the only ones. The class models keep every byte
string of that sample, so what the driver gathers and broadcasts (24 bytes a distinct string) is bounded by them. The shared orders have at most 2**24 strings, whatever the corpus. Every document is scored
over its whole text, in one pass without a shuffle; words are cached, their scores are computed for a batch at once.

Edge cases: null or blank texts have no evidence and get the score of that; repeated rows and ties get equal scores;
very long texts take time in proportion; null ids are never held out; without any toxic or ordinary label the score is
0 for all; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged, trimmed, tune

HIGH, SHARED = 6, 3
#: Discounts of counts of 1, 2 and more where an order has too few kinds of counts to estimate them.
DISCOUNTS = (0.5, 1.0, 1.5)
#: Log-likelihood ratios of words are counted beyond it in the second kind of evidence.
MARGIN = 3.0
MAX_LABELLED = 60_000
#: Characters of the labelled documents that the models are fitted on, and the parts in which these are taken.
MAX_CHARS, PARTS = 300_000_000, 4096
FOLDS = 5
_START, _END = 1, 2
_KEEP = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def grams(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the words (an end sign included): its word, its place, and the byte strings of order 1 to HIGH
    that end in it, as numbers with the order in the top byte; 0 where the word hasn't as many bytes before."""
    raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in items), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in items], np.int64)
    of = np.repeat(np.arange(len(items)), sizes)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, key = np.zeros((HIGH + 1, len(raw)), np.int64), np.zeros(len(raw), np.int64)
    for k in range(1, HIGH + 1):
        before = np.zeros(len(raw), np.int64)
        before[k - 1 :] = raw[: max(0, len(raw) - k + 1)]
        key = key | before << 8 * (k - 1)
        out[k] = np.where(place >= k - 1, key | k << 56, 0)
    return of, place, out


def _context(key: np.ndarray) -> np.ndarray:
    k = key >> 56
    return (key & ((1 << 56) - 1)) >> 8 | (k - 1) << 56


def _suffix(key: np.ndarray) -> np.ndarray:
    k = key >> 56
    return key & ((np.int64(1) << 8 * (k - 1)) - 1) | (k - 1) << 56


def _first(key: np.ndarray) -> np.ndarray:
    return key >> 8 * ((key >> 56) - 1) & 255


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, at = np.unique(keys, return_inverse=True)
    return (unique, *[np.bincount(at, v, len(unique)) for v in values])


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4 (modified Kneser-Ney)."""
    one, two, three, four = (float((n == i).sum()) for i in (1, 2, 3, 4))
    if not (one and two and three and four):
        return np.array((0.0, *DISCOUNTS))
    y = one / (one + 2 * two)
    found = 1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three
    return np.array([0.0, *np.clip(found, 0.05, (1, 2, 3))])


def level(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of one order with their counts in one class: what each gets in its context, the contexts, and what each of these leaves to the
    order below."""
    taken = discounts(n)[np.minimum(n, 3).astype(int)]
    ctx, total, left = _sums(_context(keys), n, taken)
    at = np.searchsorted(ctx, _context(keys))
    none = total == 0
    total = np.maximum(total, 1)
    return (n - taken) / total[at], ctx, np.where(none, 1.0, left / total)


def continuations(keys: np.ndarray, n: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Counts of strings of an order below the top: for those that begin a word ``n``, for others how many of ``above`` end in them."""
    suffix, kinds = _sums(_suffix(above), np.ones(len(above)))
    at = np.minimum(np.searchsorted(suffix, keys), max(len(suffix) - 1, 0))
    inner = _first(keys) != _START
    found = np.where(suffix[at] == keys, kinds[at], 0) if len(suffix) else np.zeros(len(keys))
    return np.where(inner, found, n)


class Model:
    """Both classes' models over tables of byte strings."""

    def __init__(self, shared: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]):
        """shared: byte strings of orders 1 to SHARED and their counts (continuation counts but for those that begin a word);
        own: those of orders SHARED + 1 to HIGH and two columns of raw counts, ordinary and toxic."""
        self.name = uuid.uuid4().hex
        made = []
        for k in range(1, HIGH + 1):
            keys, n = shared if k <= SHARED else own
            at = keys >> 56 == k
            here, n = keys[at], n[at].reshape(at.sum(), -1).astype(float)
            if SHARED < k < HIGH:
                n = np.stack([continuations(here, n[:, c], keys[(keys >> 56 == k + 1) & (own[1][:, c] > 0)]) for c in (0, 1)], 1)
            parts = [level(here, c) for c in n.T]
            got, rest = (np.stack([x[i] for x in parts], 1) for i in (0, 2))
            made.append((here, got, parts[0][1], rest))
        low, high = made[:SHARED], made[SHARED:]
        self.base, self.base_rest = self._sorted(low, 0), self._sorted(low, 2)
        self.own, self.own_rest = self._sorted(high, 0), self._sorted(high, 2)
        self.weights = np.zeros(3)
        self.cache: dict[bytes, float] = {}
        self.old: dict[bytes, float] = {}

    @staticmethod
    def _sorted(levels: list[tuple[np.ndarray, ...]], i: int) -> tuple[np.ndarray, np.ndarray]:
        k, v = np.concatenate([x[i] for x in levels]), np.concatenate([x[i + 1] for x in levels])
        sort = np.argsort(k)
        return k[sort], v[sort].astype(np.float32)

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        known, values = table
        out = np.full((len(keys), values.shape[1]), float(default))
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            out[hit] = values[at[hit]]
        return out

    def chances(self, strings: np.ndarray) -> np.ndarray:
        """Probabilities, ordinary and toxic, of the last bytes of ``strings`` after those before them: all of the word so far or the last
        HIGH bytes of it. Each order looks up its distinct strings in their order."""
        p = np.full((len(strings), 2), 1 / 256)
        for k in range(1, HIGH + 1):
            has = np.flatnonzero(strings >> 56 >= k)
            own, at = np.unique(strings[has] & ((np.int64(1) << 8 * k) - 1) | k << 56, return_inverse=True)
            table, rest = (self.base, self.base_rest) if k <= SHARED else (self.own, self.own_rest)
            p[has] = self._look(table, own, 0)[at] + self._look(rest, _context(own), 1)[at] * p[has]
        return p

    def ratios(self, items: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of each word, toxic against ordinary."""
        if not items:
            return np.zeros(0)
        of, place, key = grams(items)
        said = np.flatnonzero(place > 0)
        strings, at = np.unique(key[np.minimum(place[said] + 1, HIGH), said], return_inverse=True)
        p = np.log(self.chances(strings))
        return np.bincount(of[said], (p[:, 1] - p[:, 0])[at], len(items))

    def evidence(self, texts: list[str | None], cached: int = 150_000) -> np.ndarray:
        """For each text: ratio a word, ratio beyond the margin a word. Words are cached in two generations of ``cached``: what is still in use
        moves to the young one, so frequent words stay."""
        cut = [words(t) for t in texts]
        flat = [w for c in cut for w in c]
        young, old = self.cache, self.old
        fresh = []
        for w in set(flat) - young.keys():
            r = old.get(w)
            if r is None:
                fresh.append(w)
            else:
                young[w] = r
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            young.update(zip(part, self.ratios(part).tolist(), strict=True))
        r = np.fromiter(map(young.__getitem__, flat), float, len(flat))
        if len(young) > cached:
            self.cache, self.old = {}, young
        of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        n = np.maximum(np.array([len(c) for c in cut]), 1)
        plain = np.bincount(of, np.clip(r, -5, 5), len(cut)) / n
        strong = np.bincount(of, np.maximum(r - MARGIN, 0), len(cut)) / n
        return np.stack([plain, np.log1p(100 * strong)], 1)

    def forget(self) -> None:
        """Empties the caches, so that idle workers stay small."""
        self.cache, self.old = {}, {}

    def fit(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic weights by Newton steps, slightly shrunk."""
        self.center, self.scale = evidence.mean(0), evidence.std(0) + 1e-9
        x = np.column_stack([np.ones(len(evidence)), (evidence - self.center) / self.scale])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - toxic) + 0.01 * w
            w = w - np.linalg.solve(x.T * (p * (1 - p) + 1e-6) @ x + 0.01 * np.eye(len(w)), grad)
        self.weights = w

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(evidence)), (evidence - self.center) / self.scale])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _evidence_of(model: Broadcast, texts: pa.Array) -> np.ndarray:
    return model.value.evidence(texts.to_pylist())


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> DataFrame:
    """(fold, toxic, text, part) of the labelled documents that may be learned from: none that is held out, ``limit`` ids at most. part: one of
    ``PARTS``, by the id's hash."""
    own = labels.filter("toxic is not null").groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    own = own.filter(F.col("__id").isNotNull() & (fold(F.col("__id")) != 0))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(F.broadcast(own), "__id")  # ``limit`` rows at most
    return joined.select(fold(F.col("__id")).alias("fold"), F.col("__toxic").cast("int").alias("toxic"), "text", F.pmod(F.xxhash64("__id"), F.lit(PARTS)).alias("part"))


def within(sample: DataFrame, most: int) -> DataFrame:
    """The parts of a staged sample, in their order, that have ``most`` characters together: what the models hold is bounded by that."""
    sizes = dict(sample.groupBy("part").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).collect())  # PARTS rows at most
    whole = 0
    for part in sorted(sizes):
        whole += sizes[part]
        if whole > most:
            return sample.filter(F.col("part") < part)
    return sample


#: Distinct words that a task holds before it hands over their counts.
HELD_WORDS = 200_000


@trimmed
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, word, n) from (toxic, text)."""
    found: dict[int | None, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for toxic, words_of in found.items():
            kinds = pa.array([toxic] * len(words_of), pa.int32())
            yield pa.RecordBatch.from_arrays([kinds, pa.array(list(words_of), pa.binary()), pa.array(list(words_of.values()), pa.int64())], names=["toxic", "word", "n"])
        found.clear()

    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found.setdefault(toxic, Counter()).update(words(text.as_py()))
        if sum(map(len, found.values())) > HELD_WORDS:
            yield from out()
    yield from out()


def _cut(low: int, high: int):
    """For rows (word, n0, n1): (key, n0, n1) of the byte strings of orders ``low`` to ``high`` in them."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, place, key = grams(b.column(0).to_pylist())
            n = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()]).astype(float)
            for k in range(low, high + 1):
                said = (place > 0) & (key[k] > 0)
                keys, c0, c1 = _sums(key[k][said], n[0][of[said]], n[1][of[said]])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c0.astype("int64")), pa.array(c1.astype("int64"))], names=["key", "n0", "n1"])

    return run


def _strings(texts: DataFrame, low: int, high: int) -> DataFrame:
    """(key, n0, n1) of the byte strings of the words of ``texts`` (toxic, text): how often in ordinary and in toxic ones."""
    counted = texts.mapInArrow(_count_words, "toxic int, word binary, n long")
    sums = [F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in (0, 1)]
    found = counted.groupBy("word").agg(*sums).mapInArrow(_cut(low, high), "key long, n0 long, n1 long")
    return found.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of the orders 1 to SHARED over all ``texts`` (text): raw counts of strings that begin a word, continuation counts of the others."""
    found = staged(_strings(texts.select(F.lit(0).alias("toxic"), "text"), 1, SHARED + 1).select("key", F.col("n0").alias("n")), "shared-strings")
    order = F.shiftright("key", 56)
    begins = F.expr("shiftright(key, cast(8 * (shiftright(key, 56) - 1) as int)) & 255") == _START
    suffix = F.expr("(key & (shiftleft(1L, cast(8 * (shiftright(key, 56) - 1) as int)) - 1)) | shiftleft(shiftright(key, 56) - 1, 56)")
    raw = found.filter(begins & (order <= SHARED)).select("key", "n")
    return raw.unionByName(found.filter(order > 1).groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("n")))


def train(sample: DataFrame, texts: DataFrame) -> Model | None:
    """The models of folds 1 to 3 and weights fitted on fold 4 of a table (fold, toxic, text), over the shared orders of all ``texts`` (text);
    None if a class is missing."""
    spark = sample.sparkSession
    got = _strings(sample.filter("fold in (1, 2, 3)").select("toxic", "text"), SHARED + 1, HIGH).toArrow()
    counts = np.stack([got.column("n0").to_numpy(), got.column("n1").to_numpy()], 1) if got.num_rows else np.zeros((0, 2))
    if not len(counts) or (counts.sum(0) == 0).any():
        return None
    base = shared_counts(texts).toArrow()  # 2**24 rows at most
    model = Model((base.column("key").to_numpy(), base.column("n").to_numpy()), (got.column("key").to_numpy(), counts))
    shared = spark.sparkContext.broadcast(model)  # 16 bytes for each distinct string of the sample, and their contexts

    @trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = _evidence_of(shared, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["toxic", "plain", "strong"])
        shared.value.forget()

    held = sample.filter("fold = 4").select("toxic", "text").mapInArrow(weigh, "toxic int, plain double, strong double").toArrow()
    shared.destroy()  # the model goes out again with its weights
    toxic = held.column("toxic").to_numpy()
    if not 0 < toxic.sum() < len(toxic):
        return None
    model.fit(np.stack([held.column("plain").to_numpy(), held.column("strong").to_numpy()], 1), toxic.astype(float))
    return model


def _trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model | None:
    tune(docs.sparkSession)
    sample = within(staged(labelled_sample(docs, labels, id_col, text_col), "labelled"), MAX_CHARS)
    return train(sample, docs.select(F.col(text_col).cast("string").alias("text")))


def score_column(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """Column of scores, from 0 to 1."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            yield pa.array(m.score(m.evidence(texts.to_pylist())))
        m.forget()

    return F.arrow_udf(of, "double")(F.col(text_col).cast("string"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``."""
    model = _trained(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), score_column(docs, model, text_col).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic."""
    model = _trained(docs, labels, id_col, text_col)
    return docs.filter(score_column(docs, model, text_col) < 0.5)
