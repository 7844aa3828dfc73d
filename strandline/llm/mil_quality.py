"""Quality classifier: attention-based multiple-instance learning over a document's passages.

Every passage (a run of ``PASSAGE_WORDS`` words) becomes a feature vector and, through a learned
layer, an embedding.  A gated attention network weighs the embeddings, and the weighted sum is
scored.  Only document labels are used; which passages matter is learned.

Rows: a null or empty text is one passage of zeros, so it gets a score too.  A null doc_id is never
trained on.  Repeated rows get equal scores.  Extra columns pass through; a column that has the
output's name is replaced.  Without labels of both kinds every score is the share of label 1 (1.0
without labels at all).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stored, fold_of, table

PASSAGE_WORDS = 64
#: Bound of the labelled sample that is trained on, in documents, and in passages of them all.
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 200_000
#: Bytes of text that are looked at together; longer texts are cut between words.
CHUNK_BYTES = 1 << 18
CUTOFF = 0.3
_BIGRAMS = 64
_SIGNS = b"!#$%&*|<>.,"
_CLASSES = len(_SIGNS) + 6  # lower, upper, digit, other ASCII, beyond ASCII, line end
N_FEATURES = _CLASSES + _BIGRAMS + 6


def _class_table() -> np.ndarray:
    kinds = np.full(256, 3, np.int64)
    kinds[ord("a") : ord("z") + 1] = 0
    kinds[ord("A") : ord("Z") + 1] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[128:] = 4
    kinds[10] = 5
    for k, sign in enumerate(_SIGNS):
        kinds[sign] = 6 + k
    return kinds


_KIND = _class_table()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of whole texts or of parts of long ones, each of about CHUNK_BYTES, with their rows."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = at + CHUNK_BYTES
            if end < len(text):
                cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                end = cut if cut > at else end
            part = text[at:end]
            if parts and size + len(part) > CHUNK_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(part)
            size += len(part) + 1
            at = end if end > 0 else 1
    if parts:
        yield rows, parts


def passages(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the parts, and the part that each belongs to."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    first_byte = np.cumsum(sizes) - sizes
    space = _SPACE[buf]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    part = np.searchsorted(first_byte, starts, "right") - 1
    words_in = np.bincount(part, minlength=len(parts))
    first_word = np.cumsum(words_in) - words_in
    n_pass = np.maximum(1, -(-words_in // PASSAGE_WORDS))
    first_pass = np.cumsum(n_pass) - n_pass
    owner = np.repeat(np.arange(len(parts)), n_pass)
    total = int(n_pass.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return out, owner
    of_word = first_pass[part] + (np.arange(len(starts)) - first_word[part]) // PASSAGE_WORDS
    # a passage's bytes go from its first word to the next passage or to the end of its part; others count as ``total``
    opens = np.concatenate(([0], np.flatnonzero(np.diff(of_word)) + 1))
    ids, begin = of_word[opens], starts[opens]
    close = np.minimum(np.append(begin[1:], len(buf)), (first_byte + sizes)[part[opens]])
    edges = np.concatenate(([0], np.stack([begin, close], 1).ravel(), [len(buf)]))
    labels = np.concatenate(([total], np.stack([ids, np.full(len(ids), total)], 1).ravel()))
    of_byte = np.repeat(labels, np.diff(edges))
    n_bytes = np.maximum(1, np.bincount(of_byte, minlength=total + 1)[:total]).astype(np.float32)
    kinds = np.bincount(of_byte * _CLASSES + _KIND[buf], minlength=(total + 1) * _CLASSES).reshape(total + 1, _CLASSES)
    pair = (buf[:-1].astype(np.int64) * 31 + buf[1:].astype(np.int64) * 17 + (buf[:-1] >> 3)) & (_BIGRAMS - 1)
    inside = np.where(of_byte[:-1] == of_byte[1:], of_byte[:-1], total)
    pairs = np.bincount(inside * _BIGRAMS + pair, minlength=(total + 1) * _BIGRAMS).reshape(total + 1, _BIGRAMS)
    out[:, :_CLASSES] = kinds[:total] / n_bytes[:, None]
    out[:, _CLASSES : _CLASSES + _BIGRAMS] = pairs[:total] / n_bytes[:, None]
    lengths = (ends - starts).astype(np.float64)
    n_words = np.maximum(1, np.bincount(of_word, minlength=total)).astype(np.float64)
    mean = np.bincount(of_word, lengths, total) / n_words
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, lengths**2, total) / n_words - mean**2))
    # word hashes: differences of prefix sums of byte * step**position, brought to the same start
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(buf), _STEP, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power)))
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        back = np.cumprod(np.full(len(buf), inverse, np.uint64))
        words = (sums[ends] - sums[starts]) * back[starts]
    same = np.concatenate(([False], (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])))
    order = np.lexsort((words, of_word))
    sorted_w, sorted_p = words[order], of_word[order]
    fresh = np.concatenate(([True], (sorted_w[1:] != sorted_w[:-1]) | (sorted_p[1:] != sorted_p[:-1])))
    rest = out[:, _CLASSES + _BIGRAMS :]
    rest[:, 0] = mean / 10
    rest[:, 1] = spread / 10
    rest[:, 2] = np.bincount(of_word, same, total) / n_words
    rest[:, 3] = np.bincount(sorted_p, fresh, total) / n_words
    rest[:, 4] = np.bincount(of_word, _KIND[buf[starts]] == 1, total) / n_words
    rest[:, 5] = np.minimum(1, n_words / PASSAGE_WORDS)
    return out, owner


class GatedAttention:
    """x -> h = tanh(x A + a); weight ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum weight h + b)."""

    HIDDEN, GATE = 32, 16

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"A": draw(N_FEATURES, self.HIDDEN), "a": np.zeros(self.HIDDEN), "V": draw(self.HIDDEN, self.GATE), "U": draw(self.HIDDEN, self.GATE), "w": draw(self.GATE), "c": draw(self.HIDDEN), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.constant: float | None = None

    def _embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, g, (t * g) @ p["w"]

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> GatedAttention:
        """x: passages; bag: the sorted document number of each; y: the documents' labels."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        self.mean, self.scale = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)
        first = np.searchsorted(bag, np.arange(len(y) + 1))
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            for chosen in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                step += 1
                grad = self._gradient(np.concatenate([x[first[k] : first[k + 1]] for k in chosen]), np.cumsum([0, *(first[k + 1] - first[k] for k in chosen)])[:-1], y[chosen])
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.001 * (g * g - m2[k])
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, bags = self.p, np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
        h, t, g, e = self._embed(x)
        e = np.exp(e - np.maximum.reduceat(e, first)[bags])
        alpha = e / np.add.reduceat(e, first)[bags]
        z = np.add.reduceat(alpha[:, None] * h, first)
        out = 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))
        d = (out - y) / len(y)
        dz = d[:, None] * p["c"]
        d_alpha = np.einsum("ij,ij->i", dz[bags], h)
        d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, first)[bags])
        dt, dg = d_e[:, None] * p["w"] * g * (1 - t * t), d_e[:, None] * p["w"] * t * g * (1 - g)
        dh = alpha[:, None] * dz[bags] + dt @ p["V"].T + dg @ p["U"].T
        da = dh * (1 - h * h)
        scaled = (x - self.mean) / self.scale
        return {"A": scaled.T @ da, "a": da.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ d_e, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A score for each whole text; parts of a long one are merged by their attention sums."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        top = np.full(len(texts), -np.inf)
        weight, z = np.zeros(len(texts)), np.zeros((len(texts), self.HIDDEN))
        for rows, parts in _pieces(texts):
            x, owner = passages(parts)
            h, _, _, e = self._embed(x)
            first = np.searchsorted(owner, np.arange(len(parts)))
            peak = np.maximum.reduceat(e, first)
            w = np.exp(e - peak[owner])
            sums, sums_z = np.add.reduceat(w, first), np.add.reduceat(w[:, None] * h, first)
            for k, row in enumerate(rows):
                high = max(top[row], peak[k])
                old, new = np.exp(top[row] - high), np.exp(peak[k] - high)
                weight[row] = weight[row] * old + sums[k] * new
                z[row] = z[row] * old + sums_z[k] * new
                top[row] = high
        # rounded, so that a text's neighbours in a batch don't show in its last digits
        return np.round(1 / (1 + np.exp(-((z / weight[:, None]) @ self.p["c"] + self.p["b"]))), 9)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_docs: int = TRAIN_DOCS, max_passages: int = TRAIN_PASSAGES, fold: Callable = lambda c: fold_of(c, 5) != 0) -> GatedAttention:
    """Fit on a bounded sample of the labelled documents, with all passages of each.

    ``labels``: doc_id and quality.  Of several labels for a document the smallest counts; null ids
    and labels are left out.  The sample: the ``max_docs`` documents with the smallest hash of their id, of these in
    that order each that fits with those before into ``max_passages``.  Of rows that share an id the one with the least hash of
    its text counts.  Texts are encoded by the executors into a stored
    table; the driver gets the passage features of the sample (348 bytes each).
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = docs.select("doc_id").join(marks, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    picked = [(r[0], int(r[1])) for r in chosen.collect()]
    if not picked:
        return GatedAttention().fit(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0))
    spark = docs.sparkSession
    small = spark.createDataFrame(picked, "doc_id long, quality int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(small), "doc_id")
    found = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "quality", "x.text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or b"" for t in pdf["text"]]
            bags: list[list[np.ndarray]] = [[] for _ in texts]
            for rows, parts in _pieces(texts):
                x, owner = passages(parts)
                for k, row in enumerate(rows):
                    bags[row].append(x[owner == k])
            full = [np.concatenate(b) for b in bags]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "n": [len(b) for b in full], "x": [b.astype("<f4").tobytes() for b in full]})

    stored = Stored(found.mapInPandas(encode, "doc_id long, quality int, n int, x binary"), "passages")
    taken, total = [], 0
    for r in stored.df.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r["n"] <= max_passages:
            total += r["n"]
            taken.append((r["doc_id"],))
    rows = sorted(stored.df.join(F.broadcast(spark.createDataFrame(taken, "doc_id long")), "doc_id").collect(), key=lambda r: r["doc_id"])
    stored.drop()
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(np.frombuffer(bytes(r["x"]), "<f4").reshape(r["n"], N_FEATURES) for r in rows)])
    bag = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    return GatedAttention().fit(x, bag, np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, model: GatedAttention, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every row's whole text."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score([t or b"" for t in texts]))

    return docs.withColumn(out, scores.asNondeterministic()(F.col(text).cast("binary")))


def op1_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    columns = docs.columns
    return score(docs, train(docs, table(spark, sf_dir, "labels")), out="__score").where(F.col("__score") >= CUTOFF).select(*columns)


QUERIES = {"op1_mil_quality": op1_mil_quality}
ORACLES: dict[str, str] = {}
