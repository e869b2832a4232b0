"""Language identification by averaged hashed subword embeddings.

A text's subwords are its byte 2- and 3-grams (letters only, A-Z in lower case,
runs of anything else one space).  Each has a bucket, each bucket an embedding;
a text is the average of its embeddings and a linear softmax reads the language
off it.  Embeddings and softmax are trained together by stochastic gradient
descent.  Since both are linear, prediction needs one logit vector for each
bucket: a text's logits are the average over all its subwords.

Training sees a bounded sample: about ``SAMPLE_ROWS`` labelled rows, the same
share of the bound for every language, picked by a hash of doc_id.  A fifth of
the sample is kept apart to fit the temperature that turns logits into
probabilities and the rejection threshold: the score under which hardly any
right prediction falls (at most MAX_THRESHOLD).

Defined cases: a null text or one without a letter is ``und`` with score 0;
without labelled rows everything is ``und``; ties go to the first language in
the alphabet; whole texts count, of any length; an empty table gives an empty
table and repeated rows repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, small_batches, utf8

BUCKETS = 1 << 14
DIMENSION = 16
SAMPLE_ROWS = 1600
EPOCHS = 12
RATE = 4.0
MAX_THRESHOLD = 0.5
LOST = 0.001  # share of right predictions that the threshold may reject
WINDOW = 1 << 18  # bytes hashed at a time

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def normal(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(_LETTERS).split()) + b" "


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or _LETTER.search(text.decode("utf-8", "replace")) is not None


def buckets_of(data: np.ndarray) -> np.ndarray:
    """Buckets of the 2-grams and 3-grams that start at each byte but the last two, side by side."""
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    two = (a << np.uint32(8) | b) * np.uint32(2654435761)
    three = (a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2246822519)
    return np.stack((two, three)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    data = np.frombuffer(normal(text), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 2), WINDOW):
        total += np.bincount(buckets_of(data[at : at + WINDOW + 2]).ravel(), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids] / max(1, total.sum())


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages, temperature applied
    bias: np.ndarray
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, one row for each text; whole texts, in windows of bounded size."""
        plain = [normal(t) for t in texts]
        sizes = np.array([max(0, len(p) - 2) for p in plain])
        last = np.cumsum([len(p) for p in plain])
        starts = last - [len(p) for p in plain]
        data = np.frombuffer(b"".join(plain), np.uint8)
        sums = np.zeros((len(plain), len(self.languages)))
        for at in range(0, max(0, len(data) - 2), WINDOW):
            grams = buckets_of(data[at : at + WINDOW + 2])
            stop = at + grams.shape[1]
            own = np.arange(np.searchsorted(last, at, "right"), np.searchsorted(starts, stop))
            # From each text's first n-gram in the window to the last one that does not cross into the next text.
            spans = np.stack((np.maximum(starts[own], at), np.minimum(starts[own] + sizes[own], stop))) - at
            own, spans = own[spans[0] < spans[1]], spans[:, spans[0] < spans[1]]
            if len(own):
                weights = np.concatenate((self.logits[grams[0]] + self.logits[grams[1]], np.zeros((1, sums.shape[1]))))
                sums[own] += np.add.reduceat(weights, spans.T.ravel(), axis=0)[::2]
        z = sums / np.maximum(1, 2 * sizes)[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """SGD on (buckets, shares, language); rows come in any fixed order."""
    languages = sorted({lang for _, _, lang in rows})
    label = {lang: i for i, lang in enumerate(languages)}
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 20 else order
    learnt = order[len(rows) // 5 :] if len(rows) >= 20 else order
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights, bias = random.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    per_class = np.bincount([label[rows[i][2]] for i in learnt], minlength=len(languages))
    balance = len(learnt) / np.maximum(1, per_class) / len(languages)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in random.permutation(learnt):
            ids, shares, lang = rows[i]
            hidden = shares @ embedding[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[lang]] -= 1
            p *= rate * min(1.0, balance[label[lang]])
            back = weights @ p
            weights -= np.outer(hidden, p)
            bias -= 0.01 * p
            embedding[ids] -= np.outer(shares, back) * 10
    table = embedding @ weights
    z = np.array([shares @ table[ids] + bias for ids, shares, _ in (rows[i] for i in held)])
    want = np.array([label[rows[i][2]] for i in held])

    def probabilities(temperature: float) -> np.ndarray:
        y = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return y / y.sum(axis=1, keepdims=True)

    def loss(temperature: float) -> float:
        return float(-np.log(np.maximum(probabilities(temperature)[np.arange(len(want)), want], 1e-12)).mean())

    best = min(np.geomspace(0.2, 5, 33), key=loss)
    p = probabilities(best)
    right = p.max(axis=1)[p.argmax(axis=1) == want]
    threshold = min(MAX_THRESHOLD, float(np.quantile(right, LOST))) if len(right) else 0.0
    return Model(languages, table / best, bias / best, threshold)


def checksum(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the labelled rows; None if there are none."""
    rows = bounded_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = {lang: min(1.0, sample_rows / len(counts) / n) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for lang, s in sorted(share.items()) for x in (lang, s)])
    place = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < F.element_at(limit, F.col(lang_col)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.string()), pa.array([i.astype(np.uint16).tobytes() for i, _ in made], pa.binary()),
                 pa.array([s.astype(np.float32).tobytes() for _, s in made], pa.binary())],
                names=["doc_id", "lang", "ids", "shares"],
            )

    got = sample.select(F.col(id_col).cast("long"), utf8(text_col), F.col(lang_col)).mapInArrow(
        lean(run), "doc_id long, lang string, ids binary, shares binary"
    ).collect()
    got.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["lang"], bytes(r["ids"])))
    return train([(np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32).astype(np.float64), r["lang"]) for r in got if r["ids"]])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, lang_score and lang_rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    at = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small_batches(batches):
            texts = batch.column(at).to_pylist()
            known = [m is not None and has_letter(t) for t in texts]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            asked = [i for i, k in enumerate(known) if k]
            if asked:
                p = m.scores([texts[i] for i in asked])
                for i, best, score in zip(asked, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    names[i], scores[i] = m.languages[best], score
            rejected = [not k or s < m.threshold for k, s in zip(known, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*kept, "lang_pred", "lang_score", "lang_rejected"],
            )

    rows = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in kept], utf8(text_col).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in (("lang_pred", "string"), ("lang_score", "double"), ("lang_rejected", "boolean")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(lean(run), schema)
