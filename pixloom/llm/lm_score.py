"""LM scoring with a weighted backoff automaton.

The model is a bigram model over words with an end token, smoothed by absolute
discounting: a kept pair (h, w) has (c(h w) - D) / c(h) + l(h) p(w), all other
words behind h get l(h) p(w), where l(h) is what the kept pairs leave over and
p the add-0.5 unigram.  As an automaton: every word that starts a kept pair is a
state, kept pairs are its arcs, and its failure arc of weight l(h) leads to the
root, which knows every word.  Scoring walks a text once from left to right and
adds up log10 weights.

Counts cover the whole training part, and every pair in it is kept (``min_share``
keeps only pairs that make up a share of the training tokens; 0 by default).
Nothing of the model is broadcast.  Texts are dealt in blocks, and a block lists its
distinct words and pairs once, with its own training counts, dealt by hash into
buckets; a bucket adds the counts up and answers every block in the order of its
list, so that answers carry no keys.  One block of those with a pair owns it:
from the pairs it owns it says how many kept pairs start with each word, which
is added up and answered in the same way.  A block then has its whole part of
the automaton.  A key stands at most once in a block's list, so none is hot.

Keys are 64-bit hashes inside buckets of an independent hash, of words and pairs
that a block tells apart exactly: among 3 * 10^9 keys in 2000 buckets two are
mistaken for each other with odds of about 1 in 8000.

Defined cases: null text is empty, a lone end token; a null doc_id trains
like the empty string's checksum; without training documents every word is
unknown and N is 0; repeated rows are counted and scored each time; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, pieces, release_memory, unpacked_piece, utf8

START = b" "  # the place before a text; no word has white space
END = b""  # no word is empty
DISCOUNT = 0.75
BLOCK_BYTES = 16 << 20  # text of one scoring block


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), cut at ASCII white space."""
    return text.lower().split()


def checksum(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, byte planes apart."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return squeezed(values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T.tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(f"u{len(planes)}").ravel().astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, high bytes apart, for these are zeros."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Listed:
    """Keys in the order of buckets and, inside, of their hashes."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray, buckets: int):
        bucket = (places % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(hashes)
        self.order = order[np.argsort(bucket[order], kind="stable")]
        self.keys = hashes[self.order]
        self.ends = np.searchsorted(bucket[self.order], np.arange(buckets + 1, dtype=np.int64))

    def slices(self, values: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Keys, or values given by key, bucket by bucket."""
        listed = self.keys if values is None else values[self.order]
        for start, stop in zip(self.ends[:-1].tolist(), self.ends[1:].tolist()):
            yield listed[start:stop]

    def restored(self, parts: dict[int, bytes]) -> np.ndarray:
        """The values of all keys from each bucket's answer."""
        out = np.zeros(len(self.order), np.int64)
        for bucket, data in parts.items():
            start, stop = self.ends[bucket], self.ends[bucket + 1]
            out[self.order[start:stop]] = unpacked(data, int(stop - start))
        return out


class Block:
    """The numbered words and pairs of a block of texts."""

    def __init__(self, table: pa.Table, buckets: int):
        number: dict[bytes, int] = defaultdict(count().__next__)
        self.start, self.end = number[START], number[END]
        parts, sizes, rows = [], [], []
        for piece in table["piece"]:
            texts = unpacked_piece(piece)
            rows.append(texts.select(["doc_id", "held_out"]))
            for text in texts["text"]:
                words = tokens(text.as_py())
                part = np.empty(len(words) + 2, np.int32)
                part[0], part[-1] = self.start, self.end
                part[1:-1] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                parts.append(part)
                sizes.append(len(part))
        self.rows = pa.concat_tables(rows)
        self.tokens = np.concatenate(parts)  # each text between START and END
        self.sizes = np.array(sizes, np.int64)
        self.trains = np.repeat(~np.array(self.rows["held_out"].to_pylist(), bool), self.sizes)
        self.k = k = len(number)
        digests = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in number])
        del number, parts
        names, places = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        self.words = Listed(names, places, buckets)
        # Pair i ends with token i + 1; no pair ends with START.
        self.inner = np.flatnonzero(self.tokens[1:] != self.start)
        codes = self.tokens[self.inner].astype(np.int64) * k + self.tokens[self.inner + 1]
        codes, self.pair_at = np.unique(codes, return_inverse=True)
        self.first, self.second = np.divmod(codes, k)
        self.pairs = Listed(
            _mixed(names[self.first]) ^ _mixed(places[self.second] + np.uint64(1)),
            _mixed(places[self.first]) ^ _mixed(names[self.second] + np.uint64(1)), buckets,
        )

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the block's training texts have each word (START never) and each pair."""
        words = np.bincount(self.tokens[self.trains], minlength=self.k)
        words[self.start] = 0
        return words, np.bincount(self.pair_at[self.trains[self.inner]], minlength=len(self.first))


def added(keys: list[np.ndarray], *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each key, and the sums by number of the values that stand beside the keys."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for v in values:
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, v)
        sums.append(total)
    return at, sums


class Weights(dict):
    """The root's weights; all words outside have the same one."""

    unknown = 0.0

    def __missing__(self, word: bytes) -> float:
        return self.unknown


class Backoff:
    """The automaton of a whole model in memory, which blocks hold in parts.  State 0 is the root; state i + 1 is behind frequent word i or, last, before a text."""

    def __init__(self, frequent: dict[bytes, int], pairs: dict[int, int], n_docs: int, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.counts = frequent
        words = list(frequent)
        k = len(words)
        self.start = k + 1
        self.state_of = {w: i + 1 for i, w in enumerate(words)}
        self.arcs: dict[int, dict[bytes, float]] = defaultdict(dict)
        self.fail: dict[int, float] = {}
        for code, n in pairs.items():
            first, second = divmod(code, k + 1)
            context = n_docs if first == k else frequent[words[first]]
            self.arcs[first + 1][words[second]] = (n - DISCOUNT) / context
        for state, arcs in self.arcs.items():
            rest = max(1.0 - math.fsum(arcs.values()), 1e-12)
            self.fail[state] = math.log10(rest)
            for word, share in arcs.items():
                arcs[word] = math.log10(share + rest * self.share(frequent[word]))
        # Words without arcs lead to the root at once.
        self.state_of = {w: s for w, s in self.state_of.items() if s in self.arcs}
        if self.start not in self.arcs:
            self.start = 0

    def share(self, count: int) -> float:
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def score(self, sequence: list[bytes], unigram: dict[bytes, float]) -> float:
        """The log10 probability of a text; ``unigram`` has the root's weights."""
        arcs, fail, state_of = self.arcs, self.fail, self.state_of
        state, score = self.start, 0.0
        for word in sequence:
            if state:
                weight = arcs[state].get(word)
                score += fail[state] + unigram[word] if weight is None else weight
            else:
                score += unigram[word]
            state = state_of.get(word, 0)
        return score


COUNTED = "bucket long, block long, word_n binary, pair_n binary, total long, distinct long"


class Counts:
    """What the buckets' answers of the first round say about a block; ``mine`` marks the pairs it owns."""

    def __init__(self, block: Block, rows: list[dict], min_share: float):
        self.total, self.distinct = sum(r["total"] for r in rows), sum(r["distinct"] for r in rows)
        self.words = block.words.restored({r["bucket"]: r["word_n"] for r in rows})
        pairs = block.pairs.restored({r["bucket"]: r["pair_n"] for r in rows})
        self.pairs, self.mine = pairs >> 1, (pairs & 1).astype(bool)
        self.kept = (self.pairs > 0) & (self.pairs >= min_share * self.total)


def lm_score(docs: DataFrame, folds: int = 5, held_fold: int = 1, min_share: float = 0.0,
             block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: fold, token counts, unigram and backoff scores.

    ``mean_score`` is the score by token; ``elsewhere`` the share of the text's
    pairs that training texts other than this row have too: 1 for a text that
    training has twice, or once if the row itself is held out.
    """
    held = F.pmod(checksum(id_col), F.lit(folds)) == held_fold
    rows = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), utf8(text_col).alias("text")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Blocks are dealt by a hash of id and text, so that their number follows the bytes and neither a source nor rows without
    # an id are hot.
    n = max(1, math.ceil(size / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    blocks = dealt.mapInArrow(lean(pieces), "block long, piece binary").groupBy("block")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, n)
        words, pairs = block.training()
        release_memory()
        return pa.table({
            "bucket": pa.array(range(n), pa.int64()), "block": pa.array([key[0].as_py()] * n, pa.int64()),
            "words": [packed_keys(x) for x in block.words.slices()], "word_n": [packed(x) for x in block.words.slices(words)],
            "pairs": [packed_keys(x) for x in block.pairs.slices()], "pair_n": [packed(x) for x in block.pairs.slices(pairs)],
        })

    def answer(table: pa.Table) -> pa.Table:
        words = [unpacked_keys(x) for x in table["words"].to_pylist()]
        counts = np.concatenate([unpacked(x, len(w)) for x, w in zip(table["word_n"].to_pylist(), words)])
        at, (sums,) = added(words, counts)
        word_n = np.split(sums[at], np.cumsum([len(w) for w in words])[:-1])
        pairs = [unpacked_keys(x) for x in table["pairs"].to_pylist()]
        counts = np.concatenate([unpacked(x, len(p)) for x, p in zip(table["pair_n"].to_pylist(), pairs)])
        at, (pair_sums,) = added(pairs, counts)
        # The first block that trains on a pair owns it.
        trained = np.flatnonzero(counts)
        _, once = np.unique(at[trained], return_index=True)
        flagged = pair_sums[at] * 2
        flagged[trained[once]] += 1
        pair_n = np.split(flagged, np.cumsum([len(p) for p in pairs])[:-1])
        return pa.table({
            "bucket": table["bucket"], "block": table["block"],
            "word_n": [packed(x) for x in word_n], "pair_n": [packed(x) for x in pair_n],
            "total": pa.array([int(sums.sum())] * len(words), pa.int64()),
            "distinct": pa.array([int(np.count_nonzero(sums))] * len(words), pa.int64()),
        })

    asked = blocks.applyInArrow(ask, "bucket long, block long, words binary, word_n binary, pairs binary, pair_n binary")
    counted = asked.groupBy("bucket").applyInArrow(answer, COUNTED)

    def ask_starts(key: tuple, table: pa.Table, counted: pa.Table) -> pa.Table:
        block = Block(table, n)
        counts = Counts(block, counted.to_pylist(), min_share)
        own = counts.mine & counts.kept
        release_memory()
        pairs = np.bincount(block.first[own], minlength=block.k)
        mass = np.bincount(block.first[own], counts.pairs[own], minlength=block.k).astype(np.int64)
        return pa.table({
            "bucket": pa.array(range(n), pa.int64()), "block": pa.array([key[0].as_py()] * n, pa.int64()),
            "words": [packed_keys(x) for x in block.words.slices()], "n_pairs": [packed(x) for x in block.words.slices(pairs)],
            "mass": [packed(x) for x in block.words.slices(mass)],
        })

    def answer_starts(table: pa.Table) -> pa.Table:
        words = [unpacked_keys(x) for x in table["words"].to_pylist()]
        given = [
            np.concatenate([unpacked(x, len(w)) for x, w in zip(table[c].to_pylist(), words)]) for c in ("n_pairs", "mass")
        ]
        at, (pairs, mass) = added(words, *given)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        return pa.table({
            "bucket": table["bucket"], "block": table["block"],
            "n_pairs": [packed(x) for x in np.split(pairs[at], cuts)], "mass": [packed(x) for x in np.split(mass[at], cuts)],
        })

    asked = blocks.cogroup(counted.groupBy("block")).applyInArrow(
        ask_starts, "bucket long, block long, words binary, n_pairs binary, mass binary"
    )
    started = asked.groupBy("bucket").applyInArrow(answer_starts, "bucket long, block long, n_pairs binary, mass binary")
    answers = counted.unionByName(started, allowMissingColumns=True)

    def score(table: pa.Table, answered: pa.Table) -> pa.Table:
        block = Block(table, n)
        told = answered.to_pylist()
        counts = Counts(block, [r for r in told if r["word_n"] is not None], min_share)
        told = [r for r in told if r["n_pairs"] is not None]
        n_pairs = block.words.restored({r["bucket"]: r["n_pairs"] for r in told})
        mass = block.words.restored({r["bucket"]: r["mass"] for r in told})
        share = (counts.words + 0.5) / (counts.total + 0.5 * (counts.distinct + 1))
        context = counts.words.copy()
        context[block.start] = counts.words[block.end]
        context = np.maximum(context, 1)  # a word without a count starts no pair
        rest = np.where(n_pairs > 0, np.maximum(1 - (mass - DISCOUNT * n_pairs) / context, 1e-12), 1.0)
        arcs = np.where(counts.kept, (counts.pairs - DISCOUNT) / context[block.first], 0.0)
        # An arc of the automaton, or the failure arc and the root's weight.
        weights = np.log10(arcs + rest[block.first] * share[block.second])[block.pair_at]
        roots = np.log10(share)[block.tokens[block.inner + 1]]
        known = (counts.words > 0)[block.tokens[block.inner + 1]]
        ends = np.cumsum(block.sizes - 1)
        starts = ends - (block.sizes - 1)
        # How often a text itself has each of its pairs: the rest of a pair's count is from other texts.
        pair_at = block.pair_at
        keys = np.repeat(np.arange(len(block.sizes)), block.sizes - 1) * max(1, len(block.first)) + pair_at
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
        times = np.diff(np.append(np.flatnonzero(new), len(keys)))
        own = np.empty(len(keys), np.int64)
        own[order] = np.repeat(times, times)
        del keys, order, new, times
        elsewhere = counts.pairs[pair_at] > np.where(block.trains[block.inner], own, 0)
        spans = list(zip(starts.tolist(), ends.tolist()))
        release_memory()
        return pa.table({
            "doc_id": block.rows["doc_id"], "held_out": block.rows["held_out"], "n_tokens": pa.array(block.sizes - 1, pa.int64()),
            "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
            "train_tokens": pa.array([counts.total] * len(spans), pa.int64()),
            "base_score": pa.array([float(roots[a:b].sum()) for a, b in spans], pa.float64()),
            "score": pa.array([float(weights[a:b].sum()) for a, b in spans], pa.float64()),
            "mean_score": pa.array([float(weights[a:b].sum()) / (b - a) for a, b in spans], pa.float64()),
            "elsewhere": pa.array(np.add.reduceat(elsewhere.astype(np.int64), starts) / (ends - starts), pa.float64()),
        })

    return blocks.cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "mean_score double, elsewhere double",
    )
