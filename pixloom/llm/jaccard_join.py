"""N-gram Jaccard join of documents by grouped prefixes, and the components of its links.

A document's set is its distinct word shingles.  Two documents link when the
Jaccard similarity of their sets is at least ``percent`` per cent.

1.  A sketch counts all shingles of the table in ``CELLS`` cells, an array of
    fixed size.  Cell count, then hash, is one global order of shingles with
    frequent ones at the end; any order gives the same links, this one keeps
    shared passages out of the prefixes.
2.  Each set gives its size, a digest, its prefix (the first
    ``n - ceil(t n) + 1`` shingles in that order; two linked sets share one) and
    a signature: parities of its shingles by hash, about two bits a shingle.
    This is written once, and all that follows reads it.
3.  Equal sets become one class (its smallest document stands for it), classes
    of equal prefix and size one group.  Groups, not documents, are dealt out
    by prefix shingle, each once a task however many copies it has.
4.  A pair of groups in a bucket stays if it passes the size filter and the
    positional filter: what can still follow the shared shingle on both sides
    suffices for a link.
5.  The pairs that stay are expanded to their members and verified, first by
    the signatures (sets that differ in d shingles have signatures that differ
    in d bits at most, so no link is lost), then on the full sets.

Steps 4 and 5 are done twice when only components are asked for.  Round one pairs
a group with ``OFFERED`` hubs of its bucket that pass the filters, for about
``SAMPLED`` shingles of a prefix, and a group's members with its first one:
linear in the buckets, and a cluster of copies of any size becomes one component
by it, or nearly so.  Round two takes all pairs, but only between different
components of round one, since others can't change the result.  So every link
between two components is found, and no cluster is expanded into all its pairs.
``jaccard_links`` has no round one and gives all links.

Buckets stream through sorted partitions.  A bucket's rows are held only as far
as they can be the smaller side of a pair yet to come.  Verification works on
blocks whose sets have a bounded size; the pairs of one document with very many
partners go to several blocks.  Sets are compared by 64-bit shingle hashes.

Defined cases: null or wordless text has an empty set and links with nothing;
fewer words than a shingle are one shingle; equal texts link; a row without
doc_id takes the component of its text's class if a document with a doc_id has
an equal set, else null; a doc_id on several texts stands for all of them; an
empty table gives an empty table, repeated rows repeated results; columns
beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, pieces, release_memory, small_batches, unpacked_piece, utf8, written
from pixloom.llm.components import connected_components

CELLS = 1 << 20
CHUNK = 1 << 14  # cells in one row of the sketch
HUBS = 16  # groups of a bucket that others are paired with in round one
OFFERED = 4  # of them, those that a group is paired with
SAMPLED = 16  # shingles of a prefix that round one looks at, about
SMALL_BUCKET = 32  # rows up to which buckets are compared many at a time
BATCH_BYTES = 1 << 20  # text that is hashed at a time
BLOCK_BYTES = 8 << 20  # sets that are verified at a time
BLOCK_PAIRS = 400  # pairs around one hub that are verified at a time
BROADCAST_IDS = 500_000  # ids of 16 bytes: 8 MB at most; beyond that the join shuffles
KEPT_GROUPS = 1 << 20  # groups that a task remembers to have dealt out

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CUT = re.compile(rb"[\x20\x09-\x0d]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many each text has."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    inner = np.flatnonzero(~space)
    place = np.arange(len(inner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _POWER, np.uint64))
    sums = np.add.reduceat(_BYTE[data[inner]] * powers[place], np.cumsum(lengths) - lengths)
    return _mix(sums), counts


def long_word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same of one text, a stretch at a time; stretches end at white space."""
    parts, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + BATCH_BYTES)
        stop = cut.start() if cut else len(text)
        parts.append(_word_hashes([text[at:stop]])[0])
        at = stop
    hashes = np.concatenate(parts)
    return hashes, np.array([len(hashes)])


def shingle_sets(texts: Iterable[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""

    def sets_of(hashes: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        shingles = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            shingles = shingles * _POWER + hashes[k : k + len(shingles)]
        shingles, at = _mix(shingles), 0
        for n in counts.tolist():
            if n >= words:
                yield np.unique(shingles[at : at + n - words + 1])
            else:  # the whole sequence, told apart from full shingles by its length
                whole = np.full(min(1, n), 1000 + n, np.uint64)
                for h in hashes[at : at + n]:
                    whole = _mix(whole * _POWER + h)
                yield whole
            at += n

    batch: list[bytes] = []
    size = 0
    for text in texts:
        if batch and size + len(text) > BATCH_BYTES:
            yield from sets_of(*_word_hashes(batch))
            batch, size = [], 0
        if len(text) > BATCH_BYTES:
            yield from sets_of(*long_word_hashes(text))
        else:
            batch.append(text)
            size += len(text)
    if batch:
        yield from sets_of(*_word_hashes(batch))


def needed(n: int | np.ndarray, percent: int):
    """Size of the overlap without which a set of n elements has no partner."""
    return -(-percent * n // 100)


def least_common(n, m, percent: int):
    """Size of the overlap from which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def sketch(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """How many (document, shingle) pairs of the table fall in each cell."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(CELLS, np.uint32), False
        for batch in small_batches(batches):
            sets = list(shingle_sets(batch.column(0).to_pylist(), words))
            if sets:
                seen = True
                total += np.bincount(cells_of(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
        if seen:
            chunks = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_pydict({"chunk": list(range(len(chunks))), "counts": [c.tobytes() for c in chunks]})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, np.uint32)
        yield pa.RecordBatch.from_pydict({"chunk": [key[0].as_py()], "counts": [total.tobytes()]})

    rows = (
        bounded_batches(docs).select(utf8(text_col)).mapInArrow(lean(count), "chunk long, counts binary")
        .groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()
    )
    total = np.zeros((CELLS // CHUNK, CHUNK), np.int64)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return total.reshape(-1)


def signature(own: np.ndarray) -> bytes:
    """Parities of a set's hashes by their low bits: a power of two of bits, two a shingle at least."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(p: bytes, q: bytes) -> int:
    """In how many shingles two sets differ at least, by their signatures."""
    a, b = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    if len(a) < len(b):  # parities of fewer bits are those of more, folded
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def described(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, digest of the set, gid (a hash of size and prefix), prefix (shingle hashes in global order), signature."""
    cells = docs.sparkSession.sparkContext.broadcast(sketch(docs, words, text_col))
    names = ["doc_id", "n", "digest", "gid", "prefix", "signature"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, digests, firsts, groups, marks = [], [], [], [], []
            for own in shingle_sets(batch.column(1).to_pylist(), words):
                n = len(own)
                order = np.argsort(cells.value[cells_of(own)], kind="stable")  # equal counts: by hash
                first = own[order[: n - needed(n, percent) + 1 if n else 0]]
                sizes.append(n)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                firsts.append(first.view(np.int64))
                group = hashlib.blake2b(first.tobytes(), digest_size=8, salt=n.to_bytes(8, "little")).digest()
                groups.append(int.from_bytes(group, "little", signed=True))
                marks.append(signature(own))
            lengths = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            values = pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lengths), values), pa.array(marks, pa.binary())],
                names=names,
            )

    return bounded_batches(docs).select(F.col(id_col).cast("long"), utf8(text_col)).mapInArrow(
        lean(run), "doc_id long, n long, digest binary, gid long, prefix array<long>, signature binary"
    )


def dealt_out(groups: DataFrame) -> DataFrame:
    """token, n, pos, gid of each group's prefix; a task deals a group out once (or again, after very many others)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches):
            new = []
            for i, gid in enumerate(batch.column(0).to_pylist()):
                if gid not in seen:
                    seen.add(gid)
                    new.append(i)
            if len(seen) > KEPT_GROUPS:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            pos = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [lists.flatten(), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)), pa.array(pos.astype(np.int32)),
                 pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["token", "n", "pos", "gid"],
            )

    return groups.select("gid", "n", "prefix").mapInArrow(lean(run), "token long, n long, pos int, gid long")


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])


def _shared(ordered: DataFrame, percent: int) -> DataFrame:
    """Rows (token, n, pos, gid) of buckets with more than one group, each once; needs rows sorted by token, n and gid.

    Of two linked sets the smaller one (or either, of equal size) has the shared
    shingle among its first n - ceil(2 t n / (1 + t)) + 1: buckets without such
    a row are left out, as far as they lie inside a batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last row of the batch before, if it was the first of its token
        before: np.ndarray | None = None  # the last row of the batch before
        for batch in batches:
            rows = _columns(batch)
            if held is not None:
                rows = np.concatenate((held, rows), axis=1)
            elif before is not None:
                rows = np.concatenate((before, rows), axis=1)
            new = np.concatenate(([True], (rows[[0, 1, 3], 1:] != rows[[0, 1, 3], :-1]).any(axis=0)))
            rows = rows[:, new]
            token = rows[0]
            if not len(token):
                continue
            carried = before is not None and held is None  # the first row has been given out
            same = token[1:] == token[:-1]
            keep = np.concatenate(([carried], same)) | np.concatenate((same, [False]))
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            sizes = np.diff(np.append(starts, len(token)))
            early = np.logical_or.reduceat(rows[2] <= rows[1] - least_common(rows[1], rows[1], percent), starts)
            early[[0, -1]] = True  # these may go on in other batches
            keep &= np.repeat(early, sizes)
            alone = not keep[-1]
            before, held = rows[:, -1:], rows[:, -1:] if alone else None
            if carried:
                keep[0] = False
            token, n, pos, gid = rows[:, keep]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n), pa.array(pos.astype(np.int32)), pa.array(gid)], names=["token", "n", "pos", "gid"])

    return ordered.mapInArrow(lean(run), "token long, n long, pos int, gid long")


def _pairs_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"x": [p[0] for p in pairs], "y": [p[1] for p in pairs]}, schema=pa.schema([("x", pa.int64()), ("y", pa.int64())]))


def hub_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Round one: groups (x, y), each with hubs of its bucket that pass the size and positional filters.

    Rows come by position, so that hubs are groups with few shingles before the
    shared one: those that are nearest to what a family of copies has in common.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        token = None
        hubs: list[tuple[int, int, int]] = []
        for batch in batches:
            rows = _columns(batch)
            # The same shingles for sets of nearly equal size: those with the smallest hashes of their own.
            share = _mix(rows[0].view(np.uint64) + np.uint64(1)).astype(np.float64) / 2.0**64
            rows = rows[:, share * (rows[1] - needed(rows[1], percent) + 1) < SAMPLED]
            for key, n, pos, gid in rows.T.tolist():  # a bucket is never held
                if key != token:
                    token, hubs = key, []
                met = 0
                for m, at, hub in hubs:
                    if hub != gid and min(n - pos, m - at) >= least_common(n, m, percent) and 100 * min(n, m) >= percent * max(n, m):
                        pairs.add((gid, hub) if gid > hub else (hub, gid))
                        met += 1
                        if met == OFFERED:
                            break
                if met < OFFERED and len(hubs) < HUBS and pos <= n - least_common(n, n, percent):
                    hubs.append((n, pos, gid))
            if len(pairs) >= 200_000:
                yield _pairs_batch(pairs)
                pairs = set()
        if pairs:
            yield _pairs_batch(pairs)

    return buckets.sortWithinPartitions("token", "pos", "n", "gid").mapInArrow(lean(run), "x long, y long").distinct()


def _admit(out: set[tuple[int, int]], left: np.ndarray, right: np.ndarray, percent: int, also=True) -> None:
    """Add the pairs (larger, smaller group) of rows that pass the size and positional filters; sizes of left ones are not larger."""
    n, m = left[1], right[1]
    room = np.minimum(n - left[2], m - right[2])
    differ = (left[4] != right[4]) | (left[5] + right[5] > 0)
    fits = (room >= least_common(n, m, percent)) & differ & (needed(m, percent) <= n) & (left[3] != right[3]) & also
    a, b = np.broadcast_to(left[3], fits.shape)[fits], np.broadcast_to(right[3], fits.shape)[fits]
    out.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist()))


def crossing(batches: Iterable[np.ndarray], percent: int) -> Iterator[set[tuple[int, int]]]:
    """Pairs of groups (rows token, n, pos, gid, comp, mixed; sorted by token and n) that may link across components.

    Small buckets are compared many at a time, by the distance of two rows.
    Others, and those at the end of a batch, are taken batch by batch against
    the rows so far that can be the smaller side of a pair.
    """
    out: set[tuple[int, int]] = set()
    held = np.zeros((6, 0), np.int64)  # of the bucket that the last batch ended with

    def meet(rows: np.ndarray) -> None:
        nonlocal held
        held = held[:, held[1] >= needed(rows[1, 0], percent)]
        early = rows[:, rows[2] <= rows[1] - least_common(rows[1], rows[1], percent)]
        known = held.shape[1]
        order = np.flatnonzero(rows[2] <= rows[1] - least_common(rows[1], rows[1], percent))
        held = np.concatenate((held, early), axis=1)
        place = np.concatenate((np.full(known, -1), order))
        step = max(1, 1_000_000 // max(1, held.shape[1]))
        for at in range(0, rows.shape[1], step):
            part = rows[:, at : at + step]
            behind = place[None, :] < np.arange(at, at + part.shape[1])[:, None]
            _admit(out, held[:, None, :], part[:, :, None], percent, behind)

    token = None
    for rows in batches:
        if not rows.shape[1]:
            continue
        starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        mixed = (np.minimum.reduceat(rows[4], starts) != np.maximum.reduceat(rows[4], starts)) | (np.maximum.reduceat(rows[5], starts) > 0)
        large = sizes > SMALL_BUCKET
        large[-1] = True
        if rows[0, 0] == token:
            large[0] = True
        for i in np.flatnonzero(large).tolist():
            goes_on = i == 0 and rows[0, 0] == token
            if not goes_on:
                held = np.zeros((6, 0), np.int64)
            if mixed[i] or goes_on or i == len(starts) - 1:
                meet(rows[:, starts[i] : starts[i] + sizes[i]])
        token = rows[0, -1]
        small = rows[:, np.repeat(mixed & ~large, sizes)]
        for distance in range(1, SMALL_BUCKET):
            left, right = small[:, :-distance], small[:, distance:]
            same = left[0] == right[0]
            if not same.any():
                break
            _admit(out, left[:, same], right[:, same], percent)
        if len(out) >= 200_000:
            yield out
            out = set()
    if out:
        yield out


def crossing_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Round two: groups (x, y) of different components, or of several, in a bucket that pass the size and positional filters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_pairs_batch, crossing(map(_columns, batches), percent))

    return (
        buckets.repartition("token").sortWithinPartitions("token", "n", "gid")
        .select("token", "n", "pos", "gid", "comp", "mixed").mapInArrow(lean(run), "x long, y long").distinct()
    )


def expanded(pairs: DataFrame, members: DataFrame, percent: int, across: Column | None = None) -> DataFrame:
    """Documents (x, y) with sizes (nx, ny) of group pairs, for the members whose signatures admit a link."""

    def side(name: str) -> DataFrame:
        return members.select(
            F.col("gid").alias(name), F.col("doc").alias(f"{name}_doc"), F.col("n").alias(f"n{name}"),
            F.col("signature").alias(f"{name}_sig"), *([F.col("comp").alias(f"{name}_comp")] if across is not None else []),
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 10_000):
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = n + m - 2 * least_common(n, m, percent)
            found = [apart(p.as_py(), q.as_py()) for p, q in zip(batch.column(4), batch.column(5))]
            some = batch.select([0, 1, 2, 3]).filter(pa.array(np.array(found, np.int64) <= most))
            yield pa.RecordBatch.from_arrays(some.columns, names=["x", "y", "nx", "ny"])

    met = pairs.join(side("x"), "x").join(side("y"), "y")
    if across is not None:
        met = met.where(across)
    met = met.where(
        (F.col("x_doc") != F.col("y_doc")) & (F.greatest("nx", "ny") * percent <= F.least("nx", "ny") * 100)
    )
    return met.select("x_doc", "y_doc", "nx", "ny", "x_sig", "y_sig").mapInArrow(lean(run), "x long, y long, nx long, ny long")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = np.concatenate((p, q))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(p) + len(q) - common)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents (x, y) that link, as edges (a, b), by their full sets.

    A block holds the texts of its pairs once each, compressed.  The pairs of an x
    go to the block of its smallest partner, so that a family shares its hubs'
    texts; a partner whose pairs have large sets is salted by x, and an x whose
    own partners have large sets by partner.
    """
    spark = docs.sparkSession
    pairs = written(pairs.groupBy("x", "y").agg(F.max("nx").alias("nx"), F.max("ny").alias("ny")))
    size = F.lit(8) * F.col("ny")
    first = pairs.groupBy("x").agg(F.min("y").alias("hub"), F.count("*").alias("n"), (F.sum(size) + 8 * F.max("nx")).alias("bytes"))
    total = first.agg(F.sum("bytes")).first()[0]
    if not total:
        return spark.createDataFrame([], "a long, b long")
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BLOCK_BYTES))
    salts = first.groupBy("hub").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.sum("n") / BLOCK_PAIRS)).alias("salts"))
    placed = first.join(salts, "hub").select("x", "hub", "salts", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts"))
    block = F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("x"), F.col("salts")), F.pmod(F.xxhash64("y"), F.col("parts"))), F.lit(n_blocks))
    dealt = written(pairs.join(placed, "x").select(block.alias("block"), "x", "y"))
    wanted = written(dealt.select("block", F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "doc_id").select("block", "doc_id", "text").mapInArrow(lean(pieces), "block long, piece binary")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for piece in right["piece"]:
            table = unpacked_piece(piece)
            for doc, own in zip(table["doc_id"].to_pylist(), shingle_sets((t.as_py() for t in table["text"]), words)):
                sets.setdefault(doc, []).append(own)
        pairs = zip(left["x"].to_pylist(), left["y"].to_pylist())
        found = [(x, y) for x, y in pairs if any(linked(p, q, percent) for p in sets[x] for q in sets[y])]
        del sets
        release_memory()
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(check, "a long, b long")


class Join:
    """What both rounds work on: sets described once, classes, groups and shared buckets."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.words, self.percent = words, percent
        self.source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
        self.made = written(described(self.source, words, percent, "doc_id", "text"))
        full = self.made.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = written(full.groupBy("n", "digest").agg(
            F.min("doc_id").alias("doc"), F.first("gid").alias("gid"), F.first("signature").alias("signature")
        ))
        entries = dealt_out(full).repartition("token").sortWithinPartitions("token", "n", "gid")
        self.buckets = written(_shared(entries, percent))

    def verified(self, pairs: DataFrame) -> DataFrame:
        return verified(pairs, self.source, self.words, self.percent)


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between documents that stand for different classes, and doc_id, class_id of every document with a set."""
    join = Join(docs, words, percent, id_col, text_col)
    groups = join.classes.groupBy("gid").agg(F.count("*").alias("size"))
    buckets = join.buckets.withColumns({"comp": F.col("gid"), "mixed": F.lit(0)})
    pairs = crossing_pairs(buckets, percent).unionAll(groups.where("size > 1").select(F.col("gid").alias("x"), F.col("gid").alias("y")))
    found = join.verified(expanded(written(pairs), join.classes, percent))
    links = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return links, join.made.join(join.classes.select("n", "digest", "doc"), ["n", "digest"]).select("doc_id", F.col("doc").alias("class_id"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    join = Join(docs, words, percent, id_col, text_col)
    leaders = join.classes.groupBy("gid").agg(F.min("doc").alias("leader"), F.count("*").alias("size"))
    leading = join.classes.join(leaders.select("gid", F.col("leader").alias("doc")), ["gid", "doc"], "left_semi")
    others = join.classes.join(leaders.where("size > 1"), "gid").where("doc <> leader")
    one = expanded(written(hub_pairs(join.buckets, percent)), leading, percent)
    within = others.select("gid").distinct().select(F.col("gid").alias("x"), F.col("gid").alias("y"))
    first_to_others = expanded(
        within, join.classes.join(leaders.select("gid", F.col("leader").alias("comp")), "gid"), percent, F.col("y_doc") == F.col("y_comp")
    )
    merged = connected_components(written(join.verified(one.unionAll(first_to_others))))
    placed = written(join.classes.join(merged.select(F.col("a").alias("doc"), F.col("b").alias("comp")), "doc", "left").select(
        "gid", "doc", "n", "signature", F.coalesce("comp", "doc").alias("comp")
    ))
    groups = placed.groupBy("gid").agg(F.min("comp").alias("comp"), (F.min("comp") != F.max("comp")).cast("int").alias("mixed"))
    again = groups.where("mixed = 1").select(F.col("gid").alias("x"), F.col("gid").alias("y"))
    two = written(crossing_pairs(join.buckets.join(groups, "gid"), percent).unionAll(again))
    links = merged.unionAll(join.verified(expanded(two, placed, percent, F.col("x_comp") != F.col("y_comp"))))
    final = connected_components(links)
    return (
        join.made.select("doc_id", "n", "digest").join(join.classes.select("n", "digest", "doc"), ["n", "digest"], "left")
        .join(final.select(F.col("a").alias("doc"), "b"), "doc", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("b", "doc", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the smallest id (nulls last).

    Documents are told apart by id and text: of repeated rows one stays, rows
    without an id count as well, and rows without words all stay.
    """
    key = F.xxhash64(utf8(text_col))
    names = [F.col(f"`{c}`") for c in docs.columns]
    groups = jaccard_components(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), words, percent)
    # Written, so that the join below shuffles anew and Spark can split a text that a third of the rows have.
    groups = written(groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key")).groupBy("id", "key").agg(F.count("*").alias("n"))
    placed = written(rows.join(groups, "key"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("best"))
    first = first.select(F.col("best.id").alias("best_id"), F.col("best.key").alias("best_key"), F.lit(True).alias("best"))
    # By id and text, not by component: a component may hold a third of all rows.
    met = placed.join(first, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key")), "left")
    judged = met.withColumn("stays", F.coalesce("best", F.lit(False)))
    others = written(judged.where("NOT stays OR n > 1").select(F.col("id").alias("__id"), F.col("key").alias("__key"), "stays"))

    def known(of: DataFrame) -> tuple[DataFrame, Column]:
        of = F.broadcast(of) if of.count() <= BROADCAST_IDS else of
        return of, (key == of["__key"]) & F.col(id_col).eqNullSafe(of["__id"])

    single = docs.join(*known(others), "left_anti")
    repeated = docs.join(*known(others.where("stays")), "left_semi").withColumn("__key", key).dropDuplicates([id_col, "__key"])
    return single.select(*names).unionAll(repeated.select(*names))
