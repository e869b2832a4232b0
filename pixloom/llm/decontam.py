"""Benchmark decontamination by spaced seeds.

A passage is a stretch of a document that stands against an item word by word,
with at least ``min_overlap`` equal words (or the whole of a shorter item) that
make up at least ``min_share`` of it.

Each of the fixed ``MASKS`` takes some words of a short window and ignores the
others, so that replaced words there don't matter.  No stretch of ten equal words
or more of which a quarter or less are replaced escapes all of them, of whatever
length (a test goes through all patterns); for smaller overlaps or shares whole
items of fewer words and lower recall remain.  The masked words of the benchmark
are hashed into a table of seeds, those of the documents are hashed where they
lie, and a filter of the table's hashes, of fixed size, lets hardly any others
pass.  The two tables are joined on the hash: a hit names a text, an item and an
offset between them.  Texts with hits are read again, and along every offset the
stretch with the most equal words that keeps the share is found by prefix sums.

Nothing of the benchmark but the filter (``FILTER_BITS``) is held in one place.
Hits are of distinct texts as far as a task meets them, so a passage that a third
of the documents hold costs one lookup a word and an evenly dealt row for each
place.  In a run of one repeated hash a hit counts only where one of the two
sides begins its run: every offset has such a hit, and two runs don't multiply.

Defined cases: null text has no words and is clean; items of fewer than ten
words are sought as a whole, items without words never match; an item without
item_id is sought like the others and reported with a null id; items of one id
are reported once, with the longest match; of equal matches the one that starts
first is reported; repeated documents give repeated results; empty tables give
empty tables; columns beside ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, small_batches, utf8, written
from pixloom.llm.jaccard_join import long_word_hashes

#: The places of a window that each mask looks at.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 2, 3, 8), (0, 1, 2, 3, 4))
WHOLE = 10  # items of fewer words are sought as a whole
FILTER_BITS = 28  # of the filter, as a power of two, at most: 32 MB
CHUNK = 1 << 14  # bytes in one row of the filter
GROUP_BYTES = 1 << 20  # text that is hashed at a time
BROADCAST_TEXTS = 500_000  # keys of 8 bytes; beyond that the join shuffles

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def coded(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words."""
    plain = text.translate(_NORMAL)
    return long_word_hashes(plain)[0] if plain.strip() else np.zeros(0, np.uint64)


def seeds_of(codes: np.ndarray, text: np.ndarray, masks: Iterable[Sequence[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and place of every window of each mask; ``text`` numbers the text of each word, windows stay inside one."""
    for mask in masks:
        n = max(0, len(codes) - mask[-1])
        h = np.full(n, 1 + 16 * len(mask) + mask[-1], np.uint64)
        for o in mask:
            h = (h ^ codes[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(text[:n] == text[mask[-1] : mask[-1] + n])
        yield h[at], at


def cells_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter."""
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def _begins(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each window does not follow one of equal hash."""
    return ~np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1] + 1)))


def seed_table(items: DataFrame) -> DataFrame:
    """hash, item (its key), place, begins, of all windows of the items (item, codes)."""
    names = ["hash", "item", "place", "begins"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 100):
            for item, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.frombuffer(codes, np.uint64)
                masks = MASKS if len(codes) >= WHOLE else [range(len(codes))]
                for hashes, at in seeds_of(codes, np.zeros(len(codes), np.int8), masks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), item, np.int64)), pa.array(at), pa.array(_begins(hashes, at))], names=names
                    )

    return items.mapInArrow(lean(run), "hash long, item long, place long, begins boolean")


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that are set at both places of every seed's hash, and their number as a power of two."""
    bits = min(FILTER_BITS, max(20, (16 * seeds.count()).bit_length()))
    size = CHUNK * 8

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = np.unique(np.concatenate(cells_of(batch.column(0).to_numpy().view(np.uint64), bits)))
            chunk = (cells // np.uint64(size)).astype(np.int64)
            for k in np.unique(chunk).tolist():
                own = chunks.setdefault(k, np.zeros(CHUNK, np.uint8))
                inside = (cells[chunk == k] % np.uint64(size)).astype(np.int64)
                np.bitwise_or.at(own, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        if chunks:
            yield pa.RecordBatch.from_pydict({"chunk": list(chunks), "set": [c.tobytes() for c in chunks.values()]})

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.uint8)
        for batch in batches:
            for part in batch.column("set").to_pylist():
                total |= np.frombuffer(part, np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": [key[0].as_py()], "set": [total.tobytes()]})

    kind = "chunk long, set binary"
    out = np.zeros(((1 << bits) // size, CHUNK), np.uint8)
    for r in seeds.select("hash").mapInArrow(mark, kind).groupBy("chunk").applyInArrow(join, kind).collect():
        out[r["chunk"]] = np.frombuffer(r["set"], np.uint8)
    return out.reshape(-1), bits


def text_hits(texts: DataFrame, shared: object, bits: int, short: Sequence[int]) -> DataFrame:
    """hash, key, at, begins of the windows of (key, text) whose hash passes the filter; a task looks at equal keys once."""
    masks = [*MASKS, *(range(n) for n in short)]

    def passed(hashes: np.ndarray) -> np.ndarray:
        first, second = cells_of(hashes, bits)
        bitmap = shared.value
        ok = np.flatnonzero((bitmap[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1)
        second = second[ok]
        return ok[((bitmap[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def hits() -> Iterator[pa.RecordBatch]:
            codes = [coded(t) for t in group]
            sizes = [len(c) for c in codes]
            starts = np.cumsum([0, *sizes[:-1]])
            text = np.repeat(np.arange(len(codes)), sizes)
            for hashes, at in seeds_of(np.concatenate(codes), text, masks):
                ok = passed(hashes)
                own = text[at[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[ok].view(np.int64)), pa.array(np.array(keys, np.int64)[own]), pa.array(at[ok] - starts[own]),
                     pa.array(_begins(hashes, at)[ok] | (at[ok] == starts[own]))], names=["hash", "key", "at", "begins"],
                )

        group: list[bytes] = []
        keys: list[int] = []
        size = 0
        for batch in small_batches(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                group.append(text.as_py())
                keys.append(key)
                size += len(group[-1])
                if size > GROUP_BYTES:
                    yield from hits()
                    group, keys, size = [], [], 0
            if len(seen) > 1 << 20:
                seen.clear()
        if group:
            yield from hits()

    return texts.mapInArrow(lean(run), "hash long, key long, at long, begins boolean")


def best_stretch(own: np.ndarray, codes: np.ndarray, offset: int, min_share: float) -> tuple[int, int, int]:
    """Of one alignment: equal words, start and end in the document of the stretch with the most that keeps the share."""
    start, stop = max(0, offset), min(len(codes), offset + len(own))
    equal = codes[start:stop] == own[start - offset : stop - offset]
    # A stretch keeps the share if the surplus at its end is no less than at its start: for each end, the first such start.
    count = np.concatenate(([0], np.cumsum(equal)))
    surplus = count - min_share * np.arange(len(count))
    first = np.searchsorted(-np.minimum.accumulate(surplus), -surplus - 1e-9)
    most = count - count[first]
    end = int(np.argmax(most))
    if not most[end]:
        return 0, start, start
    begin = int(first[end])
    begin += int(np.argmax(equal[begin:end]))
    return int(most[end]), start + begin, start + end


def matches_of(codes: np.ndarray, lines: Iterable[tuple[int | None, np.ndarray, int]], min_overlap: int, min_share: float) -> list[dict]:
    """The best stretch for each item id, of the alignments (item id, the item's words, offset)."""
    best: dict[int | None, tuple[int, int, int]] = {}
    for name, own, offset in lines:
        equal, start, stop = best_stretch(own, codes, offset, min_share)
        if equal >= min(min_overlap, len(own)) and (name not in best or (equal, -start) > (best[name][0], -best[name][1])):
            best[name] = (equal, start, stop)
    named = sorted(best.items(), key=lambda x: (x[0] is not None, x[0]))
    return [{"item_id": n, "equal_words": e, "first_word": a, "stop_word": b} for n, (e, a, b) in named]


MATCH = "struct<item_id: long, equal_words: long, first_word: long, stop_word: long>"
_MATCH = pa.struct([(n, pa.int64()) for n in ("item_id", "equal_words", "first_word", "stop_word")])


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a key), item_id and codes of the distinct items that have words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            codes = [coded(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["item", "item_id", "codes"])

    rows = bounded_batches(benchmark).select(F.col(id_col).cast("long").alias("item_id"), utf8(text_col).alias("text")).distinct()
    return rows.select(F.xxhash64("item_id", "text"), "item_id", "text").mapInArrow(lean(run), "item long, item_id long, codes binary").where("octet_length(codes) > 0")


def alignments(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """key and lines (item_id, codes, offsets) of the texts (key, text) that share a seed with an item."""
    items = written(items_of(benchmark, item_col, item_text_col))
    sizes = items.where(F.octet_length("codes") < 8 * WHOLE).select((F.octet_length("codes") / 8).cast("int").alias("n")).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # nine at most
    seeds = written(seed_table(items.select("item", "codes")))
    bitmap, bits = seed_filter(seeds)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    hits = text_hits(texts, shared, bits, short).withColumnRenamed("begins", "starts")
    lines = hits.join(seeds, "hash").where("begins OR starts").select("key", "item", (F.col("at") - F.col("place")).alias("offset")).distinct()
    of_item = lines.groupBy("key", "item").agg(F.collect_list("offset").alias("offsets"))
    return of_item.join(items, "item").groupBy("key").agg(F.collect_list(F.struct("item_id", "codes", "offsets")).alias("lines"))


def found_in(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
             min_overlap: int, min_share: float) -> DataFrame:
    """key (of the text), doc_id and passages of the documents that hold any."""
    rows = bounded_batches(docs).select(F.xxhash64(utf8(text_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    lines = written(alignments(rows.select("key", "text"), benchmark, item_col, item_text_col))
    keys = lines.select("key")
    met = rows.join(F.broadcast(keys) if lines.count() <= BROADCAST_TEXTS else keys, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 100):
            found = []
            for key, doc, text, lines in zip(*(batch.column(i) for i in range(4))):
                known = ((x["item_id"], np.frombuffer(x["codes"], np.uint64), offset) for x in lines.as_py() for offset in x["offsets"])
                if passages := matches_of(coded(text.as_py()), known, min_overlap, min_share):
                    found.append((key.as_py(), doc.as_py(), passages))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.list_(_MATCH)))], names=["key", "doc_id", "passages"]
                )

    return met.join(lines, "key").select("key", "doc_id", "text", "lines").mapInArrow(lean(run), f"key long, doc_id long, passages array<{MATCH}>")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = 10, min_share: float = 0.75) -> DataFrame:
    """doc_id and its benchmark passages, for the documents that hold any."""
    found = found_in(docs, benchmark, id_col, text_col, item_col, item_text_col, min_overlap, min_share)
    return found.select(F.col("doc_id").alias(id_col), "passages")


def without_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = 10, min_share: float = 0.75) -> DataFrame:
    """The documents that hold no passage, decided by text: rows without an id too."""
    found = written(found_in(docs, benchmark, id_col, text_col, item_col, item_text_col, min_overlap, min_share).select("key").distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    return docs.join(found, F.xxhash64(utf8(text_col)) == found["key"], "left_anti")
