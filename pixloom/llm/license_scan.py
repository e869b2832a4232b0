"""License scans: an exact set-containment join of text blocks with license templates.

A block is a stretch of consecutive words, wherever lines end, one and a half
times as long as the template: every place of a text starts one.  A template
matches a block that holds at least ``threshold`` of the template's distinct
tokens.  Candidates come from an inverted index on template prefixes: tokens are
put in one global order (document frequency over the whole table, then the
token), and a template of ``m`` tokens that needs ``a = ceil(threshold * m)`` of
them is filed under its first ``m - a + 1`` tokens, of which every block that
matches holds one.  Only the words around such a token go on.  If they are fewer
than ``a`` they cannot match (length filter), nor if fewer than ``a`` of their
template words stand from the first shared token on in the order (positional
filter).  What is left is counted in full, block by block, so the result is the
same as comparing each block with each template.

Matching blocks that overlap are one match: the first with the most tokens.

Templates are a driver-side parameter and travel with the tasks, in lists of at
most ``MAX_TEMPLATE_TOKENS`` tokens; each further list is one more pass over the
rows inside the same tasks.  Documents are only mapped over: no shuffle, so no
key can be hot.

Defined cases: null text is empty text with no words; an empty table gives an
empty table; repeated rows give repeated results; of templates that are equal
both match; a text of any length is scanned whole; columns beside id and text
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, small_batches, utf8

MAX_TEMPLATE_TOKENS = 1_000_000

#: Phrases of the base labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by the label of the method that each one gives.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Maps A-Z to a-z and all that separates words to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


@dataclass(frozen=True)
class Index:
    templates: tuple[tuple[str, tuple[bytes, ...]], ...]  # label, tokens in global order
    needed: tuple[int, ...]  # tokens that a block must hold
    sizes: tuple[int, ...]  # words of a block
    order: dict[bytes, int]  # place of each template token in the global order
    postings: dict[bytes, tuple[tuple[int, int], ...]]  # prefix token: template, position


def build_index(templates: Sequence[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> Index:
    texts = [(label, words(text.encode())) for label, text in templates]
    sets = [(label, set(ws)) for label, ws in texts]
    vocabulary = set().union(*(s for _, s in sets))
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    ordered = tuple((label, tuple(sorted(s, key=order.__getitem__))) for label, s in sets if s)
    needed = tuple(max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s in ordered)
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for k, ((_, tokens), least) in enumerate(zip(ordered, needed)):
        for i, token in enumerate(tokens[: len(tokens) - least + 1]):
            postings.setdefault(token, []).append((k, i))
    sizes = tuple(-(-3 * len(ws) // 2) for _, ws in texts if ws)
    return Index(ordered, needed, sizes, order, {t: tuple(p) for t, p in postings.items()})


def match_blocks(tokens: list[bytes], distinct: set[bytes], index: Index) -> list[tuple[int, int, float]]:
    """(first word, template, containment) of all matches in a text."""
    asked: dict[bytes, list[int]] = {}  # by prefix token: templates that the text is long enough for
    for token in index.postings.keys() & distinct:
        if ks := [k for k, _ in index.postings[token] if len(tokens) >= index.needed[k] and len(distinct) >= index.needed[k]]:
            asked[token] = ks
    places_of: dict[bytes, list[int]] = {token: [] for token in asked}
    if asked:
        for i, token in enumerate(tokens):
            if token in asked:
                places_of[token].append(i)
    near: dict[int, list[int]] = {}  # by template: where its prefix tokens stand
    for token, ks in asked.items():
        for k in ks:
            near.setdefault(k, []).extend(places_of[token])
    found = []
    for k, places in sorted(near.items()):
        template, size, least = index.templates[k][1], index.sizes[k], index.needed[k]
        own = set(template)
        best: tuple[int, int] | None = None  # place and tokens of the match that is being extended
        reach = -1
        for start, stop in around(sorted(places), size, len(tokens)):
            shared = own.intersection(tokens[start:stop])
            if not shared:
                continue
            first = min(map(index.order.__getitem__, shared))
            behind = {t for t in tokens[start:stop] if index.order.get(t, -1) >= first}
            if stop - start < least or len(behind) < least:
                continue
            for at, overlap in counted(tokens, own, start, stop, size):
                if overlap < least:
                    continue
                if best is not None and at < reach:
                    best = (at, overlap) if overlap > best[1] else best
                else:
                    if best is not None:
                        found.append((best[0], k, best[1] / len(template)))
                    best = (at, overlap)
                reach = at + size
        if best is not None:
            found.append((best[0], k, best[1] / len(template)))
    return sorted(found)


def around(places: list[int], size: int, n: int) -> list[tuple[int, int]]:
    """Stretches that hold all blocks of ``size`` words with one of the places in it."""
    out: list[tuple[int, int]] = []
    for p in places:
        start, stop = max(0, p - size + 1), min(n, p + size)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def counted(tokens: list[bytes], own: set[bytes], start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """Place and number of distinct template tokens of the blocks in a stretch that begin with one; others hold no more."""
    inside: Counter[bytes] = Counter()
    at = [i for i in range(start, stop) if tokens[i] in own]
    end = 0
    for i in at:
        while end < len(at) and at[end] < i + size:
            inside[tokens[at[end]]] += 1
            end += 1
        yield i, len(inside)
        inside[tokens[i]] -= 1
        if not inside[tokens[i]]:
            del inside[tokens[i]]


def phrase_places(tokens: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand in a row."""
    places = []
    for phrase, label in phrases.items():
        at = -1
        while True:
            try:
                at = tokens.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(tokens[at : at + len(phrase)]) == phrase:
                places.append((at, label))
    return places


def token_frequency(docs: DataFrame, templates: Sequence[tuple[str, str]], text_col: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole table each template token stands."""
    vocabulary = frozenset(t for _, text in templates for t in words(text.encode()))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words(text)))
        if seen:
            yield pa.RecordBatch.from_pydict({"token": list(seen), "n": list(seen.values())})

    rows = (
        bounded_batches(docs).select(utf8(text_col)).mapInArrow(count, "token binary, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).collect()
    )
    return {bytes(r["token"]): r["n"] for r in rows}


def lists_of(templates: Sequence[tuple[str, str]], most: int) -> Iterator[list[tuple[str, str]]]:
    """Templates in lists of at most ``most`` tokens, or one template each."""
    held: list[tuple[str, str]] = []
    size = 0
    for label, text in templates:
        n = len(words(text.encode()))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((label, text))
        size += n
    yield held


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] | None = None,
                 threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TEMPLATE_TOKENS) -> DataFrame:
    """One row for each document: word count, phrase places, labels, and the matches.

    ``matches`` lists (first_word, label, containment), words counted from 0.
    """
    wanted = {tuple(p.encode().split()): label for p, label in (BASE_PHRASES if phrases is None else phrases).items()}
    triggers = frozenset(p[0] for p in wanted)
    match = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
    kinds = {id_col: pa.int64(), "text": pa.binary()} | dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64())
    kinds |= {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": match}
    schema = pa.schema(list(kinds.items()))
    ddl = (
        f"`{id_col}` long, text binary, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<first_word: long, label: string, containment: double>>"
    )

    def matches_of(tokens: list[bytes], index: Index) -> list[dict]:
        distinct = set(tokens)
        return [
            {"first_word": at, "label": index.templates[k][0], "containment": c} for at, k, c in match_blocks(tokens, distinct, index)
        ]

    def scan(index: Index, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = words(text)
                    places = phrase_places(tokens, wanted) if not triggers.isdisjoint(tokens) else []
                    matches = matches_of(tokens, index)
                    starts, base = [at for at, _ in places], {label for _, label in places}
                    out.append((
                        doc, b"" if last else text, len(tokens), len(places), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | {m["label"] for m in matches})),
                        max((m["containment"] for m in matches), default=0.0), matches,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return run

    def more(index: Index, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                rows = batch.to_pylist()
                for r in rows:
                    new = matches_of(words(r["text"]), index)
                    labels = {*r["labels"].split(",")} - {""} | {m["label"] for m in new}
                    r |= {"labels": ",".join(sorted(labels)), "matches": sorted(r["matches"] + new, key=lambda m: m["first_word"])}
                    r |= {"score": max((m["containment"] for m in r["matches"]), default=0.0), "text": b"" if last else r["text"]}
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return run

    out = bounded_batches(docs).select(F.col(id_col).cast("long"), utf8(text_col))
    lists = list(lists_of(templates, most))
    for k, some in enumerate(lists):
        index = build_index(some, token_frequency(docs, some, text_col), threshold)
        out = out.mapInArrow(lean((more if k else scan)(index, k + 1 == len(lists))), ddl)
    return out.drop("text")
