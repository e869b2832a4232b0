"""BPE encoding and decoding: words of a trie share the encodings of their prefixes.

For every prefix of a word, greedy merging ends in exactly one last token, and
dropping that token leaves the encoding of a shorter prefix.  So the state of a
trie node is one token: the one that ends there and starts at an ancestor whose
own last token it can follow.  An automaton over the vocabulary lists the tokens
that end at a node; one token can follow another when no merge across their
border comes before the merges inside them, an answer that is kept for each
pair.  Distinct words are put into the trie and walked depth first,
every node once, so words with a common beginning share its work.  The walk
goes over the sorted words, which is the depth-first order of their trie: the
stack holds the states on the way from the root, and two neighbours share the
part of it that is their common prefix.

A text is cut at single spaces between other characters, which no token
crosses; only distinct segments meet the pre-tokenizer's pattern, and only
distinct words meet the trie.  Segment results are kept for the life of a task,
up to ``KEPT_SEGMENTS`` (then the store is emptied; results do not depend on it).
Longer texts are encoded a stretch at a time, cut at such a space too.

Results equal those of the tokenizers library for the same vocabulary file.
Rows are mapped one by one: no shuffle, so nothing can be hot.  The vocabulary
is read on the driver and travels as a broadcast of fixed size.

Defined cases: null text is empty and has no tokens; the strings of added
tokens become those tokens; texts of any length are encoded whole; an empty
table gives an empty table; repeated rows repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, small_batches, utf8

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEPT_SEGMENTS = 150_000  # about 30 MB
KEPT_CHARS = 4_000_000  # of all segments that are kept
KEPT_PAIRS = 300_000  # about 30 MB
GROUP_CHARS = 1 << 20  # text that is encoded at a time

#: White space but spaces and line ends; a text that has some is cut by the pattern alone.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: A single space between other characters.
_BORDER = re.compile(r"\S(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        byte_of = byte_alphabet()
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}


def merge(ranks: dict[tuple[bytes, bytes], int], data: bytes) -> list[bytes]:
    """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Automaton:
    """Walks bytes; a state is the longest suffix that begins some token, made when first met.

    ``ends[state]`` lists the tokens that end there, longest first, leaving out
    tokens that merging never makes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.beginnings = {t[:n] for t in vocabulary.ids for n in range(len(t) + 1)}
        self.states: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.steps: list[dict[int, int]] = []
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.state(b"")

    def state(self, name: bytes) -> int:
        if name not in self.states:
            v = self.vocabulary
            self.states[name] = len(self.names)
            self.names.append(name)
            self.steps.append({})
            tokens = (name[i:] for i in range(len(name)))
            self.ends.append(tuple((len(t), v.ids[t]) for t in tokens if t in v.ids and merge(v.ranks, t) == [t]))
        return self.states[name]

    def step(self, state: int, byte: int) -> int:
        name = self.names[state] + bytes((byte,))
        while name not in self.beginnings:
            name = name[1:]
        made = self.steps[state][byte] = self.state(name)
        return made


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = Automaton(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.parts = {a + b: (a, b, r) for (a, b), r in reversed(vocabulary.ranks.items())}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.pairs: dict[int, bool] = {}
        #: Encodings of segments as they are, and of segments behind a space (kept without it).
        self.segments: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.kept_chars = 0

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The pieces that stand at one end of a token while it is being merged, each with the rank of the merge that ends it."""
        if (token, side) not in self.edges:
            pieces, until = [(token, float("inf"))], token
            while until in self.parts:
                *both, rank = self.parts[until]
                until = both[side]
                pieces.append((until, rank))
            self.edges[token, side] = pieces
        return self.edges[token, side]

    def follows(self, left: int, right: int) -> bool:
        """No merge across the border of the two comes before the merges inside them.

        Merges happen in the order of their ranks.  Of equal ranks the left one
        comes first: a merge inside the left token goes before one across the
        border, a merge inside the right token after it.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            tokens, ranks = self.vocabulary.tokens, self.vocabulary.ranks
            known = self.pairs[key] = not any(
                (rank := ranks.get((a, b))) is not None and rank < a_until and rank <= b_until
                for a, a_until in self.edge(tokens[left], 1) for b, b_until in self.edge(tokens[right], 0)
            )
        return known

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct words in depth-first order (that of their UTF-8 bytes) with their encodings."""
        steps, ends, step, pairs, follows = self.automaton.steps, self.automaton.ends, self.automaton.step, self.pairs, self.follows
        before, states, last = b"", [0], [(0, 0)]  # by depth: automaton state; length and id of the last token
        for name in sorted(words):
            word = name.encode()
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for n in range(shared, len(word)):
                try:
                    state = steps[state][word[n]]
                except KeyError:
                    state = step(state, word[n])
                states.append(state)
                for end in ends[state]:
                    start = n + 1 - end[0]
                    if not start:
                        break
                    left = last[start][1]
                    try:
                        if pairs[left << 32 | end[1]]:
                            break
                    except KeyError:
                        if follows(left, end[1]):
                            break
                last.append(end)
            before, tokens, n = word, [], len(word)
            while n:
                size, token = last[n]
                tokens.append(token)
                n -= size
            tokens.reverse()
            yield name, array("I", tokens).tobytes()

    def words_of(self, segment: str) -> list[str]:
        """What the pre-tokenizer makes of a segment; a word before one mark needs no pattern."""
        if segment[-1] in ".,!?;:" and segment[1:-1].isalpha() and (segment[0] == " " or segment[0].isalpha()):
            return [segment[:-1], segment[-1]]
        return self.split(segment)

    def learn(self, new_plain: set[str], new_spaced: set[str]) -> None:
        """Encode distinct segments, all their new words in one walk."""
        plain, spaced = self.segments
        cut_plain = {s: [s] if s.isalpha() else self.words_of(s) for s in new_plain}
        cut_spaced = {s: self.words_of(" " + s) for s in new_spaced if not s.isalpha()}
        words = {" " + s for s in new_spaced if s not in cut_spaced}
        for cut in (cut_plain, cut_spaced):
            words.update(w for ws in cut.values() for w in ws if (w[1:] not in spaced if w[0] == " " else w not in plain))
        for word, ids in self.walk(words):
            if word[0] == " ":
                spaced[word[1:]] = ids
            else:
                plain[word] = ids
        self.kept_chars += sum(map(len, words)) + sum(map(len, cut_plain)) + sum(map(len, cut_spaced))
        for cut, known in ((cut_plain, plain), (cut_spaced, spaced)):
            for s, ws in cut.items():
                known[s] = b"".join([spaced[w[1:]] if w[0] == " " else plain[w] for w in ws])

    def cut(self, text: str, spaced: bool = False) -> tuple[list[str], list[str]]:
        """The text (behind a space, if said so) as segments in a row: those to take as they are, then those that a space precedes."""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or text[0] == "\n" and spaced or _OTHER_SPACE.search(text):
            return self.split(" " + text if spaced else text), []
        head, *rest = text.split(" ")
        return ([], [head, *rest]) if spaced else ([head], rest)

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """A long text in parts, and whether a space stood before the part."""
        at = 0
        while len(text) - at > GROUP_CHARS and not any(" " in t for t in self.vocabulary.added):
            m = _BORDER.search(text, at + GROUP_CHARS)
            if not m:
                break
            yield text[at : m.start() + 1], at > 0
            at = m.start() + 2
        yield text[at:], at > 0

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        group: list[tuple[str, bool]] = []
        rows: list[int] = []
        size = 0
        for text in texts:
            out.append([])
            for part in self.stretches(text):
                group.append(part)
                rows.append(len(out) - 1)
                size += len(part[0])
                if size >= GROUP_CHARS:
                    for row, ids in zip(rows, self.encode_group(group)):
                        out[row].append(ids)
                    group, rows, size = [], [], 0
        for row, ids in zip(rows, self.encode_group(group)):
            out[row].append(ids)
        return [b"".join(ids) for ids in out]

    def encode_group(self, texts: list[tuple[str, bool]]) -> list[bytes]:
        cut: list[list[tuple[list[str], list[str]] | int]] = []
        for text, behind in texts:
            if self.added and any(t in text for t in self.vocabulary.added):
                parts = self.added.split(" " + text if behind else text)
                cut.append([self.vocabulary.added[p] if i % 2 else self.cut(p) for i, p in enumerate(parts) if p])
            else:
                cut.append([self.cut(text, behind)] if text else [])
        plain, spaced = self.segments
        if len(plain) + len(spaced) > KEPT_SEGMENTS or self.kept_chars > KEPT_CHARS:
            plain.clear()
            spaced.clear()
            self.kept_chars = 0
        found: list[list[tuple[list[str], dict[str, bytes], list[bytes | None]]]] = []
        new_plain: set[str] = set()
        new_spaced: set[str] = set()
        for parts in cut:
            pieces = []
            for part in parts:
                if part.__class__ is int:
                    pieces.append(([], plain, [array("I", [part]).tobytes()]))
                    continue
                for names, known, new in zip(part, self.segments, (new_plain, new_spaced)):
                    have = list(map(known.get, names))
                    if None in have:
                        new.update([s for s, ids in zip(names, have) if ids is None])
                    pieces.append((names, known, have))
            found.append(pieces)
        self.learn(new_plain, new_spaced)
        out = []
        for pieces in found:
            ids = []
            for names, known, have in pieces:
                ids += [known[s] if x is None else x for s, x in zip(names, have)] if None in have else have
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def mapper(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """A function that makes an encoder, for one task; the file is read here, on the driver."""
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return lambda: Encoder(Vocabulary(shared.value))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids; decoding starts from the ids."""
    get = mapper(docs.sparkSession, path)
    kinds = {id_col: pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if keep_ids:
        kinds["ids"] = pa.list_(pa.int32())
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in small_batches(batches):
            encoded = encoder.encode_batch([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            columns = {
                id_col: batch.column(0), "n_tokens": [len(x) // 4 for x in encoded],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in encoded],
                "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in encoded],
            }
            if keep_ids:
                columns["ids"] = [memoryview(x).cast("I").tolist() for x in encoded]
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in columns.items()], schema=schema
            )

    return bounded_batches(docs).select(F.col(id_col).cast("long"), utf8(text_col)).mapInArrow(
        lean(run), f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    )
