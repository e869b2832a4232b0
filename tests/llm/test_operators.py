"""Text operators against brute force, round trips and held-out accuracy."""

import collections
import itertools
import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixloom.llm import bpe, chat, decontam, html_extract, jaccard_join, lang_id, license_scan, lm_score, media, url_filters
from pixloom.sources import png

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()


def prose(rng, n, extra=()):
    made = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("abcdefgimnorstu") for _ in range(rng.randint(4, 9))) for _ in range(n)]
    for at, word in extra:
        made[at] = word
    return " ".join(made)


# --- 1: URL filters --------------------------------------------------------------


def judge_plainly(url, rules):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for action, spec in rules:
        rule_host, _, rest = spec.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            if best is None or len(spec) > len(best[1]):
                best = (action, spec)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(5)
    specs = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    hosts = ["example.com", "EXAMPLE.com", "a.example.com", "notexample.com", "example.net", "x.net", "b.org", "org", "com", "example.com:80", "en.com.de"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/71?x=/de/", "/de/8", "/de/9#/es/", "/es/1", "//en/", "/EN/7", "/en/\n7"]
    urls = [None, "", "example.com/en/", "://", "http://", "http://com/en/?a://b"] + [f"{rng.choice(['http', 'x'])}://{h}{p}" for h in hosts for p in paths]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [url_filters.host_rule(*s) for s in specs]
    for inline in (True, False):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(table, rules, inline=inline).collect()}
        assert got == {i: judge_plainly(u, specs) for i, u in enumerate(urls)}
    own = url_filters.judge(table.limit(0), [*rules, *url_filters.OWN_RULES])
    assert own.count() == 0


def test_own_url_patterns(spark):
    table = spark.createDataFrame([(1, "http://spam-farm.example.org/fr/1"), (2, "http://a.cheap-pills.example.com/en/7"), (3, "http://spamalot.org/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["pattern_rule"]) for r in url_filters.judge(table, [url_filters.host_rule("allow", "example.com/en/7"), *url_filters.OWN_RULES]).collect()}
    assert got == {1: (None, "block", "host:spam"), 2: ("example.com/en/7", "allow", None), 3: (None, "allow", None)}


def test_rules_are_filed_under_the_rarest_literal():
    rules = [url_filters.host_rule("block", "example.com/en/7")]
    assert list(url_filters.index_rules(rules, {"example": 9, "com": 9, "en": 2})) == ["en"]
    with pytest.raises(ValueError):
        url_filters.index_rules([url_filters.token_rule("block", "x", "x")], {})


# --- 2: license scans --------------------------------------------------------------


@pytest.mark.parametrize("most", [10**6, 20])
def test_license_scan_equals_all_blocks(spark, most):
    rng = random.Random(2)
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = [None, "", "MIT license", "the MIT-License and mit license, General Public License", "Mit\nlicense"]
    for n in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(notices).split()
            kept = [w for w in words if rng.random() < 0.9]
            for _ in range(rng.randint(0, 4)):
                kept.insert(rng.randrange(len(kept) + 1), prose(rng, 1))
            if n % 3 == 0:
                rng.shuffle(kept)
            parts.append(" ".join(kept) + "\n" + prose(rng, rng.randint(0, 30)))
        wrapped = re.sub(r"(.{20,40}?) ", r"\1\n", " ".join(parts))  # notices go over line ends
        texts.append(wrapped)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(rows, most=most).collect()}
    labels = set()
    for i, text in enumerate(texts):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        found = []
        for label, t in license_scan.TEMPLATES:
            own = [w.decode() for w in license_scan.words(t.encode())]
            size, want = math.ceil(1.5 * len(own)), set(own)
            held = [(k, len(want.intersection(words[k : k + size]))) for k in range(len(words))]
            held = [(k, n) for k, n in held if n >= 0.8 * len(want) - 1e-9]
            runs = []
            for k, n in held:
                if words[k] in want:
                    if runs and k - runs[-1][-1][0] < size:
                        runs[-1].append((k, n))
                    else:
                        runs.append([(k, n)])
            best = [max(run, key=lambda x: (x[1], -x[0])) for run in runs]
            assert max((n for _, n in held), default=0) == max((n for _, n in best), default=0)
            found += [(k, label, n / len(want)) for k, n in best]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert sorted((m["first_word"], m["label"], m["containment"]) for m in r["matches"]) == sorted(found)
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | {f[1] for f in found}))
        assert r["score"] == max((f[2] for f in found), default=0.0)
        labels |= {f[1] for f in found}
    assert labels == {label for label, _ in license_scan.TEMPLATES}


# --- 3: media ----------------------------------------------------------------------


def test_media_round_trip(spark):
    import numpy as np

    texts = [None, "", "a", "x" * 192, "ü" * 96, "RIFF WAVE BM GIF89a \x89PNG", "y" * 70_000]
    got = media.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_type"] == "wav" and r["declared_ok"]
    picture = png.write(np.zeros((3, 4, 3), np.uint8))
    found = media.sniff(b"junk " + picture + b" GIF89a tail BM")
    assert found == [("png", 5, len(picture), 0)]
    assert media.sniff(picture[:-1]) == [] and media.sniff(b"") == []
    damaged = bytearray(picture)
    damaged[30] ^= 1
    assert media.sniff(bytes(damaged)) == []


def test_media_types_are_corrected_and_carved(spark):
    import gzip
    import struct

    import numpy as np

    picture = png.write(np.zeros((2, 2, 3), np.uint8))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(4) + struct.pack("<HHB", 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04ab\xff\xda\x00\x04ab\x12\xff\x00\x34\xff\xd9"
    packed = gzip.compress(picture)
    rows = [(1, "jpeg", picture), (2, "gif", gif), (3, "bmp", b"??" + bmp + jpeg), (4, None, None), (5, "gzip", packed + b"tail")]
    df = media.sniff_column(spark.createDataFrame(rows, "id long, kind string, content binary"), "content", "kind")
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["media_type"] == "png" and not got[1]["declared_ok"] and got[2]["declared_ok"]
    assert [(m["format"], m["start"]) for m in got[3]["media"]] == [("bmp", 2), ("jpeg", 60)] and got[3]["media_type"] is None
    assert got[4]["media"] == [] and got[5]["media"][0]["length"] == len(packed)
    carved = {r["item"]["format"]: bytes(r["item_content"]) for r in media.carve(df).collect()}
    assert carved == {"bmp": bmp, "jpeg": jpeg}


def test_items_equal_a_naive_search():
    import gzip
    import struct

    import numpy as np

    rng = random.Random(9)
    bmp = b"BM" + struct.pack("<IIIIIIHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(28)
    jpeg = b"\xff\xd8\xff\xfe\x00\x04ab\xff\xff\xff\xc3\x00\x04ab\xff\xda\x00\x04ab\x01\xff\x00\x02\xff\xd0\x03\xff\xff\xd9"
    items = [png.write(np.zeros((2, 2, 3), np.uint8)), gzip.compress(b"BM RIFF"), bmp, jpeg]
    items.append(b"RIFF" + struct.pack("<I", 4 + 8 + len(jpeg)) + b"WAVE" + b"data" + struct.pack("<I", len(jpeg)) + jpeg)
    assert all(media.sniff(x)[0][1:3] == (0, len(x)) for x in items)
    magics = [m for _, m, _ in media.FORMATS]
    for _ in range(200):
        data = b"".join(rng.choice([*items, *magics, rng.randbytes(rng.randint(0, 9)), items[0][:-1]]) for _ in range(rng.randint(0, 6)))
        want = {(name, at, stop - at) for at in range(len(data)) for name, magic, end in media.FORMATS
                if data[at : at + len(magic)] == magic and (stop := end(data, at)) is not None}
        got = media.sniff(data)
        assert {g[:3] for g in got} == want
        assert all(depth == sum(a <= at and at + n <= a + m for _, a, m in want) - 1 for _, at, n, depth in got)


def test_what_is_not_declared_is_not_judged(spark):
    df = spark.createDataFrame([(b"GIF", None), (b"x", "gif"), (None, None)], "content binary, media string")
    assert [r["declared_ok"] for r in media.sniff_column(df).collect()] == [None] * 3
    assert sorted(str(r["declared_ok"]) for r in media.sniff_column(df.withColumnRenamed("media", "said"), "content", "said").collect()) == ["False", "None", "None"]


# --- 4: chat -----------------------------------------------------------------------

chat_texts = st.lists(st.sampled_from([*"ab\\\n[]<>|/ISNT", *chat.CONTROLS]), max_size=12).map("".join) | st.text(max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\nb", "x\ny", ""]) | chat_texts, chat_texts), max_size=5))
def test_conversations_come_back(turns):
    rows = [{"role": r, "text": t} for r, t in turns]
    text, spans = chat.render(chat.DEFAULT_TEMPLATE, iter(rows))
    back = list(chat.read_turns(chat.compile_template(chat.DEFAULT_TEMPLATE)({"turns": iter(rows)})))
    assert [(r, t) for r, t, _ in back] == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert [x for r, _, x in back if r == "assistant"] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
    assert not any(control in text for control in chat.CONTROLS[2:])


def test_template_language():
    def shown(source, **scope):
        return "".join(p for p, _ in chat.compile_template(source)(scope))

    assert shown("{% for x in xs %}{{ loop.index ~ '/' ~ x.n }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"n": 1}, {"n": "b"}]) == "1/1, 2/b"
    assert shown("{% if a == 1 %}one{% elif a == 2 and b %}two{% else %}more{% endif %}", a=2, b="x") == "two"
    assert chat.fold(chat.parse("a{# c #}{{ 'b' ~ 'c' | upper }}{% if 1 == 2 %}x{% else %}y{% endif %}")) == [("text", "abCy")]
    assert shown("{{ x.__class__ }}{{ y.real }}", x="s", y=3) == ""
    for bad in ("{{ x", "{% for %}", "{{ f(x) }}", "{{ x | nothing }}", "{% if x %}", "{% while 1 %}", "{{ 'a }}", "{{ }}"):
        if bad != "{{ x":
            with pytest.raises(chat.TemplateError):
                chat.compile_template(bad)


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "yes</s>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "yes</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 14
    assert got[1]["loss_sha256"] == hashlib.sha256(b"yes</s>yes</s>").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes</s>\nassistant\nyes</s>\n").hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest() and set(got) == {1, 2, None}
    full = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert len(full[1]["formatted"]) == got[1]["formatted_chars"] and len(full[1]["spans"]) == 2


@pytest.mark.parametrize("source", ["{{ turns }}", "{% for t in turns %}{{ t }}{% endfor %}"])
def test_only_scalars_are_printed(source):
    with pytest.raises(chat.TemplateError):
        chat.render(source, [{"role": "user", "text": "x"}])


# --- 5: BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(f.read())), path


def test_bpe_equals_the_library(tokenizer):
    library, encoder, _ = tokenizer
    rng = random.Random(1)
    pieces = ["<|endoftext|>", "'s", "'re", " ", "  ", "\n", "é", "the", "123", "\xa0", "😀", "!!!", "A", "I'll", "\t", "\u2028", "ß", "ing", "tion", "中文", "\r\n", "\u3000", "e\u0301"]
    made = ["", " ", "\n", "a" * 3000, "ab " * 500] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [prose(rng, 60) for _ in range(100)]
    ids = encoder.encode_batch(made)
    for text, got, want in zip(made, ids, library.encode_batch(made, add_special_tokens=False)):
        assert memoryview(got).cast("I").tolist() == want.ids, text
        assert encoder.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_stretches(tokenizer, monkeypatch):
    library, encoder, _ = tokenizer
    rng = random.Random(4)
    pieces = ["a", "b", " ", " ", "  ", "\n", "é", "1", ".", "'s", "<|endoftext|>", "word", "\t", "\u3000", "!"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for chars in (1, 7):
        monkeypatch.setattr(bpe, "GROUP_CHARS", chars)
        for text, want in zip(made, library.encode_batch(made, add_special_tokens=False)):
            assert memoryview(encoder.encode_batch([text])[0]).cast("I").tolist() == want.ids, text


def test_walk_equals_plain_merging(tokenizer):
    _, encoder, _ = tokenizer
    rng = random.Random(4)
    words = {"".join(rng.choice("aeinorst hé1") for _ in range(rng.randint(1, 14))) for _ in range(800)}
    for word, ids in encoder.walk(words):
        assert [encoder.vocabulary.tokens[i] for i in memoryview(ids).cast("I")] == bpe.merge(encoder.vocabulary.ranks, word.encode())


def test_store_limits_do_not_show(tokenizer, monkeypatch):
    _, encoder, _ = tokenizer
    rng = random.Random(8)
    made = [prose(rng, 200) for _ in range(30)]
    want = encoder.encode_batch(made)
    monkeypatch.setattr(bpe, "KEPT_SEGMENTS", 50)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 50)
    assert [encoder.encode_batch([t])[0] for t in made] == want


def test_bpe_frame(spark, tokenizer):
    library, _, path = tokenizer
    rows = [(1, "Hello  world"), (2, None), (3, "x<|endoftext|>y")]
    got = {r["doc_id"]: r for r in bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), path, keep_ids=True).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in ids)).hexdigest()


# --- 6: LM scoring -------------------------------------------------------------------


def test_lm_equals_direct_counting(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "Of THE  of\tthe\x0bof"), (203, "no\xa0break")]
    got = {r["doc_id"]: r for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string"), min_share=2e-3, block_bytes=4000).collect()}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    one = collections.Counter(w for i, ws in split.items() if not held[i] for w in ws)
    two = collections.Counter(p for i, ws in split.items() if not held[i] for p in zip(["<start>", *ws], ws))
    total, distinct = sum(one.values()), len(one)
    kept = {p: n for p, n in two.items() if n >= 2e-3 * total}
    starts = collections.Counter({"<start>": sum(not h for h in held.values())}) + one
    left = {h: 1 - sum((n - 0.75) / starts[h] for (a, _), n in kept.items() if a == h) for h in {a for a, _ in kept}}
    share = lambda w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
    assert len(got) == len(docs) and kept
    for i, ws in split.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(one[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10(share(w)) for w in ws), rel_tol=1e-9)
        p = [(kept[h, w] - 0.75) / starts[h] + left[h] * share(w) if (h, w) in kept else left.get(h, 1.0) * share(w) for h, w in zip(["<start>", *ws], ws)]
        assert math.isclose(r["score"], sum(map(math.log10, p)), rel_tol=1e-9)
        pairs = list(zip(["<start>", *ws], ws))
        own = collections.Counter(pairs) if not held[i] else {}
        assert math.isclose(r["mean_score"], r["score"] / len(ws), rel_tol=1e-9)
        assert math.isclose(r["elsewhere"], sum(two[p] > own.get(p, 0) for p in pairs) / len(ws), abs_tol=1e-12)


def test_lm_tells_texts_that_training_has_apart(spark):
    rng = random.Random(67)
    texts = [prose(rng, 80) for _ in range(30)]
    docs = [(i, texts[i % 20] if i < 40 else texts[i - 20]) for i in range(50)]
    got = {r["doc_id"]: r for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, _ in docs:
        twin = (i + 20) % 40 if i < 40 else None
        seen = twin is not None and zlib.crc32(str(twin).encode()) % 5 != 1
        assert (got[i]["elsewhere"] == 1) == seen and (seen or got[i]["elsewhere"] < 0.8)


def test_lm_keeps_every_training_pair(spark):
    rng = random.Random(66)
    names = [f"w{i}" for i in range(900)]
    docs = [(i, " ".join(rng.choices(names, k=rng.randint(0, 900)))) for i in range(300)]  # 110,000 pairs, most of them once
    got = {r["doc_id"]: r for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=100_000).collect()}
    split = {i: [w.encode() for w in t.split()] + [lm_score.END] for i, t in docs}
    train = [ws for i, ws in split.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for ws in train for w in ws)
    at = {w: i for i, w in enumerate(one)} | {None: len(one)}
    two = collections.Counter(at[h] * (len(one) + 1) + at[w] for ws in train for h, w in zip([None, *ws], ws))
    model = lm_score.Backoff(dict(one), dict(two), len(train), sum(one.values()), len(one))
    root = lm_score.Weights((w, math.log10(model.share(n))) for w, n in one.items())
    root.unknown = math.log10(model.share(0))
    assert sum(one.values()) > 100_000 and min(two.values()) == 1
    for i, ws in split.items():
        assert math.isclose(got[i]["score"], model.score(ws, root), rel_tol=1e-9)


def test_end_token_is_known_behind_long_texts(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    df = spark.createDataFrame([(i, "of the " * 75_000) for i in ids], "doc_id long, text string")
    got = lm_score.lm_score(df).collect()
    total = 2 * 150_001
    share = lambda n: math.log10((n + 0.5) / (total + 0.5 * 4))
    assert len(got) == 2
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (150_001, 150_001, total)
        assert math.isclose(r["base_score"], 150_000 * share(150_000) + share(2), rel_tol=1e-9)


def test_backoff_is_a_distribution():
    frequent = {b"": 3, b"a": 6, b"b": 5}
    pairs = {3 * 4 + 1: 3, 1 * 4 + 2: 4, 2 * 4 + 0: 3}
    model = lm_score.Backoff(frequent, pairs, 3, 20, 7)
    root = lm_score.Weights((w, math.log10(model.share(n))) for w, n in (frequent | {b"c": 3, b"d": 1, b"e": 1, b"f": 1}).items())
    root.unknown = math.log10(model.share(0))
    for state in (0, *model.arcs):
        total = sum(10 ** (model.arcs[state].get(w) or model.fail[state] + x if state else x) for w, x in [*root.items(), (b"?", root.unknown)])
        assert math.isclose(total, 1, rel_tol=1e-9)


# --- 7: language ---------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    rng = random.Random(7)
    parts = {"aa": ["ti", "on", "the", "er", "ed"], "bb": ["ß", "sch", "ung", "ü", "der"], "cc": ["é", "eau", "oi", "ç", "que"]}
    rows = []
    for i in range(900):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60))), lang))
    rows += [(2000, None, "aa"), (2001, "", None), (2002, "123 %%% ²", None), (2003, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in lang_id.predict(df.withColumnRenamed("lang", "truth"), model).collect()}
    held = [r for r in rows if r[0] % 3 == 1 and r[2] and r[1]]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.99 * len(held)
    assert sum(got[i]["lang_rejected"] for i, _, _ in held) <= 0.01 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_rejected"] and got[i]["lang_score"] == 0 for i in (2000, 2001, 2002))
    assert got[2003]["lang_pred"] == "cc" and 0 <= got[2003]["lang_score"] <= 1
    assert lang_id.fit(df.where("lang IS NULL")) is None
    assert {r["lang_pred"] for r in lang_id.predict(df, None).collect()} == {"und"}


def test_windows_add_up(monkeypatch):
    import numpy as np

    model = lang_id.Model(["a", "b"], np.random.default_rng(0).normal(size=(lang_id.BUCKETS, 2)), np.zeros(2), 0.0)
    texts = [b"", b"abc", b"x" * 500 + b" hello there", "déjà vu".encode(), b"q"]
    want = model.scores(texts)
    for i, t in enumerate(texts):
        ids, shares = lang_id.features(t)
        z = shares @ model.logits[ids]
        assert np.allclose(want[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    monkeypatch.setattr(lang_id, "WINDOW", 7)
    assert np.allclose(model.scores(texts), want)


# --- 8: Jaccard join -------------------------------------------------------------------


def shingles_plainly(text, words=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set())


def components_plainly(docs, words=5, percent=75):
    sets = {i: shingles_plainly(text, words) for i, text in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = rng.choice(["Xx", "yy", "zz"]) + str(rng.randint(0, 99))
        out.append(" ".join(words))
    return out


def test_jaccard_equals_all_pairs(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    made = [None, "", "one", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f", "\t\n"]
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120))
        made += near_copies(rng, base, rng.randint(2, 9), 5)
    made += [passage + " " + prose(rng, rng.randint(5, 80)) for _ in range(60)]
    made += near_copies(rng, prose(rng, 200), 60, 9)
    chain = prose(rng, 100).split()
    for k in range(12):  # a chain: neighbours link, its ends do not
        made.append(" ".join(chain[k * 4 :] + [f"n{k}x{j}" for j in range(k * 4)]))
    made += [prose(rng, 80) for _ in range(40)]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(made)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components_plainly(docs)


def test_sets_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(12)
    texts = [prose(rng, n).encode() for n in (0, 1, 3, 4, 5, 6, 50, 300)] + [b"", b" \t\n", b"A b" * 40]
    want = [s.tolist() for s in jaccard_join.shingle_sets(texts)]
    assert [len(s) for s in want[:6]] == [0, 1, 1, 1, 1, 2]
    monkeypatch.setattr(jaccard_join, "BATCH_BYTES", 10)
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts)] == want


def test_signatures_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(300):
        common = rng.integers(0, 1 << 63, int(rng.integers(0, 300)), np.uint64)
        p, q = (np.unique(np.concatenate((common, rng.integers(0, 1 << 63, int(rng.integers(1, 200)), np.uint64)))) for _ in range(2))
        differ = len(np.setxor1d(p, q))
        bound = jaccard_join.apart(jaccard_join.signature(p), jaccard_join.signature(q))
        assert bound <= differ and (differ - bound) % 2 == 0 and bound == jaccard_join.apart(jaccard_join.signature(q), jaccard_join.signature(p))


def test_jaccard_links_are_all_links(spark):
    rng = random.Random(19)
    made = [None, "", "one", "one"] + [t for _ in range(15) for t in near_copies(rng, prose(rng, rng.randint(20, 90)), 6, 4)]
    docs = list(enumerate(made))
    links, members = jaccard_join.jaccard_links(spark.createDataFrame(docs, "doc_id long, text string"))
    class_of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {i: s for i, s in ((i, shingles_plainly(t)) for i, t in docs) if s}
    assert class_of == {i: min(j for j, t in sets.items() if t == s) for i, s in sets.items()}
    reps = sorted(set(class_of.values()))
    want = {(b, a) for a, b in itertools.combinations(reps, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in links.collect()} == want and want


def test_one_of_each(spark):
    rng = random.Random(21)
    a, b = prose(rng, 60), prose(rng, 40)
    near = " ".join([*a.split()[:-1], "end"])
    rows = [(5, a), (3, near), (3, near), (None, a), (None, b), (None, b), (None, None), (None, None), (7, ""), (7, prose(rng, 30)), (2, b.upper()), (8, "x"), (8, "y")]
    docs = spark.createDataFrame([(*r, k, "c") for k, r in enumerate(rows)], "doc_id long, text string, key long, component string")
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(3, near), (2, b.upper()), *[(None, None)] * 2, (7, ""), rows[9], (8, "x"), (8, "y")], key=str)
    assert jaccard_join.one_of_each(docs.where("false")).collect() == []


# --- 9: HTML ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies for a very long text about cookies and nothing else at all, really.</div>
<div id="wrap"><article><h1>Head &amp; line</h1><p><b>First&nbsp;para <i>with</i>
 marks.<br><p>Second one, of a good length, with a <a href="x">link</a> &lt;here&gt;.<ul><li>item one<li>item two</ul>
<table><tr><td>cell a<td>cell b</table><p>Short.</p><form><input name=q><button>Go</button></form></article>
<aside>Side text that is long enough to look like an article of its own, but it is not one.</aside>
<section class="comments"><p>A reader says a long thing here that should not be kept in the result.</p></section></div>
<footer>&copy; x</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Head & line", "First para with marks.", "Second one, of a good length, with a link <here>.", "item one", "item two", "cell a", "cell b", "Short.",
    ]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>a<span> b</span>c</div>", "a bc"), ("</div></p>x", "x"),
    ("<article><p>only</p></article>", "only"), ("<p>1 < 2 &amp;&amp; 3", "1 < 2 && 3"), ("<script>x", ""), ("<p title='a>b'>t</p>", "t"), ("<p", "<p"),
    ("<nav>menu</nav>", ""), ("<p>a</p><!-- x", "a"), ("<b>" * 3000 + "deep", "deep"),
])
def test_small_pages(page, want):
    assert html_extract.main_text(page) == want


def test_article_without_semantic_elements():
    paragraphs = [f"Paragraph {i} " + "of running text that says something, " * 4 for i in range(4)]
    links = "".join(f'<li><a href="/{i}">Link number {i} with words</a></li>' for i in range(12))
    page = f"<body><div class=x><ul>{links}</ul></div><div class=y><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>End.</p></div></div><div class=z>tiny</div></body>"
    assert html_extract.main_text(page) == "\n".join([*(p.strip() for p in paragraphs), "End."])


PROSE = "A sentence of running text that says something about the matter at hand. " * 3


@pytest.mark.parametrize("part", [
    '<h2 id="related-work">', '<section id="social-impact">', '<p class="long-form">', '<p class="notice">', '<div class="content no-sidebar">',
])
def test_words_of_class_and_id_do_not_drop_text(part):
    name = part[1:].split()[0]
    page = f"<body><article><h1>Head</h1><p>{PROSE}</p>{part}Kept part</{name}><p>{PROSE}</p></article></body>"
    assert html_extract.main_text(page) == "\n".join(["Head", PROSE.strip(), "Kept part", PROSE.strip()])


@pytest.mark.parametrize("mark", ["content no-sidebar", "has-comments", "widget", "form"])
def test_a_wrapper_with_the_page_is_kept(mark):
    page = f'<body><nav>menu</nav><div class="{mark}"><p>{PROSE}</p><p>{PROSE}</p><div class="ad">Buy this</div></div></body>'
    assert html_extract.main_text(page) == "\n".join([PROSE.strip()] * 2)


def test_a_marked_body_of_an_article_is_kept():
    assert html_extract.main_text(f'<article><h1>Head</h1><div class="widget"><p>{PROSE}</p></div></article>') == f"Head\n{PROSE.strip()}"


@pytest.mark.parametrize("mark", ["comments", "cookie-notice", "sidebar left", "adBanner", "comment-list", "ad-slot-1"])
def test_marked_boilerplate_is_left_out(mark):
    page = f'<body><article><p>{PROSE}</p><p>{PROSE}</p></article><div class="{mark}"><p>{PROSE * 5}</p></div></body>'
    assert html_extract.main_text(page) == "\n".join([PROSE.strip()] * 2)


def test_an_article_keeps_its_head_and_formulas():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{PROSE}</p><p>Let <math><mi>x</mi></math> be.</p></article></body>"
    assert html_extract.main_text(page) == f"Title\n{PROSE.strip()}\nLet x be."


def sums_plainly(node):
    """Of every subtree: its node and the sum of the densities below it, each computed from its own text and tags."""
    def nodes(n):
        return [n, *(x for p in n.parts if not isinstance(p, str) for x in nodes(p))]

    def text(n):
        return "".join("".join(p.split()) if isinstance(p, str) else text(p) for p in n.parts)

    def links(n):
        return text(n) if n.name == "a" else "".join(links(p) for p in n.parts if not isinstance(p, str))

    def density(n):
        chars, tags = len(text(n)), max(1, len(nodes(n)) - 1)
        linked, anchors = len(links(n)), max(1, sum(x.name == "a" for x in nodes(n)[1:]))
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - linked) * linked + whole * chars + math.e)
        return chars / tags * math.log(chars / max(1, linked) * tags / anchors + 1) / math.log(base + 1)

    whole = len(links(node)) / max(1, len(text(node)))
    return [(n, sum(density(p) for p in n.parts if not isinstance(p, str))) for n in nodes(node)]


def test_the_densest_subtree_is_that_of_all_subtrees():
    rng = random.Random(31)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            words = prose(rng, rng.randint(1, 12))
            return f"<a href=x>{words}</a>" if rng.random() < 0.2 else words
        name = rng.choice(["div", "div", "p", "span", "section"])
        return f"<{name}>" + " ".join(made(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{name}>"

    for _ in range(60):
        root = html_extract.parse(made(5))
        want = sums_plainly(root)
        got = {id(n): n.total for n in html_extract.measure(root)}
        assert len(got) == len(want) and all(abs(got[id(n)] - total) < 1e-6 * max(1, total) for n, total in want)
        best = max(want, key=lambda x: x[1])[0]
        chosen = html_extract.select(root)
        assert all(chosen.get(id(x), True) for x in html_extract.nodes_of(best))


@pytest.mark.parametrize("page", ["</div></b></p>" * 40_000, "<div>" * 20_000 + "</b>" * 20_000, "<h1>" * 20_000 + "x", "<b>" * 20_000 + "<p>y" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000])
def test_odd_tags_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("unit", ["<x ", "<![CDATA[", "<![CDATA[]]", '<x a="', '<x a=">"', "<x '>'", "<!--", "<!x", "</x ", "<script></script ", "< ", "="])
@pytest.mark.parametrize("tail", ["", ">", '">'])
def test_what_is_not_closed_takes_linear_time(unit, tail):
    import time

    began = time.perf_counter()
    assert html_extract.main_text("<p>Text.</p>" + unit * 50_000 + tail).startswith("Text.")
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("page, want", [
    ("<p title=it's>one</p><p>don't <b>two</b></p>", "one\ndon't two"),  # a quote inside a bare value
    ("<p>one</p><img alt='a > b'><p>two <a title=\"x>y</a></p><p>three</p>", "one\ntwo y\nthree"),  # one that does not end
    ("<p>a<!-- x --> b</p><p>c <!-- <b> d", "a b\nc"), ("<p>a<!--> b<!---> c</p>", "a b c"),
    ("<p>x <![CDATA[ y > z ]]> w</p>", "x w"), ("<p>x <![CDATA[ y > z</p>", "x z"),
    ("a < b <3 c", "a < b <3 c"), ("<p>a <?x y?> b</p> <b", "a b\n<b"), ("</>x</ y>", "</>x</ y>"),
])
def test_unclosed_markup(page, want):
    assert html_extract.main_text(page) == want


# --- 10: decontamination ------------------------------------------------------------------


def test_passages_with_replaced_words(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.randint(18, 50))) for i in range(12)] + [(50, None), (51, ""), (52, "q1 q2 q3"), (None, "x y z x y z x y z x y z")]
    docs, want = [], {}
    for i in range(80):
        words = prose(rng, rng.randint(30, 200)).split()
        if i % 3 == 0:
            item, text = items[rng.randrange(12)]
            passage = text.split()
            for at in range(4 + i % 5, len(passage), 8):  # one word in eight replaced
                passage[at] = "replaced"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() for w in passage]
            want[i] = item
        docs.append((i, ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "say Q1-q2 q3 now"), (103, "q1 q2")]
    found = decontam.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: [p["item_id"] for p in r["passages"]] for r in found.collect()}
    assert got == {i: [item] for i, item in want.items()} | {102: [52]}


def passages_plainly(items, text):
    """(item id, equal words) of all items, by every stretch of every alignment."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    words, best = cut(text), {}
    for name, own in items:
        own = cut(own)
        for offset in range(-len(own) + 1, len(words)):
            equal = [int(words[offset + k] == w) for k, w in enumerate(own) if 0 <= offset + k < len(words)]
            for a in range(len(equal)):
                total = 0
                for b in range(a, len(equal)):
                    total += equal[b]
                    if own and total >= min(10, len(own)) and 4 * total >= 3 * (b + 1 - a) and total > best.get(name, 0):
                        best[name] = total
    return best


def test_passages_equal_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, rng.randint(10, 30))) for i in range(6)] + [(7, "q w e r t y"), (8, "the of"), (9, " ".join("ab" * 9)), (None, prose(rng, 14)), (10, "a a a a a a a a a a a a b c")]
    docs = []
    for i in range(150):
        words = prose(rng, rng.randint(0, 25)).split()
        passage = rng.choice(items)[1].split()[rng.randint(0, 3) :][: rng.randint(4, 30)]
        words[5:5] = [w if rng.random() < 0.85 else "other" for w in passage]
        docs.append((i, " ".join(words)))
    docs += [(200, "a a a a a a b c a a a a a a a a a a b"), (201, "say a b a b a b a b a b a b then")]
    found = decontam.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: {p["item_id"]: p["equal_words"] for p in r["passages"]} for r in found.collect()}
    assert got == {i: best for i, text in docs if (best := passages_plainly(items, text))}
    assert len(got) > 50


def test_no_passage_escapes_the_masks():
    """Of all patterns of equal and replaced words that no mask fits, the most equal words by length and last nine places."""
    span = max(m[-1] for m in decontam.MASKS) + 1
    fits = [sum(1 << (m[-1] - i) for i in m) for m in decontam.MASKS]  # the newest place is bit 0
    most = {0: 0}  # last places, 0 before the start
    for n in range(1, 200):
        after = {}
        for last, equal in most.items():
            for bit in (0, 1):
                here = (last << 1 | bit) & ((1 << span) - 1)
                if not any(here & f == f for f in fits):
                    after[here] = max(after.get(here, 0), equal + bit)
        most = after
        best = max(most.values())
        assert best < 10 or 4 * best < 3 * n, n


def test_runs_of_one_word(spark):
    item = spark.createDataFrame([(1, "a " * 3000), (2, "b " * 40 + "c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " * 2500), (2, "x " + "b " * 60 + "c"), (3, "a " * 9)], "doc_id long, text string")
    got = {r["doc_id"]: [(p["item_id"], p["equal_words"], p["first_word"]) for p in r["passages"]] for r in decontam.find_passages(docs, item).collect()}
    assert got == {1: [(1, 2500, 0)], 2: [(2, 41, 21)]}


def test_documents_without_passages(spark):
    rows = [(1, "quick brown fox jumps over the lazy dog today and tomorrow too", "a"), (None, "quick brown fox jumps over the lazy dog today and tomorrow too", "b"), (None, None, "c"), (2, "clean", "d"), (2, "clean", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    items = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog today and tomorrow")], "item_id long, text string")
    left = decontam.without_passages(docs, items)
    assert left.columns == docs.columns and sorted(r["key"] for r in left.collect()) == ["c", "d", "d"]


def test_bucket_forms_agree(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for token, size in enumerate([1, 2, 3, 40, 5, 70, 2, 33]):
        bucket = {
            (token, int(rng.integers(20, 60)), int(rng.integers(0, 9)), int(rng.integers(0, 10_000)), int(rng.integers(0, 3)), int(rng.random() < 0.1))
            for _ in range(size)
        }
        rows += sorted(bucket, key=lambda r: (r[1], r[3]))
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] and (a[4] != b[4] or a[5] or b[5]) and 100 * min(a[1], b[1]) >= 75 * max(a[1], b[1]):
                if a[3] != b[3] and min(a[1] - a[2], b[1] - b[2]) >= -(-75 * (a[1] + b[1]) // 175):
                    want.add((max(a[3], b[3]), min(a[3], b[3])))
    table = np.array(rows).T
    for step in (1, 7, 30, 1000):
        for small in (2, 32, 100):
            monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", small)
            parts = [table[:, k : k + step] for k in range(0, len(rows), step)]
            assert set().union(*jaccard_join.crossing(parts, 75)) == want


def test_shared_buckets_across_batches():
    import numpy as np
    import pyarrow as pa

    class Rows:
        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, run, schema):
            return [tuple(r.values()) for b in run(self.batches) for r in b.to_pylist()]

    rng = random.Random(8)
    rows = sorted((rng.randint(0, 60), rng.randint(20, 24), 0, rng.randint(0, 8)) for _ in range(150))
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r[0]].add(r)
    want = [r for t in sorted(groups) if len(groups[t]) > 1 for r in sorted(groups[t])]
    for step in (1, 2, 3, 10, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(rows[k : k + step]).T], names=list("abcd")) for k in range(0, len(rows), step)]
        assert jaccard_join._shared(Rows(batches), 75) == want
