"""Nulls, empty tables, repeated rows, very long texts and clashing columns for every operator and stage."""

import pytest

import corpus_pipeline
from pixloom.llm import bpe, chat, decontam, html_extract, jaccard_join, lang_id, license_scan, lm_score, media, queries, url_filters

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, x long, y long, token long, n long, held_out string, labels string, media string, lang_pred string"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again"), (1, "the quick brown fox jumps over the lazy dog again"), (2, None), (3, ""),
    (4, " \t\n "), (5, LONG), (6, LONG), (7, "x" * 300_000), (8, "\u0000 😀"), (9, "a"), (None, "no id here at all, five words"), (None, None), (10, "the quick brown fox jumps over the lazy dog again"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None, *[k] * 5, "h", "l", "m", "p") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, None), (2, ""), (None, "x")], "item_id long, text string")


OPERATORS = {
    "license": lambda spark, docs: license_scan.license_scan(docs),
    "media": lambda spark, docs: media.media_digest(docs),
    "bpe": lambda spark, docs: bpe.bpe_encode(docs, queries.TOKENIZER),
    "lm": lambda spark, docs: lm_score.lm_score(docs),
    "language": lambda spark, docs: lang_id.predict(docs, lang_id.fit(docs)),
    "jaccard": lambda spark, docs: jaccard_join.jaccard_components(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in got) == sorted((i is not None, i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, name):
    assert OPERATORS[name](spark, docs.where("false")).collect() == []


def test_jaccard_of_odd_rows(spark, docs):
    got = {}
    for r in jaccard_join.jaccard_components(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert got[1] == {(6, 1)} and got[10] == {(6, 1)} and got[2] == {(0, 2)} and got[4] == {(0, 4)}
    assert got[5] == {(6, 5)} and got[6] == {(6, 5)} and got[7] == {(1, 7)}


def test_decontamination_of_odd_rows(spark, docs):
    found = decontam.find_passages(docs, benchmark(spark))
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 1, 10]
    assert decontam.find_passages(docs, benchmark(spark).where("false")).collect() == []
    assert decontam.find_passages(docs.where("false"), benchmark(spark)).collect() == []


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", LONG), (1, 0, "user", LONG), (None, None, None, None), (2, None, "assistant", "")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns long, formatted string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.conversation_digests(df).collect()}
    assert got == {1: 2, None: 1, 2: 1}
    assert chat.conversation_digests(df.where("false")).collect() == []


def test_a_long_conversation_streams(spark):
    df = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "'t' AS text")
    (row,) = chat.conversation_digests(df).collect()
    assert (row["n_turns"], row["loss_chars"]) == (30_000, 15_000)


def test_html_of_odd_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<p>x" * 20_000, "t"), (2, "u", "<p>x" * 20_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html_extract.extract(df).collect()) == [0, 0, 39_999, 39_999]
    assert html_extract.extract(df.where("false")).collect() == []


def test_urls_of_odd_rows(spark):
    rows = [(1, None, "h"), (None, "http://a.org/es/", "h"), (2, "http://" + "x" * 100_000 + ".org/es/", "h"), (2, "", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    judged = url_filters.judge(df, [url_filters.host_rule("block", "org/es/")])
    assert judged.columns.count("host") == 1
    assert sorted(r["verdict"] for r in judged.collect()) == ["allow", "allow", "block", "block"]


def test_stages_take_what_the_one_before_kept(spark, tmp_path):
    good = [(i, f"{w} " * 3 + "the cat sat on the mat and looked at the other cats there", "en", "s", 1) for i, w in enumerate("alpha beta gamma delta epsilon".split())]
    rows = [*good, (50, good[0][1], "en", "s", 1), (60, None, "en", "s", 1), (61, "12 34", None, "s", 1), (70, "say: Quick brown fox jumps over the lazy dog!", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    everything = {r[0] for r in rows}
    assert kept[0] == everything - {60, 61} and kept[1] == kept[0] - {50} and kept[2] == kept[1] - {70} and kept[3] == kept[2]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept[3]
