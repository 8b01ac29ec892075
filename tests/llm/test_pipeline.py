"""Every stage of the pipeline against a brute-force version of its step, on its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_links
from tests.llm.test_packing import check_sequences
from tests.llm.test_suffix_dedup import brute as brute_strings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    draw = random.Random(12)
    words = {"en": "the of and that with this from have ther ing".split(), "de": "der und nicht ein auf sich die zu von mit".split()}
    line = lambda lang, n: " ".join(draw.choice(words[lang]) + str(draw.choice("abcdefgh")) * 2 for _ in range(n))
    shared = line("en", 60)
    texts = []
    for i in range(60):
        lang = draw.choice(["en", "de"])
        texts.append(("\n".join(line(lang, draw.randrange(6, 40)) for _ in range(4)), lang))
    texts += [(t + " xx", lang) for t, lang in texts[:8]]
    texts += [(line("en", 30) + "\n" + line("en", 12) + " " + shared + " " + line("en", 12), "en") for _ in range(4)]
    texts += [("123 --- 456", "en"), ("", "de"), (None, None), ("der und nicht " * 4000, None)]
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    tables = [spark.read.parquet(f"{path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], path).write.parquet(f"{path}/{k}.parquet")
        tables.append(spark.read.parquet(f"{path}/{k}.parquet"))
    return path, tables, [t.collect() for t in tables]


def test_columns_and_names(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    tables = stages[1]
    assert all(t.dtypes == tables[0].dtypes for t in tables[1:-1])


def test_language_rejects_what_has_no_letters(stages):
    before, after = stages[2][0], stages[2][1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_lines(stages):
    before, after = stages[2][1], stages[2][2]
    want = {int(name): text for name, _, _, text in brute_lines([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert {(r.doc_id, r.lang, r.source) for r in after} == {(r.doc_id, r.lang, r.source) for r in before}


def test_similar_documents(stages):
    before, after = stages[2][2], stages[2][3]
    keep = {i for i, _, _, kept in brute_links([(r.doc_id, r.text) for r in before]) if kept}
    assert sorted(tuple(r) for r in after) == sorted(tuple(r) for r in before if r.doc_id in keep)


def test_repeated_strings(stages):
    before, after = stages[2][3], stages[2][4]
    want = brute_strings([r.text.encode() for r in before], 200)
    assert {r.doc_id: r.text for r in after} == {r.doc_id: w[3].decode("utf-8", "ignore") for r, w in zip(before, want)}
    assert sum(w[1] for w in want) > 0


def test_packing(stages):
    before, after = stages[2][4], stages[2][5]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    check_sequences(after, 1024)


def test_run_gives_the_last_stage(spark, stages):
    path, _, rows = stages
    got = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got)) == Counter(map(key, rows[-1]))


def test_stages_with_odd_ids_repeated_rows_and_an_empty_table(spark):
    draw = random.Random(5)
    line = lambda n: " ".join(draw.choice("the of and with this from have".split()) + draw.choice("abcdefgh") * 2 for _ in range(n))
    a, b, c, d = (line(40) for _ in range(4))
    rows = [(1, a, "en", "s", 1), (2, a + " xx", "en", "s", 2), (2, b, "en", "s", 3), (None, c, "en", None, 4), (None, c + " yy", "en", "s", 5),
            (None, d, None, "s", 6), (7, d, "en", "s", 7), (8, line(40), "en", "s", 8), (8, line(40), "en", "s", 9), (None, None, None, None, None)]
    rows += [rows[6]]
    docs = spark.createDataFrame(rows, SCHEMA).select("source", "text", "lang", "n_chars", "doc_id")
    got = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    assert got.columns == docs.columns
    keep = {(r[0], r[1]) for r, (_, _, _, kept) in zip(rows, brute_links([r[:2] for r in rows]), strict=True) if kept}
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted(keep, key=repr)
    assert (2, b) in keep and (1, a) in keep and (2, a + " xx") not in keep and (None, d) not in keep
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}
        assert stage(spark, docs.limit(0), "").count() == 0
