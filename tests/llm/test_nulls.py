"""Nulls in every column, ties and repeated rows: no operator fails, and each row has its result."""

import pytest
from tessera.llm import exact_dedup, licenses, line_quality, mixing, ngram_join, packing, secrets, token_counts, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, label string, form string"
ROWS = [
    (None, None, None, None, None, None, None, None),
    (None, "a b c d e f g h i j k", None, None, None, None, None, None),
    (1, "a b c d e f g h i j k", "en", "s", 5, True, "x", "y"),
    (1, "a b c d e f g h i j k", "en", "s", 5, True, "x", "y"),
    (2, None, None, "s", None, None, None, None),
    (3, "A B C D E F G H I J K", None, None, 1, False, None, None),
    (4, "word " * 30_000, "en", "s", 1, None, None, None),
    (-5, "\u0000 ퟿ é", "en", "", 1, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize(
    "run",
    [
        line_quality.line_quality, exact_dedup.exact_duplicates, token_counts.token_counts, ngram_join.jaccard_components, secrets.secret_spans, licenses.license_detections, mixing.mix_copies,
    ],
)
def test_one_row_each(docs, run):
    ids = [r.doc_id for r in run(docs).collect()]
    assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)


def test_packing_keeps_null_ids(docs):
    got = packing.pack_documents(docs).collect()
    whole = [r for r in got if r.start == 0]
    assert sorted(str(r.doc_id) for r in whole) == sorted(str(r[0]) for r in ROWS)


def test_stages_keep_their_columns(docs):
    for stage in (line_quality.drop_low_quality, exact_dedup.drop_exact_duplicates, ngram_join.drop_near_duplicates, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns
        out.collect()
    kept = sorted(str(r.doc_id) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert kept == ["-5", "2", "3", "4"]


def test_pages_with_nulls(spark):
    rows = [(None, None, None), (None, "http://x.org/", "p"), (1, None, "p"), (1, None, "p"), (2, "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(str(r.page_id) for r in warc.archive_round_trip(pages).collect()) == sorted(str(r[0]) for r in rows)
    judged = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, "key string, verdict string"), spark.createDataFrame([(k,) for k in url_filter.LISTED], "key string")).collect()
    assert len(judged) == 5 and {r.host for r in judged} == {"", "x.org"}
    empty = url_filter.judge_urls(pages.limit(0), spark.createDataFrame([], "key string, verdict string"), spark.createDataFrame([], "key string"))
    assert empty.count() == 0
