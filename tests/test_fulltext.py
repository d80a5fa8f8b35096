"""Stems, stop words and the posting table."""

import math

import pytest
from pyspark.sql import functions as F

from engramix.functions import english
from engramix.operators import fulltext
from engramix.operators import search as se

#: Published pairs of word and stem.
STEMS = """consign consign consigned consign consignment consign consistency consist consistently consist consolatory consolatori
consolidating consolid consols consol conspicuously conspicu conspiracy conspiraci conspirators conspir constance constanc
knackeries knackeri knaves knave kneaded knead knightly knight knitting knit knives knive cats cat ties tie cries cri gas gas
this this kiwis kiwi luxuriating luxuri hopping hop hoped hope fizzed fizz agreed agre bled bled sing sing relational relat
valenci valenc vietnamization vietnam hopefulness hope electricity electr adjustable adjust replacement replac adoption adopt
communities communiti generously generous skies sky early earli proceeding proceed rolling roll say say cry cri enjoy enjoy""".split()


def test_published_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = spark.createDataFrame(pairs, "word string, want string").select("word", "want", english.stem("word").alias("stem")).collect()
    assert [(r.word, r.stem) for r in got] == [(r.word, r.want) for r in got]


def test_odd_words(spark):
    words = ["", "a", "y", "yy", "s", "12345", "été", "naïve", "日本語", "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "word string").select(english.stem("word")).collect()]
    assert all(g is not None for g in got)
    assert got[:5] == ["", "a", "y", "yy", "s"] and got[8] == "日本語"


@pytest.fixture(scope="module")
def rows(spark):
    texts = {"a": "The cat sat. Cats sit!", "b": "A running cat", "c": "runs and runs and runs", "d": None, "e": "", "f": "the of and", "g": "Cat cat CAT running ran"}
    return spark.createDataFrame(list(texts.items()), "id string, content string")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return fulltext.Index.build(rows, str(tmp_path_factory.mktemp("index")))


def found(index, query):
    return {r.id: r.score for r in fulltext.hits(index, query).collect()}


def test_words_are_found_by_stem(index):
    assert set(found(index, "cats")) == {"a", "b", "g"}
    assert found(index, "CATS") == found(index, "the cat")
    assert set(found(index, "run cats")) == {"b", "g"}
    assert found(index, "of the and") == found(index, "") == found(index, "?!") == found(index, "dog") == {}


def test_scores(index):
    n = {"a": 4, "b": 2, "c": 3, "d": 0, "e": 0, "f": 0, "g": 5}
    mean = sum(n.values()) / 7
    idf = math.log((7 - 3 + 0.5) / 3.5 + 1)
    for i, tf in (("a", 2), ("b", 1), ("g", 3)):
        assert found(index, "cat")[i] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n[i] / mean)), abs=1e-6)


def test_written_and_made_postings_agree(rows, index):
    for q in ("cats", "running cat", "sit"):
        assert found(fulltext.Index.of(rows), q) == found(index, q)


def test_reads_only_its_stems_and_live_rows(rows, index):
    hits = se.text_hits(rows.where(F.col("id") != "b"), "cats", index)
    assert {r.id for r in hits.collect()} == {"a", "g"}
    plan = index.postings.sparkSession._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(stem" in plan or "EqualTo(stem,cat)" in plan
    assert "regexp_extract_all" not in plan


def test_empty_table(rows, tmp_path):
    assert found(fulltext.Index.build(rows.limit(0), str(tmp_path)), "cat") == {}


def test_postings_do_not_depend_on_the_words_stemmed_before(rows, index, monkeypatch):
    want = sorted(index.postings.collect())
    for most, some in ((0, 8192), (1, 8192), (1 << 17, 1)):
        monkeypatch.setattr(fulltext, "STEMMED", most)
        monkeypatch.setattr(fulltext, "STEMMED_ROWS", some)
        assert sorted(fulltext.postings(rows).collect()) == want


def test_words_are_dealt_once(rows):
    plan = fulltext.postings(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(stem") == 1 and "hashpartitioning(id" not in plan


def test_endings_that_no_rule_has(spark):
    words = [*STEMS[::2], "haus", "wagen", "12345", "gehen", "buch", "xylophon", "yy", "play", "boy's"]
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", english.stem("word").alias("a"), F.expr(english.stem_sql("word")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert "CASE WHEN NOT" in str(english.stem("word"))


def test_stop_words_open_no_index(rows):
    def opened():
        raise AssertionError("an index was opened")

    assert se.text_hits(rows, "what is this about", opened).collect() == []
    with pytest.raises(AssertionError):
        se.text_hits(rows, "cats", opened)


def test_stem_frequencies_deal_words_by_stem_and_row(spark):
    from engramix.plans import catalog

    plan = catalog.QUERIES["stem_frequencies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "SortMergeJoin [word" not in plan
