"""Substring dedup, decontamination and quality rules against brute force."""

import math
import random
from collections import Counter

import brute as B
import pytest
from pyspark.sql import functions as F

from corpuswatch.llm import decontamination as D
from corpuswatch.llm import quality_rules as Q
from corpuswatch.llm.substring_dedup import repeated_words

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards make toxic brew for evil queens and jovial kings".split()
PROSE = " ".join(w for k in range(4) for w in random.Random(k).sample(WORDS, len(WORDS)))


@pytest.mark.parametrize("first_length", [10, 5])
def test_repeated_words(awkward, empty, first_length):
    got = sorted(map(tuple, repeated_words(awkward, first_length=first_length).collect()), key=B.key)
    assert got == sorted(B.repeated([r[:2] for r in B.awkward_rows()]), key=B.key)
    assert repeated_words(empty).count() == 0


def items():
    texts = B.awkward_texts()
    inner = " ".join((texts[22] or "").split()[38:60])
    return [(1, inner), (2, "Two-three FOUR"), (3, None), (4, " . "), (5, "one two three four five"), (6, inner), (None, "x"), (10, "again and again and again and again and again and again")]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(items(), "item_id bigint, text string")


@pytest.mark.parametrize("max_windows", [D.MAX_WINDOWS, 9])
def test_contaminated_words(awkward, benchmark, empty, max_windows):
    found = D.scan(awkward, benchmark, max_windows=max_windows)
    assert set(awkward.columns) <= set(found.columns)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()), key=B.key)
    assert got == sorted(B.contaminated([r[:2] for r in B.awkward_rows()], items()), key=B.key)
    assert D.scan(empty, benchmark).count() == 0
    assert D.scan(awkward, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_removal(awkward, benchmark):
    cut = D.remove_spans(awkward, benchmark)
    assert cut.columns == awkward.columns and cut.count() == awkward.count() == cut.where("items = 'own items'").count()
    long = D.scan(cut, benchmark.where("item_id in (1, 6)"))
    assert long.where("n_hit > 0").count() == 0
    kept = D.remove_documents(awkward, benchmark)
    assert kept.columns == awkward.columns
    clean = [r for r in B.contaminated([r[:2] for r in B.awkward_rows()], items()) if not r[2]]
    assert kept.count() == len(clean)


def test_quality_rules(awkward, empty):
    out = Q.judged(awkward)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{Q.TOKENIZERS}/{Q.VOCABULARY}")
    for r in out.collect():
        want = B.base_counts(r.text)
        assert tuple(r[c] for c in names) == want
        tokens = [t for w in B.BLANK.findall(r.text or "") for t in model.encode(w)]
        assert r.n_tokens == len(tokens)
        if tokens:
            assert r.chars_per_token == pytest.approx(want[1] / len(tokens))
            assert r.byte_share == pytest.approx(sum(map(model.is_byte, tokens)) / len(tokens))
            assert r.token_entropy == pytest.approx(-sum(c / len(tokens) * math.log2(c / len(tokens)) for c in Counter(tokens).values()), abs=1e-9)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert Q.judged(empty).count() == 0
    prose = awkward.withColumn("text", F.when(F.col("doc_id") == 5, PROSE).otherwise(F.col("text")))
    kept = Q.kept_documents(prose)
    assert kept.columns == awkward.columns and [r.doc_id for r in kept.where("n_words = 'own n_words'").collect()] == [5]


def test_bands_per_language_and_script(spark):
    rows = [(1, PROSE, "en"), (2, PROSE, "xx"), (3, "абвгд ежзик лмноп " * 20, "ru"), (4, " ".join(f"{i}" for i in range(1000, 1100)), None), (5, "ꙮ" * 300 + " " + " ".join(f"ꙮ{i}" for i in range(60)), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in Q.measured(df).collect()}
    assert [out[i].script for i in range(1, 6)] == ["latin", "latin", "two_byte", "none", "wide"]
    assert out[5].byte_share > 0.5 > out[3].byte_share
    strict = {"xx": Q.Band(100, 200, 0, 0)}
    kept = {r.doc_id: r.kept for r in Q.judged(df, max_repeat_percent=100, languages=strict).collect()}
    assert kept[1] and not kept[2] and not kept[4]
    assert Q.judged(df.drop("lang")).where(F.col("doc_id") == 1).count() == 1


def test_fertility_alone_rejects(spark):
    """Texts that the base rules pass and the vocabularies do not: random letters, hexadecimal, base64, text decoded wrongly twice."""
    import base64
    import random

    from corpuswatch.llm import quality_rules as Q

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr' and n_chars > 800").limit(20).collect()]
    bad = []
    for _ in range(20):
        bad.append(("en", " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 10))) for _ in range(200))))
        bad.append((None, " ".join(f"{rng.getrandbits(64):016x}" for _ in range(100))))
        bad.append(("xx", " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(80))))
    bad += [("fr", t.encode().decode("latin-1").encode().decode("latin-1")) for t in prose]
    rows = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(bad)], "doc_id bigint, text string, lang string")
    got = Q.judged(rows).collect()
    assert not any(r.base_failed and r.lang != "fr" for r in got) and not any(r.kept for r in got)
    real = Q.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang"))
    lost = real.where("not base_failed and not kept").count()
    assert lost <= 0.02 * real.where("not base_failed").count()


def test_base_columns_equal_sql(spark):
    import duckdb

    from corpuswatch.llm import quality_rules as Q

    sf = "/root/testdata/sf0.001"
    got = Q.judged(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    sql = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM '{sf}/documents.parquet'),
    l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    c AS (SELECT doc_id, count_if(k > 1) AS n FROM l GROUP BY doc_id),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS x FROM d WHERE len(w) > 2),
    r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
    s AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, range(3) AS q(k) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT, coalesce(c.n, 0)::BIGINT, coalesce(s.n, 0)::BIGINT,
      len(w) < 50 OR 100 * coalesce(s.n, 0) > 50 * len(w)
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) ORDER BY doc_id"""
    assert [tuple(r) for r in got.select(*names.split(", ")).orderBy("doc_id").collect()] == duckdb.sql(sql).fetchall()
