import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuswatch.functions.fingerprints import hamming, jaccard, simhash64
from corpuswatch.operators import dedup as D

T0 = dt.datetime(2024, 1, 1)


def articles(spark, rows):
    """Rows (title, content, minute)."""
    data = [(f"u{i:04d}", t, c, T0 + dt.timedelta(minutes=m)) for i, (t, c, m) in enumerate(rows)]
    df = spark.createDataFrame(data, "url string, title string, content string, crawled_at timestamp")
    from corpuswatch.operators.identity import with_content_hash

    return with_content_hash(df)


def urls(df):
    return sorted(r["url"] for r in df.select("url").collect())


def python_words(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip().split()


def python_simhash(text):
    """A bit is set if more than half of the word occurrences have it in the last 64 bits of their md5."""
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in python_words(text)]
    bits = "".join("1" if 2 * sum(h >> place & 1 for h in hashes) > len(hashes) else "0" for place in reversed(range(64)))
    return int.from_bytes(int(bits, 2).to_bytes(8), signed=True)


def test_simhash_equals_definition(spark):
    texts = ["", "one", "l'été à Paris, déjà vu!", "a b a b a", "x_y z-9", " \n\t ", "word " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"] for r in df.select("t", simhash64(F.col("t")).alias("s")).collect()]
    assert got == [python_simhash(t) for t in texts]


def test_hamming_and_jaccard(spark):
    row = spark.range(1).select(
        hamming(F.lit(-1), F.lit(0)).alias("h"),
        jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"),
        jaccard(F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<int>)")).alias("e"),
    ).first()
    assert (row["h"], round(row["j"], 6), row["e"]) == (64, 0.333333, 1.0)


def near_fingerprints(n, seed=3):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        v = rng.choice(centers)
        for bit in rng.sample(range(64), rng.randint(0, 7)):
            v ^= 1 << bit
        out.append(v - (1 << 64) if v >> 63 else v)
    return out


def greedy(values, close):
    kept = []
    for i, v in enumerate(values):
        if not any(close(v, values[j]) for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("blocks,hot_limit", [(7, 1000), (8, 1000), (7, 1), (7, 3)])
def test_simhash_dedup_equals_brute_force(spark, blocks, hot_limit):
    """Also with tiny hot limits: the leader rounds and the pair join give the same result."""
    values = near_fingerprints(120)
    rows = [(f"u{i:04d}", v, T0 + dt.timedelta(minutes=i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "url string, simhash long, crawled_at timestamp")
    kept = D.dedup_simhash(df, blocks=blocks, hot_limit=hot_limit)
    want = greedy(values, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 5)
    assert urls(kept) == [f"u{i:04d}" for i in want]


def test_any_earlier_differs_on_chains(spark):
    """A~B~C with A not near C: greedy keeps C, any_earlier drops it."""
    a, b, c = 0, 0b1111, 0b11111111
    df = spark.createDataFrame(
        [(u, v, T0 + dt.timedelta(minutes=i)) for i, (u, v) in enumerate([("a", a), ("b", b), ("c", c)])],
        "url string, simhash long, crawled_at timestamp",
    )
    assert urls(D.dedup_simhash(df)) == ["a", "c"]
    assert urls(D.dedup_simhash(df, keep="any_earlier")) == ["a"]


def test_reference_mode_needs_equal_fingerprints(spark):
    df = spark.createDataFrame(
        [("a", 0, T0), ("b", 1, T0 + dt.timedelta(minutes=1)), ("c", 0, T0 + dt.timedelta(days=2))], "url string, simhash long, crawled_at timestamp"
    )
    assert urls(D.dedup_simhash(df, mode="reference")) == ["a", "b"]
    assert urls(D.dedup_simhash(df, mode="reference", ttl_seconds=86400)) == ["a", "b", "c"]


def test_exact_dedup_memory(spark):
    day = 24 * 60
    df = articles(spark, [("t", "x", 0), ("t", "x", 6 * day), ("t", "x", 7 * day), ("t", "x", 13 * day), ("other", "x", 1)])
    assert urls(D.dedup_exact(df)) == ["u0000", "u0004"]
    # The memory counts from the kept row: day 6 is inside it, day 7 opens a new one that covers day 13.
    assert urls(D.dedup_exact(df, ttl_seconds=D.EXACT_TTL_SECONDS)) == ["u0000", "u0002", "u0004"]


def variants(n, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocab) for _ in range(60)] for _ in range(n // 5)]
    out = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        out.append(("t", " ".join(ws), i))
    return out


@pytest.mark.parametrize("hot_limit", [1000, 1])
def test_minhash_dedup_is_idempotent_and_justified(spark, hot_limit):
    df = articles(spark, variants(80))
    kept = D.dedup_minhash(df, chars=None, hot_limit=hot_limit).cache()
    again = D.dedup_minhash(kept, chars=None, hot_limit=hot_limit)
    assert urls(kept) == urls(again)
    shuffled = df.orderBy(F.rand(1))
    assert urls(D.dedup_minhash(shuffled, chars=None, hot_limit=hot_limit)) == urls(kept)
    rows = {r["url"]: set(python_words(f"{r['title']} {r['content']}")) for r in df.collect()}
    kept_urls = set(urls(kept))
    for u, ws in rows.items():
        if u not in kept_urls:
            assert any(k < u and len(rows[k] & ws) / len(rows[k] | ws) >= 0.85 for k in kept_urls)


def test_hot_and_cold_minhash_agree(spark):
    df = articles(spark, variants(80, seed=9))
    assert urls(D.dedup_minhash(df, chars=None, hot_limit=1)) == urls(D.dedup_minhash(df, chars=None, hot_limit=1000))


def test_lsh_recall(spark):
    """Most pairs well above the threshold meet in a band."""
    rng = random.Random(1)
    rows = []
    for i in range(40):
        ws = [f"k{i}_{j}" for j in range(100)]
        other = list(ws)
        for j in rng.sample(range(100), 4):
            other[j] += "x"
        rows += [("t", " ".join(ws), 2 * i), ("t", " ".join(other), 2 * i + 1)]
    kept = D.dedup_minhash(articles(spark, rows), chars=None).count()
    assert kept <= 48


def test_layers_report_who_dropped(spark):
    body = " ".join(f"w{i}" for i in range(90))
    rows = [("t", body, 0), ("t", body, 1), ("t", body.replace("w3 ", "w3x "), 2), ("solo", "something else entirely", 3)]
    got = {r["url"]: r["dropped_by"] for r in D.dedup_articles(articles(spark, rows)).collect()}
    assert got["u0000"] is None and got["u0001"] == "exact" and got["u0003"] is None
    assert got["u0002"] in ("simhash", "minhash")
    assert len(got) == 4


def test_hot_copies_collapse(spark):
    """A third of the rows is one text; another third shares one fingerprint bucket."""
    rows = [("t", "the same text", i) for i in range(300)] + [("t", f"the same text {i}", 300 + i) for i in range(30)]
    df = articles(spark, rows)
    got = D.dedup_articles(df)
    assert got.count() == 330
    assert got.where("dropped_by = 'exact'").count() == 299


def test_no_cartesian_plans(spark):
    df = D.with_simhash(articles(spark, variants(10)))
    plan = D.dedup_exact(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "WindowGroupLimit" in plan


def test_undated_rows_are_kept(spark):
    df = articles(spark, [("a", "x y z", 0), ("b", "other words here", 1)]).withColumn("crawled_at", F.expr("if(url = 'u0001', null, crawled_at)"))
    assert urls(D.dedup_minhash(df)) == urls(D.dedup_simhash(df)) == ["u0000", "u0001"]
    assert D.dedup_articles(df).where("dropped_by is null").count() == 2


def test_many_different_members_of_one_bucket_leave_no_hot_bucket(spark):
    """Fingerprints with 20 bits in common, and sets with common words: finer keys split them, and the result stays that of brute force."""
    rng = random.Random(5)
    values = [(rng.getrandbits(43) << 20) | 0x5A5A5 for _ in range(600)]
    values += [v ^ 1 << rng.randrange(20, 63) for v in values[:60]]
    items = spark.createDataFrame([(v, i, v) for i, v in enumerate(values)], "id long, ord int, payload long")
    close = lambda a, b: hamming(a, b) <= 5
    members = D.bucket_members(items, D.simhash_blocks(F.col("payload"), 7, 5))
    assert members.where("n > 100").count() > 0
    found = D.split_candidates(members, items, close, 100, lambda rows: D.finer_blocks(rows, 5), named=True)
    assert found.hot.count() == 0
    kept = greedy(values, lambda a, b: (a ^ b).bit_count() <= 5)
    dropped = {r["id"] for r in D.keep_first(found, close).collect()}
    assert set(values) - dropped == {values[i] for i in kept}

    sets = [sorted({*range(10), *rng.sample(range(100, 5000), 30)}) for _ in range(300)]
    sets += [sorted({*s[:-1], 9000 + i}) for i, s in enumerate(sets[:40])]
    sets.append([])
    items = spark.createDataFrame([(str(i), i, s) for i, s in enumerate(sets)], "id string, ord int, payload array<long>")
    similar = lambda a, b: jaccard(a, b) >= 0.85
    members = D.bucket_members(items, F.array(F.lit(1).cast("long")))
    found = D.split_candidates(members, items, similar, 100, lambda rows: D.rarest_words(rows, 0.85))
    assert found.hot.count() == 0
    kept = greedy([frozenset(s) for s in sets], lambda a, b: len(a & b) >= 0.85 * len(a | b))
    dropped = {int(r["id"]) for r in D.keep_first(found, similar).collect()}
    assert set(range(len(sets))) - dropped == set(kept)


def test_rarest_words_keep_every_similar_pair(spark):
    rng = random.Random(8)
    sets = []
    for n in (1, 2, 6, 7, 13, 20, 40, 100):
        base = rng.sample(range(3000), n)
        for _ in range(6):
            cut = rng.sample(base, n - rng.randint(0, n * 15 // 100))
            sets.append(sorted({*cut, *rng.sample(range(3000), rng.randint(0, n * 15 // 100))}))
    items = spark.createDataFrame([(str(i), i, s) for i, s in enumerate(sets)], "id string, ord int, payload array<long>")
    rows = D.rarest_words(items, 0.85)
    met = rows.alias("a").join(rows.alias("b"), "bucket").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    pairs = {(r["a"], r["b"]) for r in met.collect()}
    want = {(str(i), str(j)) for i, x in enumerate(sets) for j, y in enumerate(sets) if len({*x} & {*y}) / len({*x, *y}) >= 0.85}
    assert len(want) > len(sets) and want <= pairs


@pytest.mark.parametrize("hot_limit", [1000, 1])
def test_any_earlier_equals_brute_force_in_large_buckets(spark, hot_limit):
    values = near_fingerprints(120)
    rows = [(f"u{i:04d}", v, T0 + dt.timedelta(minutes=i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "url string, simhash long, crawled_at timestamp")
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 5
    want = [f"u{i:04d}" for i, v in enumerate(values) if not any(near(v, w) for w in values[:i])]
    assert urls(D.dedup_simhash(df, keep="any_earlier", hot_limit=hot_limit)) == want


@pytest.mark.parametrize("size", [8, 100, 1000])
def test_first_fingerprints_over_rounds_equal_brute_force(spark, size):
    """A crowd within a few bits of each other and spread ones, over one round and over many, without a list of pairs."""
    rng = random.Random(6)
    values = list(dict.fromkeys([*near_fingerprints(300), *(rng.getrandbits(64) - (1 << 63) for _ in range(100)), 0, -1]))
    rng.shuffle(values)
    items = spark.createDataFrame([(v, i) for i, v in enumerate(values)] + [(None, -1)], "id long, ord int").repartition(5)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 5
    got = sorted(r["id"] for r in D.first_fingerprints(items, 5, size).collect())
    assert got == sorted(values[i] for i in greedy(values, near))
    assert D.first_fingerprints(items.limit(0), 5, size).count() == 0


def test_simhash_dedup_lists_no_pairs_and_no_buckets(spark, monkeypatch):
    """Crowded fingerprints made buckets whose pairs and finer keys did not fit; keep-first must not build them."""
    monkeypatch.setattr(D, "bucket_members", None)
    values = list(dict.fromkeys(near_fingerprints(120)))
    rows = [(f"u{i:04d}", v, T0 + dt.timedelta(minutes=i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "url string, simhash long, crawled_at timestamp")
    want = greedy(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 5)
    assert urls(D.dedup_simhash(df)) == [f"u{i:04d}" for i in want]


@pytest.mark.parametrize("size", [16, 1000])
def test_last_known_value_of_close_fingerprints(spark, size):
    from corpuswatch.operators.fingerprint_tiles import last_known

    values = list(dict.fromkeys(near_fingerprints(200)))
    mine, known = values[:80], [(v, 10 * i - 700) for i, v in enumerate(values[60:])]
    got = last_known(spark.createDataFrame([(v,) for v in mine], "id long"), spark.createDataFrame(known, "id long, value long"), 5, size)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 5
    want = {a: max(n for b, n in known if near(a, b)) for a in mine if any(near(a, b) for b, _ in known)}
    assert {r["id"]: r["value"] for r in got.collect()} == want


def test_kernels_hash_a_repeated_word_once(monkeypatch):
    """Fingerprints by definition over several slices, runs beyond a byte, rows without words; a slice hashes each distinct word once."""
    import pyarrow as pa

    from corpuswatch.functions import fingerprints as FP

    rng = random.Random(5)
    lists = [[f"w{int(rng.expovariate(0.1))}" for _ in range(n)] for n in (1, 254, 255, 256, 511, 0, 3000, 7, 0, 1200)]
    monkeypatch.setattr(FP, "CHUNK_BYTES", 2000)
    texts = pa.array([" ".join(x) for x in lists[:5]] + [None] + [" ".join(x) for x in lists[6:]])

    def bit(words, i):
        return sum(int(hashlib.md5(w.encode()).hexdigest()[16:], 16) >> i & 1 for w in words) * 2 > len(words)

    want = [sum(1 << i for i in range(64) if bit(x, i)) for x in lists]
    assert [v & (1 << 64) - 1 for v in FP._simhash_kernel.func(texts).to_pylist()] == want
    slices = list(FP._hashed(texts))
    assert len(slices) > 1 and sum(len(o) - 1 for _, _, o in slices) == len(lists)
    assert all(len(digests) == len(set(map(bytes, digests))) for digests, _, _ in slices)
    assert sum(len(digests) for digests, _, _ in slices) < sum(map(len, lists)) / 5


def test_minhash_equals_definition(spark):
    from corpuswatch.functions.fingerprints import MERSENNE_31, minhash, permutation_constants

    texts = ["a b a c", "", "the  cat, the DOG", " ".join(f"x{i % 90}" for i in range(700))]
    a, b = (x.tolist() for x in permutation_constants(16))
    want = []
    for t in texts:
        base = {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) & MERSENNE_31 for w in t.lower().replace(",", " ").split()}
        want.append([min([(h * a[i] + b[i]) % MERSENNE_31 for h in base], default=MERSENNE_31) for i in range(16)])
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", minhash(F.col("t"), 16).alias("m")).orderBy("i")
    assert [r.m for r in got.collect()] == want


def test_lsh_verified_makes_signatures_once(spark):
    """Leaders, members and word sets read what was written: no kernel is left in the plan of the pairs."""
    from corpuswatch.plans.queries import lsh_verified

    found = lsh_verified(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
