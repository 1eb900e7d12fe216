"""Exact and near-duplicate removal.

Size rules that hold for every function here:

* equal fingerprints collapse to one representative before anything is compared, so a group of copies costs
  one row, however large it is;
* a bucket of candidates is compared pair by pair only while it is small (``hot_limit``); the members of larger
  buckets get finer keys that every matching pair still shares (more blocks of a fingerprint, the rarest words of a
  set). What stays large under these is compared with the first undecided member, round after round, which needs one row
  per member and never lists the pairs of the bucket. All ways give the same, exact keep-first result;
* greedy keep-first of fingerprints needs no buckets: rounds of bounded size meet what was kept before (``fingerprint_tiles``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswatch.functions.fingerprints import band_keys, hamming, jaccard, minhash, simhash64
from corpuswatch.functions.text import computed_once, head, or_empty, words
from corpuswatch.operators.fingerprint_tiles import first_fingerprints
from corpuswatch.operators.identity import first_per_key, join_rows
from corpuswatch.session import broadcast_if_small, cut_lineage, stored

# Thresholds and memory of the three layers.
EXACT_TTL_SECONDS = 7 * 86400
SIMHASH_TTL_SECONDS = 3 * 86400
SIMHASH_DISTANCE, MINHASH_SIMILARITY, NUM_PERM = 5, 0.85, 128
# Characters of the content that the analysed system compares; here whole texts are the default.
REFERENCE_SIMHASH_CHARS, REFERENCE_MINHASH_CHARS = 300, 500
# Bands and rows of 128 permutations with the least false-positive plus false-negative area at 0.85.
BANDS, ROWS = 8, 16


def dedup_text(chars: int | None) -> Column:
    """The compared text: title, blank, start of the content (``None`` = all of it)."""
    return F.concat(or_empty(F.col("title")), F.lit(" "), head(or_empty(F.col("content")), chars))


# -- exact ------------------------------------------------------------------------------------------------


def anchored_windows(points: DataFrame, keys: list[str], ts: str, seconds: int, closed: bool) -> DataFrame:
    """Give every distinct (key, time) the start of the window it falls into; rows without a key or time are left out.

    A window opens at the first uncovered time of a key and covers ``seconds`` (``closed``: the end too). Every time is
    linked to the first one that a window from it would not cover; the starts are those that the links reach from the first time of
    a key. Pointer doubling finds them: each round follows twice as many links, so there are as many rounds as the number of
    windows has binary digits. Times meet in slots as wide as a window, never a whole key in one task.
    """
    width, kind = F.make_interval(secs=F.lit(seconds)), points.schema[ts].dataType
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    known = points.select(*keys, ts).where(" and ".join(f"`{c}` is not null" for c in [*keys, ts]))
    times = stored(known.distinct().withColumn("_slot", slot), "times")
    # Slots of a key in order, each with the next two that hold times.
    order = Window.partitionBy(*keys).orderBy("_slot")
    slots = times.groupBy(*keys, "_slot").agg(F.min(ts).alias("_first"))
    slots = slots.select(*keys, "_slot", F.lead("_slot").over(order).alias("_next"), F.lead("_first").over(order).alias("_one"), F.lead("_first", 2).over(order).alias("_two"))
    ahead = times.join(slots, [*keys, "_slot"])
    # A window that starts in a slot ends in the next one: there the first time beyond its end is looked up by order.
    near = ahead.where(F.col("_next") == F.col("_slot") + 1)
    line = times.select(*keys, "_slot", F.col(ts).alias("_t"), F.col(ts).alias("_point"), F.lit(None).cast(kind).alias("_from"), F.lit(None).cast(kind).alias("_two"))
    line = line.unionByName(near.select(
        *keys, (F.col("_slot") + 1).alias("_slot"), (F.col(ts) + width).cast(kind).alias("_t"), F.lit(None).cast(kind).alias("_point"), F.col(ts).alias("_from"), "_two"))
    tie = F.col("_point").isNotNull() if not closed else F.col("_point").isNull()
    beyond = Window.partitionBy(*keys, "_slot").orderBy("_t", tie).rowsBetween(1, Window.unboundedFollowing)
    met = line.withColumn("_here", F.min("_point").over(beyond)).where("_from is not null")
    links = met.select(*keys, F.col("_from").alias(ts), F.coalesce("_here", "_two").alias("_to"))
    links = links.unionByName(ahead.where(F.col("_next") > F.col("_slot") + 1).select(*keys, ts, F.col("_one").alias("_to")))
    links = stored(links.where("_to is not null"), "links")
    reached = stored(times.groupBy(*keys).agg(F.min(ts).alias(ts)), "starts")
    starts = [reached]
    while True:
        found = reached.join(links, [*keys, ts]).select(*keys, F.col("_to").alias(ts))
        found = stored(found, "starts")
        if found.isEmpty():
            break
        starts.append(found)
        reached = reduce(DataFrame.unionByName, starts)
        longer = links.select(*keys, F.col(ts).alias("_to"), F.col("_to").alias("_end"))
        links = stored(links.join(longer, [*keys, "_to"]).select(*keys, ts, F.col("_end").alias("_to")), "links")
    # The window of a time starts in its slot or the one before.
    marked = times.join(reached.withColumn("_anchor", F.col(ts)), [*keys, ts], "left")
    last = marked.groupBy(*keys, (F.col("_slot") + 1).alias("_slot")).agg(F.max("_anchor").alias("_before")).where("_before is not null")
    upto = Window.partitionBy(*keys, "_slot").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("_own", F.max("_anchor").over(upto))
    return own.join(last, [*keys, "_slot"], "left").select(*keys, ts, F.coalesce("_own", "_before").alias("anchor"))


def dedup_exact(
    df: DataFrame, key: str = "content_hash", ts: str = "crawled_at", tie: str = "url", ttl_seconds: int | None = None
) -> DataFrame:
    """First row per key; with ``ttl_seconds`` a key may return once that time after its kept row has passed."""
    if ttl_seconds is None:
        return first_per_key(df, [key], F.col(ts), F.col(tie))
    starts = anchored_windows(df, [key], ts, ttl_seconds, closed=False).where(F.col(ts) == F.col("anchor"))
    kept = df.join(starts.select(key, ts), [key, ts], "left_semi")
    return first_per_key(kept, [key, ts], F.col(tie)).select(*df.columns)


def drop_seen(df: DataFrame, seen: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose key is not in the seen table."""
    return df.join(seen.select(key), key, "left_anti")


# -- candidates -------------------------------------------------------------------------------------------


def with_simhash(df: DataFrame, chars: int | None = None) -> DataFrame:
    return df.withColumn("simhash", simhash64(dedup_text(chars)))


def with_minhash(df: DataFrame, chars: int | None = None, num_perm: int = NUM_PERM) -> DataFrame:
    return df.withColumn("minhash", minhash(dedup_text(chars), num_perm))


def block_masks(blocks: int, max_distance: int) -> list[int]:
    """Signed 64-bit masks for every choice of ``blocks - max_distance`` blocks.

    At most ``max_distance`` flipped bits leave that many blocks untouched, so two fingerprints within the
    distance agree under at least one mask.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for(n_rows: int, max_distance: int) -> int:
    """Fewest blocks whose key is wide enough that evenly spread fingerprints share it with few others."""
    need = max(math.log2(max(n_rows, 2)) - 2, 1)
    for blocks in range(max_distance + 2, max_distance + 6):
        if 64 * (blocks - max_distance) / blocks >= need:
            return blocks
    return max_distance + 5


def simhash_blocks(fingerprint: Column, blocks: int, max_distance: int) -> Column:
    masks = block_masks(blocks, max_distance)
    return F.array(*[F.xxhash64(F.lit(i), fingerprint.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])


@dataclass
class Candidates:
    """What the keep-first rounds work on: verified pairs of small buckets, members of large ones."""

    pairs: DataFrame  # a, b: a comes first and matches b
    hot: DataFrame  # bucket, id, ord, payload


def sized_buckets(members: DataFrame) -> DataFrame:
    """Rows (bucket, id, ord) with the size ``n`` of their bucket, without the buckets that hold a single item."""
    members = cut_lineage(members)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(members.join(sizes, "bucket"))


def bucket_members(items: DataFrame, buckets: Column) -> DataFrame:
    """One row per item and bucket, without the buckets that hold a single item and without payloads."""
    return sized_buckets(items.select(F.explode(F.array_distinct(buckets)).alias("bucket"), "id", "ord"))


#: Blocks of the finer keys of fingerprints, beyond the distance: keys of about 32 bits at a distance of 5.
FINER_BLOCKS = 5


def finer_blocks(items: DataFrame, max_distance: int) -> DataFrame:
    """Rows (bucket, id, ord) of fingerprints under keys of more bits; a pair within the distance shares at least one."""
    keys = simhash_blocks(F.col("payload"), max_distance + FINER_BLOCKS, max_distance)
    return items.select(F.explode(F.array_distinct(keys)).alias("bucket"), "id", "ord")


def rarest_words(items: DataFrame, min_sim: float) -> DataFrame:
    """Rows (bucket, id, ord) of word sets under their rarest words; a pair that reaches ``min_sim`` shares at least one.

    Two sets of which neither has more than ``|x| - ceil(min_sim * |x|)`` words of its own meet among the first so many and one more
    words of each, in any order common to both; here rare words come first. A key also holds the band of the set's size: linked sets
    are in the same or in neighbouring bands.
    """
    words_of = items.select("id", F.size("payload").alias("_size"), F.explode("payload").alias("_word"))
    counts = words_of.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("id").orderBy("_n", "_word")
    # A little below the product, so that rounding never shortens the start.
    least = F.ceil(F.col("_size") * F.lit(min_sim) - F.lit(1e-6))
    first = words_of.join(counts, "_word").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("_size") - least + 1)
    band = F.floor(F.log(F.col("_size").cast("double")) / F.lit(-math.log(min_sim) + 1e-9))
    keyed = first.select("id", "_word", F.explode(F.array(band, band + 1)).alias("_band"))
    return keyed.join(items.select("id", "ord"), "id").select(F.xxhash64("_word", "_band").alias("bucket"), "id", "ord")


def split_candidates(
    members: DataFrame, items: DataFrame, match: Callable[[Column, Column], Column], hot_limit: int,
    finer: Callable[[DataFrame], DataFrame] | None = None, named: bool = False,
) -> Candidates:
    """Verified pairs of buckets up to ``hot_limit``, and the members of buckets that stay larger under finer keys.

    ``finer`` gives items new buckets (rows bucket, id, ord) that every matching pair shares. With ``named`` the id is the payload itself and
    pairs are checked where they meet; else they meet by id, and each distinct pair gets its two payloads once, however many buckets it shares.
    """
    small, hot = members.where(F.col("n") <= hot_limit), members.where(F.col("n") > hot_limit)
    if finer is not None and not hot.isEmpty():
        again = sized_buckets(finer(items.join(hot.select("id").distinct(), "id", "left_semi")))
        small, hot = small.unionByName(again.where(F.col("n") <= hot_limit)), again.where(F.col("n") > hot_limit)
    a, b = small.alias("a"), small.alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.ord") < F.col("b.ord"))
    if named:
        on = on & match(F.col("a.id"), F.col("b.id"))
    pairs = a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    if not named:
        for side in "ab":
            pairs = pairs.join(items.select(F.col("id").alias(side), F.col("payload").alias(f"_{side}")), side)
        pairs = pairs.where(match(F.col("_a"), F.col("_b"))).select("a", "b")
    return Candidates(cut_lineage(pairs), cut_lineage(hot.drop("n").join(items.select("id", "payload"), "id")))


def keep_first(found: Candidates, match: Callable[[Column, Column], Column], mode: str = "greedy"):
    """Ids (column ``id``) to drop: items that match an earlier item that is itself kept.

    ``mode="any_earlier"`` drops every item with an earlier match, kept or not; the two differ on chains
    A~B~C; in large buckets its pairs are checked where they meet, and only matches are written. Greedy works in rounds: an item that
    is nobody's later match and leads all its large buckets is kept, and its matches go. The earliest open item is always decided, so the
    rounds end.
    """
    if mode == "any_earlier":
        a, b = found.hot.alias("a"), found.hot.alias("b")
        on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.ord") < F.col("b.ord")) & match(F.col("a.payload"), F.col("b.payload"))
        late = found.pairs.select(F.col("b").alias("id")).unionByName(b.join(a, on, "left_semi").select("id"))
        return late.distinct()
    pairs, hot, dropped = found.pairs, found.hot, None
    has_hot = not hot.isEmpty()
    while has_hot or not pairs.isEmpty():
        waiting, blocked = pairs.select(F.col("a").alias("id")), pairs.select(F.col("b").alias("id"))
        if has_hot:
            leaders = hot.groupBy("bucket").agg(F.min_by(F.struct("id", "payload"), "ord").alias("l"))
            followers = hot.join(leaders, "bucket").where("id != l.id")
            waiting = waiting.unionByName(hot.select("id"))
            blocked = blocked.unionByName(followers.select("id"))
        kept = waiting.distinct().join(blocked, "id", "left_anti")
        if has_hot:
            kept = cut_lineage(kept)
        gone = pairs.join(kept, pairs.a == kept.id, "left_semi").select(F.col("b").alias("id"))
        if has_hot:
            led = followers.withColumn("leader", F.col("l.id")).join(kept.withColumnRenamed("id", "leader"), "leader", "left_semi")
            gone = gone.unionByName(led.where(match(F.col("l.payload"), F.col("payload"))).select("id"))
        gone = cut_lineage(gone.distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        # The matches of a kept item are all gone now, so its pairs leave with them.
        pairs = cut_lineage(
            pairs.join(gone, pairs.a == gone.id, "left_anti").join(gone, F.col("b") == gone.id, "left_anti")
        )
        if has_hot:
            hot = cut_lineage(hot.join(kept.unionByName(gone), "id", "left_anti").select("bucket", "id", "ord", "payload"))
            has_hot = not hot.isEmpty()
    return dropped if dropped is not None else pairs.select(F.col("b").alias("id"))


def keep_first_by_bucket(members: DataFrame) -> DataFrame:
    """Ids to drop when sharing a bucket is enough to match (no check of the pair itself).

    A bucket then holds at most one kept item, so each round needs only the first undecided item per bucket.
    """
    members = cut_lineage(members.select("bucket", "id", "ord"))
    dropped = None
    while not members.isEmpty():
        leaders = members.groupBy("bucket").agg(F.min_by("id", "ord").alias("leader"))
        led = members.join(leaders, "bucket")
        state = led.groupBy("id").agg(F.min((F.col("id") == F.col("leader")).cast("int")).alias("leads"))
        kept = cut_lineage(state.where("leads = 1").select("id"))
        hit = led.join(kept.withColumnRenamed("id", "leader"), "leader", "left_semi")
        gone = cut_lineage(hit.where("id != leader").select("id").distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        members = cut_lineage(
            members.join(kept.unionByName(gone), "id", "left_anti").select("bucket", "id", "ord")
        )
    return dropped if dropped is not None else members.select("id")


def lsh_candidates(df: DataFrame, id_col: str = "url", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Band rows (``band``, ``band_key``, id) of a table with a ``minhash`` column."""
    keys = band_keys(F.col("minhash"), bands, rows)
    return df.select(F.col(id_col), F.posexplode(keys).alias("band", "band_key"))


def verify_jaccard(pairs: DataFrame, min_sim: float = MINHASH_SIMILARITY) -> DataFrame:
    """Pairs (with word arrays ``words_a``, ``words_b``) whose Jaccard similarity reaches the bound."""
    checked = pairs.withColumn("jaccard", jaccard(F.col("words_a"), F.col("words_b")))
    return checked.where(F.col("jaccard") >= min_sim)


# -- layers -----------------------------------------------------------------------------------------------
#
# Layers work on a narrow table (order columns and fingerprints, never the text). It is read from the
# articles once, written to the checkpoint folder, and the surviving rows are joined back at the end.
# ``ts`` and ``tie`` together name a row.


def _ordered(ts: str, tie: str) -> Column:
    return F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))


def word_set_columns(chars: int | None, bands: int, rows: int) -> dict[str, Column]:
    """Word hashes of the compared text, the id of that set of words, and its band keys.

    A signature depends on the set only, so equal sets share one id.
    """
    text = dedup_text(chars)
    hashes = F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))
    return {"_words": hashes, "_bands": band_keys(minhash(text, bands * rows), bands, rows)}


def with_word_sets(df: DataFrame, keep: list[str], chars: int | None, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Narrow table with the ``keep`` columns and the word-set columns ``_set``, ``_words`` and ``_bands``."""
    hashed = computed_once(df, **word_set_columns(chars, bands, rows)).select(*keep, "_words", "_bands")
    spelled = F.array_join(F.transform("_words", lambda h: h.cast("string")), ",")
    return hashed.withColumn("_set", F.sha2(spelled, 256))


def word_set_items(narrow: DataFrame, ts: str, tie: str) -> DataFrame:
    """One item per distinct word set: id, order of its first row, word hashes and bands."""
    first = first_per_key(narrow, ["_set"], F.col(ts), F.col(tie))
    return first.select(F.col("_set").alias("id"), _ordered(ts, tie).alias("ord"), F.col("_words").alias("payload"), "_bands")


def simhash_items(narrow: DataFrame, ts: str, tie: str) -> DataFrame:
    """One item per distinct fingerprint."""
    first = narrow.groupBy("simhash").agg(F.min(_ordered(ts, tie)).alias("ord"))
    return first.select(F.col("simhash").alias("id"), "ord", F.col("simhash").alias("payload"))


def _survivors(narrow: DataFrame, value: str, dropped: DataFrame, ts: str, tie: str) -> DataFrame:
    """Narrow rows that stay: the first per fingerprint, unless that fingerprint was dropped."""
    first = first_per_key(narrow, [value], F.col(ts), F.col(tie))
    return first.join(dropped.withColumnRenamed("id", value), value, "left_anti").select(*narrow.columns)


def _simhash_layer(narrow, max_distance, mode, blocks, hot_limit, keep, ttl_seconds, ts, tie) -> DataFrame:
    if mode == "reference":
        return dedup_exact(narrow, "simhash", ts, tie, ttl_seconds)

    def match(a: Column, b: Column) -> Column:
        return hamming(a, b) <= max_distance

    items = cut_lineage(simhash_items(narrow, ts, tie))
    if keep == "greedy":
        kept = first_fingerprints(items, max_distance)
        return _survivors(narrow, "simhash", items.select("id").where("id is not null").join(kept, "id", "left_anti"), ts, tie)
    n_blocks = blocks or blocks_for(items.count(), max_distance)
    members = bucket_members(items, simhash_blocks(F.col("payload"), n_blocks, max_distance))
    found = split_candidates(members, items, match, hot_limit, lambda rows: finer_blocks(rows, max_distance), named=True)
    return _survivors(narrow, "simhash", keep_first(found, match, keep), ts, tie)


def _minhash_layer(narrow, min_sim, verify, hot_limit, keep, ts, tie, words=None) -> DataFrame:
    """Rows of ``narrow`` that stay; ``words`` (_set, _words), where ``narrow`` has no ``_words``. Only sets that share a band with another need theirs."""

    def match(a: Column, b: Column) -> Column:
        return jaccard(a, b) >= min_sim

    first = first_per_key(narrow.select("_set", ts, tie, "_bands"), ["_set"], F.col(ts), F.col(tie))
    first = cut_lineage(first.select(F.col("_set").alias("id"), _ordered(ts, tie).alias("ord"), "_bands"))
    members = bucket_members(first, F.col("_bands"))
    if verify:
        met = broadcast_if_small(members.select("id").distinct())
        known = (narrow if words is None else words).select(F.col("_set").alias("id"), F.col("_words").alias("payload"))
        known = known.join(met, "id", "left_semi").dropDuplicates(["id"])
        items = cut_lineage(known.join(first.select("id", "ord"), "id").select("id", "ord", "payload"))
        dropped = keep_first(split_candidates(members, items, match, hot_limit, lambda rows: rarest_words(rows, min_sim)), match, keep)
    else:
        dropped = keep_first_by_bucket(members)
    return _survivors(narrow, "_set", dropped, ts, tie)


def dedup_simhash(
    df: DataFrame, max_distance: int = SIMHASH_DISTANCE, mode: str = "intended", blocks: int | None = None,
    hot_limit: int = 1000, chars: int | None = None, keep: str = "greedy", ttl_seconds: int | None = None,
    ts: str = "crawled_at", tie: str = "url",
) -> DataFrame:
    """Rows kept by the SimHash layer, with their ``simhash``.

    ``intended``: a row goes when a kept earlier row is within ``max_distance`` bits. ``reference``: only an
    equal fingerprint counts, optionally remembered for ``ttl_seconds``. ``blocks`` and ``hot_limit`` shape the buckets of
    ``keep="any_earlier"``.
    """
    hashed = df if "simhash" in df.columns else with_simhash(df, chars)
    narrow = cut_lineage(hashed.select(ts, tie, "simhash"))
    kept = _simhash_layer(narrow, max_distance, mode, blocks, hot_limit, keep, ttl_seconds, ts, tie)
    return join_rows(df.drop("simhash"), kept, [ts, tie], "inner")


def dedup_minhash(
    df: DataFrame, min_sim: float = MINHASH_SIMILARITY, verify: bool = True, hot_limit: int = 1000,
    chars: int | None = None, bands: int = BANDS, rows: int = ROWS, keep: str = "greedy",
    ts: str = "crawled_at", tie: str = "url",
) -> DataFrame:
    """Rows kept by the MinHash layer: no kept earlier row shares a band (and, verified, reaches ``min_sim``)."""
    narrow = cut_lineage(with_word_sets(df, [ts, tie], chars, bands, rows))
    kept = _minhash_layer(narrow, min_sim, verify, hot_limit, keep, ts, tie)
    return join_rows(df, kept.select(ts, tie), [ts, tie], "left_semi")


def dedup_articles(
    df: DataFrame, mode: str = "intended", ts: str = "crawled_at", tie: str = "url", hot_limit: int = 1000,
    exact_ttl_seconds: int | None = None, simhash_ttl_seconds: int | None = None,
):
    """Every row with ``dropped_by``: exact, simhash, minhash, or null for the kept rows.

    Each layer judges only the rows that passed the layers before it. ``intended`` compares whole texts by Hamming distance and the
    Jaccard check; ``mode="reference"`` compares the starts of the texts by equal fingerprints and unverified bands. The first two
    layers may forget: give ``EXACT_TTL_SECONDS`` and ``SIMHASH_TTL_SECONDS`` for the memory of the analysed system (the
    second one only counts for equal fingerprints, so in reference mode).
    """
    key = ["content_hash", ts, tie]
    simhash_chars, minhash_chars = (REFERENCE_SIMHASH_CHARS, REFERENCE_MINHASH_CHARS) if mode == "reference" else (None, None)
    narrow = cut_lineage(with_word_sets(with_simhash(df, simhash_chars), [*key, "simhash"], minhash_chars))
    exact = cut_lineage(dedup_exact(narrow, ts=ts, tie=tie, ttl_seconds=exact_ttl_seconds))
    near = cut_lineage(_simhash_layer(exact, SIMHASH_DISTANCE, mode, None, hot_limit, "greedy", simhash_ttl_seconds, ts, tie))
    kept = _minhash_layer(near, MINHASH_SIMILARITY, mode == "intended", hot_limit, "greedy", ts, tie)
    # How many layers a row passed, as one small table that is joined to the articles once.
    passed = exact.select(*key).unionByName(near.select(*key)).unionByName(kept.select(*key))
    passed = passed.groupBy(*key).agg(F.count(F.lit(1)).alias("_passed"))
    n = F.coalesce("_passed", F.lit(0))
    dropped_by = F.when(n == 0, "exact").when(n == 1, "simhash").when(n == 2, "minhash")
    return join_rows(df, passed, key, "left").withColumn("dropped_by", dropped_by).drop("_passed")
