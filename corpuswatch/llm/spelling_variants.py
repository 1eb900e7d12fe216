"""Spelling variant grouping: a sorted vocabulary is scanned with banded edit-matrix rows that adjacent words share.

1. Runs of letters are counted over all texts; the frequent ones are the vocabulary.
2. Words are dealt into blocks in which every near pair meets once. Two near words first differ at one place. Those that agree in their
   first three code points meet in the block of that prefix; the others agree in all that follows these three (four in a
   longer partner) and meet in the block of that remainder. A prefix block that holds too many words is dealt again by its next three
   code points, so no block grows with the corpus: a remainder block holds at most the spellings of four places.
3. In a block the words are a sorted list; neighbours share the rows of the edit matrix up to their longest common prefix (LCP).
   The scan goes by depth: a range of words with a common prefix is one entry, with one band of three cells for each word that is
   compared with it. Children of a range reuse its band; a range whose band has no cell within one edit is skipped whole.
   Blocks are named by 64-bit hashes; two of one name (chance below 1e-6 for a billion blocks) could hide a pair.
4. The nearest frequent word of each word is its form; forms are followed by pointer doubling to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm.tables import stored
from corpuswatch.session import broadcast_if_small

#: Code points by which words are dealt at a time.
STEP = 3
#: Words of a prefix block that is scanned as it is; a larger one is dealt again.
BLOCK = 20_000
#: Words that a kernel scans at a time (whole blocks).
CHUNK = 30_000
FAR = 2


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in turn, and where each word begins."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    first = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), out=first[1:])
    return flat, first


def shared_prefixes(codes: np.ndarray, first: np.ndarray, block: np.ndarray) -> np.ndarray:
    """LCP of each word with the one before it in the sorted list; -1 at the first word of a block."""
    size = np.diff(first)
    lcp = np.zeros(len(size), dtype=np.int64)
    if len(size):
        lcp[0] = -1
    going = np.flatnonzero(block[1:] == block[:-1]) + 1
    lcp[np.flatnonzero(block[1:] != block[:-1]) + 1] = -1
    depth = 0
    while len(going):
        going = going[(size[going] > depth) & (size[going - 1] > depth)]
        going = going[codes[first[going] + depth] == codes[first[going - 1] + depth]]
        depth += 1
        lcp[going] = depth
    return lcp


def near_pairs(words: list[str], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of words of one block that differ by exactly one edit. Words are distinct and sorted within each block."""
    codes, first = _codes(words)
    n, size = len(words), np.diff(first)
    lcp = shared_prefixes(codes, first, block)

    def letter(word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code point of words at places; -1 outside."""
        inside = (place >= 0) & (place < size[word])
        return np.where(inside, codes[np.where(inside, first[word] + place, 0)] if len(codes) else -1, -1)

    # Ranges at depth 0 are the blocks; each word is compared with its own block.
    start = np.flatnonzero(lcp < 0)
    stop = np.append(start[1:], n)
    node = np.repeat(np.arange(len(start)), stop - start)
    query = np.arange(n)
    band = np.stack([np.full(n, FAR), np.zeros(n, np.int64), np.where(size > 0, 1, FAR)])
    left, right, depth = [], [], 0
    while len(query):
        # A word that ends here is the first of its range: its distance is the cell at the other word's end.
        ends = size[start[node]] == depth
        off = size[query] - depth
        reached = ends & (np.abs(off) <= 1) & (start[node] > query)
        hit = np.flatnonzero(reached)
        hit = hit[band[off[hit] + 1, hit] == 1]
        left.append(query[hit])
        right.append(start[node[hit]])
        # Ranges one deeper, in the order of the list, each with its parent and its letter.
        deep = np.flatnonzero((size > depth) & (lcp <= depth))
        if not len(deep):
            break
        parent = np.searchsorted(start, deep, side="right") - 1
        inside = deep < stop[parent]
        deep, parent = deep[inside], parent[inside]
        mark = codes[first[deep] + depth]
        bound = np.flatnonzero(lcp <= depth)
        deep_stop = np.append(bound, n)[np.searchsorted(bound, deep, side="right")]
        key = parent << 21 | mark
        low, high = np.searchsorted(parent, node), np.searchsorted(parent, node, side="right")
        # No edit so far: all children. One edit: only the letters that keep a cell at one.
        exact = np.flatnonzero(band[1] == 0)
        count = (high - low)[exact]
        which = np.repeat(exact, count)
        child = np.arange(count.sum()) + np.repeat(low[exact] - (np.cumsum(count) - count), count)
        pairs, children = [which], [child]
        once = np.flatnonzero(band[1] > 0)
        seen: list[np.ndarray] = []
        for k in (0, 1, 2):
            want = np.where(band[k, once] == 1, letter(query[once], np.full(len(once), depth - 1 + k)), -1)
            fresh = want >= 0
            for other in seen:
                fresh &= want != other
            seen.append(want)
            if len(key):
                wanted = node[once] << 21 | want
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                fresh &= key[at] == wanted
                pairs.append(once[fresh])
                children.append(at[fresh])
        which, child = np.concatenate(pairs), np.concatenate(children)
        keep = deep_stop[child] > query[which] + 1  # each pair once: only words that come later in the list
        which, child = which[keep], child[keep]
        word, c, old = query[which], mark[child], band[:, which]
        here = [letter(word, np.full(len(word), depth + k)) for k in (-1, 0, 1)]
        new = np.empty_like(old)
        new[0] = np.minimum(old[0] + (here[0] != c), old[1] + 1)
        new[1] = np.minimum(np.minimum(old[1] + (here[1] != c), old[2] + 1), new[0] + 1)
        new[2] = np.minimum(old[2] + (here[2] != c), new[1] + 1)
        for k in (0, 1, 2):  # cells beyond the word's end do not count
            place = depth + k
            new[k] = np.where((place >= 0) & (place <= size[word]), np.minimum(new[k], FAR), FAR)
        alive = new.min(axis=0) < FAR
        node, query, band = child[alive], word[alive], new[:, alive]
        start, stop, depth = deep, deep_stop, depth + 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of sorted blocks; a block may reach over several batches."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def scan(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        # Blocks of one word have no pairs.
        alone = np.ones(len(block), dtype=bool)
        same = block[1:] == block[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        table, block = table.filter(pa.array(~alone)), block[~alone]
        a, b = near_pairs(table.column("piece").to_pylist(), block)
        word, n = table.column("word"), table.column("n").to_numpy()
        if len(a):
            # Each pair is kept in one block: pairs that agree in all of the step belong to a prefix block, two longer ones to their own.
            pieces, longer = table.column("piece").to_pylist(), table.column("longer").to_numpy()
            apart = np.array([pieces[i][:STEP] != pieces[j][:STEP] for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
            kept = (longer[a] < 0) | (apart & (longer[a] + longer[b] < 2))
            a, b = a[kept], b[kept]
        both, other = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.RecordBatch.from_arrays(
            [word.take(pa.array(both)).combine_chunks(), word.take(pa.array(other)).combine_chunks(), pa.array(n[other], pa.int64())], ["word", "near", "near_n"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        block = table.column("block").to_numpy()
        cut = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
        if cut:
            yield scan(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        rows -= cut
    if rows:
        yield scan(pa.Table.from_batches(held))


def vocabulary(documents: DataFrame, min_length: int = 7, min_count: int = 2, letters: str = "A-Za-z\\u00C0-\\u00FF", drop_every: int | None = None) -> DataFrame:
    """Rows (word, n): letter runs of whole texts with at least ``min_length`` code points and ``min_count`` occurrences.

    A-Z are lower-cased, nothing else. With ``drop_every`` an occurrence whose crc32 of ``doc_id:run`` it divides loses one letter
    (at crc32 modulo length), which plants misspellings. Null texts have no runs; a null doc_id counts as an empty string there.
    """
    upper = "".join(map(chr, range(65, 91)))
    run = F.explode(F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(f"[{letters}]{{{min_length},}}"), 0))
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("word"))
    if drop_every:
        code = F.crc32(F.concat("doc_id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(code, F.length("word").cast("bigint")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.select(F.when(F.pmod(code, F.lit(drop_every)) == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, near, near_n): both directions of every pair of ``words`` (word, n; distinct words) that differ by one edit."""
    todo, depth, parts = words.select("word", "n"), 0, []
    while True:
        rest = F.length("word")
        tail = [F.substring("word", F.lit(depth + STEP + 1 + k), rest) for k in (0, 1)]
        # Words that first differ in these places: equal before them and after them.
        remainder = todo.select("word", "n", F.explode(F.array(*[
            F.struct(
                F.xxhash64(F.lit(depth), F.substring("word", F.lit(1), F.lit(depth)), tail[k], F.greatest(rest - k, F.lit(0))).alias("block"),
                F.lit(k).alias("longer"), F.substring("word", F.lit(depth + 1), F.lit(STEP + k)).alias("piece"),
            ) for k in (0, 1)])).alias("_b"),
        ).select("_b.block", "_b.longer", "_b.piece", "word", "n")
        parts.append(remainder)
        # Words that agree in them.
        longer = todo.where(rest >= depth + STEP).withColumn("prefix", F.substring("word", F.lit(1), F.lit(depth + STEP)))
        large = stored(longer.groupBy("prefix").agg(F.count("*").alias("words")).where(F.col("words") > BLOCK).select("prefix"), "large-prefixes")
        few = broadcast_if_small(large)
        block = F.xxhash64(F.lit(-1 - depth), "prefix")
        small = longer.join(few, "prefix", "left_anti")
        parts.append(small.select(block.alias("block"), F.lit(-1).alias("longer"), F.substring("word", F.lit(depth + STEP + 1), rest).alias("piece"), "word", "n"))
        if large.isEmpty():
            break
        todo = stored(longer.join(few, "prefix", "left_semi").select("word", "n"), "dealt-again")
        depth += STEP
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    dealt = members.repartition("block").sortWithinPartitions("block", "piece")
    return dealt.mapInArrow(_scanned, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last, by pointer doubling."""
    links = stored(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "links")
        if moved.where("_moved").isEmpty():
            return links
        links = moved.select("word", "root")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each row of ``words`` (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of
    largest n (ties: smallest in code-point order), if that is at least ``times`` the word's own n, else null; its root is
    the last form that following forms reaches, the word itself without one. Words that repeat are summed first, null words are left
    out; the empty word is a word like others. Words of any length are whole. An empty table gives no rows. Other columns
    are ignored.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(near, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
