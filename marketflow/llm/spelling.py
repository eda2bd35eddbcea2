"""Spelling variants through a bit-sliced position index.

Two words at one edit, the shorter of ``m`` letters, share their first or their last ``m // 2`` letters; so a word
belongs to four blocks, (side, m, half) for its own length and for one letter less.  Blocks are dealt out by hash.
A task indexes its words as bitsets, one per (position, letter), and reads each word letter by letter against all of
them at once.  With ``Z`` the words that agree so far, ``S``, ``I`` and ``D`` those that have replaced, inserted or lost
one letter, and ``B[i, c]`` the words with letter ``c`` at position ``i``, a letter ``c`` at position ``i`` gives

    S = S & B[i, c] | Z & ~B[i, c]      D = D & B[i-1, c] | Z
    I = I & B[i+1, c] | Z & B[i, c]     Z = Z & B[i, c]

At the end the bitset of the right length is taken from each.  What leaves a task is a row per word: how many near
words it found and which is the most frequent, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import checkpointed

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is so many times as frequent as its variant.
FACTOR = 5
#: One run in so many loses a letter; 0 leaves all as they are.
DAMAGE = 199
#: Words of one index; a block of more is cut into as many indexes as it needs.
INDEX = 2048
#: Words that a task counts before it passes them on.
_HELD = 400_000


def damaged(doc_id: str, run: str, damage: int = DAMAGE) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode()) if damage else 1
    if damage and h % damage == 0:
        i = h % len(run)
        return run[:i] + run[i + 1:]
    return run


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damage: int = DAMAGE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters that occur ``min_count`` times over all documents."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_letters)  # still whole runs: a shorter one matches nowhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "n"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # Letters up to U+00FF are single bytes in Latin-1, where lower() changes A-Z alone.
                own = Counter(runs.findall(text or ""))
                for word, n in own.items():
                    word = damaged(doc, word.encode("latin-1").lower().decode("latin-1"), damage)
                    if len(word) >= min_letters:
                        counts[word] += n
                if len(counts) > _HELD:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _near(words: list[str], block: np.ndarray, prefix: np.ndarray, shorter: np.ndarray,
          indexed: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking row, indexed row) at exactly one edit, within equal ``block`` numbers.

    ``shorter`` is the lesser length that a row's block joins; ``prefix`` is False in blocks of equal ends, where pairs
    with equal beginnings are left out, since the block of that beginning has them.
    """
    size = np.array([len(w) for w in words])
    code = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    letters, code = np.unique(code, return_inverse=True)
    width, n_letters = (len(indexed) + 63) // 64, len(letters)

    # B: a bitset for each (position, letter) that occurs among the indexed words; the last row is empty.
    length = size[indexed]
    ends = np.cumsum(length)
    place = np.arange(ends[-1]) - np.repeat(ends - length, length)
    entry = np.repeat(np.arange(len(indexed)), length)
    key = place * n_letters + code[np.repeat(begin[indexed], length) + place]
    slots, at = np.unique(key, return_inverse=True)
    table = np.zeros((len(slots) + 1, width), np.uint64)
    np.bitwise_or.at(table, (at, entry >> 6), np.uint64(1) << (entry & 63).astype(np.uint64))

    def among(of: np.ndarray) -> dict:
        """Bitset of the indexed words by value of ``of``."""
        out: dict = {}
        for v in np.unique(of):
            bits = np.zeros(64 * width, bool)
            bits[:len(of)] = of == v
            out[int(v)] = np.packbits(bits, bitorder="little").view(np.uint64)
        return out

    none = np.zeros(width, np.uint64)
    members, lengths = among(block[indexed]), among(length)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kind = np.stack([size[asks], shorter[asks]])
    for m, short in np.unique(kind, axis=1).T.tolist():
        rows = asks[(kind[0] == m) & (kind[1] == short)]
        letter = code[begin[rows][:, None] + np.arange(m)]

        def slot(i: int, shift: int) -> np.ndarray:
            want = (i + shift) * n_letters + letter[:, i]
            at = np.minimum(np.searchsorted(slots, want), len(slots) - 1)
            return table[np.where(slots[at] == want, at, len(slots))] if i + shift >= 0 else table[-1:]

        z = np.stack([members.get(int(b), none) for b in block[rows]])
        s, lost, more, half = np.zeros_like(z), np.zeros_like(z), z, z
        for i in range(m):
            here = slot(i, 0)
            s = (s & here) | (z & ~here)
            lost = (lost & slot(i, -1)) | z
            z = z & here
            more = (more & slot(i, 1)) | z
            if i + 1 == short // 2:
                half = z
        if m == short:
            found = (s & lengths.get(m, none)) | (more & lengths.get(m + 1, none))
        else:
            found = lost & lengths.get(m - 1, none)
        found = found & np.where(prefix[rows][:, None], ~np.uint64(0), ~half)
        q, w = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
        left.append(rows[q])
        right.append(indexed[w])
    return np.concatenate(left), np.concatenate(right)


def _blocks(words: DataFrame, min_letters: int) -> DataFrame:
    """Rows (shorter, prefix, block, word, n, indexed, asks, bin) for the tasks; a block of any size is cut into indexes."""
    short = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("shorter")
    sides = words.select("word", "n", short).where(F.col("shorter") >= min_letters).withColumn("prefix", F.explode(F.array(F.lit(True), F.lit(False))))
    half = (F.col("shorter") / 2).cast("int")
    text = F.when(F.col("prefix"), F.substring(F.col("word"), F.lit(1), half)).otherwise(F.substring(F.col("word"), -half, half))
    keyed = checkpointed(sides.withColumn("block", F.xxhash64("shorter", "prefix", text)))
    counts = keyed.groupBy("shorter", "block").count()
    whole = counts.where(F.col("count") > 1)  # a word alone in its block has no partner there
    bins = whole.groupBy("shorter").agg(F.ceil(F.sum("count") / INDEX).alias("bins"))
    sized = checkpointed(whole.join(bins, "shorter").withColumn("cuts", F.ceil(F.col("count") / INDEX)))
    rows = keyed.join(sized, ["shorter", "block"])
    # A cut of the block is indexed once for each cut that asks, so no bin has more than two cuts.
    own = F.pmod(F.xxhash64("word"), F.col("cuts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    cut = rows.withColumn("own", own).withColumn("other", other)
    one, two = F.struct(F.col("own").alias("i"), F.col("other").alias("j")), F.struct(F.col("other").alias("i"), F.col("own").alias("j"))
    asked = cut.withColumn("pair", F.explode(F.when(F.col("own") == F.col("other"), F.array(one)).otherwise(F.array(one, two))))
    home = F.when(F.col("cuts") > 1, F.concat_ws("/", F.col("block").cast("string"), F.col("pair.i").cast("string"), F.col("pair.j").cast("string")))
    return asked.select("shorter", "prefix", "block", "word", "n", (F.col("pair.i") == F.col("own")).alias("indexed"),
                        (F.col("pair.j") == F.col("own")).alias("asks"),
                        F.coalesce(home, F.pmod("block", "bins").cast("string")).alias("bin"))


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best): near words of each word that has any, and the most frequent (ties: smallest)."""
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("block", "ascending"), ("word", "ascending")])
        words, n, block = part["word"].to_pylist(), part["n"].to_numpy(), part["block"].to_numpy()
        _, number = np.unique(block, return_inverse=True)
        prefix, shorter = part["prefix"].to_numpy().astype(bool), part["shorter"].to_numpy()
        indexed, asking = np.flatnonzero(part["indexed"].to_numpy()), part["asks"].to_numpy().astype(bool)
        place = {w: i for i, w in enumerate(sorted(set(words)))}  # str order is code-point order
        rank = np.array([place[w] for w in words])
        out: list[tuple] = []
        for i in range(0, len(indexed), 2 * INDEX):      # blocks are sorted, so neighbours stand in one index
            own = indexed[i:i + 2 * INDEX]
            for j in range(0, len(words), 2 * INDEX):
                asks = j + np.flatnonzero(asking[j:j + 2 * INDEX])
                asks = asks[(number[asks] >= number[own[0]]) & (number[asks] <= number[own[-1]])]
                if not len(asks):
                    continue
                q, w = _near(words, number, prefix, shorter, own, asks)
                by = np.lexsort((rank[w], -n[w], q))
                q, w = q[by], w[by]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                out += zip([words[k] for k in q[first]], np.diff(np.append(first, len(q))).tolist(),
                           n[w[first]].tolist(), [words[k] for k in w[first]])
        cols = zip(*out) if out else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                        ["word", "n_near", "best_n", "best"])

    found = _blocks(words, min_letters).groupBy("shorter", "bin").applyInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word's chain, by doubling steps; each form is several times as frequent, so
    a chain is no longer than a logarithm of the largest count."""
    state = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = state.join(ahead, "root", "left")
        if not step.where("further IS NOT NULL").limit(1).count():
            return state
        state = checkpointed(step.select("word", F.coalesce("further", "root").alias("root")))


def spelling_groups(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, factor: int = FACTOR,
                    damage: int = DAMAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z lower-cased; ``damage`` takes one letter out of one run in so many.  Null and
    empty texts have no words; a null id counts as empty text; repeated rows count each time.  A word's form is its
    most frequent near word, ties to the smallest, if that is ``factor`` times as frequent; words of any length are
    compared whole.  Other columns are ignored; an empty table gives an empty result.
    """
    if min_letters < 2:
        raise ValueError("words of one letter have no half to share")
    words = checkpointed(word_counts(docs, min_letters, min_count, damage, id_col, text_col))
    near = near_words(words, min_letters)
    named = F.col("best_n") >= F.lit(factor) * F.col("n")
    rows = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(named, F.col("best")).alias("form"),
        F.when(named, F.col("best_n")).alias("form_n")))
    roots = _roots(rows.where("form IS NOT NULL"))
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
