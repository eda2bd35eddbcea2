"""Exact n-gram Jaccard join by set-relation skipping.

Documents with equal shingle sets become one class.  Shingles are ordered by how common they are (counted in a table
of fixed width, so that the order is the same everywhere), then by hash; two sets at the threshold share a shingle of
their prefixes.  The prefixes form index lists, and two relations between sets save most of the work on them:

* Skipping in the index: a list is cut into blocks by set size and position.  Blocks whose sizes are too far apart, or
  whose positions leave too few shingles to reach the threshold, are skipped whole.
* Skipping by answers: sets of one least or greatest hash pass a task in order of size, which keeps those with
  the most answers as leaders and counts the overlap with these.  A set at the threshold of a leader stands in the lists as an entry of
  that leader's group; no pair inside a group is looked at again, and lists of a single group are dropped.
  Once the overlap ``o`` of two leaders is counted, the overlap of a member of each lies between ``o`` less the
  shingles that the two lack and ``o`` plus those that they add; only where this leaves the answer open and the two
  are not connected yet is the member pair itself counted.

Overlaps are counted on whole sets, once a small histogram of each (shingles by the first bits of their hash, which
bounds any overlap from above) leaves the pair open.  Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marketflow.llm.common import Rolling, checkpointed, mix64
from marketflow.llm.components import connected_components

SHINGLE = 4
PERCENT = 85
#: Counters of shingle frequencies: 2 to this power, whatever the input; they travel in chunks.
COUNTERS = 22
_CHUNK = 17
#: Bits of the filter that picks sets to count: 16 for each set, within these powers of two.
_LEAST_BITS, _MOST_BITS = 20, 28
#: Leaders that a task keeps of one family, and sets that wait for later ones; what meets none is left to the index lists.
LEADERS = 64
MISSED = 2000
#: Sets of one family that pass the same task; larger families are dealt out to several.
FAMILY = 10_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (A-Z lower-cased; fewer words: the whole sequence)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.append(np.flatnonzero(buf == 32), len(buf))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(ends)) - 1
    h = np.sort(Rolling(buf).of(starts[:len(ends) - last], ends[last:]))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63


def histogram(h: np.ndarray) -> bytes:
    """Shingles by the first bits of their hash, about two a bin; empty (no bound) should a bin ever hold over 255."""
    bits = max(3, len(h).bit_length() - 2)
    counts = np.bincount(h >> np.uint64(64 - bits), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of the overlap of two sets, from their histograms."""
    if not a or not b:
        return 1 << 62
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _reaches(overlap: Column, sizes: Column, percent: int) -> Column:
    """overlap / union >= percent / 100, in integers."""
    return (100 + percent) * overlap >= percent * sizes


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, id, n, keys, sketch) per document, and at the end of each task its counters as rows with a chunk number."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held, n_held = np.zeros(1 << COUNTERS, np.uint32), [], 0
        names = ["doc_id", "id", "n", "keys", "sketch", "chunk", "counts"]
        kind = None

        def count():
            counters[:] += np.bincount(np.concatenate(held) >> np.uint64(64 - COUNTERS), minlength=len(counters)).astype(np.uint32)

        for b in batches:
            kind = b.column(0).type
            ids, n, keys, sketch = [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, shingle)
                ids.append(set_id(h) if len(h) else None)
                n.append(len(h))
                keys.append(h[[0, -1]].view(np.int64).tolist() if len(h) else [])
                sketch.append(histogram(h))
                if len(h):
                    held.append(h)
                    n_held += len(h)
                if n_held > 1 << 20:
                    count()
                    held, n_held = [], 0
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), none, pa.nulls(b.num_rows, pa.binary())], names)
        if held:
            count()
        if kind is not None:
            parts = counters.reshape(-1, 1 << _CHUNK)
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                              pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()),
                                              pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names)

    return docs.mapInArrow(run, f"doc_id {id_type}, id long, n long, keys array<long>, sketch binary, chunk int, counts binary")


def _merged(chunks: DataFrame, width: int, kind: str, merge) -> np.ndarray:
    """Rows (chunk, counts) merged to one array of ``width`` values; a task holds one array a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.frombuffer(zlib.decompress(v), kind)
                sums[c] = merge(sums[c], a) if c in sums else a
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(a.tobytes(), 1) for a in sums.values()], pa.binary())],
                                         ["chunk", "counts"])
    out = np.zeros(width, kind)
    for r in chunks.select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect():  # a row a chunk
        a = np.frombuffer(zlib.decompress(r["counts"]), kind)
        out[r["chunk"] * len(a):(r["chunk"] + 1) * len(a)] = a
    return out


def _bitmap(nodes: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Bits at the hash of every id of ``nodes`` and the power of two that they are taken from."""
    power = min(max((16 * count).bit_length(), _LEAST_BITS), _MOST_BITS)
    size = 1 << (power - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = mix64(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - power)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = bits.reshape(-1, min(size, 1 << 16))
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())],
                                         ["chunk", "counts"])
    return _merged(nodes.mapInArrow(run, "chunk int, counts binary"), size, "u1", np.bitwise_or), power


def _holds(wanted: tuple[np.ndarray, int], value: int) -> bool:
    bits, power = wanted
    at = int(mix64(np.array([value]).view(np.uint64))[0]) >> (64 - power)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def _scanned_sets(docs: DataFrame, shingle: int, emit) -> DataFrame:
    """(key, n, id, set) rows: ``emit(id, hashes)`` gives (key, array) pairs, asked once per set and batch of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                done, rows = set(), []
                for text in b.column(0).slice(s, 1000).to_pylist():
                    h = shingle_set(text, shingle)
                    if len(h) and (name := set_id(h)) not in done:
                        done.add(name)
                        rows += [(key, len(h), name, v) for key, v in emit(name, h)]
                if rows:
                    key, n, names, values = zip(*rows)
                    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key, n, names)), pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))], ["key", "n", "id", "set"])

    return docs.select("text").mapInArrow(run, "key long, n long, id long, set array<long>")


def _of_sets(docs: DataFrame, shingle: int, wanted, out) -> DataFrame:
    """(id, set): ``out(hashes)`` of every set that the bitmap ``wanted`` asks for (all, without one)."""
    rows = _scanned_sets(docs, shingle, lambda name, h: [(0, out(h))] if wanted is None or _holds(wanted.value, name) else [])
    return rows.groupBy("id").agg(F.first("set").alias("set"))


def _with_most(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``most``, the overlap that the histograms still allow."""
    @pandas_udf("long")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([most_shared(x, y) for x, y in zip(a, b)], dtype="int64")

    at = classes.select("id", "sketch")
    return (pairs.join(at.select(F.col("id").alias("u"), F.col("sketch").alias("a")), "u")
            .join(at.select(F.col("id").alias("v"), F.col("sketch").alias("b")), "v")
            .withColumn("most", bound("a", "b")).drop("a", "b"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, n_u, n_v, o): shingles that the two sets of each pair share."""
    both = (pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
            .join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v"))
    return checkpointed(both.select("u", "v", F.size("a").cast("long").alias("n_u"), F.size("b").cast("long").alias("n_v"),
                                    F.size(F.array_intersect("a", "b")).cast("long").alias("o")))


def _led(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(u, v, n_u, n_v, o): sets ``u`` at the threshold of a leader ``v`` of one of their two families; None without families."""
    keyed = classes.select("id", F.explode("keys").alias("key"))
    families = checkpointed(keyed.groupBy("key").agg(F.count_distinct("id").alias("sets")).where("sets > 1"))
    count = families.count()
    if not count:
        return None
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(families.select("key"), count))
    # One entry for each FAMILY sets at most.
    tasks = {r["key"]: -(-r["sets"] // FAMILY) for r in families.where(F.col("sets") > FAMILY).toLocalIterator()}
    dealt = docs.sparkSession.sparkContext.broadcast(tasks)

    def emit(name, h):
        keys = {key for key in h[[0, -1]].view(np.int64).tolist() if _holds(wanted.value, key)}
        return [((key + name % dealt.value.get(key, 1)) % 2**63, h) for key in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, last, out = None, None, []
        pool: list[list] = []    # [hits, id, hashes, histogram], most hits first, then the latest
        missed: list[tuple] = []  # sets that met none of the pool of their time

        def met(name, h, sketch) -> bool:
            for k, entry in enumerate(pool):
                hits, other, g, held = entry
                need = percent * (len(g) + len(h))
                if other != name and (100 + percent) * most_shared(sketch, held) >= need:
                    both = np.sort(np.concatenate([g, h]))
                    o = int((both[1:] == both[:-1]).sum())
                    if (100 + percent) * o >= need:
                        out.append((name, other, len(h), len(g), o))
                        entry[0] += 1
                        while k and pool[k - 1][0] < entry[0]:
                            pool[k - 1:k + 1] = [entry, pool[k - 1]]
                            k -= 1
                        return True
            return False

        def again():
            for held in missed:
                met(*held)
            missed.clear()

        for b in batches:
            values, offsets = b.column(3).flatten().to_numpy().view(np.uint64), b.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for i, (key, name) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if key != family:
                    again()
                    family, last = key, None
                    pool.clear()
                if name == last:  # another batch's row of the same set
                    continue
                last, h = name, values[offsets[i]:offsets[i + 1]].copy()
                sketch = histogram(h)
                pool[:] = [x for x in pool if 100 * len(x[2]) >= percent * len(h)]  # later sets are larger still
                if not met(name, h, sketch):
                    missed.append((name, h, sketch))
                pool.insert(next((k for k, x in enumerate(pool) if not x[0]), len(pool)), [0, name, h, sketch])
                del pool[LEADERS:]
                if len(missed) == MISSED:
                    again()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], ["u", "v", "n_u", "n_v", "o"])
            out.clear()
        again()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], ["u", "v", "n_u", "n_v", "o"])

    rows = _scanned_sets(docs, shingle, emit)
    return checkpointed(rows.repartition("key").sortWithinPartitions("key", "n", "id")
                        .mapInArrow(run, "u long, v long, n_u long, n_v long, o long").distinct())


def _list_pairs(token, n, pos, group, comp, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Group pairs of different components that some blocks of a token's list let pass (rows sorted by token)."""
    begin = np.flatnonzero(np.diff(token, prepend=token[0] - 1)) if len(token) else np.zeros(0, np.int64)
    if not len(begin):
        return begin, begin
    mixed = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(token))))
    keep = mixed[run]
    run, n, pos, group, comp = run[keep], n[keep], pos[keep], group[keep], comp[keep]
    if not len(run):
        return run, run
    # Blocks: one a list, group, band of sizes and band of positions.
    band = np.floor(np.log(n) / np.log(100 / percent) if percent < 100 else n).astype(np.int64)
    depth = np.frexp(pos.astype(float) + 1)[1]
    by = np.lexsort((depth, band, group, run))
    run, n, pos, group, comp, band, depth = (x[by] for x in (run, n, pos, group, comp, band, depth))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(group) != 0) | (np.diff(band) != 0) | (np.diff(depth) != 0)]))
    lo, hi, at = np.minimum.reduceat(n, new), np.maximum.reduceat(n, new), np.minimum.reduceat(pos, new)
    run, group, comp = run[new], group[new], comp[new]
    by = np.lexsort((lo, run))
    run, lo, hi, at, group, comp = (x[by] for x in (run, lo, hi, at, group, comp))
    end = np.searchsorted(run, run, side="right")
    rows, step, a, b = np.arange(len(run)), 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows := rows[rows + step < end[rows]]):
        rows = rows[100 * hi[rows] >= percent * lo[rows + step]]  # blocks further on hold larger sets still
        other = rows + step
        left = np.minimum(hi[rows] - at[rows], hi[other] - at[other])
        pass_ = (comp[rows] != comp[other]) & ((100 + percent) * left >= percent * (lo[rows] + lo[other]))
        x, y = group[rows[pass_]], group[other[pass_]]
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
        step += 1
    a, b = np.concatenate(a), np.concatenate(b)
    return np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)


def _candidates(prefixes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v), u < v: pairs of groups of different components that the index lists leave over.

    ``members`` has (id, n, grp, comp) of the sets to index.
    """
    entries = (prefixes.join(members, "id").select("n", "grp", "comp", F.posexplode("set").alias("pos", "token"))
               .select("token", "n", F.col("pos").cast("long").alias("pos"), "grp", "comp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols):
            a, b = _list_pairs(*cols, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            cut = np.searchsorted(cols[0], cols[0][-1])  # the last list may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield out([c[:cut] for c in cols])
        if len(held[0]):
            yield out(held)

    return checkpointed(entries.repartition("token").sortWithinPartitions("token").mapInArrow(run, "u long, v long").distinct())


def _joined(docs: DataFrame, classes: DataFrame, common, shingle: int, percent: int) -> DataFrame:
    """(id, least, comp) of every set."""
    at_least = _reaches(F.col("o"), F.col("n_u") + F.col("n_v"), percent)
    alone = F.lit(0).cast("long")
    led = _led(docs, classes, shingle, percent)
    if led is None:
        members = classes.select("id", "least", "n", F.col("id").alias("grp"), alone.alias("added"), alone.alias("lacks"))
        links = None
    else:
        links = led.select("u", "v")
        best = led.groupBy(F.col("u").alias("id")).agg(F.max(F.struct("o", "v", "n_u", "n_v")).alias("b"))
        members = checkpointed(classes.join(best, "id", "left").select(
            "id", "least", "n", F.coalesce("b.v", "id").alias("grp"), F.coalesce(F.col("b.n_u") - F.col("b.o"), alone).alias("added"),
            F.coalesce(F.col("b.n_v") - F.col("b.o"), alone).alias("lacks")))
    family = checkpointed(members.groupBy(F.col("grp").alias("id")).agg(F.min("n").alias("least_n"), F.max("added").alias("most_added")))

    def with_families(pairs: DataFrame) -> DataFrame:
        for x in "uv":
            pairs = pairs.join(family.select(F.col("id").alias(x), F.col("least_n").alias(f"least_{x}"), F.col("most_added").alias(f"most_{x}")), x)
        return pairs

    def best_case(overlap: str) -> Column:
        """Could some members of the two families reach the threshold?"""
        return _reaches(F.col(overlap) + F.col("most_u") + F.col("most_v"), F.col("least_u") + F.col("least_v"), percent)

    def prefix(h: np.ndarray) -> np.ndarray:
        return h[np.argsort(common.value[h >> np.uint64(64 - COUNTERS)], kind="stable")[:prefix_length(len(h), percent)]]

    prefixes = checkpointed(_of_sets(docs, shingle, None, prefix))
    met = _candidates(prefixes, members.select("id", "n", "grp", F.col("grp").alias("comp")), percent)
    met = checkpointed(with_families(_with_most(met, classes)).where(best_case("most")).select("u", "v"))
    # The sets of the leaders that met, and of their members, should the leaders' overlap not decide.
    groups = met.select(F.col("u").alias("grp")).union(met.select("v")).distinct()
    nodes = checkpointed(groups.select(F.col("grp").alias("id")).union(members.join(groups, "grp", "left_semi").select("id")).distinct())
    count, found = nodes.count(), None
    if count:
        wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes, count))
        sets = checkpointed(_of_sets(docs, shingle, wanted, lambda h: h))
        found = _overlaps(met, sets)
        more = found.where(at_least).select("u", "v")
        links = more if links is None else links.union(more)
    if links is None:
        return members.withColumn("comp", F.col("id"))
    roots = connected_components(links).select(F.col("node").alias("id"), "root")
    members = checkpointed(members.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"))
    if found is None:
        return members

    # What the leaders' overlaps leave open: members that could reach the threshold, in components still apart.
    at = members.select("id", "comp")
    apart = (found.join(at.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u")
             .join(at.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v").where("cu <> cv"))
    undecided = checkpointed(with_families(apart).where(best_case("o")).select("u", "v", "o"))
    if not undecided.limit(1).count():
        return members
    groups = undecided.select(F.col("u").alias("grp")).union(undecided.select("v")).distinct()
    there = checkpointed(members.join(groups, "grp", "left_semi"))
    pairs = _candidates(prefixes, there.select("id", "n", F.col("id").alias("grp"), "comp"), percent)

    def of(x: str) -> DataFrame:
        return there.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "grp", "added", "lacks")))
    known = undecided.select(F.col("u").alias("g"), F.col("v").alias("h"), "o")
    sized = F.col("n_u") + F.col("n_v")
    least = F.col("o") - F.col("lacks_u") - F.col("lacks_v")
    most = F.least(F.col("o") + F.col("added_u") + F.col("added_v"), F.col("most"))
    derived = checkpointed(
        _with_most(pairs, classes).join(of("u"), "u").join(of("v"), "v")
        .withColumn("g", F.least("grp_u", "grp_v")).withColumn("h", F.greatest("grp_u", "grp_v")).join(known, ["g", "h"])
        .where(_reaches(most, sized, percent)).select("u", "v", _reaches(least, sized, percent).alias("sure")))
    counted = _overlaps(derived.where("NOT sure").select("u", "v"), sets).where(at_least)
    late = derived.where("sure").select("u", "v").union(counted.select("u", "v"))
    edges = (late.join(at.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u")
             .join(at.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    roots = connected_components(edges).select(F.col("node").alias("comp"), "root")
    return members.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked when ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is
    the smallest doc_id reachable, itself included.  A text of fewer words is one shingle; null texts and texts without
    words have an empty set, are linked with nothing and keep their own id.  Equal sets are linked; repeated rows stay
    repeated; a null id keeps its row and never names a component unless all its ids are null.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = checkpointed(_prints(rows, shingle))
    prints = scanned.where("chunk IS NULL")
    counts = _merged(scanned.where("chunk IS NOT NULL"), 1 << COUNTERS, "u4", np.add)
    # Sixteen steps for each doubling, from a sixteenth of the mean on.
    steps = 16 * np.log2(np.maximum(counts, 1) / max(1.0, float(counts.mean()))) + 64
    common = docs.sparkSession.sparkContext.broadcast(np.clip(steps, 0, 255).astype(np.uint8))
    classes = checkpointed(prints.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "keys", "sketch"))))
    members = _joined(rows, classes, common, shingle, percent)
    least = members.groupBy("comp").agg(F.min("least").alias("component_id"))
    # Read back as a table, so that the join of a set that very many documents share can be split.
    named = checkpointed(members.select("id", "comp").join(least, "comp").select("id", "component_id"))
    return (prints.join(named, "id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
