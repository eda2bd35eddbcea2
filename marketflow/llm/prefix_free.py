"""Deduplication of repeated 50-byte strings by prefix-free parsing.

Every window of ``LENGTH`` bytes has a trigger: of the grams that it holds, the one whose rolling hash is least.
Triggers depend on content alone, so equal windows have equal triggers at equal places.  Windows of one trigger are
consecutive; together they are a phrase.  A document is parsed into phrases, which overlap by ``LENGTH - 1`` bytes,
and the distinct phrases of each trigger are the dictionary.

Because a phrase keeps the ``LENGTH - 1`` bytes to its right, the order of any corpus suffix, up to its first
``LENGTH`` bytes, is decided inside its phrase.  So the parse is only needed as far as phrases are equal, and the
dictionary only where a trigger has several phrases:

1. parse: triggers of each block of documents meet by trigger.  Where a trigger has one phrase in the whole corpus,
   all windows of that phrase repeat together, and the smallest doc_id decides for all of them.
2. dictionary: the phrases of triggers with several (the ends of repeated passages) are sent once a block, by their
   trigger.  A bucket's phrases get a suffix array of their first ``LENGTH`` bytes, by prefix doubling; suffixes of one
   rank are equal and find their smallest doc_id.  Phrases of different triggers share no window, so the arrays of the
   buckets, one after another, are in corpus order as far as it is asked for.
3. Documents lose what is covered by windows that also start in a smaller doc_id.

A block sends each distinct trigger or phrase once, so a passage in a third of all documents is one row a block.
Blocks are dealt by a hash of the doc_id and have a bounded size, and so have the buckets that triggers meet in;
the number of both follows the corpus.  Windows of the dictionary are compared by their bytes; triggers, and whole
phrases of a trigger that has but one, by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import Rolling, mix64

LENGTH = 50
GRAM = 20
#: Bytes of text in a block, about, and bytes of text whose triggers meet in one bucket.
BLOCK = 4 << 20
BUCKET = 4 << 20
#: Bytes that are hashed at a time, unless a document is longer.
_CHUNK = 1 << 17
_LAST = np.iinfo(np.int64).max  # null ids come last
_LIBC = ctypes.CDLL(None)
_ROW = "bucket long, block long, kind int, payload binary"


#: Arrays of a payload, by place; a payload has a few bytes of head for each, since there are very many small ones.
_NAMES = ("key", "phrase", "ids", "base", "several", "less", "start", "stop", "place", "number", "doc", "count", "bucket", "text")
_TYPES = ("uint8", "uint32", "uint64", "int64")


def _pack(**arrays: np.ndarray) -> bytes:
    head = [bytes([len(arrays)])]
    head += [struct.pack("<BBI", _NAMES.index(k), _TYPES.index(a.dtype.name), a.size) for k, a in arrays.items()]
    return b"".join(head + [a.tobytes() for a in arrays.values()])


def _unpack(payload: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 1 + 6 * payload[0]
    for i in range(payload[0]):
        name, kind, n = struct.unpack_from("<BBI", payload, 1 + 6 * i)
        out[_NAMES[name]] = np.frombuffer(payload, _TYPES[kind], n, at)
        at += out[_NAMES[name]].nbytes
    return out


def _release() -> None:
    """Give back what the last group has freed; a worker handles many groups, and its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _small(ids: np.ndarray) -> dict[str, np.ndarray]:
    """Ids as a base and offsets of 32 bits, where they fit."""
    if not len(ids):
        return {"ids": ids}
    base, top = int(ids.min()), int(ids.max())
    return {"ids": (ids - base).astype(np.uint32), "base": np.array([base])} if top - base < 2**32 else {"ids": ids}


def _large(z: dict[str, np.ndarray]) -> np.ndarray:
    return z["ids"].astype(np.int64) + z["base"][0] if "base" in z else z["ids"]


class Block:
    """The documents of a block in the order of their ids, as one buffer of bytes."""

    def __init__(self, table: pa.Table):
        _release()
        ids = table["doc"].combine_chunks()
        keys = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        texts = [b or b"" for b in table["bytes"].to_pylist()]
        order = np.argsort(keys, kind="stable")
        self.null = ids.is_null().to_numpy(zero_copy_only=False)[order]
        self.ids = keys[order].astype(np.int64)
        texts = [texts[i] for i in order]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of whole documents of about _CHUNK bytes."""
        a = 0
        while a < len(self.size):
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + _CHUNK, "right")) - 1)
            yield a, b
            a = b


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    n, have = len(h) - width + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have:width - have + n])


def _phrases(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every phrase of a block: trigger hash, phrase hash, document number, first and last window (in the buffer)."""
    out = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    for a, b in block.chunks():
        lo, hi = int(block.start[a]), int(block.start[b])
        if hi - lo < LENGTH:
            continue
        roll = Rolling(block.bytes[lo:hi])
        gram = roll.fixed(GRAM)
        # The place below the hash settles ties: the leftmost of equal grams.
        ranked = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        owner = (_sliding_min(ranked, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        windows = np.maximum(block.size[a:b] - LENGTH + 1, 0)
        doc = np.repeat(np.arange(a, b), windows)
        first = np.cumsum(windows) - windows
        place = np.arange(len(doc)) - np.repeat(first, windows) + np.repeat(block.start[a:b] - lo, windows)
        own = owner[place]
        new = np.ones(len(place), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            continue
        p0, p1 = place[at], place[np.append(at[1:], len(place)) - 1]
        # Least hashes are small; mixed again they fall into all buckets alike.
        for x, got in zip(out, (mix64(gram[own[at]]), roll.of(p0, p1 + LENGTH), doc[at], p0 + lo, p1 + lo)):
            x.append(got)
    return tuple(np.concatenate(x) for x in out)


def _distinct(gram: np.ndarray, phrase: np.ndarray, ids: np.ndarray):
    """Distinct triggers, sorted: (trigger, its phrase or 0 if it has several, smallest id, number of each input row)."""
    order = np.argsort(gram, kind="stable")
    g, p = gram[order], phrase[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    number = np.empty(len(g), np.int64)
    number[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g))))
    if not len(g):
        return g, p, ids, number
    low, high = np.minimum.reduceat(p, start), np.maximum.reduceat(p, start)
    return g[start], np.where(low == high, low, 0), np.minimum.reduceat(ids[order], start), number


def _buckets(hashes: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of the sorted hashes by bucket: equal ranges of the upper half."""
    of = ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(edge, np.append(edge[1:], len(of))):
        yield int(of[a]), slice(int(a), int(b))


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()),
                     "kind": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def _dense(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(values)
    v = values[order]
    new = np.zeros(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    del v
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.cumsum(new, dtype=np.uint32)
    return rank


def suffix_ranks(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of ``text`` at the places ``at`` in the order of their first ``LENGTH`` bytes, by prefix doubling.

    Ranks of 8 bytes give those of 16, these those of 32, and two of 32 that overlap those of 50.  Equal ranks are equal
    bytes.  A place has ``LENGTH`` bytes from it on.
    """
    if not len(at):
        return np.zeros(0, np.uint32)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(len(text), ">u8", padded, strides=(1,))  # 8 bytes from every place
    rank, have = _dense(words.astype(np.uint64)), 8
    while have < LENGTH:
        step = min(have, LENGTH - have)
        both = rank.astype(np.uint64)
        both <<= np.uint64(32)
        both[:len(rank) - step] |= rank[step:]
        have += step
        rank = _dense(both[at] if have == LENGTH else both)
        del both
    return rank


def _least_elsewhere(keys: list[np.ndarray], ids: list[np.ndarray]):
    """Group equal keys of several blocks: order, group start, group number of the ordered rows, smallest id per group."""
    key, who = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    return order, start, group, np.minimum.reduceat(who[order], start)


def _meet_triggers(table: pa.Table) -> pa.Table:
    """For each block of a bucket: triggers with several phrases, and smaller ids of those with one."""
    _release()
    z = [_unpack(p) for p in table["payload"].to_pylist()]
    blocks = table["block"].to_pylist()
    ids = [_large(x) for x in z]
    size = np.array([len(x) for x in ids])
    order, start, group, least = _least_elsewhere([x["key"] for x in z], ids)
    phrase = np.concatenate([x["phrase"] for x in z])[order]
    low, high = np.minimum.reduceat(phrase, start), np.maximum.reduceat(phrase, start)
    mixed, best = np.empty(len(order), bool), np.empty(len(order), np.int64)
    mixed[order] = ((low != high) | (low == 0))[group]
    best[order] = least[group]
    bucket, out, a = table["bucket"][0].as_py(), [], 0
    for block, x, who, n in zip(blocks, z, ids, size):
        m, b = mixed[a:a + n], best[a:a + n]
        several = np.flatnonzero(m & (x["phrase"] != 0))  # the block knows of its own
        less = np.flatnonzero(~m & (b < who))
        if len(several) or len(less):
            out.append((bucket, block, 1, _pack(several=several.astype(np.uint32), less=less.astype(np.uint32), **_small(b[less]))))
        a += n
    return _rows(out)


def _spread(p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of runs p0..p1, and the number of the run of each."""
    n = p1 - p0 + 1
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + p0[run], run


def _meet_suffixes(table: pa.Table) -> pa.Table:
    """For each block of a bucket: smaller ids of the suffixes of its phrases.  What a block sent to itself passes through."""
    _release()
    rows = list(zip(*(table[c].to_pylist() for c in ("bucket", "block", "kind", "payload"))))
    out = [r for r in rows if r[2] == 0]
    sent = [(block, _unpack(payload)) for _, block, kind, payload in rows if kind == 2]
    if not sent:
        return _rows(out)
    places, ids, before = [], [], 0
    for _, z in sent:
        n = z["count"].astype(np.int64)
        begin = before + np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        places.append(_spread(begin, begin + n - 1)[0])
        ids.append(np.repeat(_large(z), n))
        before += len(z["text"])
    # The suffix array of the bucket's dictionary; neighbours of one rank are equal windows.
    ranks = suffix_ranks(np.concatenate([z["text"] for _, z in sent]), np.concatenate(places))
    order, _, group, least = _least_elsewhere([ranks], ids)
    best = np.empty(len(order), np.int64)
    best[order] = least[group]
    bucket, a = rows[0][0], 0
    for (block, _), who in zip(sent, ids):
        b = best[a:a + len(who)]
        less = np.flatnonzero(b < who)
        if len(less):
            out.append((bucket, block, 2, _pack(less=less.astype(np.uint32), **_small(b[less]))))
        a += len(who)
    return _rows(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, if asked for).

    A byte goes when a ``LENGTH``-byte string that covers it also starts in a document with a smaller doc_id, on the
    input.  Ids are integers; null ids come after all others, and rows with equal ids do not count against each other.
    Null texts are empty; texts under ``LENGTH`` bytes stay whole; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("bytes"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long"))).first()[0] or 0
    n_blocks, n_buckets = total // BLOCK + 1, total // BUCKET + 1
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(n_blocks)))

    def parse(table: pa.Table) -> pa.Table:
        block, number = Block(table), table["block"][0].as_py()
        gram, phrase, doc, _, _ = _phrases(block)
        gram, phrase, least, _ = _distinct(gram, phrase, block.ids[doc])
        return _rows([(k, number, 1, _pack(key=gram[s].astype(np.uint32), phrase=phrase[s], **_small(least[s])))
                      for k, s in _buckets(gram, n_buckets)])

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        block, number_of = Block(table), table["block"][0].as_py()
        all_gram, all_phrase, doc, p0, p1 = _phrases(block)
        gram, phrase, least, of = _distinct(all_gram, all_phrase, block.ids[doc])
        several, slices = phrase == 0, dict(_buckets(gram, n_buckets))
        least = least.copy()
        for bucket, payload in zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()):
            z, first = _unpack(payload), slices[bucket].start
            several[first + z["several"].astype(np.int64)] = True
            least[first + z["less"].astype(np.int64)] = _large(z)
        open_ = several[of]
        gone = np.flatnonzero(~open_ & (block.ids[doc] > least[of]))
        # Phrases that follow each other in a document become one run.
        g0, g1, gd = p0[gone], p1[gone], doc[gone]
        new = np.ones(len(gone), bool)
        new[1:] = (g0[1:] != g1[:-1] + 1) | (gd[1:] != gd[:-1])
        start, stop = g0[new], g1[np.append(np.flatnonzero(new)[1:], len(gone)) - 1] if len(gone) else g1
        # The dictionary: each phrase of a trigger with several, from its smallest document.
        go, ph, place, n, who = all_gram[open_], all_phrase[open_], p0[open_], (p1 - p0 + 1)[open_], doc[open_]
        order = np.lexsort((who, ph, go))
        new = np.ones(len(order), bool)
        new[1:] = (go[order][1:] != go[order][:-1]) | (ph[order][1:] != ph[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        at, count, ids = place[first], n[first], block.ids[who[first]]
        small = lambda x: x.astype(np.uint32)  # noqa: E731  places in a block
        out, bucket_of = [], np.zeros(len(first), np.uint32)
        for k, s in _buckets(go[first], n_buckets):
            bucket_of[s] = k
            text = block.bytes[_spread(at[s], at[s] + count[s] + LENGTH - 2)[0]]
            out.append((k, number_of, 2, _pack(count=small(count[s]), text=text, **_small(ids[s]))))
        out.append((number_of % n_buckets, number_of, 0, _pack(
            start=small(start), stop=small(stop), place=small(place), number=small(number), doc=small(who),
            count=small(count), bucket=bucket_of, **_small(ids))))
        return _rows(out)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        mark = np.zeros(len(block.bytes) + 1, np.int32)
        kinds = answers["kind"].to_pylist()
        own = next((_unpack(p) for k, p in zip(kinds, answers["payload"].to_pylist()) if k == 0), None)
        if own is not None:
            np.add.at(mark, own["start"].astype(np.int64), 1)
            np.add.at(mark, own["stop"].astype(np.int64) + LENGTH, -1)
            count = own["count"].astype(np.int64)
            first = np.cumsum(count) - count
            least = np.repeat(_large(own), count)
            for k, bucket, payload in zip(kinds, answers["bucket"].to_pylist(), answers["payload"].to_pylist()):
                if k == 2:
                    z = _unpack(payload)
                    least[first[np.searchsorted(own["bucket"], bucket)] + z["less"].astype(np.int64)] = _large(z)
            begin, number = own["place"].astype(np.int64), own["number"].astype(np.int64)
            place, run = _spread(begin, begin + count[number] - 1)
            smallest = least[first[number][run] + place - begin[run]]
            hit = place[block.ids[own["doc"].astype(np.int64)[run]] > smallest]
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + LENGTH, -1)
        gone = np.cumsum(mark[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = block.start[:-1][block.size > 0]
        edge[inner] = gone[inner]  # a run ends with its document
        at = list(zip(block.start[:-1].tolist(), block.start[1:].tolist()))
        n = [int(np.count_nonzero(gone[i:j])) for i, j in at]
        spans = [int(np.count_nonzero(edge[i:j])) for i, j in at]
        kept = [block.bytes[i:j].tobytes() if not k else block.bytes[i:j][~gone[i:j]].tobytes() for (i, j), k in zip(at, n)]
        out = {"doc_id": pa.array(block.ids, mask=block.null), "n_bytes": pa.array(block.size), "n_removed": pa.array(n, pa.int64()),
               "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    # The three steps read the same exchange of the documents by block.
    triggers = blocks.groupBy("block").applyInArrow(parse, _ROW)
    answers = triggers.groupBy("bucket").applyInArrow(_meet_triggers, _ROW)
    suffixes = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, _ROW)
    found = suffixes.groupBy("bucket").applyInArrow(_meet_suffixes, _ROW)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
