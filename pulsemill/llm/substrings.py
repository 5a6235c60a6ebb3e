"""Operator 8: repeated passages by a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is
found without comparing documents in pairs:

1. Anchors.  Of the third-length strings inside each ``length``-byte window the
   one with the least hash (the last of equals) is the window's anchor.  Equal
   windows have equal anchors at equal places.  A window also holds the anchor
   with half of the rest on its left, or with half of it on its right; an anchor
   of which neither of these two longer strings occurs twice is left out.
2. Contexts.  The context of an anchor is the part of its text that holds all
   windows which contain it.  Contexts with one BLAKE2 digest of 128 bits are
   equal, and repeated in full.
3. An anchor string with several different contexts, of which one is alone, is
   open.  One copy of each of its contexts is fetched, and suffixes at the starts
   of stretches that may be repeated are put in order by mergesort.  They are
   compared through prefix polynomial hashes: binary search finds their common
   extension, the byte after it decides.  Neighbours' extensions are confirmed on
   their bytes; if one proves a collision, the bytes of these windows are compared
   directly.
4. Anchor strings with over ``MOST`` different contexts don't fit a task; their
   windows are counted by digest in Spark.  The result is the same.

Texts are named by two 64-bit hashes, and a task reads at most two copies of a
text; all rows with this text get the spans found.  Texts longer than ``PIECE``
bytes are read in pieces that share ``length`` - 1 bytes, so each window lies in
one piece.

Edge cases: null and empty texts have no bytes and the digest of the empty
string; texts below ``length`` bytes lose nothing; matches never cross
documents; repeated rows count as matches of each other; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitset import bitset, hit
from .storage import stored
from .textkit import CHUNK, U64, as_bytes, chunks, mix, powers, prefix_hash, table

#: Position bits of the packed (hash, position) values, and bytes of a long text that are read at once.
PLACE, PIECE = 28, 1 << 26
#: Contexts of one anchor string that a task may hold, and of several that are sorted together.
MOST, GATHER = 8_000, 3_000
KEY = ["k1", "k2"]
SPAN = "array<struct<k1:long,k2:long,lo:int,hi:int>>"
CONTEXT = ["h", "c1", "c2"]


class Text:
    """Several texts as one byte array with its prefix hashes."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.prefix = prefix_hash(self.data)

    def hashes(self, length: int) -> np.ndarray:
        """Hash of the string of ``length`` bytes at each place where one fits into the array."""
        n = len(self.data) - length + 1
        _, down = powers(len(self.prefix))
        return mix((self.prefix[length:] - self.prefix[:-length]) * down[:n] + U64(length))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def sizes(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and of what a window holds besides it on one side at least."""
    short = max(1, length // 3)
    return short, (length - short + 1) // 2


def anchors(text: Text, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place in the array of every anchor."""
    short, _ = sizes(length)
    width = length - short + 1
    none = np.empty(0, np.int64)
    if len(text.data) < length:
        return none.astype(U64), none, none
    h = text.hashes(short)
    mask = U64((1 << PLACE) - 1)
    place = np.arange(len(h), dtype=U64)
    least = sliding_least((h & ~mask) | (mask - place), width)
    valid = np.zeros(len(text.data) + 1, np.int8)
    some = text.size >= length
    np.add.at(valid, text.start[some], 1)
    np.add.at(valid, (text.start + text.size - length + 1)[some], -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    chosen = np.zeros(len(h), bool)
    chosen[(mask - (least[valid] & mask)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(text.start, at, "right") - 1
    # empty texts share a start with the next one; the last with this start holds the place
    return h[at], doc, at


def halves(text: Text, doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the longer strings to the left and to the right of anchors, and whether their documents hold them."""
    short, half = sizes(length)
    start = text.start[doc]
    return at - half, at - half >= start, at, at + short + half <= start + text.size[doc]


def pieces(batches, length: int, copies: int = 2):
    """Chunks (keys, offsets, texts): at most ``copies`` of each text in a task, long texts in overlapping pieces."""
    seen: dict[tuple[int, int], int] = {}
    keys, offsets, texts, size = [], [], [], 0
    for batch, own in chunks(batches, "__text"):
        for key, text in zip(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True), own, strict=True):
            if (n := seen.get(key, 0)) == copies:
                continue
            seen[key] = n + 1
            for begin in range(0, max(1, len(text) - length + 1), PIECE):
                part = text[begin : begin + PIECE + length - 1]
                if size and size + len(part) > CHUNK:
                    yield np.array(keys).reshape(-1, 2), np.array(offsets), texts
                    keys, offsets, texts, size = [], [], [], 0
                keys.append(key)
                offsets.append(begin)
                texts.append(part)
                size += len(part)
    if texts:
        yield np.array(keys).reshape(-1, 2), np.array(offsets), texts


def half_counts(docs: DataFrame, length: int) -> DataFrame:
    """Rows (h, n): how often each of the longer strings beside anchors is met."""
    short, half = sizes(length)

    def run(batches):
        for _, _, texts in pieces(batches, length):
            text = Text(texts)
            _, doc, at = anchors(text, length)
            left, has_left, right, has_right = halves(text, doc, at, length)
            place = np.unique(np.concatenate([left[has_left], right[has_right]]))
            h, n = np.unique(text.hashes(short + half)[place] if len(place) else place.astype(U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def digests(parts) -> np.ndarray:
    """Two longs for each byte string."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts), "<i8").reshape(-1, 2)


def contexts(docs: DataFrame, length: int, held) -> DataFrame:
    """Rows (h, c1, c2, m, spans) of the distinct contexts of each chunk of which a longer string may be in the filter."""
    short, half = sizes(length)
    reach = length - short
    kind = [("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]

    def run(batches):
        for keys, offsets, texts in pieces(batches, length):
            text = Text(texts)
            h, doc, at = anchors(text, length)
            if not len(h):
                continue
            left, has_left, right, has_right = halves(text, doc, at, length)
            long_ = text.hashes(short + half)
            some = has_left & hit(held.value, long_[np.maximum(left, 0)])
            some |= has_right & hit(held.value, long_[np.minimum(right, len(long_) - 1)])
            h, doc, at = h[some], doc[some], at[some]
            start = text.start[doc]
            lo = np.maximum(start, at - reach)
            hi = np.minimum(start + text.size[doc], at + length)
            c = digests(text.bytes[b:e] for b, e in zip(lo.tolist(), hi.tolist(), strict=True))
            name = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)[doc]
            lo, hi = lo - start + offsets[doc], hi - start + offsets[doc]
            order = np.lexsort((doc, lo, name, c[:, 1], c[:, 0], h))
            h, c, name, lo, hi, doc = h[order].view(np.int64), c[order], name[order], lo[order], hi[order], doc[order]
            changes = lambda *columns: np.logical_or.reduce([np.append(True, x[1:] != x[:-1]) for x in columns])
            new = changes(h, c[:, 0], c[:, 1])
            place = new | changes(name, lo)  # copies of a text hold the same span
            begin = np.flatnonzero(new)
            m = np.add.reduceat((place | changes(doc)).astype(np.int64), begin) if len(begin) else begin
            at_ = np.flatnonzero(place)
            own = keys[doc[at_]]
            structs = pa.StructArray.from_arrays(
                [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(lo[at_].astype(np.int32)), pa.array(hi[at_].astype(np.int32))], fields=[pa.field(*x) for x in kind]
            )
            edge = np.append(np.searchsorted(at_, begin), len(at_)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[begin]), pa.array(c[begin, 0]), pa.array(c[begin, 1]), pa.array(m), pa.ListArray.from_arrays(pa.array(edge), structs)], [*CONTEXT, "m", "spans"]
            )

    return docs.mapInArrow(run, f"h long, c1 long, c2 long, m long, spans {SPAN}")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (k1, k2, __text) for each text of ``wanted``, and for some others that a filter of fixed size lets pass."""
    held = bitset(wanted, "k1")

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            some = hit(held.value, batch.column("k1").to_numpy().view(U64))
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True)):
                some[i] = some[i] and key not in seen
                if some[i]:
                    seen.add(key)
            yield batch.filter(pa.array(some))

    return docs.mapInArrow(run, "k1 long, k2 long, __text binary").groupBy(*KEY).agg(F.first("__text").alias("__text"))


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (h, c1, c2, k1, k2, lo, context) for the rows (h, c1, c2, k1, k2, lo, hi, hot) of ``wanted``."""
    per_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*CONTEXT, "lo", "hi", "hot")).alias("__wanted"))
    schema = "h long, c1 long, c2 long, k1 long, k2 long, lo int, context binary, hot boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k1, k2, text, rows in zip(*(batch.column(c).to_pylist() for c in (*KEY, "__text", "__wanted")), strict=True):
                for i in range(0, len(rows), GATHER):
                    part = [{**r, "k1": k1, "k2": k2, "context": text[r["lo"] : r["hi"]]} for r in rows[i : i + GATHER]]
                    yield pa.RecordBatch.from_pylist(part, kinds).select(names)

    kinds = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in schema.split(", "))])
    return texts_of(docs, wanted.select("k1")).join(per_text, KEY).mapInArrow(run, schema)


def common(text: Text, a: np.ndarray, b: np.ndarray, limit: int | np.ndarray) -> np.ndarray:
    """Common extension of the suffixes at a and b, ``limit`` at most, by binary search over prefix hashes."""
    up, down = powers(len(text.prefix))
    low = np.zeros(len(a), np.int64)
    high = np.broadcast_to(np.asarray(limit, np.int64), len(a)).copy()
    pa_, pb, da, db = text.prefix[a], text.prefix[b], down[a], down[b]
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (text.prefix[a + mid] - pa_) * da == (text.prefix[b + mid] - pb) * db
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def before(text: Text, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Is the string at a before the one at b (both of ``length`` bytes)?"""
    lcp = common(text, a, b, length)
    at = np.minimum(lcp, length - 1)
    return (lcp < length) & (text.data[a + at] < text.data[b + at])


def suffix_sort(text: Text, at: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at the given places in the order of their first ``length`` bytes: a stable bottom-up mergesort.

    All merges of a level are done together.  An element's place in the merged
    run is its place in its own run plus the number of elements of the other
    run that go before it, found by binary search.
    """
    order, n = at.copy(), len(at)
    run = 1
    place = np.arange(n)
    while run < n:
        left = (place // run) % 2 == 0
        other = np.where(left, (place // run + 1) * run, (place // run - 1) * run)
        low = np.minimum(other, n)
        high = np.minimum(other + run, n)
        base = low.copy()
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo]) // 2
            mine, theirs, is_left = order[todo], order[mid], left[todo]
            # on a tie the left run's element goes first
            first = np.where(is_left, before(text, theirs, mine, length), ~before(text, mine, theirs, length))
            low[todo] = np.where(first, mid + 1, low[todo])
            high[todo] = np.where(first, high[todo], mid)
        begin = place // (2 * run) * (2 * run)
        target = begin + place % run + (low - base)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        run *= 2
    return order


def repeated_windows(text: Text, at: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Which windows occur at another one of the given places, exactly.

    ``at`` is ascending; ``room`` is the number of bytes from each place to the
    end of its context.  Windows whose hash is alone are out.  Of each run of
    neighbouring other windows the first is put in order with the longest one of
    the same hash; its common extension with its neighbours in that order,
    confirmed on the bytes, settles as many windows as it covers, and the next
    window of the run goes on.  Where the bytes prove a collision, the candidates
    are compared by their bytes alone.
    """
    n = len(at)
    sure = np.zeros(n, bool)
    h = text.hashes(length)[at]
    _, group, size = np.unique(h, return_inverse=True, return_counts=True)
    some = size[group] > 1
    last = np.ones(n, bool)  # last window of its run of candidates
    last[:-1] = ~(some[:-1] & some[1:] & (at[1:] == at[:-1] + 1) & (room[1:] < room[:-1]))
    end = np.flatnonzero(last)
    left = end[np.searchsorted(end, np.arange(n))] - np.arange(n) + 1
    # the two windows of each hash with the longest runs behind them
    order = np.lexsort((-left, group))
    begin = np.searchsorted(group[order], np.arange(len(size)))
    best, second = order[begin], order[np.minimum(begin + 1, n - 1)]
    first = some.copy()
    first[1:] &= last[:-1] | ~some[:-1]
    todo = np.flatnonzero(first)
    while len(todo):
        mate = np.where(best[group[todo]] == todo, second[group[todo]], best[group[todo]])
        members = np.unique(np.concatenate([todo, mate]))
        ranked = np.searchsorted(at, suffix_sort(text, at[members], length))
        place = np.empty(n, np.int64)
        place[ranked] = np.arange(len(ranked))
        reach, other = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        for step in (-1, 1):
            where = place[todo] + step
            ok = (where >= 0) & (where < len(ranked))
            near = ranked[np.clip(where, 0, len(ranked) - 1)]
            ext = np.where(ok, common(text, at[todo], at[near], np.where(ok, np.minimum(room[todo], room[near]), 0)), 0)
            other, reach = np.where(ext > reach, near, other), np.maximum(ext, reach)
        done = np.ones(len(todo), np.int64)
        for i in np.flatnonzero(reach >= length):
            a, b, size_ = at[todo[i]], at[other[i]], reach[i]
            if text.bytes[a : a + size_] != text.bytes[b : b + size_]:
                return equal_windows(text, at, some, length)
            done[i] = min(size_ - length + 1, left[todo[i]])
            sure[todo[i] : todo[i] + done[i]] = True
        if (reach < length).any():  # its hash is not alone, so it should have found its equal
            return equal_windows(text, at, some, length)
        todo = (todo + done)[done < left[todo]]
    return sure


def equal_windows(text: Text, at: np.ndarray, some: np.ndarray, length: int) -> np.ndarray:
    """Which of the candidate windows occur twice, by their bytes."""
    count: dict[bytes, int] = {}
    windows = [text.bytes[a : a + length] if ok else None for a, ok in zip(at.tolist(), some.tolist(), strict=True)]
    for w in windows:
        count[w] = count.get(w, 0) + 1
    return np.array([w is not None and count[w] > 1 for w in windows], bool)


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def spans_in(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """Spans (k1, k2, lo, hi) of the windows of some contexts (k1, k2, lo, bytes) that occur twice among them."""
    keys = np.array([x[:2] for x in rows])
    low = np.array([x[2] for x in rows])
    text = Text([x[3] for x in rows])
    windows = text.size - length + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    # overlapping contexts hold the same window of a text: one of each
    ids = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
    first = np.unique(ids[owner] * (1 << 32) + low[owner] + offset, return_index=True)[1]
    first.sort()
    owner, offset = owner[first], offset[first]
    good = np.flatnonzero(repeated_windows(text, text.start[owner] + offset, text.size[owner] - offset, length))
    out: list[tuple[int, int, int, int]] = []
    edges = np.flatnonzero(np.diff(owner[good])) + 1
    for part in np.split(good, edges) if len(good) else []:
        begin = low[owner[part[0]]] + offset[part]
        out += [(*rows[owner[part[0]]][:2], a, b) for a, b in merge_spans(begin, begin + length)]
    return out


def sorted_windows(some: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows of contexts.

    The contexts of an anchor string come to one partition and there one after
    the other, so about GATHER contexts at a time are in memory, or those of one
    anchor string.
    """

    def spans(held):
        found = spans_in(held, length)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], [*KEY, "lo", "hi"])

    def run(batches):
        held: list[tuple] = []
        last = None
        for batch in batches:
            for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", *KEY, "lo", "context")), strict=True):
                if len(held) >= GATHER and h != last:
                    yield spans(held)
                    held = []
                last = h
                held.append(tuple(row))
        if held:
            yield spans(held)

    return some.repartition("h").sortWithinPartitions("h").mapInArrow(run, "k1 long, k2 long, lo int, hi int")


def counted_windows(some: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows of contexts whose anchor has too many: by counting digests."""

    def run(batches):
        for batch in batches:
            for k1, k2, low, context in zip(*(batch.column(c).to_pylist() for c in (*KEY, "lo", "context")), strict=True):
                n = len(context) - length + 1
                w = digests(context[i : i + length] for i in range(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(np.arange(low, low + n, dtype=np.int32))], ["w1", "w2", *KEY, "lo"]
                )

    windows = stored(some.mapInArrow(run, "w1 long, w2 long, k1 long, k2 long, lo int"), "windows")
    place = F.struct(*KEY, "lo")
    twice = windows.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("w1", "w2")
    return windows.join(twice, ["w1", "w2"], "left_semi").select(*KEY, "lo", (F.col("lo") + length).cast("int").alias("hi"))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Rows (k1, k2, lo, hi) of repeated byte spans, overlapping ones included; ``docs`` has k1, k2 and __text (bytes)."""
    long_ = docs.where(F.length("__text") >= length)
    twice = stored(half_counts(long_, length).where("n > 1").select("h"), "anchors")
    seen = stored(contexts(long_, length, bitset(twice, "h")), "contexts")
    classes = seen.groupBy(*CONTEXT).agg(F.sum("m").alias("m"), F.min(F.col("spans")[0]).alias("one"))
    classes = stored(classes, "classes")
    whole = classes.where("m > 1").select(*CONTEXT)
    # the same plan at every size: both sides are large where the corpus is
    spans = seen.join(whole.hint("merge"), CONTEXT, "left_semi").select(F.explode("spans").alias("s")).select("s.*")
    open_ = classes.groupBy("h").agg(F.count("*").alias("d"), F.min("m").alias("least")).where("d > 1 and least = 1").select("h", (F.col("d") > MOST).alias("hot"))
    some = stored(fetched(long_, stored(classes.join(open_, "h").select(*CONTEXT, "one.*", "hot"), "open")), "fetched")
    # a context that is repeated in full needs no count of its windows
    return spans.unionByName(sorted_windows(some.where(~F.col("hot")), length)).unionByName(counted_windows(some.where("hot"), length))


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 400, keep_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans and, with ``keep_text``, the bytes that are left."""
    data = F.coalesce(as_bytes(text), F.lit(b""))
    keyed = docs.select(F.col(id_col), data.alias("__text"), F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(length), data).alias("k2"))
    texts = keyed.select(*KEY, "__text")
    spans = stored(repeated_spans(texts, length), "spans")
    merged = spans.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>" + ", kept binary" * keep_text

    def run(batches):
        for batch in batches:
            rows = []
            for data, found in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                own = merge_spans(np.array([s["lo"] for s in found]), np.array([s["hi"] for s in found]))
                cuts = [0, *(x for s in own for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((len(data) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": b} for a, b in own], kept))
            kinds = [pa.int64(), pa.int64(), pa.string(), kind, pa.binary()][: 5 if keep_text else 4]
            columns = [batch.column(k) for k in KEY] + [pa.array([r[i] for r in rows], x) for i, x in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(columns)])

    changed = texts_of(texts, spans.select("k1")).join(merged, KEY).mapInArrow(run, schema)
    light = keyed.select(id_col, *KEY, F.length("__text").cast("long").alias("n_bytes"), F.sha2("__text", 256).alias("__sha"), *[F.col("__text")] * keep_text)
    # a text of many rows is one row of ``changed``
    joined = light.join(changed.hint("merge"), KEY, "left")
    out = [id_col, "n_bytes", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "__sha").alias("kept_sha256")]
    out += [F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans")] + [F.coalesce("kept", "__text").alias("kept")] * keep_text
    return joined.select(*out)


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("spans")
