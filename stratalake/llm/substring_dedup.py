"""Substring deduplication by compact windows.

A text is the sequence of its WIDTH-word shingles. Under one hash function all passages of a text that share a min-hash form compact windows:
a centre and the widest stretch over which it is least, the subtrees of the text's Cartesian tree. Only windows of the least
passage length count; their centres are the minima of sliding windows, so the tree is built over those alone.

Passages at a similarity of s share the min-hash of a function with probability s, and then lie in windows of one key. Candidates agree on ENOUGH of
FUNCTIONS: an interval join of their windows has to leave a stretch of the least length. It comes twice:

* Each document's windows meet those of the least document of their key. What ENOUGH functions say is shared is verified, at most one comparison
  for a document and a stretch of it, whatever the size of a group.
* A window that this leaves unexplained (its key's least document lacks the passage) is joined with the other windows of such keys in its own
  document: the keys of two functions together are a new key. Under it all windows are compared with all lesser ones around their centres, in
  blocks inside tasks, until one shares a passage; these pairs are verified too. A passage can be halved until it is shorter than twice the least
  length, one half being no less similar than the whole, so what lies that near the centres decides. Windows whose surroundings are
  an exact copy of a lesser document's needn't take part: that document's do.

Verification finds the stretches of a text whose shingles the other holds on one diagonal, and keeps those with LEAST_WORDS words and a Jaccard
similarity of PERCENT or more. An exact repeat always agrees on all functions; a passage at similarity s on two of six with
probability 1 - (1 - s)^6 - 6 s (1 - s)^5: 0.16 % are missed at s = 0.8. What the least document of its keys lacks is found if it agrees on two functions in turn: 1.9 %
of passages of the least length are missed at s = 0.8, 0.25 % at 0.9; longer ones agree in several places.

A doc_id may be of any type that has an order.

Defined cases: null, empty and short texts have no window and no row; repeats within one document, and rows with a null doc_id, are left
alone; rows that repeat a doc_id with the same text count once; a passage stays in the least document that holds it; an empty table gives an empty result;
columns other than doc_id and text are ignored by repeats() and kept by cut().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import U64, bounded, discard, mix64, partitions_for, raw_bytes, runs, shielded, shingles, table, text_slices, whole_numbers, word_bounds, word_hashes, written
from stratalake.llm.near_dedup import with_ids

WIDTH = 5
LEAST_WORDS = 50
PERCENT = 80
FUNCTIONS = 6  # at most 8: a key's last three bits say its function
ENOUGH = 2
BLOCK = 4096
BUCKET_BYTES = 1 << 28  # of texts whose keys one task sorts for the bitmap (about 40 MB of keys)
TASK_WINDOWS = 2_000_000  # windows that a task sorts, about
MOST_BITS = 1 << 28  # of the bitmap that spares most windows of one document: 32 MB at most
LEAST = LEAST_WORDS - WIDTH + 1  # shingles in the shortest passage
REACH = 2 * LEAST - 1  # shingles in the longest that can't be halved


def sliding_least(keys: np.ndarray, t: int) -> np.ndarray:
    """The least of each t neighbours, from minima that run forwards and backwards through blocks of t."""
    m = len(keys)
    padded = np.full(-(-m // t) * t, np.iinfo(np.uint64).max, U64)
    padded[:m] = keys
    blocks = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: m - t + 1], ahead[t - 1 : m])


def minima(hashes: np.ndarray, offsets: np.ndarray, t: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, first and last stretch of which each is least, values without their last bits) of the minima of the stretches of t places of several texts laid
    end to end."""
    m = len(hashes)
    none = np.zeros(0, np.int64)
    if m < t:
        return none, none, none, none.astype(U64)
    bits = U64(max(1, m.bit_length()))
    mask = (U64(1) << bits) - U64(1)
    least = sliding_least((hashes & ~mask) | np.arange(m, dtype=U64), t)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    whole = np.flatnonzero(ends[: m - t + 1] - np.arange(m - t + 1) >= t)  # the stretches that lie in one text
    if not len(whole):
        return none, none, none, none.astype(U64)
    least = least[whole]
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return (least[new] & mask).astype(np.int64), whole[new], whole[np.append(new[1:], len(whole)) - 1], least[new] >> bits


def _nearest_lesser(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The place of the nearest lesser value before each within its text, or -1: pointers jump over what isn't less, all at a time."""
    to = np.arange(len(values)) - 1
    live = np.arange(len(values))
    while True:
        at = to[live]
        live = live[(at >= 0) & (text[at] == text[live]) & (values[at] >= values[live])]
        if not len(live):
            break
        to[live] = to[to[live]]
    to[(to >= 0) & (text[to] != text)] = -1
    return to


def compact_windows(hashes: np.ndarray, offsets: np.ndarray, t: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first centres, last centres, lefts, rights) of the compact windows of at least t places of several texts laid end to end, by first centre.
    Equal hashes that are least in the same stretch are the centres of one window, so a text of one shingle over and over has
    one window."""
    centres, begins, ends, values = minima(hashes, offsets, t)
    if not len(centres):
        return (np.zeros(0, np.int64),) * 4
    text = np.searchsorted(offsets, centres, side="right") - 1
    # The Cartesian tree of the minima: where the nearest lesser place is t or more away, it is a minimum itself.
    n = len(values)
    before = _nearest_lesser(values, text)
    after = n - 1 - _nearest_lesser(values[::-1], text[::-1])[::-1]
    lefts = np.where(begins == centres - t + 1, np.where(before >= 0, centres[before] + 1, offsets[text]), begins)
    rights = np.where(ends == centres, np.where(after < n, centres[np.minimum(after, n - 1)] - 1, offsets[text + 1] - 1), ends + t - 1)
    # Equal values between the same lesser ones are one window, from the first one's left to the last one's right.
    order = np.lexsort((centres, values, before, text))
    new = np.concatenate([[True], (values[order][1:] != values[order][:-1]) | (before[order][1:] != before[order][:-1]) | (text[order][1:] != text[order][:-1])])
    first, last = order[new], order[np.append(np.flatnonzero(new)[1:], n) - 1]
    place = np.argsort(centres[first], kind="stable")
    first, last = first[place], last[place]
    return centres[first], centres[last], lefts[first], rights[last]


def _hashed(values: np.ndarray, f: int) -> np.ndarray:
    return mix64(values ^ U64((0x9E3779B97F4A7C15 * (f + 1)) % 2**64))


def _keyed(hashes: np.ndarray, f: int) -> np.ndarray:
    return (hashes & ~U64(7)) | U64(f)


def windows_of(values: np.ndarray, offsets: np.ndarray, passing=None) -> list[np.ndarray]:
    """[key, left, right, first centre, last centre] of the windows of texts laid end to end under all functions; passing says which keys are
    wanted."""
    out = []
    for f in range(FUNCTIONS):
        h = _hashed(values, f)
        c, d, left, right = compact_windows(h, offsets)
        key = _keyed(h[c], f)
        if passing is not None:
            live = np.flatnonzero(passing(key))
            key, left, right, c, d = key[live], left[live], right[live], c[live], d[live]
        out.append([key, left, right, c, d])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _slices(batches):
    """(rows, shingles, offsets) of slices of texts; texts of fewer than LEAST_WORDS words have none."""
    for batch in batches:
        for part, texts in text_slices(batch, "text"):
            words, rows = word_hashes(texts)
            sets = [shingles(words[rows[i] : rows[i + 1]], WIDTH) if rows[i + 1] - rows[i] >= LEAST_WORDS else np.zeros(0, U64) for i in range(len(texts))]
            yield part, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def slot_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 bits within it) of each key: what the first pass knows it by."""
    mixed = mix64(keys)
    return (mixed >> U64(32)) % U64(buckets), mixed & U64(0xFFFFFFFF)


def _slots(buckets: int, held_most: int = 2_000_000):
    """Rows of (bucket, slots that one text has, slots that several have): the keys of a task's windows, each once, in 4 bytes."""

    def emit(held):
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(codes, np.arange(buckets + 1, dtype=U64) << U64(32))
        once, more = [], []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            own, many = codes[x:y].astype(np.uint32), n[x:y] > 1
            once.append(own[~many].tobytes())
            more.append(own[many].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["bucket", "once", "more"])

    def run(batches):
        held, size = [], 0
        for _, values, offsets in _slices(batches):
            for f in range(FUNCTIONS):
                h = _hashed(values, f)
                c = minima(h, offsets)[0]
                if not len(c):
                    continue
                bucket, slot = slot_of(_keyed(h[c], f), buckets)
                code, text = bucket << U64(32) | slot, np.searchsorted(offsets, c, side="right")
                order = np.lexsort((code, text))
                code, text = code[order], text[order]
                held.append(code[np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])])
                size += len(c)
            if size > held_most:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return run


def _live(group: pa.Table) -> pa.Table:
    """Of a bucket, the slots that several texts have."""
    joined = lambda c: np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint32)
    once = np.sort(joined("once"))
    live = np.union1d(once[1:][once[1:] == once[:-1]], joined("more"))
    return pa.table([group.column("bucket").slice(0, 1), pa.array([len(live)], pa.int64()), pa.array([live.tobytes()], pa.binary())], names=["bucket", "n", "slots"])


def live_bitmap(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """(bits in bytes, bits of a bucket, buckets): the keys that windows of several texts have, eight bits for each, MOST_BITS at most. It lets
    all of these pass, and others by chance, which the join by key leaves out: it spares work and decides nothing."""
    buckets = partitions_for(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0], BUCKET_BYTES)
    live = written(docs.mapInArrow(_slots(buckets), "bucket int, once binary, more binary").groupBy("bucket").applyInArrow(_live, "bucket int, n long, slots binary"), "live")
    total = live.agg(F.sum("n")).first()[0] or 0
    width = max(64, min(MOST_BITS // buckets, -(-8 * total // buckets)) // 64 * 64)

    def piece(batches):
        for batch in batches:
            found = []
            for x in batch.column("slots"):
                bits = np.zeros(width, bool)
                bits[np.frombuffer(x.as_buffer(), np.uint32) % np.uint32(width)] = True
                found.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(found, pa.binary())], names=["bucket", "bits"])

    out = np.zeros((buckets, width // 8), np.uint8)
    for batch in live.mapInArrow(piece, "bucket int, bits binary").toArrow().to_batches():
        for bucket, bits in zip(batch.column("bucket").to_pylist(), batch.column("bits"), strict=True):
            out[bucket] = np.frombuffer(bits.as_buffer(), np.uint8)
    discard(live)
    return out.ravel(), width, buckets


WINDOW = "key long, id long, place long, centre long"


def _windows(shared):
    """Rows of windows whose key passes the bitmap; place and centre hold two numbers each (first << 32 | last)."""

    def run(batches):
        bits, width, buckets = shared.value

        def passing(keys):
            bucket, slot = slot_of(keys, buckets)
            at = (bucket * U64(width) + slot % U64(width)).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

        for part, values, offsets in _slices(batches):
            key, left, right, c, d = windows_of(values, offsets, passing)
            row = np.searchsorted(offsets, left, side="right") - 1
            base = offsets[row]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("id").take(pa.array(row)), pa.array(_pack(left - base, right - base)), pa.array(_pack(c - base, d - base))], names=["key", "id", "place", "centre"])

    return run


def _pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << 32 | last


def _unpack(column) -> tuple[np.ndarray, np.ndarray]:
    both = column.to_numpy(zero_copy_only=False)
    return both >> 32, both & 0xFFFFFFFF


def _groups(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """The number of each row's group, equal rows of these columns lying together."""
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    return np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def agreed(group: np.ndarray, function: np.ndarray, left: np.ndarray, right: np.ndarray, enough: int = ENOUGH, t: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, left, right) of the stretches whose every passage of t places lies in windows of `enough` functions; windows in any order."""
    # A passage is where it begins: windows become the places at which one may, joined within a function.
    order = np.lexsort((left, function, group))
    group, function, left, stop = group[order], function[order], left[order], right[order] - t + 2
    series = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (function[1:] != function[:-1])])) if len(group) else group
    wide = int(stop.max()) + 1 if len(stop) else 1
    reach = np.maximum.accumulate(series * wide + stop) - series * wide
    new = np.concatenate([[True], (series[1:] != series[:-1]) | (left[1:] > reach[:-1])]) if len(group) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:], len(group)) - 1 if len(group) else np.zeros(0, np.int64)
    group, begin, stop = group[new], left[new], reach[last]
    places, change, owner = np.concatenate([begin, stop]), np.repeat([1, -1], len(begin)), np.concatenate([group, group])
    order = np.lexsort((change, places, owner))
    places, owner = places[order], owner[order]
    depth = np.cumsum(change[order])
    opens = np.flatnonzero((depth >= enough) & (np.concatenate([[0], depth[:-1]]) < enough))
    closes = np.flatnonzero((depth < enough) & (np.concatenate([[0], depth[:-1]]) >= enough))
    good = places[closes] > places[opens]
    return owner[opens][good], places[opens][good], places[closes][good] + t - 2


def _regions(batches):
    """Of the rows (a, b, key, place, other) of pairs of documents, those together: where ENOUGH functions agree, with the stretch of b that holds b's
    windows of these keys."""
    for batch in runs(batches, ("a", "b")):
        number = _groups(batch, ("a", "b"))
        left, right = _unpack(batch.column("place"))
        low, high = _unpack(batch.column("other"))
        found, begin, end = agreed(number, batch.column("key").to_numpy(zero_copy_only=False) & 7, left, right)
        # A row belongs to the regions of its group that it shares a passage with; regions of a group lie apart, in order.
        wide = int(right.max()) + 2 if len(right) else 1
        lo = np.searchsorted(found * wide + end, number * wide + left + LEAST - 1)
        hi = np.searchsorted(found * wide + begin, number * wide + right - LEAST + 1, side="right")
        size = np.maximum(hi - lo, 0)
        region = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        b_left, b_right = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), -1)
        np.minimum.at(b_left, region, np.repeat(low, size))
        np.maximum.at(b_right, region, np.repeat(high, size))
        first = np.searchsorted(number, found)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(first)), batch.column("b").take(pa.array(first)), *(pa.array(x.astype(np.int32)) for x in (begin, end, b_left, b_right))], names=["a", "b", "l", "r", "b_l", "b_r"])


def _joint(batches):
    """Of the rows (id, key, place, centre, open) of documents, those together: the joint windows of two functions in turn (the first follows the last) that hold
    the centres of both, whose key is made of both keys, open if one of them is."""
    for batch in runs(batches, ("id",)):
        number = _groups(batch, ("id",))
        left, right = _unpack(batch.column("place"))
        c, d = _unpack(batch.column("centre"))
        key, opens = batch.column("key").to_numpy(zero_copy_only=False).view(U64), batch.column("open").to_numpy(zero_copy_only=False)
        order = np.lexsort((left, number))
        number, left, right, c, d, key, opens = (x[order] for x in (number, left, right, c, d, key, opens))
        wide = int(right.max()) + 2 if len(right) else 1
        # Windows after each, by left, that begin early enough to share a passage with it.
        hi = np.searchsorted(number * wide + left, number * wide + right - LEAST + 1, side="right")
        size = np.maximum(hi - np.arange(len(key)) - 1, 0)
        total = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(key):
            to = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
            n = size[lo:to]
            i = np.repeat(np.arange(lo, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            lo = to
            x, y = np.maximum(left[i], left[j]), np.minimum(right[i], right[j])
            step = (key[j] & U64(7)).astype(np.int64) - (key[i] & U64(7)).astype(np.int64)
            good = np.isin(step % FUNCTIONS, (1, FUNCTIONS - 1)) & (y - x + 1 >= LEAST) & (d[i] >= x) & (c[i] <= y) & (d[j] >= x) & (c[j] <= y)
            i, j, x, y = i[good], j[good], x[good], y[good]
            less = (key[i] & U64(7)) < (key[j] & U64(7))
            both = mix64(np.where(less, key[i], key[j]) * U64(0xD6E8FEB86659FD93) + np.where(less, key[j], key[i]))
            # The first centres of both, and the last ones where equal hashes make several.
            firsts, lasts = np.stack([np.maximum(c[i], x), np.maximum(c[j], x)]), np.stack([np.minimum(d[i], y), np.minimum(d[j], y)])
            several = np.flatnonzero((firsts != lasts).any(axis=0))
            pick = np.concatenate([np.arange(len(i)), several])
            inner = np.concatenate([firsts, lasts[:, several]], axis=1)
            # Of three centres in a passage of REACH places two lie this near, so that only one agreeing on two functions may be lost.
            near = np.flatnonzero(inner.max(axis=0) - inner.min(axis=0) < LEAST)
            pick, inner = pick[near], inner[:, near]
            yield pa.RecordBatch.from_arrays([pa.array(both[pick].view(np.int64)), batch.column("id").take(pa.array(order[i[pick]])), pa.array(_pack(x[pick], y[pick])), pa.array(_pack(inner.min(axis=0), inner.max(axis=0))), pa.array(opens[i[pick]] | opens[j[pick]])], names=["key", "id", "place", "centre", "open"])


def _arrays(kind):
    """The shingles of each text in order, 32 or 16 bits each: a chance match is a lone one and makes no passage."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                words, rows = word_hashes(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingles(words[rows[i] : rows[i + 1]], WIDTH).astype(kind).tobytes() for i in range(len(texts))], pa.binary())], names=["id", "values"])

    return run


def dense_stretches(mask: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The longest stretches [i, j] that begin and end with a match and whose share of matches is at least percent, none inside another."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return []
    score = np.concatenate([[0], np.cumsum(np.where(mask, 100 - percent, -percent))])
    # From each run's begin, the last run's end at which the score is no lower.
    best = np.maximum.accumulate(score[ends][::-1])
    last = len(ends) - 1 - np.searchsorted(best, score[begins], side="left")
    fresh = np.concatenate([[True], last[1:] > np.maximum.accumulate(last)[:-1]])
    return list(zip(begins[fresh].tolist(), (ends[last[fresh]] - 1).tolist(), strict=True))


def _before(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each value's last occurrence before it, or -1; order sorts them stably."""
    out = np.full(len(values), -1)
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


class _Similar:
    """Similarity of stretches of a to what they match in b: first has the first place in b of each value of a that b holds (known)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, first: np.ndarray, order: np.ndarray, least: int, percent: int):
        self.a, self.b, self.known, self.first, self.least, self.percent = a, b, known, first, least, percent
        self.before = _before(a, np.argsort(a, kind="stable")), _before(b, order)

    def whole(self, mask: np.ndarray, where: np.ndarray, i: int, j: int):
        places = where[i : j + 1][mask[i : j + 1]]
        lo, hi = int(places.min()), int(places.max())
        new = np.flatnonzero(self.before[0][i : j + 1] < i) + i
        one, two = len(new), int(np.count_nonzero(self.before[1][lo : hi + 1] < lo))
        new = new[self.known[new]]
        first = self.first[new]
        both = int(np.count_nonzero((first >= lo) & (first <= hi)))
        early = new[first < lo]  # those may occur again from lo on
        if len(early):
            both += int(np.count_nonzero(np.isin(self.a[early], self.b[lo : hi + 1])))
        union = one + two - both
        if 100 * both >= self.percent * union and (hi - lo + 1) * 100 >= self.least * self.percent:
            return i, j, lo, hi, both / union
        return None

    def within(self, mask: np.ndarray, where: np.ndarray, i: int, j: int) -> list:
        """The stretches of [i, j], from the begin of a run to the end of one, that are similar enough, none inside another. A dense stretch that isn't
        may hold some: for each begin the ends are tried, from the last on, whose sizes allow it if all that b holds anywhere is shared."""
        if found := self.whole(mask, where, i, j):
            return [found]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[i : j + 1].astype(np.int8), [0]])))
        ends, out, reach = edges[1::2] + i - 1, [], -1
        for x in (edges[::2] + i).tolist():
            stops = ends[ends >= max(x + self.least - 1, reach + 1)]
            if not len(stops):
                continue
            m, w, new = mask[x : j + 1], where[x : j + 1], self.before[0][x : j + 1] < x
            lo = np.minimum.accumulate(np.where(m, w, len(self.b)))[stops - x]
            hi = np.maximum.accumulate(np.where(m, w, -1))[stops - x]
            in_a, shared = np.cumsum(new)[stops - x], np.cumsum(new & self.known[x : j + 1])[stops - x]
            in_b = np.zeros(len(stops), np.int64)
            for v in np.unique(lo).tolist():
                own = lo == v
                in_b[own] = np.cumsum(self.before[1][v : int(hi[own].max()) + 1] < v)[hi[own] - v]
            for y in stops[100 * shared >= self.percent * (in_a + in_b - shared)][::-1].tolist():
                if found := self.whole(mask, where, x, y):
                    out.append(found)
                    reach = y
                    break
        return out


GAP = 16  # shingles by which neighbouring diagonals of one passage differ at most


def _spans_at(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all stretches of `width` values, made of two overlapping ones of a power of two."""
    names, size = mix64(values.astype(U64) + U64(1)), 1
    while size * 2 <= width:
        names = mix64(names[:-size] * U64(0x9E3779B97F4A7C15) + names[size:] + U64(size))
        size *= 2
    rest = width - size
    return names if not rest else mix64(names[:-rest] * U64(0x9E3779B97F4A7C15) + names[rest:])


def exact_stretches(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int, float]]:
    """Stretches of a that b holds exactly, whatever diagonals they lie on: runs of places whose next `least` values b holds one after the other. Of stretches
    that overlap, as many stay as it takes to cover the same places."""
    if min(len(a), len(b)) < least:
        return []
    x, y = _spans_at(a, least), _spans_at(b, least)
    order = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    hits = np.flatnonzero(y[order][at] == x)
    where = order[at[hits]]
    cuts = np.flatnonzero((np.diff(hits) != 1) | (np.diff(where) != 1)) + 1 if len(hits) else []
    every = [(int(i[0]), int(i[-1]) + least - 1, int(j[0]), int(j[-1]) + least - 1, 1.0) for i, j in zip(np.split(hits, cuts), np.split(where, cuts), strict=True) if len(i)]
    out: list = []
    for x in every:  # by their begins, and so by their ends
        if len(out) > 1 and x[0] <= out[-2][1] + 1:
            out[-1] = x  # the last one isn't needed between its neighbours
        else:
            out.append(x)
    return out


def passages(a: np.ndarray, b: np.ndarray, least: int = LEAST, percent: int = PERCENT) -> list[tuple[int, int, int, int, float]]:
    """(first and last shingle in a, first and last in b, similarity) of the near-duplicate passages of two shingle sequences.

    Matches lie on diagonals. Runs of `least` matches on one diagonal are exact passages; dense stretches of matches in a band of
    diagonals hold passages where their sets are similar enough. At a similarity of s both sides hold s of their shingles in common, whichever has words
    inserted, so a share of `percent` is sought and the sets decide. Passages inside another one are left out."""
    if len(a) < least or len(b) * 100 < least * percent:
        return []
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(ranked) - 1)
    known = ranked[at] == a
    hits = np.flatnonzero(known)
    if len(hits) * 100 < least * percent:
        return []
    shift = order[at[hits]] - hits
    found = []
    values, counts = np.unique(shift, return_counts=True)
    # Diagonals with many matches, and those on which long runs of matches begin: in repetitive text matches fall on the first of equals.
    runs = np.split(np.arange(len(hits)), np.flatnonzero(np.diff(hits) != 1) + 1)
    lines = set(values[counts >= least // 4].tolist()) | {int(shift[r[0]]) for r in runs if len(r) >= least}
    for s in sorted(lines):
        lo, hi = max(0, -s), min(len(a), len(b) - s)
        if hi - lo < least:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (a[lo:hi] == b[lo + s : hi + s]).astype(np.int8), [0]])))
        for i, j in zip((edges[::2] + lo).tolist(), (edges[1::2] + lo - 1).tolist(), strict=True):
            if j - i + 1 >= least:
                found.append((i, j, i + s, j + s, 1.0))
    # Runs of matches that no diagonal explains: text that repeats itself.
    if any(len(r) >= least and not any(i <= hits[r[0]] and hits[r[-1]] <= j for i, j, *_ in found) for r in runs):
        found += exact_stretches(a, b, least)
    similar = None
    bands = np.cumsum(np.concatenate([[0], np.diff(values) > GAP]))
    band = bands[np.searchsorted(values, shift)]
    for k in range(int(bands[-1]) + 1):
        own = band == k
        if own.sum() * 100 < least * percent:
            continue
        mask, where = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        mask[hits[own]] = True
        where[hits[own]] = (hits + shift)[own]
        for i, j in dense_stretches(mask, percent):
            if j - i + 1 >= least:
                similar = similar or _Similar(a, b, known, order[at], order, least, percent)
                found += similar.within(mask, where, i, j)
    found.sort(key=lambda x: (x[0], -x[1], -x[4]))
    out: list = []
    for x in found:
        if not out or x[1] > out[-1][1]:
            out.append(x)
    return out


LINK = "a long, b long, start int, stop int, b_start int, b_stop int, similarity double"


def _verify(batches):
    for batch in batches:
        rows = []
        num = [batch.column(c).to_pylist() for c in ("a", "b", "l", "b_l")]
        for a, b, l, b_l, x, y in zip(*num, batch.column("part_a"), batch.column("part_b"), strict=True):
            for i, j, lo, hi, s in passages(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)):
                # In words: a shingle ends WIDTH - 1 words after it begins; stops are exclusive.
                rows.append((a, b, i + l, j + l + WIDTH, lo + b_l, hi + b_l + WIDTH, s))
        yield _link_batch(rows)


PAIRS = 2_000_000  # places of pairs of windows looked at at a time
SHINGLES = 300_000
FIRST = 64  # least rows of a group that each is compared with at a time
CELLS = 1 << 24  # bits in a table of those that rows hold


def dense_around(known: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST, percent: int = PERCENT) -> np.ndarray:
    """For each row of matches, whether some stretch of `least` or more places that holds the places low to high has a share of `percent` of
    matches."""
    score = np.zeros((len(known), known.shape[1] + 1), np.int32)
    np.cumsum(np.where(known, np.int32(100 - percent), np.int32(-percent)), axis=1, out=score[:, 1:])
    place = np.arange(score.shape[1])
    begin = np.minimum.accumulate(np.where(place <= low[:, None], score, np.int32(2**30)), axis=1)
    return ((score[:, least:] >= begin[:, : score.shape[1] - least]) & (place[least:] > high[:, None])).any(axis=1)


SLACK = 1.5  # places that chance matches may have moved


def _steps(known: np.ndarray, centre: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of matches, how many places there are from its centre on (side 1; before it: -1) up to the first, second, ... match, the centre's own place
    on the left; a large number where there are fewer; the first column is of no match. And how many matches there are by place."""
    n, width = known.shape
    reach = np.arange(min(width, REACH))
    at = centre[:, None] + (reach + 1 if side > 0 else -reach)
    seen = np.take_along_axis(known, np.clip(at, 0, width - 1), axis=1) & (at >= 0) & (at < width)
    many = np.cumsum(seen, axis=1)
    out = np.full((n, len(reach) + 1), np.float32(1e6))
    out[:, 0] = 0
    row, place = np.nonzero(seen)
    out[row, many[row, place]] = place + 1
    return out, many


def alike_around(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, until: np.ndarray) -> np.ndarray:
    """How many places more than the similarity allows could differ (negative: how many are missing) in the best stretches, of the least length, that hold the common centres
    in_a and in_b, and place `until` of a, given which places of either the other holds. Passages have their matches in the same order, so the n-th match beside the centre in one is the n-th in the
    other, and what lies between them on both sides is what they don't share: at PERCENT no more than a share of the matches.
    This holds where shingles aren't repeated, give or take SLACK places."""
    gain = PERCENT / (100 - PERCENT)
    total, reach = [], []
    for side in (-1, 1):
        (x, many), (y, _) = _steps(a, in_a, side), _steps(b, in_b, side)
        n = np.arange(max(x.shape[1], y.shape[1]), dtype=np.float32)
        x, y = (np.pad(z, ((0, 0), (0, len(n) - z.shape[1])), constant_values=1e6) for z in (x, y))
        total.append(np.where((side < 0) | (x >= (until - in_a)[:, None]), n - gain * (x + y - 2 * n), np.float32(-1e9)))
        reach.append((x, many))
    left, right = total
    # The best right side with as many matches, and as long, as the left one leaves to find.
    best = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]
    best = np.concatenate([best, np.full((len(best), 1), np.float32(-1e9))], axis=1)
    length = LEAST - np.minimum(reach[0][0], LEAST).astype(np.int64)
    short = np.where(length > 1, np.take_along_axis(reach[1][1], np.clip(length - 2, 0, reach[1][1].shape[1] - 1), axis=1), 0) + 1
    rest = np.maximum(np.where(length > 0, short, 0), -(-LEAST * PERCENT // 100) - np.arange(left.shape[1]))
    return (left + np.take_along_axis(best, np.clip(rest, 0, best.shape[1] - 1), axis=1)).max(axis=1, initial=-1e9) / gain


def first_alike(groups: np.ndarray, ids: np.ndarray, opens: np.ndarray, alone: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray, offsets: np.ndarray):
    """(row, the least lesser row of its group that shares a passage around its centres) of the open rows. Rows come by group, with the
    shingles around their centres; low, high: the centres' places in them; alone: whether rows of the group's blocks meet all others, or
    those of the other block (own) only.

    Which rows of a group hold which shingles is a table of bits, so what a row's places match in each other one is looked up for many pairs
    together. A share of `percent` around the centres is necessary for a passage; pairs that have it are compared in full, from the least on."""
    n = len(ids)
    order = np.lexsort((ids, groups))
    groups, ids, opens, alone, own, low, high = (x[order] for x in (groups, ids, opens, alone, own, low, high))
    sizes = np.diff(offsets)[order]
    width = int(sizes.max()) if n else 0
    if width < LEAST:
        return
    inside = np.arange(width) < sizes[:, None]
    places = (offsets[:-1][order][:, None] + np.arange(width))[inside]
    row = np.repeat(np.arange(n), sizes)
    values, numbers = np.unique(groups[row] << 32 | codes[places], return_inverse=True)
    edges = np.searchsorted(values >> 32, np.arange(int(groups[-1]) + 2))
    held = np.diff(edges)  # shingles of each group; one column more stays empty
    table = np.repeat(held[groups].astype(np.int32)[:, None], width, axis=1)
    table[inside] = numbers - edges[groups[row]]
    first = np.searchsorted(groups, groups)
    rank = np.arange(n) - first
    left = np.flatnonzero(opens & (rank > 0) & (sizes >= LEAST))
    for least in range(0, int(rank.max()) + 1, FIRST):
        left = left[rank[left] > least]
        if not len(left):
            return
        some = np.flatnonzero((rank >= least) & (rank < least + FIRST) & np.isin(groups, groups[left]))
        cells = held[groups[some]] + 1
        base = np.zeros(n, np.int64)
        base[some] = np.cumsum(cells) - cells
        bits = np.zeros(int(cells.sum()), bool)
        mine = inside[some]
        bits[(base[some][:, None] + table[some])[mine]] = True
        settled: set[int] = set()
        many = np.minimum(rank[left] - least, FIRST)
        total = np.concatenate([[0], np.cumsum(many)])
        k = 0
        while k < len(left):
            to = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS // width, side="right")) - 1)
            x = np.repeat(left[k:to], many[k:to])
            y = first[x] + least + np.arange(len(x)) - np.repeat(total[k:to] - total[k], many[k:to])
            k = to
            good = (ids[y] < ids[x]) & (alone[x] | (own[x] != own[y])) & (sizes[y] * 100 >= LEAST * PERCENT)
            x, y = x[good], y[good]
            known = bits[base[y][:, None] + table[x]]
            good = np.flatnonzero(np.count_nonzero(known, axis=1) * 100 >= LEAST * PERCENT)
            good = good[dense_around(known[good], low[x[good]], high[x[good]])]
            x, y, known = x[good], y[good], known[good]
            # Rows that say a shingle more than once, but for chance, are compared in full.
            rows = np.unique(np.concatenate([x, y]))
            said = np.sort(np.where(inside[rows], table[rows], -1 - np.arange(width)), axis=1)
            varied = np.ones(n, bool)
            varied[rows] = np.count_nonzero(said[:, 1:] == said[:, :-1], axis=1) <= 1
            room = np.zeros(len(x))
            lo = 0
            while lo < len(x):
                cells = held[groups[x[lo:]]] + 1
                news = np.concatenate([[True], x[lo + 1 :] != x[lo:-1]])
                hi = lo + max(1, int(np.searchsorted(np.cumsum(cells * news), CELLS, side="right")))
                p, q = x[lo:hi], y[lo:hi]
                start = np.cumsum(cells[: hi - lo] * news[: hi - lo]) - cells[: hi - lo]  # of the bits of each pair's row
                mine = inside[p[news[: hi - lo]]]
                bits_x = np.zeros(int(start[-1] + cells[hi - lo - 1]), bool)
                bits_x[(start[news[: hi - lo]][:, None] + table[p[news[: hi - lo]]])[mine]] = True
                room[lo:hi] = np.where(varied[p] & varied[q], 1.0, 0.0) * alike_around(known[lo:hi], bits_x[start[:, None] + table[q]], low[p], low[q], high[p])
                lo = hi
            good = room >= -SLACK
            for i, j, sure in zip(x[good].tolist(), y[good].tolist(), (room[good] > SLACK).tolist(), strict=True):
                if i in settled:
                    continue
                a, b = (codes[offsets[r] : offsets[r + 1]] for r in (order[i], order[j]))
                if sure or any(p <= low[i] and high[i] <= q for p, q, *_ in passages(a, b)):
                    settled.add(i)
                    yield int(order[i]), int(order[j])
        left = left[~np.isin(left, np.fromiter(settled, np.int64, len(settled)))]


REGION = "a long, b long, l int, r int, b_l int, b_r int"


def _cross(batches):
    """first_alike() of the rows of each (key, i, j), which come together, as regions."""
    for batch in runs(batches, ("key", "i", "j")):
        num = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        groups = _groups(batch, ("key", "i", "j"))
        data, offsets = raw_bytes(batch.column("near"))
        data, offsets = data.view(np.uint16).astype(np.int64), offsets // 2
        low, high = _unpack(batch.column("centre"))
        at, (left, right) = num("at").astype(np.int64), _unpack(batch.column("place"))
        columns = [num("id"), num("open"), num("i") == num("j"), num("block"), low - at, high - at]
        begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        found, lo = [], 0
        # Groups at a time of SHINGLES, or a larger one.
        for hi in np.append(begins[1:], batch.num_rows)[np.append(offsets[begins[1:]] // SHINGLES != offsets[begins[:-1]] // SHINGLES, True)].tolist():
            found += [(lo + x, lo + y) for x, y in first_alike(groups[lo:hi] - groups[lo], *(c[lo:hi] for c in columns), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            lo = hi
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(num("id")[x]), pa.array(num("id")[y]), *(pa.array(v.astype(np.int32)) for v in (left[x], right[x], left[y], right[y]))], names=["a", "b", "l", "r", "b_l", "b_r"])


def _link_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "start", "stop", "b_start", "b_stop", "similarity"])


def _slice(values, lo, hi, size: int = 4):
    """Places lo to hi of a binary column of values of `size` bytes."""
    return F.substring(values, lo * size + 1, (hi - lo + 1) * size)


def _places(column: str) -> list:
    """The two numbers of a place."""
    return [F.shiftright(column, 32).cast("int"), F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")]


def arrays_of(ids: DataFrame, docs: DataFrame, name: str, kind=np.uint32) -> DataFrame:
    """(id, values) of the documents with these ids, one row each."""
    arrays = with_ids(docs.withColumnRenamed("id", "doc"), "doc", ids, "left_semi").withColumnRenamed("doc", "id").mapInArrow(_arrays(kind), "id long, values binary")
    return written(arrays.dropDuplicates(["id"]), name + "-arrays")


def confirm(regions: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The verified passages of places l to r of a that b holds in its places b_l to b_r."""
    arrays = arrays_of(written(regions.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name + "-ids"), docs, name)
    part = regions.join(arrays.withColumnRenamed("id", "a"), "a").select(*regions.columns, _slice(F.col("values"), F.col("l"), F.col("r")).alias("part_a"))
    both = part.join(arrays.withColumnRenamed("id", "b"), "b").select("a", "b", "l", "b_l", "part_a", _slice(F.col("values"), F.col("b_l"), F.col("b_r")).alias("part_b"))
    links = written(both.mapInArrow(_verify, LINK), name + "-links")
    discard(arrays)
    return links


def repeats(docs: DataFrame) -> DataFrame:
    """A row for each passage of document a that the lesser document b holds as well: words start to stop of a, b_start to b_stop of b,
    similarity of their shingle sets. Documents whose doc_ids aren't whole numbers are numbered in the order of these."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    if whole_numbers(docs):
        return _repeats(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    # Numbers grow along sorted partitions, so no task sees all ids.
    names = written(docs.select("doc_id").distinct().sort("doc_id").select("doc_id", F.monotonically_increasing_id().alias("id")), "numbers")
    links = _repeats(written(docs.join(names, "doc_id").select("id", "text"), "numbered"))
    columns = links.columns
    for c in ("a", "b"):
        links = links.join(names.select(F.col("id").alias(c), F.col("doc_id").alias("_" + c)), c).drop(c).withColumnRenamed("_" + c, c)
    return links.select(*columns)


def _repeats(docs: DataFrame) -> DataFrame:
    """repeats() of rows of id (long) and text."""
    spark = docs.sparkSession
    # Windows are made twice, first as keys alone: most keys belong to one document, and their places would fill disks for nothing.
    bitmap = spark.sparkContext.broadcast(live_bitmap(docs))
    windows = written(docs.mapInArrow(_windows(bitmap), WINDOW), "windows")
    roots = written(windows.groupBy("key").agg(F.min("id").alias("root"), F.max("id").alias("most"), F.min_by("place", "id").alias("other")).where("root < most").select("key", "root", "other"), "roots")
    shared = written(windows.join(roots, "key"), "shared")
    discard(windows, roots)
    n = partitions_for(spark, shared.count(), TASK_WINDOWS)
    stars = shared.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"), "key", "place", "other")
    regions = stars.repartition(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_regions, REGION)
    links = confirm(written(regions, "regions"), docs, "star")
    # A window is explained if a verified passage of its document holds its centres, and spare if an exact one holds all that is near them.
    spans = written(links.groupBy(F.col("a").alias("id")).agg(F.collect_set(F.struct("start", "stop", (F.col("similarity") == 1).alias("exact"))).alias("spans")), "spans")
    spans_of = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int,exact:boolean>>"))
    (first, last), (left, right) = _places("centre"), _places("place")
    near_left, near_right = F.greatest(left, first - (REACH - 1)), F.least(right, last + (REACH - 1))
    lesser = F.col("id") != F.col("root")
    explained = F.exists(spans_of, lambda s: (s["start"] <= first) & (last < s["stop"]))
    spare = lesser & F.exists(spans_of, lambda s: s["exact"] & (s["start"] <= near_left) & (near_right <= s["stop"] - WIDTH))
    keys = written(shared.join(spans, "id", "left").where(lesser & ~explained).select(F.col("key").alias("id")).distinct(), "open-keys")
    if not keys.isEmpty():
        rest = with_ids(shared, "key", keys, "left_semi").join(spans, "id", "left").where(~spare).select("id", "key", "place", "centre", (lesser & ~explained).alias("open"))
        joint = written(rest.repartition(n, "id").sortWithinPartitions("id").mapInArrow(_joint, WINDOW + ", open boolean"), "joint")
        several = joint.groupBy("key").agg(F.min("id").alias("least"), F.max(F.when(F.col("open"), F.col("id"))).alias("most"), F.count("*").alias("size")).where("least < most")
        several = written(several.select("key", "most", "size"), "several")
        found = written(joint.join(several, "key").where("id <= most").drop("most"), "found")
        discard(shared, joint)
        arrays = arrays_of(written(found.select("id").distinct(), "open-ids"), docs, "open", np.uint16)
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        at, until = F.greatest(left, last - (REACH - 1)), F.least(right, first + (REACH - 1))
        spread = found.join(arrays, "id").select("key", "id", "open", "place", "centre", at.alias("at"), _slice(F.col("values"), at, until, 2).alias("near"), parts.alias("parts"))
        spread = spread.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.drop("parts").withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
        n = partitions_for(spark, several.agg(F.sum(F.col("size") * parts)).first()[0], TASK_WINDOWS // 4)
        crossed = spread.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cross, REGION)
        crossed = written(crossed.groupBy("a", "b").agg(*(f(c).alias(c) for f, c in ((F.min, "l"), (F.max, "r"), (F.min, "b_l"), (F.max, "b_r")))), "crossed")
        discard(several, found, arrays)
        links = links.unionByName(confirm(crossed, docs, "cross"))
    else:
        discard(shared)
    return links.distinct()


def _cut_batches(names: list[str]):
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                data, offsets = raw_bytes(texts)
                starts, ends, rows = word_bounds(data, offsets)
                out = []
                for i, spans in enumerate(part.column("_spans").to_pylist()):
                    lo, pieces, own = int(offsets[i]), [], rows[i]
                    for s in sorted((x["start"], x["stop"]) for x in spans):
                        a, b = int(starts[own + s[0]]), int(ends[min(own + s[1], rows[i + 1]) - 1])
                        if a > lo:
                            pieces.append(data[lo:a].tobytes())
                        lo = max(lo, b)
                    pieces.append(data[lo : int(offsets[i + 1])].tobytes())
                    out.append(b"".join(pieces).decode("utf-8", "replace").strip())
                columns = [part.column(n) if k != at else pa.array(out, pa.string()) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs with the passages that links name taken out of document a; documents left without a word go. n_chars, where there is such a
    column, is counted anew."""
    spans = written(links.groupBy(F.col("a").alias("id")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans")), "spans")
    plain, restored = shielded(docs, ["doc_id", "text", "n_chars"])
    untouched = with_ids(plain, "doc_id", spans.select("id"), "left_anti")
    columns = plain.columns
    hit = with_ids(plain, "doc_id", spans.select("id"), "left_semi").join(spans, F.col("doc_id") == F.col("id")).select(*columns, "_spans")
    changed = hit.mapInArrow(_cut_batches(columns), plain.schema).where(F.length("text") > 0)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restored(untouched.unionByName(changed))


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("a").alias("doc_id"), F.col("b").alias("match_doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("stop_word"), F.col("b_start").alias("match_start_word"), F.col("b_stop").alias("match_stop_word"), "similarity")


@bounded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated passage stays in the least document that holds it and is cut from the others."""
    return cut(docs, repeats(docs))
