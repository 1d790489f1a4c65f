"""Repeated byte strings by a sparse suffix array.

A byte is removed if a string of ``length`` bytes that also starts in a document with a smaller
doc_id covers it. One sort key per byte would move many times the input. So suffixes are sampled
by content: each window of ``length`` bytes has an anchor, the leftmost of its least-hashed
``GRAM``-byte strings. Equal windows have equal anchors at equal places, wherever they stand.

1. Documents are packed into blocks, each written once.
2. Splitters come from a sample of the anchors' leading bytes; there are as many ranges as PART_BYTES
   go into the input. Each block sends a 32-bit print of its anchors to the anchor's range. Prints
   that occur once are gone after that; a wrong hit costs a comparison and no more.
3. For the anchors left, blocks send the suffixes with the windows around them, one for each
   content: of equal ones in a block only that of the smallest doc_id. A hot passage costs a row
   per block, whatever its copies.
4. A range sorts its suffixes by multikey quicksort, eight bytes a step: those that agree so far are
   sorted by their next bytes, to the end. So equal strings stand side by side, byte for byte. The
   smallest doc_id owns a string, the others are reported to their blocks. Copies of a whole suffix
   are dealt with first, then the windows of those left.
5. Leading bytes that several splitters share are hot: their suffixes lie in several ranges, dealt
   by block, and no print is asked for. What such a range has not found repeated is compared across
   the boundaries: its windows meet the other ranges' by value.
6. Blocks paint the reported windows and digest what is left, or put the rows together again.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` keep all; rows
with the same doc_id are never compared with each other; rows with a null doc_id come after all
others and are not compared with each other; repeated rows are judged row by row; a very long text
is a block of its own, whole in one task; an empty table gives an empty result; extra columns,
whatever their names, are ignored by repeated_bytes and passed on by remove_repeats.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from .common import materialize, partitions, skew_join, splitmix

GRAM = 20
BLOCK_BYTES = 2 << 20
#: Bytes of input to a range, and the most ranges (their splitters go to every task).
PART_BYTES, MAX_PARTS = 4 << 20, 1 << 20
#: Anchors sampled in a block, from one stretch of this many bytes; suffixes whose windows are sorted at a time.
SAMPLE, STRETCH, CHUNK = 32, 1 << 16, 1 << 16
KEY = 18
LAST = (1 << 63) - 1


def _words(raw, at: int, n: int):
    """The n 8-byte words that start at bytes at, at+1, ... of a padded buffer."""
    import numpy as np

    return np.ndarray((n,), "<u8", raw, at, (1,))


def _pad(raw: bytes) -> bytes:
    return raw + bytes(96)


def anchors(raw: bytes, starts, length: int):
    """Runs of windows with a common anchor in documents laid end to end (starts: len + 1 offsets).
    Gives (anchor, first window, last window, 32-bit print of the anchor's bytes), ascending."""
    import numpy as np

    n, wide = len(raw), length - GRAM + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint32),)
    if n < length:
        return none
    buf = _pad(raw)
    with np.errstate(over="ignore"):
        h = _words(buf, 0, n) * np.uint64(0x9E3779B97F4A7C15)
        h += (_words(buf, 8, n) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h += (_words(buf, 12, n) >> np.uint64(32)) * np.uint64(0xCA5A826395121157)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
    low, span = h, 1
    while 2 * span <= wide:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: n - wide + 1], low[wide - span : wide - span + n - wide + 1])
    low = low[: n - length + 1]
    # Windows over a document's end are none: they end a run, and begin none.
    ok = np.ones(len(low), bool)
    for e in starts[1:-1].tolist():
        ok[max(0, e - length + 1) : e] = False
    new = np.empty(len(low), bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
    new[starts[1:-1][starts[1:-1] < len(low)]] = True
    # A place that is its own window's anchor ends the windows that it serves; the windows after a
    # run's last such place have theirs beyond the run.
    own = h[: len(low)] == low
    new[1:] |= own[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    at, beyond = last.copy(), np.flatnonzero(~own[last])
    view = np.lib.stride_tricks.sliding_window_view(h, wide)
    for k in range(0, len(beyond), 1 << 15):
        f = first[beyond[k : k + (1 << 15)]]
        at[beyond[k : k + (1 << 15)]] = f + (view[f] == low[f][:, None]).argmax(1)
    return at, first, last, h[at]


def _keys(raw: bytes, at, salt):
    """KEY bytes for each place: the sixteen bytes there and two of a salt."""
    import numpy as np

    out = np.zeros((len(at), KEY), np.uint8)
    buf = _pad(raw)
    for k in (0, 8):
        out[:, k : k + 8] = _words(buf, k, len(raw) + 1)[at].view(np.uint8).reshape(-1, 8)
    out[:, 16:] = np.broadcast_to(salt, len(at)).astype(">u2").view(np.uint8).reshape(-1, 2)
    return out


class Ranges:
    """Ranges of keys between splitters. A hot prefix is one that several splitters share; splitters
    that share theirs with no other begin a prefix, whatever their salt."""

    def __init__(self, splitters: list[bytes]):
        import numpy as np

        prefixes = [s[:16] for s in splitters]
        self.hot_prefixes = sorted({a for a, b in zip(prefixes, prefixes[1:]) if a == b})
        hot = set(self.hot_prefixes)
        splitters = sorted({s if s[:16] in hot else s[:16] + b"\0\0" for s in splitters})
        self.first = np.array([int.from_bytes(s[:8], "big") for s in splitters], np.uint64)
        self.edges = np.array(splitters, f"S{KEY}")

    def __len__(self):
        return len(self.edges) + 1

    def of(self, raw: bytes, at, block: int):
        """(range, whether the prefix is hot) of the suffixes that start at places of a block."""
        import numpy as np

        if not len(self.edges) or not len(at):
            return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        salt = int(splitmix(np.array([block], np.uint64))[0] >> np.uint64(48))
        first = self.first
        lead = _words(_pad(raw), 0, len(raw) + 1)[at].byteswap()
        lo = np.searchsorted(first, lead, "left")
        close = np.flatnonzero((lo < len(first)) & (first[np.minimum(lo, len(first) - 1)] == lead))
        hot = np.zeros(len(at), bool)
        if len(close):  # these need more than the first eight bytes
            keys = _keys(raw, at[close], salt)
            lo[close] = np.searchsorted(self.edges, keys.reshape(-1).view(f"S{KEY}"), "right")
            if self.hot_prefixes:
                hot[close] = self.is_hot(keys)
        return lo.astype(np.int64), hot

    def is_hot(self, keys):
        import numpy as np

        return np.isin(np.ascontiguousarray(keys[:, :16]).reshape(-1).view("S16"), np.array(self.hot_prefixes, "S16"))


def multikey(raw: bytes, at, size):
    """Multikey quicksort of the strings raw[at : at + size], eight bytes a step: gives their order
    and, for each place in it, whether the string differs from the one before. Strings that agree to
    the end of the shorter one are told apart by their sizes."""
    import numpy as np

    n = len(at)
    order, new = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, new
    new[0] = True
    w = _words(_pad(raw), 0, len(raw) + 88)
    active, depth, most = np.arange(n), 0, int(size.max())
    while len(active) and depth < most + 8 * (int(size.min()) < most):
        x = order[active]
        left = size[x] - depth
        v = w[np.minimum(at[x] + depth, len(w) - 1)].byteswap()
        if depth >= most:
            v = size[x].astype(np.uint64)
        elif int(left.min()) < 8:
            keep = np.clip(left, 0, 8).astype(np.uint64) * np.uint64(8)
            v = np.where(keep == 64, v, v & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(keep, np.uint64(63))))
        group = np.cumsum(new[active])
        o = np.lexsort((v, group)) if depth else np.argsort(v)
        order[active] = x[o]
        v, group = v[o], group[o]
        new[active[1:]] |= (group[1:] == group[:-1]) & (v[1:] != v[:-1])
        tied = ~new
        tied[:-1] |= ~new[1:]
        active = active[tied[active]]
        depth += 8
    return order, new


def _shrink(a) -> bytes:
    """Integers as bytes, plane by plane, compressed."""
    import numpy as np
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1) if len(a) else b""


def _grow(raw: bytes, dtype):
    import numpy as np
    import zstandard

    if not raw:
        return np.zeros(0, dtype)
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def blocks(docs: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """(block, ids, none, ends, raw, bytes, rest, sample): documents packed as compressed blocks of
    about BLOCK_BYTES; a longer document is a block of its own. If ``whole``, rest holds the rows'
    other columns and which texts are null."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def pack(ids, texts, rows):
            raw = b"".join(texts)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            null = np.array([i is None for i in ids])
            mix = int(splitmix(np.array([number], np.uint64))[0])
            a = mix % max(1, len(raw) - STRETCH)
            part = raw[a : a + STRETCH]
            cut = np.clip(starts - a, 0, len(part))
            at = anchors(part, np.unique(np.append(cut, [0, len(part)])), length)[0]
            pick = splitmix(at.astype(np.uint64) + np.uint64(mix >> 1)).argsort()[:SAMPLE] if len(at) else at
            keys = _keys(part, at[pick], splitmix(at[pick].astype(np.uint64) ^ np.uint64(mix)) >> np.uint64(48))
            rest = None
            if whole:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows[0].schema) as out:
                    for r in rows:
                        out.write_batch(r)
                rest = zstandard.compress(sink.getvalue().to_pybytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.array([LAST if i is None else i for i in ids], np.int64).tobytes()]), pa.array([null.tobytes()]), pa.array([starts[1:].tobytes()]), pa.array([zstandard.compress(raw, 6)], pa.binary()), pa.array([len(raw)]), pa.array([rest], pa.binary()), pa.array([[k.tobytes() for k in keys]], pa.list_(pa.binary()))], names=["block", "ids", "none", "ends", "raw", "bytes", "rest", "sample"])

        ids, texts, rows, size = [], [], [], 0
        for b in batches:
            other = pa.RecordBatch.from_arrays([pc.is_null(b.column("text")), *(b.column(k) for k in range(b.num_columns) if k != text_at)], names=[f"c{k}" for k in range(b.num_columns)]) if whole else None
            since = 0
            for k, (i, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                t = t.encode("utf-8", "surrogatepass") if t else b""
                if texts and size + len(t) > BLOCK_BYTES:
                    yield pack(ids, texts, rows + [other.slice(since, k - since)] if whole else None)
                    number, since = number + 1, k
                    ids, texts, rows, size = [], [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
            if whole and b.num_rows:
                rows.append(other.slice(since))
        if texts:
            yield pack(ids, texts, rows)

    text_at = docs.columns.index("text")
    return (docs if whole else docs.select("doc_id", "text")).mapInArrow(run, "block long, ids binary, none binary, ends binary, raw binary, bytes long, rest binary, sample array<binary>")


def _opened(b):
    """The rows of a batch of blocks: block, ids, null marks, starts, bytes and its other columns."""
    import numpy as np
    import zstandard

    for r in b.to_pylist():
        ends = np.frombuffer(r["ends"], np.int64)
        yield r["block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["none"], bool), np.concatenate([[0], ends]), zstandard.decompress(r["raw"]), r


def _splitters(stored: DataFrame, parts: int) -> list[bytes]:
    """The least sampled key of each of ``parts`` ranges of sampled keys, but for the first. There
    are MAX_PARTS at most."""
    if parts < 2:
        return []
    s = stored.select(F.explode("sample").alias("s")).repartitionByRange(parts, "s").groupBy(F.spark_partition_id().alias("p")).agg(F.min("s").alias("s"))
    return sorted(bytes(r["s"]) for r in s.collect())[1:]


def _prints(ranges: Ranges, length: int):
    """Step 2, on blocks: (part, block, prints). A hot prefix occurs often anyway and sends none."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for block, ids, _, starts, raw, _ in _opened(b):
                at, _, _, h = anchors(raw, starts, length)
                part, hot = ranges.of(raw, at, block)
                at, h, part = at[~hot], h[~hot], part[~hot]
                doc = ids[np.searchsorted(starts, at, "right") - 1]
                # Of each print two are sent if two documents have it, else one.
                key = (part.astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64)
                o = np.lexsort((doc, key))
                key, doc = key[o], doc[o]
                once = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                other = np.append(False, (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])) if len(key) else once
                twice = np.append(False, other[:-1]) & other if len(key) else once
                key = key[once | (other & ~twice)]
                which = (key >> np.uint64(32)).astype(np.int64)
                values = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                cut = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.zeros(0, np.int64)
                rows = [(int(which[i]), block, _shrink(np.diff(values[i:j], prepend=np.uint32(0)))) for i, j in zip(cut, [*cut[1:], len(which)])]
                yield _batch(rows, ["part", "block", "body"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _batch(rows, names, kinds):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _common(batches):
    """Step 2, on a partition of (part, block, body) grouped by part: prints that occur twice."""
    import numpy as np
    import pyarrow as pa

    def done(part, rows):
        lists = [np.cumsum(_grow(body, np.uint32), dtype=np.uint32) for _, body in rows]
        every = np.sort(np.concatenate(lists))
        dup = np.unique(every[1:][every[1:] == every[:-1]])
        for (block, _), values in zip(rows, lists):
            k = np.searchsorted(dup, values)
            hit = values[(k < len(dup)) & (dup[np.minimum(k, len(dup) - 1)] == values)] if len(dup) else dup
            if len(hit):
                hit = hit[np.append(True, hit[1:] != hit[:-1])]
                yield part, block, _shrink(np.diff(hit, prepend=np.uint32(0)))

    for part, rows in _runs(batches, "part", ["block", "body"]):
        yield _batch(list(done(part, rows)), ["part", "block", "body"], [pa.int64(), pa.int64(), pa.binary()])


def _runs(batches, key, names):
    """Consecutive rows with the same key, of rows sorted by it."""
    now, rows = None, []
    for b in batches:
        cols = [b.column(n).to_pylist() for n in [key, *names]]
        for k, *rest in zip(*cols):
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append(rest)
    if rows:
        yield now, rows


def _suffixes(ranges: Ranges, length: int):
    """Step 3, on blocks with the prints found (prints: list of part and body): (part, block, body).
    Of suffixes that agree within the block the others are dealt with here and only passed on
    (part below 0)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for block, ids, _, starts, raw, r in _opened(b):
                lists = [(np.uint64(x["part"]) << np.uint64(32)) | np.cumsum(_grow(x["body"], np.uint32), dtype=np.uint32).astype(np.uint64) for x in r["prints"] or []]
                if not lists and not ranges.hot_prefixes:
                    continue
                wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *lists]))
                at, first, last, h = anchors(raw, starts, length)
                part, on = ranges.of(raw, at, block)
                if len(wanted):
                    key = (part.astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64)
                    k = np.searchsorted(wanted, key)
                    on |= (k < len(wanted)) & (wanted[np.minimum(k, len(wanted) - 1)] == key)
                on = np.flatnonzero(on)
                at, first, last, part = at[on], first[on], last[on], part[on]
                doc = ids[np.searchsorted(starts, first, "right") - 1]
                size = last - first + length
                o, new = multikey(raw, first, size)
                begin = np.flatnonzero(new)
                copy = np.empty(len(o), bool)
                if len(o):
                    copy[o] = doc[o] > np.repeat(np.minimum.reduceat(doc[o], begin), np.diff(np.append(begin, len(o))))
                # Copies of a smaller document's suffix: every window is a repeat.
                rows = []
                c = np.flatnonzero(copy)
                if len(c):
                    rows.append((-1 - (block * 31 + block // (1 << 32)) % 997, block, _reply(first[c], (np.uint32(1) << (last - first + 1)[c].astype(np.uint32)) - np.uint32(1))))
                s = np.flatnonzero(~copy)
                s = s[np.argsort(part[s], kind="stable")]
                p = part[s]
                cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else p
                for i, j in zip(cut, [*cut[1:], len(p)]):
                    t = s[i:j]
                    rows.append((int(p[i]), block, _sent(raw, doc[t], first[t], size[t], (at - first)[t])))
                yield _batch(rows, ["part", "block", "body"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _sent(raw: bytes, doc, first, size, off) -> bytes:
    """Suffixes as bytes: how many, their documents, places, sizes and anchors' places, their text."""
    import numpy as np
    import zstandard

    text = b"".join(raw[x : x + y] for x, y in zip(first.tolist(), size.tolist()))
    head = [doc.astype(np.int64), first.astype(np.int64), size.astype(np.uint8), off.astype(np.uint8)]
    return zstandard.compress(b"".join([len(doc).to_bytes(4, "little"), *(x.tobytes() for x in head), text]), 3)


def _received(bodies: list[bytes]):
    """What _sent put together, of several blocks: (block's number in the list, doc, first, size,
    off, place in raw, raw)."""
    import numpy as np
    import zstandard

    cols, texts = [], []
    for number, body in enumerate(bodies):
        x = zstandard.decompress(body)
        n = int.from_bytes(x[:4], "little")
        at, got = 4, [np.full(n, number)]
        for kind in (np.int64, np.int64, np.uint8, np.uint8):
            got.append(np.frombuffer(x, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        cols.append(got)
        texts.append(x[at:])
    number, doc, first, size, off = (np.concatenate(c) for c in zip(*cols))
    return number, doc, first, size, off, np.cumsum(size) - size, b"".join(texts)


def _reply(first, mask) -> bytes:
    import numpy as np

    n = len(first)
    return n.to_bytes(4, "little") + _shrink(np.concatenate([np.diff(first, prepend=0).astype(np.uint32), mask.astype(np.uint32)]))


def _owned(order, new, doc):
    """For strings in order: the number of each one's group and the smallest document of it."""
    import numpy as np

    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], begin) if len(begin) else begin
    return group, least[group] if len(begin) else least


def resolve(doc, size, off, at, raw: bytes, length: int):
    """Step 4: for each suffix the mask of its windows that start in a smaller document too."""
    import numpy as np

    mask, count = np.zeros(len(doc), np.int64), size - length + 1
    o, new = multikey(raw, at, size)
    group, least = _owned(o, new, doc)
    copy = doc[o] > least
    mask[o[copy]] = (np.int64(1) << count[o[copy]]) - 1
    # Of the others one speaks for those of its document with the same string.
    mine, its = o[~copy], group[~copy]
    lead = np.append(True, its[1:] != its[:-1]) if len(its) else np.zeros(0, bool)
    speaker = np.repeat(mine[lead], np.diff(np.append(np.flatnonzero(lead), len(mine))))
    leads = mine[lead]
    # Equal windows have equal anchors, so the speakers can be taken in turn, anchor by anchor.
    w = _words(_pad(raw), 0, len(raw) + 64)
    a, b = (w[at[leads] + off[leads] + k].byteswap() for k in (0, 8))
    by = np.lexsort((b, a))
    leads, a, b = leads[by], a[by], b[by]
    edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    edge = np.append(edge, len(leads))
    k = 0
    while k < len(edge) - 1:
        z = max(k + 1, int(np.searchsorted(edge, edge[k] + CHUNK, "right")) - 1)
        s = leads[edge[k] : edge[z]]
        row = np.repeat(s, count[s])
        step = np.arange(len(row)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
        o, new = multikey(raw, at[row] + step, np.full(len(row), length))
        hit = o[doc[row][o] > _owned(o, new, doc[row])[1]]
        np.bitwise_or.at(mask, row[hit], np.int64(1) << step[hit])
        k = z
    mask[mine] = mask[speaker]
    return mask


def _matched(ranges: Ranges, length: int):
    """Step 4, on a partition sorted by part: (block, body) with the repeated windows, and of the
    other windows with hot prefixes (block, place, doc, bytes)."""
    names = ["block", "body", "place", "doc", "bytes"]

    def found(rows):
        import numpy as np

        number, doc, first, size, off, at, raw = _received([body for _, body in rows])
        mask = resolve(doc, size, off, at, raw, length)
        ends = np.searchsorted(number, np.arange(len(rows) + 1))
        for (block, _), begin, end in zip(rows, ends, ends[1:]):
            m = begin + np.flatnonzero(mask[begin:end])
            if len(m):
                m = m[np.argsort(first[m], kind="stable")]
                yield block, _reply(first[m], mask[m]), None, None, None
        if ranges.hot_prefixes:
            for k in np.flatnonzero(ranges.is_hot(_keys(raw, at + off, 0))).tolist():
                for step in range(int(size[k]) - length + 1):
                    if not mask[k] >> step & 1:
                        x = int(at[k]) + step
                        yield rows[number[k]][0], None, int(first[k]) + step, int(doc[k]), raw[x : x + length]

    def run(batches):
        import itertools

        import pyarrow as pa

        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for part, rows in _runs(batches, "part", ["block", "body"]):
            every = iter([(*r, None, None, None) for r in rows] if part < 0 else found(rows))
            while some := list(itertools.islice(every, 1 << 16)):
                yield _batch(some, names, kinds)

    return run


def _across(told: DataFrame) -> DataFrame:
    """Step 5: (block, body) of the windows left that start in a smaller document of another range.
    A range sends a window of one document only, but that may hold it often."""
    left = told.where("bytes is not null").select("block", "place", "doc", "bytes")
    least = left.groupBy("bytes").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("k")).where("least < most")
    least = materialize(least.drop("most"), "across")
    total = least.agg(F.sum("k")).first()[0] or 0
    again = skew_join(left, least.select("bytes", "least"), ["bytes"], least, total, F.col("place")).where("doc > least").select("block", "place")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = []
            for block, places in zip(b.column("block").to_pylist(), b.column("places")):
                p = np.sort(np.asarray(places.values))
                rows.append((block, _reply(p, np.ones(len(p), np.int64))))
            yield _batch(rows, ["block", "body"], [pa.int64(), pa.binary()])

    return again.groupBy("block").agg(F.collect_list("place").alias("places")).mapInArrow(run, "block long, body binary")


def _removed(n: int, replies, length: int):
    """Which of n bytes are covered by the windows of the replies."""
    import numpy as np

    edge = np.zeros(n + 1, np.int32)
    for body in replies or []:
        k = int.from_bytes(body[:4], "little")
        both = _grow(body[4:], np.uint32)
        first, mask = np.cumsum(both[:k].astype(np.int64)), both[k:]
        for bit in range(32):
            s = first[(mask >> np.uint32(bit)) & np.uint32(1) != 0] + bit
            if len(s):
                np.add.at(edge, s, 1)
                np.add.at(edge, s + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _painted(docs: DataFrame, length: int, finish, schema, whole: bool = False) -> DataFrame:
    """finish(ids, null marks, starts, raw, removed, rest) gives the batch of each block."""
    if not GRAM + 8 <= length <= GRAM + 31:
        raise ValueError(f"length must be from {GRAM + 8} to {GRAM + 31}: a suffix's windows are the bits of a 32-bit mask")
    stored = materialize(blocks(docs, length, whole), "blocks", "none")
    size = stored.agg(F.sum("bytes")).first()[0] or 0
    ranges = Ranges(_splitters(stored, min(MAX_PARTS, -(-size // PART_BYTES))))
    n = max(partitions(docs.sparkSession), len(ranges))
    body = stored.select("block", "ids", "none", "ends", "raw")
    sent = body.mapInArrow(_prints(ranges, length), "part long, block long, body binary")
    found = sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_common, "part long, block long, body binary")
    lists = found.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("prints"))
    out = body.join(lists.hint("shuffle_hash"), "block", "left").mapInArrow(_suffixes(ranges, length), "part long, block long, body binary")
    told = out.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_matched(ranges, length), "block long, body binary, place long, doc long, bytes binary")
    if ranges.hot_prefixes:
        told = materialize(told, "matches")
        told = told.where("body is not null").select("block", "body").unionByName(_across(told))
    replies = told.groupBy("block").agg(F.collect_list("body").alias("replies"))

    def paint(batches):
        for b in batches:
            for _, ids, none, starts, raw, r in _opened(b):
                yield finish(ids, none, starts, raw, _removed(len(raw), r["replies"], length), r.get("rest"))

    every = stored.drop("sample", "bytes") if whole else body
    return every.join(replies.hint("shuffle_hash"), "block", "left").mapInArrow(paint, schema)


def repeated_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    def finish(ids, none, starts, raw, removed, rest):
        import numpy as np

        kept = np.frombuffer(raw, np.uint8)
        rows = []
        for i, null, a, z in zip(ids.tolist(), none.tolist(), starts.tolist(), starts[1:].tolist()):
            r = removed[a:z]
            spans = int(r[:1].sum() + (r[1:] & ~r[:-1]).sum())
            rows.append((None if null else i, z - a, int(r.sum()), spans, hashlib.sha256(kept[a:z][~r].tobytes() if spans else raw[a:z]).hexdigest()))
        import pyarrow as pa

        return _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [*[pa.int64()] * 4, pa.string()])

    return _painted(docs, length, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, begins, ends) in bytes of the maximal removed runs, for rows that have some."""
    def finish(ids, none, starts, raw, removed, rest):
        import numpy as np
        import pyarrow as pa

        rows = []
        for i, null, a, z in zip(ids.tolist(), none.tolist(), starts.tolist(), starts[1:].tolist()):
            d = np.diff(removed[a:z].astype(np.int8), prepend=0, append=0)
            if d.any():
                rows.append((None if null else i, np.flatnonzero(d > 0), np.flatnonzero(d < 0)))
        return _batch(rows, ["doc_id", "begins", "ends"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])

    return _painted(docs, length, finish, "doc_id long, begins array<long>, ends array<long>")


def without(text: str, begins, ends) -> str:
    """The text without byte runs; a run gives up a character that it doesn't hold whole."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    for b, e in zip(begins, ends):
        while inside(b):
            b += 1
        while e > b and inside(e):
            e -= 1
        if b < e:
            out.append(raw[at:b])
            at = e
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with the repeated runs cut out of text; n_chars, where there is such a column, follows.
    Documents of which no word is left go. Rows travel whole within their block, so neither doc_id
    nor any other column need identify them."""
    names = docs.columns
    others = [n for n in names if n != "text"]

    def finish(ids, none, starts, raw, removed, rest):
        import numpy as np
        import pyarrow as pa
        import zstandard

        table = pa.ipc.open_stream(zstandard.decompress(rest)).read_all()
        texts, keep = [], []
        for null, a, z in zip(table.column(0).to_pylist(), starts.tolist(), starts[1:].tolist()):
            text = None if null else raw[a:z].decode("utf-8", "surrogatepass")
            d = np.diff(removed[a:z].astype(np.int8), prepend=0, append=0)
            cut = d.any()
            if cut:
                text = without(text, np.flatnonzero(d > 0).tolist(), np.flatnonzero(d < 0).tolist())
            texts.append(text)
            keep.append(not cut or bool(text.split()))
        cols = {n: table.column(k + 1) for k, n in enumerate(others)}
        if "n_chars" in cols:
            kind = cols["n_chars"].type
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
        cols["text"] = pa.array(texts, pa.string())
        t = pa.table([cols[n] for n in names], names=names).filter(pa.array(keep)).combine_chunks()
        return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_arrays([pa.array([], c.type) for c in t.columns], names=names)

    return _painted(docs, length, finish, docs.schema, whole=True)
