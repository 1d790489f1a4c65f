"""Hidden Markov language model: trained by Baum-Welch over all training texts, exact likelihoods.

1. Tokens of the training texts are counted (``counts``); all words, however rare, are in this table.
2. A state emits a class of words: each of the CLASSES commonest words is a class of its own, the
   others share a class by their length in bytes (up to SHORT). Within such a class a word has its
   share of the class's count, one added to each known word and once for all unknown ones. So every
   word has a probability that follows the counts of the whole corpus.
3. Every text becomes a row of class numbers (``encoded``). The commonest words, LISTED at most and
   LISTED * (KEY + 1) bytes, are looked up within the task; the others, by text and word, meet the
   counts in a join. A word of over KEY bytes is known by its digest.
4. Baum-Welch: in each of ROUNDS rounds every task runs scaled forward and backward recursions over its
   texts, many at a time, and gives expected counts of emissions, transitions and starts; Spark sums
   them by class. The driver holds a model of CLASSES + SHORT rows, whatever the corpus. In training a
   sequence is up to SEGMENT tokens of a text; all tokens are in one.
5. Scores: the scaled forward recursion over each whole text. Long texts are cut into pieces whose
   transfer matrices are made side by side and multiplied in order, which gives the same likelihood.

Words are runs of anything but space and \\t..\\r with A-Z lower-cased; each text has one end token
more. A text is in training unless crc32 of its doc_id as text leaves HELD_OUT modulo PARTS.

Defined cases: null and empty texts are an end token alone; a null doc_id hashes as an empty text, and
rows with null or repeated doc_ids are rows of their own; without training texts all tokens are
unknown and N is 0; unknown words count as one event of their class; a very long text takes memory
for its class numbers (two bytes a token) in one task; an empty table gives an empty result; extra
columns, whatever their names, are ignored.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, splitmix, worker_state

CLASSES, SHORT, LISTED, KEY = 8192, 16, 131_072, 64
STATES, ROUNDS, SEGMENT = 8, 4, 1024
#: Of the first model: how far states differ in a word (a factor of e**SPREAD), and how often they stay.
SPREAD, STAY = 4.0, 0.9
PARTS, HELD_OUT = 7, 2
#: Tokens worked on at a time, tokens of a piece of a long text, and what a long text is.
SLICE, PIECE, LONG = 1 << 18, 256, 2048
#: The end of a text; no word holds a blank.
END = b" "
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """Words, long ones by their digest, and the end."""
    import hashlib

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if words and max(map(len, words)) > KEY:
        words = [w if len(w) <= KEY else END + hashlib.sha256(w).digest() for w in words]
    words.append(END)
    return words


def counts(docs: DataFrame) -> DataFrame:
    """(token, c) over the training texts. Tasks count before the shuffle, a bounded number of words at a time."""
    flush = 300_000

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def out(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["token", "c"])

        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                seen.update(tokens(t.as_py()))
                if len(seen) >= flush:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Sizes and the listed words of a table of counts."""

    total: int
    distinct: int
    words: list[bytes]
    counts: list[int]
    rest: list[tuple[int, int]]  # of the shared classes: their counts and distinct words

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}

    @cached_property
    def tables(self):
        """Of the listed words: class, log10 of the base, log10 of the share within the class."""
        import numpy as np

        kind = np.array([k if k < CLASSES else self.shared(w) for k, w in enumerate(self.words)], np.uint16)
        base = np.log10((np.array(self.counts, float) + 1) / (self.total + self.distinct + 1))
        share = np.array([0.0 if k < CLASSES else self.share(kind[k], self.counts[k]) for k in range(len(self.words))])
        return kind, base, share

    @staticmethod
    def shared(word: bytes) -> int:
        return CLASSES + min(len(word), SHORT) - 1

    def share(self, kind: int, c: int) -> float:
        import math

        n, distinct = self.rest[kind - CLASSES]
        return math.log10((c + 1) / (n + distinct + 1))

    def class_counts(self):
        import numpy as np

        own = self.counts[:CLASSES]
        return np.array([*own, *[0] * (CLASSES - len(own)), *(n for n, _ in self.rest)], float)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """What tasks need of a written table of counts. How many words have a count (to ten significant
    bits) tells from which count on there are LISTED words at most, and these come to the driver."""
    total, distinct = counted.agg(F.sum("c"), F.count("*")).first()
    low = F.greatest(F.length(F.bin("c")) - 10, F.lit(0))
    levels = counted.withColumn("s", low).groupBy(F.expr("shiftleft(shiftright(c, s), s)").alias("c"))
    least, seen = None, 0
    for r in sorted(levels.agg(F.count("*").alias("k")).collect(), key=lambda r: -r["c"]):
        seen += r["k"]
        if seen > LISTED:
            break
        least = r["c"]
    top = sorted(((-r["c"], bytes(r["token"])) for r in counted.where(F.col("c") >= least).collect()) if least else [])
    words, of = [w for _, w in top], [-c for c, _ in top]
    # The shared classes: all words but the commonest, so sums over all less sums over those.
    n = F.least(F.length("token"), F.lit(SHORT))
    rest = [[0, 0] for _ in range(SHORT)]
    for r in counted.groupBy(n.alias("n")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():
        rest[r["n"] - 1] = [r["c"], r["k"]]
    for w, c in zip(words[:CLASSES], of):
        own = rest[min(len(w), SHORT) - 1]
        own[0] -= c
        own[1] -= 1
    return Vocabulary(total or 0, distinct, words, of, [(a, b) for a, b in rest])


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, held_out, n, known, base, share, ids, rare): class numbers of each text in order,
    what the listed words add to the sums, and the other words with how often they stand there."""
    kind = "row long, doc_id long, held_out boolean, n long, known long, base double, share double, ids binary, rare array<struct<token: binary, k: int>>"
    sent, mark = docs.sparkSession.sparkContext.broadcast((vocab.words, vocab.counts, vocab.total, vocab.distinct, vocab.rest)), uuid.uuid4().hex

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def made():
            words, of, total, distinct, rest = sent.value
            return Vocabulary(total, distinct, words, of, rest)

        v = worker_state(("markov", mark), made)
        place, (own, base, share) = v.place, v.tables
        row = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "held_out", "n", "known", "base", "share", "ids", "rare"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int32())]))]
        for b in batches:
            out, size = [], 0
            for doc_id, held, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
                row += 1
                words = tokens(text.as_py())
                at = np.array([place.get(w, -1) for w in words], np.int64)
                other = np.flatnonzero(at < 0)
                there = at[at >= 0]
                ids = np.empty(len(at), np.uint16)
                ids[at >= 0] = own[there]
                rare = [words[k] for k in other.tolist()]
                ids[other] = [v.shared(w) for w in rare]
                out.append((row, doc_id, held, len(words), len(there), float(base[there].sum()), float(share[there].sum()), ids.tobytes(), [{"token": w, "k": k} for w, k in Counter(rare).items()]))
                size += len(words)
                if size >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, kind)


@dataclass
class Model:
    """start (states), step (states x states), emit (classes x states)."""

    start: Any
    step: Any
    emit: Any


def _by_time(starts, lengths):
    """Sequences side by side, longest first: the order, how many are there at each time, and the place
    of every token, time by time."""
    import numpy as np

    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max(initial=0))
    there = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(most), "right")
    at = np.concatenate([starts[order[:n]] + t for t, n in enumerate(there.tolist())]) if most else np.zeros(0, np.int64)
    return order, there, at


def forward(m: Model, ids, starts, lengths, keep: bool = False):
    """log10 likelihood of each sequence, by the forward recursion scaled at every step; with ``keep``
    what the backward recursion needs."""
    import numpy as np

    order, there, at = _by_time(starts, lengths)
    e = m.emit[ids[at]]
    alpha, ones = (np.empty_like(e) if keep else None), np.ones(e.shape[1])
    scale, o, before = np.empty(len(at)), 0, None
    for n in there.tolist():
        a = e[o : o + n] * (m.start if before is None else before[:n] @ m.step)
        s = a @ ones
        a /= s[:, None]
        scale[o : o + n] = s
        if keep:
            alpha[o : o + n] = a
        before, o = a, o + n
    # A sequence is at the same place of every time it reaches, so its scales add up by place.
    where = np.concatenate([np.arange(n) for n in there.tolist()]) if len(there) else np.zeros(0, np.int64)
    out = np.empty(len(lengths))
    out[order] = np.bincount(where, np.log10(scale), len(lengths))
    return (out, there, at, e, alpha, scale) if keep else out


def expected(m: Model, ids, starts, lengths):
    """Expected counts of (starts, transitions, emissions by class) of sequences, and their log10 likelihood."""
    import numpy as np

    found, there, at, e, alpha, scale = forward(m, ids, starts, lengths, keep=True)
    states = len(m.start)
    moves, back, o = np.zeros((states, states)), np.ones((0, states)), len(at)
    later, o_later = 0, len(at)
    for n in there.tolist()[::-1]:
        o -= n
        beta = np.ones((n, states))
        if later:
            x = e[o_later : o_later + later] * back / scale[o_later : o_later + later, None]
            moves += alpha[o : o + later].T @ x
            beta[:later] = x @ m.step.T
            alpha[o_later : o_later + later] *= back
        back, later, o_later = beta, n, o
    if later:
        alpha[:later] *= back
    classes = ids[at]
    emits = np.stack([np.bincount(classes, alpha[:, k], len(m.emit)) for k in range(states)], 1)
    return alpha[: there[0]].sum(0) if len(there) else np.zeros(states), moves * m.step, emits, float(found.sum())


def long_forward(m: Model, ids) -> float:
    """log10 likelihood of one long sequence: transfer matrices of pieces, made side by side, then
    multiplied in order. At most SLICE tokens are in work."""
    import numpy as np

    a = m.start * m.emit[ids[0]]
    total, states = float(np.log10(a.sum())), len(m.start)
    a, at = a / a.sum(), 1
    while at < len(ids):
        part = ids[at : at + SLICE]
        at += len(part)
        full, tail = divmod(len(part), PIECE)
        grid = part[: full * PIECE].reshape(full, PIECE)
        for block in ([grid] if full else []) + ([part[full * PIECE :].reshape(1, tail)] if tail else []):
            p, logs = np.broadcast_to(np.eye(states), (len(block), states, states)).copy(), np.zeros(len(block))
            for t in range(block.shape[1]):
                p = (p.reshape(-1, states) @ m.step).reshape(p.shape) * m.emit[block[:, t]][:, None, :]
                s = p.sum((1, 2))
                p /= s[:, None, None]
                logs += np.log10(s)
            for k in range(len(block)):
                a = a @ p[k]
                s = a.sum()
                total += float(np.log10(s) + logs[k])
                a = a / s
    return total


def _slices(rows, size: int = SLICE):
    """Groups of arrays of up to ``size`` elements together."""
    held, n = [], 0
    for x in rows:
        if held and n + len(x) > size:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x)
    if held:
        yield held


def first_model(vocab: Vocabulary, states: int) -> Model:
    """States that favour different words, by a hash of word and state; a state tends to stay."""
    import numpy as np

    own = vocab.class_counts()
    share = (own + 1) / (own.sum() + len(own))
    with np.errstate(over="ignore"):
        h = splitmix(np.arange(len(own) * states, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(11)
    emit = share[:, None] * np.exp(SPREAD * (h.astype(float) / 2.0**53).reshape(len(own), states))
    return Model(np.full(states, 1 / states), np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states), emit / emit.sum(0))


def baum_welch(ids: DataFrame, m: Model, vocab: Vocabulary) -> tuple[Model, float]:
    """One round over the rows of (ids): the next model, and the log10 likelihood under this one."""
    import numpy as np

    states, size = len(m.start), len(m.emit)
    sent = ids.sparkSession.sparkContext.broadcast((m.start, m.step, m.emit))

    def run(batches):
        import pyarrow as pa

        here = Model(*sent.value)
        start, step, emit, found = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
        rows = (x[k : k + SEGMENT] for b in batches for x in (np.frombuffer(r.as_py(), np.uint16) for r in b.column("ids")) for k in range(0, len(x), SEGMENT))
        for group in _slices(rows):
            n = np.array([len(x) for x in group])
            a, b_, c, d = expected(here, np.concatenate(group), np.cumsum(n) - n, n)
            start, step, emit, found = start + a, step + b_, emit + c, found + d
        # Classes by number; below 0: the starts, the likelihood, then the transitions.
        table = np.vstack([emit, start[None], np.full((1, states), found), step])
        some = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < size, some, size - 1 - some), pa.int32()), *(pa.array(table[some, k]) for k in range(states))], names=["class", *(f"s{k}" for k in range(states))])

    kind = "class int, " + ", ".join(f"s{k} double" for k in range(states))
    got = ids.mapInArrow(run, kind).groupBy("class").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states))).collect()
    table = np.zeros((size + 2 + states, states))
    for r in got:
        table[r["class"] if r["class"] >= 0 else size - 1 - r["class"]] = r[1:]
    sent.unpersist()
    own = vocab.class_counts()
    share, prior = (own + 1) / (own.sum() + len(own)), 0.1 * size
    emit = table[:size] + prior * share[:, None]
    step, start = table[size + 2 :] + 1, table[size] + 1
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0)), float(table[size + 1, 0])


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training rows of a written table of ``encoded``."""
    m, ids = first_model(vocab, states), rows.where("not held_out").select("ids")
    for _ in range(rounds if vocab.total else 0):
        m, _ = baum_welch(ids, m, vocab)
    return m


def _scored(rows: DataFrame, m: Model) -> DataFrame:
    """The rows with ``score``, the log10 likelihood of the classes."""
    keep = ["row", "doc_id", "held_out", "n", "known", "base", "share"]
    sent = rows.sparkSession.sparkContext.broadcast((m.start, m.step, m.emit))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        here = Model(*sent.value)
        for b in batches:
            every = [np.frombuffer(r.as_py(), np.uint16) for r in b.column("ids")]
            out = np.empty(len(every))
            short = [k for k, x in enumerate(every) if len(x) <= LONG]
            done = 0
            for group in _slices(every[k] for k in short):
                n = np.array([len(x) for x in group])
                out[short[done : done + len(group)]] = forward(here, np.concatenate(group), np.cumsum(n) - n, n)
                done += len(group)
            for k, x in enumerate(every):
                if len(x) > LONG:
                    out[k] = long_forward(here, x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])

    return rows.select(*keep, "ids").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", score double")


def language_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    counted = materialize(counts(docs), "counts")
    vocab = vocabulary(counted)
    rows = materialize(encoded(docs, vocab), "encoded")
    m = train(rows, vocab, states, rounds)
    # Words that are not listed: by text and word they meet their counts.
    each = rows.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.k").join(counted, "token", "left")
    c, total = F.coalesce("c", F.lit(0)) + 1.0, vocab.total + vocab.distinct + 1
    inner = F.element_at(F.array(*(F.lit(float(n + k + 1)) for n, k in vocab.rest)), F.least(F.length("token"), F.lit(SHORT)))
    sums = each.groupBy("row").agg(F.sum(F.col("k") * F.log10(c / total)).alias("rare_base"), F.sum(F.col("k") * F.log10(c / inner)).alias("rare_share"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    none = lambda x: F.coalesce(x, F.lit(0))
    return _scored(rows, m).join(sums, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + none("rare_known")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + none("rare_base")).alias("base_score"), (F.col("score") + F.col("share") + none("rare_share")).alias("score"))
