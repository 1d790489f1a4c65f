"""The sequenced change applier against a plain loop over arrivals."""
import collections
import datetime as dt
import math
import random
import zlib

from corpusloom.llm import common, queries, sequencer

KIND = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, n long, batch int, page string"
EPOCH = dt.datetime(1970, 1, 1)


def plain(rows):
    """rows: tuples of the first nine columns. What the contract says, arrival by arrival."""
    rows = list(dict.fromkeys(rows))
    ranks = collections.defaultdict(set)
    for r in rows:
        ranks[r[1]].add((r[2] is not None, r[2] or 0))
    ranks = {c: {s: k + 1 for k, s in enumerate(sorted(v))} for c, v in ranks.items()}
    fed = collections.defaultdict(list)
    for r in rows:
        if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 11 == 0:
            continue
        day = (r[4] - EPOCH).days + 2 * (zlib.crc32(str(r[0]).encode()) % 4)
        fed[min(8, max(1, 1 + (day - 19723) * 8 // 160))].append((day, r[0], ranks[r[1]][(r[2] is not None, r[2] or 0)], r))
    nexts, held, values, out, last = collections.defaultdict(lambda: 1), collections.defaultdict(dict), {}, [], {}

    def apply(c, batch, missed=0):
        while nexts[c] in held[c]:
            day, i, n, r = held[c].pop(nexts[c])
            cents = math.floor(100 * r[8] + 0.5) if r[8] is not None and math.isfinite(r[8]) else None
            city, old = values.get(c, (None, None))
            values[c] = {"I": (r[7], cents), "U": (r[7] if r[7] is not None else city, cents if cents is not None else old), "D": (None, None)}.get(r[3], (city, old))
            last[c] = len(out)
            out.append([i, c, "applied", batch, missed, *values[c], r[3] != "D"])
            nexts[c], missed = n + 1, 0

    seen = None
    for batch in range(1, 10):
        for c in list(held):
            while held[c] and (batch == 9 or (seen is not None and min(x[0] for x in held[c].values()) + 5 <= seen)):
                to = min(held[c])
                missed, nexts[c] = to - nexts[c], to
                apply(c, batch, missed)
        for x in sorted(fed[batch], key=lambda x: x[:3]):
            c, n = x[3][1], x[2]
            if n in held[c] or n < nexts[c]:
                out.append([x[1], c, "rejected", batch, 0, None, None, False])
            else:
                held[c][n] = x
                apply(c, batch)
        days = [x[0] for b in range(1, batch + 1) for x in fed[b]]
        seen = max(days) if days else None
    for k, r in enumerate(out):
        r[7] = r[7] and last.get(r[1]) == k
    return collections.Counter(map(tuple, out))


def got(df):
    return collections.Counter((r.change_id, r.client_id, r.status, r.batch, r.missed, r.city, r.cents, r.current) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], KIND).repartition(3)


def drawn(rng, size, clients, days=120):
    rows, seqs = [], collections.Counter()
    for k in range(size):
        c = rng.choice(clients)
        seqs[c] += rng.random() < 0.8
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * days) if rng.random() < 0.1 else k * 24 * days // size)
        rows.append((k, c, seqs[c], rng.choice("IUUUUD"), None if rng.random() < 0.02 else at, "s", "g", rng.choice([None, "Ulm", "Bern"]), rng.choice([None, round(rng.uniform(-9, 9), 2)])))
    return rows + rng.choices(rows, k=size // 20)


def test_against_plain(spark):
    rng = random.Random(1)
    rows = drawn(rng, 1500, [7] * 12 + [None] + list(range(20)))
    rows += [(9000, 3, None, "I", dt.datetime(2024, 2, 1), "s", "g", "Köln", 1.005), (9001, 3, None, "X", dt.datetime(2024, 2, 2), "s", "g", None, float("nan")),
             (None, 3, 4, "U", dt.datetime(2024, 2, 1), "s", "g", "x", 1.0), (9002, 4, 1, None, dt.datetime(1999, 2, 1), "s", "g", "a" * 70_000, float("inf")), (9003, 5, -4, "D", dt.datetime(2030, 1, 1), "s", "g", "", 0.0)]
    assert got(sequencer.apply_changes(frame(spark, rows))) == plain(rows)


def test_small_pages_and_empty_batches(spark, monkeypatch):
    # Runs over many pages, one client that is nearly all, batches without rows.
    monkeypatch.setattr(sequencer, "PAGE", 4)
    monkeypatch.setattr(sequencer, "SHELF", 2)
    rng = random.Random(2)
    rows = [r for r in drawn(rng, 900, [7] * 20 + [1, 2, 3]) if r[4] is None or not dt.datetime(2024, 2, 1) < r[4] < dt.datetime(2024, 3, 25)]
    assert got(sequencer.apply_changes(frame(spark, rows))) == plain(rows)


def test_empty(spark):
    assert sequencer.apply_changes(frame(spark, [])).count() == 0


def test_op11(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.read(spark, d, "client_changes").select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").collect()]
    first, again = queries.op11_sequenced_changes(spark, d), queries.op11_sequenced_changes(spark, d)
    assert got(first) == got(again) == plain(rows)
