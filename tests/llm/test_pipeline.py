"""The pipeline against a version in plain Python that shares no stage code, and every stage on odd,
repeated, clashing and empty rows."""
import collections
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import common, neardup, packing, quality, queries, secrets, suffixdedup, tokenstore

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path())


def without_rejected(rows):
    table = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])})
    number = pa.array(range(len(rows)), pa.int64())
    c = duckdb.connect()
    c.register("documents", table.set_column(0, "doc_id", number))
    kept = {r[0] for r in c.sql(f"SELECT doc_id FROM ({queries.OP6_SQL}) WHERE kept").fetchall()}
    return [r for k, r in enumerate(rows) if k in kept]


def without_near_copies(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    best = {}
    for k, r in enumerate(rows):
        if r[0] is not None and sets[k]:
            best[root(k)] = min(best.get(root(k), (r[0], k)), (r[0], k))
    return [r for k, r in enumerate(rows) if r[0] is None or not sets[k] or best[root(k)][1] == k]


def without_repeats(rows, n=50):
    first, rank = {}, [(1 << 63) - 1 if r[0] is None else r[0] for r in rows]
    raw = [(r[1] or "").encode() for r in rows]
    for d, b in zip(rank, raw):
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(d, first.get(b[i : i + n], d))
    out = []
    for r, d, b in zip(rows, rank, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        text, at = "", 0
        for c in r[1] or "":
            size = len(c.encode())
            text += "" if all(gone[at : at + size]) else c
            at += size
        text = None if r[1] is None else text
        if not any(gone) or text.split():
            out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def without_secrets(spark, rows):
    d = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    spans = collections.defaultdict(list)
    for x in secrets.scan(d).where("is_secret").collect():
        spans[x.doc_id].append((x.start, x.end))
    out = []
    for k, r in enumerate(rows):
        text = r[1]
        for a, z in sorted(spans[k], reverse=True):
            text = text[:a] + "[SECRET]" + text[z:]
        out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def test_against_plain_python(spark):
    rows = [tuple(r) for r in common.read(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [r for r in rows if len(r[1]) > 600]
    passage = long[0][1][100:400]
    rows += [(5000 + k, r[1] + " new words " + str(k), *r[2:]) for k, r in enumerate(long[:6])]  # near copies
    rows += [(6000 + k, r[1][:300] + passage + r[1][300:], *r[2:]) for k, r in enumerate(long[10:20])]  # a shared passage
    rows += [rows[3], (None, long[30][1], "en", None, 1), (None, long[30][1], "en", None, 1), (7000, long[31][1] + ' token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "en", "s", 1), (7000, long[32][1] + " é" * 40, None, "s", 1), (7001, None, None, None, None), (7002, "", "en", "s", 0)]
    want = without_secrets(spark, without_repeats(without_near_copies(without_rejected(rows))))
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = common.new_path(spark, f"test{k}")
        stage(spark, docs, "here").write.parquet(path)
        docs = spark.read.parquet(path)
    got = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    # Rows that passed without a change keep the n_chars they came with until the last of the stages.
    assert collections.Counter(got) == collections.Counter(want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "here").collect()
    ids = collections.defaultdict(list)
    for r in got:
        ids[r[0]].append(library().encode(r[1] or "", add_special_tokens=False).ids + [1])
    total = collections.Counter()
    for p in pieces:
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and len(x) == p.doc_tokens for x in ids[p.doc_id])
        total[p.doc_id] += p.length
    assert total == {d: sum(map(len, x)) for d, x in ids.items()}


LONG = " ".join(f"word{k % 977}x{k}" for k in range(20_000))
CLASH = ["row", "n", "fp1", "bands", "best", "id", "begins", "ends", "block", "none", "raw", "rest", "c0", "c1", "__n_words", "n_words", "kept", "__t_lang", "__max_symbols", "__share", "part"]


@pytest.fixture(scope="module")
def odd(spark):
    good = [" ".join(f"w{k}x{j}" for j in range(70)) for k in range(5)]
    texts = ["", None, "one", "a b c", "a b c", LONG, good[0], good[0] + " more", good[1], "été 日本 " + good[2], "x" * 70_000]
    rows = [(k, t, None if k % 4 == 0 else "en", "s", len(t) if t else None) for k, t in enumerate(texts)]
    rows += [rows[3], rows[6], (None, good[3], "en", None, 5), (None, good[3], "en", None, 5), (2, good[4], "en", "s", 1), (2, "quite " + good[1][::-1], "en", "s", 1)]
    names = KIND + ", " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *(f"v{k}" for k in range(len(CLASH)))) for r in rows], names).repartition(3)


def counted(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_odd_rows(spark, odd):
    rows = [tuple(r)[:5] for r in odd.collect()]
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and counted(kept) == collections.Counter((r[0], r[1]) for r in without_rejected(rows))
    left = neardup.deduplicate(odd, 5, 80)
    assert left.columns == odd.columns and counted(left) == collections.Counter((r[0], r[1]) for r in without_near_copies(rows))
    cut = suffixdedup.remove_repeats(odd)
    assert cut.columns == odd.columns and counted(cut) == collections.Counter((r[0], r[1]) for r in without_repeats(rows))
    done = secrets.redact(odd)
    assert done.columns == odd.columns and done.count() == len(rows)
    for df in (kept, left, cut, done):
        assert all(r[c] == f"v{k}" for r in df.collect() for k, c in enumerate(CLASH))
    want = collections.Counter()
    for r in rows:
        want[r[0]] += len(library().encode(r[1] or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for p in packing.pack(odd).collect():
        got[p.doc_id] += p.length
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], KIND + ", row string, c0 int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "nowhere")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_queries_leave_only_their_result(spark):
    root = common.shared_dir(spark).removeprefix("file://") + "/corpusloom"
    for name in ("op6_quality_rules", "op9_token_store", "pipeline"):
        before = set(os.listdir(root))
        out = queries.QUERIES[name](spark, SF)
        assert len(set(os.listdir(root)) - before) == 1 and out.count() > 0, name


def test_five_thousand_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 5050):
        w = list(base)
        for at in rng.choice(120, 2 if k < 5000 else 6, replace=False):
            w[at] = f"e{k}x{at}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert all(linked(0, k) for k in range(5000)) and not any(linked(i, j) for i in range(5000, 5050) for j in range(i))
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 5, 80).collect()}
    assert got == {k: (0, k == 0) if k < 5000 else (k, True) for k, _ in rows}


def test_links_that_no_star_finds(spark):
    # Pairs within a family of texts that all look a little alike, but not like a centre.
    rng = np.random.default_rng(8)
    common_part = [f"c{k}" for k in range(80)]
    rows = []
    for k in range(120):
        own = [f"o{k}x{j}" for j in range(40)]
        for j in range(2):
            w = common_part + own
            w[int(rng.integers(85, 115))] = f"y{k}x{j}"
            rows.append((2 * k + j, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_hot_prefix_over_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    hot = "This very passage is found in nearly every document of the lot, word by word. "
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = [(k, noise(int(rng.integers(100, 300))) + hot * (k % 3) + noise(60) + ("x" * int(rng.integers(40, 200)) if k % 2 else "") + noise(30) + (hot[5:] + hot[:40] if k % 5 == 0 else "")) for k in range(300)]
    rows += [(None, hot * 2), (None, hot * 2), (7, hot + "tail" * 30)]
    for name, value in (("BLOCK_BYTES", 2000), ("PART_BYTES", 2000), ("SAMPLE", 64), ("STRETCH", 4000)):
        monkeypatch.setattr(suffixdedup, name, value)
    seen = []
    real = suffixdedup.Ranges.__init__
    monkeypatch.setattr(suffixdedup.Ranges, "__init__", lambda self, s: (real(self, s), seen.append((len(self), len(self.hot_prefixes))))[0])
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.text) for r in suffixdedup.remove_repeats(d).collect())
    assert seen[0][0] > 40 and seen[0][1] > 2
    assert got == collections.Counter((r[0], r[1]) for r in without_repeats([(*r, None, None) for r in rows]))


def test_multikey_order():
    rng = np.random.default_rng(1)
    raw = bytes(rng.choice([97, 98], 4000).astype(np.uint8)) + b"abc" * 300 + bytes(rng.integers(0, 3, 2000).astype(np.uint8))
    at = rng.integers(0, len(raw) - 90, 3000)
    size = rng.choice([50, 51, 57, 64, 80], 3000)
    order, new = suffixdedup.multikey(raw, at, size)
    strings = [raw[at[k] : at[k] + size[k]] for k in order]
    assert strings == sorted(strings, key=lambda t: (t.ljust(88, b"\0"), len(t)))
    assert new.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]


def test_order_along_the_curve(spark):
    docs = common.read(spark, SF, "documents")
    first = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(docs).where("start = 0").collect()}
    matrix, size = packing.projection(), library().get_vocab_size() + 10
    keys = {}
    for r in docs.collect():
        ids = np.array(library().encode(r.text, add_special_tokens=False).ids + [1])
        keys[r.doc_id] = int(packing.hilbert(packing.cells(ids, np.array([len(ids)]), matrix, packing.token_hashes(size)))[0])
    order = sorted(first, key=first.get)
    assert order == sorted(order, key=lambda d: (keys[d], d))


def test_token_files(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = common.read(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    out = f"file://{tmp_path}/tokens"
    tokenstore.write_tokens(docs, out, row_group_mb=1, page_kb=16)
    names = [f for f in os.listdir(tmp_path / "tokens") if f.endswith(".parquet")]
    groups = 0
    for f in names:
        m = pq.ParquetFile(tmp_path / "tokens" / f).metadata
        groups += m.num_row_groups
        for g in range(m.num_row_groups):
            cols = {m.row_group(g).column(k).path_in_schema: m.row_group(g).column(k) for k in range(m.num_columns)}
            assert "RLE_DICTIONARY" in cols["ids.list.element"].encodings
            for c in ("doc_id", "n_tokens", "local_start"):
                assert "DELTA_BINARY_PACKED" in cols[c].encodings and cols[c].has_column_index and cols[c].has_offset_index
    assert groups > len(names)
    some = tokenstore.read_tokens(spark, out).where("doc_id between 100 and 109")
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 110))
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "tokens" in x]
    assert any("doc_id" in x.split("PushedFilters: [")[1].split("]")[0] for x in scans) and all("ids" not in x.split("ReadSchema:")[1].split(">")[0] for x in scans)


def test_repeated_spans(spark):
    passage = "a passage of more than fifty bytes that stands in several of the documents, é too"
    rows = [(1, f"first {passage} end"), (2, f"{passage}{passage}"), (3, f"x {passage} y {passage[:60]} z"), (4, "short"), (5, None)]
    raw = {d: (t or "").encode() for d, t in rows}
    got = {r.doc_id: list(zip(r.begins, r.ends)) for r in suffixdedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {}
    for d, b in raw.items():
        gone = [any(b[i : i + 50] in raw[e] for e in raw if e < d for i in range(max(0, k - 49), min(k, len(b) - 50) + 1)) for k in range(len(b))]
        spans = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        if spans:
            want[d] = list(zip(spans[::2], spans[1::2]))
    assert got == want and set(got) == {2, 3}
