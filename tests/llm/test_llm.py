"""Operators against brute force on small fixtures, with nulls, empty, long, repeated and clashing rows."""
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from corpusloom.llm import bpe, common, licenses, neardup, packing, quality, queries, secrets, suffixdedup, tokenstore, topk, urlfilter

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, ids string, part int, n long, id long, component long"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(20_000))
TEXTS = ["", None, "one", "a b c", "a b c", "x" * 70_000, LONG, "  lead  and\n\n trail ", "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" now", "Licensed under CC BY 4.0. All rights reserved",
         "été 日本 <|endoftext|> it's", "the end " * 40, "\n".join(["same line here"] * 5), " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(58)) + " z z"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 4 == 0 else "en", "s", len(t) if t else None) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[13], (None, "a b c", "en", None, 5)]
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4) for r in rows], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path())


def ids_of(texts):
    return [e.ids for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe(spark, odd, empty):
    t = library()
    rows = bpe.round_trip_digests(odd).collect()
    want = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = ids_of([r.text])[0]
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows)) == want
    assert bpe.round_trip_digests(empty).count() == 0
    back = bpe.decode(bpe.encode(odd.where("doc_id is not null"))).collect()
    assert {r.doc_id: r.text for r in back} == {k: x or "" for k, x in enumerate(TEXTS)}


def test_token_store(odd, empty):
    rows = tokenstore.write_and_verify(odd).collect()
    order = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in order:
        ids = ids_of([r.text])[0] + [0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert tokenstore.write_and_verify(empty).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd).collect()
    n = collections.Counter()
    seqs = collections.defaultdict(list)
    ids = {r.doc_id: ids_of([r.text])[0] + [1] for r in odd.collect()}
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        n[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(r.doc_id for r in odd.collect())
    assert n == {d: len(ids[d]) * k for d, k in copies.items()}
    for s, pieces in seqs.items():
        at = 0
        for o, m in sorted(pieces):
            assert o == at
            at += m
        assert at == 2048 or s == max(seqs)
    assert packing.pack(empty).count() == 0


def test_hilbert_neighbours():
    # On the curve's start, consecutive indexes are cells one step apart.
    old = packing.BITS
    packing.BITS = 3
    try:
        p = np.stack(np.meshgrid(*[np.arange(8)] * 2, indexing="ij"), -1).reshape(-1, 2)
        o = p[np.argsort(packing.hilbert(p))]
        assert (np.abs(np.diff(o, axis=0)).sum(1) == 1).all()
    finally:
        packing.BITS = old


def test_quality(odd, empty):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) for j in range(3) if tri[w[k], w[k + 1], w[k + 2]] > 1}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)

    q = quality.quality_report(odd)
    assert q.count() == odd.count()
    for r in q.where("doc_id is not null").collect():
        b = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
    assert quality.quality_report(empty).count() == 0
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == q.where("kept").count()


def test_quality_keeps_clean(spark):
    d = common.read(spark, "/root/testdata/sf0.01", "documents")
    l = common.read(spark, "/root/testdata/sf0.01", "labels")
    r = quality.quality_report(d).join(l, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.avg(F.col("base_failed").cast("int")).alias("b")).collect()
    kept = {x.quality: (x.k, x.b) for x in r}
    assert kept[0][0] < 0.05 and kept[1][0] >= 1 - kept[1][1] - 0.02


def test_quality_junk_source(spark):
    # Sources of which 30% and 60% are junk, and one alone in its language.
    d, l = (common.read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    counts = quality.text_counts(d, "doc_id", "lang", "source").join(l, "doc_id").where(~quality.base_failed()).where("lang = 'en'").withColumn("n", F.row_number().over(Window.partitionBy("quality").orderBy("doc_id")))
    counts = common.materialize(counts.select("doc_id", "lang", "source", *(x.split()[0] for x in quality.COUNTS.split(", ")), "quality", "n"), "test")
    junk = counts.where("quality = 0").count()
    mixed = counts
    for lang, source, share in (("en", "junk30", 0.3), ("en", "junk60", 0.6), ("xx", "junk60", 0.6)):
        own = counts.where((F.col("quality") == 0) | (F.col("n") <= int(junk * (1 - share) / share))).withColumns({"lang": F.lit(lang), "source": F.lit(source)})
        mixed = mixed.unionByName(own)
    r = quality.judge(common.materialize(mixed, "test")).groupBy("lang", F.when(F.col("source").startswith("junk"), F.col("source")).alias("s"), "quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert len(r) == 8
    for x in r:
        assert x.k == 0 if x.quality == 0 else x.k >= 0.98, x


def test_near_duplicates(spark, odd, empty):
    rows = neardup.near_duplicates(odd, 2, 80).collect()
    got = {(r.doc_id, r.component_id, r.kept) for r in rows}
    assert len(rows) == odd.count()
    assert {(3, 3, True), (4, 3, False), (13, 13, True), (0, 0, True), (1, 1, True), (None, None, True)} <= got
    assert neardup.near_duplicates(empty).count() == 0
    d = common.read(spark, SF, "documents")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, neardup.near_duplicates(d, 2, 80).collect())) == sorted(c.sql(queries.OP4_SQL).fetchall())
    left = neardup.deduplicate(odd.where("doc_id is not null"), 2, 80)
    assert left.columns == odd.columns and left.count() == left.select("doc_id").distinct().count()


def test_near_duplicate_chains(spark):
    # Neighbours in the chain are similar, its ends are not: the star's centre misses most links.
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(60)]
    r = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {x.component_id for x in r} == {0}


def test_top_k(spark):
    rows = [(k, [float((k * 7 + j * 3) % 11) - 5 for j in range(6)]) for k in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, []), (None, [1.0]), (100, [9.0] * 6), (50, [float((350 + j * 3) % 11) - 5 for j in range(6)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).repartition(3)
    got = topk.top_k(df, 5, 50).collect()
    live = [(v, np.floor(256 * np.array(e + [0.0] * (6 - len(e))))) for v, e in rows if v is not None and e is not None and None not in e and np.isfinite(e).all()]
    want = collections.Counter()
    for i, (q, e) in enumerate(live):
        if q % 50 == 0:
            s = sorted((-int(e @ f), v) for j, (v, f) in enumerate(live) if j != i)[:5]
            want.update((q, k + 1, v, -x) for k, (x, v) in enumerate(s))
    assert collections.Counter(map(tuple, got)) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_suffix_dedup(spark, odd, empty):
    def brute(rows, n=50):
        first = {}
        raw = [((1 << 63) - 1 if d is None else d, d, (t or "").encode()) for d, t in rows]
        for k, _, b in raw:
            for i in range(len(b) - n + 1):
                first[b[i : i + n]] = min(k, first.get(b[i : i + n], k))
        out = []
        for k, d, b in raw:
            gone = np.zeros(len(b) + 1, bool)
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < k:
                    gone[i : i + n] = True
            out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
        return collections.Counter(out)

    rows = [(k, "ab" * (k % 70) + "lorem ipsum dolor sit " * (k % 5) + "é" * (k % 90)) for k in range(80)] + [(500, None), (501, ""), (None, "ab" * 60), (3, "ab" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collections.Counter(map(tuple, suffixdedup.repeated_bytes(df).collect())) == brute(rows)
    assert suffixdedup.repeated_bytes(empty).count() == 0
    assert suffixdedup.repeated_bytes(odd).count() == odd.count()
    assert suffixdedup.without("aé" + "b" * 5, [2], [4]) == "aébbbb"


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/de/", "http://x.com/de/", "x.com/de/", None, "http://org", "http://org/", "http://notexample.org/es/", "http://com/fr/x#y", "http://com?u=/fr/", "http://a.com/de/"] * 2
    df = spark.createDataFrame([(k // 2, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("key", F.lit("k"))
    want = collections.Counter()
    for k, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        h, p = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fit = max(((len(a + b), a + b, v) for v, a, b in rules if (h == a or h.endswith("." + a)) and p.startswith(b)), default=(0, None, "allow"))
        want[k // 2, h, p, fit[1], fit[2]] += 1
    kind = "verdict string, host string, path string"
    assert collections.Counter(map(tuple, urlfilter.judge_urls(df, spark.createDataFrame(rules, kind)).collect())) == want
    assert urlfilter.judge_urls(df.limit(0), spark.createDataFrame(rules, kind)).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(df, spark.createDataFrame([], kind)).collect()} == {"allow"}


def test_licenses(odd, empty):
    rows = {r.doc_id: r for r in licenses.license_report(odd).collect()}
    r = rows[9]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (9, 2, 2, 6, "cc-by,reserved")
    assert set(r.labels.split(",")) >= {"cc-by", "reserved"} and 0 <= r.score <= 1
    assert (rows[1].n_words, rows[1].first_word, rows[1].base_labels, rows[1].score) == (0, None, "", 0.0)
    assert licenses.license_report(empty).count() == 0 and len(licenses.rules()) > 200


def test_license_containment(spark):
    d = spark.createDataFrame([(1, "under the GNU Lesser General Public License, version 2.1 or so")], "doc_id long, text string")
    assert licenses.license_report(d).first().labels == "gpl,lgpl-2.1"
    d = spark.createDataFrame([(1, "the Simplified BSD License"), (2, "Unicode License Agreement")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.license_report(d).collect()} == {1: "bsd-2-clause", 2: "unicode"}


def license_samples(regex):
    """Texts that the rule fits: each optional part and each gap at its longest, or else left out; words apart by a line break."""
    from re import _parser as parser

    def walk(items, most, other):
        out = ""
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                out += "\n" if str(arg[0][0]) == "NEGATE" or (str(arg[0][0]) == "CATEGORY" and "SPACE" in str(arg[0][1]) and "NOT" not in str(arg[0][1])) else "x" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            elif op == "MAX_REPEAT":
                out += walk(arg[2], most, other) * (max(1, arg[0]) if most else arg[0])
            elif op == "SUBPATTERN":
                out += walk(arg[3], most, other)
            elif op == "BRANCH":
                out += walk(arg[1][-1 if other else 0], most, other)
        return out

    return {walk(parser.parse(regex), most, other) for most in (False, True) for other in (False, True)}


def test_license_gaps(spark):
    samples = [(k, label, s) for k, r, label, _ in licenses.rules() for s in license_samples(r) if re.search(r, s)]
    assert all(w in s for k, _, s in samples for w in k.split())
    rows = [(label, s) for _, label, s in samples]
    assert {label for label, _ in rows} == {label for *_, label, _ in licenses.rules()}
    texts = spark.createDataFrame([(k, f"x ;; {s.upper()} ;; y") for k, (_, s) in enumerate(rows)], "doc_id long, text string").repartition(4)
    fit = {k: {label for _, r, label, _ in licenses.rules() if re.search(r, f"x ;; {s.upper()} ;; y".lower())} for k, (_, s) in enumerate(rows)}
    for r in texts.select("doc_id", F.lower("text").alias("t")).select("doc_id", licenses.gated(F.col("t")).alias("g"), licenses.detections(F.col("t")).alias("f")).collect():
        assert r.g and {x.label for x in r.f} <= fit[r.doc_id] and r.f, rows[r.doc_id]
    lines = {1: ("GNU General\nPublic License version 3", "gpl,gpl-3"), 2: ("Creative\nCommons Attribution 4.0", "cc-by-4.0"), 3: ("the Expat  License", "mit"), 4: ("Unicode Terms\nof Use", "unicode"), 5: ("BSD 3-Clause", "bsd-3-clause"),
             6: ("Open Data\n * Commons Database License", "odbl"), 7: ("Redistribution\nand use in source and binary forms", "bsd"), 8: ("CC\u2013BY\u2013SA 4.0", "cc-by-sa-4.0")}
    got = {r.doc_id: r.labels for r in licenses.license_report(spark.createDataFrame([(k, t) for k, (t, _) in lines.items()], "doc_id long, text string")).collect()}
    assert got == {k: w for k, (_, w) in lines.items()}


def test_license_spdx(spark):
    tags = {"GPL-2.0-only": "gpl-2", "GPL-3.0-or-later": "gpl-3", "AGPL-3.0": "agpl-3", "LGPL-2.1-only": "lgpl-2.1", "LGPL-2.0": "lgpl-2", "GPL-2": "gpl-2", "Apache-2.0": "apache-2.0", "MIT": "mit", "GPL-2.07": ""}
    d = spark.createDataFrame([(k, f"# SPDX-License-Identifier: {t}\n") for k, t in enumerate(tags)], "doc_id long, text string")
    assert [r.labels for r in licenses.license_report(d).orderBy("doc_id").collect()] == list(tags.values())


def test_secrets(spark, odd, empty):
    r = secrets.scan(odd).where("is_secret").collect()
    assert [(x.doc_id, x.match) for x in r] == [(8, "0641917ea4e9feb9cda83477b57ac2654884f485")]
    done = {x.doc_id: x.text for x in secrets.redact(odd.where("doc_id is not null")).collect()}
    assert done[8] == "token = \"[SECRET]\" now" and done[6] == LONG and done[1] is None
    assert secrets.scan(empty).count() == 0


def test_secret_accuracy(spark):
    all_ = secrets.generated_findings(spark, 4000).withColumn("fold", F.pmod(F.xxhash64("candidate"), F.lit(5)))
    model = secrets.train(all_.where("fold > 0"))
    f = secrets.features(F.col("candidate"), F.col("before"), F.col("after"))
    held = all_.where("fold = 0").select("label", *(f[k].alias(k) for k in secrets.FEATURES))
    got = held.select("label", (secrets.forest_expression(model, F.col) >= 0.5).cast("int").alias("p"))
    assert got.agg(F.avg((F.col("label") == F.col("p")).cast("int"))).first()[0] > 0.95


def test_secret_assignments(spark):
    cases = [('password = "Winter2024!x"', "Winter2024!x"), ('"password": "S3cr3t!pass"', "S3cr3t!pass"), ("password: hunter2hunter", "hunter2hunter"), ("pwd=Summer2023!", "Summer2023!"), ("access_key=Ab1Cd2Ef3Gh4", "Ab1Cd2Ef3Gh4"),
             ('secret = "correct.horse.battery.staple.9"', "correct.horse.battery.staple.9"), ("password=Abcdef1234567890!tail", "Abcdef1234567890!tail"), ('token = "Ab,cd;ef12!x"', "Ab,cd;ef12!x")]
    d = spark.createDataFrame([(k, f"so the {t} is") for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert sorted((r.doc_id, r.match) for r in secrets.scan(d).where("is_secret").collect()) == [(k, m) for k, (_, m) in enumerate(cases)]
    assert {r.doc_id: r.text for r in secrets.redact(d).collect()} == {k: f"so the {t.replace(m, '[SECRET]')} is" for k, (t, m) in enumerate(cases)}
    plain = spark.createDataFrame([(k, t) for k, t in enumerate(["your password: required here", "Secret: Wonderful things", "token: available now"])], "doc_id long, text string")
    assert secrets.scan(plain).where("is_secret").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        path = common.new_path(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    want = {r.doc_id: len(ids_of([r.text])[0]) + 1 for r in docs.collect()}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == want
