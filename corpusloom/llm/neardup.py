"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and
star-shaped candidate edges, confirmed on full shingle sets.

1. Rows are numbered and written. A text's distinct word shingles are hashed once; the sorted hashes
   fall into BINS bins, and the least in each is the sketch. An empty bin borrows from the first full
   bin in its own fixed random order. ROWS bins make a band, a band's value a bucket.
2. Texts with equal sets are one class from here on, named by the number of its first row (that of
   the smallest doc_id), so exact copies cost one row each.
3. Buckets with one class go. Each other bucket gives stars, not pairs: edges from a centre (its
   most typical class, then its first) to the other members. Edges are confirmed on full sets.
4. Two members of a bucket may be linked though neither is linked to a centre. So buckets that still
   hold several components are followed up without a cap: each class outside its bucket's largest
   component meets the bucket's other components, where sizes and shared shingles allow a link.
   Shingles that occur in one class only bound what that class can share, and counts of the others
   in PARTS parts bound what two classes can share. A pair is met in one of its buckets only.

Rows of a hot group (copies of one text, members of a bucket, a centre's edges) are dealt to several
tasks wherever they are joined (`skew_join`).

At similarity 0.8 a pair shares no band with probability (1 - 0.8**4)**32, about 5e-8.

Defined cases: null or wordless texts have an empty set and are linked with nothing; rows are told
apart by their number, so rows that share a doc_id are linked by their texts alone; rows with a null
doc_id are linked with nothing, have a null component and are kept; an empty table gives an empty
result; extra columns, whatever their names, are ignored by near_duplicates and passed on by
deduplicate; very long texts are one set in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialize, skew_join, splitmix, trim, worker_state
from .components import components
from .encoder import slices

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Parts of a set in which shared shingles are bounded.
PARTS = 64
#: Word hashes kept from text to text in a worker.
KNOWN_WORDS = 200_000


def shingles(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; fewer words than
    ``words`` are one shingle of their own kind."""
    import numpy as np
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = worker_state(shingles, dict)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for x in set(w).difference(known):
        known[x] = xxhash.xxh3_64_intdigest(x)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    with np.errstate(over="ignore"):
        out = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def borrow_order():
    """For each bin, all bins in the order in which it borrows from them."""
    import numpy as np

    with np.errstate(over="ignore"):
        return np.argsort(splitmix(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) + np.uint64(1 << 40)), axis=1)


def sketch(hashes, order):
    """The BINS values of one sorted set that isn't empty."""
    import numpy as np

    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(hashes, edges)
    full = np.diff(first, append=len(hashes)) > 0
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    if len(empty):
        o = order[empty]
        source[empty] = o[np.arange(len(empty)), full[o].argmax(1)]
    return hashes[first[source]]


def bands(sketches):
    """(n, BANDS) bucket values of (n, BINS) sketches."""
    import numpy as np

    s = sketches.reshape(len(sketches), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), s.shape[:2])
        for r in range(ROWS):
            out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(row, n, fp1, fp2, bands, doc_id, text and the other columns as c0, c1, ...) of every row; fp1,
    fp2 digest the set and are null without one. ``row`` holds once the result is written."""
    fields = {f.name: f for f in docs.schema.fields}
    others = [n for n in docs.columns if n not in ("doc_id", "text")]
    kind = T.StructType([*(T.StructField(n, T.LongType()) for n in ("row", "n", "fp1", "fp2")), T.StructField("bands", T.ArrayType(T.LongType())), *(T.StructField(n, fields[n].dataType) for n in ("doc_id", "text")), *(T.StructField(f"c{k}", fields[n].dataType) for k, n in enumerate(others))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        order, row = borrow_order(), TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column("text").to_pylist()
                sizes, prints, rows = [], [], np.zeros((len(texts), BINS), np.uint64)
                for k, t in enumerate(texts):
                    s = shingles(t, words)
                    sizes.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        rows[k] = sketch(s, order)
                none = np.array([p is None for p in prints])
                fp = np.frombuffer(b"".join(p or bytes(16) for p in prints), np.int64).reshape(-1, 2)
                values = bands(rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), pa.array(sizes, pa.int64()), pa.array(fp[:, 0], mask=none), pa.array(fp[:, 1], mask=none), lists, *part.columns], names=kind.names)
                row += len(texts)
        trim()

    return docs.select("doc_id", "text", *(F.col(f"`{n}`") for n in others)).mapInArrow(run, kind)


def shingle_sets(signed: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, set) of the classes ids(id), from the texts of their first rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column("text")
            for part in slices(texts):
                sets = [shingles(t, words) for t in texts[part].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("row")[part], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "set"])
        trim()

    return signed.select("row", "text").join(ids.select(F.col("id").alias("row")), "row", "left_semi").mapInArrow(run, "id long, n long, set array<long>")


def may_link(percent: int, n1: Column, c1: Column, n2: Column, c2: Column) -> Column:
    """Whether sets of n1 and n2 shingles, of which c1 and c2 can be shared, can be similar enough."""
    most = F.least(c1, c2)
    return 100 * most >= percent * (n1 + n2 - most)


def shared_counts(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, c, parts) of the classes that can have a link: c shingles are in some other class's
    set too, parts counts them by the hash's last six bits."""
    alone = (sets.select("id", F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("k"), F.min("id").alias("id"))
             .where("k = 1").groupBy("id").agg(F.collect_list("g").alias("alone")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            counts = []
            for s, x in zip(b.column("set"), b.column("alone")):
                s = np.asarray(s.values)
                s = np.setdiff1d(s, np.asarray(x.values)) if x.is_valid else s
                counts.append(np.bincount(s & (PARTS - 1), minlength=PARTS).astype(np.int32))
            c = [int(x.sum()) for x in counts]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(c, pa.int64()), pa.array(counts, pa.list_(pa.int32()))], names=["id", "n", "c", "parts"])
        trim()

    made = sets.join(alone, "id", "left").select("id", "n", "set", "alone").mapInArrow(run, "id long, n long, c long, parts array<int>")
    return made.where(100 * F.col("c") >= percent * F.col("n"))


def can_share(percent: int, n1: Column, parts1: Column, n2: Column, parts2: Column) -> Column:
    """may_link with a closer bound: what two sets share in each part is at most the smaller count."""
    most = F.aggregate(F.zip_with(parts1, parts2, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 100 * most >= percent * (n1 + n2 - most)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) whose full sets are similar enough. A centre's pairs may be
    many: a is the side that is dealt out."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("set").alias(f"{x}set"))
    sizes = materialize(pairs.groupBy("a").agg(F.count("*").alias("k")), "degrees")
    total = sizes.agg(F.sum("k")).first()[0] or 0
    ends = side("a").join(sizes.select("a"), "a", "left_semi")
    j = skew_join(pairs.join(side("b"), "b"), ends, ["a"], sizes, total, F.col("b"))
    shared = F.size(F.array_intersect("aset", "bset"))
    return j.where(100 * shared >= percent * (F.col("an") + F.col("bn") - shared)).select("a", "b")


def follow_up(rows: DataFrame, comp: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame | None:
    """Step 4: further links (a, b) between classes of buckets whose members are in several components."""
    named = rows.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = materialize(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")), "split")
    total = sizes.agg(F.sum("k")).first()[0] or 0
    split = materialize(sizes.where("lo < hi").select("bucket", "k"), "split")
    open_ = materialize(skew_join(named, split.select("bucket"), ["bucket"], split, total, F.col("id")), "open")
    if open_.isEmpty():
        return None
    total = split.agg(F.sum("k")).first()[0]
    main = open_.groupBy("bucket", "component").agg(F.count("*").alias("s")).groupBy("bucket").agg(F.max(F.struct("s", "component"))["component"].alias("main"))
    there = skew_join(open_, main, ["bucket"], split, total, F.col("id"))
    # A class is in BANDS buckets at most.
    known = open_.groupBy("id").agg(F.collect_list("bucket").alias("buckets")).join(nodes.select("id", "parts"), "id")
    there = materialize(there.join(known, "id"), "met")
    # A pair is met once, in its smallest bucket, from a class outside that bucket's largest component.
    # Both sides are plain shuffles, so that Spark splits what is skewed.
    p, q = there.where("component <> main").alias("p"), there.alias("q")
    once = (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.main")) | (F.col("p.id") < F.col("q.id")))
    here = F.array_min(F.array_intersect("p.buckets", "q.buckets")) == F.col("p.bucket")
    ok = once & may_link(percent, *map(F.col, ("p.n", "p.c", "q.n", "q.c"))) & here & can_share(percent, *map(F.col, ("p.n", "p.parts", "q.n", "q.parts")))
    pairs = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & ok).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    return materialize(confirm(materialize(pairs, "pairs"), sets, percent), "links")


def links(signed: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the classes that have links."""
    bucketed = signed.select(F.col("row").alias("id"), "bands").join(classes.select("id"), "id").select("id", F.explode("bands").alias("bucket"))
    several = materialize(bucketed.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "several")
    total = several.agg(F.sum("k")).first()[0] or 0
    met = lambda x, one: skew_join(x, one, ["bucket"], several, total, F.col("id"))
    members = materialize(met(bucketed, several.select("bucket")), "buckets")
    sets = materialize(shingle_sets(signed, members.select("id").distinct(), words), "sets")
    nodes = materialize(shared_counts(sets, percent), "nodes")

    rows = members.join(nodes.drop("parts"), "id")
    end = lambda c, x: [F.col(f"{c}.id").alias(x), F.col(f"{c}.n").alias(f"{x}n"), F.col(f"{c}.c").alias(f"{x}c")]
    me = F.struct("id", "n", "c")
    centres = rows.groupBy("bucket").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("r"), (-F.col("id")).alias("i"), me.alias("x"))).alias("typical"), F.min(me).alias("first"))
    stars = met(rows.select("bucket", "id", me.alias("me")), centres).select("me", F.explode(F.array("typical.x", "first")).alias("centre")).where("me.id <> centre.id")
    stars = stars.select(*end("centre", "a"), *end("me", "b")).where(may_link(percent, *map(F.col, ("an", "ac", "bn", "bc")))).select("a", "b").distinct()
    found = materialize(confirm(materialize(stars, "stars"), sets, percent), "links")
    comp = materialize(components(found), "components")
    more = follow_up(rows, comp, sets, nodes, percent)
    return comp if more is None or more.isEmpty() else materialize(components(found.unionByName(more)), "components")


def judged(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written rows with their signatures, and (row, doc_id, n, best) of those that take part:
    best is the smallest (doc_id, row) of the row's component."""
    signed = materialize(signatures(docs, words), "signatures")
    live = signed.where("doc_id is not null and n > 0").select("row", "doc_id", "n", "fp1", "fp2")
    classes = live.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("k"))
    classes = materialize(classes.withColumn("id", F.col("best.row")), "classes")
    comp = links(signed, classes.select("id"), words, percent)
    linked = comp.join(classes.select("id", "best"), "id")
    least = materialize(linked.groupBy("component").agg(F.min("best").alias("best"), F.count("*").alias("k")), "least")
    total = least.agg(F.sum("k")).first()[0] or 0
    mine = skew_join(comp, least.drop("k"), ["component"], least, total, F.col("id")).select("id", F.col("best").alias("theirs"))
    named = classes.join(mine, "id", "left").select("fp1", "fp2", F.coalesce("theirs", "best").alias("best"))
    total = classes.agg(F.sum("k")).first()[0] or 0
    return signed, skew_join(live, named, ["fp1", "fp2"], classes.select("fp1", "fp2", "k"), total, F.col("row")).select("row", "doc_id", "n", "best")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    signed, live = judged(docs.select("doc_id", "text"), words, percent)
    named = live.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"))
    rest = signed.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: of those with the smallest doc_id the
    first. Rows are looked up by their number, so no other row goes."""
    signed, live = judged(docs, words, percent)
    gone = materialize(live.where("row <> best.row").select("row"), "gone")
    left = signed.join(gone, "row", "left_anti")
    others = [n for n in docs.columns if n not in ("doc_id", "text")]
    held = {"doc_id": "doc_id", "text": "text"} | {n: f"c{k}" for k, n in enumerate(others)}
    return left.select(*(F.col(held[n]).alias(n) for n in docs.columns))
