"""Trained sentence boundaries."""
import math
import random
from collections import Counter

from corpusloom.operators import boundaries as B, segment

SHORT = ["Dr.", "Mr.", "Mrs.", "Prof.", "St.", "e.g.", "i.e.", "etc.", "Inc.", "vs.", "p.m.", "approx."]
NAMES = ["Smith", "Jones", "Baker", "Lopez", "Weber", "Novak"]
NOUNS = "garden house river letter window bridge market school doctor table morning winter street".split()
VERBS = "saw left found painted crossed reached described measured".split()


def labelled(seed, n):
    """(text, its sentences): abbreviations stand before names, before words in lower case, and at ends."""
    rng = random.Random(seed)
    w, gold, gaps = lambda: rng.choice(NOUNS), [], []
    for _ in range(n):
        name, kind = rng.choice(NAMES), rng.randrange(7)
        who = f"{rng.choice(SHORT[:5])} {name}"
        gold.append([f"The {w()} {rng.choice(VERBS)} the {w()}.", f"{who} {rng.choice(VERBS)} a {w()} near the {w()}.", f"She {rng.choice(VERBS)} some things, e.g. the {w()} and the {w()}.",
                     f"They {rng.choice(VERBS)} the {w()} at five p.m.", f"A {w()} of {name} Inc. {rng.choice(VERBS)} approx. ten of them.", f"He {rng.choice(VERBS)} it, i.e. the {w()} vs. the {w()}!", f"The {w()} and the {w()} {rng.choice(VERBS)} {who}?"][kind])
        gaps.append(rng.choice([" ", "\n", "  "]))
    return "".join(s + g for s, g in zip(gold, gaps[:-1] + [""])), gold


def places(parts, text):
    at, out = 0, set()
    for p in parts:
        at = text.index(p, at) + len(p)
        out.add(at)
    return out


def test_labelled_boundaries(spark):
    train = spark.createDataFrame([(k, labelled(k, 60)[0]) for k in range(40)], "doc_id long, text string")
    held = [labelled(1000 + k, 60) for k in range(20)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(held)], "doc_id long, text string")
    model = B.train_boundaries(train)
    got = {}
    for name, d in (("plain", segment.sentences(df)), ("model", B.model_sentences(df, model))):
        hit = made = true = 0
        rows = sorted((r.doc_id, r.pos, r.sentence) for r in d.collect())
        for k, (text, gold) in enumerate(held):
            own, want = places([s for i, _, s in rows if i == k], text), places(gold, text)
            hit, made, true = hit + len(own & want), made + len(own), true + len(want)
        got[name] = hit / made, hit / true
    print(got)
    assert got["plain"][0] < 0.8 and got["model"][0] > 0.97 and got["model"][1] > 0.97
    found = {r.type for r in model.abbreviations.collect()}
    assert {"dr", "mr", "e.g", "i.e", "vs", "p.m"} <= found and not found & set(NOUNS) and "the" in {r.type for r in model.starters.collect()}


def test_scores_against_counts(spark):
    texts = [labelled(k, 30)[0] for k in range(8)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plain = lambda w: w.strip(B.MARKS)
    n, k = Counter(), Counter()
    for w in " ".join(texts).split():
        t = plain(w).rstrip(".?!").lower()
        n[t] += 1
        k[t] += plain(w).endswith(".")
    p = sum(k.values()) / sum(n.values())
    want = {}
    for t in n:
        size = len(t.replace(".", ""))
        ratio = -2 * (k[t] * math.log(p) + (n[t] - k[t]) * math.log(1 - p) - k[t] * math.log(.99) - (n[t] - k[t]) * math.log(.01))
        score = ratio * math.exp(-size) * (t.count(".") + 1) * size ** float(k[t] - n[t])
        if k[t] and score >= B.LEAST_ABBREVIATION:
            want[t] = score
    got = {r.type: r.score for r in B.train_boundaries(df).abbreviations.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in want)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "Dr. Who\tcame.  \n"), (3, "Dr. Who\tcame.  \n"), (4, "no stop at all"), (5, "word. " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = B.BoundaryModel(spark.createDataFrame([("dr", 1.0)], "type string, score double"), spark.createDataFrame([], "type string, score double"))
    got = Counter((r.doc_id, r.pos, r.sentence) for r in B.model_sentences(df, m).collect())
    assert got[(2, 0, "")] == got[(4, 0, "no stop at all")] == 1 and got[(3, 0, "Dr. Who\tcame.")] == got[(3, 1, "")] == 2
    assert sum(v for (k, _, _), v in got.items() if k == 5) == 20_001 and not any(k[0] == 1 for k in got)
    none = B.train_boundaries(df.limit(0))
    assert none.abbreviations.count() == none.starters.count() == 0
    assert B.train_boundaries(spark.createDataFrame([(1, "one. two.")], "doc_id long, text string")).starters.count() == 0


def test_texts_meet_the_model_by_their_places(spark):
    texts = ["Dr. Smith came. etc. and so on.  The end. ", "", None, "  . . Dr. Smith. Dr.", "Dr. Smith came. etc. and so on.  The end. ", "no boundary", "A!? Dr.\n\nBaker left? e.g. x."]
    df = spark.createDataFrame([(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(0, "Prof. Weber. The rest."), (0, texts[0])], "doc_id long, text string")
    known = spark.createDataFrame([(x, 1.0) for x in ("dr", "etc", "prof")], "type string, score double")
    m = B.BoundaryModel(known, spark.createDataFrame([("the", 40.0)], "type string, score double"))
    got = Counter((r.doc_id, r.pos, r.sentence) for r in B.model_sentences(df, m).collect())
    first = ["Dr. Smith came.", "etc. and so on.", "The end.", ""]
    want = [(0, first), (0, first), (4, first), (0, ["Prof. Weber.", "The rest."]), (1, [""]), (5, ["no boundary"]), (6, ["A!?", "Dr.\n\nBaker left?", "e.g.", "x."]), (None, ["  .", ".", "Dr. Smith.", "Dr."])]
    assert got == Counter((k, pos, s) for k, parts in want for pos, s in enumerate(parts))
    # Sentences are put together within their row: texts are not grouped again, and types are not dealt out.
    plan = B.model_sentences(df, m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
