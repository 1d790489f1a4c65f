"""Secrets outside the plain grammar of assignments: long blanks, other signs, URLs, PGP blocks."""
from corpusloom.llm import labelled_findings, secrets

# + a secret between « and », - a text without one; none of them is trained on.
LINES = [
    "+ password              = «hunter2hunter!9»",
    "+ passwd:\t\t\t\t\"«Winter2024!x»\"",
    "+ user => 'bob', password => '«sunny-Day_44x»'",
    "+ passphrase: «9stone&Lantern»",
    "+ {\"private_key\": \"«m4Qz8TrLw0PfYx2KcN7s»\"}",
    "+ Authorization: Bearer «qkzmwpxnvtyrlsjdhgfb»",
    "+ mongodb://admin:«S3cr3tPass»@db.internal/app",
    "+ redis://:«Hq7pLmZ2wKx»@cache:6379/0",
    "+ token := \"«zt6Lq9Rm2XwPv4Kd8Ys»\"",
    "+ credentials: «k3yHoUse!Brass»",
    "+ API_TOKEN_2024_STAGING_TOKEN=«vb6Qm2Zx9LpTr»",
    "+ secret" + " " * 300 + ":" + "\n" * 90 + "«4moons-Over9hills»",
    "- see https://example.org:8080/a@b for more",
    "- password              = required",
    "- https://user:password@host.example/",
    "- the key: everything changes in spring",
    "- Authorization: Bearer",
    "- ftp://mirror.example.org/pub/file@2",
]


def test_outside_the_grammar(spark):
    seen = {b for _, b, _, _ in labelled_findings.findings()}
    rows = [(k, x[2:].replace("«", "").replace("»", ""), x.split("«")[1].split("»")[0] if x[0] == "+" else None) for k, x in enumerate(LINES)]
    assert not seen & {v for *_, v in rows}
    d = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(3)
    found = secrets.scan(d).collect()
    texts = {k: t for k, t, _ in rows}
    for r in found:  # offsets are those of the value
        assert texts[r.doc_id][r.start : r.end] == r.match
    candidates, taken = {(r.doc_id, r.match) for r in found}, {(r.doc_id, r.match) for r in found if r.is_secret}
    want = {(k, v) for k, _, v in rows if v}
    assert want <= candidates, want - candidates
    missed, wrong = want - taken, {(k, m) for k, m in taken if rows[k][2] is None}
    print(f"recall {len(want) - len(missed)}/{len(want)}, missed {missed}, false positives {wrong}")
    assert len(missed) <= 0.1 * len(want) and not wrong
    clean = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    for k, v in want - missed:
        assert clean[k] == texts[k].replace(v, "[SECRET]")


def test_pgp_block(spark):
    key = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2.0.22 (GNU/Linux)\n\nlQOYBFabcdefGHIJKLmnop+/=\n=ab1C\n-----END PGP PRIVATE KEY BLOCK-----"
    d = spark.createDataFrame([(1, f"x {key} y"), (1, f"x {key} y"), (None, key)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.match == key, r.is_secret) for r in secrets.scan(d).collect()) == [(0, True, True), (1, True, True), (1, True, True)]
    assert sorted(r.text for r in secrets.redact(d).collect()) == ["[SECRET]", "x [SECRET] y", "x [SECRET] y"]
