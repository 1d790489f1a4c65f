"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a private key block (PGP's too); the value of an assignment to a name such as
``password`` (``=``, ``:``, ``:=`` or ``=>``, blanks of any length and quotes around it, an
authorization scheme before the value, eight characters or more); the password of a URL
(``scheme://user:password@``, four characters or more); or a run of at least LEAST key characters with
a digit in it. Its features are length, character transitions and spread, dictionary
coverage, path marks around it, and the words beside it. A random forest trained on labelled findings
gives the probability of a real secret. The trained trees are turned into one nested CASE expression,
so that scoring, like the search, is a DataFrame expression evaluated row by row: nothing is
shuffled, and the driver sees the training rows' statistics only.

Training uses ``MAX_TRAIN`` labelled findings at most (a documented bound; those of least hash);
without a table of such findings the forest is trained on findings labelled by hand
(`labelled_findings`), each counted HAND times, and on variations made by rule (`generated_findings`).

Defined cases: null and empty texts have no candidates; a null doc_id's findings carry null; candidates don't overlap, and where several
could begin the order above decides; a probability equal to the threshold is a secret; repeated rows
each give their findings; a very long text is scanned whole, in one task, in time linear in its
candidates; an empty table gives an empty result; extra columns, whatever their names, are ignored by
scan and passed on by redact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import labelled_findings
from .spans import match_spans

MAX_TRAIN, TREES, DEPTH, SEED, HAND = 20_000, 24, 7, 11, 25
CONTEXT, THRESHOLD, LEAST = 48, 0.5, 16

# Names of things to keep secret, names of things that only look so, common words.
SECRET_NAMES = "password passwd pwd pass secret token apikey api_key api-key access_key auth authorization bearer credential credentials private_key client_secret signature key".split()
PUBLIC_NAMES = "commit sha sha1 sha256 md5 checksum digest hash revision rev uuid guid id isbn issn doi version build img image src href file path url serial order invoice example sample dummy placeholder phone tel".split()
PLAIN_VALUES = "required everything available authentication something wonderful username undefined optional following different important information unknown generated reminder protected character mandatory published".split()
WORDS = "the and for that with this from have not are was you all new can has more will home about page free time site news info contact data user name example test sample key your here changeme default value string number file image index html http www com org version release build config server client local admin login public static assets lib node module package report final draft section chapter item order invoice model series".split()

KEY = "[A-Za-z0-9+/_-]"
#: Ends of names whose values are candidates. The short ones count as whole words only.
NAMED = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization|credentials?|signature|(?<![a-z])(?:pass|auth|bearer|key))"
SIGN = r"[\"']?\s*+(?>=>|:=|[=:])\s*+[\"']?(?:(?i:bearer|basic)\s++)?"
#: A match may begin with what leads to the value: from the end of a name on (a name may end a key run
#: that is a candidate itself, so it is looked back at and a run that ends in one leaves the sign), or
#: a URL's user. LEAD takes it off. The short lookarounds spare most places the long ones.
LEAD = r"^(?:[\"']?\s*(?:=>|:=|[=:])\s*[\"']?(?:(?i:bearer|basic)\s+)?|//[^:]*:)"
#: An assigned value, up to the closing quote where it is quoted, a URL's password, or else a key-like
#: run of LEAST characters or more with a digit, not inside a longer run.
CANDIDATE = (r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=:,.()\s-]{16,}?-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
             rf"|(?<=[A-Za-z])(?=[\"']?\s*+[=:])(?<={NAMED}){SIGN}(?=[^\s\"'])(?:(?<=\")[^\s\"]{{8,}}+(?=\")|(?<=')[^\s']{{8,}}+(?=')|[^\s\"',;<>]{{8,}}+)"
             r"|(?<=[A-Za-z0-9]:)//[^\s:/?#@\"'<>]*+:[^\s/?#@\"'<>]{4,}+(?=@)"
             rf"|(?<!{KEY})(?=[A-Za-z+/_-]*+[0-9]){KEY}{{{LEAST},}}+(?:(?<!{NAMED})={{1,2}})?")

FEATURES = ["length", "transitions", "spread", "digits", "upper", "hexadecimal", "dictionary", "slashes", "separators", "path", "secret_near", "public_near", "assigned", "quoted", "known_prefix", "repeats", "consonants"]


def _any(words: list[str]) -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z])"


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features of a candidate with the text before and after it."""
    n = F.length(c).cast("double")
    share = lambda p: F.length(F.regexp_replace(c, p, "")) / n  # noqa: E731  of what is left
    num = lambda b: b.cast("double")
    edge = F.right(before, F.lit(40))
    return {
        "length": n,
        "transitions": (F.length(F.regexp_replace(c, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", " ")) - n) / n,
        "spread": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[^0-9]"), "upper": share("[^A-Z]"),
        "hexadecimal": num(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(WORDS, key=len, reverse=True)), "")) / n,
        "slashes": share("[^/]"), "separators": share("[^_-]"),
        "path": num(edge.rlike(r"[/\\.?&#]$|://\S*$") | after.rlike(r"^(?:[/\\]|\.[a-z]{2,4}\b)")),
        "secret_near": num(edge.rlike(_any(SECRET_NAMES))),
        "public_near": num(edge.rlike(_any(PUBLIC_NAMES)) | after.rlike("^.{0,3}" + _any(PUBLIC_NAMES))),
        "assigned": num(edge.rlike(r"(?:[=:]|=>)\s*[\"']?(?:(?i:bearer|basic)\s+)?$")), "quoted": num(edge.rlike("[\"']$") & after.rlike("^[\"']")),
        "known_prefix": num(c.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[baprs]-|AIza|eyJ|glpat-|-----BEGIN )")),
        "repeats": share(r"(.)(?!\1)"),
        "consonants": 1 - F.length(F.regexp_replace(F.lower(c), "[bcdfghjklmnpqrstvwxz]{4,}", "")) / n,
    }


def generated_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(before, candidate, after, label): labelled findings made by rule from row numbers."""
    h = lambda k: F.md5(F.concat(F.lit(f"{SEED}-{k}-"), F.col("id").cast("string")))
    b64 = lambda k: F.translate(F.base64(F.unhex(F.concat(h(k), h(k + 1)))), "=+/", "xYz")
    digits = lambda k, most: F.substring(F.translate(F.concat(h(k), h(k + 1)), "abcdef", "918273"), F.lit(1), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most - 15)).cast("int") + 16)
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    plain = ["over", "the report with", "una parte de", "und der", "in this section", "est dans la", "left the house", ""]
    upper = F.upper(F.translate(h(3), "0123456789", "QZ2WJ4K567"))
    word = F.concat_ws("_", pick(20, WORDS), pick(21, WORDS), pick(22, WORDS), F.pmod("id", F.lit(2031)).cast("string"))
    name, public = pick(30, ["password", "token", "secret", "api_key", "client_secret", "passwd", "auth token", "passphrase", "DB_PASSWORD", "credentials"]), pick(31, ["commit", "sha256", "md5", "checksum", "digest", "uuid", "revision", "image"])
    sign = pick(32, ["=", " = \"", ": ", ":", "=\"", "='", " = ", "      = ", " => '", ":\t\t\""])
    close = F.when(sign.endswith("\""), "\"").when(sign.endswith("'"), "'").otherwise("")
    rest = F.concat(close, F.lit(" "), pick(33, plain))
    kinds = [  # before, candidate, after, label
        (F.concat(pick(1, plain), F.lit(" ")), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(F.lit(" "), pick(2, plain)), 1),
        (F.concat(pick(1, plain), F.lit(" "), name, sign), F.substring(h(5), 1, 18), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), name, sign), F.concat(h(5), F.substring(h(6), 1, 8)), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), name, sign), b64(7), rest, 1),
        (F.concat(pick(1, plain), F.lit(" ")), F.concat(pick(8, ["ghp_", "sk_live_", "xoxb-", "glpat-"]), F.substring(b64(9), 1, 36)), F.concat(F.lit(" "), pick(2, plain)), 1),
        (F.concat(name, sign), F.concat(F.substring(b64(10), 1, 12), F.lit("7!")), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), public, pick(11, [" ", ": ", "="])), F.concat(h(12), F.substring(h(13), 1, 8)), F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(pick(1, plain), F.lit(" ")), F.regexp_replace(h(14), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.lit("see https://www.example.org/files/"), word, F.lit(".html for more"), 0),
        (F.concat(pick(1, plain), F.lit(" ")), word, F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(pick(15, ["phone ", "isbn ", "order ", "tel ", "call "])), F.regexp_replace(F.substring(F.translate(h(16), "abcdef", "012345"), 1, 16), "^(.{4})(.{4})(.{4})", "$1-$2-$3-"), F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(pick(1, plain), F.lit(" ")), digits(40, 16), F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(pick(1, plain), F.lit(" ")), digits(42, 24), F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(name, sign), pick(17, ["your_password_1_here", "xxxxxxxxxxxxxxxx1234", "example_key_0000000000", "changeme_default_123", "00000000000000000000", "test_value_1111111111"]), rest, 0),
        (F.lit("img src=\"data/"), F.concat(pick(23, WORDS), F.lit("/"), pick(24, WORDS), F.lit("-"), F.substring(h(18), 1, 6), F.lit("/"), pick(25, WORDS)), F.lit(".png\" "), 0),
    ]
    short, year = pick(50, WORDS + PLAIN_VALUES), F.pmod(F.xxhash64("id", F.lit(51)), F.lit(2100)).cast("string")
    letters = F.translate(h(19), "0123456789", "ghijklmnop")
    plain_value = pick(52, PLAIN_VALUES)
    code = F.concat(pick(53, ["os.environ", "process.env.", "config.get", "request.headers.", "self._", "getpass.getpass(", "settings."]), pick(54, ["", "SECRET_KEY", "token", "password", "value"]))
    kinds += [  # assigned values without a key's look, and values that are no secrets
        (F.concat(pick(1, plain), F.lit(" "), name, sign), F.concat(F.initcap(short), year, pick(55, ["!", "x", "#", "!x"]), F.lit("7!")), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), name, sign), F.concat(pick(56, WORDS + PLAIN_VALUES), F.pmod("id", F.lit(97)).cast("string"), pick(57, WORDS + PLAIN_VALUES), pick(67, ["", "4all", "9"])), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), name, sign), F.concat(F.initcap(F.substring(letters, 1, 6)), F.substring(digits(68, 24), 1, 10), pick(69, ["!", "#", "@", "$", "%"]), F.substring(letters, 9, 4)), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), name, sign), F.concat_ws(".", pick(58, PLAIN_VALUES), pick(59, PLAIN_VALUES), pick(60, PLAIN_VALUES), F.pmod("id", F.lit(10)).cast("string")), rest, 1),
        (F.concat(pick(1, plain), F.lit(" "), name, pick(61, [": ", " = ", ": \"", ":\n"])), plain_value, F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(pick(1, plain), F.lit(" "), name, pick(70, [": ", " = ", ": \"", ":\n"])), F.initcap(plain_value), F.concat(F.lit(" "), pick(2, plain)), 0),
        (F.concat(pick(1, plain), F.lit(" "), name, pick(62, [" = ", "=", ": "])), code, pick(63, ["[\"X\"]", "()", " ", ")"]), 0),
        (F.concat(pick(1, plain), F.lit(" "), name, pick(64, [": ", "=", " = \""])), F.concat(F.lit("https://www."), pick(65, WORDS), F.lit(".org/"), pick(66, WORDS)), F.concat(F.lit(" "), pick(2, plain)), 0),
    ]
    scheme, user, host = pick(71, ["postgres", "mongodb", "redis", "amqp", "https", "ftp", "mysql"]), pick(72, ["admin", "root", "app", "deploy", "reader", ""]), pick(73, ["db.example.com/main", "10.0.0.7:5432", "localhost/", "cache:6379/0"])
    login = F.concat(pick(1, plain), F.lit(" "), scheme, F.lit("://"), user, F.lit(":"))
    kinds += [  # passwords of URLs, values after an authorization's scheme
        (login, F.concat(F.initcap(F.substring(letters, 1, 7)), F.pmod("id", F.lit(89)).cast("string"), pick(74, ["!", "", "x"])), F.concat(F.lit("@"), host), 1),
        (login, F.substring(b64(75), 1, 14), F.concat(F.lit("@"), host), 1),
        (login, pick(76, ["password", "changeme", "example", "your_password", "xxxx", "${DB_PASS}", "%s"]), F.concat(F.lit("@"), host), 0),
        (F.concat(pick(1, plain), F.lit(" "), pick(77, ["Authorization: Bearer ", "authorization: Basic ", "\"Authorization\": \"Bearer "])), F.when(F.pmod("id", F.lit(2)) == 0, F.substring(letters, 1, 22)).otherwise(b64(78)), F.concat(F.lit(" "), pick(2, plain)), 1),
    ]
    which = F.pmod("id", F.lit(len(kinds)))
    return (spark.range(0, n, 1, 1).select(F.element_at(F.array(*(F.struct(b.alias("before"), c.alias("candidate"), a.alias("after"), F.lit(y).alias("label")) for b, c, a, y in kinds)), (which + 1).cast("int")).alias("x")).select("x.*"))


def train(labelled: DataFrame):
    """A forest over at most MAX_TRAIN rows of (before, candidate, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    before, after = F.right("before", F.lit(CONTEXT)), F.left("after", F.lit(CONTEXT))
    f = features(F.col("candidate"), before, after)
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    rows = labelled.orderBy(F.xxhash64("before", "candidate", "after"), "label").limit(MAX_TRAIN).select(*(f[k].alias(k) for k in FEATURES), F.col("label").cast("double").alias("label"), weight.alias("weight")).coalesce(1)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", weightCol="weight").fit(rows)


def default_findings(spark: SparkSession) -> DataFrame:
    """(before, candidate, after, label, weight): findings labelled by hand and variations."""
    hand = spark.createDataFrame(labelled_findings.findings(), "before string, candidate string, after string, label int").withColumn("weight", F.lit(float(HAND)))
    return hand.unionByName(generated_findings(spark).withColumn("weight", F.lit(1.0)))


def forest_expression(model, value) -> Column:
    """The mean over the trees of the share of secrets in the leaf; value(name) gives a feature."""
    def node(x) -> Column:
        if x.numDescendants() == 0:
            stats = list(x.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = x.split()
        return F.when(value(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold())), node(x.leftChild())).otherwise(node(x.rightChild()))

    trees = [node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]
    total = trees[0]
    for t in trees[1:]:
        total = total + t
    return total / len(trees)


def findings(text: Column, model) -> Column:
    """array<struct<start, end, match, before, after, lead, probability>> of the candidates of a text;
    lead is what stands before the value within the pattern's match."""
    def value(x):
        v = F.regexp_replace(x["match"], LEAD, "")
        lead = F.left(x["match"], F.length(x["match"]) - F.length(v))
        return F.struct((x["start"] + F.length(lead)).alias("start"), x["end"].alias("end"), v.alias("match"), F.right(F.concat(x["before"], F.regexp_replace(lead, r"\s+", " ")), F.lit(CONTEXT)).alias("before"), x["after"].alias("after"), lead.alias("lead"))

    def scored(x):
        f = features(x["match"], x["before"], x["after"])
        return F.struct(x.alias("x"), F.struct(*(f[k].alias(k) for k in FEATURES)).alias("f"))

    c = F.transform(F.transform(match_spans(text, F.lit(CANDIDATE), CONTEXT), value), scored)
    c = F.transform(c, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["match"].alias("match"), y["x"]["before"].alias("before"), y["x"]["after"].alias("after"), y["x"]["lead"].alias("lead"), forest_expression(model, lambda k: y["f"][k]).alias("probability")))
    return F.when(text.rlike(CANDIDATE), c)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, start, end, match, probability, is_secret."""
    spark = docs.sparkSession
    model = train(labelled if labelled is not None else default_findings(spark))
    found = docs.select("doc_id", F.explode(findings(F.col("text"), model)).alias("x"))
    return found.select("doc_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.match").alias("match"), "x.probability", (F.col("x.probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by ``mark``; other texts are left as they are."""
    model = train(labelled if labelled is not None else default_findings(docs.sparkSession))
    text = F.col("text")
    shown = F.transform(findings(text, model), lambda x: F.concat(x["lead"], F.when(x["probability"] >= threshold, F.lit(mark)).otherwise(x["match"])))
    done = F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), shown, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")
    return docs.withColumn("text", F.when(text.rlike(CANDIDATE), done).otherwise(text))
