"""Reproducible splits, samples and the sentence generator, all from stable hashes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stats import hash32
from .locate import two_level_draws
from .ranking import number_rows, sampled_ranges

# The generator's vocabulary.
SINGULAR = "man woman boy girl student teacher doctor chef artist driver cat dog bird horse rabbit child parent friend neighbor worker player singer dancer writer reader".split()
PLURAL = "men women boys girls students teachers doctors chefs artists drivers cats dogs birds horses rabbits children parents friends neighbors workers players singers dancers writers readers".split()
PRONOUNS = "I You He She We They It".split()
MODALS = "can will must should may might would could shall".split()
BASE = "like love see hear know find take give make buy sell read write draw paint cook eat drink play watch study learn teach help call ask answer open close build create design develop understand explain remember forget enjoy hate prefer want need".split()
PAST = "liked loved seen heard known found taken given made bought sold read written drawn painted cooked eaten drunk played watched studied learned taught helped called asked answered opened closed built created designed developed understood explained remembered forgotten enjoyed hated preferred wanted needed".split()
PRESENT = "liking loving seeing hearing knowing finding taking giving making buying selling reading writing drawing painting cooking eating drinking playing watching studying learning teaching helping calling asking answering opening closing building creating designing developing understanding explaining remembering forgetting enjoying hating preferring wanting needing".split()
OBJECTS = "book pen apple car house ball computer phone music movie food water coffee tea cake picture song game toy flower tree sun moon sky sea dog cat bird fish horse answer question problem solution idea work job task project plan painting story letter message news lesson class school garden park".split()


def choice(seed: str, k: Column, n: int) -> Column:
    """A number below n from the row number and a seed."""
    return (hash32(F.concat(k.cast("string"), F.lit("/" + seed))) % n).cast("int")


def exact_split(df: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """``is_train`` for exactly int(share * n) rows, in hash order. Ranges of the hash and the
    key are the buckets of the numbering."""
    d = sampled_ranges(df.withColumn("h", hash32(F.col(key))), ["h", key], "bucket")
    ranked = number_rows(d, [], F.col("bucket"), ["h", key]).drop("bucket")
    n = df.agg(F.floor(F.count("*") * share).alias("n_train"))
    return ranked.join(F.broadcast(n)).withColumn("is_train", F.col("rn") <= F.col("n_train")).drop("n_train")


def batches(split: DataFrame, size: int = 32) -> DataFrame:
    """R2: batch numbers in hash order."""
    return split.withColumn("batch", F.floor((F.col("rn") - 1) / size))


def two_level_sample(lines: DataFrame, file: str, key: str, draws: int, seed: str = "draw") -> DataFrame:
    """For each draw a file, all alike, then a line of it, all alike, with replacement. Files have
    a row each; lines are found by counts per bucket of keys (locate.two_level_draws), so only buckets
    that are drawn are sorted."""
    sizes = lines.groupBy(file).agg(F.count("*").alias("n"))
    files = number_rows(sizes, [], F.lit(0), [file], "file_no")
    total = files.agg(F.count("*").alias("files"))
    d = lines.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(total))
    d = d.withColumn("file_no", (hash32(F.concat(F.col("draw").cast("string"), F.lit(f"/{seed}-file"))) % F.col("files")) + 1).join(files, "file_no")
    d = d.withColumn("line", (hash32(F.concat(F.col("draw").cast("string"), F.lit(f"/{seed}-line"))) % F.col("n")) + 1)
    return two_level_draws(lines, file, key, d.select("draw", file, "line")).select("draw", file, key)


def generated_sentences(spark: SparkSession, n: int) -> DataFrame:
    """(id, sentence): subject, auxiliary, verb and object by hash."""
    k = F.col("id")
    pick = lambda seed, xs: F.element_at(F.array(*map(F.lit, xs)), choice(seed, k, len(xs)) + 1)
    kind, aux, coin = choice("kind", k, 3), choice("aux", k, 4), choice("coin", k, 2)
    noun = F.when(kind == 1, pick("subject", SINGULAR)).otherwise(pick("subject", PLURAL))
    subject = F.when(kind == 0, pick("subject", PRONOUNS)).otherwise(F.concat(F.lit("The "), noun))
    third = (kind == 1) | ((kind == 0) & subject.isin("He", "She", "It"))
    first = (kind == 0) & (subject == "I")
    be = F.when(first, "am").when(third, "is").otherwise("are")
    was = F.when(first | third, "was").otherwise("were")
    verb = (F.when(aux == 0, F.concat_ws(" ", pick("modal", MODALS), pick("base", BASE)))
            .when(aux == 1, F.concat_ws(" ", F.when(coin == 0, be).otherwise(was), pick("present", PRESENT)))
            .when(aux == 2, F.concat_ws(" ", F.when(coin == 0, be).otherwise(was), pick("past", PAST)))
            .otherwise(F.concat_ws(" ", F.when(coin == 0, F.when(third, "has").otherwise("have")).otherwise("had"), pick("past", PAST))))
    return spark.range(n).select("id", F.concat_ws(" ", subject, verb, F.lit("the"), F.concat(pick("object", OBJECTS), F.lit("."))).alias("sentence"))
