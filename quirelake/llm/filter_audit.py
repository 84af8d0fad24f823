"""What filters of documents do to each other: every order of five filters, from one CUBE over their failure flags.

Each document is reduced to five flags, one for each filter's failure condition. Documents of one part and like flags are
counted together (32 rows a part, whatever the size of the corpus), and a CUBE over the flags and the part gives, in the
rows whose grouped flags are all false, the survivors of every subset of filters. A step of an order is then a pair of
subsets, before it and after it, so all 120 orders are joins of pairs of subsets: no order is run.

Rows by their defined results:
- A null text is an empty one: it has no words, so it fails A (under 200) and passes B, C and D.
- A null part is the empty string, and counts with it.
- E asks for a smaller doc_id with the same text. A null doc_id is neither smaller nor larger: it fails no E and makes no
  other fail it. Rows that repeat a doc_id and its text count each, with one result.
- A label counts if any row of labels for that doc_id has it; labels of null doc_ids count for none.
- No documents: no parts, so no rows. Columns beyond doc_id, text and part are never read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import with_columns_of, written

FILTERS = "ABCDE"
#: The filters' constants, stated by the contract.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def text_failures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, part) as doc_id, part, digest (of the text) and bits: 1, 2, 4, 8 for failures of A, B, C, D."""
    inner = F.btrim(F.col("t"), F.lit(SPACE))
    words = docs.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    words = words.withColumn("words", F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("t") - F.length(F.translate("t", CAPITALS, ""))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length("t"), F.col("t").rlike(SYMBOLS))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return words.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("bits"))


def counted_failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, bits (1 to 16 for failures of A to E), n, good, toxic: the documents of each part by what they fail.

    Copies are told by aggregates of (text, part), combined before they move, never by a window over the copies; the only
    joins are on doc_id and on the text's digest, both of rows that are already distinct.
    """
    rows = docs.select(*[(F.col(f"`{k}`") if k in docs.columns else F.lit(None)).cast(t).alias(name) for k, t, name in (("doc_id", "long", "doc_id"), ("text", "string", "text"), (part, "string", "part"))])
    labels = with_columns_of(labels, doc_id=T.LongType(), quality=T.LongType(), toxic=T.LongType()).filter("doc_id IS NOT NULL")
    known = labels.groupBy("doc_id").agg(*[F.max(F.when(F.col(k) == 1, 1).otherwise(0)).alias(k) for k in ("quality", "toxic")])
    # written, as both the copies' counts and their least doc_ids are taken from it: texts are read once
    one = written(text_failures(rows), "text-failures").groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    one = one.select("doc_id", "part", "digest", "bits", "n", *[(F.col("n") * F.coalesce(k, F.lit(0))).alias(name) for k, name in (("quality", "good"), ("toxic", "toxic"))])
    by_text = one.groupBy("digest", "part", "bits").agg(
        F.min("doc_id").alias("first"),
        *[F.sum(k).alias(k) for k in COUNTS],
        *[F.min_by(k, "doc_id").alias(f"first_{k}") for k in COUNTS],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(k)).otherwise(0)).alias(f"null_{k}") for k in COUNTS],
    )
    least = by_text.groupBy("digest").agg(F.min("first").alias("least"))
    leads = F.col("first").eqNullSafe(F.col("least")) & F.col("first").isNotNull()
    passes = [(F.when(leads, F.col(f"first_{k}")).otherwise(0) + F.col(f"null_{k}")).alias(f"passes_{k}") for k in COUNTS]
    both = by_text.join(least, "digest").select("part", "bits", *COUNTS, *passes).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in (*COUNTS, *[f"passes_{k}" for k in COUNTS])])
    sides = F.array(
        F.struct(F.col("bits").alias("bits"), *[F.col(f"passes_{k}").alias(k) for k in COUNTS]),
        F.struct((F.col("bits") + 16).alias("bits"), *[(F.col(k) - F.col(f"passes_{k}")).alias(k) for k in COUNTS]),
    )
    return both.select("part", F.explode(sides).alias("side")).select("part", "side.*").filter("n > 0")


def subset_survivors(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, mask, n, good, toxic: the documents that pass all filters of the subset, by CUBE; all subsets, zeros included."""
    flags = counted.select("part", *COUNTS, *[((F.col("bits").bitwiseAND(1 << i)) != 0).alias(f) for i, f in enumerate(filters)])
    cube = flags.cube("part", *filters).agg(*[F.sum(k).alias(k) for k in COUNTS], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"without_{f}") for f in filters])
    of_part = cube.filter(F.col("all_parts") == 0)
    for f in filters:
        of_part = of_part.filter((F.col(f"without_{f}") == 1) | ~F.col(f))
    mask = sum((F.when(F.col(f"without_{f}") == 0, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    some = of_part.select("part", mask.alias("mask"), *COUNTS)
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    return every.join(some, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step; see the module's head.

    part, filter_order, step, and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley as counts of
    documents in the part.
    """
    spark = docs.sparkSession
    subsets = written(subset_survivors(written(counted_failures(docs, labels, part), "audit-flags"), filters), "audit-subsets")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    whole = sum(bit.values())
    steps = [("".join(o), k + 1, o[k], bit[o[k]], sum(bit[f] for f in o[:k]), sum(bit[f] for f in o[: k + 1])) for o in permutations(filters) for k in range(len(filters))]
    # a fixed table: orders times steps
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, letter string, own int, before int, after int"))

    def at(name: str, *columns: str) -> DataFrame:
        return subsets.select("part", F.col("mask").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    pairs = at("before", *COUNTS).join(table, "before").join(at("after", *COUNTS), ["part", "after"])
    pairs = pairs.join(at("own", "n"), ["part", "own"])
    rest = pairs.withColumn("others", F.lit(whole).bitwiseXOR(F.col("own"))).join(at("others", "n"), ["part", "others"])
    every = rest.join(at("whole", "n").filter(F.col("whole") == whole), "part").join(at("none", "n").filter(F.col("none") == 0), "part")
    lost = lambda k: F.col(f"before_{k}") - F.col(f"after_{k}")
    rows = every.select(
        "part", "filter_order", "step", "letter",
        F.col("after_n").alias("kept"),
        lost("n").alias("removed"),
        (F.col("none_n") - F.col("own_n") - lost("n")).alias("redundant"),
        (F.col("others_n") - F.col("whole_n")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
    )
    rows = written(rows, "audit-steps")
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "letter"]).drop("letter")
