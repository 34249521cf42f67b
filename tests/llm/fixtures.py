"""Small documents with every awkward case, and brute-force versions to hold operators against."""

import random

from pyspark.sql import types as T

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "to", "vu") for b in ("be", "da", "fi", "go", "hu", "ji", "ly", "pa", "que", "ré")]
#: Extra columns whose names the operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
        T.StructField("key", T.IntegerType()), T.StructField("keys", T.StringType()), T.StructField("cuts", T.StringType()),
        T.StructField("score", T.StringType()), T.StructField("class_id", T.StringType()), T.StructField("part", T.StringType()),
    ]
)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    out = [base, base, base.replace(base.split()[3], "changed", 1), base + " more", None, "", " \n\t ", "one", "two words", "two words"]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 40)}" for _ in range(6)]
    words = base.split()
    for _ in range(12):  # near copies of one text
        changed = list(words)
        changed[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(changed))
    out.append(prose(rng, 30_000))
    out.append("x" * 200_000)
    out.append("Þé漢🙂 " * 500)
    out.append("again " * 300)
    return out


def rows():
    made = [(i, t, "en", None if i == 3 else f"s{i % 3}", len(t or ""), "x", 1, "k", "c", "s", "d", "p") for i, t in enumerate(texts())]
    made.append(made[0])  # a repeated row
    made.append((None, "no id at all", None, None, None, None, None, None, None, None, None, None))
    made.append((None, *made[0][1:]))
    return made


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
