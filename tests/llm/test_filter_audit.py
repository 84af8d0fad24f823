"""The filter audit against running every order, document by document."""

import re
from itertools import permutations

import pytest
from pyspark.sql import types as T

from quirelake.llm.filter_audit import audit

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n", T.StringType())])
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, labels):
    fails, counts = [], {}
    for i, text, lang, *_ in docs:
        t = text or ""
        ws = WORDS.findall(t)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)}
        good, toxic = (any(d is not None and d == i and x[k] == 1 for d, *x in labels) for k in (0, 1))
        fails.append((lang or "", {k for k, v in f.items() if v}, good, toxic))
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                counts[part, "".join(order), step] = [len(left), len(out), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in own), sum(x[2] for x in out), sum(x[3] for x in out)]
                removed_by[f] += len(out)
                gone += out
        for (p, o, s), v in counts.items():
            if p == part:
                v.append(removed_by[o[s - 1]])
    return {k: tuple(v) for k, v in counts.items()}


def result(spark, docs, labels):
    got = audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}


def text(n, distinct, extra=""):
    return " ".join(f"w{i % distinct}" for i in range(n)) + extra


def test_against_all_orders(spark):
    long, poor, loud = text(250, 250), text(250, 20), text(220, 220) + " X" * 60
    docs = [(i, t, lang, "other", "n") for i, (t, lang) in enumerate([(long, "en"), (long, "de"), (long, "en"), (poor, "en"), (poor, None), (loud, "en"), (loud + "#", ""), ("", "en"), (None, "en"), ("A B | C", "de"), (text(200, 100), "en"), (text(199, 99), "de"), (long + "\x0b\x0c *", None), ("x" * 300_000, "de"), ("   ", "en")])]
    docs += [(2, long, "en", None, None), (None, long, "fr", None, None), (None, long, "fr", None, None), (0, long, "en", None, None), (3, "new text", "en", None, None), (-1, loud, None, None, None)]
    labels = [(0, 1, 0), (0, 0, 1), (2, 1, None), (5, 1, 1), (5, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1), (9, 2, 0)]
    assert result(spark, docs, labels) == plain(docs, labels)


def test_a_third_of_the_rows_is_one_text(spark):
    docs = [(i, "same" if i % 3 == 0 else f"text {i}", "en" if i % 2 else "fr", None, None) for i in range(400)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 400, 3)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert result(spark, docs, labels) == plain(docs, labels)


@pytest.mark.parametrize("docs", [[], [(None, None, None, None, None)]])
def test_empty_and_null(spark, docs):
    assert result(spark, docs, []) == plain(docs, [])
