"""Signatures and near misses against trying each signature on each text."""

import random

from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import detect, quality
from quirelake.plans import documents


def upper(t):
    return " ".join((t or "").upper().split())


def plain_match(docs, signatures):
    out = {}
    order = sorted(signatures, key=lambda s: (s[1], s[0]))
    for key, text in docs:
        if text is None:
            continue
        h, q = upper(text), "".join(text.split()).upper()
        hits = [(1, i) for i, s in enumerate(order) if s[2].upper() in h] or [(2, i) for i, s in enumerate(order) if len("".join(s[2].split())) >= 8 and "".join(s[2].split()).upper() in q]
        if hits:
            out[key] = min([min(hits), *([out[key]] if key in out else [])])
    return {k: (order[i][0], p) for k, (p, i) in out.items()}


def plain_near(docs, signatures, most=3):
    out = []
    for key, text in docs:
        h, best = upper(text), {}
        for v, _, s in signatures:
            words = upper(s).split()
            ratio = sum(w in h for w in words) / len(words) if len(words) >= 2 else 0
            if 0.6 <= ratio < 1:
                best[v] = max(ratio, best.get(v, 0))
        out += [(key, v, round(r, 9)) for v, r in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]]
    return sorted(map(repr, out))


def test_detection_against_plain_versions(spark):
    rng = random.Random(12)
    words = ["PART", "PARTS", "PART NO", "PA", "LIST", "LISTED", "a.b*c", "(x)", "É", "report", "STATUS LIST", "B"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    signatures = [(f"V{i % 9}", rng.randrange(5), phrase(rng.randrange(1, 4))) for i in range(25)]
    docs = [(i % 70 if i % 11 else None, rng.choice(["{}", "x {} y", "{}\n"]).format(phrase(rng.randrange(0, 6)) if rng.random() < 0.8 else " ".join(phrase(3)))) for i in range(90)] + [(200, None), (201, ""), (202, "w " * 60_000 + "STATUS LIST")]
    d = spark.createDataFrame(docs, "k long, t string").repartition(4)
    s = spark.createDataFrame(signatures, "variant string, priority int, signature string")
    got = {r["k"]: (r["variant"], r["pass"]) for r in detect.match_signatures(d, s, "k", "t").collect()}
    assert got == plain_match(docs, signatures)
    near = sorted(repr((r["k"], r["variant"], round(r["ratio"], 9))) for r in detect.near_misses(d, s, "k", "t").collect())
    assert near == plain_near(docs, signatures)
    for df in (detect.match_signatures(d, s, "k", "t"), detect.near_misses(d, s, "k", "t")):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert detect.match_signatures(d, s.limit(0), "k", "t").count() == detect.near_misses(d, s.limit(0), "k", "t").count() == 0
    empty = spark.createDataFrame([("all", 9, ""), ("part", 1, "PART")], s.schema)
    assert {r["k"]: r["variant"] for r in detect.match_signatures(d.filter("k > 199"), empty, "k", "t").collect()} == {201: "all", 202: "all"}


def test_profile_by_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(12)) for _ in range(301)] + [("c", 5), ("d", None)]
    got = {r["k"]: r for r in quality.profile(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v").collect()}
    assert set(got) == {"a", "b", "c"}
    for k, r in got.items():
        own = sorted(v for q, v in rows if q == k)
        n = len(own)
        assert (r["n"], r["median"], r["p95"], r["largest"], r["total"]) == (n, (own[(n - 1) // 2] + own[n // 2]) / 2, own[int(0.95 * n)], own[-1], sum(own))
        assert abs(r["mean"] - sum(own) / n) < 1e-9


def test_capitals_are_a_letter_for_a_letter(spark):
    wide = [chr(i) for i in range(1, 0x1FFFF) if not 0xD800 <= i <= 0xDFFF and len(chr(i).upper()) > 1]
    texts = ["", "straße", "aŉbﬁcᾳd é", "ẞ", *wide]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3).orderBy("i").select(text.capitals(F.col("t"))).collect()]
    assert got == [text.capital(t) for t in texts]
    assert got[:4] == ["", "STRAẞE", "AŉBﬁCᾼD É", "ẞ"] and all(len(g) == 1 for g in got[4:])


def test_sharp_s_is_not_two_letters(spark):
    """Words and signatures of SS, as the SQL sees them: not in ß, whose capital is a letter of its own."""
    d = spark.createDataFrame([(1, "ßh es it"), (2, "sh es it"), (3, "maße der liste")], "k long, t string")
    s = spark.createDataFrame([("V1", 1, "Sh onst, es it"), ("V2", 2, "sse der"), ("V3", 3, "ße d e f"), ("V4", 4, "Maße der")], "variant string, priority int, signature string")
    assert {(r["k"], r["variant"]): r["ratio"] for r in detect.near_misses(d, s.limit(1), "k", "t").collect()} == {(2, "V1"): 0.75}
    assert [(r["k"], r["variant"], r["pass"]) for r in detect.match_signatures(d, s, "k", "t").collect()] == [(3, "V4", 1)]
    told = d.select("k", detect.sheet_type(F.col("t"), {"HT": ["ss"], "OCCM": ["maße"]}).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in told] == ["Unknown", "Unknown", "OCCM"]


def test_short_texts_of_codes_are_codes(spark, tmp_path):
    rows = [(0, "ab"), (6, "x\ny"), (12, "long enough " * 9), (1, "a" * 60), (3, "short"), (5, "words and words " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["reason"]: r["documents"] for r in documents.unusable_texts(spark, str(tmp_path)).collect()}
    assert got == {"garbled_cid": 3, "garbled_encoding": 1, "near_blank_text": 1, "usable": 1}
