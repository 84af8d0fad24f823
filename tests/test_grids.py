"""Columns from header tokens and cells between rules, against plain versions."""

import random
import statistics

from pyspark.sql import functions as F

from quirelake.operators.grids import AnchorLayout, aligned, anchored_rows, grid_cells, grid_records

LAYOUT = AnchorLayout(left=("ATA", "ZONE", "FIN", "DESCRIPTION"), right=(("VENDOR_CODE", "VENDOR"), ("PART_NUMBER", "PART"), ("SERIAL_NUMBER", "SERIAL")), row=(r"^\d{2}$", r"^\d{2,3}$"), optional=(("FIN", "^[A-Z0-9]{2,8}$"),))
WORDS = "doc long, page int, text string, left double, top double, width double, height double, conf int"


def plain_aligned(words, tokens):
    """Every choice of words, the most tokens, then the earliest words."""
    best = None

    def walk(k, at, picked):
        nonlocal best
        if k == len(tokens):
            n = sum(p is not None for p in picked)
            if best is None or n > sum(p is not None for p in best):
                best = picked
            return
        for i in range(at, len(words)):
            if words[i][1].upper().rstrip(":") == tokens[k]:
                walk(k + 1, i + 1, [*picked, words[i][0]])
        walk(k + 1, at, [*picked, None])

    walk(0, 0, [])
    return best


def test_alignment_has_the_most_tokens_in_order(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        rows.append((i, [(float(10 * k), 10.0 * k, rng.choice(["PART", "Serial:", "vendor", "NO", "PART:", "x"])) for k in range(rng.randrange(0, 7))]))
    tokens = ("VENDOR", "PART", "SERIAL")
    df = spark.createDataFrame(rows, "i long, words array<struct<left:double,center:double,text:string>>")
    for r in df.select("i", "words", aligned(F.col("words"), tokens).alias("at")).collect():
        want = plain_aligned([(w["left"], w["text"]) for w in r["words"]], tokens)
        assert sum(x is not None for x in r["at"]) == sum(x is not None for x in want), r
        assert [x for x in r["at"] if x is not None] == sorted(x for x in r["at"] if x is not None)


def plain_rows(pages):
    """{page: lines of (left, width, text)} of one document to its records."""
    anchors = {c: [] for c, _ in LAYOUT.right}
    for lines in pages.values():
        best = max((plain_aligned([(x, t) for x, _, t in line], [t for _, t in LAYOUT.right]) for line in lines), key=lambda a: sum(p is not None for p in a), default=None)
        if best and sum(p is not None for p in best) >= 2:
            for (c, _), x in zip(LAYOUT.right, best, strict=True):
                if x is not None:
                    anchors[c].append(x)
    at = {c: int(statistics.median(xs)) for c, xs in anchors.items() if xs}
    cut = min(at.values()) - 50 if at else float("inf")
    out = []
    for page, lines in pages.items():
        for line in lines:
            words = sorted(line)
            if len(words) < 2 or not (words[0][2].isdigit() and len(words[0][2]) == 2 and words[1][2].isdigit() and len(words[1][2]) in (2, 3)):
                continue
            left = [t for x, _, t in words if x < cut]
            rec = {"ATA": left[0], "ZONE": left[1], "FIN": "", **{c: [] for c, _ in LAYOUT.right}}
            more = left[2:]
            if more and more[0].isalnum() and more[0].upper() == more[0] and 2 <= len(more[0]) <= 8:
                rec["FIN"], more = more[0], more[1:]
            rec["DESCRIPTION"] = " ".join(more)
            for x, w, t in words:
                if x >= cut:
                    rec[min(at, key=lambda c: (abs(x + w / 2 - at[c]), list(at).index(c)))].append(t)
            out.append((page, *[rec[c] for c in LAYOUT.left], *[" ".join(rec[c]) for c, _ in LAYOUT.right]))
    return sorted(out)


def test_rows_of_shifted_pages_with_missing_columns(spark):
    rng = random.Random(7)
    rows, want = [], []
    for doc in range(12):
        shift, gone = rng.randrange(0, 60), rng.choice([None, "VENDOR", "PART", "SERIAL"])
        pages = {}
        for page in range(1, rng.randrange(2, 4)):
            jitter = rng.randrange(-4, 5)
            lines = [[(700.0 + 200 * i + shift + jitter, 60.0, t + rng.choice(["", ":"])) for i, t in enumerate(["VENDOR", "PART", "SERIAL"]) if t != gone]] if rng.random() < 0.8 else []
            lines.insert(0, [(10.0, 40.0, "PART"), (80.0, 20.0, "one")])
            for _ in range(5):
                line = [(20.0 + shift, 20.0, str(rng.randrange(20, 84))), (80.0 + shift, 30.0, str(rng.randrange(10, 999)))]
                if rng.random() < 0.6:
                    line.append((140.0 + shift, 40.0, f"{rng.randrange(1, 99)}HQ"))
                line += [(220.0 + shift + 90 * k, 70.0, w) for k, w in enumerate(rng.sample(["fuel", "pump", "valve", "(left)"], 3))]
                line += [(700.0 + 200 * i + shift + rng.randrange(-20, 40), 50.0, f"{c}{rng.randrange(99)}") for i, c in enumerate("VPS") if rng.random() < 0.8]
                lines.append(line)
            pages[page] = lines
            for k, line in enumerate(lines):
                rows += [(doc, page, t, x, 100.0 + 40 * k + rng.randrange(-3, 4), w, 20.0, 90) for x, w, t in line]
        want += [(doc, *r) for r in plain_rows(pages)]
    rows += [(99, 1, "24", 20.0, 10.0, 20.0, 20.0, 90), (99, 1, "100", 80.0, 10.0, 20.0, 20.0, 90), (99, 1, None, 90.0, 10.0, 20.0, 20.0, 90), (99, 1, "all", 900.0, 10.0, 20.0, 20.0, 90)]
    want.append((99, 1, "24", "100", "", "all", "", "", ""))
    df = spark.createDataFrame(rows, WORDS).repartition(4)
    got = [tuple(r)[:2] + tuple(r)[3:-1] for r in anchored_rows(df, LAYOUT, "doc", ["doc", "page"]).collect()]
    assert sorted(got) == sorted(want)
    assert anchored_rows(df.limit(0), LAYOUT, "doc", ["doc", "page"]).count() == 0


def test_words_far_from_every_column_are_loose(spark):
    layout = AnchorLayout(left=("ATA", "ZONE", "D"), right=LAYOUT.right, row=LAYOUT.row, within=0.5)
    words = [("VENDOR", 500.0), ("PART", 600.0), ("SERIAL", 700.0)]
    rows = [(1, 1, t, x, 10.0, 2.0, 20.0, 9) for t, x in words] + [(1, 1, t, x, 60.0, 2.0, 20.0, 9) for t, x in [("24", 10.0), ("100", 40.0), ("V", 520.0), ("P", 640.0), ("far", 900.0)]]
    got = anchored_rows(spark.createDataFrame(rows, WORDS), layout, "doc", ["doc", "page"]).collect()
    assert [(r["VENDOR_CODE"], r["PART_NUMBER"], r["SERIAL_NUMBER"], r["loose"]) for r in got] == [("V", "P", "", "far")]


def plain_cells(xs, ys, v, h, words):
    """Cells by trying every pair of lines."""
    def drawn(pieces, at, low, high):
        return sum(max(0, min(b, high) - max(a, low)) for p, a, b in pieces if abs(p - at) <= 8) >= 0.5 * (high - low)

    out = {}
    for t, x, y, w, hh in words:
        cx, cy = x + w / 2, y + hh / 2
        c = next((i for i in range(len(xs) - 1) if xs[i] <= cx < xs[i + 1]), None)
        r = next((i for i in range(len(ys) - 1) if ys[i] <= cy < ys[i + 1]), None)
        if c is None or r is None:
            continue
        while c and not drawn(v, xs[c], ys[r], ys[r + 1]):
            c -= 1
        while r and not drawn(h, ys[r], xs[c], xs[c + 1]):
            r -= 1
        out.setdefault((r, c), []).append((y, x, t))
    cells = {}
    for (r, c), own in out.items():
        cs = rs = 1
        while c + cs < len(xs) - 1 and not drawn(v, xs[c + cs], ys[r], ys[r + 1]):
            cs += 1
        while r + rs < len(ys) - 1 and not drawn(h, ys[r + rs], xs[c], xs[c + 1]):
            rs += 1
        cells[r, c] = (rs, cs, " ".join(t for *_, t in sorted(own)))
    return cells


def test_cells_against_brute_force(spark):
    rng = random.Random(11)
    words, rules, want = [], [], {}
    for page in range(40):
        xs = [40 + i * rng.choice([90, 120]) + 5 for i in range(rng.randrange(2, 6))]
        xs = sorted({x for x in xs})
        ys = [30 + 50 * i for i in range(rng.randrange(2, 6))]
        v = [(x + rng.choice([0, 0, 1]), a, b) for i, x in enumerate(xs) for a, b in zip(ys, ys[1:], strict=False) if i in (0, len(xs) - 1) or rng.random() < 0.75]
        h = [(y, a, b) for i, y in enumerate(ys) for a, b in zip(xs, xs[1:], strict=False) if i in (0, len(ys) - 1) or rng.random() < 0.75]
        own = [(f"w{k}", float(rng.randrange(20, xs[-1] + 40)), float(ys[0] - 30 + 50 * rng.randrange(0, len(ys) + 1) + 15), 10.0, 10.0) for k in range(14)]
        words += [(page, *w) for w in own]
        rules += [(page, "v", float(p), float(b), float(a)) for p, a, b in v] + [(page, "h", float(p), float(a), float(b)) for p, a, b in h]
        lines = lambda pieces: [min(g) if len(g) == 1 else sum(g) // len(g) for g in _runs(sorted({p for p, *_ in pieces}))]
        want |= {(page, r, c): x for (r, c), x in plain_cells(lines(v), lines(h), v, h, own).items()}
    df = spark.createDataFrame([(p, t, x, y, w, hh) for p, t, x, y, w, hh in words], "page int, text string, left double, top double, width double, height double").repartition(3)
    lines = spark.createDataFrame(rules, "page int, kind string, at double, start double, stop double")
    got = {(r["page"], r["row"], r["col"]): (r["row_span"], r["col_span"], r["text"]) for r in grid_cells(df, lines, ["page"]).collect()}
    assert got == want
    assert grid_cells(df, lines.limit(0), ["page"]).count() == 0 and grid_cells(df.limit(0), lines, ["page"]).count() == 0


def _runs(points):
    out = []
    for p in points:
        if out and p - out[-1][-1] <= 2:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def test_records_of_cells(spark):
    words = [(1, t, x, y, 10.0, 10.0) for t, x, y in [("ATA", 10.0, 5.0), ("PART", 60.0, 5.0), ("24", 10.0, 25.0), ("P", 60.0, 25.0), ("1", 75.0, 25.0), ("both", 40.0, 45.0), ("under", 60.0, 33.0)]]
    rules = [(1, "v", x, 0.0, 60.0) for x in (0.0, 100.0)] + [(1, "v", 50.0, 0.0, 40.0)] + [(1, "h", y, 0.0, 100.0) for y in (0.0, 20.0, 40.0, 60.0)]
    cells = grid_cells(spark.createDataFrame(words, "page int, text string, left double, top double, width double, height double"), spark.createDataFrame(rules, "page int, kind string, at double, start double, stop double"), ["page"])
    assert {(r["row"], r["ATA"], r["PART"]) for r in grid_records(cells, ("ATA", "PART"), ["page"]).collect()} == {(1, "24", "P 1 under"), (2, "both", "")}


def test_lines_are_not_joined_with_their_anchors(spark):
    """Anchors are told by windows; two pages' headers give a document's, a document without one has none."""
    words = [(1, 1, t, float(x), top, 40.0, 10.0) for t, x, top in (("Vendor:", 500, 0.0), ("PART", 700, 0.0), ("24", 20, 40.0), ("100", 80, 40.0), ("V1", 480, 40.0), ("P1", 730, 40.0))]
    words += [(1, 2, t, float(x), top, 40.0, 10.0) for t, x, top in (("VENDOR", 520, 0.0), ("PART:", 720, 0.0), ("25", 20, 40.0), ("101", 80, 40.0), ("P2", 700, 40.0))]
    words += [(2, 1, t, float(x), 0.0, 40.0, 10.0) for t, x in (("26", 20), ("102", 80), ("PART", 700))]
    df = spark.createDataFrame(words, "doc long, page long, text string, left double, top double, width double, height double")
    layout = AnchorLayout(left=("ATA", "ZONE", "REST"), right=(("V", "VENDOR"), ("P", "PART")), row=(r"^\d{2}$", r"^\d{3}$"))
    out = anchored_rows(df, layout, "doc", ["doc", "page"])
    assert sorted(map(tuple, out.select("doc", "page", "ATA", "ZONE", "REST", "V", "P").collect())) == [(1, 1, "24", "100", "", "V1", "P1"), (1, 2, "25", "101", "", "", "P2"), (2, 1, "26", "102", "PART", "", "")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
