"""The registry: routing against a plain version, rows of every format by hand, and a plain reader by tokens."""

import random
import re

import pytest

from quirelake.operators.catalogue import AMOS, CATALOGUE, FORMATS, SHEET_SIGNATURES
from quirelake.operators.registry import SHEETS, Format, Registry, form, many, one, opt, rest

PAD = "x" * 120
#: name: (lines, the rows' columns in their order)
ROWS = {
    "B777 Annex 8 OCCM": (["12 622A0 FAN recirculation gz-b77/2125/01/aft", "12 622A0 GZ-B77/2125/01/AFT", "x 622A0 FAN GZ/2125/01/A"], [("12", "622A0", "FAN recirculation", "21", "AFT", "GZ-B77/2125/01/AFT")]),
    "B777 Annex 7 OCCM": (["7 S231T100-1 PANEL  ASSY", "7 ab PANEL", "Ref x y"], [("7", "S231T100-1", "PANEL ASSY", "APU")]),
    "On Condition Components Report": (["24 STATIC INVERTE 1B-100 00412 X12 3-Jan-19", "R", "AB", "", "C", "84 STATIC 1B 00412 X12 3-Jan-19", "R", "24 PUMP 1B-1 3 Y1 13-Feb-20"], [("24", "STATIC INVERTERAB", "1B-100", "00412", "X12", "3-Jan-19"), ("24", "PUMP", "1B-1", "3", "Y1", "13-Feb-20")]),
    "Aircraft Components List": (["2131 P1 PUMP FUEL 60–1", "1931 P1 PUMP 60-1", "2131 P1 60-1"], [("2131", "P1", "PUMP FUEL", "60-1")]),
    "TAP Compact OCCM": (["PN1 SN1 FUEL PUMP 28 X12 05JAN2015 1200 a b", "PN1 SN1 28 X12 05JAN2015 1200", "PN1 SN1 A 05JAN2015 28 X12 05JAN2015 1200"], [("PN1", "SN1", "FUEL PUMP", "28", "X12", "05JAN2015", "1200")]),
    "TAP HT (compact)": (["PN1 SN1 FUEL PUMP 28 X12 05JAN2015 1200FH OVH 10", "PN1 SN1 PUMP 28 X-2 05JAN2015", "PAGE - 1 SN1 PUMP 28 X-2 05JAN2015", "PN1 SN1 PUMP 28 X 05JAN2015 12XX"], [("PN1", "SN1", "FUEL PUMP", "28", "X12", "05JAN2015", "1200", "OVH 10"), ("PN1", "SN1", "PUMP", "28", "X-2", "05JAN2015", "", ""), ("PN1", "SN1", "PUMP", "28", "X", "05JAN2015", "", "12XX")]),
    "Vietnam Airlines": (["FUEL PUMP P1 S1 A321 1-Jan-20 22-Feb-21 LIFE LIMIT OK", "P1 S1 A321 1-Jan-20 2-Feb-21 X OK", "PUMP P S A321 1-Jan-20 2-Feb-21 OK"], [("FUEL PUMP", "P1", "S1", "A321", "1-Jan-20", "22-Feb-21", "LIFE LIMIT", "OK"), ("PUMP", "P", "S", "A321", "1-Jan-20", "2-Feb-21", "", "OK")]),
    "Technical Object Listing": (["12345678 FUEL PUMP P1 S1 GZ-1", "Since Install 10 days 3/4/2018 x", "since inspect  none", "TOTAL 5", "TOTAL 6", "Life limit 7", "Total 8", "12345679 broken", "Since Install 9/9/2019", "12345670 VALVE P2 S2 GZ-2"], [("12345678", "FUEL PUMP", "P1", "S1", "GZ-1", "3/4/2018", "10 days 3/4/2018 x", "none", "", "", "6"), ("12345670", "VALVE", "P2", "S2", "GZ-2", "", "", "", "", "", "")]),
    "e.MES Hard Time Component Status": (["28-11-ESR OVH LRU P1 S1 FUEL PUMP 1,200 - 2020-01-01 5", "28-11 OVH LRU P1 S1 FUEL PUMP 12", "28-11 OVH LRU P1 S1 12 2020-01-01", "19-11 OVH LRU P1 S1 PUMP"], [("28", "28-11-ESR", "OVH", "LRU", "P1", "S1", "FUEL PUMP", "1,200 - 2020-01-01 5"), ("28", "28-11", "OVH", "LRU", "P1", "S1", "FUEL PUMP 12", "")]),
    "Aircraft Rotables Report": (["21-31 X1 FUEL PUMP P1 S1 01.Jan.2010 3.Feb.2011 10 20", "21-31 X1 PUMP P1 S1 3.Feb.2011 10 20", "21-31 X1 P1 S1 3.Feb.2011 10 20"], [("21-31", "X1", "FUEL PUMP", "P1", "S1", "01.Jan.2010", "3.Feb.2011", "10", "20"), ("21-31", "X1", "PUMP", "P1", "S1", "", "3.Feb.2011", "10", "20")]),
    "Aegean ERJ OCCM": ([".IEAS yb - 170-1 FUEL PUMP S1 21-31 101", "yb ton", "170-1 S1 21-31 101", "CCooddee 170-1 PUMP S1 21-31 101"], [("170-1", "FUEL PUMP", "S1", "21-31", "101")]),
    "OCCM Status (IGO)": (["28 P1 S1 FUEL PUMP X1 3‐Jan‐19 1 2 3 4", "84 P1 S1 PUMP X1 3-Jan-19 1 2 3 4", "28 P1 S1 X1 3-Jan-19 1 2 3 4"], [("28", "P1", "S1", "FUEL PUMP", "X1", "3-Jan-19", "1", "2", "3", "4")]),
    "Iberia Listado OCCM": (["21-31 X1 BOMBA DE COMB P1 S1 01/02/2010 03/04/2011 10:20 7", "21-31 X1 BOMBA P1 S1", "21-31 X1 P1 S1"], [("21-31", "X1", "BOMBA DE COMB", "P1", "S1", "01/02/2010", "03/04/2011", "10:20", "7"), ("21-31", "X1", "BOMBA", "P1", "S1", "", "", "", "")]),
    "A330 Engineering Planning OCCM": (["28 100 F1 FUEL PUMP P1 S1 3-Jan-2019 1 2 3 4 5 6 end", "28 100 F1 P1 S1 3-Jan-19 1 2 3 4 5 6", "28 100 F1 PUMP P1 S1 3-Jan-19 1 2 3 4 5"], [("28", "100", "F1", "FUEL PUMP", "P1", "S1", "3-Jan-2019", "1", "2", "3", "4", "5", "6"), ("28", "100", "F1", "", "P1", "S1", "3-Jan-19", "1", "2", "3", "4", "5", "6")]),
    "Remaining Potentials": (["345101A LH WING", "3/4/2018 PN : P1 SN : S1 FUEL PUMP", "28-11 / F1", "FH 10 20", "CY 3", "Days 4", "x y", "3/4/2018 PN: P1 SN: S1", "783203C", "", "3/4/2019 PN: P2 SN: S2"], [("345101A", "LH WING", "3/4/2018", "P1", "S1", "FUEL PUMP", "28-11 / F1", "10 20", "3", "4"), ("783203C", "", "3/4/2019", "P2", "S2", "", "", "", "", "")]),
    "OCCM List As At": (["28 FUEL PUMP 12-AB S1 LH WING 2019-01-02 10:11:12 1 2 3", "28 PUMP 12-AB S1 2019-01-02 7 8 9 1 2 3 4", "28 PUMP 12-AB S1 2019-01-02 7"], [("28", "FUEL PUMP", "12-AB", "S1", "LH WING", "2019-01-02", "10:11:12", "1", "2", "3", "", "", ""), ("28", "PUMP", "12-AB", "S1", "", "2019-01-02", "", "7", "8", "9", "1", "2", "3")]),
    "AerCap Hard Time Component Status": (["before 1-Jan-19", "2828-11-01(a) FUEL PUMP 9", "next 2-Jan-2019 due", "plain", "Name: 3-Jan-2019", "8428-11-01 X", "12 WORTH TO GO", "29AD 2019-01-02 REPAIR", "it is OVERDUE"], [("28", "28-11-01(a)", "FUEL PUMP 9"), ("28", "28-11-01(a)", "next 2-Jan-2019 due"), ("28", "28-11-01(a)", "12 WORTH TO GO"), ("29", "AD 2019-01-02", "REPAIR"), ("29", "AD 2019-01-02", "it is OVERDUE")]),
    "MSN Components Status List": (["N12345 1234 28 100 F1 FUEL PUMP 3-Jan-19 P1 S1 1.5 2 3.5 4 5 NEW e.a.s.a.", "N12345 1234 28 100 F1 3-Jan-19 P1 S1 REPAIRED", "N12345 1234 28 100 3-Jan-19 P1 S1 x y"], [("N12345", "1234", "28", "100", "F1", "FUEL PUMP", "3-Jan-19", "P1", "S1", "1.5", "2", "3.5", "4", "NEW", "E.A.S.A."), ("N12345", "1234", "28", "100", "F1", "", "3-Jan-19", "P1", "S1", "", "", "", "", "REPAIRED", "")]),
    "CONFIG SLOT OCCM": (["28-11-01 P1 S1 LH WING I1234567 FUEL PUMP 01/02/2019 1.234,5 2 3 4", "28-11-01 P1 S1 I1234567 FUEL 01/02/2019 1 2 3 4", "28-11-01 P1 S1 X I1234567 A 01-02-2019 1 2 3,456 4"], [("28-11-01", "P1", "S1", "LH WING", "I1234567", "FUEL PUMP", "01/02/2019", "1.234,5", "2", "3", "4")]),
    "CCA A340 OCCM": (["1 28 FUEL PUMP P1 S1 LEFT WING AFT CARGO 2019.01.02 ok so", "1 28 PUMP P1 S1 LEFT Aft cargo 20190102", "1 28 PUMP P1 S1 ORIGINAL", "1 28 P1 S1 ORIGINAL"], [("1", "28", "FUEL PUMP P1 S1", "LEFT", "WING", "AFT CARGO", "2019.01.02", "ok so"), ("1", "28", "PUMP", "P1", "S1", "LEFT Aft cargo", "20190102", ""), ("1", "28", "PUMP", "P1", "S1", "", "ORIGINAL", "")]),
    "Avianca OCCM": (["4 28 0 FUEL PUMP P1 S1 3-Jan-19 1,2 UNKNOWN", "ata28 P1 S1 FUEL PUMP 03.04.2019", "4 28 X1 P1 S1 3-Jan-19 1.2 3 x", "4 28 X1 P1 S1 3-Jan-19 x 3"], [("4", "28", "", "FUEL PUMP", "P1", "S1", "3-Jan-19", "1,2", "UNKNOWN"), ("", "28", "", "FUEL PUMP", "P1", "S1", "03.04.2019", "", ""), ("4", "28", "X1", "", "P1", "S1", "3-Jan-19", "1.2", "3")]),
    "Cathay OCCM": (["28 FUEL PUMP E1 P-1 S123 LH 1:00 2:00 3:00 4 5 6 3/04/2019", "28 PUMP E1 P-1 S-1 1:00 2:00 3:00 4 5 6 3-Jan-19", "28 E1 P-1 S123 LH 1:00 2:00 3:00 4 5 6 3-Jan-19"], [("28", "FUEL PUMP", "E1", "P-1", "S123", "LH", "1:00", "2:00", "3:00", "4", "5", "6", "3/04/2019"), ("28", "PUMP", "E1", "P-1", "S-1", "", "1:00", "2:00", "3:00", "4", "5", "6", "3-Jan-19")]),
    "Aircraft Inventory Report (MM_504)": (["28AB P1 S1 FUEL PUMP X:1 03-Jan-19 was new 1.5 x 10:20 y 3 4 5", "28 P1 S1 PUMP X1 03-04-2019", "28 P1 S1 X1 03-Jan-19 a b"], [("28AB", "P1", "S1", "FUEL PUMP", "X:1", "03-Jan-19", "was new", "1.5", "10:20", "3", "4"), ("28", "P1", "S1", "PUMP", "X1", "03-04-2019", "", "", "", "", "")]),
    "OCCM Inventory (SAP-ES)": (["Ubicac. x", "ECABC -ATA28-11-A FUEL PUMP P-1:M1 S1 01/02/2019", "ECABC -ATA29 PUMP P-1:M1 01/02/2019", "ECABC ATA29 PUMP P-1:M1 01/02/2019"], [("28", "ATA28-11-A", "FUEL PUMP", "P-1", "M1", "S1", "01/02/2019"), ("29", "ATA29", "PUMP", "P-1", "M1", "", "01/02/2019")]),
    "OCCM List (TAH/TAC at Install)": (["28 P1 S1 FUEL PUMP X1 3-Jan-19 1 2 3 4", "28 P1 S1 FUEL PUMP X1 See note 5 1 2 3 4", "28 P1 S1 X1 3-Jan-19 1 2 3 4", "28 P1 S1 PUMP X1 9 1 2 3 4"], [("28", "P1", "S1", "FUEL PUMP", "X1", "3-Jan-19", "1", "2", "3", "4"), ("28", "P1", "S1", "FUEL PUMP", "X1", "See note 5", "1", "2", "3", "4")]),
    "OCCM List MSN (Dot-Dated, With Condition)": (["28 P1 S1 FUEL N PUMP OH LH WING 01.02.2019 1 2 3 4", "28 P1 S1 PUMP N 01.02.2019 x 1 2 3 4", "28 P1 S1 PUMP X 01.02.2019 1 2 3 4"], [("28", "P1", "S1", "FUEL N PUMP", "OH", "LH WING", "01.02.2019", "1", "2", "3", "4"), ("28", "P1", "S1", "PUMP", "N", "", "01.02.2019", "1", "2", "3", "4")]),
    "OASES": (["241100 LH WING 12.5 P1 FUEL PUMP S1 3Jan2019 Days 1 2 3 4", "Hours x 5 6 7 8", "", "Landings 9 10 11 12", "Hours 0 0 0 0", "24110000 X1 100 P2 VALVE S2 13Jan2019 Days 1 2 3 ?", "Landings 1 2 3", "24110000 X1 P2 S2 13Jan2019 Days 1 2 3 ?"], [("241100", "LH WING", "12.5", "P1", "FUEL PUMP", "S1", "3Jan2019", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12"), ("24110000", "X1", "100", "P2", "VALVE", "S2", "13Jan2019", "1", "2", "3", "?", "", "", "", "", "", "", "", "")]),
    "Aircraft Rotables HT": (["ATA POSITION x", "28-11 X1 FUEL PUMP P1 S1 01.Jan.2010 03.Feb.2011 10 20 OVH 500 H 30 H 05.May.2020 09.Sep.2021", "28-11 X1 P1 S1 03.Feb.2011 10 20 none", "19-11 X1 PUMP P1 S1 03.Feb.2011 10 20 x y"], [("28", "X1", "FUEL PUMP", "P1", "S1", "01.Jan.2010", "03.Feb.2011", "10", "20", "OVH", "500 H", "30 H", "09.Sep.2021"), ("28", "X1", "", "P1", "S1", "", "03.Feb.2011", "10", "20", "none", "", "", "")]),
    "Aircraft Spec File OCCM": (["P0 X1 01.02.2019 10:20 5", "28 FUEL P1-1 S1 PUMP LH X1 01.02.2019 10:20 5 end", "P2 S2 X2 01.02.2019 10:20:30 6", "29 P3 S3 X3 01.02.2019 1:00 7", "VALVE S4 X4 01.02.2019 1:00 8"], [("", "", "P0", "", "", "X1", "01.02.2019", "10:20", "5"), ("28", "FUEL", "P1-1", "S1", "PUMP LH", "X1", "01.02.2019", "10:20", "5"), ("28", "FUEL", "P2", "S2", "", "X2", "01.02.2019", "10:20:30", "6"), ("29", "", "P3", "S3", "", "X3", "01.02.2019", "1:00", "7"), ("29", "", "VALVE", "S4", "", "X4", "01.02.2019", "1:00", "8")]),
    "AMOS": (["21-22 AIR CONDITIONING see below", "P1 S1 FUEL PUMP 30HQ A/C DELIVERY / 24310 03.Jan.2019 10:20 5 trail", "P1 S1 FUEL PUMP NEW / 24310 3.Jan.2019 10 5", ",RAM AIR", "32 LANDING GEAR x", "P2 S2 VALVE 11HB X/1 END 3.Jan.2019 1 2", "P2 S2 VALVE X/1 3.Jan.2019 1 2", "P2 S2 NEW / 1 3.Jan.2019 1 2", "P2 S2 11HB REL / 1 3.Jan.2019 1 2", "P3 S3 VALVE 3.Jan.2019 1 2"], [("21-22", "P1", "S1", "FUEL PUMP", "30HQ", "A/C DELIVERY / 24310", "03.Jan.2019", "10:20", "5"), ("21-22", "P1", "S1", "FUEL PUMP,RAM AIR", "", "NEW / 24310", "3.Jan.2019", "10", "5"), ("32", "P2", "S2", "VALVE", "11HB", "X/1 END", "3.Jan.2019", "1", "2"), ("32", "P2", "S2", "VALVE", "", "X/1", "3.Jan.2019", "1", "2")]),
}
ALIASES = {"Iberia Listado HT": "Iberia Listado OCCM", "AMOS HT (Aircraft Equipment List Report)": "AMOS", "Remaining Potentials (HT)": "Remaining Potentials"}


def test_rows_of_every_format(spark):
    """Each format's lines, read as that format whatever the route; another format's lines in between change nothing."""
    assert set(ROWS) | set(ALIASES) == {f.name for f in FORMATS}
    docs = [(f.name, "\r\n".join([PAD, *ROWS[ALIASES.get(f.name, f.name)][0]]), "x_apu_list.pdf", f.name) for f in FORMATS]
    routed = spark.createDataFrame(docs, "doc string, text string, file string, variant string").repartition(3)
    got: dict = {}
    for r in sorted(CATALOGUE.records(routed, "doc", file="file").collect(), key=lambda r: (r["doc"], r["line_no"])):
        assert r["variant"] == r["doc"]
        got.setdefault(r["doc"], []).append(dict(r["record"]))
    for f in FORMATS:
        want = [dict(zip(f.columns, row, strict=True)) for row in ROWS[ALIASES.get(f.name, f.name)][1]]
        assert got.get(f.name, []) == want, f.name


def plain_route(text, registry):
    """The contract's words: the sheet's tiers, then the first format with a signature and the head's aircraft."""
    head = " ".join((text or "").upper().split())
    squeezed = head.replace(" ", "")
    has = {False: lambda s: " ".join(s.upper().split()) in head, True: lambda s: len("".join(s.split())) >= 8 and "".join(s.upper().split()) in squeezed}
    family = re.search(r"A3[0-9]{2}|B7[0-9]7", head)
    sheet = None
    for tier in (lambda s: registry.sheets.get(s, ()), lambda s: [x for f in registry.of(s) for x in f.signatures]):
        for squeeze in (False, True):
            sheet = sheet or next((s for s in SHEETS if any(has[squeeze](x) for x in tier(s))), None)
    if not sheet:
        return "Unknown", "Unknown"
    for squeeze in (False, True):
        for f in registry.of(sheet):
            if any(has[squeeze](x) for x in f.signatures) and (not f.aircraft or not family or re.search(f.aircraft, family[0])):
                return sheet, f.name
    return sheet, "Unknown"


def test_routes_against_the_plain_version(spark):
    rng = random.Random(3)
    pieces = [s for f in FORMATS for s in f.signatures] + [s for own in SHEET_SIGNATURES.values() for s in own]
    texts = [None, "", "A340", "OCCM", "nothing of note " * 10]
    for _ in range(220):
        own = [rng.choice(pieces) for _ in range(rng.randrange(1, 3))]
        own = [" ".join(x) if rng.random() < 0.15 else x.lower() if rng.random() < 0.3 else x for x in own]
        texts.append(rng.choice(["", "A340 report\n", "TYPE: B777-300\n", "Aircraft A321\n"]) + rng.choice([" ", "\n", "  "]).join(own) + " tail")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(4)
    got = {r["doc"]: (r["sheet_type"], r["variant"]) for r in CATALOGUE.route(docs).collect()}
    wrong = {i: (t, got[i], plain_route(t, CATALOGUE)) for i, t in enumerate(texts) if got[i] != plain_route(t, CATALOGUE)}
    assert not wrong, list(wrong.values())[:3]
    why = {r["doc"]: r["diagnosis"] for r in CATALOGUE.route(docs).collect()}
    assert why[0] == why[1] == "no_text_layer" and why[4] == "no_signature_match" and why[3] is None


def test_an_aircraft_that_does_not_fit_moves_on_to_the_next_format(spark):
    rows = (form(one("A"), rest()),)
    registry = Registry((Format("first", "OCCM", ("LIST",), ("A",), rows, aircraft="(?i)A340"), Format("second", "OCCM", ("LIST",), ("A",), rows)), {"OCCM": ("LIST",)})
    docs = spark.createDataFrame([(1, "LIST A340-300"), (2, "LIST A321"), (3, "LIST"), (4, "L I S T")], "doc long, text string")
    assert {r["doc"]: r["variant"] for r in registry.route(docs).collect()} == {1: "first", 2: "second", 3: "first", 4: "Unknown"}


def test_only_documents_of_formats_with_state_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "x")], "doc long, text string")
    stateless = Registry(tuple(f for f in FORMATS if not f.stateful), SHEET_SIGNATURES)
    plan = stateless.records(stateless.route(docs), "doc")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Window|Python|Join", plan)
    whole = CATALOGUE.records(CATALOGUE.route(docs), "doc")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Join|Cartesian", whole)


def test_nulls_empty_long_and_repeated(spark):
    row = "P1 S1 FUEL PUMP NEW / 24310 3.Jan.2019 10 5"
    text = "AMOS " + PAD + "\n" + "\n".join([row] * 3000) + "\n" + "w " * 50_000
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (None, "AMOS " + PAD + "\n" + row, 5)], "doc long, text string, line_no int")
    got = CATALOGUE.records(CATALOGUE.route(docs), "doc").groupBy("doc").count().collect()
    assert {r["doc"]: r["count"] for r in got} == {1: 3000, None: 1}
    assert CATALOGUE.records(CATALOGUE.route(docs.limit(0)), "doc").count() == 0


@pytest.mark.parametrize("f", [f for f in FORMATS if f.forms], ids=lambda f: f.name)
def test_declarations_name_their_groups(f):
    for x in f.forms:
        names = [n for p in x.parts for n in p.names]
        assert len(names) == len(set(names)) and set(names) <= set(f.columns)
        assert re.compile(re.sub(r"\\p\{L\}", "A-Za-z", x.pattern)).groups == len(names)
    assert AMOS.stateful and opt("A").names == ("A",) and many("B", lazy=True).pattern.endswith("?)")


def test_a_signature_is_looked_for_once(spark):
    """In the whole of a plan that routes, each signature stands once for each form that it can have in a head."""
    docs = spark.createDataFrame([(1, "x")], "doc long, text string")
    plan = CATALOGUE.route(docs)._jdf.queryExecution().optimizedPlan().toString()
    own = {" ".join(s.upper().split()) for f in FORMATS for s in f.signatures if len("".join(s.split())) >= 8 and " " in s.strip()}
    assert len(own) > 60
    for s in own:
        assert plan.count(f", {s})") == plan.count(f", {''.join(s.split())})") == 1, s
