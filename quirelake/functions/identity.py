"""Identity from noisy names: aircraft keys, families, serial numbers and registrations of document headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import LINE_END, blank, joined_letters

# Fixed patterns of file names, tried in the order of aircraft_key().
LABELLED = r"(?i)(?:^|[^A-Z0-9])MSN[ _\-]?(\d{3,5})(?=[^\d]|$)"
LEADING = r"^(\d{3,5})[_ -]"
REGISTRATION = (
    r"(?i)(?:^|[^A-Z0-9])(VN-A\d{3,4}|VP-[A-Z]{3}|VQ-[A-Z]{3}|EC-[A-Z]{3}|E[0-9]-[A-Z]{3}|HZ-[A-Z]{3}|HL\d{4}|B-\d{3,4}|D-[A-Z]{4}"
    r"|[0-9][A-Z]-[A-Z0-9]{3,5}|N\d{1,5}[A-Z]{0,2}|[A-Z]{1,2}-[A-Z0-9]{3,5})(?=[^A-Z0-9]|$)"
)
COMPRESSED = r"(?i)^(CS|EI|OO|PH|OE|OY|LX|SE|LN|OH|SX|SP|OK|HA|YR|TC|9H|9A|EC)([A-Z0-9]{3})(?=[_ .])"
BARE = r"(?i)(?:^|[^A-Z0-9])(\d{4,5})(?=[^\d]|$)"

#: Sources of a key that identify an airframe for certain.
STRONG_SOURCES = ("override", "header_msn", "header_registration", "manual", "msn", "msn_prefix", "registration", "registration_compressed")


def is_year(n: Column) -> Column:
    return (F.length(n) == 4) & n.between("1990", "2030")


def is_one_digit(n: Column) -> Column:
    """All digits the same, as of fillers."""
    return n.rlike(r"^(\d)\1*$")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _keyed(key: Column, source: str) -> Column:
    return F.when(key.isNotNull(), F.struct(key.alias("key"), F.lit(source).alias("source")))


def aircraft_key(filename: Column) -> Column:
    """struct(key, source) of a file name: the first rung of the ladder that holds."""
    name = blank(filename)
    leading = _found(name, LEADING)
    short = F.concat_ws("-", _found(name, COMPRESSED, 1), _found(name, COMPRESSED, 2))
    bare = F.get(F.filter(F.regexp_extract_all(name, F.lit(BARE), F.lit(1)), lambda n: ~is_year(n) & ~is_one_digit(n)), 0)
    return F.coalesce(
        _keyed(_found(name, LABELLED), "msn"),
        _keyed(F.when(~is_year(leading), leading), "msn_prefix"),
        _keyed(F.upper(_found(name, REGISTRATION)), "registration"),
        _keyed(F.when(name.rlike(COMPRESSED), F.upper(short)), "registration_compressed"),
        _keyed(bare, "msn_guess"),
        F.struct(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("key"), F.lit("filename").alias("source")),
    )


def preferred_key(filename: Column, override: Column, msn: Column, registration: Column) -> Column:
    """struct(key, source): an override, else the header's serial number, its registration, then the file name."""
    given = lambda c: F.nullif(F.trim(blank(c)), F.lit(""))
    return F.coalesce(_keyed(given(override), "override"), _keyed(given(msn), "header_msn"), _keyed(given(registration), "header_registration"), aircraft_key(filename))


# Fixed patterns of models.
MODEL_LINE = r"(?i)(MODEL|TYPE|M\s?O\s?D\s?E\s?L|A\s?/\s?C\s*:|\bAIRCRAFT\b|\bBOEING\b)"
TAIL = r"\b(N\d{1,5}[A-Z]{0,2}|[A-Z]{1,2}-[A-Z]{2,5}|[A-Z]{2}-[A-Z0-9]{3,4})\b"
AIRBUS = r"\bA?3(18|19|20|21|30|40|50|80)\b"
AIRBUS_LETTER = r"\bA3(18|19|20|21|30|40|50|80)\b"
BOEING = r"\bB?7(37|47|57|67|77|87)\b"
BOEING_DASH = r"\bB?7(37|47|57|67|77|87)-[0-9]{1,3}(?![0-9])[0-9A-Z]{0,5}(?:[^A-Z0-9]|$)"
BOEING_LETTER = r"\bB7(37|47|57|67|77|87)\b"
EMBRAER = r"(?i)\b(ERJ\s?1[79]0|E1[79]0|EMB[- ]?1[79]\d)\b"
# Families of the model numbers.
AIRBUS_FAMILIES = {"18": "A320 family", "19": "A320 family", "20": "A320 family", "21": "A320 family", "30": "A330", "40": "A340", "50": "A350", "80": "A380"}


def _airbus(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in AIRBUS_FAMILIES.items() for x in pair]), F.regexp_extract(c, pattern, 1))


def _family(c: Column, tiers: list[tuple[str, str]], sure: str) -> Column:
    found = []
    for kind, pattern in tiers:
        name = {"airbus": _airbus(c, pattern), "boeing": F.concat(F.lit("B7"), F.regexp_extract(c, pattern, 1)), "embraer": F.lit("Embraer")}[kind]
        model = F.regexp_extract(c, pattern, 0)
        found.append(F.when(c.rlike(pattern), F.struct(name.alias("family"), model.alias("model"), F.lit(sure).alias("confidence"))))
    return F.coalesce(*found)


def plain_lines(text: Column, n: int | None = None) -> Column:
    """A header's lines, letter-spaced words joined; n: the first ones only."""
    lines = F.split(blank(text), LINE_END)
    return F.transform(F.slice(lines, 1, n) if n else lines, joined_letters)


def family(text: Column) -> Column:
    """struct(family, model, confidence) of a header: model lines first, registrations masked, then sure tokens anywhere."""
    masked = F.transform(plain_lines(text), lambda x: F.struct(x.rlike(MODEL_LINE).alias("names"), F.regexp_replace(x, TAIL, " ").alias("text")))
    tiers = [("airbus", AIRBUS), ("boeing", BOEING), ("embraer", EMBRAER)]
    of_lines = F.transform(F.filter(masked, lambda x: x["names"]), lambda x: _family(x["text"], tiers, "high"))
    named = F.get(F.filter(of_lines, lambda f: f.isNotNull()), 0)
    anywhere = [("airbus", AIRBUS_LETTER), ("boeing", BOEING_DASH), ("boeing", BOEING_LETTER), ("embraer", EMBRAER)]
    loose = _family(F.array_join(F.transform(masked, lambda x: x["text"]), "\n"), anywhere, "medium")
    return F.coalesce(named, loose, F.struct(F.lit("Unknown").alias("family"), F.lit("").alias("model"), F.lit("none").alias("confidence")))


# Fixed patterns: labels of serial numbers and registrations, a serial number, words of lines that head columns.
MSN_LABEL = r"(?i)(?:MSN|SERIAL\s*(?:NUMBER|NO|#)?|S\s?/\s?N|S\s?E\s?R\s?I\s?A\s?L)\s*[:#.]?\s*"
MSN_VALUE = r"\b(\d{3,6})\b"
REG_LABEL = r"(?i)(?:A\s*/?\s*C\s*)?REG(?:ISTRATION)?\s*[:.]?\s*"
COLUMN_HEADS = r"(?i)\b(PART|SERIAL|DESCRIPTION|ATA|REPORT)\b"
#: Lines of a header that may name the airframe.
HEADER_LINES = 12


def _after(lines: Column, label: str, value: str) -> Column:
    """The first value behind the first label of a line that has both; null if none has."""
    found = F.transform(F.filter(lines, lambda x: x.rlike(label)), lambda x: F.regexp_extract(F.regexp_extract(x, f"{label}(.*)", 1), value, 1))
    return F.get(F.filter(found, lambda v: v != ""), 0)


def header_msn(text: Column) -> Column:
    """The labelled serial number of the first twelve lines, or empty."""
    return F.coalesce(_after(plain_lines(text, HEADER_LINES), MSN_LABEL, MSN_VALUE), F.lit(""))


def header_registration(text: Column) -> Column:
    """The labelled registration of the first twelve lines, else the first one on a line that heads no columns; upper case."""
    lines = plain_lines(text, HEADER_LINES)
    loose = F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(TAIL) & ~x.rlike(COLUMN_HEADS)), 0), TAIL, 1)
    return F.upper(F.coalesce(_after(lines, REG_LABEL, TAIL), loose, F.lit("")))


# Fixed patterns of the other family classifier, which knows more makers and takes a stated type first.
TYPE_LABELS = (r"Aircraft\s+Type:", r"A/C\s+Type\s*:", r"Type/Series\s*:", r"Aircraft\s+Model\s*:", r"AIRPLANE\s+MODEL\s*:")
TYPE_END = r"(?:\s+(?:Reference|A/C\s+T[TC]|MSN|Registration|TSN|CSN|Serial\s+N|Date|Reg\b)|\s{2,}|\s*$)"
FAMILY_TOKEN = r"(?i)(A3[012345]\d|A2[28]0|B7[0-9]{2}|EMB[\s-]?\d{3}|ERJ[\s-]?\d{3}|CRJ[\s-]?\d{3}|ATR[\s-]?\d{2}|MD[\s-]?\d{2}|DC[\s-]?\d+|737|747|757|767|777|787)"


def stated_type(head: Column) -> Column:
    """What follows the first label of a type that a header has, or empty."""
    found = [_found(blank(head), rf"(?im){label}\s*(.+?){TYPE_END}") for label in TYPE_LABELS]
    return F.coalesce(*[F.trim(f) for f in found], F.lit(""))


def short_family(head: Column) -> Column:
    """A header's family without blanks and dashes (A320, B737, EMB190): of its stated type, else anywhere, else empty."""
    token = F.coalesce(_found(stated_type(head), FAMILY_TOKEN), _found(blank(head), FAMILY_TOKEN), F.lit(""))
    plain = F.regexp_replace(F.upper(token), r"[\s-]", "")
    return F.when(plain.rlike(r"^\d+$"), F.concat(F.lit("B"), plain)).otherwise(plain)


# Fixed patterns of what a list of life-limited parts is about.
ENGINE_MODEL = r"(?i)\b(CFM56|CFM-56|CF34|CF6|GE9X|GEnx|LEAP[\- ]?1[AB]|V2500|V2527|V2533|PW[12]\d{3}|PW4\d{3}|PW6\d{3}|JT8D|JT9D|RB211|TRENT[ \-]?\d{0,4}|GP7\d{3}|GTF)\b"
APU_MODEL = r"(?i)\b(APU|GTCP\d*|GTCP-\d+|APIC|APS\d{3,4}|131-9[AB]?|331-\d{3})\b"
GEAR_MODEL = r"(?i)\b(MLG|NLG|MAIN\s+LANDING\s+GEAR|NOSE\s+LANDING\s+GEAR|LANDING\s+GEAR|SHOCK\s+STRUT|TORQUE\s+LINK|TRUNNION|PINTLE)\b"
ENGINE_PART = r"(?i)^(?:\d{3,4}M\d{1,3}[GP]\d{1,3}|338-\d{3}-\d{3}-\d|336-\d{3}-\d{3}-\d|50N\d{4}|3\d{4}-\d{2,4}|\d{4}M\d{1,3})"
APU_PART = r"(?i)^(?:3800\d{3}-|389\d{4}-|GTCP)"
GEAR_WORDS = r"(?i)\b(AXLE|TRUNNION|SLIDING\s+TUBE|OUTER\s+CYLINDER|INNER\s+CYLINDER|SHIMMY|TORQUE\s+LINK|MAIN\s+FITTING|SHOCK\s+STRUT|PINTLE|DRAG\s+STRUT|SIDE\s+STAY|PIN/BOLT)\b"
ENGINE_MODULES = ("LPC", "HPC", "HPT", "LPT", "FAN", "BOOSTER", "COMBUSTOR", "COMBUSTION", "COMP", "TURBINE")


def record_signals(records: DataFrame, key: str) -> DataFrame:
    """(key, engine_modules, engine_atas, gear_atas, apu_atas, engine_parts, apu_parts, gear_words) of documents' records.

    records: (key, MODULE, ATA, PART_NUMBER, DESCRIPTION); the sets are of ten fixed names at most.
    """
    ata = F.when(F.trim("ATA").rlike(r"^\d{1,9}$"), F.trim("ATA").cast("int"))
    module = F.upper("MODULE")
    return records.groupBy(key).agg(
        F.size(F.collect_set(F.when(module.isin(*ENGINE_MODULES), module))).alias("engine_modules"),
        F.count_if(ata.between(70, 80)).alias("engine_atas"),
        F.count_if(ata == 32).alias("gear_atas"),
        F.count_if(ata == 49).alias("apu_atas"),
        F.count_if(F.trim("PART_NUMBER").rlike(ENGINE_PART)).alias("engine_parts"),
        F.count_if(F.trim("PART_NUMBER").rlike(APU_PART)).alias("apu_parts"),
        F.count_if(F.col("DESCRIPTION").rlike(GEAR_WORDS)).alias("gear_words"),
    )


def subject(text: Column) -> Column:
    """struct(subject, confidence, score, runner_up): weighted signals of a document's first 3000 characters and records.

    The row has the columns of record_signals(), null where it has no records. Ties go to Engine, then Landing Gear.
    """
    head = F.left(blank(text), F.lit(3000))
    hits = lambda p: F.regexp_count(head, F.lit(p))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    many = lambda c: F.when(n(c) >= 3, 4).otherwise(0)
    scores = {
        "Engine": hits(ENGINE_MODEL) * 2 + n("engine_modules") * 4 + n("engine_atas") + many("engine_parts"),
        "Landing Gear": hits(GEAR_MODEL) + n("gear_atas") * 2 + many("gear_words"),
        "APU": hits(APU_MODEL) * 2 + n("apu_atas") * 2 + many("apu_parts"),
    }
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.cast("long").alias("score"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())])))
    best, second = F.get(ranked, 0), F.get(ranked, 1)["score"]
    sure = F.when(best["score"] == 0, "low").when(best["score"] >= 2 * F.greatest(second, F.lit(1)), "high").when(best["score"] > second, "medium").otherwise("low")
    return F.struct(F.when(best["score"] > 0, best["name"]).otherwise("Other").alias("subject"), sure.alias("confidence"), best["score"].alias("score"), second.alias("runner_up"))
