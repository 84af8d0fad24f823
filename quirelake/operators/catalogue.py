"""Declared formats, without recognition: each is its signatures and the forms of its rows, nothing else."""

from __future__ import annotations

from quirelake.operators.registry import Format, Registry, form, many, one, opt, raw, rest

# Signatures, columns and what tokens look like, in the formats' own terms.
CHAPTER = r"(?:[2-7]\d|8[0-3])"
DMY_SHORT = r"\d{1,2}-[A-Za-z]{3}-\d{2}"
DMY = r"\d{1,2}-[A-Za-z]{3}-\d{2,4}"
DMY_DOTTED = r"\d{1,2}\.[A-Za-z]{3}\.\d{4}"
DMY_GLUED = r"\d{2}[A-Z]{3}\d{4}"
SLASHED = r"\d{2}/\d{2}/\d{4}"
ISO = r"\d{4}-\d{2}-\d{2}"
INT = r"\d+"
HOURS = r"\d+:\d{2}"
SUBCHAPTER = r"\d{2}-\d{2}"
FLOAT = r"[\d.]+"
CERT = r"(?i:[FEJ]\.?A\.?[AS]\.?A?\.?|C\.?A\.?A\.?C\.?|C\.?A\.?D\.?|D\.?G\.?A\.?C\.?)"
PLACE = r"(?i:CARGO|FRONT|AFTER|AFT|FORWARD|FWD|REAR|LEFT|RIGHT|L|R|LH|RH|UPR|UPPER|LWR|LOWER|CTR|CENTER|CENTRE|MIDDLE|E/E|EE|CABIN|COCKPIT|GALLEY|LAVATORY|ZONE|ROOM|BAY|STN)"
PLACE_DATE = r"(?:\d{4}\.\d{2}\.\d{2}|\d{8}|ORIGINAL)"
NUMERIC = r"(?:-|\d[\d,]*(?:\.\d+)?)"
EU_NUMBER = r"(?:\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?|\d+)"
SLOT = r"\d+(?:-\d+){2,5}"
WATERMARK = r"(?:\.IEAS|IEAS|yb|lavorppa|roirp|tuohtiw|dewolla|ton|si|noitarnegeR|fo)"
RELEASE_DATE = DMY_DOTTED
POSITION_CODE = r"(?=[A-Z0-9]{2,10}(?: |$))(?=[^ ]*[A-Z])(?=[^ ]*\d)[A-Z0-9]+"
TASK = r"\d{2}-\d{1,3}-\d{2}(?:\([A-Za-z]+\))?|AD \d{4}-\d{2}-\d{2}"


def _other(*tokens: str) -> str:
    """A token with its blank that is none of these."""
    return rf"(?: (?!(?:{'|'.join(tokens)})(?: |$))\S+)"


def _token(of: str) -> str:
    return f" {of}(?= |$)"


def _release_forms():
    """Part and serial number, description, position, release label with its slash, date, times: with a slash of its own
    or within a token, with a position at most five tokens before it or without."""
    plain, undated = _other(POSITION_CODE, RELEASE_DATE), _other(RELEASE_DATE)
    unslashed, whole = _other("/", RELEASE_DATE), rf"(?: (?!(?:/|{RELEASE_DATE})(?: |$))\S+)"
    inside = rf" (?!{RELEASE_DATE}(?: |$))(?!/ )[^ ]*/[^ ]*(?= |$)"
    clear = rf"(?: (?!{RELEASE_DATE}(?: |$))[^ /]+(?= |$))"
    quiet = rf"(?: (?!(?:/|{RELEASE_DATE}|{POSITION_CODE})(?: |$))\S+)"
    head, tail = (one("PART_NUMBER"), one("SERIAL_NUMBER")), (one("INST_DATE", RELEASE_DATE), one("TSN"), one("CSN"), rest())
    pos = raw(f"({_token(POSITION_CODE)})", "POS")
    own = rf" /(?= ){unslashed}*"
    return (
        form(*head, raw(f"({undated}+)", "DESCRIPTION"), pos, raw(f"({plain}{{0,4}}{own})", "RELEASE_LABEL"), *tail),
        form(*head, raw(f"({undated}*{plain}{{4}}|{plain}{{1,3}})", "DESCRIPTION"), raw(f"({plain}{own})", "RELEASE_LABEL"), *tail),
        form(*[raw(f"({whole})", n) for n in ("PART_NUMBER", "SERIAL_NUMBER")], raw(f"({whole}+)", "DESCRIPTION"), pos, raw(f"({quiet}{{0,4}}{inside}{clear}*)", "RELEASE_LABEL"), *tail),
        form(*[raw(f"({whole})", n) for n in ("PART_NUMBER", "SERIAL_NUMBER")], raw(f"({whole}*{quiet}{{5}}|{quiet}{{1,4}})", "DESCRIPTION"), raw(f"({inside}{clear}*)", "RELEASE_LABEL"), *tail),
    )


AMOS = Format(
    "AMOS", "OCCM", ("AMOS", "swiss-as.com", "Aircraft Equipment List Report", "PART NO. SERIAL NO. DESCRIPTION POS.", "PART NO SERIAL NO DESCRIPTION POS"),
    ("ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POS", "RELEASE_LABEL", "INST_DATE", "TSN", "CSN"),
    _release_forms(),
    least_page=100,
    section=(rf"^((?:{CHAPTER}|00)(?:-\d{{2}}){{0,2}}) [A-Z][A-Z &/,\-]*[A-Z] \S.+$", "ATA"),
    continuation=(r"^[\p{L}\s,.\-]{1,20}$", "DESCRIPTION", ""),
)

ANNEX_8 = Format(
    "B777 Annex 8 OCCM", "OCCM", ("Equipment Description Functional Location",),
    ("ITEM", "PART_NUMBER", "DESCRIPTION", "ATA", "POSITION", "FUNCTIONAL_LOCATION"),
    (form(one("ITEM", r"\d{1,5}"), one("PART_NUMBER"), many("DESCRIPTION"), raw(r" ((?i:[A-Z0-9\-]+)/(\d{2})\d{2}/\d{2}/((?i:[A-Z0-9]+)))", "FUNCTIONAL_LOCATION", "ATA", "POSITION")),),
    least_page=30, upper=("POSITION", "FUNCTIONAL_LOCATION"),
)

ANNEX_7 = Format(
    "B777 Annex 7 OCCM", "OCCM", ("ANNEX 6:", "B777-300ER Airframe OCCM", "B777-300ER ENGINE OCCM", "B777-300ER APU OCCM", "B777-300ER LANDING GEAR OCCM"),
    ("REF", "PART_NUMBER", "DESCRIPTION", "AREA"),
    (form(one("REF", r"\d{1,5}"), one("PART_NUMBER", r"[A-Z0-9][A-Z0-9./\-]{2,}"), many("DESCRIPTION")),),
    aircraft="(?i)B777", least_page=30,
    file_values=(("AREA", (("airframe", "AIRFRAME"), ("engine", "ENGINE"), ("apu", "APU"), ("landing gear|_lg_| lg |lg occm", "LG"))),),
)

ON_CONDITION = Format(
    "On Condition Components Report", "OCCM", ("On Condition / Condition Components", "ATA Description Part Number Serial Number Position"),
    ("ATA", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "POSITION", "INSTALLATION_DATE"),
    (form(one("ATA", CHAPTER), many("DESCRIPTION"), one("PART_NUMBER"), one("SERIAL_NUMBER"), one("POSITION"), one("INSTALLATION_DATE", DMY_SHORT)),),
    least_page=100, continuation=(r"^\p{L}{1,4}$", "DESCRIPTION", ""),
)

COMPONENTS_LIST = Format(
    "Aircraft Components List", "OCCM", ("AIRCRAFT COMPONENTS LIST", "ATA POSITION DESCRIPTION VENDOR P/N. SERIAL NO. INST_DATE TSN CSN"),
    ("ATA", "POSITION", "DESCRIPTION", "PART_NUMBER"),
    (form(one("ATA", r"[2-9]\d{3}"), one("POSITION"), many("DESCRIPTION"), one("PART_NUMBER")),),
    least_page=40, dashes=True,
)

TAP_COMPACT = Format(
    "TAP Compact OCCM", "OCCM", ("PROG. MAN: TAP", "FLIGHT TIME:"),
    ("PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "ATA", "POSITION", "INSTALL_DATE", "FH"),
    (form(one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION", but=DMY_GLUED), one("ATA", CHAPTER), one("POSITION"), one("INSTALL_DATE", DMY_GLUED), one("FH", INT), rest()),),
    least_page=100,
)

TAP_HARD_TIME = Format(
    "TAP HT (compact)", "HT", ("PROG. MAN: TAP", "FLIGHT TIME:"),
    ("PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "ATA", "POSITION", "INSTALL_DATE", "FH", "TASK_TRAIL"),
    (
        form(one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION", but=DMY_GLUED), one("ATA", CHAPTER), one("POSITION"), one("INSTALL_DATE", DMY_GLUED), raw(r" (\d+)(?:FH|CY|TSN|CSN)?(?= |$)", "FH"), rest("TASK_TRAIL")),
        form(one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION", but=DMY_GLUED), one("ATA", CHAPTER), one("POSITION"), one("INSTALL_DATE", DMY_GLUED), rest("TASK_TRAIL")),
    ),
    least_page=80, skip=r"(?i)PROG\.?\s*MAN|FLIGHT TIME|MAINTENANCE|ENGINEERING|^ PN\s+SN\s+KEYWORD|^ ATA\s*$|PAGE\s*-?\s*\d",
)

REPLACEMENT_PLAN = Format(
    "Vietnam Airlines", "HT", ("PLAN OF AIRCRAFT COMPONENT REPLACEMENT",),
    ("DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "AIRCRAFT", "DEADLINE", "ESTIMATE", "REASON", "REMARK"),
    (form(many("DESCRIPTION", but=r"A\d{3}"), raw(f"({_other(r'A[0-9]{3}')})", "PART_NUMBER"), raw(f"({_other(r'A[0-9]{3}')})", "SERIAL_NUMBER"), one("AIRCRAFT", r"A\d{3}"), one("DEADLINE", DMY_SHORT), one("ESTIMATE", DMY_SHORT), many("REASON", least=0), one("REMARK")),),
    least_page=100,
)

TECHNICAL_OBJECTS = Format(
    "Technical Object Listing", "OCCM", ("Equipment Description of Technical Object", "Functional Location", "Since Install", "Since Inspect"),
    ("KARDEX", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "FUNCTIONAL_LOCATION", "INSTALL_DATE", "INSTALL_RAW", "INSPECT_RAW", "REPAIR_RAW", "OVERHAUL_RAW", "TOTAL_RAW"),
    (form(one("KARDEX", r"\d{8}"), many("DESCRIPTION"), one("PART_NUMBER"), one("SERIAL_NUMBER"), one("FUNCTIONAL_LOCATION")),),
    least_page=100, starts=r"^\d{8}\b", ends=r"^(?:allowable time|life limit|inspection period)",
    notes=(("INSTALL_DATE", r"(?i)^since install.*?(\d{1,2}/\d{1,2}/\d{4})"), ("INSTALL_RAW", "(?i)^since install(.*)$"), ("INSPECT_RAW", "(?i)^since inspect(.*)$"), ("REPAIR_RAW", "(?i)^since repair(.*)$"), ("OVERHAUL_RAW", "(?i)^since overhaul(.*)$"), ("TOTAL_RAW", "(?i)^total(.*)$")),
)

_TASK_CODE = rf" (({CHAPTER})(?:-(?:\d{{1,3}}|ESR))+)(?= |$)"
EMES_HARD_TIME = Format(
    "e.MES Hard Time Component Status", "HT", ("FROM E.MES", "T/C # TASK HT"),
    ("ATA", "TASK_CODE", "TASK_TYPE", "HT_CLASS", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "STATUS_TRAIL"),
    (
        form(raw(_TASK_CODE, "TASK_CODE", "ATA"), one("TASK_TYPE"), one("HT_CLASS"), one("PART_NUMBER"), one("SERIAL_NUMBER"), raw(f"(?!(?: {NUMERIC})* {ISO}(?: |$))({_other(ISO)}+?)", "DESCRIPTION"), raw(f"((?:{_token(NUMERIC)})*{_token(ISO)}.*)", "STATUS_TRAIL")),
        form(raw(_TASK_CODE, "TASK_CODE", "ATA"), one("TASK_TYPE"), one("HT_CLASS"), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION", but=ISO)),
    ),
)

ROTABLES = Format(
    "Aircraft Rotables Report", "OCCM", ("Aircraft Rotables Report", "POSITION DESCRIPTION P/N S/N MANUFACTURED INSTALLED"),
    ("ATA", "POSITION", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "MANUFACTURED", "INSTALLED", "TSN", "CSN"),
    (
        form(one("ATA", SUBCHAPTER), one("POSITION"), many("DESCRIPTION"), one("PART_NUMBER"), one("SERIAL_NUMBER"), one("MANUFACTURED", DMY_DOTTED), one("INSTALLED", DMY_DOTTED), one("TSN", INT), one("CSN", INT)),
        form(one("ATA", SUBCHAPTER), one("POSITION"), many("DESCRIPTION"), one("PART_NUMBER"), raw(f"({_other(DMY_DOTTED)})", "SERIAL_NUMBER"), one("INSTALLED", DMY_DOTTED), one("TSN", INT), one("CSN", INT)),
    ),
    least_page=100,
)

AEGEAN = Format(
    "Aegean ERJ OCCM", "OCCM", ("EMBRAER-170",),
    ("PART_NUMBER", "DESCRIPTION", "SERIAL_NUMBER", "ATA_CHAPTER", "POSITION"),
    (form(raw(rf"(?: {WATERMARK}(?= |$))*+(?: -(?= |$))?+"), one("PART_NUMBER", r"(?:[A-Z0-9][A-Z0-9\-]*-[A-Z0-9\-]+|\d+-\d+)"), many("DESCRIPTION"), one("SERIAL_NUMBER"), one("ATA_CHAPTER", SUBCHAPTER), one("POSITION", r"\d{3}")),),
    least_page=80, skip="CCooddee|SSeerriiaallnnuummbbeerr",
)

IGO_STATUS = Format(
    "OCCM Status (IGO)", "OCCM", ("ATA PART NO. SERIAL NO. DESCRIPTION POSITION INST‐DATE TSN CSN TSI CSI",),
    ("ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POSITION", "INSTALL_DATE", "TSN", "CSN", "TSI", "CSI"),
    (form(one("ATA", CHAPTER), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION"), one("POSITION"), one("INSTALL_DATE", DMY_SHORT), *[one(c, INT) for c in ("TSN", "CSN", "TSI", "CSI")]),),
    dashes=True,
)

IBERIA = Format(
    "Iberia Listado OCCM", "OCCM", ("LISTADO DE EQUIPOS INSTALADOS", "LIST OF INSTALLED COMPONENTS (AC or NHA)", "IBERIA, L.A.E. OPERADORA"),
    ("ATA", "LOCATION", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "MANUFACTURE_DATE", "NHA_DATE", "FH", "FC"),
    (
        form(one("ATA", SUBCHAPTER), one("LOCATION"), many("DESCRIPTION"), one("PART_NUMBER"), one("SERIAL_NUMBER"), one("MANUFACTURE_DATE", SLASHED), one("NHA_DATE", SLASHED), one("FH", rf"(?:{HOURS}|{INT})"), one("FC", INT)),
        form(one("ATA", SUBCHAPTER), one("LOCATION"), many("DESCRIPTION"), one("PART_NUMBER"), one("SERIAL_NUMBER")),
    ),
    least_page=100,
)

A330_PLANNING = Format(
    "A330 Engineering Planning OCCM", "OCCM", ("ENGINEERING & PLANNING",),
    ("ATA", "ZONE", "FIN", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "INSTALL_DATE", "AC_FH_AT_INSTALL", "AC_FC_AT_INSTALL", "COMP_FH_AT_INSTALL", "COMP_FC_AT_INSTALL", "COMP_TSN", "COMP_CSN"),
    (form(one("ATA", CHAPTER), one("ZONE"), one("FIN"), many("DESCRIPTION", least=0, lazy=True), one("PART_NUMBER"), one("SERIAL_NUMBER"), one("INSTALL_DATE", DMY), *[one(c) for c in ("AC_FH_AT_INSTALL", "AC_FC_AT_INSTALL", "COMP_FH_AT_INSTALL", "COMP_FC_AT_INSTALL", "COMP_TSN", "COMP_CSN")], rest()),),
    least_page=50, dashes=True,
)

REMAINING_POTENTIALS = Format(
    "Remaining Potentials", "OCCM", ("Remaining potentials report", "Aircraft Remaining Potentials", "BI SI Remain Deadline", "Effectivity :"),
    ("KARDEX", "POSITION_DESC", "INSTAL_DATE", "PART_NUMBER", "SERIAL_NUMBER", "FULL_DESCRIPTION", "AMM_FIN", "FH_RAW", "CY_RAW", "DAYS_RAW"),
    (form(one("INSTAL_DATE", r"\d{1,2}/\d{1,2}/\d{4}"), raw(r" PN ?: ?(\S+)(?= )", "PART_NUMBER"), raw(r" SN ?: ?(\S+)(?= |$)", "SERIAL_NUMBER"), rest("FULL_DESCRIPTION")),),
    least_page=100, before=(r"^[A-Z0-9]{3,10}\b", "KARDEX", "POSITION_DESC"), offsets=(("AMM_FIN", 1, ""), ("FH_RAW", 2, "FH "), ("CY_RAW", 3, "CY "), ("DAYS_RAW", 4, "Days ")),
)

LIST_AS_AT = Format(
    "OCCM List As At", "OCCM", ("OCCM LIST AS AT", "ATA DESCRIPTION MPN MSN POSN", "MPN MSN POSN INSTALL DATE"),
    ("ATA", "DESCRIPTION", "MPN", "MSN", "POSN", "INSTALL_DATE", "INSTALL_TIME", "TSN", "CSN", "TSO", "CSO", "TSSV", "CSSV"),
    (form(raw(r"(?=(?: \S+){8})"), one("ATA", CHAPTER), many("DESCRIPTION", but=r"\d+(?:-[A-Z0-9]+)+"), raw(rf" (?!{ISO}(?: |$))(\d+(?:-[A-Z0-9]+)+)(?= )", "MPN"), raw(f"({_other(ISO)})", "MSN"), many("POSN", least=0, but=ISO), one("INSTALL_DATE", ISO), raw("(?= )"), opt("INSTALL_TIME", r"\d{2}:\d{2}:\d{2}"), *[opt(c) for c in ("TSN", "CSN", "TSO", "CSO", "TSSV", "CSSV")], rest()),),
    least_page=100,
)

TIMELINE = Format(
    "AerCap Hard Time Component Status", "HT", ("COMP.TIMELINE", "A/C TIMELINE (@INSTL)"),
    ("ATA", "TASK_CODE", "STATUS_TRAIL"),
    (form(raw(rf" ({CHAPTER})({TASK}) (.*)", "ATA", "TASK_CODE", "STATUS_TRAIL")), form(raw(rf"(?! \d{{2}}(?:{TASK}) )((?=.*\d{{1,2}}-[A-Za-z]{{3}}-\d{{2,4}}|.*(?:WORTH TO GO|OVERDUE)$).*)", "STATUS_TRAIL"), under=True)),
    dashes=True, skip=r"^ (?:AerCap|Westpark|A/C |INTERVAL|ATA MP ITEM|All rights reserved|ANNOTATION|Name:|Signature:)", carried=("ATA", "TASK_CODE"),
)

MSN_STATUS = Format(
    "MSN Components Status List", "OCCM", ("OC&CM COMPONENTS STATUS LIST", "Item MSN ATA Zone FIN Description"),
    ("ITEM", "MSN", "ATA", "ZONE", "FIN", "DESCRIPTION", "INSTALL_DATE", "PART_NUMBER", "SERIAL_NUMBER", "TSN", "CSN", "TSR", "CSR", "STATUS", "CERT"),
    (form(one("ITEM", r"N\d{4,6}"), *[one(c) for c in ("MSN", "ATA", "ZONE", "FIN")], many("DESCRIPTION", least=0, but=DMY), one("INSTALL_DATE", DMY), one("PART_NUMBER"), one("SERIAL_NUMBER"), *[raw(f"(?: ({FLOAT})(?= |$))?+", c) for c in ("TSN", "CSN", "TSR", "CSR")], raw(f"(?: {FLOAT}(?= |$))*+"), many("STATUS", least=0, lazy=True), raw(f"(?: ({CERT})(?= |$))?", "CERT")),),
    least_page=50, upper=("CERT",),
)

CONFIG_SLOT = Format(
    "CONFIG SLOT OCCM", "OCCM", ("CONFIG SLOT PART NUMBER SERIAL NUMBER POSITION ID BARCODE", "TIME SINCE NEW TIME SINCE OVERHAUL CYCLE SINCE NEW CYCLE SINCE OVERHAUL", "CONFIG SLOT"),
    ("CONFIG_SLOT", "PART_NUMBER", "SERIAL_NUMBER", "POSITION", "ID_BARCODE", "EQUIPMENT_DESCRIPTION", "INSTALL_DATE", "TIME_SINCE_NEW", "TIME_SINCE_OVERHAUL", "CYCLE_SINCE_NEW", "CYCLE_SINCE_OVERHAUL"),
    (form(one("CONFIG_SLOT", SLOT), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("POSITION", but=r"\d{2}[/-]\d{2}[/-]\d{4}"), one("ID_BARCODE", "I[0-9A-Z]{6,8}"), many("EQUIPMENT_DESCRIPTION", but=r"\d{2}[/-]\d{2}[/-]\d{4}|I[0-9A-Z]{6,8}"), one("INSTALL_DATE", r"\d{2}[/-]\d{2}[/-]\d{4}"), *[one(c, EU_NUMBER) for c in ("TIME_SINCE_NEW", "TIME_SINCE_OVERHAUL", "CYCLE_SINCE_NEW", "CYCLE_SINCE_OVERHAUL")], rest()),),
    least_page=100,
)

_PLACED = (one("ITEM", r"\d{1,5}"), one("ATA", CHAPTER), many("DESCRIPTION"), one("PART_NUMBER"))
_PLACED_DATE = (one("INSTALL_DATE", PLACE_DATE), many("NOTES", least=0, but=PLACE_DATE))
A340_STATUS = Format(
    "CCA A340 OCCM", "OCCM", ("OCCM COMPONETS STATUS", "ITEM ATA DESCRIPTION P/N S/N LOCATION"),
    ("ITEM", "ATA", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "LOCATION", "INSTALL_DATE", "NOTES"),
    (
        form(*_PLACED, one("SERIAL_NUMBER"), raw(f"((?:{_token(PLACE)}){{3}})", "LOCATION"), *_PLACED_DATE),
        form(*_PLACED, raw(f"({_other(PLACE)})", "SERIAL_NUMBER"), raw(f"((?:{_token(PLACE)}){{0,2}})", "LOCATION"), *_PLACED_DATE),
    ),
    aircraft="(?i)A340", least_page=60,
)

AVIANCA = Format(
    "Avianca OCCM", "OCCM", ("A I C R A F T:", "A I R C R A F T:"),
    ("ITEM", "ATA", "POSITION", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "INST_DATE", "TSN", "CSN"),
    (
        form(one("ITEM", INT), one("ATA", INT), one("POSITION"), many("DESCRIPTION", least=0, but=DMY), raw(f"({_other(DMY)})", "PART_NUMBER"), raw(f"({_other(DMY)})", "SERIAL_NUMBER"), one("INST_DATE", DMY), one("TSN", r"(?:[\d.,]+|UNKNOWN)"), one("CSN", r"(?:\d+|UNKNOWN)"), rest()),
        form(raw(r" (?i:ATA)(\d{2})(?= )", "ATA"), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION"), one("INST_DATE", r"\d{2}\.\d{2}\.\d{4}")),
    ),
    least_page=80, empty=(("POSITION", "0"),),
)

_CATHAY_TIMES = (*[one(c, HOURS) for c in ("TSN", "TSO", "TSR")], *[one(c, INT) for c in ("CSN", "CSO", "CSR")], one("INSTALL_DATE", rf"(?:\d{{1,2}}/\d{{2}}/\d{{4}}|{DMY})"))
CATHAY = Format(
    "Cathay OCCM", "OCCM", ("ATA Description Equip ID Part Number Serial Number Location TSN TSO TSR", "TSN TSO TSR CSN CSO CSR Install Date"),
    ("ATA", "DESCRIPTION", "EQUIP_ID", "PART_NUMBER", "SERIAL_NUMBER", "LOCATION", "TSN", "TSO", "TSR", "CSN", "CSO", "CSR", "INSTALL_DATE"),
    (
        form(one("ATA", CHAPTER), many("DESCRIPTION"), one("EQUIP_ID"), one("PART_NUMBER"), one("SERIAL_NUMBER", r"[^\s-]{3,}"), one("LOCATION", "[A-Z0-9]{1,5}"), *_CATHAY_TIMES),
        form(one("ATA", CHAPTER), many("DESCRIPTION"), one("EQUIP_ID"), raw(rf" (?![^\s-]{{3,}} [A-Z0-9]{{1,5}} {HOURS} )(\S+)(?= )", "PART_NUMBER"), one("SERIAL_NUMBER"), *_CATHAY_TIMES),
    ),
    least_page=100,
)

_MM504_NUMBER = r"(?:(?: (?![\d:.]+(?: |$))\S+)*+ ([\d:.]+)(?= |$))?"
MM504 = Format(
    "Aircraft Inventory Report (MM_504)", "OCCM", ("AIRCRAFT INVENTORY REPORT", "MCM-RW-1.3-5"),
    ("ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POSITION", "INSTALL_DATE", "COMMENT", "COUNTER", "FH", "FC", "DAYS"),
    (form(raw(r"(?=(?: \S+){6})"), one("ATA", "(?i:[A-Z0-9]{2,12})"), *[raw(f"({_other(r'[0-9]{2}-[A-Za-z]{3}-[0-9]{2}', r'[0-9]{2}-[0-9]{2}-[0-9]{4}')})", c) for c in ("PART_NUMBER", "SERIAL_NUMBER")], many("DESCRIPTION", but=r"\d{2}-[A-Za-z]{3}-\d{2}|\d{2}-\d{2}-\d{4}"), raw(f"({_other(r'[0-9]{2}-[A-Za-z]{3}-[0-9]{2}', r'[0-9]{2}-[0-9]{2}-[0-9]{4}')})", "POSITION"), one("INSTALL_DATE", r"(?:\d{2}-[A-Za-z]{3}-\d{2}|\d{2}-\d{2}-\d{4})"), raw(r"((?: (?![\d:.])\S+)*+)", "COMMENT"), *[raw(_MM504_NUMBER, c) for c in ("COUNTER", "FH", "FC", "DAYS")], rest()),),
    least_page=100,
)

SAP_INVENTORY = Format(
    "OCCM Inventory (SAP-ES)", "OCCM", ("Ubicac.técnica Denominación Material Número de serie Válido de",),
    ("ATA", "POSITION_CODE", "DESCRIPTION", "PART_NUMBER", "MATERIAL_CODE", "SERIAL_NUMBER", "VALID_FROM"),
    (form(raw(r" [A-Z0-9]{3,8} -(ATA(\d{2})(?:-[A-Z0-9]+)*)(?= )", "POSITION_CODE", "ATA"), many("DESCRIPTION", lazy=True), raw(r" ([A-Z0-9./,\-]+):([A-Z0-9]+)(?= )", "PART_NUMBER", "MATERIAL_CODE"), opt("SERIAL_NUMBER"), one("VALID_FROM", SLASHED)),),
    dashes=True, skip="^ Ubicac",
)

_AT_INSTALL = tuple(one(c) for c in ("TAH_AT_INSTALL", "TAC_AT_INSTALL", "TSN", "CSN"))
AT_INSTALL = Format(
    "OCCM List (TAH/TAC at Install)", "OCCM", ("ATA Partno Serialno Description Pos Inst-Date TAH@INS TAC@INS TSN CSN", "TAH@INS TAC@INS"),
    ("ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POSITION", "INSTALL_DATE", "TAH_AT_INSTALL", "TAC_AT_INSTALL", "TSN", "CSN"),
    (
        form(one("ATA", CHAPTER), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION"), one("POSITION"), one("INSTALL_DATE", DMY_SHORT), *_AT_INSTALL),
        form(one("ATA", CHAPTER), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION", but="See"), raw(f"({_other('See')})", "POSITION"), raw(r" (See(?= )(?: \S+)*?)", "INSTALL_DATE"), *_AT_INSTALL),
    ),
)

CONDITION = "(?:N|R|IT|OH|M|S)"
DOTTED = r"\d{2}\.\d{2}\.\d{4}"
DOT_DATED = Format(
    "OCCM List MSN (Dot-Dated, With Condition)", "OCCM", ("OCCM LIST MSN", "ATA PART NO. SERIAL NO. DESCRIPTION CON POS. INST-DATE TAH Inst TAC Inst TSN CSN"),
    ("ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "CONDITION", "POSITION", "INSTALL_DATE", "TAH_AT_INSTALL", "TAC_AT_INSTALL", "TSN", "CSN"),
    (form(one("ATA", CHAPTER), one("PART_NUMBER"), one("SERIAL_NUMBER"), many("DESCRIPTION", but=DOTTED), one("CONDITION", CONDITION), many("POSITION", least=0, but=f"{DOTTED}|{CONDITION}"), one("INSTALL_DATE", DOTTED), raw(r"(?: \S+)*"), *_AT_INSTALL),),
)

_DAYS = (one("SERIAL_NUMBER"), one("LAST_BATCH_MOVEMENT", r"\d{1,2}[A-Za-z]{3}\d{4}"), raw(" Days(?= )"), *[one(f"DAYS_SINCE_{b}") for b in ("NEW", "FIT", "OVERHAUL", "REPAIR")])
_DECIMAL = r"\d+(?:\.\d+)?"
OASES = Format(
    "OASES", "OCCM", ("FL Technics OASES", "OASES Live system", "OASES Option", "Aircraft Build Report Date", "Aircraft Build Aircraft Reg", "Position Zone Part Number Description", "Last Batch Movement", "Since New Since Fit Since Overhaul"),
    ("ATA", "POSITION", "ZONE", "PART_NUMBER", "DESCRIPTION", "SERIAL_NUMBER", "LAST_BATCH_MOVEMENT", *[f"{m}_SINCE_{b}" for m in ("DAYS", "HOURS", "LANDINGS") for b in ("NEW", "FIT", "OVERHAUL", "REPAIR")]),
    (
        form(one("ATA", r"\d{6,8}"), raw(rf" (\S+ (?!{_DECIMAL}(?: |$))\S+)(?= )", "POSITION"), one("ZONE", _DECIMAL), one("PART_NUMBER"), many("DESCRIPTION"), *_DAYS),
        form(one("ATA", r"\d{6,8}"), raw(rf"(?! \S+ (?!{_DECIMAL} )\S+ {_DECIMAL} \S+ )"), one("POSITION"), one("ZONE"), one("PART_NUMBER"), many("DESCRIPTION"), *_DAYS),
    ),
    least_page=100, starts=r"^\d{6,8} .* Days \S+ \S+ \S+ \S+$", ends=r"^landings(?: \S+){4}",
    notes=tuple((f"{m}_SINCE_{b}", rf"^{m.title()}(?= \S+ \S+ \S+ \S+)(?: .*)? (\S+)" + r" \S+" * (3 - i) + "$") for m in ("HOURS", "LANDINGS") for i, b in enumerate(("NEW", "FIT", "OVERHAUL", "REPAIR"))),
)

_DATED = r"\d{2}\.[A-Za-z]{3}\.\d{4}"
_ROTABLE_HEAD = (raw(r"(?=(?: \S+){8})"), raw(rf" ({CHAPTER})-\d{{2}}(?= )", "ATA"), one("POSITION"), many("DESCRIPTION", least=0, lazy=True), one("PART_NUMBER"))
_ROTABLE_LIMITS = (many("REQUIREMENT", least=0, lazy=True), raw(rf"(?=(?:.* ({_DATED})(?= |$))?)", "EXPECTED"), raw(r" (\d+ [HD])(?= |$)", "INTERVAL"), raw(r"(?: (\S+ \S+)(?= |$))?", "TO_GO"), rest())
_ROTABLE_TIMES = (one("INSTALL_DATE", _DATED), one("TSN", INT), one("CSN", INT))
ROTABLES_HARD_TIME = Format(
    "Aircraft Rotables HT", "HT", ("Aircraft Rotables Report",),
    ("ATA", "POSITION", "DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "MANUFACTURED", "INSTALL_DATE", "TSN", "CSN", "REQUIREMENT", "INTERVAL", "TO_GO", "EXPECTED"),
    tuple(form(*_ROTABLE_HEAD, *made, *_ROTABLE_TIMES, *limits) for made in ((one("SERIAL_NUMBER"), one("MANUFACTURED", _DATED)), (raw(f"({_other(_DATED)})", "SERIAL_NUMBER"),)) for limits in (_ROTABLE_LIMITS, (many("REQUIREMENT", least=0),))),
    least_page=80, skip=r"(?i)Aircraft Rotables Report|^ Aircraft:|^ ATA\s+POSITION",
)

_SPECIFIED = (raw(f"({_other(DOTTED)})", "PART_NUMBER"), raw(f"({_other(DOTTED)})?", "SERIAL_NUMBER"), many("DESCRIPTION", least=0, but=DOTTED), raw(f"({_other(DOTTED)})", "POS"), one("INST_DATE", DOTTED), one("TSN", r"\d+:\d{2}(?::\d{2})?"), one("CSN", INT), rest())
SPECIFICATION = Format(
    "Aircraft Spec File OCCM", "OCCM", ("AIRCRAFT SPECIFICATION FILE",),
    ("ATA", "ATA_DESCRIPTION", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POS", "INST_DATE", "TSN", "CSN"),
    (form(one("ATA", r"\d{1,2}"), raw(r"((?: [^\d ]+(?= ))*+)", "ATA_DESCRIPTION"), *_SPECIFIED), form(raw(r"(?! \d{1,2} )"), *_SPECIFIED, under=True)),
    carried=("ATA", "ATA_DESCRIPTION"), orphans=True,
)

#: In order of priority within a sheet, as the formats are tried.
FORMATS = (
    SPECIFICATION, AEGEAN, A330_PLANNING, AVIANCA, ANNEX_8, ANNEX_7, A340_STATUS, MSN_STATUS, IGO_STATUS, MM504, ROTABLES, AMOS, CATHAY, CONFIG_SLOT, IBERIA, OASES, LIST_AS_AT, ON_CONDITION, REMAINING_POTENTIALS, TAP_COMPACT, TECHNICAL_OBJECTS, COMPONENTS_LIST, SAP_INVENTORY, AT_INSTALL, DOT_DATED,
    REPLACEMENT_PLAN, TAP_HARD_TIME, IBERIA.alias("Iberia Listado HT", "HT", "Fecha de listado", "Horas de vuelo"), ROTABLES_HARD_TIME,
    AMOS.alias("AMOS HT (Aircraft Equipment List Report)", "HT", "Aircraft Equipment List Report", "Aircraft-Equipment-List", "PART NO. SERIAL NO. DESCRIPTION POS."),
    TIMELINE, EMES_HARD_TIME, REMAINING_POTENTIALS.alias("Remaining Potentials (HT)", "HT", *REMAINING_POTENTIALS.signatures, "Protocol Type H/T"),
)

# Signatures of the sheets themselves.
SHEET_SIGNATURES = {
    "LLP": (
        "LIFE LIMITED PART LIST", "Lowest LLP", "Component Equipment List Report", "ENGINE LLPs STATUS REPORT", "Engine Life Limited Parts Status", "LIFE LIMITED PARTS SUMMARY", "CFM56-7B LIFE LIMITED PARTS", "LIFE LIMITS PARTS STATUS LIST", "LANDING GEAR STATUS", "Assemblies >> Gear LLPs", "Life Limited Part Status", "Serialized Unit List - Hard Limits", "LDG LLP COMPLIANCE STATUS", "LANDING GEAR LIFE LIMIT PARTS REPORT", "LLP Status Report", "When Airframe CSN:", "06331890969", "LOWER LIMITER", "LANDING GEAR LIFE LIMITED PARTS STATUS", "MAINTENANCEPLANNING AND CONTROL", "Available hours/cycles for Component life limited parts", "LIFE LIMITED PARTS FOR A", "ALS Part 1", "IHI Corporation", "LIST OF INTERNAL PARTS", "Life Limited Parts for:", "POWERPLANT MAINTENANCE CENTER", "ENGINE CONTROL FLEET ENGINES", "ITEMS CONTROL FOR", "Master Tracking List", "Serialized List", "TURBINE ACCEPTANCE TAG", "Disc Sheet", "Lowest Cycles Remaining",
    ),
    "HT": (
        "PLAN OF AIRCRAFT COMPONENT REPLACEMENT", "HARD TIME COMPONENTS STATUS FOR A/C-REGISTRATION", "HARD TIME LIST AS AT", "HT-LL STATUS", "HT&LLP STATUS", "ATA MPD TASK NO PART NUMBER SERIAL NUMBER PART DESCRIPTION POS TASK TYPE", "MPD TASK TASK MPD INTERVAL", "COMP.TIMELINE", "OXYGEN GENERATOR STATUS", "T/C # TASK HT", "Time-controlled Components", "HARD TIME REPORT", "MPD TASK Work Type ZONE", "TIME CONTROLLED COMPONENTS STATUS", "AIRCRAFT REGLEMENTARY INVENTORY", "AIRCRAFT FULL INVENTORY", "Activity Life Expiry Report", "TIME CONTROLLED ITEMS STATUS", "Time Controlled Items Report", "Protocol Type H/T", "HT LISTING", "MAINTENANCE DUE REPORT", "Hard Time Monitoring Sheet", "Time Controlled Items Current Status", "HARD TIME COMPONENT LIST", "FIT A/C Hr FIT A/C Cyc", "TOTAL TIMES SINCE NEW", "HARD TIME STATUS", "Fire Extinguisher Status List", "OXYGEN STATUS LIST", "EMER INVENTORY MSN", "HT LIST REPORT", "MPD Item #", "LAST INSP/OVH", "ATA OMP REF REQ PN SN DESCRIPTION POS INST DATE", "HT COMPONETS STATUS", "EO ATA_CHAPTER PN SN PN_DESCRIPTION INSTALLED_POSITION INSTALLED_DATE ACTUAL_HOURS ACTUAL_CYCLES TASK REQUIREMENT SCHEDULE_HOURS SCHEDULE_CYCLES SCHEDULE_DAYS DUE_DATE DUE_AT_HOURS DUE_AT_CYCLES REMAIN_HOURS REMAIN_MINUTES REMAIN_CYCLES REMAIN_DAYS NHA_PN NHA_SN", "LIMIT CONTROL NEXT DUE REMAINING NOTES", "HT-COMPONENT", "HT ‐ COMPONENT STATUS", "MPD PART SERIAL INSTALLED SERVICE INTERVAL NEXT DUE REMAINING REMARKS", "ACRF REG. :", "TRPSTATUS", "Hard Time Components List", "MAINTENANCE STATUS REPORT Report ERM1", "HT COMPONENTS STATUS", "LIMITE CONTROL CHECK", "Fitted to part Fitted to serial", "HT Aircraft Component LOG", "AIRFRAME HTC/LLP STATUS", "TIME CONTROLLED ITEMS (TCI)", "HARD TIME COMPONENTS STATUS REPORT", "ATA LAST DATE INSTALLED DATE LAST TIME TIME SINCE INSTALL ALOW TIME INTERVAL REMAIN FOR OH", "PN SN DESCRIPTION POS Inst Date TSN CSN TASK DESCRIPTION",
    ),
    "OCCM": (
        "OCCM", "AVIONIC INSTALLED UNITS", "AIRCRAFT EQUIPMENT LIST REPORT", "OCCM COMPONENTS STATUS LIST", "OCCM STATUS", "AIRCRAFT REGISTRATION:", "PROG. MAN:", "AIRCRAFT-EQUIPMENT-LIST", "AIRCRAFT COMPONENT LOG", "Parts Remaining Fitted at Build", "Parts Remaining fitted at Build", "I-BIX", "AIRCRAFT COMPONENTS LIST", "A/C Status Audit Print", "Remaining potentials report", "ATA INSTALL DATE POSITION PN SN DESCRIPTION", "OCCM SUMMARY LIST", "Pos InstDate OvhDateDSO", "OCCM Report Date :", "Serial # Position Description Installation Date", "OC/CM STATUS", "ATA P/N DESCRIPTION S/N POS MPCODE INST. DATE UNIT TSN TSI LSN LSI", "O/C COMPONENT STATUS", "OCCM Control Sheet", "All Fitted Aircraft Component LOG", "OCCM COMPONENT INVENTORY", "OCCM Listing", "Component Data at Install", "Serialized Component List", "INSTALLED PARTS LIST", "SERIALIZATION LIST by ATA CHAPTER", "ASSEMBLY CONFIGURATION / STATUS REPORT", "MAINTENANCE STATUS REPORT", "COMPONENT LIST", "A/C Installed Parts Print", "AIRCRAFT REG. :", "COMPONENTS CONTROL", "ON CONDITION MONITORING COMPONENTS", "serialised components report", "OCCMUIC", "INSTALLATION DATA CURRENT DATA (", "CONDITION MONITORING COMPONENTS STATUS", "LOCALIZATION", "ROTABLE COMPONENTS", "installed_position installed_date actual_hours actual_cycles", "ATA PART NO. SERIAL NO. DESCRIPTION POSITION INST‐DATE TSN CSN TSI CSI", "AIC ON CONDITION REPORT", "ON CONDITION COMPONENT MONITORING STATUS", "AIRCRAFT OC/CM COMPONENTS STATUS",
    ),
}

CATALOGUE = Registry(FORMATS, SHEET_SIGNATURES)
