"""Queries of the registry of formats: orders printed in ten formats, routed and read back; the SQL reads the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.catalogue import CATALOGUE
from quirelake.sources.tables import table


#: Format: its head, its rows as printed (a form or more, taken in turn), and lines before them.
PRINTED: dict[str, tuple[str, tuple[str, ...], str]] = {
    "B777 Annex 8 OCCM": ("Equipment Description Functional Location", ("{n} {pn} {words} GZ-b77/{ch}25/01/aft", "{n} {pn} GZ/{ch}25/01/a"), ""),
    "Aircraft Components List": ("AIRCRAFT COMPONENTS LIST", ("{ch}31 {pos} {words} {pn}", "{ch}31 {pos} {pn}"), ""),
    "Vietnam Airlines": ("Plan of aircraft  component replacement", ("{words} {pn} {sn} A321 {dmy} {dmy} LIFE {words} OK", "{pn} {sn} A321 {dmy} {dmy} X OK"), ""),
    "e.MES Hard Time Component Status": ("T/C # TASK HT", ("{ch}-11-ESR OVH LRU {pn} {sn} {words} 1,200 - {iso} {n}", "{ch}-11 OVH LRU {pn} {sn} {words} 12"), ""),
    "Aircraft Rotables Report": ("OCCM: Aircraft Rotables Report", ("{ch}-31 {pos} {words} {pn} {sn} {dotted} {dotted} {n} 7", "{ch}-31 {pos} {words} {pn} {sn} {dotted} {n} 7"), ""),
    "OCCM Status (IGO)": ("ATA PART NO. SERIAL NO. DESCRIPTION POSITION INST‐DATE TSN CSN TSI CSI", ("{ch} {pn} {sn} {words} {pos} {dmy} {n} 2 3 4", "{ch} {pn} {sn} {pos} {dmy} {n} 2 3 4"), ""),
    "Iberia Listado OCCM": ("LISTADODE EQUIPOS INSTALADOS", ("{ch}-31 {pos} {words} {pn} {sn} {slashed} {slashed} 10:20 {n}", "{ch}-31 {pos} {words} {pn} {sn}"), ""),
    "A330 Engineering Planning OCCM": ("ENGINEERING & PLANNING", ("{ch} 100 F1 {words} {pn} {sn} {dmy} {n} 2 3 4 5 6 end", "{ch} 100 F1 {pn} {sn} {dmy} {n} 2 3 4 5 6"), ""),
    "AMOS": ("OCCM list by AMOS", ("{pn} {sn} {words} 30HQ NEW / 24310 {dotted} {n} 5", "{pn} {sn} {words} NEW / 24310 {dotted} {n} 5"), "21-22 AIR CONDITIONING see below"),
    "AerCap Hard Time Component Status": ("A/C TIMELINE (@INSTL) and COMP.TIMELINE", ("{ch}28-11-01(a) {words} {n}", "next {dmy} due {n}"), ""),
}
_WORDS = ("FUEL PUMP", "VALVE", "LH WING  TANK")


#: What a printed row may hold, in SQL; `_columns` says the same of lineitem's columns.
_SQL = {
    "pn": "'P' || l_partkey || '-' || l_linenumber",
    "sn": "'S' || l_suppkey",
    "ch": "CAST(l_partkey % 64 + 20 AS VARCHAR)",
    "pos": "'X' || (l_suppkey % 90 + 10)",
    "n": "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)",
    "words": "[" + ", ".join(f"'{w}'" for w in _WORDS) + "][l_partkey % 3 + 1]",
    "iso": "strftime(l_shipdate, '%Y-%m-%d')",
    "dmy": "strftime(l_shipdate, '%-d-%b-%y')",
    "dotted": "strftime(l_shipdate, '%d.%b.%Y')",
    "slashed": "strftime(l_shipdate, '%d/%m/%Y')",
}


def _columns() -> dict[str, Column]:
    text = lambda c: c.cast("string")
    day = lambda form: F.date_format("l_shipdate", form)
    return {
        "pn": F.concat(F.lit("P"), text(F.col("l_partkey")), F.lit("-"), text(F.col("l_linenumber"))),
        "sn": F.concat(F.lit("S"), text(F.col("l_suppkey"))),
        "ch": text(F.col("l_partkey") % 64 + 20),
        "pos": F.concat(F.lit("X"), text(F.col("l_suppkey") % 90 + 10)),
        "n": text(F.col("l_quantity").cast("int")),
        "words": F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.pmod("l_partkey", F.lit(3)) + 1).cast("int")),
        "iso": day("yyyy-MM-dd"),
        "dmy": day("d-MMM-yy"),
        "dotted": day("dd.MMM.yyyy"),
        "slashed": day("dd/MM/yyyy"),
    }


def _pieces(template: str) -> list[tuple[bool, str]]:
    """(is it a name, text) of a template."""
    out = []
    for i, piece in enumerate(template.split("{")):
        name, _, literal = piece.partition("}") if i else ("", "", piece)
        out += [(True, name)] * bool(name) + [(False, literal)] * bool(literal)
    return out


PAD = "." * 100


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each order as a document of one of the formats, or of none.

    A row's template is looked up and its names are replaced, each by a value made only where the template has it: a case
    of all templates written out is more code than the JVM compiles.
    """
    k = F.pmod("l_orderkey", F.lit(len(PRINTED) + 1))
    templates = F.array(*[F.lit(t) for _, forms, _ in PRINTED.values() for t in forms], *[F.lit(None).cast("string")] * 2)
    template = F.element_at(templates, (k * 2 + F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2)).cast("int"))
    own = template
    for name, value in _columns().items():
        own = F.replace(own, F.lit(f"{{{name}}}"), F.when(F.contains(template, F.lit(f"{{{name}}}")), value).otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.coalesce(own, F.lit("a row of no format")).alias("line"))
    heads = F.element_at(F.array(*[F.lit(f"{h}\n{PAD}\n{b}") for h, _, b in PRINTED.values()], F.lit(f"nothing known\n{PAD}\n")), (k + 1).cast("int"))
    docs = rows.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("line")), "\nPage 1 of 2\n").alias("lines"))
    return docs.select(F.col("l_orderkey").alias("doc_id"), F.concat(heads, F.lit("\n"), F.col("lines")).alias("text"))


def format_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = CATALOGUE.route(printed(spark, sf_dir))
    return routed.groupBy("sheet_type", "variant", F.coalesce("diagnosis", F.lit("")).alias("diagnosis")).agg(F.count("*").alias("documents"))


def format_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of every printed document, its columns joined in their order."""
    found = CATALOGUE.records(CATALOGUE.route(printed(spark, sf_dir)), "doc_id")
    return found.select(F.col("doc").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "variant", F.array_join(F.map_values("record"), "|").alias("cells"))


QUERIES = {f.__name__: f for f in (format_routes, format_records)}


def _sql_printed() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    row = lambda t: " || ".join(_SQL[x] if named else quoted(x) for named, x in _pieces(t))
    k = f"l_orderkey % {len(PRINTED) + 1}"
    rows = " ".join(f"WHEN {i} THEN CASE WHEN l_linenumber % 2 = 1 THEN {row(a)} ELSE {row(b)} END" for i, (_, (a, b), _) in enumerate(PRINTED.values()))
    heads = " ".join(f"WHEN {i} THEN {quoted(h)} || chr(10) || '{PAD}' || chr(10) || {quoted(b)}" for i, (h, _, b) in enumerate(PRINTED.values()))
    return f"""p AS (SELECT l_orderkey AS doc_id, list(CASE {k} {rows} ELSE 'a row of no format' END) AS lines FROM lineitem GROUP BY 1),
      d AS (SELECT doc_id, (CASE {k.replace('l_orderkey', 'doc_id')} {heads} ELSE 'nothing known' || chr(10) || '{PAD}' || chr(10) END) || chr(10) || array_to_string(list_sort(lines), chr(10) || 'Page 1 of 2' || chr(10)) AS text FROM p),
      h AS (SELECT *, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h, upper(regexp_replace(text, '\\s+', '', 'g')) AS q FROM d),
      r AS (SELECT *, CASE WHEN contains(h, 'PLAN OF AIRCRAFT COMPONENT REPLACEMENT') THEN 'Vietnam Airlines' WHEN contains(h, 'T/C # TASK HT') THEN 'e.MES Hard Time Component Status' WHEN contains(h, 'COMP.TIMELINE') THEN 'AerCap Hard Time Component Status'
        WHEN contains(h, 'ENGINEERING & PLANNING') THEN 'A330 Engineering Planning OCCM' WHEN contains(h, 'EQUIPMENT DESCRIPTION FUNCTIONAL LOCATION') THEN 'B777 Annex 8 OCCM' WHEN contains(h, 'INST‐DATE TSN CSN TSI CSI') THEN 'OCCM Status (IGO)'
        WHEN contains(h, 'AIRCRAFT ROTABLES REPORT') THEN 'Aircraft Rotables Report' WHEN contains(h, 'AMOS') THEN 'AMOS' WHEN contains(h, 'AIRCRAFT COMPONENTS LIST') THEN 'Aircraft Components List' WHEN contains(q, 'LISTADODEEQUIPOSINSTALADOS') THEN 'Iberia Listado OCCM' ELSE 'Unknown' END AS variant FROM h)"""


_BETWEEN = "array_to_string(t[{0}:n - {1}], ' ')"
_CHAPTER = "regexp_full_match(t[1], '[0-9]{2}') AND TRY_CAST(t[1] AS INTEGER) BETWEEN 20 AND 83"
#: How SQL reads a line of each format: by its tokens t and their number n.
_READ = {
    "B777 Annex 8 OCCM": (r"n >= 4 AND regexp_full_match(t[1], '\d{1,5}') AND regexp_full_match(upper(t[n]), '[A-Z0-9-]+/\d{4}/\d{2}/[A-Z0-9]+')", ["t[1]", "t[2]", _BETWEEN.format(3, 1), "left(split_part(t[n], '/', 2), 2)", "upper(split_part(t[n], '/', 4))", "upper(t[n])"]),
    "Aircraft Components List": (r"n >= 4 AND regexp_full_match(t[1], '[2-9]\d{3}')", ["t[1]", "t[2]", _BETWEEN.format(3, 1), "t[n]"]),
    "Vietnam Airlines": ("at_a321 > 3 AND n > at_a321 + 3", ["array_to_string(t[1:at_a321 - 3], ' ')", "t[at_a321 - 2]", "t[at_a321 - 1]", "t[at_a321]", "t[at_a321 + 1]", "t[at_a321 + 2]", "array_to_string(t[at_a321 + 3:n - 1], ' ')", "t[n]"]),
    "e.MES Hard Time Component Status": (r"n >= 6 AND regexp_full_match(t[1], '\d{2}(-(\d{1,3}|ESR))+')", ["left(t[1], 2)", "t[1]", "t[2]", "t[3]", "t[4]", "t[5]", "array_to_string(t[6:coalesce(at_iso - 3, n)], ' ')", "coalesce(array_to_string(t[at_iso - 2:n], ' '), '')"]),
    "Aircraft Rotables Report": (
        r"n >= 7 AND regexp_full_match(t[1], '\d{2}-\d{2}') AND regexp_full_match(t[n], '\d+') AND regexp_full_match(t[n - 2], '\d{1,2}\.[A-Za-z]{3}\.\d{4}')",
        ["t[1]", "t[2]", *[f"CASE WHEN regexp_full_match(t[n - 3], '\\d{{1,2}}\\.[A-Za-z]{{3}}\\.\\d{{4}}') THEN {a} ELSE {b} END" for a, b in ((_BETWEEN.format(3, 6), _BETWEEN.format(3, 5)), ("t[n - 5]", "t[n - 4]"), ("t[n - 4]", "t[n - 3]"), ("t[n - 3]", "''"))], "t[n - 2]", "t[n - 1]", "t[n]"],
    ),
    "OCCM Status (IGO)": (f"n >= 10 AND {_CHAPTER}", ["t[1]", "t[2]", "t[3]", _BETWEEN.format(4, 6), "t[n - 5]", "t[n - 4]", "t[n - 3]", "t[n - 2]", "t[n - 1]", "t[n]"]),
    "Iberia Listado OCCM": (
        r"n >= 5 AND regexp_full_match(t[1], '\d{2}-\d{2}')",
        ["t[1]", "t[2]", *[f"CASE WHEN n >= 9 AND regexp_full_match(t[n - 2], '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN {a} ELSE {b} END" for a, b in ((_BETWEEN.format(3, 6), _BETWEEN.format(3, 2)), ("t[n - 5]", "t[n - 1]"), ("t[n - 4]", "t[n]"), ("t[n - 3]", "''"), ("t[n - 2]", "''"), ("t[n - 1]", "''"), ("t[n]", "''"))]],
    ),
    "A330 Engineering Planning OCCM": (f"n >= 12 AND {_CHAPTER} AND at_dmy >= 6", ["t[1]", "t[2]", "t[3]", "array_to_string(t[4:at_dmy - 3], ' ')", *[f"t[at_dmy + {i}]" for i in (-2, -1, 0, 1, 2, 3, 4, 5, 6)]]),
    "AMOS": ("at_slash >= 5", ["coalesce(section, '')", "t[1]", "t[2]", "CASE WHEN t[at_slash - 2] = '30HQ' THEN array_to_string(t[3:at_slash - 3], ' ') ELSE array_to_string(t[3:at_slash - 2], ' ') END", "CASE WHEN t[at_slash - 2] = '30HQ' THEN '30HQ' ELSE '' END", "array_to_string(t[at_slash - 1:at_slash + 1], ' ')", "t[at_slash + 2]", "t[at_slash + 3]", "t[at_slash + 4]"]),
    "AerCap Hard Time Component Status": (r"carried IS NOT NULL AND (main IS NOT NULL OR regexp_matches(line, '\d{1,2}-[A-Za-z]{3}-\d{2,4}'))", ["left(carried, 2)", "substr(carried, 3)", "CASE WHEN main IS NOT NULL THEN array_to_string(t[2:n], ' ') ELSE array_to_string(t, ' ') END"]),
}

SQL = {
    "format_routes": f"""WITH {_sql_printed()} SELECT CASE WHEN variant IN ('Vietnam Airlines', 'e.MES Hard Time Component Status', 'AerCap Hard Time Component Status') THEN 'HT' WHEN variant = 'Unknown' THEN 'Unknown' ELSE 'OCCM' END AS sheet_type,
      variant, CASE WHEN variant <> 'Unknown' THEN '' WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.3 * length(regexp_replace(text, '\\s', '', 'g')) THEN 'garbled_encoding' ELSE 'no_signature_match' END AS diagnosis, count(*) AS documents FROM r GROUP BY 1, 2, 3""",
    "format_records": rf"""WITH {_sql_printed()}, l AS (SELECT doc_id, variant, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM r WHERE variant <> 'Unknown'),
      k AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS t FROM l), n AS (SELECT *, len(t) AS n, list_position(t, 'A321') AS at_a321, list_position(t, '/') AS at_slash,
        nullif(len(list_filter(list_transform(t, lambda x, i: CASE WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}') THEN i END), lambda x: x IS NOT NULL)), 0) AS isos,
        list_min(list_transform(t, lambda x, i: CASE WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}') THEN i END)) AS at_iso, list_min(list_transform(t, lambda x, i: CASE WHEN regexp_full_match(x, '\d{{1,2}}-[A-Za-z]{{3}}-\d{{2,4}}') THEN i END)) AS at_dmy,
        CASE WHEN regexp_matches(line, '^\d{{2}}(-\d{{2}}){{0,2}} +[A-Z][A-Z &/,-]*[A-Z] +\S.+$') THEN t[1] END AS head, CASE WHEN regexp_full_match(t[1], '\d{{4}}-\d{{1,3}}-\d{{2}}(\([A-Za-z]+\))?') AND TRY_CAST(left(t[1], 2) AS INTEGER) BETWEEN 20 AND 83 THEN t[1] END AS main FROM k),
      c AS (SELECT *, last_value(head IGNORE NULLS) OVER w AS section, last_value(main IGNORE NULLS) OVER w AS carried FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
      SELECT doc_id, line_no, variant, CASE variant {" ".join(f"WHEN '{v}' THEN concat_ws('|', {', '.join(cells)})" for v, (_, cells) in _READ.items())} END AS cells
      FROM c WHERE CASE variant {" ".join(f"WHEN '{v}' THEN {ok}" for v, (ok, _) in _READ.items())} ELSE FALSE END""",
}
