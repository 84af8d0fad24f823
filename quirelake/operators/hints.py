"""Who a document is of, by hints: names in the file's name and the text, and the country of a registration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import blank

# Words of names, in the order they are looked for, and whom they name; empty names nobody.
NAME_HINTS = (("AEROFLOT", "Aeroflot"), ("VOLARIS", "Volaris"), ("VIETNAM", "Vietnam Airlines"), ("VNA", "Vietnam Airlines"), ("CHINA EASTERN", "China Eastern"), ("EASTERN", "China Eastern (?)"), ("MSN", ""))
# A registration in a file's name, and the countries of registrations' prefixes.
REGISTRATION = r"\b([A-Z]{1,2})-?([A-Z0-9]{3,4})\b"
COUNTRIES = {
    "ZK": "New Zealand", "VH": "Australia", "G": "United Kingdom", "D": "Germany", "F": "France", "I": "Italy", "VP": "Bermuda/Cayman", "VQ": "Bermuda/Cayman", "EI": "Ireland", "OK": "Czech", "SP": "Poland", "HA": "Hungary", "YR": "Romania",
    "LZ": "Bulgaria", "OO": "Belgium", "PH": "Netherlands", "SX": "Greece", "TC": "Turkey", "UR": "Ukraine", "RA": "Russia", "B": "China/Taiwan", "VT": "India", "9V": "Singapore", "HL": "South Korea", "JA": "Japan", "9M": "Malaysia",
    "HS": "Thailand", "VN": "Vietnam", "PK": "Indonesia", "RP": "Philippines", "ZS": "South Africa", "ET": "Ethiopia", "N": "USA", "C": "Canada", "XA": "Mexico", "PR": "Brazil", "PT": "Brazil",
}
BETWEEN = " · "


def operator_hint(filename: Column, text: Column, names: tuple[tuple[str, str], ...] = NAME_HINTS, countries: dict[str, str] = COUNTRIES) -> Column:
    """Hints joined in order, each once: names in the file's name, its registration's country, names in the text; else empty.

    Nulls are empty. Names are found whatever their case, a registration in capitals only, the first in the name.
    """

    def named(c: Column) -> Column:
        upper = F.upper(blank(c))
        return F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(word)), name) for word, name in names if word and name]))

    prefix = F.regexp_extract(blank(filename), REGISTRATION, 1)
    table = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])
    country = F.try_element_at(table, prefix)
    registered = F.array_compact(F.array(F.when(country.isNotNull(), F.concat(F.lit("reg:"), prefix, F.lit("="), country))))
    return F.array_join(F.array_distinct(F.concat(named(filename), registered, named(text))), BETWEEN)
