"""Jurisdiction of a name: ordered legal-form patterns, then country names, first match wins."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strandline.functions.names import trimmed
from strandline.functions.patterns import Ordered

# Country names by ISO 3166-1 alpha-2 code.
COUNTRIES = {
    "US": "United States", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "IT": "Italy", "NL": "Netherlands",
    "AU": "Australia", "JP": "Japan", "CA": "Canada", "MX": "Mexico", "SE": "Sweden", "DK": "Denmark", "NO": "Norway",
    "FI": "Finland", "CH": "Switzerland", "AT": "Austria", "BE": "Belgium", "ES": "Spain", "PT": "Portugal", "IE": "Ireland",
    "BR": "Brazil", "AR": "Argentina", "CL": "Chile", "CO": "Colombia", "IN": "India", "CN": "China", "HK": "Hong Kong",
    "SG": "Singapore", "KR": "South Korea", "TW": "Taiwan", "TH": "Thailand", "MY": "Malaysia", "PH": "Philippines",
    "ID": "Indonesia", "NZ": "New Zealand", "ZA": "South Africa", "IL": "Israel", "AE": "United Arab Emirates",
    "SA": "Saudi Arabia", "RU": "Russia", "PL": "Poland", "CZ": "Czech Republic", "HU": "Hungary", "RO": "Romania",
    "TR": "Turkey", "LU": "Luxembourg", "KY": "Cayman Islands", "BM": "Bermuda", "VG": "British Virgin Islands", "PA": "Panama",
    "PR": "Puerto Rico", "BS": "Bahamas", "BB": "Barbados", "JE": "Jersey", "GG": "Guernsey", "IM": "Isle of Man",
    "LI": "Liechtenstein", "MC": "Monaco", "MT": "Malta", "CY": "Cyprus", "GR": "Greece", "NG": "Nigeria", "KE": "Kenya",
    "EG": "Egypt", "CW": "Curacao", "MU": "Mauritius", "PE": "Peru", "VE": "Venezuela", "CR": "Costa Rica",
    "DO": "Dominican Republic", "GT": "Guatemala", "EC": "Ecuador", "UY": "Uruguay", "HR": "Croatia", "SK": "Slovakia",
    "BG": "Bulgaria", "RS": "Serbia", "UA": "Ukraine", "LT": "Lithuania", "LV": "Latvia", "EE": "Estonia", "SI": "Slovenia",
    "IS": "Iceland", "VN": "Vietnam", "PK": "Pakistan", "BD": "Bangladesh", "LK": "Sri Lanka", "MM": "Myanmar", "KH": "Cambodia",
}
# Legal forms in the order in which they are tried.
LEGAL_FORMS = (
    (r"\bS\.\s*de\s*R\.L\.\s*de\s*C\.V\.", "MX"), (r"\bS\.\s*de\s*R\.L\.", "MX"), (r"\bS\.A\.\s*de\s*C\.V\.", "MX"),
    (r"\bK\.K\.\s*$", "JP"), (r"\bKabushiki\s+Kaisha\b", "JP"), (r"\bYugen\s+Kaisha\b", "JP"), (r"\bGodo\s+Kaisha\b", "JP"),
    (r"\bS\.r\.l\.", "IT"), (r"\bS\.p\.A\.", "IT"),
    (r"\bS\.A\.S\.\s*$", "FR"), (r"\bS\.A\.S\.\b", "FR"), (r"\bS\.A\.R\.L\.", "FR"), (r"\bS\.C\.A\.\b", "FR"), (r"\bS\.N\.C\.\b", "FR"),
    (r"\bB\.V\.\s*$", "NL"), (r"\bB\.V\.\b", "NL"), (r"\bN\.V\.\s*$", "NL"), (r"\bN\.V\.\b", "NL"),
    (r"\bGmbH\s*&\s*Co\.\s*KG\b", "DE"), (r"\bGmbH\b", "DE"), (r"\bAktiengesellschaft\b", "DE"), (r"\bAG\s*$", "DE"), (r"\bKG\b", "DE"), (r"\be\.V\.\b", "DE"),
    (r"\bPty\.?\s+Ltd\.?\s*$", "AU"), (r"\bPty\.?\s+Limited\s*$", "AU"), (r"\bPty\b", "AU"),
    (r"\bPLC\s*$", "GB"), (r"\bP\.L\.C\.\s*$", "GB"), (r"\bLimited\s*$", "GB"), (r"\bLtd\.?\s*$", "GB"), (r"\bLLP\s*$", "GB"),
    (r"\bA/S\s*$", "DK"), (r"\bApS\s*$", "DK"), (r"\bAB\s*$", "SE"), (r"\bASA\s*$", "NO"), (r"\bAS\s*$", "NO"), (r"\bOy\s*$", "FI"), (r"\bOyj\s*$", "FI"),
    (r"\bS\.L\.\s*$", "ES"), (r"\bS\.L\.U\.\s*$", "ES"), (r"\bLda\.\s*$", "PT"), (r"\bLtda\.?\s*$", "BR"), (r"\bS/A\b", "BR"),
    (r"\bCo\.,?\s*Ltd\.?\b.*(?:Korea|Seoul)", "KR"), (r"\bPvt\.?\s+Ltd\.?\b", "IN"), (r"\bPrivate\s+Limited\b", "IN"), (r"\bPte\.?\s+Ltd\.?\b", "SG"),
    (r"\bCo\.,?\s*Ltd\.?\b.*Hong\s*Kong", "HK"), (r"\bDAC\s*$", "IE"), (r"\bULC\s*$", "IE"), (r"\bS\.a\.r\.l\.\b", "LU"), (r"\bS\.\s*[àa]\s*r\.l\.\b", "LU"),
    (r"\bSPRL\b", "BE"), (r"\bBVBA\b", "BE"), (r"\bSp\.\s*z\s*o\.o\.\b", "PL"), (r"\bs\.r\.o\.\b", "CZ"), (r"\ba\.s\.\s*$", "CZ"),
    (r"\bKft\.\s*$", "HU"), (r"\bZrt\.\s*$", "HU"), (r"\bNyrt\.\s*$", "HU"), (r"\bA\.S\.\s*$", "TR"), (r"\bS\.R\.L\.\b", "RO"),
    (r"\bInc\.?\s*$", "US"), (r"\bIncorporated\s*$", "US"), (r"\bCorp\.?\s*$", "US"), (r"\bCorporation\s*$", "US"), (r"\bLLC\s*$", "US"), (r"\bL\.L\.C\.\s*$", "US"),
    (r"\bLP\s*$", "US"), (r"\bL\.P\.\s*$", "US"), (r"\bNA\s*$", "US"), (r"\bN\.A\.\s*$", "US"), (r"\bULC\b.*(?:Canada|Alberta|Ontario)", "CA"),
)
# Other names of countries.
ALIASES = {
    "u.s.": "US", "usa": "US", "u.s.a.": "US", "uk": "GB", "u.k.": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "great britain": "GB", "holland": "NL", "nippon": "JP", "prc": "CN", "mainland china": "CN", "republic of korea": "KR",
    "uae": "AE", "deutschland": "DE", "espana": "ES", "españa": "ES", "italia": "IT", "brasil": "BR", "svizzera": "CH",
    "schweiz": "CH", "suisse": "CH", "norge": "NO", "sverige": "SE", "danmark": "DK", "suomi": "FI", "osterreich": "AT",
    "österreich": "AT", "belgique": "BE", "czech": "CZ", "cayman": "KY", "bvi": "VG", "curaçao": "CW",
}
# States in the order in which they are looked for.
STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia",
    "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland",
    "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire",
    "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania",
    "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington",
    "West Virginia", "Wisconsin", "Wyoming", "District of Columbia",
)


def country_names() -> list[tuple[str, str]]:
    """Lower-cased names and aliases with their codes, longest first, listed order among equal lengths."""
    every = {name.lower(): code for code, name in COUNTRIES.items()} | ALIASES
    return sorted(every.items(), key=lambda x: -len(x[0]))


def detect_us_state(name: Column) -> Column:
    """The first listed state whose name occurs anywhere ("west virginia" holds "virginia"); null if none does."""
    low = F.lower(name)
    return F.get(F.filter(F.array(*map(F.lit, STATES)), lambda s: low.contains(F.lower(s))), F.lit(0))


@cache
def _automaton() -> Ordered:
    """Once a worker."""
    return Ordered(LEGAL_FORMS, country_names())


@pandas_udf(StringType())
def _codes(names: pd.Series) -> pd.Series:
    find = _automaton().first
    return names.map(find, na_action="ignore").astype(object)


def country_code(name: Column) -> Column:
    """Code of the first legal form that matches, else of the longest country name that occurs; null if none does.

    All forms and names are looked for in one pass; as a chain of expressions they would be
    some two hundred patterns for every name.
    """
    return _codes(trimmed(name))


def country_name(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code)


def parse_geography(name: Column) -> Column:
    """struct(country_code, country_name, jurisdiction), null where nothing matches."""
    code = country_code(name)
    state = F.when(code == "US", detect_us_state(name))
    return F.when(code.isNotNull(), F.struct(code.alias("country_code"), country_name(code).alias("country_name"), state.alias("jurisdiction")))
