"""Place-name rules for location standardization."""

from __future__ import annotations

# Normalized names that mark a posting as overseas.
OVERSEAS_COUNTRIES: tuple[str, ...] = (
    "new zealand", "australia", "canada", "united states", "usa",
    "united states of america", "uk", "united kingdom", "great britain",
    "japan", "singapore", "hong kong", "hongkong", "taiwan",
    "taiwan, r.o.c.", "taiwan roc", "south korea", "korea", "germany",
    "saudi arabia", "united arab emirates", "uae", "qatar", "kuwait",
    "bahrain", "oman", "dubai", "abu dhabi", "riyadh", "jeddah",
    "malaysia", "brunei", "italy", "spain", "ireland", "netherlands",
    "poland", "israel", "cyprus", "greece", "china", "vietnam",
    "thailand", "indonesia", "papua new guinea", "papaua new guinea",
    "micronesia", "micronesia(federated states of)",
    "micronesia (federated states of)", "mongolia", "slovakia",
    "hungary", "finland", "lithuania", "morocco", "guyana", "cambodia",
    "myanmar", "fiji", "france", "switzerland", "norway", "sweden",
    "denmark", "austria", "portugal", "russia", "turkey", "egypt",
    "libya", "nigeria", "south africa", "india", "pakistan",
    "bangladesh", "sri lanka", "mexico", "brazil", "chile", "argentina",
    "papua new guinea (independent state of)",
)

# Continents name no single country.
OVERSEAS_CONTINENTS: tuple[str, ...] = (
    "europe", "middle east", "asia", "africa", "oceania",
    "north america", "south america",
)

# Official region descriptions and the short names reported for them.
REGION_SHORT_NAMES: dict[str, str] = {
    "Region I (Ilocos Region)": "Ilocos Region",
    "Region II (Cagayan Valley)": "Cagayan Valley",
    "Region III (Central Luzon)": "Central Luzon",
    "Region IV-A (CALABARZON)": "CALABARZON",
    "Region V (Bicol Region)": "Bicol Region",
    "Region VI (Western Visayas)": "Western Visayas",
    "Region VII (Central Visayas)": "Central Visayas",
    "Region VIII (Eastern Visayas)": "Eastern Visayas",
    "Region IX (Zamboanga Peninsula)": "Zamboanga Peninsula",
    "Region X (Northern Mindanao)": "Northern Mindanao",
    "Region XI (Davao Region)": "Davao Region",
    "Region XII (SOCCSKSARGEN)": "SOCCSKSARGEN",
    "National Capital Region (NCR)": "NCR",
    "Cordillera Administrative Region (CAR)": "Cordillera Administrative Region",
    "Autonomous Region in Muslim Mindanao (ARMM)": "ARMM",
    "Region XIII (Caraga)": "Caraga",
    "MIMAROPA Region": "MIMAROPA",
}

# Fixed value: code prefix of the capital region, whose cities are listed as provinces.
CAPITAL_REGION_PREFIX = "13"
CAPITAL_REGION = "NCR"

# Renamed regions; applied only on request (``fix_regions=True``).
RENAMED_REGIONS: dict[str, str] = {"armm": "BARMM"}

UNKNOWN = "Unknown"
REMOTE = "Remote"
OVERSEAS = "Overseas"
OVERSEAS_UNSPECIFIED = "Overseas (Unspecified)"
AMBIGUOUS = "Ambiguous"
