"""Country spelling variants merged by the dashboards.

Fixed values: each mapping is written as in the source statements it serves, as
(variant spellings) -> standard name.  Different statements merge different sets,
so every query names the mapping it uses.
"""

# The user dimension merges Spain and Brazil spellings.
COUNTRY_MAP_DIM_USER = {
    "Spain": ("España", "Spain"),
    "Brazil": ("Brasil", "Brazil"),
}

# The country KPI table merges Spain and Germany spellings.
COUNTRY_MAP_SPAIN_GERMANY = {
    "Spain": ("España", "Spain"),
    "Germany": ("Deutschland", "Germany"),
}

# The user-base and final country tables rename Deutschland only.
COUNTRY_MAP_GERMANY_ONLY = {
    "Germany": ("Deutschland",),
}
