"""Word lists that decide results, in their order of precedence."""

NAME_PREFIXES = (
    "department ", "university ", "mr ", "mr. ", "mrs ", "mrs. ", "miss ", "miss. ", "lord ", "lord. ", "lady ", "lady. ",
)
NAME_SUFFIXES = (
    " agency", " limited", " charities", " ltd", " plc", " school", " corporation", " university", " and sons", " water board",
    " users", " estate", " quarry", " nurseries", " esq.", " esq", " and son", " and partners", " farms",
)
ADDRESS_SUFFIXES = (" road", " lane", " avenue", " street")
AGENCY_PHRASES = ("hereinafter", "grants this", "a agency")
NAME_WORDS = ("trading as",)
SHORT_WORDS = ("a", "a,", "b,", "c,", "d,", "e,", "of", "to", "be")
FIRST_NAME_STOPS = (
    "the", "po", "mersey", "june", "charity", "grant", "manor", "red", "south", "north", "west", "rho", "rivers", "see", "heh", "you", "thames",
)
PREFERRED_SPELLINGS = ("Mid", "Central", "North", "South", "Ltd", "Farm", "Farms")
UNITS = ("megalitres", "litres", "cubic metres", "megagallons", "thousand gallons", "million gallons", "gallons")
ISSUER = "The Environment Agency"
