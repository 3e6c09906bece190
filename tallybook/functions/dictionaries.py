"""Keyword dictionaries by which stories are classified."""

# Categories of the batch run with their keywords, in the order that decides between equal scores.
BATCH_CATEGORIES = {
    "PUBLIC MONEY": [
        "bbmp scam", "bbmp fraud", "crore misuse", "crore irregularit", "siphon", "fake bill", "ghost worker", "pourakarmika scam", "embezzl", "misappropriat",
        "disproportionate asset", "lokayukta raid", "acb raid", "ed raid bbmp", "corruption bbmp", "gba scam", "gba fraud",
    ],
    "ROAD SAFETY": ["pothole death", "pothole accident", "road death bengaluru", "road accident bbmp", "pedestrian death", "pedestrian killed", "road fatality", "road crash bengaluru"],
    "CONTRACTORS": ["kridl", "blacklisted contractor", "contractor scam", "tender scam", "4(g)", "without tender", "contractor fraud", "work order irregularit"],
    "ENVIRONMENT": [
        "lake encroach", "lake pollut", "sewage lake", "untreated sewage", "lake dead fish", "bellandur", "varthur", "foam lake", "kspcb action", "ngt bengaluru", "tree fell",
        "tree cut illegal", "green cover",
    ],
    "BUDGET": ["bbmp budget unspent", "bbmp budget gap", "gba budget", "fund unutilized", "budget allocation bbmp", "fiscal deficit bbmp"],
    "ELECTED REPS": ["mla criminal", "mla arrested", "corporator arrested", "mla assets", "mla attendance", "ward committee", "council meeting"],
    "WATER": ["bwssb", "water shortage", "water crisis bengaluru", "cauvery water", "borewell dry", "water supply bengaluru", "water tanker mafia"],
    "WASTE": ["garbage crisis", "waste management bbmp", "landfill", "solid waste", "garbage contractor", "waste processing", "black spot"],
}

# The same for the feed that is refreshed by the hour.
FEED_CATEGORIES = {
    "PUBLIC MONEY": [
        "bbmp scam", "bbmp fraud", "crore misuse", "crore irregularit", "siphon", "fake bill", "ghost worker", "pourakarmika scam", "embezzl", "misappropriat", "lokayukta raid",
        "acb raid", "ed raid bbmp", "corruption bbmp", "gba scam",
    ],
    "ROAD SAFETY": ["pothole", "road death", "road accident", "pedestrian death", "pedestrian killed", "road fatality", "road crash", "cave in", "cave-in", "road damage", "footpath broken", "signal broken"],
    "CONTRACTORS": ["kridl", "blacklisted contractor", "contractor scam", "tender scam", "4(g)", "without tender", "contractor fraud", "bbmp contractor"],
    "ENVIRONMENT": [
        "lake encroach", "lake pollut", "sewage", "untreated sewage", "lake dead fish", "bellandur foam", "kspcb action", "ngt bengaluru", "tree fell", "tree cut illegal", "sewage overflow",
    ],
    "BUDGET": ["bbmp budget", "gba budget", "fund unutilized", "budget allocation", "unspent fund"],
    "ELECTED REPS": ["mla criminal", "mla arrested", "corporator arrested", "mla assets", "mla attendance", "corporator complaint"],
    "WATER": ["bwssb", "water shortage", "water crisis", "cauvery water", "borewell dry", "water tanker", "water supply", "water problem", "water cut"],
    "WASTE": ["garbage", "waste management", "landfill", "solid waste", "garbage contractor", "waste pickup", "trash"],
    "POWER": ["bescom", "power cut", "power outage", "electricity", "transformer"],
}

# Categories of the hourly feed that are shown in red.
RED_CATEGORIES = ["PUBLIC MONEY", "ROAD SAFETY", "CONTRACTORS", "ELECTED REPS", "POWER"]
