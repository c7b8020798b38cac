"""Default dimension data. Every operator takes these as arguments, so a user's own
tables replace them without code changes."""

# Slug-line prefixes, tested in this order (long spellings first).
LOCATION_PREFIXES = (
    ("INT./EXT.", "INT/EXT"),
    ("INT/EXT.", "INT/EXT"),
    ("I./E.", "INT/EXT"),
    ("I/E.", "INT/EXT"),
    ("EXT./INT.", "INT/EXT"),
    ("EXT/INT.", "INT/EXT"),
    ("INNEN/AUSSEN", "INT/EXT"),
    ("AUSSEN/INNEN", "INT/EXT"),
    ("INT.", "INT"),
    ("INNEN", "INT"),
    ("I.", "INT"),
    ("EXT.", "EXT"),
    ("AUSSEN", "EXT"),
    ("E.", "EXT"),
)

# Time words (English, German) and the value they stand for.
TIME_WORDS = {
    "DAY": "DAY",
    "NIGHT": "NIGHT",
    "DAWN": "DAWN",
    "DUSK": "DUSK",
    "MORNING": "MORNING",
    "EVENING": "EVENING",
    "CONTINUOUS": "CONTINUOUS",
    "CONT": "CONTINUOUS",
    "LATER": "CONTINUOUS",
    "SAME": "CONTINUOUS",
    "MOMENTS LATER": "CONTINUOUS",
    "TAG": "DAY",
    "NACHT": "NIGHT",
    "MORGEN": "MORNING",
    "MORGENS": "MORNING",
    "ABEND": "EVENING",
    "ABENDS": "EVENING",
    "DÄMMERUNG": "DUSK",
    "DAEMMERUNG": "DUSK",
    "MORGENDÄMMERUNG": "DAWN",
    "FORTLAUFEND": "CONTINUOUS",
    "SPÄTER": "CONTINUOUS",
    "SPAETER": "CONTINUOUS",
}

# Spellings that open a scene in running text.
SCENE_MARKERS = (
    "INT./EXT.",
    "INT/EXT.",
    "EXT./INT.",
    "EXT/INT.",
    "INT.",
    "EXT.",
    "INNEN/AUSSEN",
    "AUSSEN/INNEN",
    "INNEN",
    "AUSSEN",
)

# Of these, the ones that allow blanks around their slash, and the ones that
# need a dot or a blank after the word.
SLASH_MAY_BE_SPACED = ("INT./EXT.", "EXT./INT.", "INNEN/AUSSEN", "AUSSEN/INNEN")
WORD_MUST_END = ("INNEN", "AUSSEN")

# Demonstration taxonomy, our own wording: (category, class, rule id, description).
RISK_CLASSES = (
    ("PHYSICAL", "FIRE", "PHY-01", "open flame, pyrotechnics or heat near people"),
    ("PHYSICAL", "WATER", "PHY-02", "work in, on or under water"),
    ("PHYSICAL", "HEIGHT", "PHY-03", "work above ground level"),
    ("PHYSICAL", "VEHICLES", "PHY-04", "moving vehicles with people close by"),
    ("PHYSICAL", "WEAPONS", "PHY-05", "real or replica weapons in use"),
    ("PHYSICAL", "ANIMALS", "PHY-06", "animals handled during the take"),
    ("ENVIRONMENTAL", "TIGHT_SPACE", "ENV-01", "narrow or closed rooms"),
    ("ENVIRONMENTAL", "NOISE", "ENV-02", "sound levels that need ear protection"),
    ("PSYCHOLOGICAL", "GRIEF", "PSY-01", "scenes about loss and mourning"),
    ("PSYCHOLOGICAL", "INTIMACY", "PSY-02", "close physical contact or nudity"),
)

# Demonstration measures, our own wording: (code, title, responsible, due, classes).
MEASURES = (
    ("FIRE-WATCH", "Fire watch with extinguishers on stand-by", "Effects lead", "day-5", ("FIRE",)),
    ("DIVE-TEAM", "Rescue divers and warm-up area", "Safety officer", "day-3", ("WATER",)),
    ("FALL-ARREST", "Harness, anchor points and rescue plan", "Rigging lead", "day-3", ("HEIGHT",)),
    ("ROUTE-CLOSE", "Closed route and vehicle inspection", "Transport lead", "day-2", ("VEHICLES",)),
    ("ARMOURER", "Armourer present, every weapon inspected", "Armourer", "day-1", ("WEAPONS",)),
    ("HANDLER", "Qualified handler and rest periods", "Animal handler", "day-2", ("ANIMALS",)),
    ("AIR-CHECK", "Air quality and exit check", "Safety officer", "day-1", ("TIGHT_SPACE", "FIRE")),
    ("EAR-CARE", "Hearing protection for everyone on set", "Safety officer", "day-1", ("NOISE", "WEAPONS")),
    ("COUNSEL", "Briefing and a contact for counselling", "Production", "day-4", ("GRIEF", "INTIMACY")),
    ("CLOSED-SET", "Closed set with an intimacy coordinator", "Production", "day-4", ("INTIMACY",)),
    ("PRE-BRIEF", "General safety briefing before the first take", "Safety officer", "day-1",
     ("FIRE", "WATER", "HEIGHT", "VEHICLES", "WEAPONS", "ANIMALS")),
)

# Demonstration keyword rules: (term, class, likelihood, impact).
KEYWORDS = (
    ("fire", "FIRE", 4, 4),
    ("flames", "FIRE", 4, 5),
    ("water", "WATER", 3, 3),
    ("river", "WATER", 3, 4),
    ("roof", "HEIGHT", 3, 5),
    ("ladder", "HEIGHT", 2, 3),
    ("car", "VEHICLES", 3, 4),
    ("truck", "VEHICLES", 3, 5),
    ("gun", "WEAPONS", 3, 5),
    ("knife", "WEAPONS", 3, 4),
    ("dog", "ANIMALS", 2, 2),
    ("horse", "ANIMALS", 3, 3),
    ("tunnel", "TIGHT_SPACE", 2, 4),
    ("siren", "NOISE", 2, 2),
    ("funeral", "GRIEF", 3, 2),
    ("kiss", "INTIMACY", 2, 2),
)
