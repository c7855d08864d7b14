"""Word lists and tables that results depend on. Fixed values, in their natural order."""

from __future__ import annotations

# Spelling of a unit -> unit.
UNITS = {
    "mg": "mg", "milligram": "mg", "milligrams": "mg",
    "mcg": "mcg", "microgram": "mcg", "micrograms": "mcg", "ug": "mcg",
    "g": "g", "gm": "g", "gram": "g", "grams": "g",
    "ml": "ml", "milliliter": "ml", "millilitre": "ml", "milliliters": "ml",
    "l": "l", "litre": "l", "liter": "l",
    "iu": "iu",
    "%": "%",
}

# Spelling of a dosage form -> form.
FORMS = {
    "tab": "tablet", "tabs": "tablet", "tablet": "tablet", "tablets": "tablet",
    "cap": "capsule", "caps": "capsule", "capsule": "capsule", "capsules": "capsule",
    "syp": "syrup", "syr": "syrup", "syrup": "syrup",
    "inj": "injection", "injection": "injection", "injections": "injection",
    "susp": "suspension", "suspension": "suspension",
    "drop": "drops", "drops": "drops",
    "oint": "ointment", "ointment": "ointment",
    "gel": "gel", "cream": "cream", "lotion": "lotion", "spray": "spray",
}

# Shapes that handwriting confuses, (read, meant), in the order in which variants are made.
OPTICAL_PAIRS = [("m", "n"), ("n", "m"), ("1", "l"), ("0", "o"), ("5", "s"), ("q", "g"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("i", "y"), ("y", "i"), ("k", "b"), ("b", "k")]

# Characters that OCR confuses.
CHARACTER_CONFUSIONS = {"0": ["o"], "o": ["0"], "1": ["i", "l"], "i": ["1", "l"], "l": ["1", "i"], "5": ["s"], "s": ["5"], "8": ["b"], "b": ["8"]}

# Abbreviation -> frequency, in the order in which they are looked for.
FREQUENCIES = {
    "OD": "Once Daily", "BD": "Twice Daily", "BID": "Twice Daily", "TDS": "Thrice Daily", "TID": "Thrice Daily",
    "QID": "Four Times Daily", "HS": "At Bedtime", "SOS": "When Required", "STAT": "Immediately",
    "AC": "Before Meals", "PC": "After Meals", "PRN": "When Required", "BBF": "Before Breakfast",
    "AFTER FOOD": "After Meals", "BEFORE FOOD": "Before Meals",
}
#: Of these, the ones that tell a time and not how often.
MEAL_PHRASES = ("AFTER FOOD", "BEFORE FOOD")

# Words that never begin a name on a page.
STOPWORDS = [
    "name", "address", "tablet", "take", "with", "hospital", "hospitals", "days", "day", "tab", "cap", "one", "two", "three", "four", "sig", "temp",
    "capsule", "syr", "syrup", "drop", "drops", "inj", "injection", "the", "and", "for", "after", "before", "food", "water", "morning", "night",
    "evening", "daily", "dose", "oral", "once", "twice", "times", "week", "weeks", "month", "months", "dr", "doctor", "consultant", "patient", "male",
    "female", "years", "yrs", "date", "time", "uhid", "reg", "appointment", "mobile", "online", "clinic", "department", "advice", "investigation",
    "weight", "height", "allergies", "diet", "diagnosis", "dale", "consullant", "mri", "brain", "plain", "teeth", "dental", "linked", "shelscar",
    "chandra", "lame", "make", "care", "your", "ichandra", "adddivision", "smokycope", "headnight", "gizzlant", "uchphysical", "doffaking", "among",
    "duegsie", "curs-t-f-o", "cpping", "violoing", "apms", "life", "lift", "several", "other", "diseases", "stairs", "instead", "former", "proper",
    "women", "school", "schools", "street", "streets", "protest", "protests", "terms", "announced", "experienced", "warranted", "princesses",
    "embassy", "emergency", "contact", "validity", "entries", "sign", "signature", "assessment", "record", "nationality", "religion", "student",
    "corporate", "treatment", "investigations", "clinical", "notes", "advised", "meditation", "exercises", "fruits", "vegetables", "fibre",
    "heaviness", "bloating", "nausea", "vomiting", "vomitings", "stools", "loss", "fever", "cough", "review", "candida", "effects", "mucas", "mucus",
    "srivathsa", "rivathsa", "kims", "medical", "as", "directed", "instructed",
]

# A line with one of these, in any case, is an advertisement.
AD_FRAGMENTS = [
    "horlicks", "apollo247", "apolloz4z", "exclusiveoffer", "1800-572", "orderwia", "whatsepp",
    "upto 70% off", "upto 25% off", "free delivery", "flat 15% cashback", "free lab test", "buy smart health",
    "get free 1 year", "shop now", "order now", "book now", "home delivery", "home sample", "circle plan",
    "page 1 of", "page 2 of",
]

# A line with one of these, or with one of the words, or a number of mg, ml or mcg, opens the medicine section.
SECTION_TRIGGERS = [" rx", "rx ", "r/", "treatment", "medicine", "medication", "adv:", "advise", "adv"]
SECTION_WORDS = ["tab", "cap", "syp", "inj", "ointment"]

# Form and route -> their names in the extraction contract.
CONTRACT_FORMS = {"tablet": "TABLET", "capsule": "CAPSULE", "syrup": "SYRUP", "injection": "INJECTION", "drops": "DROPS"}
CONTRACT_ROUTES = {"oral": "ORAL", "topical": "TOPICAL", "injection": "INJECTION", "inhaled": "INHALED", "ophthalmic": "OPHTHALMIC", "nasal": "NASAL"}
