"""The curated brands: (brand, generic, aliases, strength, form, components). Fixed values."""

from __future__ import annotations

# Fixed values.
BRANDS = [
    ("Dolo 650", "Paracetamol", ["dolo", "dolo650", "dolo 650", "dolo-650"], "650mg", "tablet", []),
    ("Crocin 650", "Paracetamol", ["crocin", "crocin650", "crocin 650", "crocin-650", "crocin advance"], "650mg", "tablet", []),
    ("Calpol 500", "Paracetamol", ["calpol", "calpol500", "calpol 500", "calpol-500"], "500mg", "tablet", []),
    ("Calpol Syrup", "Paracetamol", ["calpol syrup", "calpol susp"], "250mg/5ml", "syrup", []),
    ("Meftal", "Mefenamic Acid", ["meftal", "meftal 250"], "250mg", "tablet", []),
    ("Meftal-P", "Mefenamic Acid + Paracetamol", ["meftal p", "meftalp", "meftal-p"], "250mg + 325mg", "tablet", [(250.0, "mg", "Mefenamic Acid"), (325.0, "mg", "Paracetamol")]),
    ("Combiflam", "Ibuprofen + Paracetamol", ["combiflam"], "400mg + 325mg", "tablet", [(400.0, "mg", "Ibuprofen"), (325.0, "mg", "Paracetamol")]),
    ("Augmentin 625", "Amoxicillin + Clavulanic Acid", ["augmentin", "augmentin625", "augmentin 625", "augmentin-625"], "500mg + 125mg", "tablet", [(500.0, "mg", "Amoxicillin"), (125.0, "mg", "Clavulanic Acid")]),
    ("Azithral 500", "Azithromycin", ["azithral", "azithral500", "azithral 500", "azithral-500"], "500mg", "tablet", []),
    ("Zifi 200", "Cefixime", ["zifi", "zifi200", "zifi 200", "zifi-200"], "200mg", "tablet", []),
    ("Allegra 120", "Fexofenadine", ["allegra", "allegra120", "allegra 120", "allegra-120"], "120mg", "tablet", []),
    ("Pan 40", "Pantoprazole", ["pan", "pan40", "pan 40", "pan-40"], "40mg", "tablet", []),
    ("Pantocid 40", "Pantoprazole", ["pantocid", "pantocid40", "pantocid 40", "pantocid-40"], "40mg", "tablet", []),
    ("Amlopres 5", "Amlodipine", ["amlopres", "amlopres5", "amlopres 5", "amlopres-5"], "5mg", "tablet", []),
    ("Telma 40", "Telmisartan", ["telma", "telma40", "telma 40", "telma-40"], "40mg", "tablet", []),
    ("Glycomet 500", "Metformin", ["glycomet", "glycomet500", "glycomet 500", "glycomet-500"], "500mg", "tablet", []),
    ("Januvia 100", "Sitagliptin", ["januvia", "januvia100", "januvia 100", "januvia-100"], "100mg", "tablet", []),
]
