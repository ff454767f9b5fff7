"""Word lists and tables that decide results."""

from __future__ import annotations

# Keywords are matched as substrings of lower-case labels (of ids, for military events).
TENSION_HIGH = ("sanction", "attack", "invade", "bomb", "missile", "strike", "kill", "threaten", "blockade", "terrorize")
TENSION_MEDIUM = ("restrict", "ban", "expel", "dispute", "tension", "pressure", "cyber", "confront")
TENSION_COOP = ("cooperate", "ally", "partner", "invest", "aid", "support", "trade", "treaty")
HOSTILE = (*TENSION_HIGH, *TENSION_MEDIUM, "war", "conflict")
COOPERATIVE = (*TENSION_COOP, "agreement", "join")
MILITARY = ("war", "battle", "strike", "military", "conflict", "invasion")
SCORE_HIGH, SCORE_MEDIUM, SCORE_COOP, SCORE_OTHER = 18.0, 9.0, -3.0, 2.0

ENTITY_CLASSES = ("country", "person", "organization", "technology", "event", "treaty", "resource")
RELATIONSHIP = "relationship"
ALERT_THRESHOLD = 75.0
FUZZY_THRESHOLD = 0.82
RESULT_CAP = 200

# Colours by tension (lower bounds, falling) and by group.
TENSION_COLOURS = ((75.0, "#ff2244"), (50.0, "#ff6b35"), (25.0, "#ffaa40"), (10.0, "#ffe066"))
TENSION_CALM = "#00ff88"
GROUP_UNKNOWN_COLOUR = "#8b949e"

# Ordered categories of labels, regular expressions on lower-case text; the first that matches counts.
TAXONOMY = (
    ("Conflict", "attack|invad|bomb|threaten|missile|kill|seize|blockade"),
    ("Coercive", "sanction|restrict|ban|expel|pressure|accuse"),
    ("Diplomatic", "negotiat|talk|summit|meet|ambassador|recognize"),
    ("Economic", "trade|invest|sanction|aid|loan|export|import"),
    ("Military Coop", "ally|joint exercise|arms|weapon|military aid|train"),
    ("Political", "support|endorse|elect|appoin|govern"),
)
# Canonical labels, likewise.
CANONICAL_LABELS = (
    ("sanctions", "sanction|imposed sanctions|economic sanctions|trade sanctions"),
    ("military invasion", "invad|military invasion|launched offensive"),
    ("military strike", "bomb|airstrike|shelling|missile strike"),
    ("diplomatic engagement", "diplomatic talks|negotiat|diplomacy|summit"),
    ("military support", "military aid|weapon supplies|arms transfer"),
    ("alliance", "ally|alliance|pact|treaty|military agreement"),
)
# Signs of prompt injection in lower-case text; the first six also make a line unsafe.
INJECTION = (
    r"ignore (all )?previous instructions",
    r"you are now",
    r"forget your (previous )?instructions",
    r"(system|assistant):\s",
    r"<\|.*?\|>",
    r"\[INST\]|\[/INST\]",
    r"###\s*(instruction|system|human|ai):",
    r"prompt\s*injection",
    r"bypass.*?(filter|safety|restriction)",
    r"act as if you are",
    r"new instruction:",
)
LINE_PATTERNS = 6
# Quality of news domains.
SOURCE_QUALITY = {"reuters.com": 0.9, "bbc.com": 0.88, "apnews.com": 0.9, "nytimes.com": 0.85, "theguardian.com": 0.82, "rt.com": 0.35, "t.me": 0.2}

# Name, latitude, longitude.
GAZETTEER = (
    ("Afghanistan", 33.939, 67.71), ("Algeria", 28.034, 1.66), ("Argentina", -38.416, -63.617), ("Australia", -25.274, 133.775), ("Austria", 47.516, 14.55),
    ("Bangladesh", 23.685, 90.356), ("Belgium", 50.504, 4.47), ("Brazil", -14.235, -51.925), ("Canada", 56.13, -106.347), ("Chile", -35.675, -71.543),
    ("China", 35.862, 104.195), ("Colombia", 4.571, -74.297), ("Czech Republic", 49.817, 15.473), ("Denmark", 56.264, 9.502), ("Egypt", 26.821, 30.802),
    ("Ethiopia", 9.145, 40.489), ("Finland", 61.924, 25.748), ("France", 46.228, 2.214), ("Germany", 51.166, 10.452), ("Greece", 39.074, 21.824),
    ("Hungary", 47.162, 19.503), ("India", 20.594, 78.963), ("Indonesia", -0.789, 113.921), ("Iran", 32.428, 53.688), ("Iraq", 33.223, 43.68),
    ("Ireland", 53.413, -8.244), ("Israel", 31.046, 34.852), ("Italy", 41.872, 12.567), ("Japan", 36.205, 138.253), ("Kenya", -0.024, 37.906),
    ("Lebanon", 33.854, 35.862), ("Libya", 26.335, 17.228), ("Malaysia", 4.21, 101.976), ("Mexico", 23.635, -102.553), ("Morocco", 31.792, -7.093),
    ("Myanmar", 21.914, 95.956), ("Netherlands", 52.133, 5.291), ("New Zealand", -40.901, 174.886), ("Nigeria", 9.082, 8.675), ("North Korea", 40.339, 127.51),
    ("Norway", 60.472, 8.469), ("Pakistan", 30.375, 69.345), ("Peru", -9.19, -75.015), ("Philippines", 12.88, 121.774), ("Poland", 51.919, 19.145),
    ("Portugal", 39.399, -8.224), ("Qatar", 25.355, 51.184), ("Romania", 45.943, 24.967), ("Russia", 61.524, 105.319), ("Saudi Arabia", 23.886, 45.079),
    ("South Africa", -30.559, 22.938), ("South Korea", 35.908, 127.767), ("Spain", 40.464, -3.749), ("Sudan", 12.863, 30.218), ("Sweden", 60.128, 18.644),
    ("Switzerland", 46.818, 8.228), ("Syria", 34.802, 38.997), ("Taiwan", 23.698, 120.96), ("Thailand", 15.87, 100.993), ("Turkey", 38.964, 35.243),
    ("EU", 50.85, 4.35), ("NATO", 50.88, 4.43), ("US", 37.09, -95.713), ("United States", 37.09, -95.713), ("UK", 55.378, -3.436),
    ("United Kingdom", 55.378, -3.436), ("Ukraine", 48.38, 31.166), ("United Arab Emirates", 23.424, 53.848), ("Venezuela", 6.424, -66.59), ("Vietnam", 14.058, 108.277),
    ("Yemen", 15.553, 48.516),
)
# Colours of groups.
GROUP_COLOURS = {
    "country": "#ff7b72", "person": "#ffa657", "organization": "#d2a8ff", "technology": "#79c0ff",
    "event": "#7ee787", "treaty": "#f0e68c", "resource": "#56d364", "unknown": "#8b949e",
}
