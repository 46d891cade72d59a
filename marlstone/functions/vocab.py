"""Constants that are the semantics, and literal columns made from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hint words of the six default categories, in definition order.
IDENTITY_HINTS = "hair, eyes, face, smile, expression, freckles, glasses, beard, makeup, blonde, brunette, brown hair, black hair, red hair, looking at camera, age, complexion, skin".split(", ")
WARDROBE_HINTS = "shirt, t-shirt, tee, dress, jacket, coat, hoodie, sweater, jeans, pants, skirt, shorts, shoes, boots, heels, hat, cap, gloves, uniform, wearing, outfit, suit, blouse, scarf, tie, vest, socks, sandals".split(", ")
POSE_HINTS = "standing, sitting, kneeling, leaning, posing, full body, upper body, close up, close-up, portrait, selfie, side view, front view, looking away, arms crossed, from above, from below, from side, headshot".split(", ")
SETTING_HINTS = "background, room, living room, bedroom, kitchen, window, curtains, floor, rug, couch, sofa, chair, bed, street, park, beach, forest, studio, indoors, outdoors, wall, garden, office, cafe, restaurant, city, mountain".split(", ")
LIGHTING_HINTS = "backlight, backlighting, natural light, studio lighting, golden hour, shadow, shadows, high key, low key, rim light, silhouette, soft light, harsh light, candlelight, neon, dramatic lighting, sunlight, overcast, spotlight, ambient light, warm light, cool light, flash, bokeh, lens flare, dappled light, twilight, dawn, dusk".split(", ")
ACTION_HINTS = "reading, writing, cooking, dancing, running, walking, eating, drinking, playing, swimming, typing, painting, holding, carrying, reaching, waving, pointing, laughing, singing, climbing, jumping, stretching, working, talking, hugging, fighting, sleeping, driving".split(", ")


class Category(NamedTuple):
    name: str
    hints: list[str]
    priority: int = 5             # order in zero-shot and category variants, least first
    zeroshot_cap: int | None = None
    photo: tuple[int, int] = (8, 22)    # segments and words of its variant, by style
    anime: tuple[int, int] = (12, 28)


# Priorities, caps and limits of the default categories.
CATEGORIES = (
    Category("identity", IDENTITY_HINTS, 1, None, (8, 22), (12, 28)),
    Category("wardrobe", WARDROBE_HINTS, 3, None, (8, 24), (12, 28)),
    Category("pose_composition", POSE_HINTS, 2, None, (8, 24), (10, 24)),
    Category("setting", SETTING_HINTS, 5, 3, (7, 22), (10, 24)),
    Category("lighting", LIGHTING_HINTS, 4, 2, (6, 18), (8, 20)),
    Category("action", ACTION_HINTS, 2, None, (8, 22), (10, 24)),
)

# Words that don't count as content, for clause filtering and for prose tokens.
STOPWORDS = "a an the is are was were be been being in on at to for of with by from into this that it its she he they her his and or but also very quite rather some photo image picture portrait woman man person girl boy lady guy figure".split()
PROSE_STOPWORDS = "a an the is are was were be been being in on at to for of with by from into this that it its she he her his they and or but also very quite rather some has have had not no there which who appears looks seems can may might photo image picture portrait photograph woman man person girl boy lady guy figure young old".split()

# Filler prefixes and compound nouns.
FILLERS = ["the image shows ", "this image shows ", "the photo shows ", "the picture shows ", "there is ", "there are ", "in the image ", "in this image ", "a photo of ", "an image of ", "a picture of "]
COMPOUND_NOUNS = [
    "shirt|dress|jacket|sweater|coat|skirt|pants|jeans|shorts|top|blouse|vest", "hair|eyes|skin", "light|lighting|glow|shadow|shadows",
    "door|wall|window|floor|ceiling|mirror|table|chair|couch|sofa|bed", "background|foreground", "pattern|texture|fabric|material", "expression|smile|grin|frown",
]

# Tag sets of noise filtering and of the training variant.
RATING_TAGS = "sensitive general questionable explicit rating:general rating:sensitive rating:questionable rating:explicit realistic".split()
RESTORED_TAGS = "1girl 1boy 1other solo".split()
NOISE_TAGS = RATING_TAGS + RESTORED_TAGS
IDENTITY_TAGS = "brown_hair brown_eyes black_hair black_eyes blonde_hair blue_eyes green_eyes red_hair long_hair short_hair medium_hair male female breasts medium_breasts".split()
FRAMING_TAGS = "close-up, close_up, closeup, upper_body, upper body, full_body, full body, portrait, headshot, from_above, from above, from_below, from below, from_side, from side".split(", ")
PRIMARY_POSES = "standing, sitting, kneeling, leaning, walking, running, lying_down, lying down, crouching".split(", ")
RESCUED_TAGS = "looking_at_viewer, looking at viewer, looking_away, looking away, looking_at_camera, looking at camera, closed_mouth, open_mouth, closed mouth, open mouth, smile, smiling, grin, frown, serious, upper_body, upper body, full_body, full body, close-up, close_up, closeup, from_side, from side, from_above, from above, from_below, from below, arms_crossed, arms crossed, hand_on_hip, hand on hip, sitting, standing, kneeling, leaning, cleavage".split(", ")
OMISSIONS = [[], ["setting"], ["wardrobe"], ["setting", "wardrobe"]]
TRAINING_CAPS = {"wardrobe": 2, "lighting": 2, "setting": 3}
ENRICHMENT_TOKENS = 5

# Token budgets, estimators, presets and style marks.
BUDGETS = {"sd15": 60, "sdxl": 60, "flux": 200, "sd3": 200, "kolors": 200, "pixart": 200, "playground": 60}
DEFAULT_BUDGET = 60
T5_BACKENDS = ["flux", "sd3", "kolors", "pixart"]
PRESETS = {"tags": 0.20, "keywords": 0.35, "balanced": 0.50, "descriptive": 0.68, "prose": 0.85}
BIAS_RANGE = (0.15, 0.90)
ANIME_MARKS = "pony|illustrious|anime|booru"

# Colours, postures and words that are no head noun.
COLOURS = "red orange yellow green blue purple violet pink brown black white gray grey blonde blond silver gold golden tan beige cyan teal navy maroon crimson scarlet turquoise".split()
COLOUR_FOLDS = {"grey": "gray", "blond": "blonde", "violet": "purple", "crimson": "red", "scarlet": "red", "golden": "gold"}
POSTURES = "standing sitting lying kneeling crouching squatting".split()
NON_NOUNS = "and or the a an with on in of to at dark light pale bright deep very off".split()
PALETTE = {
    "red": (200, 30, 30), "orange": (230, 140, 30), "yellow": (235, 220, 50), "green": (40, 160, 60), "blue": (40, 70, 200),
    "purple": (130, 50, 170), "pink": (240, 150, 190), "brown": (120, 75, 40), "black": (20, 20, 20), "white": (240, 240, 240),
    "gray": (128, 128, 128), "blonde": (220, 200, 130), "silver": (190, 190, 195), "gold": (210, 175, 55), "tan": (210, 180, 140),
    "beige": (225, 215, 190), "cyan": (60, 200, 210), "teal": (30, 140, 140), "navy": (30, 40, 90), "maroon": (110, 30, 40), "turquoise": (60, 210, 190),
}

# Default taxonomy, gate directions and tolerance, image suffixes.
SYNONYMS = {"automobile": "car", "auto": "car", "photograph": "photo"}
PARENTS = {"mountain": ["landscape", "nature"], "beach": ["coast", "nature"]}
GATE = {
    "contradiction_rate_mean": "lower", "items_with_contradiction_pct": "lower", "over_budget_pct_training": "lower",
    "over_budget_pct_zeroshot": "lower", "coverage_recall_mean": "higher", "clip_mean": "higher",
}
TOLERANCE = 0.01
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".gif"]


def _sql(value) -> str:
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_sql(v) for v in value)})"
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"{value}D" if isinstance(value, float) else str(value)


def listed(values) -> str:
    """SQL text: values for IN. A set of literals is hashed once, an array in every call."""
    return "(" + ", ".join(_sql(v) for v in values) + ")"


def strings(values) -> Column:
    """A literal array<string>."""
    return F.expr(f"cast({_sql(list(values))} as array<string>)")


def lookup(table: dict, key: Column) -> Column:
    """The table's value for ``key``, null if it has none."""
    return F.try_element_at(F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")"), key)


def empty() -> Column:
    return F.expr("cast(array() as array<string>)")


def each(function: str, array: Column, body: str, *zero: Column) -> Column:
    """A higher-order function whose lambda is SQL text.

    A lambda written in Python takes several calls to the JVM for each of its nodes;
    as text it takes one, whatever its size. The planned expression is the same.
    """
    return F.call_function(function, array, *zero, F.expr(body))


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]
