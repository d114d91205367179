"""Nutrition profiles that were given to unlike foods, and what stands in for them by kind of dish."""

from trencher.functions.rules import Rule

PROFILE_COLUMNS = ("calories", "carbs", "fat", "protein", "profile")
# Profiles that are replaced.
REPLACED = (
    (297, 18, 16, 20, "platter_297"),
    (1868, 107, 80, 162, "seafood_1868"),
    (430, 6, 45, 1, "salad_430"),
    (1400, 122, 59, 95, "entree_1400"),
)
# Defaults of earlier imports.
DEFAULTS = (
    (600, 40, 25, 30, "generic entree"),
    (200, 45, 1, 1, "sweet beverage"),
    (140, 39, 0, 7, "nonsensical snack"),
    (400, 50, 18, 4, "dessert default"),
    (400, 55, 18, 5, "bakery default"),
    (300, 35, 14, 8, "appetizer default"),
    (150, 13, 0, 2, "beer default"),
    (200, 18, 0, 2, "craft beer default"),
    (250, 25, 12, 8, "side dish default"),
    (400, 50, 20, 5, "grab-bag"),
)
CONFIDENCE = 40

# Calories, shares of them from fat, carbs and protein, sugar's share of carbs, fiber, sodium, cholesterol.
DISH_COLUMNS = ("calories", "fat_share", "carb_share", "protein_share", "sugar_share", "fiber", "sodium", "cholesterol")
_PLATTER = r"platter|combo"
DISHES = (
    Rule(r"wings|raptor", (800, 0.50, 0.15, 0.35, 0.05, 1, 1800, 120), also=_PLATTER),
    Rule(r"chicken.*parmesan|chicken parm", (900, 0.40, 0.35, 0.25, 0.08, 3, 1400, 90), also=_PLATTER),
    Rule(r"fettuccine|alfredo|pasta", (850, 0.38, 0.42, 0.20, 0.06, 3, 1200, 70), also=_PLATTER),
    Rule(r"pizza|cheese slice|pesto.*slice", (700, 0.40, 0.38, 0.22, 0.06, 3, 1300, 50), also=_PLATTER),
    Rule(r"gyro", (750, 0.42, 0.35, 0.23, 0.05, 3, 1200, 60), also=_PLATTER),
    Rule(r"fish|battered", (800, 0.45, 0.35, 0.20, 0.04, 2, 1300, 70), also=_PLATTER),
    Rule(r"bbq|ribwich|rib|pork|pernil|carnegie", (950, 0.42, 0.30, 0.28, 0.10, 3, 1500, 90), also=_PLATTER),
    Rule(r"tender|chicken|southern", (800, 0.45, 0.35, 0.20, 0.05, 2, 1300, 70), also=_PLATTER),
    Rule(r"fruit", (200, 0.05, 0.90, 0.05, 0.80, 4, 10, 0), also=_PLATTER),
    Rule(r"cheese", (500, 0.55, 0.25, 0.20, 0.04, 1, 900, 70), also=_PLATTER),
    Rule(r"mezze", (600, 0.48, 0.35, 0.17, 0.06, 5, 900, 20), also=_PLATTER),
    Rule(r"butcher.*board", (1200, 0.50, 0.20, 0.30, 0.04, 2, 1800, 100), also=_PLATTER),
    Rule(r"vegan", (600, 0.30, 0.50, 0.20, 0.06, 6, 900, 0), also=_PLATTER),
    Rule(_PLATTER, (800, 0.40, 0.35, 0.25, 0.06, 3, 1300, 70)),
    Rule(r"caesar", (550, 0.50, 0.25, 0.25, 0.08, 3, 1000, 70)),
    Rule(r"cobb", (600, 0.50, 0.20, 0.30, 0.08, 4, 1100, 80)),
    Rule(r"salad", (500, 0.42, 0.35, 0.23, 0.08, 4, 1100, 40), also=r"soup"),
    Rule(r"salad", (350, 0.50, 0.30, 0.20, 0.12, 4, 600, 30)),
    Rule(r"chile relleno", (550, 0.45, 0.35, 0.20, 0.05, 4, 1000, 60)),
    Rule(r"chicken.*finger|chicken.*tender", (600, 0.45, 0.30, 0.25, 0.04, 1, 1200, 80)),
    Rule(r"bangers.*mash", (700, 0.48, 0.32, 0.20, 0.04, 3, 1400, 80)),
    Rule(r"loaded.*chips|irish.*chips", (700, 0.50, 0.35, 0.15, 0.04, 3, 1100, 50)),
    Rule(r"burger|cheeseburger", (850, 0.45, 0.30, 0.25, 0.06, 3, 1200, 90)),
    Rule(r"bento.*box", (700, 0.35, 0.40, 0.25, 0.06, 3, 1000, 60)),
    Rule(r"fish.*chips|fish.*n.*chips", (800, 0.45, 0.35, 0.20, 0.04, 2, 1200, 70)),
    Rule(r"tuna", (550, 0.35, 0.35, 0.30, 0.05, 2, 900, 50)),
    Rule(r"buffalo chicken", (650, 0.42, 0.30, 0.28, 0.04, 2, 1500, 80)),
    Rule(r"yardbird|chicken", (700, 0.40, 0.30, 0.30, 0.05, 2, 1100, 85)),
    Rule(r"croissant", (500, 0.45, 0.35, 0.20, 0.06, 2, 900, 60)),
    Rule(r"tour de france", (800, 0.45, 0.30, 0.25, 0.06, 3, 1100, 80)),
    Rule(r"croquette", (450, 0.48, 0.32, 0.20, 0.04, 1, 700, 60)),
    Rule(r"side", (300, 0.40, 0.45, 0.15, 0.05, 2, 500, 15)),
    Rule(r"two tenders", (400, 0.45, 0.30, 0.25, 0.04, 1, 800, 60)),
    Rule(r"steam.*boil|bouillabaisse|seafood.*boil", (750, 0.35, 0.25, 0.40, 0.04, 2, 1800, 200)),
    Rule(r"shrimp.*grits", (650, 0.42, 0.33, 0.25, 0.04, 2, 1200, 150)),
    Rule(r"gambas|shrimp.*garlic", (400, 0.55, 0.15, 0.30, 0.05, 1, 800, 180)),
    Rule(r"shrimp.*rice.*bowl", (550, 0.30, 0.40, 0.30, 0.04, 3, 1000, 150)),
)
