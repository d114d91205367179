r"""Dish types, their nutrition profiles and ingredient additions.

A dish rule is (type, name pattern, name exclusion, pattern on name + description, category).
"""

_SMOKED = r"\brib|brisket|bbq|bar-?b-?q|smoked|pulled pork"
_PROTEIN = r"chicken|beef|steak|pork|lamb|duck|turkey|shrimp|fish|salmon|tuna|mahi|cod|grouper|tilapia|lobster|crab|scallop|mussel|rib\b|brisket|short rib|filet|fillet|chop\b|loin|tenderloin|meatball|sausage|calamari|octopus"
DISH_RULES = (
    ("kids_meal", r"\bkid|child", None, None, None),
    ("wings", r"wings|drumettes", None, None, None),
    ("nachos", r"nachos|totchos", None, None, None),
    ("bbq_platter", r"platter|feast|sampler", None, _SMOKED, None),
    ("bbq_platter", r"\bcombo\b", r"sandwich|burger|chicken|wrap", r"\brib|brisket|bbq|smoked|pulled", None),
    ("burger", r"burger|cheeseburger", None, None, None),
    ("sandwich", r"sandwich|sub\b|po.boy|panini|\bwrap\b|hoagie", r"cookie sandwich|ice cream sandwich|chips|chip\b|make any", None, None),
    ("pasta", r"pasta|paccheri|penne|spaghetti|fettuccine|gnocchi|mac.*cheese|alfredo", None, None, None),
    ("noodle_bowl", r"pad thai|ramen|pho|noodle|lo mein|stir.fry|fried rice", None, None, None),
    ("pizza", r"pizza|flatbread", None, None, None),
    ("taco", r"taco|burrito|quesadilla|tostada|enchilada", None, None, None),
    ("soup", r"soup|chowder|gumbo|bisque", None, None, None),
    ("soup", r"\bchili\b", r"fries|tots|dog|burger|nachos|cheese fries", None, None),
    ("salad", r"salad|slaw", r"fruit salad|tropical salad|side salad|house salad|green salad|garden salad|mixed green", None, "entree"),
    ("sushi_roll", r"\broll\b|sushi|maki", r"cinnamon|cinnabon", None, None),
    ("poke_bowl", r"poke|bowl", None, r"chicken|beef|fish|shrimp|salmon|tuna|pork", None),
    ("breakfast", r"breakfast|brunch|pancake|biscuit|omelet|benedict", None, None, None),
    ("breakfast", r"waffle", r"cone|bowl|sundae|bubble waffle", None, None),
)
# Cooking-method types need a protein word in the name as well.
PROTEIN_WORDS = _PROTEIN
COOKED_RULES = (
    ("fried_entree", r"fried|crispy|battered|tempura|breaded", r"^(fried ricotta|crispy calamari|crispy spring roll|pan.fried potsticker)"),
    ("grilled_entree", r"grilled|roasted|braised|seared", None),
)
CATEGORY_TYPES = {"snack": "appetizer", "dessert": "dessert", "side": "side"}

# type: (base calories, fat, carb, protein shares, sugar share of carbs, fiber, sodium, highest calories,
#        least believable calories, ingredients already in the base)
DISHES = {
    "kids_meal": (350, 0.40, 0.35, 0.25, 0.10, 2, 800, 700, 150, "bread fries"),
    "wings": (600, 0.55, 0.15, 0.30, 0.05, 1, 1800, 1200, 300, "chicken"),
    "nachos": (700, 0.50, 0.30, 0.20, 0.05, 4, 1400, 1400, 350, "cheese tortilla"),
    "bbq_platter": (900, 0.42, 0.30, 0.28, 0.08, 4, 1600, 1800, 500, "beef pork bread"),
    "burger": (550, 0.45, 0.30, 0.25, 0.10, 3, 1200, 1400, 350, "beef bread"),
    "sandwich": (500, 0.38, 0.38, 0.24, 0.08, 3, 1100, 1100, 300, "bread"),
    "pasta": (600, 0.35, 0.45, 0.20, 0.08, 3, 1000, 1200, 350, ""),
    "noodle_bowl": (550, 0.30, 0.45, 0.25, 0.10, 3, 1400, 1100, 300, "rice"),
    "pizza": (550, 0.38, 0.40, 0.22, 0.08, 3, 1200, 1200, 300, "bread cheese"),
    "taco": (450, 0.40, 0.35, 0.25, 0.05, 4, 1000, 1000, 200, "tortilla"),
    "soup": (350, 0.40, 0.35, 0.25, 0.08, 3, 1400, 800, 150, ""),
    "fried_entree": (600, 0.48, 0.32, 0.20, 0.05, 2, 1200, 1200, 300, ""),
    "grilled_entree": (550, 0.38, 0.30, 0.32, 0.05, 3, 1000, 1200, 300, ""),
    "salad": (400, 0.45, 0.30, 0.25, 0.15, 5, 800, 900, 200, ""),
    "sushi_roll": (350, 0.25, 0.50, 0.25, 0.10, 2, 900, 700, 150, "rice"),
    "poke_bowl": (500, 0.25, 0.45, 0.30, 0.05, 4, 1000, 900, 250, "rice"),
    "breakfast": (550, 0.45, 0.35, 0.20, 0.12, 2, 1100, 1200, 300, "bread egg"),
    "appetizer": (400, 0.45, 0.35, 0.20, 0.08, 2, 900, 900, 150, ""),
    "dessert": (450, 0.35, 0.55, 0.10, 0.65, 2, 300, 1000, 150, ""),
    "side": (300, 0.40, 0.45, 0.15, 0.10, 3, 600, 600, 100, ""),
    "generic_entree": (550, 0.38, 0.35, 0.27, 0.08, 3, 1000, 1400, 300, ""),
}
DISH_FIELDS = ("base", "fat_share", "carb_share", "protein_share", "sugar_share", "fiber_g", "sodium_mg", "max_cal", "min_cal", "implied")
BROAD_TYPES = ("generic_entree", "appetizer", "dessert", "side")

# (ingredient, calories, pattern, exclusion); an ingredient counts once.
INGREDIENTS = (
    ("bacon", 80, r"\bbacon\b", None),
    ("cheese", 110, r"cheese|cheddar|swiss|provolone|pepper\s?jack|gouda|brie|gruyere|mozzarella|parmesan|goat cheese|blue cheese|colby", None),
    ("avocado", 120, r"avocado|guacamole|guac\b", None),
    ("cream_sauce", 100, r"cream sauce|alfredo|béchamel|hollandaise|béarnaise|beurre blanc", None),
    ("aioli_mayo", 80, r"aioli|mayo|remoulade|ranch|tartar sauce", None),
    ("gravy", 60, r"\bgravy\b", None),
    ("butter", 70, r"\bbutter\b", r"\bbutter\b.*peanut"),
    ("pork_belly", 150, r"pork belly", None),
    ("fries", 380, r"\bfries\b|french fries|\btots\b|\btater\b", None),
    ("rice", 220, r"\brice\b", r"\brice\b.*(vinegar|paper|noodle)"),
    ("bread", 150, r"\bbun\b|brioche|ciabatta|focaccia|sourdough|baguette", None),
    ("bread", 150, r"\bbread\b", r"\bbread\b.*crumb|\bbread\b.*ed\b"),
    ("cornbread", 180, r"cornbread|corn muffin", None),
    ("potato", 220, r"\bpotato\b", r"\bpotato\b\s*(?:bun|roll|bread)"),
    ("potato", 220, r"mashed|colcannon", None),
    ("tortilla", 120, r"tortilla|taco shell", None),
    ("egg", 90, r"\begg\b|fried egg|poached egg", None),
    ("chicken", 200, r"\bchicken\b", None),
    ("beef", 250, r"\bbeef\b|angus|\bsteak\b|brisket|\bpatty\b", None),
    ("pork", 220, r"\bpork\b", r"\bpork\b.*belly"),
    ("pork", 220, r"pulled pork|\bribs\b|carnitas", None),
    ("shrimp", 100, r"shrimp|prawn", None),
    ("fish", 180, r"\bfish\b", r"\bfish\b\s*(?:roe|sauce|stock)"),
    ("fish", 180, r"salmon|\btuna\b|mahi|\bcod\b|grouper|tilapia", None),
    ("lobster", 130, r"lobster|\bcrab\b", None),
    ("sausage", 180, r"sausage|bratwurst|chorizo|andouille", None),
    ("whipped_cream", 80, r"whipped cream", None),
    ("ice_cream_add", 200, r"à la mode|a la mode|with ice cream", None),
)
# A side named after an ingredient does not count it again.
SIDE_NAMES = {"fries": r"\bfries\b|\btots\b|\btater\b", "potato": r"\bpotato\b|\bmashed\b", "rice": r"\brice\b", "cornbread": r"\bcornbread\b"}
FRIED_METHOD = r"fried|deep[\s-]?fried|crispy|battered|tempura|breaded"
ANIMAL_WORDS = r"chicken|beef|pork|steak|lamb|duck|turkey|shrimp|lobster|crab|salmon|fish|egg|cheese|cream|butter|bacon|sausage|brisket|ribs"

# Words counted when judging a description: calories each is expected to bring.
RICH_WORDS = (
    (100, ("bacon", "cheese", "cheddar", "swiss", "provolone", "mozzarella", "brie", "cream", "butter", "aioli", "mayo", "ranch", "gravy", "hollandaise", "avocado", "guacamole", "pork belly", "chorizo", "sausage", "fried", "crispy", "battered", "tempura", "breaded", "alfredo", "béchamel", "beurre", "truffle")),
    (200, ("fries", "tots", "potato", "rice", "noodles", "pasta", "bread", "bun", "roll", "tortilla", "pita", "waffle", "pancake", "biscuit", "cornbread")),
    (180, ("steak", "beef", "chicken", "pork", "lamb", "duck", "turkey", "shrimp", "lobster", "crab", "salmon", "tuna", "fish", "egg", "pulled pork", "brisket", "ribs")),
)
NOT_A_DISH = r"prix fixe|tasting menu|buffet|all.you.can|^(topping|add-on|side of|extra|garnish|dipping sauce|dressing)|^(sides|drinks|desserts|appetizers|entrees|beverages|salads|soups|specials)$|^(salad enhancement|add protein|add .* to)"
