r"""Food words, calorie ranges and nutrition profiles.

Patterns are matched on lower-cased text.  A look-around tests one place of a
match; an exclusion next to a pattern tests the whole text.
"""

from trencher.functions.rules import Rule

# Multi-label food types: (label, include, exclude, group).  Types of group "bare" only
# apply while nothing above them matched.
FOOD_TYPES = (
    ("burger", r"burger|cheeseburger", None, ""),
    ("pizza", r"pizza", None, ""),
    ("salad", r"salad", r"chicken salad sandwich", ""),
    ("taco", r"taco", None, ""),
    ("wrap", r"wrap|burrito", None, ""),
    ("sandwich", r"sandwich|sub |hoagie|panini", None, ""),
    ("hotdog", r"hot dog|corn dog", None, ""),
    ("chicken_tenders", r"chicken tender|chicken strip|chicken nugget|chicken finger", None, ""),
    ("wings", r"wing", r"buffalo wing sauce", ""),
    ("nachos", r"nachos", None, ""),
    ("fries", r"fries|french fries|tots|totchos", None, ""),
    ("steak", r"steak|filet|ribeye|sirloin|new york strip|porterhouse", None, ""),
    ("seafood", r"salmon|fish|mahi|sea bass|cod|tuna|shrimp|lobster|crab", r"fish.*chips", ""),
    ("fish_and_chips", r"fish.*chips|fish.*fries|fish n chips", None, ""),
    ("pasta", r"pasta|spaghetti|fettuccine|penne|linguine|mac.*cheese", None, ""),
    ("soup", r"soup|chowder|bisque|gumbo", None, ""),
    ("bowl", r"rice bowl|poke bowl|grain bowl", None, ""),
    ("turkey_leg", r"turkey leg", None, ""),
    ("pretzel", r"pretzel", r"pretzel.*dog", ""),
    ("churro", r"churro", None, ""),
    ("cupcake", r"cupcake", None, ""),
    ("cake", r"cake|cheesecake", r"cake pop|pancake|funnel cake", ""),
    ("cookie", r"cookie", None, ""),
    ("brownie", r"brownie", None, ""),
    ("ice_cream", r"ice cream|sundae|gelato", None, ""),
    ("frozen_treat", r"dole whip|soft serve", None, ""),
    ("funnel_cake", r"funnel cake", None, ""),
    ("donut", r"donut|doughnut", None, ""),
    ("shake", r"smoothie|shake|milkshake|frappuccino", None, ""),
    ("beer", r"\b(beer|ale|lager|ipa|stout|pilsner|draft|draught)\b", r"butterbeer|ginger beer|root beer|beer.?batter|beer cheese", ""),
    ("wine", r"\b(wine|sangria|champagne|prosecco|mimosa)\b", r"wine sauce|wine reduction|wine.?brais|wine glaze|red wine-", ""),
    ("cocktail", r"\b(cocktail|margarita|daiquiri|martini|mojito|mai tai|pina colada|hurricane)\b", r"sauce|glaze", ""),
    ("butterbeer", r"butterbeer", None, ""),
    ("coffee", r"\b(coffee|latte|espresso|cappuccino|americano|cold brew)\b", r"coffee.?cake|coffee.?rub|toffee", ""),
    ("tea", r"\b(tea|chai)\b", r"steak|tender|team|teal", ""),
    ("soft_drink", r"\b(soda|coca.cola|sprite|fanta)\b", r"cocktail", ""),
    ("soft_drink", r"\b(lemonade|agua fresca)\b", None, ""),
    ("soft_drink", r"\bjuice\b", r"sauce|jus\b", ""),
    ("water", r"\bwater\b", r"watermelon|water chestnut|cold water", "bare"),
    ("quesadilla", r"quesadilla", None, ""),
    ("ribs", r"ribs", None, ""),
    ("pork", r"pork|pulled pork|kalua", None, "bare"),
    ("chicken", r"chicken", r"chicken.*(tender|strip|nugget|finger|wing)", "bare"),
    ("egg_roll", r"egg roll|spring roll", None, ""),
    ("popcorn", r"popcorn", r"popcorn.*chicken", ""),
    ("bread", r"bread|roll|biscuit|croissant|muffin|scone", None, "bare"),
    ("shave_ice", r"shave ice|shaved ice|snow cone", None, ""),
)
CALORIE_RANGES = {
    "burger": (450, 1400), "pizza": (250, 900), "salad": (100, 700), "taco": (150, 500), "wrap": (400, 900),
    "sandwich": (350, 1000), "hotdog": (300, 800), "chicken_tenders": (400, 1000), "wings": (400, 1200),
    "nachos": (500, 1400), "fries": (200, 700), "steak": (400, 1200), "seafood": (200, 800),
    "fish_and_chips": (600, 1200), "pasta": (400, 1200), "soup": (150, 500), "bowl": (350, 800),
    "turkey_leg": (800, 1300), "pretzel": (300, 700), "churro": (200, 500), "cupcake": (350, 800),
    "cake": (300, 800), "cookie": (200, 600), "brownie": (300, 700), "ice_cream": (200, 700),
    "frozen_treat": (150, 450), "funnel_cake": (600, 1200), "donut": (250, 600), "shake": (300, 900),
    "beer": (100, 300), "wine": (100, 200), "cocktail": (150, 500), "butterbeer": (200, 500), "coffee": (5, 500),
    "tea": (0, 200), "soft_drink": (0, 400), "water": (0, 10), "quesadilla": (350, 800), "ribs": (600, 1400),
    "pork": (300, 900), "chicken": (300, 900), "egg_roll": (150, 400), "popcorn": (300, 700), "bread": (150, 500),
    "shave_ice": (100, 350),
}

_KIDS = r"\b(kids?|child|jr\b|junior|little|mini)\b"
# Expected ranges, first hit wins: (label, calories lo/hi, carbs lo/hi, fat lo/hi, protein lo/hi).
PROFILE_COLUMNS = ("label", "cal_lo", "cal_hi", "carb_lo", "carb_hi", "fat_lo", "fat_hi", "protein_lo", "protein_hi")
PROFILES = (
    Rule(_KIDS + r".*(?:burger|cheeseburger)", ("kids burger", 200, 700, 15, 50, 10, 40, 10, 30)),
    Rule(_KIDS + r".*pizza", ("kids pizza", 150, 600, 20, 60, 5, 30, 5, 25)),
    Rule(_KIDS + r".*(?:hot dog|corn dog)", ("kids hot dog", 150, 500, 15, 40, 8, 30, 5, 20)),
    Rule(_KIDS + r".*(?:chicken|tender|nugget|finger)", ("kids chicken", 150, 600, 10, 40, 8, 30, 10, 30)),
    Rule(_KIDS + r".*(?:mac|cheese|pasta|noodle)", ("kids pasta", 150, 600, 20, 60, 5, 30, 5, 20), r"babybel"),
    Rule(_KIDS, ("kids meal", 100, 700, 10, 80, 3, 40, 3, 40), r"sierra nevada|hazy little thing|mother'?s little helper|churro|ipa\b|lager\b|stout\b|\bale\b|pilsner|beer|wine|cocktail|margarita|sangria|fruit\s*cup|babybel"),
    Rule(r"fruit\s*(?:platter|plate|cup|bowl|salad)|fresh\s*fruit", ("fruit plate", 50, 400, 10, 90, 0, 10, 0, 10)),
    Rule(r"cheeseburger|hamburger|burger(?!.*impossible)", ("burger", 500, 1400, 30, 80, 25, 70, 20, 60)),
    Rule(r"\bwhole\b.*pizza", ("whole pizza", 1500, 3200, 150, 350, 60, 150, 60, 160)),
    Rule(r"cheese pizza|pepperoni pizza|pizza", ("pizza", 400, 1200, 40, 100, 15, 50, 15, 45), r"cookie"),
    Rule(r"hot dog|corn dog", ("hot dog", 300, 900, 25, 60, 15, 50, 10, 30)),
    Rule(r"turkey leg", ("turkey leg", 800, 1200, 0, 10, 40, 70, 80, 160)),
    Rule(r"funnel cake", ("funnel cake", 600, 1200, 70, 150, 25, 60, 5, 20), r"topping"),
    Rule(r"churro", ("churro", 200, 600, 30, 80, 10, 30, 2, 10), r"milk\s*shake|shake\b|family"),
    Rule(r"cupcake", ("cupcake", 350, 800, 45, 120, 15, 40, 3, 10), r"cocktail"),
    Rule(r"dole whip|soft.serve", ("frozen treat", 150, 400, 30, 80, 0, 15, 0, 8)),
    Rule(r"pretzel(?!.*pretzel kitchen)", ("pretzel", 300, 700, 50, 120, 1, 25, 5, 20), r"bread pudding|bread stick|breadstick|loaded"),
    Rule(r"mac.*cheese|mac n cheese", ("mac & cheese", 400, 1000, 35, 80, 20, 55, 15, 35)),
    Rule(r"chicken tender|chicken finger|chicken strip|chicken nugget", ("chicken tenders", 400, 1000, 20, 60, 20, 50, 25, 55), r"1 pc|single|per piece|grilled"),
    Rule(r"nachos|totchos", ("nachos", 500, 1300, 40, 100, 25, 70, 15, 45)),
    Rule(r"caesar salad", ("caesar salad", 150, 700, 8, 40, 8, 45, 5, 40)),
    Rule(r"brownie", ("brownie", 300, 800, 40, 100, 15, 45, 3, 12)),
    Rule(r"milkshake|\bshake\b", ("milkshake", 400, 1100, 50, 130, 15, 50, 8, 20)),
    Rule(r"platter|feast|sampler", ("platter/sampler", 500, 1800, 30, 200, 15, 80, 15, 120), r"make any|vegetable platter|veggie platter|cheese platter|fruit|combo tray|imperial sampler|beer sampler|wine sampler|flight"),
    Rule(r"combo", ("combo meal", 300, 1600, 15, 200, 5, 80, 5, 120), r"make any|combo tray"),
    Rule(r"\blatte\b|cold brew|\bcappuccino\b", ("coffee drink", 0, 700, 0, 90, 0, 35, 0, 50)),
    Rule(r"\bbeer\b(?!.*(?:butter|batter|brined|braised|cheese|glazed|marinated|infused|float|root))", ("beer", 100, 350, 5, 30, 0, 2, 0, 5), r"chicken|pork|steak|burger|sandwich|wings|ribs|fish|tacos|root beer|barq"),
    Rule(r"\bwine\b(?!.*(?:braised|reduction|sauce|vinaigrette|marinated|glazed|infused|cupcake|cake|country|bar))", ("wine", 100, 400, 2, 20, 0, 1, 0, 2)),
    Rule(r"margarita|mojito|sangria|(?<!shrimp |fruit |prawn |seafood )cocktail", ("cocktail", 50, 500, 5, 60, 0, 5, 0, 3)),
    Rule(r"^(?:bottled |sparkling |still |spring |mineral |flavored |dasani |smart|premium |tulum |coconut |vitamin )?water$", ("water", 0, 120, 0, 30, 0, 1, 0, 1)),
    Rule(r"ribs|rib plate|bbq.*rib", ("ribs", 600, 1400, 15, 60, 30, 70, 30, 70)),
    Rule(r"doughnut|donut", ("doughnut", 250, 700, 30, 90, 10, 35, 3, 10), r"chicken.*(?:doughnut|donut)|(?:doughnut|donut).*chicken|chicken\s*'?n'?\s*donut"),
    Rule(r"ice cream|sundae", ("ice cream/sundae", 250, 1200, 30, 130, 10, 55, 3, 15)),
    Rule(r"cookie", ("cookie", 200, 1000, 25, 120, 10, 50, 2, 15), r"cookies\s*&\s*cream|cookies\s*'?n'?\s*cream"),
    Rule(r"wrap|burrito", ("wrap/burrito", 350, 1000, 30, 80, 15, 50, 15, 45)),
    Rule(r"sandwich|panini|sub", ("sandwich", 250, 1200, 20, 80, 8, 55, 8, 50), r"potato chip|chips\b|make any"),
    Rule(r"(?<!cheese)steak(?! dog|house| fries| & egg)|filet(?! de saumon)|ribeye|rib.eye|prime rib", ("steak", 400, 1200, 0, 60, 20, 65, 30, 80), r"cauliflower|vegan|veggie|extra steak|add steak|chocolate cake|steak fries|filet de saumon"),
    Rule(r"fish\s*(?:&|and|'?n'?)\s*chips", ("fish & chips", 700, 1400, 60, 130, 30, 80, 25, 100)),
    Rule(r"salmon|sea bass|fish(?!.*finger)", ("fish entree", 300, 900, 5, 80, 10, 50, 15, 60), r"\b(ipa|ale|lager|stout|porter|pilsner|dogfish|sailfish|swordfish\s+ipa)\b"),
)

# Words with a lowest and a highest believable calorie count.
TOO_LOW = {
    "burger": 350, "pizza": 200, "sandwich": 250, "burrito": 350, "nachos": 300, "fried chicken": 300, "steak": 300,
    "pasta": 250, "mac and cheese": 250, "ice cream": 150, "sundae": 250, "cupcake": 250, "brownie": 200,
    "cookie": 100, "donut": 150, "churro": 150, "pretzel": 200,
}
TOO_HIGH = {
    "side": 800, "appetizer": 1200, "salad": 1000, "soup": 600, "cookie": 600, "muffin": 700, "scone": 600,
    "ice cream": 800, "coffee": 400,
}
ZERO_ENERGY_DRINKS = r"^(diet |sugar.?free|zero.?calorie|plain tea|green tea|black tea|earl grey|hot tea|iced tea|americano|espresso|black coffee)"
ZERO_ENERGY_NAMES = r"^(coffee|tea|espresso|americano|hot tea|iced tea|earl grey|green tea|double espresso|brewed coffee|cold brew|nitro cold brew)|unsweetened|plain|water|^diet |sugar.?free|zero.?calorie"
