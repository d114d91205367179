r"""Rule tables of the imputers (first rule that fires wins).

``scope="name"`` rules read the name only, the others name and description.
"""

from trencher.functions.rules import Rule

ENTREE, SNACK, SIDE, DESSERT, DRINK = ("entree",), ("snack",), ("side",), ("dessert",), ("beverage",)
SWEET_BAKES = r"cake|cookie|brownie|cupcake|ice cream|sundae|churro|donut|pastry"

# Share of carbs that is fiber.
FIBER = (
    Rule(r"bean|lentil|chickpea|black bean|pinto bean|kidney bean|quinoa|farro|barley|bulgur|bran|whole wheat|whole grain|multi-grain", 0.20),
    Rule(r"vegetable|broccoli|cauliflower|brussels sprout|kale|spinach|artichoke|sweet potato|yam|apple|pear|berry|raspberry|blackberry|strawberry|oatmeal|oat", 0.12),
    Rule(r"salad", 0.12, r"salad.*dressing"),
    Rule(r"fruit|orange|banana|grape|peach|plum|mango|pineapple|brown rice|wild rice|corn|peas|carrot|nuts|almond|walnut|pecan|peanut", 0.10),
    Rule(r"salad|bowl|veggie|vegetable|rice|grain", 0.07, category=ENTREE),
    Rule(r"pasta|pizza|sandwich|burger|wrap", 0.05, category=ENTREE),
    Rule(r"steak|chicken|pork|beef|fish|seafood", 0.04, category=ENTREE),
    Rule("", 0.05, category=ENTREE),
    Rule(r"chip|pretzel|cracker|popcorn", 0.04, category=SNACK),
    Rule(r"fried|nugget|tender|wing", 0.02, category=SNACK),
    Rule("", 0.03, category=SNACK),
    Rule(r"vegetable|veggie|slaw|salad|green", 0.10, category=SIDE),
    Rule(r"potato|fries|tots|hash", 0.05, category=SIDE),
    Rule("", 0.04, category=SIDE),
    Rule(r"apple|berry|fruit", 0.04, category=DESSERT),
    Rule("", 0.02, category=DESSERT),
    Rule(SWEET_BAKES, 0.04, also=r"apple|berry|fruit"),
    Rule(SWEET_BAKES, 0.02),
    Rule(r"smoothie", 0.05, category=DRINK),
    Rule(r"juice", 0.02, category=DRINK),
    Rule("", 0.0, category=DRINK),
    Rule("", 0.03),
)

_SUGARY = r"cake|cookie|brownie|cupcake|frosting|icing|chocolate|fudge|caramel|candy|sweet|sugar|honey|syrup|glaze"
_FRUITY = r"smoothie|juice|fruit cup|berry|apple|orange|grape|pineapple|mango|strawberry|banana|watermelon"
_SODAS = r"soda|lemonade|tea|coffee|mocha|latte|frappuccino|milkshake|shake"
_BLACK = r"black coffee|hot coffee|espresso|black tea|hot tea"
_PLAIN = r"water|sparkling|seltzer|club soda|unsweetened|diet"
_DRINKS = r"beer|wine|cocktail|margarita|sangria|mojito|martini|whiskey|rum|vodka|gin|tequila|bourbon"
_GLAZED = r"teriyaki|sweet and sour|orange chicken|general tso|hoisin|glazed"
_SMOKED = r"bbq|barbecue|pulled pork|ribs|brisket|smoked"

# Share of carbs that is sugar (name only).
SUGAR = (
    Rule("", 0.70, category=DESSERT),
    Rule(_SUGARY, 0.70),
    Rule(_FRUITY, 0.75),
    Rule(_SODAS, 0.05, category=DRINK, also=_BLACK),
    Rule(_SODAS, 0.50, category=DRINK),
    Rule(_PLAIN, 0.02, category=DRINK),
    Rule(_DRINKS, 0.30),
    Rule(r"bread|bun|roll|biscuit|croissant|danish|muffin|scone|bagel|toast|waffle|pancake", 0.15),
    Rule(r"chip|pretzel|cracker|popcorn|nacho|fries|tots", 0.10, category=SNACK),
    Rule(_GLAZED, 0.35, category=ENTREE),
    Rule(_SMOKED, 0.30, category=ENTREE),
    Rule("", 0.20, category=ENTREE),
    Rule("", 0.15, category=SIDE),
    Rule("", 0.20),
)
# The edge-case refill repeats the sugar rules without breads, snacks and sides (name only) ...
SUGAR_EDGE = (
    Rule("", 0.70, category=DESSERT),
    Rule(_SUGARY, 0.70),
    Rule(_FRUITY, 0.75),
    Rule(_SODAS, 0.05, category=DRINK, also=_BLACK),
    Rule(_SODAS, 0.50, category=DRINK),
    Rule(_PLAIN, 0.02, category=DRINK),
    Rule(_DRINKS, 0.30),
    Rule(_GLAZED, 0.35, category=ENTREE),
    Rule(_SMOKED, 0.30, category=ENTREE),
    Rule("", 0.20),
)
# ... and has its own shorter fiber rules.
FIBER_EDGE = (
    Rule(r"smoothie", 0.05, category=DRINK),
    Rule("", 0.0, category=DRINK),
    Rule(r"bean|lentil|chickpea|quinoa|farro|barley|bulgur|bran|whole wheat|whole grain|multi-grain", 0.20),
    Rule(r"vegetable|broccoli|cauliflower|brussels sprout|kale|spinach|artichoke|sweet potato|yam|apple|pear|berry|oatmeal|oat", 0.12),
    Rule(r"salad", 0.12, r"salad.*dressing"),
    Rule(r"salad|bowl|veggie|vegetable|rice|grain", 0.07, category=ENTREE),
    Rule("", 0.05, category=ENTREE),
    Rule(r"chip|pretzel|cracker|popcorn", 0.04, category=SNACK),
    Rule("", 0.03, category=SNACK),
    Rule("", 0.02, category=DESSERT),
    Rule("", 0.03),
)

# Share of calories from protein (4 kcal per gram).
PROTEIN = (
    Rule(r"steak|beef|ribeye|sirloin|filet|brisket|prime rib|short rib|pot roast|chicken breast|grilled chicken|rotisserie chicken|turkey|duck|salmon|tuna|mahi|swordfish|cod|tilapia|shrimp|lobster|crab|scallop|pork chop|pork tenderloin|lamb chop|lamb shank|eggs benedict|omelet|frittata|quiche", 0.30),
    Rule(r"ham(?!burger)", 0.30),
    Rule(r"burger|sandwich|wrap|panini|pulled pork|ribs|carnitas|pasta.*meat|lasagna|bolognese|chili|stew", 0.22, category=ENTREE),
    Rule(r"chicken", 0.22, r"chicken.*salad", category=ENTREE),
    Rule(r"pizza|pasta|noodle|rice bowl|fried rice|pad thai", 0.17, category=ENTREE),
    Rule("", 0.20, category=ENTREE),
    Rule(r"chicken tender|wing|nugget|hot dog|sausage|pretzel dog|meatball|beef|pork", 0.15, category=SNACK),
    Rule("", 0.08, category=SNACK),
    Rule(r"chip|fries|tots|nacho|pretzel|popcorn|cracker", 0.08),
    Rule(r"bean|hummus|edamame|quinoa", 0.12, category=SIDE),
    Rule("", 0.07, category=SIDE),
    Rule("", 0.04, category=DESSERT),
    Rule(SWEET_BAKES, 0.04),
    Rule(r"protein|milk|latte|cappuccino|mocha", 0.10, category=DRINK),
    Rule(r"shake", 0.10, r"shake.*whip", category=DRINK),
    Rule(r"smoothie", 0.05, category=DRINK),
    Rule("", 0.02, category=DRINK),
    Rule("", 0.10),
)

# Milligrams of sodium per calorie.  The label "fried snack" reads the item's own flag.
SODIUM = (
    Rule(r"cured|prosciutto|salami|pepperoni|jamón|bacon|soy sauce|teriyaki|miso", 2.2),
    Rule(r"ham(?!burger)", 2.2),
    Rule(r"bbq|ribs|brisket|pulled pork|smoked|carnitas|pizza|soup|broth|ramen|noodle soup|mac.*cheese|quesadilla|sausage|hot dog|pretzel dog", 1.5),
    Rule(r"cheese(?!cake)", 1.5),
    Rule(r"burger|sandwich|panini|wrap|fried|crispy|tempura|battered|pasta|marinara|alfredo|taco|burrito|fajita|enchilada|nacho", 1.0, category=ENTREE),
    Rule("", 0.75, category=ENTREE),
    Rule(r"chip|fries|tots|pretzel|popcorn|cracker|chicken tender|wing|nugget|\bfried_item\b", 0.85, category=SNACK),
    Rule("", 0.45, category=SNACK),
    Rule("", 0.65, category=SIDE),
    Rule("", 0.20, category=DESSERT),
    Rule(SWEET_BAKES, 0.20),
    Rule(r"water|coffee|tea|juice|lemonade|soda|smoothie", 0.05, r"protein", category=DRINK),
    Rule(r"milk|latte|cappuccino|mocha|shake", 0.15, category=DRINK),
    Rule("", 0.10, category=DRINK),
    Rule("", 0.50),
)

# (sugar share of carbs, fiber grams, sodium per calorie, cholesterol mg), name only.
MICRO_COLUMNS = ("sugar_share", "fiber_g", "sodium_per_cal", "cholesterol_mg")
MICRO = (
    Rule(r"beer|ale|lager|stout|pilsner|ipa|cider", (0.1, 0, 0.1, 0), category=DRINK),
    Rule(r"wine|pinot|cabernet|chardonnay|merlot|rosé|prosecco|champagne", (0.8, 0, 0.04, 0), category=DRINK),
    Rule(r"martini|margarita|cocktail|mojito|old fashioned|mule|negroni|spritz|daiquiri", (0.85, 0, 0.05, 0), category=DRINK),
    Rule(r"coffee|espresso|latte|cappuccino|americano|cold brew|macchiato", (0.7, 0, 0.1, 5), category=DRINK),
    Rule(r"tea|chai|matcha", (0.9, 0, 0.05, 0), category=DRINK),
    Rule(r"smoothie|shake|milkshake", (0.75, 2, 0.2, 25), category=DRINK),
    Rule(r"soda|cola|sprite|fanta|lemonade|juice|punch", (0.95, 0, 0.1, 0), category=DRINK),
    Rule("", (0.7, 0, 0.1, 0), category=DRINK),
    Rule(r"ice cream|gelato|sundae|sorbet|frozen", (0.7, 1, 0.15, 50), category=DESSERT),
    Rule(r"cake|cupcake|brownie|cookie|pie|pastry|tart|cobbler", (0.65, 1, 0.4, 45), category=DESSERT),
    Rule(r"chocolate|candy|fudge|truffle|ganache", (0.7, 2, 0.15, 20), category=DESSERT),
    Rule(r"churro|funnel cake|donut|doughnut|beignet", (0.5, 1, 0.6, 30), category=DESSERT),
    Rule(r"fruit|berry|apple", (0.8, 3, 0.05, 0), category=DESSERT),
    Rule("", (0.65, 1, 0.3, 30), category=DESSERT),
    Rule(r"burger|cheeseburger", (0.1, 3, 1.5, 85), category=ENTREE),
    Rule(r"pizza|flatbread", (0.1, 3, 2.0, 40), category=ENTREE),
    Rule(r"pasta|fettuccine|spaghetti|penne|rigatoni|gnocchi|mac.*cheese", (0.08, 3, 1.2, 55), category=ENTREE),
    Rule(r"steak|ribeye|filet|sirloin|tenderloin", (0.0, 0, 1.0, 120), category=ENTREE),
    Rule(r"chicken", (0.05, 2, 1.3, 90), category=ENTREE),
    Rule(r"fish|salmon|tuna|cod|grouper|mahi|shrimp|lobster|crab", (0.05, 1, 1.2, 85), category=ENTREE),
    Rule(r"soup|chowder|chili|gumbo|bisque", (0.1, 3, 2.5, 30), category=ENTREE),
    Rule(r"salad", (0.2, 4, 1.0, 40), category=ENTREE),
    Rule(r"taco|burrito|quesadilla|enchilada", (0.08, 4, 1.5, 60), category=ENTREE),
    Rule(r"sandwich|sub|wrap|panini", (0.08, 3, 1.5, 55), category=ENTREE),
    Rule(r"wings", (0.1, 1, 2.5, 100), category=ENTREE),
    Rule(r"fried|crispy|battered|tempura", (0.05, 2, 1.5, 70), category=ENTREE),
    Rule("", (0.1, 3, 1.3, 60), category=ENTREE),
    Rule(r"pretzel", (0.05, 2, 2.5, 5), category=SNACK),
    Rule(r"fries|tots|nachos", (0.02, 3, 2.0, 15), category=SNACK),
    Rule(r"popcorn", (0.05, 4, 1.5, 0), category=SNACK),
    Rule("", (0.1, 2, 1.5, 20), category=SNACK),
    Rule(r"salad|slaw|vegetables", (0.2, 3, 1.0, 10), category=SIDE),
    Rule(r"fries|tots|potato|rice", (0.02, 2, 1.5, 5), category=SIDE),
    Rule(r"bread|roll|biscuit|cornbread", (0.1, 2, 1.5, 10), category=SIDE),
    Rule("", (0.1, 2, 1.2, 15), category=SIDE),
    Rule("", (0.15, 2, 1.0, 30)),
)

# Foods that cannot be fat free, and their share of calories from fat / protein.
FATTY = r"fried|crispy|battered|tempura|panko|cheese|cheddar|mozzarella|parmesan|gouda|brie|gruyere|oaxaca|queso|butter|buttery|buttermilk|meunière|bacon|sausage|chorizo|prosciutto|pancetta|cream|creamy|alfredo|carbonara|donut|doughnut|churro|funnel cake|burger|cheeseburger|fries|chips|tots|poutine|croissant|danish|pastry|puff|brownie|cookie|cake|cupcake|ice cream|gelato|sundae|wings|nuggets|nachos|loaded|grilled cheese|quesadilla|ranch|aioli|mayo|mayonnaise"
FATTY_NOT = r"beer|wine|ale|lager|cocktail|margarita|martini|whiskey|vodka|rum|bourbon"
FAT = (
    Rule(r"fried|crispy|battered|tempura|panko", 0.45),
    Rule(r"cheese|cheddar|mozzarella|gouda|quesadilla|nachos", 0.40),
    Rule(r"butter|cream|alfredo|carbonara|meunière", 0.45),
    Rule(r"bacon|sausage|chorizo|pancetta", 0.50),
    Rule(r"donut|doughnut|croissant|danish|pastry|churro", 0.45),
    Rule(r"burger", 0.42),
    Rule("", 0.40, category=DESSERT),
    Rule(r"brownie|cookie|cake|cupcake|ice cream|gelato|sundae", 0.40),
    Rule(r"wings|nuggets", 0.50),
    Rule(r"fries|chips|tots|poutine", 0.45),
    Rule("", 0.35),
)
FAT_PROTEIN = (
    Rule(r"chicken|beef|pork|steak|burger|bacon|sausage|wings|nuggets|fish|shrimp|lobster|crab", 0.25),
    Rule(r"cheese", 0.18),
    Rule(r"egg", 0.30),
    Rule("", 0.05, category=DESSERT),
    Rule(r"donut|cake|cookie|pastry|churro", 0.05),
    Rule("", 0.12),
)

# Whole-record templates for items without calories.
ZERO_NAMES = r"^bottled\s*water|^water$|^premium\s*(bottled\s*)?water|^sparkling\s*water|^mineral\s*water|^spring\s*water|^perrier|^evian|^smartwater|^dasani|^aquafina|h2o.*water|courtesy.*water|^small\s*water|^black\s*coffee$|^brewed\s*coffee$|^coffee$|^hot\s*coffee$|^decaf\s*coffee$|^espresso$|^double\s*espresso$|^americano$|^black\s*tea$|^hot\s*tea$|^iced\s*tea\s*\(unsweetened\)|^unsweetened\s*tea|^green\s*tea$|^herbal\s*tea$|diet\s+(coke|pepsi|soda|sprite)|coke\s*zero|zero\s*sugar|sugar[- ]?free"
TEMPLATE_COLUMNS = ("template", "calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium")
TEMPLATES = (
    Rule(r"soda|cola|sprite|fanta|root beer|dr pepper|pepsi|coke(?!\s*zero)", ("regular_soda", 140, 39, 0, 0, 39, 0, 45)),
    Rule(r"lemonade", ("lemonade", 120, 31, 0, 0, 28, 0, 10)),
    Rule(r"orange\s*juice", ("orange_juice", 110, 26, 0, 2, 22, 0, 0)),
    Rule(r"apple\s*juice", ("apple_juice", 120, 29, 0, 0, 24, 0, 10)),
    Rule(r"2%\s*milk|lowfat\s*milk", ("milk_2pct", 120, 12, 5, 8, 12, 0, 120)),
    Rule(r"chocolate\s*milk", ("chocolate_milk", 190, 26, 5, 8, 24, 1, 150)),
    Rule(r"smoothie", ("smoothie", 280, 55, 4, 6, 45, 3, 60)),
    Rule(r"shake|milkshake", ("milkshake", 550, 75, 22, 12, 65, 1, 250)),
    Rule(r"latte", ("latte", 190, 18, 7, 13, 17, 0, 170)),
    Rule(r"cappuccino", ("cappuccino", 120, 10, 4, 8, 10, 0, 100)),
    Rule(r"mocha", ("mocha", 290, 35, 11, 13, 30, 2, 150)),
    Rule(r"frappuccino|frappe", ("frappuccino", 380, 55, 15, 5, 50, 0, 220)),
    Rule(r"hot\s*(chocolate|cocoa)", ("hot_chocolate", 320, 45, 12, 10, 40, 2, 200)),
    Rule(r"\b(beer|ale|lager|stout|porter|ipa|pilsner)\b", ("beer", 150, 13, 0, 2, 0, 0, 14)),
    Rule(r"light\s*(beer|lager)", ("light_beer", 100, 5, 0, 1, 0, 0, 10)),
    Rule(r"\bwine\b", ("wine", 125, 4, 0, 0, 1, 0, 5)),
    Rule(r"cocktail|mixed\s*drink", ("cocktail", 200, 15, 0, 0, 12, 0, 10)),
    Rule(r"margarita", ("margarita", 280, 36, 0, 0, 32, 0, 580)),
    Rule(r"mimosa|bellini", ("mimosa", 120, 12, 0, 0, 10, 0, 5)),
    Rule(r"\bchips?\b", ("chips", 160, 15, 10, 2, 0, 1, 170)),
    Rule(r"popcorn", ("popcorn", 400, 48, 24, 5, 0, 8, 600)),
    Rule(r"pretzel", ("pretzel", 480, 100, 4, 12, 4, 4, 1200)),
    Rule(r"churro", ("churro", 280, 35, 14, 3, 12, 1, 200)),
    Rule(r"cookie", ("cookie", 200, 28, 9, 2, 16, 1, 120)),
    Rule(r"brownie", ("brownie", 350, 45, 18, 4, 30, 2, 150)),
    Rule(r"muffin", ("muffin", 380, 55, 15, 6, 28, 2, 350)),
    Rule(r"donut|doughnut", ("donut", 280, 35, 15, 4, 15, 1, 300)),
    Rule(r"cupcake", ("cupcake", 350, 50, 15, 3, 35, 1, 280)),
    Rule(r"cake", ("cake_slice", 400, 55, 18, 5, 40, 1, 350)),
    Rule(r"sundae", ("ice_cream_sundae", 500, 65, 24, 8, 55, 1, 180)),
    Rule(r"ice\s*cream|gelato", ("ice_cream_scoop", 200, 24, 11, 3, 21, 0, 60)),
    Rule(r"cheeseburger", ("cheeseburger", 750, 45, 42, 35, 8, 2, 1200)),
    Rule(r"burger|hamburger", ("burger", 650, 45, 35, 30, 8, 2, 1000)),
    Rule(r"hot\s*dog|corn\s*dog", ("hot_dog", 350, 35, 18, 12, 5, 1, 900)),
    Rule(r"pizza", ("pizza_slice", 300, 35, 12, 12, 4, 2, 600)),
    Rule(r"sandwich|sub|hoagie|panini", ("sandwich", 500, 45, 22, 25, 6, 3, 1100)),
    Rule(r"wrap|burrito", ("wrap", 550, 50, 25, 28, 4, 4, 1200)),
    Rule(r"taco", ("taco", 200, 20, 10, 10, 2, 2, 400)),
    Rule(r"quesadilla", ("quesadilla", 550, 40, 32, 25, 3, 3, 1100)),
    Rule(r"nacho", ("nachos", 600, 55, 35, 18, 4, 6, 1200)),
    Rule(r"chicken\s*(tender|finger|nugget|strip)", ("chicken_tenders", 450, 25, 25, 30, 1, 1, 900)),
    Rule(r"chicken\s*sandwich", ("chicken_sandwich", 550, 45, 26, 32, 6, 2, 1100)),
    Rule(r"grilled\s*chicken", ("grilled_chicken", 300, 2, 12, 45, 0, 0, 600)),
    Rule(r"fish\s*(and|&|'?n'?)\s*chips", ("fish_and_chips", 800, 70, 42, 35, 3, 4, 1000)),
    Rule(r"fried\s*shrimp|shrimp\s*basket", ("fried_shrimp", 400, 30, 22, 20, 2, 1, 800)),
    Rule(r"steak|filet|sirloin|ribeye", ("steak", 450, 0, 25, 55, 0, 0, 500)),
    Rule(r"ribs?", ("ribs", 700, 15, 45, 55, 12, 0, 900)),
    Rule(r"pulled\s*pork", ("pulled_pork", 400, 20, 22, 35, 15, 1, 800)),
    Rule(r"bbq\s*platter|bbq\s*combo", ("bbq_platter", 1100, 60, 55, 80, 25, 4, 1800)),
    Rule(r"pasta|spaghetti|fettuccine|penne", ("pasta", 650, 85, 22, 20, 8, 4, 900)),
    Rule(r"mac\s*(and|&|'?n'?)\s*cheese", ("mac_and_cheese", 500, 45, 28, 18, 6, 2, 900)),
    Rule(r"salad", ("salad", 350, 20, 25, 15, 8, 5, 600)),
    Rule(r"soup|chowder", ("soup", 250, 25, 12, 10, 6, 3, 900)),
    Rule(r"fries|french\s*fries", ("fries", 400, 50, 20, 5, 0, 4, 350)),
    Rule(r"onion\s*rings?", ("onion_rings", 450, 55, 24, 6, 6, 3, 600)),
    Rule(r"mashed\s*potatoes?", ("mashed_potatoes", 200, 30, 8, 4, 2, 3, 400)),
    Rule(r"baked\s*beans?", ("baked_beans", 180, 32, 2, 8, 12, 6, 500)),
    Rule(r"coleslaw|cole\s*slaw", ("coleslaw", 150, 12, 12, 1, 8, 2, 200)),
    Rule(r"\bcorn\b", ("corn", 120, 25, 2, 4, 5, 3, 15)),
    Rule(r"\brice\b", ("rice", 200, 45, 0, 4, 0, 1, 5)),
    Rule(r"bread|roll|biscuit", ("bread", 150, 28, 2, 5, 3, 2, 250)),
    Rule(r"pancake", ("pancakes", 450, 65, 15, 10, 15, 2, 700)),
    Rule(r"waffle", ("waffles", 400, 55, 16, 8, 12, 2, 600)),
    Rule(r"french\s*toast", ("french_toast", 450, 50, 20, 12, 20, 2, 500)),
    Rule(r"scrambled\s*eggs?|eggs?\s*benedict", ("eggs", 180, 2, 12, 14, 1, 0, 350)),
    Rule(r"bacon", ("bacon", 180, 0, 14, 12, 0, 0, 600)),
    Rule(r"sausage", ("sausage", 250, 2, 22, 12, 1, 0, 500)),
    Rule(r"breakfast\s*sandwich", ("breakfast_sandwich", 450, 35, 25, 22, 4, 2, 900)),
    Rule(r"fruit\s*cup|mixed\s*fruit", ("fruit_cup", 80, 20, 0, 1, 16, 2, 5)),
    Rule(r"\bapple\b(?!\s*juice)", ("apple", 95, 25, 0, 0, 19, 4, 2)),
    Rule(r"banana", ("banana", 105, 27, 0, 1, 14, 3, 1)),
    Rule(r"grapes", ("grapes", 100, 27, 0, 1, 23, 1, 3)),
)

# Allergens: words that mean "contains" and words that mean "may contain"; words of up to
# three letters only count as whole words.  Exclusions clear the allergen altogether.
ALLERGENS = (
    ("milk", "milk|cream|cheese|butter|yogurt|gelato|ice cream|whipped|custard|pudding|fudge|caramel|mozzarella|cheddar|parmesan|provolone|swiss|gouda|brie|feta|ricotta|mascarpone|gorgonzola|blue cheese|pepper jack|american cheese|monterey|cotija|queso|fontina|gruyere|asiago|romano|burrata|havarti|alfredo|béchamel|bechamel|carbonara|hollandaise|ranch|caesar|creamy|au gratin|scalloped|sour cream|crème|creme|fraiche|latte|cappuccino|mocha|macchiato|dulce de leche|tres leches|cheesecake|tiramisu|panna cotta|mousse|buttermilk|half and half|evaporated milk|condensed milk|milkshake|shake|smoothie|float|sundae|frosting|icing|glaze",
     "chocolate|brownie|cookie|cake|pastry|croissant|muffin|scone", r"dairy[- ]?free|vegan|non[- ]?dairy|lactose[- ]?free|oat\s*milk|almond\s*milk|soy\s*milk|coconut\s*milk"),
    ("wheat", "bread|bun|roll|bagel|baguette|ciabatta|focaccia|sourdough|brioche|croissant|english muffin|pita|naan|flatbread|toast|crouton|breadstick|crostini|pasta|noodle|spaghetti|fettuccine|penne|linguine|macaroni|lasagna|ravioli|gnocchi|udon|ramen|lo mein|chow mein|spätzle|orzo|wrap|tortilla|burrito|quesadilla|taco|enchilada|breaded|battered|fried|crispy|crusted|tempura|panko|schnitzel|katsu|cake|cookie|brownie|muffin|scone|biscuit|pastry|pie|tart|danish|strudel|turnover|donut|doughnut|churro|funnel cake|crepe|waffle|pancake|french toast|pretzel|cracker|graham|pizza|calzone|stromboli|sandwich|sub|hoagie|panini|slider|po boy|dumpling|wonton|egg roll|spring roll|pot sticker|gyoza|pierogi|empanada|samosa|flour|wheat|seitan|gravy|roux", None, None),
    ("eggs", "egg|eggs|omelette|omelet|frittata|quiche|scrambled|poached|fried egg|sunny side|over easy|hard boiled|soft boiled|deviled|mayo|mayonnaise|aioli|hollandaise|bearnaise|caesar|tartar sauce|custard|creme brulee|flan|meringue|souffle|zabaglione|sabayon|french toast|benedict|carbonara|brioche|challah",
     "cake|cookie|brownie|muffin|pastry|waffle|pancake|breaded|battered", r"egg[- ]?free|vegan"),
    ("soy", "soy|tofu|tempeh|edamame|miso|natto|soy sauce|shoyu|tamari|teriyaki|soy milk|soya", "asian|chinese|japanese|korean|thai|vietnamese|stir fry|wok", None),
    ("peanuts", "peanut|peanuts|peanut butter|groundnut|goober|arachis|pad thai|satay|kung pao", "thai|asian|trail mix", None),
    ("tree_nuts", "almond|cashew|walnut|pecan|pistachio|hazelnut|filbert|macadamia|brazil nut|chestnut|pine nut|pignoli|praline|marzipan|frangipane|gianduja|nutella|nut butter|almond butter|cashew butter|almond milk|cashew milk|hazelnut spread|baklava|biscotti", "pesto|trail mix|granola", None),
    ("fish", "fish|salmon|tuna|cod|tilapia|halibut|mahi|grouper|snapper|bass|trout|catfish|swordfish|flounder|sole|perch|walleye|sardine|anchovy|herring|mackerel|eel|sashimi|sushi|ceviche|poke|lox|gravlax|fish and chips|fish taco|fish fry|smoked fish|gefilte|worcestershire|fish sauce|nuoc mam|caesar", None, None),
    ("shellfish", "shrimp|prawn|crab|lobster|crawfish|crayfish|langostino|langoustine|scampi|clam|mussel|oyster|scallop|abalone|snail|escargot|conch|whelk|periwinkle|squid|calamari|octopus|cuttlefish|seafood|surf and turf|cioppino|bouillabaisse|paella|gumbo|jambalaya|etouffee|crab cake|lobster roll|shrimp cocktail|clam chowder|oyster rockefeller", None, None),
    ("sesame", "sesame|tahini|hummus|halvah|halva|sesame oil|sesame seed|goma|falafel|baba ghanoush|baba ganoush", "mediterranean|middle eastern|lebanese|israeli|greek|turkish|asian|sushi", None),
    ("gluten", "wheat|barley|rye|malt|triticale|beer|ale|lager|stout|porter|pilsner|bread|pasta|noodle|flour|breaded|battered|cake|cookie|brownie|pastry|pie|muffin|pretzel|cracker|croissant|bagel|pizza|wrap|tortilla|pita|soy sauce|teriyaki|gravy", None, r"gluten[- ]?free|gf\b|celiac"),
)


def allergen_pattern(words: str) -> str:
    r"""Words of up to three letters are wrapped in ``\b``."""
    return "|".join(rf"\b{w}\b" if len(w) <= 3 else w for w in words.split("|"))


# Items with researched values: (word, calories, carbs, fat, protein, sodium).
OVERRIDES = (
    (r"turkey leg", 1093, 0, 54, 150, 5284),
    (r"mickey pretzel", 480, 80, 8, 12, 1100),
    (r"ohana bread pudding", 1055, 143, 40, 15, None),
    (r"totchos", 552, 37, 29, 36, None),
)
