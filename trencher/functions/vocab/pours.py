r"""Drink classes, alcohol by volume, shots per cocktail."""

from trencher.functions.rules import Rule

# Standard grams of alcohol per drink class.
STANDARD_GRAMS = {
    "light_beer": 11, "beer": 14, "craft_beer": 18, "strong_beer": 24, "beer_flight": 14, "wine": 14, "champagne": 14,
    "sangria": 13, "mimosa": 8, "cocktail": 14, "strong_cocktail": 28, "frozen_cocktail": 18, "margarita": 16,
    "frozen_margarita": 20, "spritz": 11, "spirit_neat": 14, "liqueur_coffee": 8, "sake": 18, "mead": 15,
    "hard_cider": 14, "hard_seltzer": 12, "non_alcoholic": 0,
}
# Class rules on "name | description"; scope "name" reads the name, scope "beer" the text without soft "beers".
SOFT_BEERS = r"ginger ale|root beer|birch beer|cream ale"
_SPIRITS = r"vodka|tequila|\brum\b|\bgin\b|bourbon|whiskey|brandy|mezcal|scotch|cognac"
DRINK_CLASSES = (
    ("non_alcoholic", "both", r"non[- ]?alcoholic|zero alcohol|alcohol[- ]?free|virgin |mocktail|n/a beer", None, None),
    ("non_alcoholic", "name", r"root beer|ginger beer|birch beer|butterbeer", r"ginger beer \w*(cocktail|punch|mule)|mule|cocktail|punch|vodka|rum|gin |whiskey|bourbon|tequila", None),
    ("beer_flight", "name", r"beer flight", None, None),
    ("craft_beer", "beer", r"\bipa\b|india pale ale|double ipa|hazy ipa|pale ale|craft beer", None, None),
    ("strong_beer", "beer", r"\bstout\b|porter|imperial|belgian|tripel|dubbel|barleywine|quad", None, None),
    ("light_beer", "beer", r"\blight\b.*\bbeer\b|\bbeer\b.*\blight\b|lite beer|ultra|skinny brew|michelob|bud light|coors light|miller lite", None, None),
    ("beer", "beer", r"\blager\b|\bbeer\b|\bale\b|\bpilsner\b|\bhefeweizen\b|\bamber\b.*\bale\b|\bwheat\b.*\bbeer\b", None, None),
    ("mimosa", "name", r"mimosa", None, None),
    ("sangria", "name", r"sangria", None, None),
    ("champagne", "both", r"champagne|prosecco|sparkling wine|cava|bellini", None, None),
    ("wine", "both", r"\bwine\b|cabernet|merlot|chardonnay|pinot|riesling|sauvignon|moscato|rosé|zinfandel|shiraz|malbec", None, None),
    ("frozen_margarita", "name", r"frozen.*margarita", None, None),
    ("frozen_cocktail", "both", r"frozen|blended|slushy|slushie|icee.*rum|icee.*vodka", None, r"vodka|rum|tequila|gin |whiskey|bourbon|liqueur|cocktail"),
    ("margarita", "name", r"margarita", None, None),
    ("strong_cocktail", "both", r"long island|zombie|jungle juice|fish bowl|scorpion bowl|hurricane|mai tai|painkiller", None, None),
    ("spritz", "both", r"spritz|aperol", None, None),
    ("liqueur_coffee", "both", r"irish coffee|coffee.*liqueur|liqueur.*coffee|bailey.*coffee|kahlua.*coffee|amarula.*coffee|african coffee", None, None),
    ("cocktail", "both", r"cocktail|mojito|daiquiri|mule|cosmopolitan|old fashioned|manhattan|negroni|paloma|sour\b|martini|colada|punch.*rum|punch.*vodka|smash|fizz\b|highball|julep|caipirinha|tiki", None, None),
    ("spirit_neat", "both", _SPIRITS, None, r"neat|on the rocks|straight|shot|tasting"),
    ("cocktail", "both", _SPIRITS, None, None),
    ("sake", "both", r"\bsake\b|nigori|junmai|daiginjo", None, None),
    ("mead", "both", r"\bmead\b", None, None),
    ("hard_cider", "both", r"hard cider|\bcider\b.*\balcohol", None, None),
    ("hard_seltzer", "both", r"hard seltzer|white claw|truly|high noon", None, None),
    ("cocktail", "both", r"liqueur|abv|proof|alcohol", None, None),
)

BEER_ABV = tuple(Rule(p, v) for p, v in (
    (r"bud light", 4.2), (r"coors light", 4.2), (r"miller lite", 4.17), (r"mich(elob)? ultra", 4.2), (r"natural light|natty light", 4.2),
    (r"keystone light", 4.1), (r"busch light", 4.1), (r"amstel light", 3.5), (r"corona premier", 4.0), (r"budweiser", 5.0),
    (r"corona extra", 4.6), (r"corona", 4.6), (r"modelo negra", 5.4), (r"modelo especial", 4.4), (r"modelo", 4.4),
    (r"heineken 0\.0|heineken zero", 0.0), (r"heineken", 5.0), (r"stella artois", 5.2), (r"yuengling", 5.3), (r"dos equis", 4.7),
    (r"pacifico", 4.4), (r"tecate", 4.5), (r"pabst|pbr", 4.8), (r"foster'?s", 5.0), (r"guinness", 4.2), (r"bass ale", 5.1),
    (r"newcastle", 4.7), (r"sapporo", 4.9), (r"kirin", 4.9), (r"asahi", 5.0), (r"tsing ?tao", 4.7), (r"peroni", 5.1),
    (r"leffe blonde", 6.6), (r"leffe", 6.6), (r"hoegaarden", 4.9), (r"kona longboard", 4.6), (r"kona big wave", 4.4), (r"kona", 4.6),
    (r"blue moon", 5.4), (r"sam adams boston", 4.9), (r"samuel adams|sam adams", 4.9), (r"sierra nevada pale", 5.6),
    (r"sierra nevada torpedo", 7.2), (r"sierra nevada celebration", 6.8), (r"sierra nevada", 5.6), (r"lagunitas daytime", 4.6),
    (r"lagunitas ipa", 6.2), (r"lagunitas", 6.2), (r"goose island ipa", 5.9), (r"goose island 312", 4.2), (r"goose island", 5.9),
    (r"dogfish head 90", 9.0), (r"dogfish head 60", 6.0), (r"dogfish head", 6.0), (r"cigar city jai alai", 7.5), (r"cigar city", 5.5),
    (r"angry orchard", 5.0), (r"ace cider", 5.0), (r"bold rock", 4.7), (r"magners", 4.5), (r"woodchuck", 5.0), (r"stone ipa", 6.9),
    (r"stone", 5.5), (r"fat tire", 5.2), (r"new belgium", 5.2), (r"bells two hearted", 7.0), (r"founders all day", 4.7),
    (r"ballast point sculpin", 7.0), (r"sweetwater", 5.3), (r"terrapin", 5.3), (r"funky buddha", 5.7), (r"elysian space dust", 8.2),
    (r"firestone walker", 5.5), (r"oskar blues dale'?s", 6.5), (r"voodoo ranger", 7.0), (r"hazy ipa", 6.5), (r"allagash white", 5.2),
    (r"wicked weed", 5.5), (r"pseudo sue", 5.8), (r"big wave", 4.4), (r"landshark", 4.6), (r"safari amber", 5.0), (r"kungaloosh", 5.0),
    (r"volcano blossom", 5.0), (r"duff beer", 4.8), (r"simpsons", 4.8), (r"victory golden monkey", 9.5), (r"chimay", 7.0), (r"duvel", 8.5),
    (r"delirium tremens", 8.5), (r"la fin du monde", 9.0), (r"unibroue", 5.0), (r"tripel", 8.0), (r"dubbel", 7.0), (r"barleywine", 10.0),
    (r"imperial stout", 9.0), (r"imperial ipa", 8.5), (r"double ipa|dipa", 8.0), (r"white claw", 5.0), (r"truly", 5.0), (r"high noon", 4.5),
    (r"vizzy", 5.0), (r"hard seltzer", 5.0), (r"hard cider", 5.0), (r"\bipa\b|india pale ale", 6.5), (r"pale ale", 5.5), (r"\bstout\b", 5.5),
    (r"\bporter\b", 5.5), (r"\blager\b", 5.0), (r"\bpilsner\b", 5.0), (r"hefeweizen|wheat beer", 5.0), (r"amber ale", 5.3), (r"\bale\b", 5.0),
    (r"\bbeer\b", 5.0), (r"oktoberfest|marzen|märzen", 5.5),
))
COCKTAIL_SHOTS = tuple(Rule(p, v) for p, v in (
    (r"long island", 3.5), (r"texas tea", 3.5), (r"dockside iced tea", 3.0), (r"zombie", 3.0), (r"jungle juice", 2.5), (r"fish bowl", 3.0),
    (r"scorpion bowl", 3.0), (r"martini", 2.0), (r"manhattan", 2.0), (r"old fashioned", 2.0), (r"negroni", 2.0), (r"sazerac", 2.0),
    (r"mai tai", 2.0), (r"hurricane", 2.0), (r"painkiller", 2.0), (r"margarita", 1.5), (r"mojito", 1.5), (r"moscow mule|mule", 1.5),
    (r"paloma", 1.5), (r"cosmopolitan|cosmo\b", 1.5), (r"daiquiri", 1.5), (r"caipirinha", 1.5), (r"pi[nñ]a colada|colada", 1.5),
    (r"rum punch|punch.*rum", 1.5), (r"whiskey sour|bourbon sour", 1.5), (r"gin and tonic|gin & tonic|g&t\b", 1.5), (r"vodka tonic|vodka soda", 1.5),
    (r"rum and coke|cuba libre", 1.5), (r"tom collins", 1.5), (r"gimlet", 1.5), (r"sidecar", 1.5), (r"dark 'n' stormy|dark and stormy", 1.5),
    (r"julep", 1.5), (r"highball", 1.5), (r"tequila sunrise", 1.5), (r"fuzzy tauntaun", 1.5), (r"jedi mind trick", 1.5), (r"t-?16 skyhopper", 1.5),
    (r"dagobah slug", 1.5), (r"bespin fizz", 1.5), (r"jet juice", 1.5), (r"outer rim", 1.5), (r"tipsy ducks in love", 1.5), (r"grog", 1.5),
    (r"skipper sipper", 1.5), (r"aperol spritz|spritz", 0.8), (r"hugo spritz", 0.5), (r"bellini", 0.8), (r"mimosa", 0.6), (r"kir royale", 0.9),
    (r"shandy", 0.5), (r"\bshot\b|neat|on the rocks|straight", 1.0),
))
WINE_ABV = (
    (r"cabernet sauvignon|cabernet", 14.0), (r"merlot", 14.5), (r"pinot noir", 13.5), (r"shiraz|syrah", 14.0), (r"malbec", 13.5),
    (r"zinfandel", 14.5), (r"tempranillo|rioja", 13.5), (r"chianti|sangiovese", 13.0), (r"red blend", 13.5), (r"chardonnay", 13.5),
    (r"sauvignon blanc", 12.5), (r"pinot grigio|pinot gris", 12.0), (r"riesling", 11.0), (r"moscato", 5.5), (r"gewurztraminer|gewürztraminer", 13.0),
    (r"viognier", 14.0), (r"white blend", 12.5), (r"champagne", 12.5), (r"prosecco", 11.0), (r"cava", 11.5), (r"sparkling wine|sparkling", 12.0),
    (r"rosé|rose wine", 12.0), (r"daiginjo", 16.0), (r"junmai", 15.5), (r"nigori", 15.0), (r"\bsake\b", 15.5), (r"mead", 12.5),
    (r"sangria", 9.0), (r"port\b", 20.0), (r"sherry", 17.0), (r"vermouth", 16.0), (r"red wine", 13.5), (r"white wine", 12.5), (r"\bwine\b", 13.0),
)
LIQUEUR_ABV = tuple(Rule(p, v) for p, v in (
    (r"baileys|bailey'?s", 17.0), (r"irish cream", 17.0), (r"kahlua|kahlúa", 20.0), (r"amarula", 17.0), (r"frangelico", 20.0), (r"cointreau", 40.0),
    (r"grand marnier", 40.0), (r"chambord", 16.5), (r"midori", 20.0), (r"disaronno|amaretto", 28.0), (r"campari", 25.0), (r"aperol", 11.0),
    (r"blue cura[cç]ao", 25.0), (r"triple sec", 23.0), (r"schnapps", 20.0), (r"falernum", 11.0), (r"st[.-]? ?germain|elderflower liqueur", 20.0),
))
SPIRITS = r"\bvodka\b|\btequila\b|\bmezcal\b|\b(?:dark |light |white |spiced |aged |coconut )?rum\b|\bgin\b|\bbourbon\b|\bwhiskey\b|\bwhisky\b|\brye\b|\bscotch\b|\bcognac\b|\bbrandy\b|\babsinthe\b|\bcachaça\b"
LIQUEURS = r"liqueur|schnapps|curaçao|curacao|triple sec|amaretto|falernum|campari|aperol"
FOOD_NOT_DRINK = r"soup|dip|fondue|sauce|glaze|batter|braised|braise|brined|rubbed|crusted"
LIQUEUR_COFFEE = r"coffee.*liqueur|liqueur.*coffee|bailey.*coffee|kahlua.*coffee|amarula.*coffee|african coffee|cream liqueur.*coffee|coffee.*cream liqueur"
WINE_NAME = r"\bwine\b|cabernet|merlot|chardonnay|pinot|riesling|moscato|rosé|zinfandel|shiraz|malbec|prosecco|champagne|cava|sangria|\bsake\b|nigori|junmai|mead|port\b|sherry"
SAKE = r"sake|nigori|junmai|daiginjo"
OUNCES = r"\(?\b(\d{1,2})\s*(?:oz|ounce)s?\b\)?"
ML_PER_OZ, ETHANOL_DENSITY, GRAMS_PER_SHOT = 29.5735, 0.789, 14
