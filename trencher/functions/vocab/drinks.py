r"""Fixed values: (include, exclude) pairs of the two longer drink detectors."""

BREWERS = r"modelo|corona|heineken|budweiser|stella artois|yuengling|samuel adams|peroni|chimay|coors|blue moon|strongbow|schöfferhofer|warsteiner|kronenbourg|amstel|beck|dos equis|pacifico|negra modelo|lagunitas|goose island|cigar city|funky buddha|terrapin|sweetwater|dogfish|sierra nevada|new belgium|fat tire|blue point"

# Name tests of the energy-gap aware detector.
GAP_AWARE = (
    (rf"\b({BREWERS}|high noon|allagash|ommegang|delirium|duvel|crooked can|duff|kirin|estrella|coedo|new holland|bud light|safari amber|rochefort|trappist)\b", r"batter|bread|sauce|braise|glaze|crust|rub|marinate|infuse"),
    (r"\b(ipa|pilsner|lager|stout|porter|hefeweizen|shandy|gose|pale ale|wheat beer|draft beer|craft beer|on tap|saison|draft\b|draught)\b", r"batter|bread|sauce|braise|glaze|ginger ale|beer.batter"),
    (r"\b(martini|margarita|mojito|daiquiri|paloma|negroni|spritz|mule|bellini|mimosa|sangria|old fashioned|mai tai|pi[ñn]a colada|cosmopolitan|manhattan|sidecar|highball|toddy|boulevardier|sazerac|aperol|bloody mar[yi]s?|gimlet|cosmo.politan|long island iced tea|rita\b|blue hawaii|blue lagoon)\b", r"burger|chicken|pork|steak|fries|sandwich|doughnut|donut|cake\b|cookie"),
    (r"\b(tequila|mezcal|vodka|bourbon|whisky|whiskey|scotch|rum|gin\b|brandy|cognac|sake\b|soju|amarula|liqueur|liquor|fernet|jägermeister|jagermeister)\b", r"batter|sauce|braise|glaze|crust|rub|marinate|infuse|vodka sauce|alla vodka|rum cake|bourbon glaze|whiskey sauce|beer.batter"),
    (r"\b(pinot|cabernet|chardonnay|merlot|riesling|sauvignon blanc|prosecco|champagne|rosé|shiraz|malbec|tempranillo|grenache|zinfandel|chianti|barolo|rioja|chablis|chenin blanc|brut|wines?\s+by\s+the)\b", r"sauce|braise|reduction|glaze|braised|rubbed|marinate|infuse|cupcake|cake"),
    (r"\b(beer|wine|cocktail|boozy)\b", r"root beer|ginger beer|butter.?beer|beer.?batter|beer.?bread|beer.?cheese|wine.?sauce|wine.?braised|wine.?reduction|wine.?vinaigrette|wine.?bar|wine.?country"),
    (r"\b21\+", None),
    (r"\bbrew\b", r"brew pub|brewery|brewed chicken|home.?brew"),
    (r"\b(canned|craft|bottled|domestic|imported|draft)\s+(beer|ale|lager|wine)s?\b", None),
    (r"\b(fire whiskey|wizard'?s brew|grog|mead|butterbeer)\b", r"fudge|cake|ice cream|potted cream"),
    (r"frozen\s+(flight|slush|punch)", None),
)
TOP_SHELF_PLACE = r"bar|cantina|tequila|margarita|lounge|tavern|cava"
DRAFT_NAME, DRAFT_NOT = r"\b(draft|seasonal draft|honey pilsner|pilsner)\b", r"draft pick|draft house"
DRAFT_PLACE = r"bar|pub|lounge|tap|grill|brew"
BAR_LIKE = r"\b(bar|pub|lounge|cantina|tavern|grog|brew|tap\s*house|tiki|wine bar|tonic|cocktail|astropub|watering hole|saloon|speakeasy|cava|smoothie|joffrey|promenade|showcase)"

# The calorie repairers' test for drinks filed as food.
BEVERAGE_NAMES = (
    (rf"\b({BREWERS})\b", None),
    (r"\b(ipa|pilsner|lager|stout|porter|hefeweizen|shandy|gose|amber|pale ale|wheat beer|draft beer|craft beer|on tap)\b", r"batter|bread|sauce|braise|glaze|crust|rub|marinate"),
    (r"\b(martini|margarita|mojito|daiquiri|paloma|negroni|spritz|mule|bellini|mimosa|sangria|old fashioned|mai tai|piña colada|cosmopolitan|manhattan|sidecar|highball|toddy|fizz|sour|boulevardier|sazerac)\b", r"burger|chicken|pork|steak|fries|sandwich"),
    (r"\b(tequila|mezcal|vodka|bourbon|whisky|whiskey|scotch|rum|gin|brandy|cognac|sake|soju)\b", r"batter|sauce|braise|glaze|crust|rub|marinate|infuse|vodka sauce|alla vodka|penne vodka|bourbon glaze|rum cake|bourbon sauce|whiskey sauce"),
    (r"\b(pinot|cabernet|chardonnay|merlot|riesling|sauvignon blanc|prosecco|champagne|rosé|shiraz|malbec|tempranillo|grenache|zinfandel|chianti|barolo|rioja|chablis)\b", r"sauce|braise|reduction|glaze|braised|rubbed|marinate|infuse"),
    (r"\b(cold brew|espresso|latte|cappuccino|americano|macchiato|frappuccino|smoothie|milkshake|juice|soda|lemonade|tea\b|chai\b|matcha|refresher|punch|agua fresca|boba)\b", r"cake|cookie|brownie|ice cream|crust|sauce"),
    (r"\b(butterbeer|wizard'?s brew|daisyroot draught|fishy green ale|gillywater|otter'?s fizzy|fire whiskey|grog|mead|potion|elixir|libation|freeze|slush)\b", r"fudge|potted cream|ice cream|cake|crêpe"),
    (r"\b(flight|on the rocks|neat|up|double|single malt|reserve|aged|barrel|cask)\b.*\b(tequila|whiskey|bourbon|sake|wine|beer|scotch|rum|vodka|gin)\b|\b(tequila|whiskey|bourbon|sake|wine|beer|scotch|rum|vodka|gin)\b.*\b(flight|on the rocks|neat|up|double|single malt|reserve|aged|barrel|cask)\b", None),
    (r"\bhigh noon\b", None),
)
# The ingredient estimator's shorter list.
DISH_NOT_DRINK = (
    (r"\b(beer|ale|lager|ipa|pilsner|stout|porter|wine|cocktail|margarita|mojito|daiquiri|martini|sangria|spritz|mule|bellini|mimosa|sour|fizz|highball|toddy|negroni|paloma|sazerac|flight)\b", r"cake|cookie|brownie|sauce|batter|bread|ice cream"),
    (r"\b(tequila|mezcal|vodka|bourbon|whisky|whiskey|scotch|rum|gin|brandy|sake|soju)\b", r"sauce|glaze|cake|braised"),
    (r"\b(chardonnay|cabernet|merlot|pinot|riesling|prosecco|champagne|rosé|shiraz|malbec)\b", None),
    (r"\b(cold brew|espresso|latte|cappuccino|americano|smoothie|milkshake|juice|soda|lemonade|tea\b|matcha|refresher|slush)\b", r"cake|cookie|crust|sauce"),
    (r"\b(modelo|corona|heineken|budweiser|stella|yuengling|peroni|strongbow|blue moon|high noon)\b", None),
)
# The refill script's name test, also used with bar names.
SIMPLE_INCLUDE = r"\b(beer|ale|lager|stout|ipa|wine|merlot|chardonnay|cabernet|pinot|prosecco|champagne|margarita|mojito|daiquiri|martini|manhattan|cocktail|bourbon|whiskey|vodka|rum|tequila|gin|sake|sangria|spritz|aperol|negroni|paloma|mai\s*tai|old\s*fashioned|mule|sour|collins|highball|flight|on\s*the\s*rocks|hard\s*cider|hard\s*seltzer|mimosa|bellini)\b"
SIMPLE_EXCLUDE = r"\b(batter(?:ed)?|bread(?:ed)?|sauce|glaze|glazed|crust(?:ed)?|brined|braised|marinated|infused|root\s*beer|ginger\s*beer|ginger\s*ale|butterbeer|shrimp\s*cocktail|fruit\s*cocktail)\b"
SIMPLE_PLACE = r"\b(bar|lounge|cantina|pub|tavern|grog|grotto)\b"
