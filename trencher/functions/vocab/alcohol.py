r"""Word lists that tell alcoholic drinks from food and soft drinks.

Patterns are matched on lower-cased names (descriptions case-insensitively).
"""

NEGATIVE = r"\b(batter(?:ed)?|bread(?:ed)?|sauce|glaze|glazed|crust(?:ed)?|brined|braised|marinated|infused|cookie|root\s*beer|ginger\s*beer|ginger\s*ale|butterbeer|cream\s*soda|rum\s*cake|punch\s*cake|beer\s*cheese|sweet\s*(?:and|&)\s*sour|sour\s*cream)\b"
DEFINITIVE_COCKTAIL = r"\b(martinis?|margaritas?|mojitos?|daiquiris?|manhattans?|negronis?|cosmopolitans?|pi[nñ]a\s*coladas?|mai\s*tais?|long\s*islands?|espresso\s*martinis?|micheladas?|mules?|palomas?|mimosas?|bellinis?)\b"
BEER = r"\b(beer|ale|lager|stout|ipa|pilsner|porter|hefeweizen|saison|gose|shandy|wheat\s*beer|pale\s*ale|draught|amber|apa)\b"
WINE = r"\b(wines?|merlot|chardonnay|cabernet|pinot|prosecco|champagne|riesling|moscato|sangria|ros[eé]|sauvignon|shiraz|tempranillo|grüner|glühwein|malbec|grillo|vermentino|regale|brut|froscato|froz[eé']|friezling|cavicchioli|cotes\s*du\s*rhone)\b"
COCKTAIL = r"\b(margaritas?|mojitos?|daiquiris?|martinis?|manhattans?|cosmopolitans?|old\s*fashioned|negronis?|palomas?|pi[nñ]a\s*coladas?|mai\s*tais?|long\s*island|mules?|sours?|sling|collins|julep|caipirinha|rickey|gimlet|highball|toddy|smash|swizzle|spritzer|espresso\s*martinis?|coladas?|mudslides?|micheladas?|mimosas?|bellinis?|bees?\s*knees|punch|cosmo|ritas?|lava\s*flow)\b"
SPIRIT = r"\b(bourbon|whiskey|whisky|vodka|rum|tequila|gin|sake|mead|mezcal|absinthe|grappa|schnapps|amaretto|kahlua|bailey'?s|jägermeister|limoncello|amarula|cachaça|liqueur|malibu|raicilla|raclcilla|sotol)\b"
OTHER = r"\b(hard\s*cider|hard\s*seltzer|hard\s*lemonade|mimosas?|bellinis?|spritz|aperol|cocktail|on\s*the\s*rocks|neat|proof|abv|tipsy|boozy|spiked|spirited|with\s*alcohol|with\s*(?:rum|vodka|tequila|whiskey|bourbon|gin)|dole\s*whip\s*flight)\b"
BRAND_BEER = r"\b(michelob\s*ultra|miller\s*lite|bud\s*light|modelo\s*especial|heineken|corona(?!\s*chicken)|stella\s*artois|yuengling|kronenbourg|delirium\s*tremens|dragon'?s?\s*milk|duvel|guinness|crooked\s*can|perrier[- ]jouët|pbr|pabst|dos\s*equis|blue\s*moon|sam\s*adams|samuel\s*adams|budweiser|coors|tecate|pacifico|lagunitas|sierra\s*nevada|fat\s*tire|shock\s*top|landshark|kona|red\s*stripe)\b"
BRAND_SELTZER_CIDER = r"\b(high\s*noon|white\s*claw|truly|topo\s*chico\s*hard|strongbow|angry\s*orchard|magners|aval\s*french|rekorderlig|woodchuck|smith\s*&\s*forge|ace\s*cider)\b"
AGE_RESTRICTED = r"\(21\+\)|must\s*be\s*21|adults?\s*only"
BAR_PLACE = r"\b(bar|lounge|cantina|pub|tavern|taphouse|tap\s*house|taproom|tap\s*room|grog|grotto|grill\s*&?\s*bar|tonic|wine\s*bar)\b"
SOFT_DRINK = r"\b(water|dasani|aquafina|evian|coca[- ]?cola|coke|pepsi|sprite|fanta|dr\.?\s*pepper|mountain\s*dew|coffee|espresso|latte|cappuccino|americano|mocha|macchiato|cold\s*brew|tea|chai|matcha|juice|smoothie|milkshake|shake|float|malt|dole\s*whip|icee|slush|frapp|hot\s*chocolate|cocoa|apple\s*cider|milk(?!\s*stout)|chocolate\s*milk|powerade|gatorade|freestyle|fountain\s*drink|kids?\b|child|soda\b)\b"
KNOWN_NAMES = (
    "lost on safari", "sherbet lemon", "yak attack", "pink himalayan", "everest escape",
    "dockside iced tea", "beach bum", "texas tea", "shark tooth",
)

# The row trigger's shorter list.
TRIGGER_INCLUDE = r"\b(beer|ale|lager|stout|ipa|pilsner|porter|wine|sangria|mimosa|champagne|prosecco|bellini|cocktail|margarita|martini|daiquiri|mojito|paloma|mule|spritz|sour|old fashioned|negroni|bourbon|whiskey|vodka|rum|tequila|gin|sake|soju|mead|cider)\b"
TRIGGER_EXCLUDE = r"(beer[- ]batter|beer[- ]brais|beer[- ]cheese|beer[- ]bread|wine[- ]brais|wine[- ]infus|wine[- ]poach|wine[- ]reduc|wine[- ]sauce|wine[- ]glaz|root beer|butterbeer|ginger beer|birch beer|rum[- ]cake|rum[- ]glaz|rum[- ]sauce|rum[- ]infus)"

# The quality report's list, and the wider one that also excuses energy mismatches.
QUALITY_ALCOHOL = r"beer|wine|cocktail|margarita|martini|whiskey|vodka|rum|bourbon|scotch|tequila|sangria|mimosa|bellini|mojito|daiquiri"
MISMATCH_EXPECTED = r"beer|wine|cocktail|margarita|martini|whiskey|vodka|rum|bourbon|scotch|tequila|sangria|mimosa|bellini|mojito|daiquiri|ale|lager|ipa|stout|pilsner|sangria|sake|champagne|prosecco|cognac|brandy|gin|vermouth|liqueur|moonshine|cider|mead|coffee|tea|espresso|americano|cold brew|latte"
