"""Boolean and categorical detectors over names, descriptions and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.numeric import zero_if_null
from trencher.functions.rules import present
from trencher.functions.text import clean_display, display_name, edges
from trencher.functions.vocab import alcohol as A
from trencher.functions.vocab import drinks as D
from trencher.functions.vocab.foods import FOOD_TYPES

# Patterns on lower-cased text.
HEADER_WORDS = r"^(choose|select|pick|build|create|customize|make it yours)\b"
MERCHANDISE = r"\b(mug|tote|shirt|gift card|keychain|ornament|lanyard)\b"
FOOD_CONTEXT = r"\b(pork|chicken|shrimp|crab(?:meat)?|lobster|mussels?|fish|salmon|tuna|steak|beef|turkey|dog|burger|fries|pasta|ravioli|gnocchi|flatbread|pizza|popcorn|potato|onion|rings?|pretzel|cheese|bisque|soup|chowder|pie|brownie|churro|cookie|cake|cupcake|cheesecake|pudding|ganache|chocolate|chocolat|fudge|caramel|cranachan|bananas?|bread|sandwich(?:es)?|wrap|salad|brine|battered|braised|glazed|rubbed|crusted|marinated|infused|sauce|reduction|compote|vinaigrette|soft-serve|ice cream|tiramisu|mousse|custard|sundae)\b"
DRINK_WORDS = r"\b(cabernet|merlot|pinot|chardonnay|champagne|prosecco|sangria|lager|ipa|stout|porter|cocktail|martini|margarita|mojito|soda|cola|coffee|latte|espresso|lemonade|beer|ale|cider|wine|tea|old fashioned)\b"
COFFEE_AND_JUICE = r"\b(latte|cappuccino|mocha|espresso|coffee|cold brew|tea|chai|juice|smoothie|milk|hot chocolate|cocoa|frappuccino|macchiato|americano)\b"
FRIED_PASTRY = r"\b(fried|crispy|pastry|pie|croissant|donut|doughnut|fritter|churro)\b"
MEAT = r"\b(chicken|beef|pork|turkey|steak|ribs|brisket|fish|salmon|shrimp|lobster|lamb|sausage|bacon|ham)\b"
DESSERT_LIKE = r"ice cream|sundae|cake\b|cookie\b|brownie|cupcake|cheesecake|pie\b|cobbler|pudding|mousse|tart\b|crème brûlée|churro|dole whip|sorbet|gelato|fudge|candy|chocolate\b|macarons?|tiramisu|panna cotta|waffle cone|funnel cake|beignet"
VEGETARIAN = r"\bveg(an|etarian)\b|plant.based|impossible|beyond meat|tofu|tempeh|jackfruit"
FRIED = r"\bfri(ed|es)\b|crispy|tempura|battered|deep.fry|croquette|corn dog|schnitzel"
PLACEHOLDER = r"details coming soon|menu coming soon|tba\b|^n/a$"


def any_case(pattern: str) -> str:
    return "(?i)" + pattern


def section_header(name: Column) -> Column:
    """Menu headings that were scraped as items ("Choose your sauce"); blank names count too."""
    cleaned = clean_display(name)
    quantity = cleaned.rlike(r"^\d+\s+[A-Za-z]") & ~F.coalesce(name, F.lit("")).rlike(r"^\d+\.\s+")
    return (
        F.when(cleaned == "", True)
        .when(cleaned.rlike(r"^\d+%") | quantity, False)
        .otherwise(F.lower(cleaned).rlike(edges(HEADER_WORDS)))
    )


def display_category() -> Column:
    """Category shown to readers: drink words turn an item into a beverage unless food is in sight."""
    name = F.lower(display_name(F.col("name")))
    drinkish = (zero_if_null(F.col("alcohol_grams")) > 0) | name.rlike(edges(DRINK_WORDS))
    return (
        F.when((F.col("category") == "beverage") | name.rlike(edges(MERCHANDISE)), F.col("category"))
        .when(drinkish & ~name.rlike(edges(FOOD_CONTEXT)), "beverage")
        .otherwise(F.col("category"))
    )


def likely_alcoholic(name: Column | None = None, description: Column | None = None, place: Column | None = None) -> Column:
    """Definitive drink names win, then general words, then the description; cooking
    words veto the last resort, which is being a non-soft item at a bar."""
    text = F.lower(F.col("name") if name is None else name)
    desc = F.coalesce(F.col("description") if description is None else description, F.lit(""))
    venue = F.coalesce(F.col("restaurant_name") if place is None else place, F.lit(""))
    by_name = (
        text.rlike(edges("|".join((A.DEFINITIVE_COCKTAIL, A.BRAND_BEER, A.BRAND_SELTZER_CIDER, A.AGE_RESTRICTED))))
        | text.isin(*A.KNOWN_NAMES)
        | (text.rlike(edges(r"\bcocktail\b")) & ~text.rlike(edges(r"\b(shrimp|prawn|fruit|crab|seafood)\b")))
        | (text.rlike(edges(r"\bbrew\b")) & ~text.rlike(edges(r"\bcold\s*brew\b")))
        | text.rlike(edges(r"\bflight\b|frozen.*(?:alcohol|with\s+(?:rum|vodka|tequila))|with\s+alcohol"))
        | text.rlike(edges("|".join((A.BEER, A.WINE, A.COCKTAIL, A.SPIRIT, A.OTHER))))
    )
    by_description = desc.rlike(edges(
        any_case("|".join((A.SPIRIT, A.COCKTAIL, A.BEER, A.WINE, A.OTHER, A.BRAND_BEER, A.DEFINITIVE_COCKTAIL)))
    )) | (desc.rlike(edges(r"\bDO\b")) & desc.rlike(edges(any_case(r"\b(Spain|France|Italy|Portugal)\b"))))
    at_bar = venue.rlike(edges(any_case(A.BAR_PLACE))) & ~text.rlike(edges(A.SOFT_DRINK))
    return by_name | by_description | (~text.rlike(edges(A.NEGATIVE)) & at_bar)


def trigger_alcoholic(name: Column) -> Column:
    """The row trigger's own, shorter test (name only)."""
    text = F.lower(F.coalesce(name, F.lit("")))
    return text.rlike(edges(A.TRIGGER_INCLUDE)) & ~text.rlike(edges(A.TRIGGER_EXCLUDE))


def likely_beverage() -> Column:
    return (F.col("category") == "beverage") | F.lower("name").rlike(edges(COFFEE_AND_JUICE))


def infer_vegetarian(text: Column) -> Column:
    return F.lower(text).rlike(edges(VEGETARIAN))


def infer_fried(text: Column) -> Column:
    return F.lower(text).rlike(edges(FRIED))


def placeholder(name: Column) -> Column:
    return F.lower(name).rlike(edges(PLACEHOLDER))


# Ordered place patterns.
PARK_TYPES = (
    (r"disney (dream|fantasy|magic|treasure|wish|wonder)\b", "cruise-ship"),
    (r"typhoon lagoon|volcano bay|blizzard beach|aquatica", "water-park"),
    (r"disney springs|downtown disney|citywalk|universal citywalk", "district"),
    (r"resort|hotel|inn\b|lodge\b|floridian|contemporary|polynesian|wilderness|boardwalk|riviera|coronado|caribbean|saratoga|yacht|beach club|pop century|art of animation|all-star|swan|dolphin|aulani|portofino|sapphire|stella nova|terra luna|cabana bay|hard rock|aventura|endless summer|royal pacific|surfside", "resort"),
    (r"magic kingdom|epcot|hollywood studios|animal kingdom|universal studios|islands of adventure|epic universe|disneyland park|disney california|seaworld|busch gardens|dollywood|kings island", "theme-park"),
)
LOCATIONS = (
    (r"aulani", "Aulani Resort"),
    (r"disney (magic|wonder|dream|fantasy|wish|treasure)", "Disney Cruise Line"),
    (r"downtown disney|disneyland", "Disneyland Resort"),
    (r"disney|magic kingdom|epcot|hollywood studios|animal kingdom", "Walt Disney World"),
    (r"epic universe", "Universal Orlando Resort"),
    (r"universal.*(hollywood|studios hollywood)", "Universal Hollywood"),
    (r"universal|islands of adventure|volcano bay", "Universal Orlando Resort"),
    (r"seaworld|busch gardens", "SeaWorld Parks"),
    (r"dollywood", "Dollywood"),
    (r"kings island", "Kings Island"),
)
TIMEZONES = ((r"aulani", "Pacific/Honolulu"), (r"disneyland|downtown disney|hollywood", "America/Los_Angeles"))


def first_label(text: Column, pairs: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    (pattern, label), *rest = pairs
    out = F.when(text.rlike(edges(pattern)), label)
    for pattern, label in rest:
        out = out.when(text.rlike(edges(pattern)), label)
    return out.otherwise(otherwise)


def park_type(name: Column) -> Column:
    return first_label(F.lower(name), PARK_TYPES, "other")


def park_location(name: Column) -> Column:
    return first_label(F.lower(name), LOCATIONS, "Other")


def park_timezone(name: Column) -> Column:
    return first_label(F.lower(name), TIMEZONES, "America/New_York")


def canonical_park_name(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return (
        F.when(key == "magic kingdom", "Magic Kingdom Park")
        .when(key == "hollywood studios", "Disney's Hollywood Studios")
        .when(key == "walt disney world parks", "Walt Disney World Specialty Carts")
        .otherwise(name)
    )


def any_pair(text: Column, pairs) -> Column:
    """True where some pattern matches and its own exclusion does not."""
    out = F.lit(False)
    for include, exclude in pairs:
        test = text.rlike(edges(include))
        out = out | (test & ~text.rlike(edges(exclude)) if exclude else test)
    return out


def gap_aware_alcoholic() -> Column:
    """Drink test that also reads place, category and the energy the macros cannot explain."""
    name, place = F.lower("name"), F.lower(F.coalesce("restaurant_name", F.lit("")))
    fat, protein, carbs, calories = (zero_if_null(F.col(c)) for c in ("fat", "protein", "carbs", "calories"))
    implied = protein * 4 + carbs * 4 + fat * 9
    over = F.when(implied > 0, calories / implied).otherwise(F.lit(0.0))
    drink = F.col("category") == "beverage"
    return (
        any_pair(name, D.GAP_AWARE)
        | (name.rlike(edges(r"\btop shelf\b")) & place.rlike(edges(D.TOP_SHELF_PLACE)))
        | (name.rlike(edges(D.DRAFT_NAME)) & ~name.rlike(edges(D.DRAFT_NOT)) & (drink | place.rlike(edges(D.DRAFT_PLACE))))
        | (place.rlike(edges(D.BAR_LIKE)) & ((fat < 5) | name.rlike("punch") | (name.rlike("flight") & ~name.rlike("chicken flight"))))
        | (drink & (fat <= 1) & (protein <= 2) & (calories > 100))
        | ((fat == 0) & (calories > 100) & (((protein <= 2) & (over > 1.5)) | ((protein <= 15) & (over > 2.0))))
    )


def beverage_by_name(name: Column) -> Column:
    return any_pair(F.lower(name), D.BEVERAGE_NAMES)


def dish_is_drink() -> Column:
    return (F.col("category") == "beverage") | any_pair(F.lower("name"), D.DISH_NOT_DRINK)


def simple_drink() -> Column:
    name, place = F.lower("name"), F.lower(F.coalesce("restaurant_name", F.lit("")))
    return (
        (F.col("category") == "beverage")
        | (name.rlike(edges(D.SIMPLE_INCLUDE)) & ~name.rlike(edges(D.SIMPLE_EXCLUDE)))
        | place.rlike(edges(D.SIMPLE_PLACE))
    )


def with_food_types(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Adds ``food_types``: every matching type in order, with a generic type as the fallback.

    The "bare" types look at what matched before them, so the array grows in
    projected steps instead of nested copies of one expression.
    """
    if text is None:
        text = F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit(""))))
    df = df.withColumn("_t", text).withColumn("food_types", F.array().cast("array<string>"))

    def hit(include: str, exclude: str | None) -> Column:
        test = F.col("_t").rlike(edges(include))
        return test & ~F.col("_t").rlike(edges(exclude)) if exclude else test

    batch: list[Column] = []
    for label, include, exclude, group in FOOD_TYPES:
        if group == "bare":
            if batch:
                df = df.withColumn("food_types", F.concat("food_types", present(*batch)))
                batch = []
            fires = (F.size("food_types") == 0) & hit(include, exclude)
            df = df.withColumn("food_types", F.when(fires, F.array(F.lit(label))).otherwise(F.col("food_types")))
        else:
            batch.append(F.when(hit(include, exclude), F.lit(label)))
    df = df.withColumn("food_types", F.concat("food_types", present(*batch)))
    generic = F.col("category").isin("dessert", "beverage", "entree", "side", "snack")
    return df.withColumn(
        "food_types",
        F.when((F.size("food_types") == 0) & generic, F.array(F.concat("category", F.lit("_generic")))).otherwise(F.col("food_types")),
    ).drop("_t")
