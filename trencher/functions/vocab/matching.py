"""Fixed values of the matchers."""

# The terms that tell a kind of food.
FOOD_KEYWORDS = {
    "burger": ("burger", "hamburger", "cheeseburger", "patty"),
    "sandwich": ("sandwich", "sub", "hoagie", "wrap", "panini"),
    "pizza": ("pizza", "flatbread"),
    "chicken": ("chicken", "wing", "tender", "nugget", "fried chicken"),
    "beef": ("beef", "steak", "ribeye", "sirloin", "brisket"),
    "pork": ("pork", "bacon", "ham", "ribs", "pulled pork"),
    "seafood": ("fish", "shrimp", "lobster", "salmon", "tuna", "crab"),
    "salad": ("salad", "greens", "caesar"),
    "soup": ("soup", "chili", "stew", "chowder"),
    "pasta": ("pasta", "spaghetti", "fettuccine", "mac and cheese", "macaroni"),
    "taco": ("taco", "burrito", "quesadilla", "nachos", "enchilada"),
    "dessert": ("cake", "cookie", "brownie", "ice cream", "sundae", "pie", "churro"),
    "beverage": ("soda", "lemonade", "tea", "coffee", "smoothie", "shake", "juice"),
    "fries": ("fries", "tots", "potato", "chips"),
    "pretzel": ("pretzel",),
}
# Keywords are longer than this; these words are none; keywords of photos have so many letters at least.
KEYWORD_LENGTH, STOP_WORDS, PHOTO_WORD_LENGTH = 3, ("with", "and", "the"), 4
