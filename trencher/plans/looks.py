"""Checking SQL for patterns with look-arounds, which its engine lacks.

A look-around test becomes another test of position: what must not stand next to
a match is blanked out first, or all before the last thing that must not follow
is cut off; then the bare pattern is searched.
"""

from __future__ import annotations

from trencher.plans.catalogue import quoted

#: Pattern: what matches anywhere, what matches in the changed text, what is blanked there, what cuts it.
LOOKS = {
    r"ham(?!burger)": (None, "ham", "hamburger", None),
    r"cheese(?!cake)": (None, "cheese", "cheesecake", None),
    r"soda|cola|sprite|fanta|root beer|dr pepper|pepsi|coke(?!\s*zero)": ("soda|cola|sprite|fanta|root beer|dr pepper|pepsi", "coke", r"coke\s*zero", None),
    r"\bapple\b(?!\s*juice)": (None, r"\bapple\b", r"\bapple\b\s*juice", None),
    r"cheeseburger|hamburger|burger(?!.*impossible)": ("cheeseburger|hamburger", "burger", None, "impossible"),
    r"pretzel(?!.*pretzel kitchen)": (None, "pretzel", None, "pretzel kitchen"),
    r"\bbeer\b(?!.*(?:butter|batter|brined|braised|cheese|glazed|marinated|infused|float|root))":
        (None, r"\bbeer\b", None, "butter|batter|brined|braised|cheese|glazed|marinated|infused|float|root"),
    r"\bwine\b(?!.*(?:braised|reduction|sauce|vinaigrette|marinated|glazed|infused|cupcake|cake|country|bar))":
        (None, r"\bwine\b", None, "braised|reduction|sauce|vinaigrette|marinated|glazed|infused|cupcake|cake|country|bar"),
    r"margarita|mojito|sangria|(?<!shrimp |fruit |prawn |seafood )cocktail": ("margarita|mojito|sangria", "cocktail", "(shrimp|fruit|prawn|seafood) cocktail", None),
    r"(?<!cheese)steak(?! dog|house| fries| & egg)|filet(?! de saumon)|ribeye|rib.eye|prime rib":
        ("ribeye|rib.eye|prime rib", "steak|filet", "cheesesteak|steak(?: dog|house| fries| & egg)|filet de saumon", None),
    r"salmon|sea bass|fish(?!.*finger)": ("salmon|sea bass", "fish", None, "finger"),
}


def parts(pattern: str) -> str:
    """``pattern`` as four SQL values for ``test``."""
    assert pattern in LOOKS or not any(look in pattern for look in ("(?!", "(?<")), pattern
    always, plain, blank, cut = LOOKS.get(pattern, (pattern, None, None, None))
    return ", ".join("NULL" if v is None else quoted(v) for v in (always, plain, blank, cut and f"^.*({cut})"))


def test(text: str, row: str = "") -> str:
    """Whether ``text`` matches the four values, columns ``inc, bare, blank, cut`` of ``row``."""
    changed = f"CASE WHEN {row}blank IS NOT NULL THEN regexp_replace({text}, {row}blank, '#', 'g') ELSE regexp_replace({text}, {row}cut, '\\1') END"
    return f"(coalesce(regexp_matches({text}, {row}inc), false) OR coalesce(regexp_matches({changed}, {row}bare), false))"
