"""Place taxonomy: resort and category of a park by name.

The first resort with any hit wins; inside it the longest pattern, then the
first category.  Sorting the patterns that way once turns the choice into
"first rule that fires".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resort id, name, location, and per category (id, label, patterns, seasonal flag).
TAXONOMY = (
    ("wdw", "Walt Disney World", "Orlando, Florida", (
        ("theme-parks", "Theme Parks", ("Magic Kingdom", "EPCOT", "Hollywood Studios", "Animal Kingdom", "Walt Disney World Parks"), False),
        ("water-parks", "Water Parks", ("Blizzard Beach", "Typhoon Lagoon"), False),
        ("hotels", "Resort Hotels", ("Walt Disney World Resort Hotels", "Walt Disney World Resorts", "Disney's"), False),
        ("disney-springs", "Disney Springs", ("Disney Springs",), False),
        ("seasonal", "Seasonal & Festivals", ("Walt Disney World Festivals", "Festivals & Events", "Festival"), True),
    )),
    ("disneyland", "Disneyland Resort", "Anaheim, California", (
        ("theme-parks", "Theme Parks", ("Disneyland Park", "Disney California Adventure"), False),
        ("downtown-disney", "Downtown Disney", ("Downtown Disney",), False),
        ("hotels", "Resort Hotels", ("Disneyland Resort Hotels",), False),
    )),
    ("universal-orlando", "Universal Orlando Resort", "Orlando, Florida", (
        ("theme-parks", "Theme Parks", ("Universal Studios Florida", "Islands of Adventure", "Epic Universe"), False),
        ("water-parks", "Water Parks", ("Volcano Bay",), False),
        ("citywalk", "CityWalk", ("Universal CityWalk",), False),
        ("hotels", "Resort Hotels", (
            "Epic Universe Hotels", "Universal Aventura Hotel", "Universal Cabana Bay", "Universal Hard Rock Hotel",
            "Universal Portofino Bay", "Universal Royal Pacific", "Universal Sapphire Falls",
            "Universal Endless Summer - Dockside", "Universal Endless Summer - Surfside",
            "Universal Endless Summer Resort - Dockside", "Universal Endless Summer Resort - Surfside",
            "Universal Stella Nova", "Universal Terra Luna",
        ), False),
    )),
    ("cruise", "Disney Cruise Line", "At Sea", (
        ("ships", "Ships", ("Disney Magic", "Disney Wonder", "Disney Dream", "Disney Fantasy", "Disney Wish", "Disney Treasure"), False),
    )),
    ("seaworld", "SeaWorld Parks", "Florida", (("parks", "Parks", ("SeaWorld Orlando", "Busch Gardens Tampa"), False),)),
    ("aulani", "Aulani Resort", "Ko Olina, Hawaii", (("dining", "Dining", ("Aulani",), False),)),
    ("dollywood", "Dollywood", "Pigeon Forge, Tennessee", (("theme-park", "Theme Park", ("Dollywood",), False),)),
    ("kings-island", "Kings Island", "Mason, Ohio", (("theme-park", "Theme Park", ("Kings Island",), False),)),
)
LAST = 2**31 - 1


def flat_patterns() -> list[dict]:
    """One record per pattern, in winning order."""
    rows = []
    for resort_no, (resort, name, location, categories) in enumerate(TAXONOMY):
        for category_no, (category, label, patterns, seasonal) in enumerate(categories):
            for venue_no, pattern in enumerate(patterns):
                rows.append({
                    "resort_no": resort_no, "resort_id": resort, "resort_name": name, "resort_location": location,
                    "category_no": category_no, "category_id": category, "category_label": label,
                    "venue_no": venue_no, "pattern": pattern.lower(), "seasonal": seasonal,
                })
    return sorted(rows, key=lambda r: (r["resort_no"], -len(r["pattern"]), r["category_no"]))


def classify(park_name: Column, defaults: dict[str, object]) -> dict[str, Column]:
    """Columns for every key of ``defaults`` (null park names take the defaults too)."""
    name = F.lower(park_name)
    rows = flat_patterns()
    number = None
    for i, row in enumerate(rows, start=1):
        test = F.contains(name, F.lit(row["pattern"]))
        number = F.when(test, i) if number is None else number.when(test, i)
    return {
        key: F.coalesce(F.try_element_at(F.array(*(F.lit(r[key]) for r in rows)), number), F.lit(default))
        for key, default in defaults.items()
    }


def venue_position(park_name: Column, resort: Column, category: Column) -> Column:
    """Index of the first pattern of the park's own category that hits; unknown parks go last."""
    name = F.lower(park_name)
    out = F.when(F.lit(False), LAST)
    for row in sorted(flat_patterns(), key=lambda r: (r["resort_no"], r["category_no"], r["venue_no"])):
        hit = (resort == row["resort_id"]) & (category == row["category_id"]) & F.contains(name, F.lit(row["pattern"]))
        out = out.when(hit, row["venue_no"])
    return out.otherwise(LAST)
