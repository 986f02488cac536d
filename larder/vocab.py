"""Closed vocabularies. The values are fixed: stored data and keys depend on them."""

# Fixed values, in their own order: aisles follow the walk through a shop, and the last one is the fallback.
AISLES = ("Produce", "Meat & Seafood", "Dairy & Eggs", "Bakery", "Grains & Pasta", "Canned & Jarred", "Pantry", "Spices", "Frozen", "Other")
CATEGORIES = ("Chicken", "Beef & Turkey", "Vegetarian", "Soup", "Breakfast", "No-reheat")
TAGS = (
    "10 minutes", "30 minutes", "Better on day two", "Big batch", "Cheap", "Comfort", "Component prep", "Crunchy", "Freezes",
    "Gluten-free", "Grab and go", "Hands-off", "High fiber", "High protein", "Marinate ahead", "No cook", "No microwave",
    "One cleanup", "One pot", "Pantry staples", "Reader favorite", "Sheet pan", "Slow cooker", "Under 20 min", "Vegan",
    "Vegan option", "Vegetarian",
)
RATING_ASPECTS = ("quick", "slow", "cheap", "expensive", "tasty", "bland", "reheats_well", "soggy_leftovers", "too_much_cleanup", "would_repeat")
DISH_STATUS = ("pending", "active", "rejected")
SOURCE_KIND = ("blog", "reddit", "social")
RUN_STATUS = ("running", "success", "partial", "error")
RUN_KIND = ("scan", "search")

# Scores, rule derivation, history, batches, limits, relaxation and matching.
NEUTRAL_SCORE, SCORE_RANGE, REASON_LENGTH = 50, (0, 100), 140
MIN_RATED, MIN_OBSERVATIONS, DISLIKE_MEDIAN, TIME_LADDER = 5, 5, 2.5, (30, 60, 90)
HISTORY, SCORE_BATCH, SCORE_RUN = 50, 20, 400
BATCHES, MAX_PICKS, MAX_IMPORT = (1, 4), 100, 500
LIMIT_DEFAULT, LIMIT_MAX = 50, 500
RELAXATION_ROUNDS, WIDEN = 2, 1.5
FUZZY_THRESHOLD, FUZZY_MARGIN = 0.78, 0.08
DAY_BUDGET, BUDGET_GATE = {"scan": 1.00, "search": 0.10}, 0.9
