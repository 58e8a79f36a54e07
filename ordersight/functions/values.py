"""Values fixed by the problem: labels, groupings, feature names, chosen settings."""

from __future__ import annotations

# --- Fixed values: class labels -------------------------------------------------------------
ROOT = "ORDERS"
TREE_EDGES = [
    (["UNKNOWN", "KNOWN"], "ORDERS"),
    (["HAPPY", "UNHAPPY"], "KNOWN"),
    (["MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY"], "UNHAPPY"),
]
KNOWN_PREFIX = "KNOWN "
RECODED_GENERAL = ["HAPPY"]
RECODED_DETAILED = ["HAPPY", "MILDLY UNHAPPY", "MEDIUM UNHAPPY", "HEAVILY UNHAPPY"]

# --- Fixed values: transporter code -> transporter ------------------------------------------
TRANSPORTERS = {
    "POSTNL": ["AH-NL", "TNT", "TNT-EXPRESS", "TNT-EXTRA"],
    "DHL": ["DHL", "DHL_DE", "DHLFORYOU"],
    "DPD": ["DPD-NL", "DPD-BE"],
    "BRIEF": ["BRIEFPOST", "BPOST_BRIEF", "DHL-GLOBAL-MAIL", "TNT_BRIEF"],
}
OTHER_TRANSPORTER = "OTHER"

# --- Fixed values: product group -> general group -------------------------------------------
PRODUCT_GROUPS = {
    "Books": ["Dutch Books PG", "Ebooks and Audiobooks", "International Books PG"],
    "Music, Film & Games": [
        "Games Accessories", "Games Consoles", "Games Software Physical", "Movies", "Music"],
    "Computer & Electronics": [
        "Camera", "Desktop Monitor and Beamer", "Ereaders and Accessories", "Laptop Computers",
        "PC Accessories", "Personal Audio", "Sound and Vision Accessories", "Storage and Network",
        "Telephone and Tablet Accessories", "Telephones and Tablets", "Television"],
    "Toys & Hobby": ["General Toys", "Recreational and Outdoor Toys"],
    "Baby & Kids": ["Baby and Kids Fashion", "Baby PG"],
    "Health & Care": ["Daily Care PG", "Health PG", "Perfumery PG", "Personal Care"],
    "Fashion, Shoes & Accessories": [
        "Footwear", "Jewelry and Watches", "Mens and Womens Fashion", "Wearables"],
    "Sports, Outdoor & Travel": [
        "Bodyfashion and Beachwear", "Camping and Outdoor", "Cycling", "Sporting Equipment",
        "Sportswear", "Travel Bags and Accessories"],
    "Office & School": ["Educational Dutch", "Educational International", "Printing and Ink"],
    "Food & Beverage": ["Supermarket PG"],
    "Home, Cooking & Household": [
        "Furniture", "Heating and Air", "Home Decoration", "Home Entertainment", "Household",
        "Household Appliances", "Kitchen", "Kitchen Machines", "Lighting",
        "Major Domestic Appliances PG", "Plumbing and Safety"],
    "Pets, Garden & Jobs": ["Garden", "Pet PG", "Textiles", "Tools and Paint"],
    "Car & Motor": ["Car and Motorcycle"],
}
OTHER_GROUP = "Other"


def group_column(group: str) -> str:
    """Name of the one-hot column of a general group: its first word, commas removed."""
    return "group" + group.split(" ")[0].replace(",", "")


# --- Fixed values: calendar names -----------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]

# --- Fixed values: model features -----------------------------------------------------------
BASIC = ["totalPrice", "quantityOrdered", "fulfilmentByPlatform", "countryCodeNL", "countryOriginNL",
         "countryOriginBE", "countryOriginDE", "productTitleLength", "promisedDeliveryDays",
         "partnerSellingDays", "orderCorona"]
WEEK = ["order" + d for d in WEEKDAYS]
MONTH = ["order" + m for m in MONTHS]
YEAR = ["orderYear2020"]
GROUP = [group_column(g) for g in
         ["Health", "Home", "Sports", "Computer", "Pets", "Toys", "Books", "Baby", "Music", "Food",
          "Office", "Fashion", "Other", "Car"]]
TRANSPORTER_X = [f"transporter{t}/X" for t in ["POSTNL", "DHL", "DPD", "BRIEF", "OTHER"]]
KNOWN_X = ["caseKnownX", "returnKnownX", "cancellationKnownX", "onTimeDeliveryKnownX",
           "lateDeliveryKnownX"]
PRODUCT_X = ["productOrderCountX", "productTotalCountX", "productTotalReturnedX",
             "productReturnFractionX"]
SELLER_X = ["sellerDailyOrdersX"]
HISTORY_VARIABLES = ["transporterCode", "sellerId", "productGroup"]
HISTORY_X = [f"{v}Historic{k}X" for v in HISTORY_VARIABLES for k in ["Happy", "Unhappy", "Unknown"]]

STATIC_FEATURES = BASIC + WEEK + MONTH + YEAR + GROUP
FEATURES = STATIC_FEATURES + TRANSPORTER_X + KNOWN_X + PRODUCT_X + SELLER_X + HISTORY_X
LABEL = "detailedMatchClassification"
OUTCOME = "generalMatchClassification"
KEY = "orderLineId"
DATE = "orderDate"

# --- Fixed values: settings chosen per day 0..10 --------------------------------------------
OUTCOME_DELAY = 30
CERTAINTY = 0.7
STEPS = 100
LAST_DAY = 10
TREE_SETTINGS = {
    "ORDERS": {"penalty": ["l1", "l1", "l2", "l2", "l2", "l2", "l1", "l1", "l1", "l1", "l1"]},
    "KNOWN": {"depth": [9, 10, 12, 12, 12, 12, 10, 10, 10, 10, 10],
              "trees": [35, 45, 30, 30, 30, 30, 45, 45, 45, 45, 45]},
    "UNHAPPY": {"depth": [14, 14, 14, 14, 14, 14, 14, 14, 14, 14, 14],
                "trees": [20, 45, 30, 30, 30, 30, 45, 45, 45, 45, 45]},
}
FLAT_SETTINGS = {
    "penalty": ["l1", "l1", "l1", "l1", "l1", "l1", "l2", "l1", "l1", "l1", "l1"],
    "depth": [14, 14, 14, 14, 14, 14, 14, 14, 14, 14, 14],
    "trees": [45, 45, 40, 45, 40, 45, 40, 45, 45, 45, 45],
}
FLAT_FOREST_FROM_DAY = 5
SEARCH_COMBINATIONS = [
    ("LR", "RF", "RF"), ("RF", "LR", "LR"), ("LR", "LR", "LR"), ("RF", "RF", "RF"),
    ("LR", "LR", "RF"), ("LR", "RF", "LR"), ("RF", "RF", "LR"), ("RF", "LR", "RF")]
SEARCH_SAMPLE_ROWS = 1_100_000
SEARCH_TRIALS = 20
SEARCH_SEED = 1
