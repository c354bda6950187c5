"""Fixed values of the passenger-experience domain.

Scales, bin edges, labels, column lists and search grids that results depend
on. All are plain data; no operator reads them except through its arguments.
"""

from __future__ import annotations

INF = float("inf")

# --- fixed values: service columns -----------------------------------------
SERVICE_COLUMNS = [
    "Seat_Comfort", "InFlight_Entertainment", "Food_Quality", "Cleanliness",
    "Cabin_Staff_Service", "Legroom", "Baggage_Handling", "CheckIn_Service",
    "Boarding_Process",
]
RATING_COLUMNS = SERVICE_COLUMNS + ["WiFi_Service"]

# --- fixed values: text -> number scales ------------------------------------
# One entry per variant in use. `default` replaces what the scale does not
# hold; `lower` compares lower-cased text.
SCALES: dict[str, dict] = {
    "rating_encoded": {
        "values": {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4, "Unavailable": 0, "No Connection": 0},
        "default": None, "lower": False},
    "rating_prepared": {
        "values": {"poor": 1, "fair": 2, "good": 3, "excellent": 4},
        "default": 0, "lower": True},
    "wifi_prepared": {
        "values": {"poor": 1, "fair": 2, "good": 3, "excellent": 4, "no connection": 0, "unavailable": 0},
        "default": 0, "lower": True},
    "rating_clustering": {
        "values": {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4, "Unavailable": None, "No Connection": None},
        "default": 0, "lower": False},
    "rating_composite": {
        "values": {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4},
        "default": 2, "lower": False},
    "rating_profile": {
        "values": {"Poor": 1, "Good": 2, "Excellent": 3},
        "default": None, "lower": False},
    "rating_olap": {
        "values": {"Poor": 1, "Fair": 2, "Good": 3, "Excellent": 4},
        "default": 0, "lower": False},
    "satisfaction_binary": {
        "values": {"Happy": 1, "Satisfied": 1, "Neutral": 0, "Dissatisfied": 0},
        "default": None, "lower": False},
    "satisfaction_prepared": {
        "values": {"happy": 4, "satisfied": 3, "neutral": 2, "dissatisfied": 1},
        "default": 0, "lower": True},
    "satisfaction_clustering": {
        "values": {"Happy": 5, "Satisfied": 4, "Neutral": 3, "Dissatisfied": 2, "Unhappy": 1},
        "default": 3, "lower": False},
    "satisfaction_profile": {
        "values": {"Happy": 3, "Satisfied": 2, "Neutral": 1, "Dissatisfied": 0},
        "default": None, "lower": False},
    "satisfaction_olap": {
        "values": {"Happy": 4, "Satisfied": 3, "Neutral": 2, "Dissatisfied": 1},
        "default": 0, "lower": False},
    "yes_no_encoded": {
        "values": {"Yes": 1, "No": 0, "Maybe": 0.5, "Sometimes": 0.5, "Not Applicable": 0},
        "default": None, "lower": False},
    "yes_no_prepared": {
        "values": {"yes": 1, "no": 0},
        "default": 0, "lower": True},
    "preferred_prepared": {
        "values": {"yes": 1, "no": 0, "sometimes": 0.5},
        "default": 0, "lower": True},
    "recommendation_prepared": {
        "values": {"yes": 1, "no": 0, "maybe": 0.5},
        "default": 0, "lower": True},
    "yes_no_clustering": {
        "values": {"Yes": 1, "No": 0, "Maybe": 0.5, "Sometimes": 0.5},
        "default": 0, "lower": False},
    "loyalty_rank": {
        "values": {"bronze": 1, "silver": 2, "gold": 3, "platinum": 4},
        "default": 0, "lower": True},
    "class_value": {
        "values": {"economy": 1, "business": 2, "first class": 3},
        "default": 1, "lower": True},
}

# --- fixed values: bins (right-closed unless said otherwise) ----------------
AGE_BINS = ([0, 18, 25, 40, 60, 100], ["<18", "18-25", "26-40", "41-60", "60+"])
DELAY_BINS = ([-INF, 15, 45, INF], ["On-time", "Minor Delay", "Significant Delay"])
FLIGHT_TIME_BINS = ([0, 90, 180, 300, INF], ["Short", "Medium", "Long", "Extended"])
CUSTOMER_VALUE_BINS = ([0, 3, 6, 10], ["Standard", "Valuable", "Premium"])
SERVICE_TERTILES = ["Basic", "Standard", "Premium"]
# left-closed hours
DURATION_HOURS = ([1, 2], ["Short", "Medium", "Long"])
# upper ages (inclusive) of the two query-side groupings; the rest, and null, is 60+
AGE_CASE_SERVICE = ([(17, "Under 18"), (25, "18-25"), (40, "26-40"), (60, "41-60")], "60+")
AGE_CASE_SEGMENT = ([(24, "Under 25"), (40, "25-40"), (60, "41-60")], "60+")

# --- fixed values: cleaning --------------------------------------------------
SPELLINGS = {
    "Gender": {"Unknown": "Other", "X": "Other"},
    "Nationality": {"Ind": "Indian", "Indien": "Indian"},
}
FILL_VALUES = {
    "Feedback_Comments": "No valid feedback",
    "Complaint_Type": "No complaint",
    "WiFi_Service": "Unavailable",
    "Preferred_Airline": "No",
    "Frequent_Route": "Not Applicable",
}
VALID_RANGES = {"Age": (0, 120), "Flight_Distance": (0, INF)}
RARE_LABEL = "Rare_City"
MIN_CITY_COUNT = 15
BUDGET_AIRLINES = ["SpiceJet", "IndiGo", "TruJet"]
POSITIVE_SATISFACTION = ["Happy", "Satisfied"]
NO_COMPLAINT = "No complaint"

# --- fixed values: clustering feature sets -----------------------------------
FEATURE_SETS = {
    "satisfaction": RATING_COLUMNS + ["Overall_Satisfaction"],
    "demographics": [
        "Age", "Gender", "Nationality", "Travel_Purpose", "Class", "Flight_Distance",
        "Festival_Season_Travel", "Loyalty_Membership", "Frequent_Flyer", "Booking_Channel",
    ],
    "travel_behavior": [
        "Travel_Purpose", "Flight_Distance", "Flight_Duration", "Flight_Route_Type",
        "Loyalty_Membership", "Frequent_Flyer", "Preferred_Airline", "Frequent_Route",
        "Payment_Method", "Class", "Booking_Channel",
    ],
    "complaint": [
        "Departure_Delay", "Arrival_Delay", "Overall_Satisfaction", "Recommendation",
        "Complaint_Submitted", "Complaint_Type", "Baggage_Lost", "Compensation_Received",
    ],
    "all": ["Age", "Class", "Flight_Distance", "Departure_Delay", "Arrival_Delay", "Flight_Duration"]
    + SERVICE_COLUMNS
    + ["Overall_Satisfaction", "Recommendation", "Complaint_Submitted", "Loyalty_Membership", "Frequent_Flyer"],
}

# --- fixed values: association mining ----------------------------------------
KEYED_ITEM_COLUMNS = [
    "Travel_Purpose", "Airline_Name", "Class", "Loyalty_Membership", "Recommendation",
    "Service_Class", "Flight_Time_Cat", "Departure_City", "Arrival_City",
]
PREFIXED_ITEM_COLUMNS = [
    "Gender", "Nationality", "Travel_Purpose", "Airline_Name", "Class", "Departure_City",
    "Arrival_City", "Flight_Route_Type", "Departure_Delay_Category", "Arrival_Delay_Category",
    "Flight_Duration_Category", "Seat_Comfort", "InFlight_Entertainment", "Food_Quality",
    "Cleanliness", "Cabin_Staff_Service", "Legroom", "Baggage_Handling", "CheckIn_Service",
    "Boarding_Process", "WiFi_Service", "Overall_Satisfaction", "Recommendation",
    "Complaint_Submitted", "Complaint_Type", "Seat_Type", "Loyalty_Membership",
    "Frequent_Flyer", "Airline_Loyalty_Program", "Baggage_Lost", "Compensation_Received",
    "Booking_Channel", "Seat_Upgrade", "Special_Assistance", "Discount_Received",
    "Preferred_Airline", "Frequent_Route", "Payment_Method",
]
FLAG_ITEM_COLUMNS = [
    "Festival_Season_Travel", "Baggage_Lost", "Seat_Upgrade", "Compensation_Received",
    "Frequent_Flyer", "Special_Assistance", "Discount_Received",
]
KEYED_MINING = {"min_support": 0.06, "max_len": 3, "min_lift": 1.7, "min_confidence": 0.65}
PREFIXED_MINING = {"min_support": 0.05, "max_len": 3, "min_confidence": 0.5}
FLAG_SUPPORTS = [0.05, 0.02]
FLAG_CONFIDENCES = [0.5, 0.3]
RULE_CATEGORIES = {
    "City Patterns": ["Departure=", "Arrival="],
    "Service Relationships": ["Service"],
    "Loyalty Program Insights": ["Loyalty"],
}
RULE_CATEGORY_OTHER = "Flight Operations"
CUSTOMER_ITEMS = ["Gender_", "Nationality_", "Travel_Purpose_"]
OPERATION_ITEMS = ["Departure_Delay_Category_", "Arrival_Delay_Category_", "Flight_Duration_Category_"]
SERVICE_ITEMS = ["Seat_Comfort_", "InFlight_Entertainment_", "Food_Quality_"]
OUTCOME_ITEMS = ["Overall_Satisfaction_", "Recommendation_"]

# --- fixed values: model study ------------------------------------------------
ENCODED_GRIDS = {
    "random_forest": {"numTrees": [100], "maxDepth": [30, 10]},
    "knn": {"k": [3, 5, 7], "weights": ["uniform", "distance"]},
    "decision_tree": {"maxDepth": [30, 5, 10], "impurity": ["gini", "entropy"]},
    "gaussian_nb": {"smoothing": [1e-9, 1e-8, 1e-7]},
}
TUNING_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2"]},
    "decision_tree": {"maxDepth": [30, 5, 10, 15, 20], "minInstancesPerNode": [1, 2, 4]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20]},
    "linear_svm": {"C": [0.1, 1, 10]},
    "knn": {"k": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "mlp": {"hidden": [(50,), (100,), (50, 50), (100, 50)]},
}
