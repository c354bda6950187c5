"""The OLAP pack: each entry groups a star by attributes a business asks about.

A plan names keys and measures; `Star` picks the joins. `late` marks a dimension
that only labels groups, so the fact is folded before it is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import bin_case, flag, recode, scale, score_any, strip_char
from wayfarer.plans.star import Measure, Star, count, mean, rate, total


def _delays(digits: int | None = 1) -> list[Measure]:
    dep, arr = F.col("Departure_Delay"), F.col("Arrival_Delay")
    return [
        mean("Avg_Departure_Delay", dep, "Departure_Delay", digits=digits),
        mean("Avg_Arrival_Delay", arr, "Arrival_Delay", digits=digits),
        _total_delay(digits),
    ]


def _total_delay(digits: int | None = 1) -> Measure:
    return mean(
        "Avg_Total_Delay", F.col("Departure_Delay") + F.col("Arrival_Delay"),
        "Departure_Delay", "Arrival_Delay", digits=digits,
    )


def _rating(name: str, column: str) -> Measure:
    return mean(name, scale(column, vocab.SCALES["rating_olap"]), column, digits=6)


def _satisfaction() -> Measure:
    return mean(
        "Avg_Satisfaction", scale("Overall_Satisfaction", vocab.SCALES["satisfaction_olap"]),
        "Overall_Satisfaction", digits=6,
    )


def _recommendation() -> Measure:
    return rate("Recommendation_Rate", recode("Recommendation", {"Yes": 1, "Maybe": 0.5}, 0), "Recommendation")


def _yes_rate(name: str, column: str) -> Measure:
    return rate(name, flag(column), column)


def _yes_count(name: str, column: str) -> Measure:
    return total(name, flag(column).cast("bigint"), column)


def _positive(digits: int = 2) -> Measure:
    return rate(
        "Positive_Satisfaction_Percentage", score_any("Overall_Satisfaction", vocab.POSITIVE_SATISFACTION),
        "Overall_Satisfaction", digits=digits,
    )


def with_share(df: DataFrame, count_col: str, within: list[str], name: str = "Percentage", digits: int = 1) -> DataFrame:
    """Percentage of `count_col` within groups of an already aggregated table."""
    whole = F.sum(count_col).over(Window.partitionBy(*within))
    return df.withColumn(name, F.round(F.col(count_col).cast("double") * 100.0 / whole.cast("double"), digits))


# --- loyalty, delay and service questions -------------------------------------

def delay_by_airline_class(s: Star) -> DataFrame:
    out = s.aggregate(["Airline_Name", "Class"], _delays() + [count("Flight_Count")], late="airline")
    return out.orderBy(F.desc("Avg_Total_Delay"), "Airline_Name", "Class")


def satisfaction_by_loyalty(s: Star) -> DataFrame:
    keys = ["Loyalty_Membership", "Overall_Satisfaction"]
    out = s.aggregate(keys, [count("Passenger_Count")], late="airline")
    return with_share(out, "Passenger_Count", ["Loyalty_Membership"]).orderBy(*keys)


def service_quality_by_airline(s: Star) -> DataFrame:
    measures = [
        _rating("Avg_Seat_Comfort", "Seat_Comfort"),
        _rating("Avg_Entertainment", "InFlight_Entertainment"),
        _rating("Avg_Food_Quality", "Food_Quality"),
        _rating("Avg_Cleanliness", "Cleanliness"),
        _rating("Avg_Staff_Service", "Cabin_Staff_Service"),
        _satisfaction(), count("Passenger_Count"),
    ]
    out = s.aggregate(["Airline_Name"], measures, late="airline")
    return out.orderBy(F.desc("Avg_Satisfaction"), "Airline_Name")


def complaints_by_airline_share(s: Star) -> DataFrame:
    out = s.aggregate(
        ["Airline_Name", "Complaint_Type"], [count("Complaint_Count")], late="airline",
        where=F.col("Complaint_Type") != vocab.NO_COMPLAINT, where_reads=["Complaint_Type"],
    )
    out = with_share(out, "Complaint_Count", ["Airline_Name"])
    return out.orderBy("Airline_Name", F.desc("Complaint_Count"), "Complaint_Type")


def delay_by_route_type(s: Star) -> DataFrame:
    out = s.aggregate(["Flight_Route_Type"], _delays() + [count("Flight_Count")], late="flight")
    return out.orderBy(F.desc("Avg_Total_Delay"), "Flight_Route_Type")


def age_service_preferences(s: Star) -> DataFrame:
    measures = [
        _rating("Avg_Seat_Comfort", "Seat_Comfort"), _rating("Avg_Legroom", "Legroom"),
        _rating("Avg_WiFi", "WiFi_Service"), _rating("Avg_Entertainment", "InFlight_Entertainment"),
        _satisfaction(), count("Passenger_Count"),
    ]
    tops, rest = vocab.AGE_CASE_SERVICE
    labelled = s.dimensions["passenger"].derive(
        "Age_Group", by=lambda rows: rows.withColumn("Age_Group", bin_case("Age", tops, rest))
    )
    return s.with_dimension("passenger", labelled).aggregate(["Age_Group"], measures, late="passenger").orderBy("Age_Group")


def route_performance(s: Star) -> DataFrame:
    measures = _delays() + [_yes_count("Total_Baggage_Issues", "Baggage_Lost"), count("Flight_Count")]
    out = s.aggregate(["Departure_City", "Arrival_City"], measures, late="flight")
    return out.orderBy(F.desc("Avg_Total_Delay"), "Departure_City", "Arrival_City")


def loyalty_effectiveness(s: Star) -> DataFrame:
    measures = [
        _satisfaction(), _recommendation(), _yes_rate("Compensation_Rate", "Compensation_Received"),
        count("Member_Count"),
    ]
    out = s.aggregate(["Loyalty_Membership"], measures, late="airline")
    return out.orderBy(F.desc("Avg_Satisfaction"), "Loyalty_Membership")


def payment_experience(s: Star) -> DataFrame:
    measures = [
        _rating("Avg_CheckIn_Rating", "CheckIn_Service"), _rating("Avg_Boarding_Rating", "Boarding_Process"),
        _yes_count("Total_Complaints", "Complaint_Submitted"), count("Total_Bookings"),
        _yes_rate("Complaint_Rate", "Complaint_Submitted"),
    ]
    return s.aggregate(["Payment_Method"], measures).orderBy("Complaint_Rate", "Payment_Method")


def class_experience(s: Star) -> DataFrame:
    measures = [
        _rating("Avg_Seat_Comfort", "Seat_Comfort"), _rating("Avg_Food_Quality", "Food_Quality"),
        _total_delay(), _yes_count("Total_Upgrades", "Seat_Upgrade"), _satisfaction(), count("Passenger_Count"),
    ]
    out = s.aggregate(["Class"], measures, late="flight")
    return out.orderBy(F.desc("Avg_Satisfaction"), "Class")


def festival_impact(s: Star) -> DataFrame:
    measures = [_total_delay(), _yes_rate("Baggage_Loss_Rate", "Baggage_Lost"), _satisfaction(), count("Travel_Count")]
    return s.aggregate(["Festival_Season_Travel"], measures).orderBy("Festival_Season_Travel")


def complaint_resolution(s: Star) -> DataFrame:
    measures = [
        _yes_rate("Compensation_Rate", "Compensation_Received"),
        mean("Avg_Arrival_Delay", F.col("Arrival_Delay"), "Arrival_Delay", digits=1),
        count("Complaint_Count"),
    ]
    out = s.aggregate(["Complaint_Type"], measures, where=F.col("Complaint_Type") != vocab.NO_COMPLAINT)
    # the total of all complaints is the sum of the few rows above
    return share_of_total(out, "Complaint_Count").orderBy(F.desc("Complaint_Count"), "Complaint_Type")


def share_of_total(df: DataFrame, count_col: str, name: str = "Percentage", digits: int = 1) -> DataFrame:
    """Share of the grand total, by an uncorrelated scalar subquery."""
    whole = df.agg(F.sum(count_col).alias("whole")).scalar()
    return df.withColumn(name, F.round(F.col(count_col).cast("double") * 100.0 / whole.cast("double"), digits))


def frequent_flyer_behavior(s: Star) -> DataFrame:
    measures = [
        mean("Avg_Age", F.col("Age"), "Age", digits=1), _yes_rate("Discount_Usage_Rate", "Discount_Received"),
        _yes_count("Total_Upgrades", "Seat_Upgrade"), _recommendation(), _satisfaction(), count("Passenger_Count"),
    ]
    return s.aggregate(["Frequent_Flyer"], measures, late="airline").orderBy("Frequent_Flyer")


def gender_class_counts(s: Star) -> DataFrame:
    out = s.aggregate(["Gender", "Class"], [count("Passenger_Count")], late="passenger")
    return out.orderBy("Gender", "Class")


def booking_channel_effect(s: Star) -> DataFrame:
    on_time = F.when((F.col("Departure_Delay") == 0) & (F.col("Arrival_Delay") == 0), 1.0).otherwise(0.0)
    measures = [
        rate("On_Time_Flight_Percentage", on_time, "Departure_Delay", "Arrival_Delay"),
        _yes_rate("Discount_Rate", "Discount_Received"), _yes_rate("Upgrade_Rate", "Seat_Upgrade"),
        _satisfaction(), count("Booking_Count"),
    ]
    return s.aggregate(["Booking_Channel"], measures).orderBy(F.desc("Avg_Satisfaction"), "Booking_Channel")


def purpose_satisfaction(s: Star) -> DataFrame:
    measures = [
        _satisfaction(), _rating("Avg_WiFi_Importance", "WiFi_Service"),
        _rating("Avg_Food_Importance", "Food_Quality"), _recommendation(), count("Passenger_Count"),
    ]
    out = s.aggregate(["Travel_Purpose"], measures, late="passenger")
    return out.orderBy(F.desc("Avg_Satisfaction"), "Travel_Purpose")


def loyalty_program_comparison(s: Star) -> DataFrame:
    """Groups by the stored program name and shows the cleaned one, so two
    spellings that differ by a carriage return stay two rows."""
    program = F.col("Airline_Loyalty_Program")
    kept = s.dimensions["airline"].where((program != "N/A") & program.isNotNull())
    measures = [
        count("Member_Count"), _yes_rate("Frequent_Flyer_Rate", "Frequent_Flyer"), _satisfaction(),
        _recommendation(), _yes_rate("Discount_Rate", "Discount_Received"),
    ]
    out = s.with_dimension("airline", kept).aggregate(["Airline_Loyalty_Program"], measures)
    return out.withColumn("Airline_Loyalty_Program", strip_char("Airline_Loyalty_Program")).orderBy(
        F.desc("Avg_Satisfaction"), "Airline_Loyalty_Program", "Member_Count"
    )


# --- cube operations -----------------------------------------------------------

def _airline_class_sums(s: Star) -> DataFrame:
    """Sums and counts per airline and class: all the cube operations read these."""
    dep, arr = F.col("Departure_Delay"), F.col("Arrival_Delay")
    return s.aggregate(
        ["Airline_Name", "Class"],
        [total("dep", dep.cast("double"), "Departure_Delay"), total("dep_n", dep.isNotNull().cast("bigint"), "Departure_Delay"),
         total("arr", arr.cast("double"), "Arrival_Delay"), total("arr_n", arr.isNotNull().cast("bigint"), "Arrival_Delay")],
        late="airline",
    )


def rollup_airline_class(s: Star) -> DataFrame:
    """Subtotals from the folded table, so the fact is not expanded three-fold."""
    return (
        _airline_class_sums(s).rollup("Airline_Name", "Class").agg(
            F.round(F.try_divide(F.sum("dep"), F.sum("dep_n")), 6).alias("Avg_Departure_Delay"),
            F.round(F.try_divide(F.sum("arr"), F.sum("arr_n")), 6).alias("Avg_Arrival_Delay"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )


def rollup_leaves(s: Star) -> DataFrame:
    return rollup_airline_class(s).where(F.col("level") == 0).drop("level")


def slice_airline(s: Star, airline: str = "Air India") -> DataFrame:
    return s.aggregate(
        ["Airline_Name"], [mean("Avg_Departure_Delay", F.col("Departure_Delay"), "Departure_Delay", digits=6)],
        late="airline", late_where=F.col("Airline_Name") == airline,
    )


def dice_airlines_class(s: Star, airlines=("Air India", "SpiceJet"), travel_class: str = "Economy") -> DataFrame:
    return s.aggregate(
        ["Airline_Name", "Class"], [count("FlightCount")], late="airline",
        where=F.col("Class") == travel_class, late_where=F.col("Airline_Name").isin(*airlines),
    )


def pivot_airline_class(s: Star, classes=("Business", "Economy", "First Class")) -> DataFrame:
    sums = _airline_class_sums(s).where(F.col("Airline_Name").isNotNull())
    return (
        sums.groupBy("Airline_Name").pivot("Class", list(classes))
        .agg(F.round(F.try_divide(F.sum("dep"), F.sum("dep_n")), 6))
        .orderBy("Airline_Name")
    )


# --- counts and means --------------------------------------------------------------

def satisfaction_distribution(s: Star) -> DataFrame:
    return s.aggregate(["Overall_Satisfaction"], [count("Count")], late="service")


def payment_usage(s: Star) -> DataFrame:
    return s.aggregate(["Payment_Method"], [count("Count")])


def distance_by_city_airline(s: Star) -> DataFrame:
    return s.aggregate(
        ["Departure_City", "Airline_Name"],
        [mean("Avg_Flight_Distance", F.col("Flight_Distance"), "Flight_Distance", digits=8)], late="airline",
    )


def _by_airline_and_staging(s: Star, column: str, name: str) -> DataFrame:
    """Counts per airline and an attribute of the staging table, whose key has
    another name than the fact's."""
    staged = s.dimensions["passenger"].frame.select(F.col("Passenger_Key").alias("Passenger_ID"), column)
    pairs = s.aggregate(["Airline_Name", "Passenger_Key"], [count(name)], late="airline")
    return (
        pairs.join(staged, pairs["Passenger_Key"] == staged["Passenger_ID"])
        .groupBy("Airline_Name", column).agg(F.sum(name).alias(name))
    )


def gender_by_airline(s: Star) -> DataFrame:
    return _by_airline_and_staging(s, "Gender", "FlightCount")


def seat_type_by_airline(s: Star) -> DataFrame:
    return _by_airline_and_staging(s, "Seat_Type", "SeatCount")


def purpose_by_nationality(s: Star) -> DataFrame:
    return s.aggregate(["Nationality", "Travel_Purpose"], [count("Count")], late="passenger")


def avg_age_by_purpose(s: Star) -> DataFrame:
    return s.aggregate(["Travel_Purpose"], [mean("Avg_Age", F.col("Age"), "Age", digits=6)])


def delayed_over_15(s: Star, minutes: int = 15) -> DataFrame:
    late = F.when(F.col("Departure_Delay") > minutes, 1).otherwise(0)
    return s.aggregate(
        ["Airline_Name"],
        [count("Total_Flights"), total("Delayed_Flights", late.cast("bigint"), "Departure_Delay"),
         rate("Delay_Percentage", late, "Departure_Delay", digits=2)],
        late="airline",
    )


def complaint_types_by_airline(s: Star) -> DataFrame:
    return s.aggregate(
        ["Airline_Name", "Complaint_Type"], [count("Complaint_Count")], late="airline",
        where=F.col("Complaint_Submitted") == "Yes", where_reads=["Complaint_Submitted"],
    )


def booking_usage(s: Star) -> DataFrame:
    return s.aggregate(["Booking_Channel"], [count("FlightCount")])


def frequent_flyers_by_airline(s: Star) -> DataFrame:
    return s.aggregate(
        ["Airline_Name"], [count("FrequentFlyerCount")], late="airline", late_where=F.col("Frequent_Flyer") == "Yes",
    )


# --- segments on the staging table -----------------------------------------------------

def segment_age_purpose(s: Star) -> DataFrame:
    tops, rest = vocab.AGE_CASE_SEGMENT
    labelled = s.dimensions["passenger"].derive(
        "Age_Group", by=lambda rows: rows.withColumn("Age_Group", bin_case("Age", tops, rest))
    )
    return s.with_dimension("passenger", labelled).aggregate(
        ["Travel_Purpose", "Age_Group"], [count("Passenger_Count"), _positive()], late="passenger"
    )


def on_time_by_route_type(s: Star) -> DataFrame:
    on_time = F.when((F.col("Departure_Delay") <= 0) & (F.col("Arrival_Delay") <= 0), 1).otherwise(0)
    reads = ("Departure_Delay", "Arrival_Delay")
    return s.aggregate(
        ["Flight_Route_Type"],
        [count("Total_Flights"), total("On_Time_Flights", on_time.cast("bigint"), *reads),
         rate("On_Time_Percentage", on_time, *reads, digits=2)],
        late="flight",
    )


def loyalty_impact(s: Star) -> DataFrame:
    return s.aggregate(["Loyalty_Membership"], [count("Total_Passengers"), _positive()], late="airline")


def class_performance(s: Star) -> DataFrame:
    return s.aggregate(["Class"], _delays(6)[:2] + [_positive()], late="flight")


PACK: dict[str, Callable[[Star], DataFrame]] = {
    f.__name__: f
    for f in (
        delay_by_airline_class, satisfaction_by_loyalty, service_quality_by_airline, complaints_by_airline_share,
        delay_by_route_type, age_service_preferences, route_performance, loyalty_effectiveness, payment_experience,
        class_experience, festival_impact, complaint_resolution, frequent_flyer_behavior, gender_class_counts,
        booking_channel_effect, purpose_satisfaction, loyalty_program_comparison, rollup_airline_class, slice_airline,
        dice_airlines_class, pivot_airline_class, satisfaction_distribution, payment_usage, distance_by_city_airline,
        gender_by_airline, purpose_by_nationality, avg_age_by_purpose, delayed_over_15, complaint_types_by_airline,
        booking_usage, seat_type_by_airline, frequent_flyers_by_airline, segment_age_purpose, on_time_by_route_type,
        loyalty_impact, class_performance,
    )
}


def run_pack(star: Star, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All (or the named) results of the pack, lazily, by query name."""
    return {name: PACK[name](star) for name in (names or PACK)}
