"""Registered queries and oracles of the OLAP pack."""

from __future__ import annotations

from wayfarer.plans import olap
from wayfarer.plans.binding import oracle, star


def _run(plan):
    return lambda spark, sf_dir: plan(star(spark, sf_dir))


QUERIES = {name: _run(plan) for name, plan in olap.PACK.items()}


def _score(column: str) -> str:
    return (
        f"CASE {column} WHEN 'Excellent' THEN 4.0 WHEN 'Good' THEN 3.0 WHEN 'Fair' THEN 2.0 WHEN 'Poor' THEN 1.0 ELSE 0.0 END"
    )


def _avg(column: str, alias: str) -> str:
    return f"round(avg(CAST({_score(column)} AS DOUBLE)), 6) AS {alias}"


SAT = (
    "round(avg(CAST(CASE Overall_Satisfaction WHEN 'Happy' THEN 4 WHEN 'Satisfied' THEN 3 WHEN 'Neutral' THEN 2 "
    "WHEN 'Dissatisfied' THEN 1 ELSE 0 END AS DOUBLE)), 6) AS Avg_Satisfaction"
)
REC = (
    "round(avg(CAST(CASE Recommendation WHEN 'Yes' THEN 1 WHEN 'Maybe' THEN 0.5 ELSE 0 END AS DOUBLE)) * 100, 1) "
    "AS Recommendation_Rate"
)
DELAYS = (
    "round(avg(Departure_Delay), 1) AS Avg_Departure_Delay, round(avg(Arrival_Delay), 1) AS Avg_Arrival_Delay, "
    "round(avg(Departure_Delay + Arrival_Delay), 1) AS Avg_Total_Delay"
)
TOTAL = "round(avg(Departure_Delay + Arrival_Delay), 1) AS Avg_Total_Delay"
POSITIVE = (
    "round(100 * avg(CASE WHEN Overall_Satisfaction IN ('Happy', 'Satisfied') THEN 1.0::DOUBLE ELSE 0.0 END), 2) "
    "AS Positive_Satisfaction_Percentage"
)


def _yes(column: str, alias: str) -> str:
    return f"round(avg(CASE WHEN {column} = 'Yes' THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS {alias}"


def _yes_n(column: str, alias: str) -> str:
    return f"CAST(sum(CASE WHEN {column} = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS {alias}"


def _group(keys: str, measures: str, where: str = "") -> str:
    return f"SELECT {keys}, {measures} FROM staging {where} GROUP BY {keys}"


ORACLES = {name: oracle(sql) for name, sql in {
    "delay_by_airline_class": _group("Airline_Name, Class", f"{DELAYS}, count(*) AS Flight_Count"),
    "satisfaction_by_loyalty": _group(
        "Loyalty_Membership, Overall_Satisfaction",
        "count(*) AS Passenger_Count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY Loyalty_Membership), 1) AS Percentage"),
    "service_quality_by_airline": _group("Airline_Name", ", ".join([
        _avg("Seat_Comfort", "Avg_Seat_Comfort"), _avg("InFlight_Entertainment", "Avg_Entertainment"),
        _avg("Food_Quality", "Avg_Food_Quality"), _avg("Cleanliness", "Avg_Cleanliness"),
        _avg("Cabin_Staff_Service", "Avg_Staff_Service"), SAT, "count(*) AS Passenger_Count"])),
    "complaints_by_airline_share": _group(
        "Airline_Name, Complaint_Type",
        "count(*) AS Complaint_Count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY Airline_Name), 1) AS Percentage",
        "WHERE Complaint_Type != 'No complaint'"),
    "delay_by_route_type": _group("Flight_Route_Type", f"{DELAYS}, count(*) AS Flight_Count"),
    "age_service_preferences":
        "SELECT CASE WHEN Age < 18 THEN 'Under 18' WHEN Age BETWEEN 18 AND 25 THEN '18-25' "
        "WHEN Age BETWEEN 26 AND 40 THEN '26-40' WHEN Age BETWEEN 41 AND 60 THEN '41-60' ELSE '60+' END AS Age_Group, "
        + ", ".join([_avg("Seat_Comfort", "Avg_Seat_Comfort"), _avg("Legroom", "Avg_Legroom"), _avg("WiFi_Service", "Avg_WiFi"),
                     _avg("InFlight_Entertainment", "Avg_Entertainment"), SAT, "count(*) AS Passenger_Count"])
        + " FROM staging GROUP BY 1",
    "route_performance": _group(
        "Departure_City, Arrival_City",
        f"{DELAYS}, {_yes_n('Baggage_Lost', 'Total_Baggage_Issues')}, count(*) AS Flight_Count"),
    "loyalty_effectiveness": _group(
        "Loyalty_Membership", f"{SAT}, {REC}, {_yes('Compensation_Received', 'Compensation_Rate')}, count(*) AS Member_Count"),
    "payment_experience": _group("Payment_Method", ", ".join([
        _avg("CheckIn_Service", "Avg_CheckIn_Rating"), _avg("Boarding_Process", "Avg_Boarding_Rating"),
        _yes_n("Complaint_Submitted", "Total_Complaints"), "count(*) AS Total_Bookings",
        _yes("Complaint_Submitted", "Complaint_Rate")])),
    "class_experience": _group("Class", ", ".join([
        _avg("Seat_Comfort", "Avg_Seat_Comfort"), _avg("Food_Quality", "Avg_Food_Quality"), TOTAL,
        _yes_n("Seat_Upgrade", "Total_Upgrades"), SAT, "count(*) AS Passenger_Count"])),
    "festival_impact": _group(
        "Festival_Season_Travel", f"{TOTAL}, {_yes('Baggage_Lost', 'Baggage_Loss_Rate')}, {SAT}, count(*) AS Travel_Count"),
    "complaint_resolution": _group(
        "Complaint_Type",
        f"{_yes('Compensation_Received', 'Compensation_Rate')}, round(avg(Arrival_Delay), 1) AS Avg_Arrival_Delay, "
        "count(*) AS Complaint_Count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM staging "
        "WHERE Complaint_Type != 'No complaint'), 1) AS Percentage",
        "WHERE Complaint_Type != 'No complaint'"),
    "frequent_flyer_behavior": _group("Frequent_Flyer", ", ".join([
        "round(avg(Age), 1) AS Avg_Age", _yes("Discount_Received", "Discount_Usage_Rate"),
        _yes_n("Seat_Upgrade", "Total_Upgrades"), REC, SAT, "count(*) AS Passenger_Count"])),
    "gender_class_counts": _group("Gender, Class", "count(*) AS Passenger_Count"),
    "booking_channel_effect": _group("Booking_Channel", ", ".join([
        "round(avg(CASE WHEN Departure_Delay = 0 AND Arrival_Delay = 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS On_Time_Flight_Percentage",
        _yes("Discount_Received", "Discount_Rate"), _yes("Seat_Upgrade", "Upgrade_Rate"), SAT, "count(*) AS Booking_Count"])),
    "purpose_satisfaction": _group("Travel_Purpose", ", ".join([
        SAT, _avg("WiFi_Service", "Avg_WiFi_Importance"), _avg("Food_Quality", "Avg_Food_Importance"), REC,
        "count(*) AS Passenger_Count"])),
    "loyalty_program_comparison":
        "SELECT replace(p, chr(13), '') AS Airline_Loyalty_Program, Member_Count, Frequent_Flyer_Rate, Avg_Satisfaction, "
        "Recommendation_Rate, Discount_Rate FROM (SELECT Airline_Loyalty_Program AS p, count(*) AS Member_Count, "
        f"{_yes('Frequent_Flyer', 'Frequent_Flyer_Rate')}, {SAT}, {REC}, {_yes('Discount_Received', 'Discount_Rate')} "
        "FROM staging WHERE Airline_Loyalty_Program != 'N/A' GROUP BY Airline_Loyalty_Program)",
    "rollup_airline_class":
        "SELECT Airline_Name, Class, round(avg(Departure_Delay), 6) AS Avg_Departure_Delay, "
        "round(avg(Arrival_Delay), 6) AS Avg_Arrival_Delay, CAST(grouping(Airline_Name, Class) AS BIGINT) AS level "
        "FROM staging GROUP BY ROLLUP (Airline_Name, Class)",
    "slice_airline":
        "SELECT Airline_Name, round(avg(Departure_Delay), 6) AS Avg_Departure_Delay FROM staging "
        "WHERE Airline_Name = 'Air India' GROUP BY Airline_Name",
    "dice_airlines_class": _group(
        "Airline_Name, Class", "count(*) AS FlightCount",
        "WHERE Airline_Name IN ('Air India', 'SpiceJet') AND Class = 'Economy'"),
    "pivot_airline_class":
        "SELECT Airline_Name, round(avg(CASE WHEN Class = 'Business' THEN Departure_Delay END), 6) AS \"Business\", "
        "round(avg(CASE WHEN Class = 'Economy' THEN Departure_Delay END), 6) AS \"Economy\", "
        "round(avg(CASE WHEN Class = 'First Class' THEN Departure_Delay END), 6) AS \"First Class\" "
        "FROM staging GROUP BY Airline_Name",
    "satisfaction_distribution": _group("Overall_Satisfaction", "count(*) AS Count"),
    "payment_usage": _group("Payment_Method", "count(*) AS Count"),
    "distance_by_city_airline": _group(
        "Departure_City, Airline_Name", "round(avg(Flight_Distance), 8) AS Avg_Flight_Distance"),
    "gender_by_airline": _group("Airline_Name, Gender", "count(*) AS FlightCount"),
    "purpose_by_nationality": _group("Nationality, Travel_Purpose", "count(*) AS Count"),
    "avg_age_by_purpose": _group("Travel_Purpose", "round(avg(Age), 6) AS Avg_Age"),
    "delayed_over_15": _group(
        "Airline_Name",
        "count(*) AS Total_Flights, CAST(sum(CASE WHEN Departure_Delay > 15 THEN 1 ELSE 0 END) AS BIGINT) AS Delayed_Flights, "
        "round(100.0::DOUBLE * sum(CASE WHEN Departure_Delay > 15 THEN 1 ELSE 0 END) / count(*), 2) AS Delay_Percentage"),
    "complaint_types_by_airline": _group(
        "Airline_Name, Complaint_Type", "count(*) AS Complaint_Count", "WHERE Complaint_Submitted = 'Yes'"),
    "booking_usage": _group("Booking_Channel", "count(*) AS FlightCount"),
    "seat_type_by_airline": _group("Airline_Name, Seat_Type", "count(*) AS SeatCount"),
    "frequent_flyers_by_airline": _group(
        "Airline_Name", "count(*) AS FrequentFlyerCount", "WHERE Frequent_Flyer = 'Yes'"),
    "segment_age_purpose":
        "SELECT Travel_Purpose, CASE WHEN Age < 25 THEN 'Under 25' WHEN Age BETWEEN 25 AND 40 THEN '25-40' "
        "WHEN Age BETWEEN 41 AND 60 THEN '41-60' ELSE '60+' END AS Age_Group, count(*) AS Passenger_Count, "
        f"{POSITIVE} FROM staging GROUP BY 1, 2",
    "on_time_by_route_type": _group(
        "Flight_Route_Type",
        "count(*) AS Total_Flights, CAST(sum(CASE WHEN Departure_Delay <= 0 AND Arrival_Delay <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS On_Time_Flights, "
        "round(100.0::DOUBLE * sum(CASE WHEN Departure_Delay <= 0 AND Arrival_Delay <= 0 THEN 1 ELSE 0 END) / count(*), 2) AS On_Time_Percentage"),
    "loyalty_impact": _group("Loyalty_Membership", f"count(*) AS Total_Passengers, {POSITIVE}"),
    "class_performance": _group(
        "Class", "round(avg(Departure_Delay), 6) AS Avg_Departure_Delay, round(avg(Arrival_Delay), 6) AS Avg_Arrival_Delay, " + POSITIVE),
}.items()}
