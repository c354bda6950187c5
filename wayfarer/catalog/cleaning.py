"""Registered queries: sources and sinks, projection, filters, repair."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import scale
from wayfarer.operators import clean
from wayfarer.plans import olap
from wayfarer.plans.binding import VIEWS, oracle, star, table, view
from wayfarer.session import staging_dir
from wayfarer.sources import readers, writers

STAR_COLUMNS = [
    "Age", "Gender", "Travel_Purpose", "Airline_Name", "Class", "Departure_City", "Arrival_City", "Flight_Distance",
    "Flight_Duration", "Departure_Delay", "Arrival_Delay", "Festival_Season_Travel", "Seat_Comfort", "Food_Quality",
    "Cleanliness", "Cabin_Staff_Service", "WiFi_Service", "Overall_Satisfaction", "Recommendation", "Complaint_Type",
    "Baggage_Lost", "Loyalty_Membership", "Booking_Channel", "Seat_Upgrade", "Compensation_Received",
    "Discount_Received", "Payment_Method",
]
CSV_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
CSV_COLUMNS = [c.strip().split()[0] for c in CSV_SCHEMA.split(",")]
RATINGS = ["Seat_Comfort", "Food_Quality", "WiFi_Service", "Overall_Satisfaction", "Recommendation"]
# one scale of every kind, applied to the column it is made for
RECODES = {
    "rating_encoded": "Seat_Comfort", "rating_prepared": "Seat_Comfort", "wifi_prepared": "WiFi_Service",
    "rating_clustering": "WiFi_Service", "rating_composite": "Food_Quality", "rating_profile": "Food_Quality",
    "satisfaction_binary": "Overall_Satisfaction", "satisfaction_prepared": "Overall_Satisfaction",
    "satisfaction_clustering": "Overall_Satisfaction", "satisfaction_profile": "Overall_Satisfaction",
    "yes_no_encoded": "Recommendation", "recommendation_prepared": "Recommendation",
    "yes_no_clustering": "Recommendation",
}


def _scratch(spark, name: str) -> str:
    return os.path.join(staging_dir(spark), f"{name}-{uuid.uuid4().hex}")


def read_csv_table(spark, sf_dir):
    path = _scratch(spark, "orders-csv")
    table(spark, sf_dir, "orders").select(*CSV_COLUMNS).write.option("header", True).csv(path)
    return readers.read_csv_table(spark, path, CSV_SCHEMA)


def write_csv_result(spark, sf_dir):
    result = olap.on_time_by_route_type(star(spark, sf_dir))
    path = writers.write_csv_result(result, _scratch(spark, "results"), "On Time By Route")
    return readers.read_csv_table(spark, path, result.schema)


def to_json_records(spark, sf_dir):
    return writers.to_json_records(olap.complaint_types_by_airline(star(spark, sf_dir)))


def recode_map(spark, sf_dir):
    rows = view(spark, sf_dir, "service")
    return rows.select("Service_Key", *[scale(c, vocab.SCALES[name]).alias(name) for name, c in RECODES.items()])


def _recode_sql() -> str:
    fields = []
    for name, column in RECODES.items():
        spec = vocab.SCALES[name]
        source = f"lower({column})" if spec["lower"] else column
        arms = " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in spec["values"].items() if v is not None)
        rest = "NULL" if spec["default"] is None else f"{float(spec['default'])}::DOUBLE"
        fields.append(f"CASE {source} {arms} ELSE {rest} END AS {name}")
    return f"SELECT Service_Key, {', '.join(fields)} FROM service"


def filter_or_range(spark, sf_dir):
    raw = view(spark, sf_dir, "raw")
    tests = {c: clean.in_range(c, *r) for c, r in vocab.VALID_RANGES.items()}
    return raw.agg(*[F.count_if(F.col(c).isNotNull() & ~t).alias(f"bad_{c}") for c, t in tests.items()])


def impute_mean(spark, sf_dir):
    out = clean.impute_mean(view(spark, sf_dir, "raw").select("Passenger_ID", "Age", "Flight_Distance"), ["Age", "Flight_Distance"])
    return out.select("Passenger_ID", F.round("Age", 6).alias("Age"), F.round("Flight_Distance", 6).alias("Flight_Distance"))


def impute_median(spark, sf_dir):
    out = clean.impute_median(view(spark, sf_dir, "raw").select("Passenger_ID", "Age", "Flight_Distance"), ["Age", "Flight_Distance"])
    return out.select("Passenger_ID", F.round("Age", 6).alias("Age"), F.round("Flight_Distance", 6).alias("Flight_Distance"))


def select_by_type(spark, sf_dir):
    """The numeric columns of the table."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*clean.columns_by_type(rows)[0])


def keep_original(spark, sf_dir):
    rows = view(spark, sf_dir, "service").select("Service_Key", "Seat_Comfort", "Recommendation")
    kept = clean.keep_original(rows, ["Seat_Comfort", "Recommendation", "Absent"])
    return clean.recode_columns(kept, {
        "Seat_Comfort": vocab.SCALES["rating_prepared"], "Recommendation": vocab.SCALES["recommendation_prepared"],
    })


def select_present(spark, sf_dir):
    """The widest feature set, cut to the columns the table has."""
    return clean.select_present(view(spark, sf_dir, "service"), ["Service_Key", *vocab.FEATURE_SETS["all"]])


def _raw(*columns):
    def load(spark, sf_dir):
        return view(spark, sf_dir, "raw").select("Passenger_ID", *columns)
    return load


QUERIES = {
    "read_csv_table": read_csv_table,
    "write_csv_result": write_csv_result,
    "to_json_records": to_json_records,
    "project_star": lambda s, d: star(s, d).flat(STAR_COLUMNS),
    "filter_eq": lambda s, d: clean.filter_eq(view(s, d, "airline"), "Airline_Name", "Air India"),
    "filter_in_and": lambda s, d: clean.filter_in_and(
        view(s, d, "service"), {"Overall_Satisfaction": ["Happy", "Satisfied"]}, {"Complaint_Submitted": "Yes"}
    ).select("Service_Key", "Passenger_Key", "Overall_Satisfaction"),
    "filter_ne_notnull": lambda s, d: clean.filter_ne_notnull(view(s, d, "airline"), "Airline_Loyalty_Program", "N/A"),
    "filter_or_range": filter_or_range,
    "recode_map": recode_map,
    "replace_values": lambda s, d: clean.replace_values(_raw("Gender", "Nationality")(s, d), vocab.SPELLINGS),
    "null_if_out_of_range": lambda s, d: clean.null_if_out_of_range(_raw("Age", "Flight_Distance")(s, d), vocab.VALID_RANGES),
    "fill_constants": lambda s, d: clean.fill_constants(_raw("Complaint_Type", "Preferred_Airline")(s, d), vocab.FILL_VALUES),
    "impute_median": impute_median,
    "impute_mean": impute_mean,
    "impute_mode": lambda s, d: clean.impute_mode(_raw("Gender", "Travel_Purpose")(s, d), ["Gender", "Travel_Purpose"]),
    "drop_null_rows": lambda s, d: clean.drop_null_rows(_raw("Age", "Gender")(s, d), ["Age", "Gender"]),
    "coerce_numeric": lambda s, d: clean.coerce_numeric(_raw("Seat_Comfort", "Food_Quality")(s, d), ["Seat_Comfort", "Food_Quality"]),
    "keep_original": keep_original,
    "select_present": select_present,
    "select_by_type": select_by_type,
    "drop_columns": lambda s, d: clean.drop_columns(view(s, d, "passenger"), ["Passenger_Key", "Gender", "Absent"]),
}


def _mode_sql(column: str) -> str:
    return (
        f"(SELECT {column} FROM (SELECT {column}, count(*) AS n FROM raw WHERE {column} IS NOT NULL GROUP BY 1) "
        f"ORDER BY n DESC, {column} LIMIT 1)"
    )


ORACLES = {name: oracle(sql) for name, sql in {
    "read_csv_table": f"SELECT {', '.join(CSV_COLUMNS)} FROM orders",
    "write_csv_result":
        "SELECT Flight_Route_Type, count(*) AS Total_Flights, CAST(count(*) FILTER (Departure_Delay <= 0 AND Arrival_Delay <= 0) AS BIGINT) AS On_Time_Flights, "
        "round(100.0::DOUBLE * count(*) FILTER (Departure_Delay <= 0 AND Arrival_Delay <= 0) / count(*), 2) AS On_Time_Percentage FROM staging GROUP BY 1",
    "to_json_records":
        "SELECT CAST(to_json(t) AS VARCHAR) AS record FROM (SELECT Airline_Name, Complaint_Type, count(*) AS Complaint_Count "
        "FROM staging WHERE Complaint_Submitted = 'Yes' GROUP BY ALL) t",
    "project_star": f"SELECT {', '.join(STAR_COLUMNS)} FROM staging",
    "filter_eq": "SELECT * FROM airline WHERE Airline_Name = 'Air India'",
    "filter_in_and":
        "SELECT Service_Key, Passenger_Key, Overall_Satisfaction FROM service "
        "WHERE Overall_Satisfaction IN ('Happy', 'Satisfied') AND Complaint_Submitted = 'Yes'",
    "filter_ne_notnull": "SELECT * FROM airline WHERE Airline_Loyalty_Program <> 'N/A'",
    "filter_or_range":
        "SELECT count(*) FILTER (Age < 0 OR Age > 120) AS bad_Age, count(*) FILTER (Flight_Distance < 0) AS bad_Flight_Distance FROM raw",
    "recode_map": _recode_sql(),
    "replace_values":
        "SELECT Passenger_ID, CASE WHEN Gender IN ('Unknown', 'X') THEN 'Other' ELSE Gender END AS Gender, "
        "CASE WHEN Nationality IN ('Ind', 'Indien') THEN 'Indian' ELSE Nationality END AS Nationality FROM raw",
    "null_if_out_of_range":
        "SELECT Passenger_ID, CASE WHEN Age BETWEEN 0 AND 120 THEN Age END AS Age, "
        "CASE WHEN Flight_Distance >= 0 THEN Flight_Distance END AS Flight_Distance FROM raw",
    "fill_constants":
        "SELECT Passenger_ID, coalesce(Complaint_Type, 'No complaint') AS Complaint_Type, "
        "coalesce(Preferred_Airline, 'No') AS Preferred_Airline FROM raw",
    "impute_median":
        "SELECT Passenger_ID, round(coalesce(Age, (SELECT median(Age) FROM raw)), 6) AS Age, "
        "round(coalesce(Flight_Distance, (SELECT median(Flight_Distance) FROM raw)), 6) AS Flight_Distance FROM raw",
    "impute_mean":
        "SELECT Passenger_ID, round(coalesce(Age, (SELECT avg(Age) FROM raw)), 6) AS Age, "
        "round(coalesce(Flight_Distance, (SELECT avg(Flight_Distance) FROM raw)), 6) AS Flight_Distance FROM raw",
    "impute_mode":
        f"SELECT Passenger_ID, coalesce(Gender, {_mode_sql('Gender')}) AS Gender, "
        f"coalesce(Travel_Purpose, {_mode_sql('Travel_Purpose')}) AS Travel_Purpose FROM raw",
    "drop_null_rows": "SELECT Passenger_ID, Age, Gender FROM raw WHERE Age IS NOT NULL AND Gender IS NOT NULL",
    "coerce_numeric":
        "SELECT Passenger_ID, TRY_CAST(Seat_Comfort AS DOUBLE) AS Seat_Comfort, TRY_CAST(Food_Quality AS DOUBLE) AS Food_Quality FROM raw",
    "keep_original":
        "SELECT Service_Key, Seat_Comfort AS Seat_Comfort_Original, Recommendation AS Recommendation_Original, "
        "CASE Seat_Comfort WHEN 'Poor' THEN 1.0::DOUBLE WHEN 'Fair' THEN 2 WHEN 'Good' THEN 3 WHEN 'Excellent' THEN 4 ELSE 0 END AS Seat_Comfort, "
        "CASE Recommendation WHEN 'Yes' THEN 1.0::DOUBLE WHEN 'Maybe' THEN 0.5 ELSE 0 END AS Recommendation FROM service",
    "select_present": f"SELECT Service_Key, {', '.join(c for c in vocab.FEATURE_SETS['all'] if c in VIEWS['service'][1])} FROM service",
    "select_by_type": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "drop_columns":
        "SELECT Age, Travel_Purpose, Nationality, Seat_Type, Preferred_Airline, Special_Assistance, Frequent_Route FROM passenger",
}.items()}
