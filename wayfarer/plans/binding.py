"""Binds the passenger-experience roles to the driver's order tables.

Each derived column is one expression in the SQL subset both engines share, so
the same text defines the Spark view and the oracle's CTE; everything computed
*on* the views is written separately on the two sides.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.plans.star import Dimension, Star
from wayfarer.session import ship


# the tables as delivered; naming the schema spares one footer job per read
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders":
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string",
    "lineitem":
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz",
    "events":
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _rating(number: str) -> str:
    return (
        f"CASE {number} WHEN 0 THEN 'Poor' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Good' "
        f"WHEN 3 THEN 'Excellent' ELSE 'Unavailable' END"
    )


_PRIORITY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Excellent' WHEN '2-HIGH' THEN 'Good' "
    "WHEN '3-MEDIUM' THEN 'Fair' WHEN '4-NOT SPECIFIED' THEN 'Poor' ELSE 'Unavailable' END"
)
_UNHAPPY = "(o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AND o_orderstatus <> 'O')"
_COMPLAINT = f"({_UNHAPPY} OR o_custkey % 7 = 0)"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "fact": ("lineitem", {
        "Service_Key": "l_orderkey",
        "Flight_Key": "l_partkey",
        "Airline_Key": "l_suppkey",
        "Leg": "l_linenumber",
        "Departure_Delay": "CAST(l_quantity - 10 AS INT)",
        "Arrival_Delay": "CAST(l_quantity - 5 * l_linenumber AS INT)",
        "Festival_Season_Travel": "CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END",
        "Baggage_Lost": "CASE WHEN l_discount > 0.085 THEN 'Yes' ELSE 'No' END",
        "Seat_Upgrade": "CASE WHEN l_discount < 0.025 THEN 'Yes' ELSE 'No' END",
        "Compensation_Received":
            "CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN 'No' ELSE 'Not Applicable' END",
        "Discount_Received": "CASE WHEN l_discount > 0.055 THEN 'Yes' ELSE 'No' END",
        "Booking_Channel":
            "CASE WHEN l_linenumber IN (1, 4) THEN 'Mobile App' WHEN l_linenumber IN (2, 5) THEN 'Website' "
            "ELSE 'Travel Agent' END",
        "Payment_Method": "CASE WHEN l_tax < 0.025 THEN 'Card' WHEN l_tax < 0.055 THEN 'UPI' ELSE 'Cash' END",
    }),
    "flight": ("part", {
        "Flight_Key": "p_partkey",
        "Class":
            "CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL') THEN 'Economy' "
            "WHEN p_type IN ('PROMO', 'MEDIUM') THEN 'Business' ELSE 'First Class' END",
        "Departure_City": "p_brand",
        "Arrival_City": "concat('City ', CAST(p_size % 12 AS STRING))",
        "Flight_Route_Type": "CASE WHEN p_size > 25 THEN 'International' ELSE 'Domestic' END",
        "Flight_Distance": "p_retailprice",
        "Flight_Duration":
            "concat(lpad(CAST(p_size % 6 AS STRING), 2, '0'), ':', lpad(CAST(p_partkey % 60 AS STRING), 2, '0'))",
    }),
    "airline": ("supplier JOIN nation ON s_nationkey = n_nationkey", {
        "Airline_Key": "s_suppkey",
        "Airline_Name":
            "CASE n_nationkey WHEN 0 THEN 'Air India' WHEN 1 THEN 'SpiceJet' WHEN 2 THEN 'IndiGo' "
            "WHEN 3 THEN 'TruJet' ELSE n_name END",
        "Loyalty_Membership":
            "CASE s_suppkey % 5 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' "
            "WHEN 3 THEN 'Platinum' ELSE 'Basic' END",
        "Frequent_Flyer": "CASE WHEN s_suppkey % 3 = 0 THEN 'Yes' ELSE 'No' END",
        "Airline_Loyalty_Program":
            "CASE s_suppkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN concat('Star Club', chr(13)) "
            "WHEN 3 THEN 'Star Club' WHEN 4 THEN 'Sky Miles' ELSE 'Cloud Card' END",
    }),
    "service": ("orders", {
        "Service_Key": "o_orderkey",
        "Passenger_Key": "o_custkey",
        "Seat_Comfort": _PRIORITY,
        "InFlight_Entertainment": _rating("o_orderkey % 5"),
        "Food_Quality": f"CASE WHEN o_custkey % 3 = 0 THEN {_PRIORITY} ELSE {_rating('o_orderkey % 4')} END",
        "Cleanliness": f"CASE WHEN o_custkey % 2 = 0 THEN {_PRIORITY} ELSE {_rating('(o_orderkey + o_custkey) % 4')} END",
        "Cabin_Staff_Service": _rating("(o_orderkey + o_custkey) % 3 + 1"),
        "Legroom": _rating("o_orderkey % 7 % 4"),
        "Baggage_Handling": _rating("o_custkey % 5"),
        "CheckIn_Service": _rating("o_custkey % 4"),
        "Boarding_Process": _rating("(o_orderkey + 3 * o_custkey) % 5"),
        "WiFi_Service":
            "CASE WHEN o_orderkey % 6 = 5 THEN 'No Connection' ELSE " + _rating("o_orderkey % 6") + " END",
        "Overall_Satisfaction":
            f"CASE WHEN {_UNHAPPY} THEN 'Dissatisfied' WHEN o_orderstatus = 'F' THEN 'Happy' "
            "WHEN o_orderstatus = 'P' THEN 'Satisfied' ELSE 'Neutral' END",
        "Recommendation":
            f"CASE WHEN {_UNHAPPY} THEN 'No' WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'Maybe' ELSE 'Yes' END",
        "Complaint_Submitted": f"CASE WHEN {_COMPLAINT} THEN 'Yes' ELSE 'No' END",
        "Complaint_Type":
            f"CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN NOT {_COMPLAINT} THEN 'No complaint' "
            "WHEN o_custkey % 4 = 0 THEN 'Delay' WHEN o_custkey % 4 = 1 THEN 'Baggage' "
            "WHEN o_custkey % 4 = 2 THEN 'Food' ELSE 'Staff' END",
    }),
    "passenger": ("customer JOIN nation ON c_nationkey = n_nationkey", {
        "Passenger_Key": "c_custkey",
        "Age": "CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE CAST(c_custkey % 97 + 4 AS INT) END",
        "Gender": "CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Female' ELSE 'Other' END",
        "Travel_Purpose": "c_mktsegment",
        "Nationality": "n_name",
        "Seat_Type": "CASE c_custkey % 3 WHEN 0 THEN 'Aisle' WHEN 1 THEN 'Window' ELSE 'Middle' END",
        "Preferred_Airline": "CASE c_custkey % 5 WHEN 0 THEN 'Sometimes' WHEN 1 THEN 'Yes' WHEN 2 THEN NULL ELSE 'No' END",
        "Special_Assistance": "CASE WHEN c_acctbal < 0 THEN 'Yes' ELSE 'No' END",
        "Frequent_Route": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('Route ', CAST(c_custkey % 9 AS STRING)) END",
    }),
    # values as they arrive: impossible ages, odd spellings, text numbers, gaps
    "raw": ("customer JOIN nation ON c_nationkey = n_nationkey", {
        "Passenger_ID": "c_custkey",
        "Age": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 140 - 8 AS DOUBLE) END",
        "Gender": "CASE c_custkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'X' ELSE NULL END",
        "Nationality": "CASE n_nationkey % 5 WHEN 0 THEN 'Ind' WHEN 1 THEN 'Indien' WHEN 2 THEN 'Indian' ELSE n_name END",
        "Flight_Distance": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END",
        "Seat_Comfort":
            "CASE c_custkey % 7 WHEN 0 THEN 'bad' WHEN 1 THEN NULL ELSE CAST(c_custkey % 7 AS STRING) END",
        "Food_Quality": "CASE WHEN c_custkey % 6 = 0 THEN 'n/a' ELSE CAST(c_custkey % 4 + 1 AS STRING) END",
        "Travel_Purpose": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END",
        "Flight_Duration":
            "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN CAST(c_custkey % 200 AS STRING) "
            "WHEN 3 THEN '25:61' ELSE concat(CAST(c_custkey % 6 AS STRING), ':', lpad(CAST(c_custkey % 60 AS STRING), 2, '0')) END",
        "Complaint_Type": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Delay' END",
        "Preferred_Airline": "CASE c_custkey % 5 WHEN 0 THEN 'Sometimes' WHEN 1 THEN 'YES' WHEN 2 THEN NULL ELSE 'no' END",
    }),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One bound view, straight from the parquet tables it needs."""
    source, columns = VIEWS[name]
    if " JOIN nation ON " in source:
        base, condition = source.split(" JOIN nation ON ")
        # nation is a fixed table of 25 rows; broadcasting follows from its size
        frame = table(spark, sf_dir, base).join(table(spark, sf_dir, "nation"), F.expr(condition))
    else:
        frame = table(spark, sf_dir, source)
    return frame.selectExpr(*[f"{text} AS {name_}" for name_, text in columns.items()])


def star(spark: SparkSession, sf_dir: str) -> Star:
    def dimension(name: str, key: str, via: str = "fact") -> Dimension:
        # the tables come with whole foreign keys
        return Dimension(lambda: view(spark, sf_dir, name), key, via, columns=tuple(VIEWS[name][1]), total=True)

    return Star(
        view(spark, sf_dir, "fact"),
        {
            "flight": dimension("flight", "Flight_Key"),
            "airline": dimension("airline", "Airline_Key"),
            "service": dimension("service", "Service_Key"),
            "passenger": dimension("passenger", "Passenger_Key", via="service"),
        },
    )


_PARENTS = {"flight": ("p_partkey", "fact", "l_partkey"), "airline": ("s_suppkey", "fact", "l_suppkey"),
            "service": ("o_orderkey", "fact", "l_orderkey"), "passenger": ("c_custkey", "service", "o_custkey")}


def late_flat(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``star(...).flat(columns)``, whose joins carry the tables' own columns: few and short ones stand for the many
    texts that are made of them, and every text is made after the last join."""
    owners = {c: next(v for v in ("fact", *_PARENTS) if c in VIEWS[v][1]) for c in columns}

    def carried(view_: str, column: str) -> str:
        if view_ in _PARENTS and column == _PARENTS[view_][0]:  # a key is what points at it
            return carried(*_PARENTS[view_][1:])
        return f"{view_}__{column}"

    texts, wanted = {}, []
    for c, v in owners.items():
        names = re.findall(r"\b[lpsnoc]_[a-z]+\b", VIEWS[v][1][c])
        wanted += [carried(v, n) for n in names]
        texts[c] = re.sub(r"\b[lpsnoc]_[a-z]+\b", lambda m: f"`{carried(v, m.group())}`", VIEWS[v][1][c])

    def raw(view_: str) -> DataFrame:
        tables = VIEWS[view_][0].split(" JOIN nation ON ")
        frame = table(spark, sf_dir, tables[0])
        if len(tables) > 1:
            frame = frame.join(table(spark, sf_dir, "nation"), F.expr(tables[1]))  # 25 rows
        return frame.select(*[F.col(c).alias(f"{view_}__{c}") for c in frame.columns])

    dims = {v: Dimension(raw(v), f"{v}__{key}", via, f"{via}__{pointer}", total=True) for v, (key, via, pointer) in _PARENTS.items()}
    # a view named only by its key is joined too: rows without a partner drop out there as well
    used = [v for v in dict.fromkeys(owners.values()) if v != "fact"]
    return Star(raw("fact"), dims).flat(list(dict.fromkeys(wanted)), used, nested=True).selectExpr(*[f"{texts[c]} AS {c}" for c in columns])


def oracle(body: str) -> str:
    """`body` with the bound views it names put in front as CTEs."""
    used = [n for n in VIEWS if _names(body, n) or (n not in ("raw",) and _names(body, "staging"))]
    ctes = []
    for name in used:
        source, columns = VIEWS[name]
        fields = ", ".join(f"{text} AS {alias}" for alias, text in columns.items())
        ctes.append(f"{name} AS (SELECT {fields} FROM {source})")
    if _names(body, "staging"):
        ctes.append(
            "staging AS (SELECT * FROM fact JOIN flight USING (Flight_Key) JOIN airline USING (Airline_Key) "
            "JOIN service USING (Service_Key) JOIN passenger USING (Passenger_Key))"
        )
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def _names(body: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", body, re.IGNORECASE) is not None
