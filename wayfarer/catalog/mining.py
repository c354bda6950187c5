"""Registered queries: association mining and text."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wayfarer import vocabulary as vocab
from wayfarer.functions.columns import bin_fixed, bin_left_closed, hhmm_to_minutes, row_mean, scale
from wayfarer.operators import clean, text
from wayfarer.operators import rules as r
from wayfarer.operators.bins import bin_quantile
from wayfarer.plans.binding import late_flat, oracle, table
from wayfarer.session import stage, staging_dir
from wayfarer.sources import writers

CITIES = ["Departure_City", "Arrival_City"]
ROW = ["Service_Key", "Leg", "Flight_Key", "Airline_Key"]
RULE_CUT = {k: vocab.KEYED_MINING[k] for k in ("min_confidence", "min_lift")}


def _service_composite(rows):
    """Mean service score; one projection per step, so that no expression is repeated in the next."""
    scores = {f"{c}_Score": scale(c, vocab.SCALES["rating_composite"]) for c in vocab.SERVICE_COLUMNS}
    return rows.withColumns(scores).withColumn("Service_Composite", row_mean(*scores))


def _flight_times(rows):
    timed = rows.withColumn("Flight_Minutes", hhmm_to_minutes("Flight_Duration"))
    return timed.withColumns({
        "Flight_Time_Cat": bin_fixed("Flight_Minutes", *vocab.FLIGHT_TIME_BINS),
        "Flight_Duration_Category": bin_left_closed(F.col("Flight_Minutes") / 60, *vocab.DURATION_HOURS),
    })


def _flights(spark, sf_dir, columns):
    """The flat table with the categories that mining reads, all derived after the joins."""
    delays = {f"{c}_Category": c for c in ("Departure_Delay", "Arrival_Delay")}
    times = ("Flight_Time_Cat", "Flight_Duration_Category")
    made = {"Service_Composite": vocab.SERVICE_COLUMNS, **{c: ["Flight_Duration"] for c in times}, **{c: [d] for c, d in delays.items()}}
    rows = late_flat(spark, sf_dir, list(dict.fromkeys(b for c in columns for b in made.get(c, [c]))))
    if "Service_Composite" in columns:
        rows = _service_composite(rows)
    if any(c in times for c in columns):
        rows = _flight_times(rows)
    rows = rows.withColumns({c: bin_fixed(d, *vocab.DELAY_BINS) for c, d in delays.items() if c in columns})
    return rows.select(*columns)


def keyed(spark, sf_dir, keep=()):
    """Service class by terciles of all flights, cities tidied and rare ones named so."""
    columns = [c if c != "Service_Class" else "Service_Composite" for c in vocab.KEYED_ITEM_COLUMNS]
    rows = stage(_flights(spark, sf_dir, [*keep, *columns]), "keyed")
    rows = bin_quantile(rows, "Service_Composite", vocab.SERVICE_TERTILES, "Service_Class")
    rows = clean.rare_to_other(clean.clean_names(rows, CITIES), CITIES, vocab.MIN_CITY_COUNT, vocab.RARE_LABEL)
    return r.transactions_keyed(rows, vocab.KEYED_ITEM_COLUMNS, keep, CITIES)


def prefixed(spark, sf_dir):
    return r.transactions_prefixed(_flights(spark, sf_dir, vocab.PREFIXED_ITEM_COLUMNS), vocab.PREFIXED_ITEM_COLUMNS)


def flags(spark, sf_dir, keep=()):
    dummies = ["Class", "Booking_Channel"]
    rows = _flights(spark, sf_dir, [*keep, *vocab.FLAG_ITEM_COLUMNS, *dummies])
    return r.transactions_flags(rows, vocab.FLAG_ITEM_COLUMNS, dummies, keep)


def _mined_keyed(spark, sf_dir):
    return r.frequent_itemsets(keyed(spark, sf_dir), vocab.KEYED_MINING["min_support"], vocab.KEYED_MINING["max_len"])


def _mined_prefixed(spark, sf_dir):
    return r.frequent_itemsets(prefixed(spark, sf_dir), vocab.PREFIXED_MINING["min_support"], vocab.PREFIXED_MINING["max_len"])


def _joined(df, *arrays):
    """Item lists as text, numbers rounded: what the oracle can compare."""
    out = df.withColumns({a: F.concat_ws(" + ", a) for a in arrays})
    numbers = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    return out.withColumns({c: F.round(c, 6) for c in numbers})


def _rules(spark, sf_dir, **cut):
    mined = _mined_keyed(spark, sf_dir)
    return mined, r.association_rules(mined, **cut)


def _with_items(df):
    return df.select(*ROW, F.concat_ws("|", "items").alias("items"))


def transactions_prefix(spark, sf_dir):
    rows = _flights(spark, sf_dir, [*ROW, *vocab.PREFIXED_ITEM_COLUMNS])
    return _with_items(r.transactions_prefixed(rows, vocab.PREFIXED_ITEM_COLUMNS, ROW))


def frequent_itemsets(spark, sf_dir):
    return _joined(_mined_keyed(spark, sf_dir).itemsets, "items")


def frequent_itemsets_flags(spark, sf_dir):
    """Unlimited length."""
    return _joined(r.frequent_itemsets(flags(spark, sf_dir), 0.05).itemsets, "items")


def support_fallback(spark, sf_dir):
    _, rules = r.mine_with_fallback(flags(spark, sf_dir), (0.95, 0.2), (0.99, 0.3), 3)
    return _joined(rules, "antecedent", "consequent")


def write_rules(spark, sf_dir):
    _, rules = _rules(spark, sf_dir, **RULE_CUT)
    path = os.path.join(staging_dir(spark), f"rules-{uuid.uuid4().hex}")
    writers.write_rules(rules, path, "parquet")
    return _joined(spark.read.schema(rules.schema).parquet(path), "antecedent", "consequent")


def rule_category(spark, sf_dir):
    out = r.rule_category(_rules(spark, sf_dir, min_confidence=0.2)[1])
    return _joined(out.select("category", "place", "antecedent", "consequent", "lift"), "antecedent", "consequent")


def rules_by_prefix(spark, sf_dir):
    mined = _mined_prefixed(spark, sf_dir)
    rules = r.association_rules(mined, min_confidence=0.2)
    out = r.rules_by_prefix(rules, vocab.SERVICE_ITEMS, vocab.OUTCOME_ITEMS)
    return _joined(out.select("antecedent", "consequent", "confidence", "lift"), "antecedent", "consequent")


def rule_edges(spark, sf_dir):
    return _joined(r.rule_edges(_rules(spark, sf_dir, min_confidence=0.2)[1], 200))


def rule_summary(spark, sf_dir):
    return r.rule_summary(*_rules(spark, sf_dir, **RULE_CUT))


def itemsets_by_prefix(spark, sf_dir):
    mined = _mined_prefixed(spark, sf_dir).itemsets
    customer = r.itemsets_by_prefix(mined, vocab.CUSTOMER_ITEMS).withColumn("kind", F.lit("customer"))
    operation = r.itemsets_by_prefix(mined, vocab.OPERATION_ITEMS).withColumn("kind", F.lit("operation"))
    return _joined(customer.unionByName(operation), "items")


def tfidf_terms(spark, sf_dir):
    out = text.tfidf_terms(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


QUERIES = {
    "transactions_kv": lambda s, d: _with_items(keyed(s, d, ROW)),
    "transactions_prefix": transactions_prefix,
    "transactions_flags": lambda s, d: _with_items(flags(s, d, ROW)),
    "frequent_itemsets": frequent_itemsets,
    "frequent_itemsets_flags": frequent_itemsets_flags,
    "support_fallback": support_fallback,
    "association_rules": lambda s, d: _joined(_rules(s, d)[1], "antecedent", "consequent"),
    "rules_filtered": lambda s, d: _joined(_rules(s, d, **RULE_CUT, max_consequent=1)[1], "antecedent", "consequent"),
    "rules_top": lambda s, d: _joined(r.rules_top(_rules(s, d, min_confidence=0.2)[1]), "antecedent", "consequent"),
    "rule_category": rule_category,
    "itemsets_by_prefix": itemsets_by_prefix,
    "rules_by_prefix": rules_by_prefix,
    "rule_edges": rule_edges,
    "itemset_matrix": lambda s, d: r.itemset_matrix(_mined_keyed(s, d).itemsets),
    "rule_summary": rule_summary,
    "write_rules": write_rules,
    "tfidf_terms": tfidf_terms,
    "vocabulary_size": lambda s, d: text.vocabulary_size(table(s, d, "documents"), "text"),
}

# --- oracles --------------------------------------------------------------------------

_MIN = "(CAST(split_part(Flight_Duration, ':', 1) AS INT) * 60 + CAST(split_part(Flight_Duration, ':', 2) AS INT))"


def _delay(c: str) -> str:
    return f"CASE WHEN {c} <= 15 THEN 'On-time' WHEN {c} <= 45 THEN 'Minor Delay' ELSE 'Significant Delay' END AS {c}_Category"


_RATE = " + ".join(
    f"(CASE {c} WHEN 'Poor' THEN 1 WHEN 'Fair' THEN 2 WHEN 'Good' THEN 3 WHEN 'Excellent' THEN 4 ELSE 2 END)" for c in vocab.SERVICE_COLUMNS)
_FLIGHTS = (
    "scored AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY Service_Key, Leg, Flight_Key, Airline_Key) - 1 AS id, "
    f"CASE WHEN {_MIN} <= 0 THEN NULL WHEN {_MIN} <= 90 THEN 'Short' WHEN {_MIN} <= 180 THEN 'Medium' WHEN {_MIN} <= 300 THEN 'Long' ELSE 'Extended' END AS Flight_Time_Cat, "
    f"CASE WHEN {_MIN} < 60 THEN 'Short' WHEN {_MIN} < 120 THEN 'Medium' ELSE 'Long' END AS Flight_Duration_Category, "
    f"{_delay('Departure_Delay')}, {_delay('Arrival_Delay')}, ({_RATE}) / 9.0::DOUBLE AS Service_Composite FROM staging), "
    "cities AS MATERIALIZED (SELECT c FROM (SELECT Departure_City AS c FROM scored UNION ALL SELECT Arrival_City FROM scored) GROUP BY c HAVING count(*) >= 15), "
    "edges AS (SELECT quantile_cont(Service_Composite, 1.0::DOUBLE / 3) AS low, quantile_cont(Service_Composite, 2.0::DOUBLE / 3) AS high FROM scored), "
    "flights AS MATERIALIZED (SELECT *, CASE WHEN Service_Composite <= low THEN 'Basic' WHEN Service_Composite <= high THEN 'Standard' ELSE 'Premium' END AS Service_Class FROM scored, edges)"
)


def _kv_items() -> str:
    parts = []
    for c in vocab.KEYED_ITEM_COLUMNS:
        if c in CITIES:
            parts.append(f"CASE WHEN {c} IN (SELECT c FROM cities) THEN '{c.split('_')[0]}=' || {c} END")
        else:
            parts.append(f"'{c}=' || replace({c}, ' ', '_')")
    return _list(parts)


def _list(parts: list[str]) -> str:
    return f"list_sort([x for x in [{', '.join(parts)}] if x is not null])"


_PREFIX_ALL = _list([f"'{c}_' || {c}" for c in vocab.PREFIXED_ITEM_COLUMNS])
_FLAGS = _list([f"CASE WHEN {c} = 'Yes' THEN '{c}' END" for c in vocab.FLAG_ITEM_COLUMNS] + ["'Class_' || Class", "'Booking_Channel_' || Booking_Channel"])


def _mine(items: str, support: float, max_len: int = 3) -> str:
    """CTEs up to ``sets (items VARCHAR[], n)`` and ``tx_n``. Rows are numbered by their own columns and cut into
    chunks of 60; a frequent item is a number and a bit mask per chunk. An itemset is the number its items make in base
    4096; it grows from frequent pairs, and its rows are the joint bits."""
    need = f">= {support} * (SELECT total FROM tx_n)"
    key = "BIGINT" if max_len <= 5 else "HUGEINT"
    steps = [
        _FLIGHTS, f"tx AS MATERIALIZED (SELECT id, {items} AS items FROM flights)", "tx_n AS MATERIALIZED (SELECT count(*)::DOUBLE AS total FROM tx)",
        "u AS MATERIALIZED (SELECT id, unnest(items) AS x FROM tx)",
        f"f1 AS MATERIALIZED (SELECT x, n, row_number() OVER (ORDER BY x) AS i FROM (SELECT x, count(*) AS n FROM u GROUP BY 1 HAVING count(*) {need}))",
        "item_names AS MATERIALIZED (SELECT list(x ORDER BY i) AS all_names FROM f1)",
        f"m1 AS MATERIALIZED (SELECT CAST(i AS {key}) AS k, i, id // 60 AS chunk, bit_or(1::BIGINT << CAST(id % 60 AS INT)) AS mask FROM u JOIN f1 USING (x) GROUP BY ALL)",
        f"s1 AS (SELECT CAST(i AS {key}) AS k, n FROM f1)",
        f"s2 AS MATERIALIZED (SELECT a.k * 4096 + b.i AS k, a.i AS x, b.i AS y, sum(bit_count(a.mask & b.mask)) AS n FROM m1 a JOIN m1 b USING (chunk) WHERE a.i < b.i GROUP BY ALL HAVING sum(bit_count(a.mask & b.mask)) {need})",
    ]
    shown = []
    for size in range(1, max_len + 1):
        if size > 2:
            steps.append(
                f"m{size - 1} AS MATERIALIZED (SELECT l.k * 4096 + p.y AS k, p.y AS i, l.chunk, l.mask & b.mask AS mask FROM m{size - 2} l JOIN s2 p ON p.x = l.i "
                f"JOIN s{size - 1} f ON f.k = l.k * 4096 + p.y JOIN m1 b ON b.i = p.y AND b.chunk = l.chunk WHERE l.mask & b.mask <> 0)")
            steps.append(
                f"s{size} AS MATERIALIZED (SELECT l.k * 4096 + p.y AS k, sum(bit_count(l.mask & b.mask)) AS n FROM m{size - 1} l JOIN s2 p ON p.x = l.i "
                f"JOIN m1 b ON b.i = p.y AND b.chunk = l.chunk GROUP BY 1 HAVING sum(bit_count(l.mask & b.mask)) {need})")
        at = ", ".join(f"all_names[CAST(k // {4096 ** (size - 1 - p)} % 4096 AS INT)]" for p in range(size))
        shown.append(f"SELECT [{at}] AS items, CAST(n AS BIGINT) AS n FROM s{size}, item_names")
    steps.append(f"sets AS MATERIALIZED ({' UNION ALL '.join(shown)})")
    return "WITH " + ", ".join(steps)


_RULES = (
    ", pairs AS (SELECT items, n, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT) - 1)) AS m FROM sets WHERE len(items) > 1), "
    "halves AS (SELECT n, [x for x, i in items if (m >> (i - 1)) & 1 = 1] AS a, [x for x, i in items if (m >> (i - 1)) & 1 = 0] AS c FROM pairs), "
    "rules AS (SELECT halves.a AS antecedent, halves.c AS consequent, sa.n / total AS antecedent_support, sc.n / total AS consequent_support, "
    "halves.n / total AS support, halves.n::DOUBLE / sa.n AS confidence, halves.n::DOUBLE / sa.n / (sc.n / total) AS lift, "
    "halves.n / total - sa.n / total * (sc.n / total) AS leverage, "
    "CASE WHEN halves.n = sa.n THEN 'inf'::DOUBLE ELSE (1 - sc.n / total) / (1 - halves.n::DOUBLE / sa.n) END AS conviction "
    "FROM halves JOIN sets sa ON sa.items = halves.a JOIN sets sc ON sc.items = halves.c, tx_n) "
)
_NUMBERS = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction"))
_SHOWN = f"array_to_string(antecedent, ' + ') AS antecedent, array_to_string(consequent, ' + ') AS consequent, {_NUMBERS}"
_ITEMSETS = "SELECT array_to_string(items, ' + ') AS items, n, round(n / total, 6) AS support FROM sets, tx_n"
_BY_LIFT = "ORDER BY round(lift, 9) DESC, antecedent, consequent"
_KEYED = _mine(_kv_items(), vocab.KEYED_MINING["min_support"])
_PREFIXED = _mine(_PREFIX_ALL, vocab.PREFIXED_MINING["min_support"])


def _has(items: str, words: list[str]) -> str:
    return "len([1 for x in " + items + " if " + " or ".join(f"contains(x, '{w}')" for w in words) + "]) > 0"


def _row_items(items: str) -> str:
    return f"WITH {_FLIGHTS} SELECT {', '.join(ROW)}, array_to_string({items}, '|') AS items FROM flights"


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_WORDS = f"WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE text IS NOT NULL), v AS (SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 50)"

ORACLES = {name: oracle(sql) for name, sql in {
    "transactions_kv": _row_items(_kv_items()),
    "transactions_prefix": _row_items(_PREFIX_ALL),
    "transactions_flags": _row_items(_FLAGS),
    "frequent_itemsets": f"{_KEYED} {_ITEMSETS}",
    "frequent_itemsets_flags": f"{_mine(_FLAGS, 0.05, len(vocab.FLAG_ITEM_COLUMNS) + 2)} {_ITEMSETS}",
    "support_fallback": f"{_mine(_FLAGS, 0.2)}{_RULES} SELECT {_SHOWN} FROM rules WHERE confidence >= 0.3",
    "association_rules": f"{_KEYED}{_RULES} SELECT {_SHOWN} FROM rules",
    "rules_filtered": f"{_KEYED}{_RULES} SELECT {_SHOWN} FROM rules WHERE confidence >= 0.65 AND lift >= 1.7 AND len(consequent) = 1",
    "rules_top": f"{_KEYED}{_RULES} SELECT {_SHOWN} FROM (SELECT * FROM rules WHERE confidence >= 0.2 {_BY_LIFT} LIMIT 5)",
    "rule_category":
        f"{_KEYED}{_RULES}, labelled AS (SELECT *, CASE WHEN {_has('(antecedent || consequent)', ['Departure=', 'Arrival='])} THEN 'City Patterns' "
        f"WHEN {_has('(antecedent || consequent)', ['Service'])} THEN 'Service Relationships' WHEN {_has('(antecedent || consequent)', ['Loyalty'])} THEN 'Loyalty Program Insights' "
        "ELSE 'Flight Operations' END AS category FROM rules WHERE confidence >= 0.2), "
        "placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(lift, 9) DESC, antecedent, consequent) AS place FROM labelled) "
        "SELECT category, CAST(place AS INT) AS place, array_to_string(antecedent, ' + ') AS antecedent, array_to_string(consequent, ' + ') AS consequent, round(lift, 6) AS lift FROM placed WHERE place <= 3",
    "itemsets_by_prefix": f"{_PREFIXED} " + " UNION ALL ".join(
        f"SELECT array_to_string(items, ' + ') AS items, n, round(n / total, 6) AS support, '{kind}' AS kind FROM "
        f"(SELECT * FROM sets WHERE {_has('items', words)} ORDER BY n DESC, items LIMIT 5), tx_n"
        for kind, words in (("customer", vocab.CUSTOMER_ITEMS), ("operation", vocab.OPERATION_ITEMS))),
    "rules_by_prefix":
        f"{_PREFIXED}{_RULES} SELECT array_to_string(antecedent, ' + ') AS antecedent, array_to_string(consequent, ' + ') AS consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift "
        f"FROM (SELECT * FROM rules WHERE confidence >= 0.2 AND {_has('antecedent', vocab.SERVICE_ITEMS)} AND {_has('consequent', vocab.OUTCOME_ITEMS)} {_BY_LIFT} LIMIT 5)",
    "rule_edges":
        f"{_KEYED}{_RULES}, best AS (SELECT * FROM rules WHERE confidence >= 0.2 {_BY_LIFT} LIMIT 200), "
        "ends AS (SELECT lift, replace(a, '_', ' ') AS a, replace(c, '_', ' ') AS c FROM (SELECT lift, a, unnest(consequent) AS c FROM (SELECT lift, unnest(antecedent) AS a, consequent FROM best))) "
        "SELECT least(a, c) AS src, greatest(a, c) AS dst, round(min(lift), 6) AS weight FROM ends GROUP BY 1, 2",
    "itemset_matrix":
        f"{_KEYED}, best AS (SELECT items, CAST(row_number() OVER (ORDER BY n DESC, items) AS INT) AS place FROM sets ORDER BY n DESC, items LIMIT 20), "
        "names AS (SELECT DISTINCT unnest(items) AS item FROM best) "
        "SELECT place, replace(item, '_', ' ') AS item, CAST(list_contains(items, item) AS INT) AS held FROM best, names",
    "rule_summary":
        f"{_KEYED}{_RULES} SELECT CAST(total AS BIGINT) AS rows, (SELECT count(*) FROM sets) AS itemsets, "
        "(SELECT count(*) FROM rules WHERE confidence >= 0.65 AND lift >= 1.7) AS rules FROM tx_n",
    "write_rules": f"{_KEYED}{_RULES} SELECT {_SHOWN} FROM rules WHERE confidence >= 0.65 AND lift >= 1.7",
    "tfidf_terms":
        f"{_WORDS}, t AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM v) GROUP BY 1, 2), "
        "d AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1), "
        "x AS (SELECT doc_id, term, tf * idf AS raw FROM t JOIN d USING (term)) "
        "SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM x",
    "vocabulary_size": f"{_WORDS} SELECT count(*) AS themes FROM v",
}.items()}
