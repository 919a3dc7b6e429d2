"""Domain tables as fixed views of the test tables. The text is SQL that Spark and the checking engine both run, so a view is the same on either side."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_FIRST = "James,Mary,Robert,Patricia,Joseph,Jennifer,Michael,Linda,Philip,Clara,Vivian,Olivia"
_LAST = "Smith,Johnson,Schroeder,Bowen,Phelps,Olivier,Thornton,Keyes,Winslow,Garner,Rayburn"
_PEOPLE = f"""
SELECT CAST(c_custkey AS STRING) AS PersonKey, split_part('{_FIRST}', ',', CAST(1 + c_custkey % 12 AS INT)) AS FirstName,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE split_part('Lee,Ann,Ray,Lynn,Jo', ',', CAST(1 + c_custkey % 5 AS INT)) END AS MiddleName,
       split_part('{_LAST}', ',', CAST(1 + c_custkey % 11 AS INT)) AS LastName, CASE WHEN c_custkey % 7 = 0 THEN 'Jr' END AS Suffix,
       CASE WHEN c_custkey % 31 = 1 THEN NULL WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS Gender, c_mktsegment AS Ethnicity,
       DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INT) AS DOB, CAST(c_custkey % 80 AS INT) AS Age,
       '555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS Phone, '900-' || lpad(CAST(c_custkey % 97 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS SSN,
       'ADDR_' || CAST(c_custkey AS STRING) AS AddressKey, lpad(CAST(c_custkey * 7919 % 100000 AS STRING), 5, '0') AS ZipCode,
       CASE WHEN c_nationkey % 2 = 0 THEN 'HOUSE' ELSE 'APARTMENT' END AS ResidenceType
FROM {{customer}}
"""
_OBSERVED = """
SELECT {{side}} || '-' || lpad(PersonKey, 9, '0') || {{copy}} AS RecordKey, {{dataset}} AS DatasetId, PersonKey, FirstName,
       CASE WHEN CAST(PersonKey AS INT) % {{gap}} = 0 THEN NULL ELSE MiddleName END AS MiddleName,
       CASE WHEN CAST(PersonKey AS INT) % {{gap}} = 3 THEN upper(LastName) WHEN CAST(PersonKey AS INT) % {{gap}} = 4 THEN LastName || 'e' ELSE LastName END AS LastName,
       CASE WHEN CAST(PersonKey AS INT) % {{gap}} = 5 THEN DOB + 1 ELSE DOB END AS DOB, CASE WHEN CAST(PersonKey AS INT) % {{gap}} = 6 THEN NULL ELSE Phone END AS Phone,
       CASE WHEN CAST(PersonKey AS INT) % {{gap}} = 7 THEN NULL ELSE AddressKey END AS AddressKey, DATE '2026-01-01' AS SourceSnapshotDate
FROM {people} WHERE CAST(PersonKey AS INT) % 10 {{where}}
"""


def _observed(side: str, dataset: str, gap: int, where: str, copy: str = "") -> str:
    text = _OBSERVED.replace("{{side}}", f"'{side}'").replace("{{copy}}", f"'{copy}'").replace("{{dataset}}", f"'{dataset}'").replace("{{gap}}", str(gap))
    return text.replace("{{where}}", where)


VIEWS = {
    "records": """
SELECT CAST(o.o_orderkey AS STRING) AS RecordKey, CAST(o.o_custkey AS STRING) AS PersonKey,
       CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS STRING) AS EntityRecordIndex,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'AGE_0_17' WHEN '2-HIGH' THEN 'age_18_34' WHEN '3-MEDIUM' THEN 'AGE_35_64' WHEN '5-LOW' THEN 'age_65_plus' END AS AgeBin,
       CASE o.o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END AS Gender, c.c_mktsegment AS Ethnicity,
       CASE WHEN (c.c_nationkey + o.o_orderkey) % 2 = 0 THEN 'HOUSE' ELSE 'APARTMENT' END AS ResidenceType, 'ADDR_' || CAST(o.o_orderkey AS STRING) AS AddressKey,
       CASE WHEN o.o_orderkey % 5 = 0 THEN ' ' ELSE 'Street ' || CAST(o.o_orderkey % 90 AS STRING) END AS StreetName, CAST(o.o_orderkey % 400 AS STRING) AS HouseNumber
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
""",
    # records in the same order by person, with the day as the index, so that nothing is numbered; for what reads the order alone
    "dated_records": """
SELECT /*+ SHUFFLE_HASH(c) */ CAST(o.o_orderkey AS STRING) AS RecordKey, CAST(o.o_custkey AS STRING) AS PersonKey,
       CAST(year(o.o_orderdate) * 10000 + month(o.o_orderdate) * 100 + day(o.o_orderdate) AS STRING) AS EntityRecordIndex,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'AGE_0_17' WHEN '2-HIGH' THEN 'age_18_34' WHEN '3-MEDIUM' THEN 'AGE_35_64' WHEN '5-LOW' THEN 'age_65_plus' END AS AgeBin,
       CASE o.o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END AS Gender, c.c_mktsegment AS Ethnicity,
       CASE WHEN (c.c_nationkey + o.o_orderkey) % 2 = 0 THEN 'HOUSE' ELSE 'APARTMENT' END AS ResidenceType
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
""",
    "people": _PEOPLE,
    "residence": """
SELECT CAST(o_custkey AS STRING) AS PersonKey, 'ADDR_' || CAST(o_orderkey AS STRING) AS AddressKey, CAST(o_orderdate AS DATE) AS ResidenceStartDate,
       LEAD(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ResidenceEndDate
FROM {orders}
""",
    "residence_raw": """
SELECT CAST(o_custkey AS STRING) AS PersonKey, 'ADDR_' || CAST(o_orderkey AS STRING) AS AddressKey, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ResidenceStartDate,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN CAST(o_orderdate AS DATE) - 5 ELSE CAST(o_orderdate AS DATE) + 30 END AS ResidenceEndDate
FROM {orders}
""",
    "memberships": """
SELECT 'HH_' || CAST(l_suppkey AS STRING) AS HouseholdKey, CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS PersonKey, CAST(l_shipdate AS DATE) AS MembershipStartDate,
       CASE WHEN l_linenumber = 1 AND l_orderkey % 50 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + 30 END AS MembershipEndDate
FROM {lineitem}
""",
    "truth_events": """
SELECT 'EVT_' || lpad(CAST(event_id AS STRING), 7, '0') AS EventKey,
       CASE WHEN event_id % 97 = 0 THEN 'DEATH' WHEN event_id % 89 = 0 THEN 'PARTY' WHEN event_type = 'signup' THEN 'BIRTH' WHEN event_type = 'purchase' THEN 'move' WHEN event_type = 'click' THEN 'COHABIT' WHEN event_type = 'view' THEN 'LEAVE_HOME' ELSE 'DIVORCE' END AS EventType,
       CASE WHEN event_id % 71 = 0 THEN NULL ELSE DATE '1998-01-01' + CAST(event_id % 1000 AS INT) END AS EventDate,
       CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN CAST(user_id AS STRING) WHEN event_type = 'view' THEN CAST(user_id AS STRING) END AS SubjectPersonKey,
       CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 AND event_id % 17 <> 0 THEN 'HH_' || CAST(user_id % 10 AS STRING) END AS SubjectHouseholdKey,
       CASE WHEN event_type = 'purchase' THEN 'ADDR_' || CAST(event_id % 13 AS STRING) END AS FromAddressKey, CASE WHEN event_type = 'purchase' AND event_id % 19 <> 0 THEN 'ADDR_' || CAST(event_id % 11 AS STRING) END AS ToAddressKey,
       CASE WHEN event_type IN ('click', 'error') THEN CAST(user_id AS STRING) END AS PersonKeyA, CASE WHEN event_type IN ('click', 'error') THEN CAST((user_id * 7 + event_id) % 150 AS STRING) END AS PersonKeyB,
       CASE WHEN event_type = 'click' AND event_id % 17 <> 0 THEN 'HH_' || CAST(event_id AS STRING) END AS NewHouseholdKey, CASE WHEN event_type = 'click' THEN split_part('move_to_A,move_to_B,new_address,elsewhere', ',', CAST(1 + event_id % 4 AS INT)) END AS CohabitMode,
       CASE WHEN event_type IN ('signup', 'view') AND event_id % 23 <> 0 THEN CAST((user_id + event_id) % 150 AS STRING) END AS ChildPersonKey, CASE WHEN event_type = 'signup' THEN CAST(user_id AS STRING) END AS Parent1PersonKey,
       CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN CAST(user_id - user_id % 2 AS STRING) END AS Parent2PersonKey, CASE WHEN event_type = 'error' THEN split_part('joint,split,parent_a_primary,sometimes', ',', CAST(1 + event_id % 4 AS INT)) END AS CustodyMode
FROM {events}
""",
    "record_map": """
SELECT CAST(user_id AS STRING) AS PersonKey, event_type AS DatasetId, event_type || '-' || CAST(event_id - event_id % 40 AS STRING) AS RecordKey
FROM {events} WHERE NOT (event_type = 'view' AND user_id % 3 = 0) AND NOT (event_type = 'error' AND user_id % 4 < 2)
""",
    "cohorts": """
SELECT split_part('age_0_17,age_18_24,age_25_34,age_35_64', ',', CAST(1 + c_nationkey % 4 AS INT)) AS age_cohort_id, avg(CAST(c_custkey % 40 AS DOUBLE)) AS moved_past_year_pct, count(*) AS population
FROM {customer} WHERE c_custkey % 11 <> 0 GROUP BY 1
""",
    "mobility_lines": """
SELECT CAST(2 + c_custkey % 17 AS INT) AS line, count(*) AS value FROM {customer} GROUP BY 1
UNION ALL SELECT CAST(18 + c_custkey % 15 AS INT), count(*) FROM {customer} WHERE c_custkey % 17 < 15 AND c_nationkey % 3 = 0 GROUP BY 1
""",
    "household_types": """
SELECT c_mktsegment AS household_type_id, count(*) AS household_count FROM {customer} WHERE c_nationkey % 4 <> 1 GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM {customer}
""",
    "demographics": """
SELECT CASE WHEN c_nationkey % 7 = 0 THEN 'Elsewhere' ELSE split_part('White (Non-Hispanic),Hispanic / Latino,Black / African American,Asian,Multiracial / Other', ',', CAST(1 + c_custkey % 5 AS INT)) END AS label,
       CASE WHEN c_nationkey % 2 = 0 THEN 'about ' || CAST(count(*) AS STRING) || '.5%' WHEN c_nationkey % 3 = 0 THEN ' ' || CAST(count(*) AS STRING) || ' % ' ELSE CAST(count(*) AS STRING) END AS value
FROM {customer} GROUP BY 1, c_nationkey
""",
    "age_labels": """
SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + p_partkey % 9 AS STRING) WHEN p_partkey % 5 = 1 THEN CAST(p_size AS STRING) || '+'
       WHEN p_partkey % 5 = 2 THEN 'under ' || CAST(p_size AS STRING) WHEN p_partkey % 5 = 3 THEN 'about ' || CAST(p_size AS STRING) || ' - ' || CAST(p_size + p_partkey % 9 AS STRING) || ' years' ELSE 'unknown' END AS label,
       CASE WHEN p_partkey % 5 < 4 THEN p_size END AS low, CASE WHEN p_partkey % 5 IN (0, 3) THEN CAST(p_size + p_partkey % 9 AS INT) WHEN p_partkey % 5 < 4 THEN 95 END AS high
FROM {part}
""",
    "observed_a": _observed("A", "dataset_a", 97, "< 8"),
    "observed_b": _observed("B", "dataset_b", 23, ">= 2") + " UNION ALL " + _observed("B", "dataset_b", 11, "IN (2, 5, 9)", "-2"),
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """The test tables of a folder and the views of them, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        return self.spark.sql(text, **{n: self[n] for n in _needs(text)})


def with_views(sql: str) -> str:
    """SQL for the checking engine, with the views that it names in braces defined before it."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not head:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def unit_sql(seed: int, salt: str, key: str) -> str:
    return f"(CAST('0x' || substr(sha256(concat_ws('|', '{seed}', '{salt}', CAST({key} AS VARCHAR))), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE)"


def int_sql(seed: int, salt: str, modulus: int | str, key: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256(concat_ws('|', '{seed}', '{salt}', CAST({key} AS VARCHAR))), 1, 16) AS UBIGINT) % CAST({modulus} AS UBIGINT) AS BIGINT)"
