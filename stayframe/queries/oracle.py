"""SQL fragments for DuckDB: the derived listings, the cleaned tables, the logs."""

from __future__ import annotations

from collections.abc import Sequence

from stayframe.plans.cleaning import SCORE_COLUMNS
from stayframe.sources.listings import LISTINGS_SCHEMA, REVIEW_PARTS

LISTINGS = """
SELECT
  k AS id,
  CASE WHEN k % 10 = 0 THEN NULL ELSE b END AS bedrooms,
  CASE WHEN k % 13 = 0 THEN NULL ELSE b + k % 2 END AS beds,
  1 + k % 30 AS minimum_nights,
  CASE WHEN c % 9 = 0 THEN 0 ELSE (c * 7) % 366 END AS availability_365,
  CASE WHEN k % 97 = 0 THEN NULL
       WHEN cents < 100000 THEN '$' || CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0')
       ELSE '$' || CAST(CAST(floor(cents / 100000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0')
            || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0') END AS price,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 23 = 0 THEN 'N/A' ELSE CAST(50 + k % 51 AS STRING) || '%' END AS host_response_rate,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(40 + c % 61 AS STRING) || '%' END AS host_acceptance_rate,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 4 = 0 THEN 'within an hour' WHEN k % 4 = 1 THEN 'within a few hours'
       WHEN k % 4 = 2 THEN 'within a day' ELSE 'a few days or more' END AS host_response_time,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(300 + (k * 31) % 201 AS DOUBLE) / 100 END AS review_scores_rating,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(300 + (k * 37) % 201 AS DOUBLE) / 100 END AS review_scores_accuracy,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(300 + (k * 41) % 201 AS DOUBLE) / 100 END AS review_scores_cleanliness,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(300 + (k * 43) % 201 AS DOUBLE) / 100 END AS review_scores_checkin,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(300 + (k * 47) % 201 AS DOUBLE) / 100 END AS review_scores_communication,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(300 + (k * 53) % 201 AS DOUBLE) / 100 END AS review_scores_location,
  CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(300 + (k * 59) % 201 AS DOUBLE) / 100 END AS review_scores_value,
  CAST(377000 + (c * 13) % 1000 AS DOUBLE) / 10000 AS latitude,
  CAST(-1225000 + (c * 17) % 1200 AS DOUBLE) / 10000 AS longitude
FROM (
  SELECT o_orderkey AS k, o_custkey AS c, 1 + o_custkey % 4 AS b,
         5000 + CAST(round(o_totalprice * 100) AS BIGINT) % 70000 + 15000 * (1 + o_custkey % 4) AS cents
  FROM orders
) t
"""

DOLLARS = "TRY_CAST(replace(price, '$', '') AS DOUBLE)"
DOLLARS_AND_COMMAS = "TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE)"
FRESH = "CAST((id * 7919) % 1000 AS DOUBLE) / 2000 - CAST(1 AS DOUBLE) / 4"
BUCKET = "((((id % 2147483648) * 2654435761) % 4294967296) % 100)"
ALL_COLUMNS = LISTINGS_SCHEMA.names


def rate(column: str) -> str:
    return f"TRY_CAST(replace({column}, '%', '') AS DOUBLE) / 100"


_RATES = f"{rate('host_response_rate')} AS host_response_rate, {rate('host_acceptance_rate')} AS host_acceptance_rate"
_SCORES = ", ".join(SCORE_COLUMNS)
_PART_SUM = " + ".join(REVIEW_PARTS)
_TYPED = f"SELECT id, {_RATES}, bedrooms, {_SCORES}, latitude, longitude, {DOLLARS} AS price FROM listings"
_SUMMED = (
    f"SELECT id, {_RATES}, bedrooms, review_scores_rating, latitude, longitude, "
    f"{DOLLARS_AND_COMMAS} AS price, {_PART_SUM} AS review_scores_sum FROM listings"
)


def complete(columns: Sequence[str]) -> str:
    return " AND ".join(f"{name} IS NOT NULL" for name in columns)


_TYPED_COLUMNS = ["host_response_rate", "host_acceptance_rate", "bedrooms", *SCORE_COLUMNS, "price"]
_SUMMED_COLUMNS = [
    "host_response_rate", "host_acceptance_rate", "bedrooms", "review_scores_rating", "price", "review_scores_sum",
]

# Views by name; each may use the ones before it.
VIEWS = {
    "listings": LISTINGS,
    "etl": f"""SELECT id, bedrooms, minimum_nights, availability_365, {DOLLARS} AS price FROM listings
        WHERE minimum_nights < 14 AND availability_365 > 0
          AND {complete(["id", "bedrooms", "minimum_nights", "availability_365", "price"])}""",
    "cleaned": f"SELECT * FROM ({_TYPED}) WHERE {complete(_TYPED_COLUMNS)}",
    "features": "SELECT * EXCLUDE (price) FROM cleaned",
    "spine": f"SELECT id, price, {FRESH} AS score_diff_to_last_month FROM cleaned",
    "training": "SELECT s.*, f.* EXCLUDE (id) FROM spine s LEFT JOIN features f USING (id)",
    "tracking": f"SELECT * FROM ({_SUMMED}) WHERE {complete(_SUMMED_COLUMNS)}",
    "linear": f"SELECT id, CAST(bedrooms AS DOUBLE) AS bedrooms, {DOLLARS} AS price FROM listings",
    "filled": """SELECT id, coalesce(bedrooms, avg(bedrooms) OVER ()) AS bedrooms,
        coalesce(price, avg(price) OVER ()) AS price FROM linear""",
    "split_rows": f"SELECT *, CASE WHEN {BUCKET} < 80 THEN 'train' ELSE 'test' END AS split FROM filled",
    "coefficients": """SELECT regr_slope(price, bedrooms) AS slope, regr_intercept(price, bedrooms) AS intercept,
        regr_r2(price, bedrooms) AS r2 FROM split_rows WHERE split = 'train'""",
    "predicted": """SELECT id, split, price, bedrooms, intercept + slope * bedrooms AS prediction
        FROM split_rows, coefficients""",
    # Least squares with two inputs, in closed form, on the training part of the training set.
    "moments": f"""SELECT avg(bedrooms) AS mx, avg(score_diff_to_last_month) AS mz, avg(price) AS my,
        var_pop(bedrooms) AS xx, var_pop(score_diff_to_last_month) AS zz,
        covar_pop(bedrooms, score_diff_to_last_month) AS xz, covar_pop(bedrooms, price) AS xy,
        covar_pop(score_diff_to_last_month, price) AS zy FROM training WHERE {BUCKET} < 80""",
    "plane": """SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz,
        mx, mz, my FROM moments""",
    "run_log": """SELECT user_id AS experiment_id,
        CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
        event_type AS metric, value, ts, event_id FROM events""",
    "latest_values": """SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY run_id, metric ORDER BY ts DESC, event_id DESC) AS rn FROM run_log) WHERE rn = 1""",
    "runs": """SELECT l.experiment_id, l.run_id, min(s.start_time) AS start_time,
        max(CASE WHEN metric = 'click' THEN value END) AS click, max(CASE WHEN metric = 'error' THEN value END) AS error,
        max(CASE WHEN metric = 'purchase' THEN value END) AS purchase,
        max(CASE WHEN metric = 'signup' THEN value END) AS signup, max(CASE WHEN metric = 'view' THEN value END) AS view
        FROM latest_values l JOIN (SELECT run_id, min(ts) AS start_time FROM run_log GROUP BY run_id) s USING (run_id)
        GROUP BY l.experiment_id, l.run_id""",
    "version_log": """SELECT user_id % 10 AS model, user_id AS version_key, ts, event_id,
        CASE event_type WHEN 'view' THEN 'Staging' WHEN 'purchase' THEN 'Production'
                        WHEN 'error' THEN 'Archived' ELSE 'None' END AS stage,
        event_id % 2 = 0 AS archive_existing, CASE WHEN event_id % 5 = 0 THEN props END AS description
        FROM events WHERE event_type <> 'click'""",
    "last_change": """SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY model, version_key ORDER BY ts DESC, event_id DESC) AS rn FROM version_log) WHERE rn = 1""",
    "numbered": """SELECT model, version_key, CAST(row_number() OVER (PARTITION BY model ORDER BY first_ts, version_key)
        AS BIGINT) AS version, first_ts
        FROM (SELECT model, version_key, min(ts) AS first_ts FROM version_log GROUP BY model, version_key)""",
    "archived": """SELECT c.model, c.version_key, CASE WHEN c.stage IN ('Staging', 'Production') AND EXISTS (
        SELECT 1 FROM version_log a WHERE a.model = c.model AND a.stage = c.stage AND a.archive_existing
          AND (a.ts > c.ts OR (a.ts = c.ts AND a.event_id > c.event_id))) THEN 'Archived' ELSE c.stage END AS stage
        FROM last_change c""",
    "ended": """SELECT model FROM version_log GROUP BY model
        HAVING count(*) FILTER (WHERE stage = 'Archived') > count(*) FILTER (WHERE stage = 'Production')""",
}


def over(last: str, sql: str) -> str:
    """A statement with the views up to ``last`` that it or another view mentions."""
    names = list(VIEWS)[: list(VIEWS).index(last) + 1]
    needed, text = [], sql
    for name in reversed(names):
        if name in text:
            needed.append(name)
            text += VIEWS[name]
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in reversed(needed)) + "\n" + sql
