"""Shared building blocks of the catalogue: table access, the stay analogue on
the driver tables (``events`` sessions), the hourly panel, and their SQL
counterparts for the DuckDB oracle.

Analogue (driver tables carry no clinical data):
subject/admission = ``events.user_id``; stay = user session with a 24 h gap
(``user_id, session_no``); measurement label/value = ``event_type``/``value``;
outcome event = first ``error`` observation (with a value) of the stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.operators import grid, stays, windows
from stayline.sources.tables import nan_to_null

LABELS = ["click", "error", "purchase", "signup", "view"]
KEYS = ["user_id", "session_no"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table; NaN becomes NULL at ingest."""
    return nan_to_null(spark.read.parquet(f"{d}/{name}.parquet"))


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (sums/averages differ in the last bits
    between engines); the SQL side applies the same rounding."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded_sql(sql: str, cols, digits: int = 6) -> str:
    """Wrap oracle SQL so the listed double columns are rounded like ``finish``."""
    if not cols:
        return sql
    rep = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _r"


# ---------------------------------------------------------------- sessions
def sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return stays.sessionize(ev, "user_id", "ts", "ts", gap_hours=24, tiebreak=["event_id"])


SESS_SQL = """
sess AS (
  SELECT event_id, user_id, ts, event_type, value,
         CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no
  FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL THEN 1
                       WHEN ts - lag(ts) OVER w > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS brk
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) AS s0
)"""


def stay_table(spark: SparkSession, d: str, sess: DataFrame | None = None, sums: dict | None = None) -> DataFrame:
    """AG1 roll-up of the sessions: one row per stay.  ``sess``: sessions that a
    query also uses elsewhere; ``sums``: sums taken in the same pass."""
    s = sessions(spark, d) if sess is None else sess
    return stays.rollup_stays(s, KEYS, "ts", "ts", "event_type", LABELS, sums=sums)


def stay_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The stays of ``stay_table`` with their ends only, from one record per user and day."""
    ev = table(spark, d, "events").select("user_id", "ts")
    s = stays.sessionize(stays.daily_records(ev, "user_id", "ts"), "user_id", "first_at", "last_at", gap_hours=24)
    return stays.rollup_stays(s, KEYS, "first_at", "last_at")


def stay_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Stays with the sum of their values (``amount``), in one roll-up."""
    s = sessions(spark, d).withColumn("_amount", F.col("value").cast("decimal(18,2)"))
    st = stay_table(spark, d, s, sums={"amount": "_amount"})
    return st.withColumn("amount", F.col("amount").cast("double"))


ST_SQL = """
st AS (
  SELECT user_id, session_no, min(ts) AS intime, max(ts) AS outtime,
         """ + ",\n         ".join(
    f"coalesce(bool_or(event_type = '{L}'), false) AS {L}" for L in LABELS) + """
  FROM sess WHERE user_id IS NOT NULL AND session_no IS NOT NULL
  GROUP BY user_id, session_no
)"""
STAYS_SQL = SESS_SQL + "," + ST_SQL


# ---------------------------------------------------------------- panel
def panel(spark: SparkSession, d: str, sess: DataFrame | None = None) -> DataFrame:
    """Contiguous hourly panel of the sessions, one column per label."""
    return grid.hourly_grid(sessions(spark, d) if sess is None else sess, KEYS, "ts", "event_type", "value", LABELS)


GRID_SQL = """
g0 AS (
  SELECT user_id, session_no, date_trunc('hour', ts) AS hour, ts, event_type AS label,
         avg(value) AS v
  FROM sess WHERE value IS NOT NULL AND event_type IN (""" + ", ".join(f"'{L}'" for L in LABELS) + """)
  GROUP BY user_id, session_no, date_trunc('hour', ts), ts, event_type
),
g1 AS (
  SELECT user_id, session_no, hour,
         """ + ",\n         ".join(f"median(CASE WHEN label = '{L}' THEN v END) AS {L}" for L in LABELS) + """
  FROM g0 GROUP BY user_id, session_no, hour
),
gb AS (SELECT user_id, session_no, min(hour) AS lo, max(hour) AS hi FROM g1 GROUP BY user_id, session_no),
spine AS (SELECT user_id, session_no, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM gb),
panel AS (
  SELECT s.user_id, s.session_no, s.hour, """ + ", ".join(f"g1.{L}" for L in LABELS) + """
  FROM spine s LEFT JOIN g1 ON s.user_id = g1.user_id AND s.session_no = g1.session_no AND s.hour = g1.hour
)"""
PANEL_SQL = SESS_SQL + "," + GRID_SQL
PANEL_STAYS_SQL = SESS_SQL + "," + ST_SQL + "," + GRID_SQL


def outcome_times(spark: SparkSession, d: str) -> DataFrame:
    """Outcome event per stay: first ``error`` event of the session."""
    s = sessions(spark, d)
    return s.where((F.col("event_type") == "error") & F.col("value").isNotNull()) \
            .groupBy(*KEYS).agg(F.min("ts").alias("event_time"))


OUTCOME_SQL = """
oc AS (SELECT user_id, session_no, min(ts) AS event_time FROM sess
       WHERE event_type = 'error' AND value IS NOT NULL GROUP BY user_id, session_no)"""


def labelled_panel(spark: SparkSession, d: str, sess: DataFrame | None = None) -> DataFrame:
    """Panel + L1 horizon label (24 h), keyed like the reference panel.

    The outcome time (first ``error`` observation of the stay) comes out of the
    grid aggregate and a window over the stay - no second pass over events."""
    p = grid.hourly_grid(sessions(spark, d) if sess is None else sess, KEYS, "ts", "event_type", "value", LABELS,
                         first_times=["error"])
    # same partitioning and order as the panel windows, so all share one sort
    w = windows.spec(KEYS).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = p.withColumn("event_time", F.min("error_first_time").over(w)).drop("error_first_time")
    x = x.withColumn("label", windows.horizon_label("event_time", "hour", 24))
    return x.drop("event_time")


LABELLED_SQL = PANEL_SQL + "," + OUTCOME_SQL + """,
lp AS (
  SELECT p.*, coalesce(oc.event_time - p.hour <= INTERVAL 24 HOUR, false) AS label
  FROM panel p LEFT JOIN oc ON p.user_id = oc.user_id AND p.session_no = oc.session_no
)"""
