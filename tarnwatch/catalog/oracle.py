"""Composable DuckDB SQL: named CTEs, pulled into a statement by the names its text mentions."""

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(f"CTE {name} defined twice")
    CTES[name] = sql.strip()


def _mentioned(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", sql)) if n in CTES]


def oracle(sql: str) -> str:
    """The statement with every CTE it needs, in dependency order."""
    order: list[str] = []

    def visit(text, path=()):
        for name in _mentioned(text):
            if name in path or name in order:
                continue
            visit(CTES[name], (*path, name))
            order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    recursive = "RECURSIVE " if any("recursive_step" in CTES[n] for n in order) else ""
    parts = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    return f"WITH {recursive}{parts}\n{sql.strip()}"


def r9(expr: str) -> str:
    return f"(round({expr}, 9) + 0.0)"


cte("ev", """
SELECT *, CAST(round(value * 100) AS BIGINT) AS v,
       CAST(datediff('day', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS d, hour(ts) AS h
FROM events""")

cte("readings", """
SELECT 'st' || (user_id % 4) AS station_id, ts AS "timestamp", event_id AS src_ord,
       15 + (v % 2000) / 100.0::DOUBLE AS temperature, 6 + ((7 * v) % 350) / 100.0::DOUBLE AS ph,
       (v % 6000) / 100.0::DOUBLE AS turbidity,
       CASE WHEN event_type <> 'error' THEN ((13 * v) % 1400) / 100.0::DOUBLE END AS dissolved_oxygen
FROM ev WHERE event_type <> 'signup'""")

cte("dense_base", """
SELECT *, abs(12 - h) AS tri, CASE WHEN d % 9 = 4 AND h BETWEEN 8 AND 13 THEN 1 ELSE 0 END AS pollution,
  CASE WHEN (h + 18) % 24 <= 10 THEN 35 * ((h + 18) % 24) ELSE (24 - (h + 18) % 24) * (24 - (h + 18) % 24) * 350 // 196 END AS daylight FROM ev""")

cte("dense", """
SELECT CASE WHEN user_id % 8 < 7 THEN 'st0' ELSE 'st1' END AS station_id, ts AS "timestamp", event_id AS src_ord,
  (CASE WHEN d % 4 = 1 AND h BETWEEN 6 AND 15 THEN 2150 WHEN event_id % 97 = 0 THEN 3900 + v % 40
        ELSE 2400 - 30 * tri + v % 40 END) / 100.0::DOUBLE AS temperature,
  (CASE WHEN event_id % 211 = 0 THEN 1500 ELSE 780 - 6 * tri + (7 * v) % 20 + 60 * pollution END) / 100.0::DOUBLE AS ph,
  (500 + v % 60 + 3000 * pollution) / 100.0::DOUBLE AS turbidity,
  CASE WHEN event_type <> 'error'
       THEN (550 + daylight + (13 * v) % 30 - 450 * pollution - 40 * greatest(d % 10 - 5, 0)) / 100.0::DOUBLE END
    AS dissolved_oxygen
FROM dense_base""")

cte("weather_sums", """
SELECT date_trunc('hour', ts) AS hr, CAST(sum(v) AS BIGINT) AS s1, CAST(sum(3 * v) AS BIGINT) AS s3,
       CAST(sum(5 * v) AS BIGINT) AS s5, CAST(sum(7 * v) AS BIGINT) AS s7, CAST(sum(11 * v) AS BIGINT) AS s11
FROM ev GROUP BY 1""")

cte("weather", """
SELECT hr AS "timestamp", 15 + (s3 % 2000) / 100.0::DOUBLE AS air_temperature, (s1 % 101) / 100.0::DOUBLE AS cloud_cover,
       greatest(s1 % 1000 - 700, 0) / 100.0::DOUBLE AS rain_mm, 1 + (s7 % 900) / 100.0::DOUBLE AS wind_speed,
       (20 + s11 % 80)::DOUBLE AS relative_humidity, (100 + s5 % 2400)::DOUBLE AS boundary_layer_height
FROM weather_sums""")

cte("weather_gappy", """
SELECT * EXCLUDE (hno) FROM (SELECT *, CAST(epoch("timestamp") AS BIGINT) // 3600 AS hno FROM weather)
WHERE NOT (hno % 37 IN (5, 6)) AND NOT (hno % 53 BETWEEN 10 AND 15)""")

cte("lab", """
SELECT 'st' || (user_id % 4) AS station_id, ts AS "timestamp", event_id AS src_ord,
  CASE WHEN v % 10 = 0 THEN '<1' WHEN v % 17 = 0 THEN 'n/a' ELSE CAST(1 + v % 9 AS VARCHAR) END AS bod,
  (250 + v % 900)::DOUBLE AS conductivity, ((3 * v) % 4000) / 100.0::DOUBLE AS nitrate,
  CASE WHEN v % 11 = 0 THEN '<0.5' ELSE CAST(1 + v % 60 AS VARCHAR) END AS chlorophyll_a,
  CASE WHEN v % 13 = 0 THEN '<2' ELSE CAST(10 + (v * v) % 9000 AS VARCHAR) END AS total_coliform
FROM ev WHERE event_type = 'signup'""")

cte("air", """
SELECT 'air' || (user_id % 2) AS station_id, ts AS "timestamp", event_id AS src_ord,
  (v % 600) / 10.0::DOUBLE AS pm1,
  (CASE WHEN d % 5 = 3 AND h = 12 THEN 9000 + v % 100 WHEN d % 10 < 4 THEN 900 + v % 1500 ELSE v % 1500 END) / 10.0::DOUBLE AS pm25,
  (v % 3000) / 10.0::DOUBLE AS pm10, (v % 4000) / 10.0::DOUBLE AS tsp,
  (CASE WHEN d % 6 = 2 AND h BETWEEN 3 AND 15 THEN 50 ELSE (3 * v) % 120 END) / 1000.0::DOUBLE AS o3,
  (v % 101) / 1000.0::DOUBLE AS no2, ((7 * v) % 400) / 100.0::DOUBLE AS co,
  (CASE WHEN d % 7 = 1 AND h < 3 THEN -40 ELSE (5 * v) % 60 - 5 END) / 1000.0::DOUBLE AS so2
FROM ev WHERE NOT (d % 11 = 5 AND h BETWEEN 2 AND 8)""")

cte("episodes", """
SELECT event_id AS ep, 'st' || (user_id % 4) AS station_id,
  CASE event_id % 3 WHEN 0 THEN 'spike' WHEN 1 THEN 'offset' ELSE 'event' END AS kind,
  CASE WHEN event_id % 3 = 2 THEN '' WHEN event_id % 2 = 0 THEN 'ph' ELSE 'dissolved_oxygen' END AS sensor,
  ts AS "start", ts + INTERVAL 6 HOUR AS "end"
FROM ev WHERE event_type = 'purchase' AND event_id % 5 = 0""")
