"""The labelled table from its definitions, as one Spark SQL text: row-level statistics, a range
join per line. It is the yardstick that ``bench.py`` times the library's plan against; both give
the same rows."""

TABLES = ("fact", "gps_customer", "gps_distributor", "day_off")

LABELLED = """
WITH located AS (
  SELECT f.*, c.latitude AS gps_cus_latitude, c.longitude AS gps_cus_longitude,
         d.latitude AS gps_dist_latitude, d.longitude AS gps_dist_longitude
  FROM fact f LEFT JOIN gps_customer c ON c.customerid = f.customer_code
              LEFT JOIN gps_distributor d ON d.customerid = f.distributor_code),
measured AS (
  SELECT *, pow(sin(radians(gps_dist_latitude - gps_cus_latitude) / 2), 2) + cos(radians(gps_cus_latitude))
            * cos(radians(gps_dist_latitude)) * pow(sin(radians(gps_dist_longitude - gps_cus_longitude) / 2), 2) AS chord
  FROM located),
distances AS (
  SELECT * EXCEPT (chord), 2 * 6371 * asin(sqrt(CASE WHEN chord > 1 THEN 1 ELSE chord END)) AS distance_km FROM measured),
middle AS (
  SELECT percentile(distance_km, 0.5) AS median FROM distances
  WHERE gps_cus_latitude IS NOT NULL AND gps_cus_longitude IS NOT NULL
    AND gps_dist_latitude <> 0 AND gps_dist_longitude <> 0),
filled AS (
  SELECT * EXCEPT (distance_km, median),
         CASE WHEN 0 IN (gps_cus_latitude, gps_cus_longitude, gps_dist_latitude, gps_dist_longitude)
                OR distance_km IS NULL THEN median ELSE distance_km END AS distance_km
  FROM distances CROSS JOIN middle),
quarters AS (SELECT percentile(distance_km, array(0.25, 0.75)) AS q FROM filled),
kept AS (
  SELECT * EXCEPT (q) FROM filled CROSS JOIN quarters
  WHERE distance_km BETWEEN q[0] - 2 * (q[1] - q[0]) AND q[1] + 2 * (q[1] - q[0])),
ranges AS (SELECT DISTINCT order_date, settlement_date FROM kept),
counted AS (
  SELECT r.order_date AS od, r.settlement_date AS sd, count(DISTINCT o.d_date) AS off
  FROM ranges r LEFT JOIN day_off o ON o.d_date BETWEEN r.order_date AND r.settlement_date GROUP BY 1, 2),
timed AS (
  SELECT k.*, CAST(datediff(settlement_date, order_date) AS DOUBLE) AS delivery_day,
         CAST(CASE WHEN order_no IS NULL OR customer_code IS NULL OR settlement_date IS NULL THEN 0
                   ELSE coalesce(off, 0) END AS DOUBLE) AS days_off_count
  FROM kept k LEFT JOIN counted c ON c.od = k.order_date AND c.sd <=> k.settlement_date),
worked AS (
  SELECT *, CASE WHEN delivery_day - days_off_count < 0 THEN 0 ELSE delivery_day - days_off_count END AS day_processing
  FROM timed)
SELECT *, CASE WHEN day_processing <= 2 THEN 1.0D ELSE 0.0D END AS ontime,
       CASE WHEN diff_ec <= 0.1D THEN 1.0D ELSE 0.0D END AS infull,
       CASE WHEN day_processing <= 2 AND diff_ec <= 0.1D THEN 1.0D ELSE 0.0D END AS difot
FROM worked
"""


def labelled(inp):
    """The baseline over the inputs of a run."""
    for name in TABLES:
        getattr(inp, name).createOrReplaceTempView(name)
    return inp.fact.sparkSession.sql(LABELLED)
