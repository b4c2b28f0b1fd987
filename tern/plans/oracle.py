"""DuckDB oracle statements for the registered queries.

Written independently of the Spark code: plain joins, windows and QUALIFY
where the Spark side uses rewrites (aggregate instead of window, grid join
instead of all pairs).  Derivation constants repeat ``tern.plans.derived``.
"""

VARIANT_EXTRACT = """
SELECT event_id, event_type,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(json_extract_string(props, '$.missing') AS INTEGER) AS k_missing,
       json_extract_string(props, '$.k') AS k_text
FROM events
"""

# customer_orders: the JSON orders are lineitem x orders; the join to
# customers is on o_custkey.
_CO = """
SELECT o.o_custkey AS customer_id, c.c_name AS customer_name, l.l_orderkey AS order_id,
       l.l_partkey AS product_id, CAST(CAST(l.l_quantity AS INTEGER) AS BIGINT) AS quantity,
       CAST(l.l_extendedprice AS DECIMAL(10,2)) AS order_total,
       CAST(o.o_orderdate AS DATE) AS purchase_date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
"""

_PROD = """
SELECT p_partkey AS product_id, p_name AS product_name,
       CAST(500 + p_partkey % 501 AS DECIMAL(10,2)) AS stock
FROM part
"""

CUSTOMER_ORDERS = _CO

_SR = f"""
WITH co AS ({_CO}),
j AS (SELECT co.*, p.p_name AS product_name FROM co JOIN part p ON co.product_id = p.p_partkey)
SELECT customer_id, customer_name, order_id, product_id, product_name, order_total, quantity,
       CAST(CAST(order_total AS DECIMAL(18,6)) / CAST(quantity AS DECIMAL(18,6)) AS DECIMAL(18,8)) AS unitsalesprice,
       purchase_date,
       CAST(date_diff('day',
            lag(purchase_date) OVER (PARTITION BY customer_id
                                     ORDER BY purchase_date NULLS FIRST, order_id NULLS FIRST,
                                              product_id NULLS FIRST, quantity NULLS FIRST,
                                              order_total NULLS FIRST),
            purchase_date) AS INTEGER) AS days_since_last_purchase,
       CAST(customer_id AS VARCHAR) || '-' || CAST(product_id AS VARCHAR) || '-'
         || strftime(purchase_date, '%Y-%m-%d') AS customer_sk
FROM j
"""

SALES_REPORT = _SR

CUMULATIVE_PURCHASES = f"""
WITH sr AS ({_SR})
SELECT customer_id, customer_name,
       CAST(sum(order_total) AS DECIMAL(38,2)) AS total_sales,
       count(customer_sk) AS total_orders,
       count(DISTINCT product_id) AS distinct_products
FROM sr
WHERE CAST(purchase_date AS TIMESTAMP) >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 6 MONTH
GROUP BY customer_id, customer_name
"""

TOP_CUSTOMERS = f"""
WITH cp AS ({CUMULATIVE_PURCHASES})
SELECT customer_name, total_sales, total_orders, distinct_products
FROM cp ORDER BY total_sales DESC, customer_id LIMIT 15
"""

INVENTORY_ALERT = f"""
WITH sr AS ({_SR}), prod AS ({_PROD}),
a AS (
  SELECT s.product_id, s.product_name, s.purchase_date AS latest_sales_date,
         p.stock AS begining_stock,
         sum(s.quantity) OVER (PARTITION BY s.product_id ORDER BY s.purchase_date) AS totalunitsold
  FROM sr s JOIN prod p ON s.product_id = p.product_id
  QUALIFY row_number() OVER (PARTITION BY s.product_id ORDER BY s.purchase_date DESC) = 1
)
SELECT product_id, product_name, latest_sales_date, begining_stock,
       CAST(totalunitsold AS BIGINT) AS totalunitsold,
       CAST(begining_stock - totalunitsold AS DECIMAL(38,2)) AS unitsleft,
       CAST(round(100.0 * (begining_stock - totalunitsold) / begining_stock, 2) AS DECIMAL(18,2)) AS percent_unitleft
FROM a
"""

RUNNING_UNITS = f"""
WITH sr AS ({_SR})
SELECT DISTINCT product_id, purchase_date,
       CAST(sum(quantity) OVER (PARTITION BY product_id ORDER BY purchase_date NULLS FIRST) AS BIGINT) AS totalunitsold
FROM sr
"""

RUNNING_UNITS_BY_SALE = f"""
WITH sr AS ({_SR})
SELECT product_id, customer_id, order_id, purchase_date, quantity,
       CAST(sum(quantity) OVER (PARTITION BY product_id ORDER BY purchase_date NULLS FIRST) AS BIGINT) AS totalunitsold
FROM sr
"""

# Three moments, one of them at noon; the bound moves forward, then back.
AS_OF_DATES = ("2001-08-01 00:00:00", "2001-11-15 12:00:00", "2000-02-29 00:00:00")

CUMULATIVE_AS_OF_DATES = " UNION ALL ".join(
    f"SELECT *, '{at}' AS as_of FROM ({CUMULATIVE_PURCHASES.replace('2001-08-01 00:00:00', at)})" for at in AS_OF_DATES
)

LATEST_SALES = f"""
WITH sr AS ({_SR})
SELECT product_id, purchase_date, order_id, customer_id, quantity, order_total FROM sr
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY purchase_date DESC NULLS LAST, order_id DESC, customer_id DESC,
                           quantity DESC, order_total DESC) = 1
"""

LOW_STOCK = f"""
WITH al AS ({INVENTORY_ALERT})
SELECT * FROM al WHERE percent_unitleft < 10 ORDER BY unitsleft, product_id
"""


# --------------------------------------------------------------------------
# Highways, cities and weather, rebuilt from the driver tables with the
# derivation rules of tern.plans.derived (all literals DOUBLE, as in Spark).
# --------------------------------------------------------------------------

def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _city_lat(u):
    return f"({_d(25.0)} + ({u} % 40) * {_d(0.6)} + (({u} * 37) % 100) / {_d(1000.0)})"


def _city_lon(u):
    return f"({_d(-125.0)} + (({u} // 40) % 500) * {_d(0.6)} + (({u} * 53) % 100) / {_d(1000.0)})"


def _city_name(u):
    return f"('city_' || CAST(CASE WHEN {u} % 50 = 49 THEN {u} - 1 ELSE {u} END AS VARCHAR))"


_LINES = f"""
cb AS (SELECT c_custkey AS c, c_nationkey AS nk, c_custkey // 10 AS u FROM customer),
ln AS (
  SELECT c, nk,
    CASE WHEN c % 10 IN (0, 5) THEN {_city_lat('u')} ELSE {_city_lat('u')} + ((c * 7919) % 401 - 200) / {_d(1000.0)} END AS lat0,
    CASE WHEN c % 10 IN (0, 5) THEN {_city_lon('u')} ELSE {_city_lon('u')} + ((c * 104729) % 401 - 200) / {_d(1000.0)} END AS lon0,
    CASE WHEN c % 97 = 50 THEN 2 ELSE 2 + c % 39 END AS npts,
    ((c * 31) % 21 - 10) / {_d(2000.0)} AS dlat,
    ((c * 17) % 21 - 10) / {_d(2000.0)} AS dlon,
    c % 101 = 100 AS geom_null,
    c % 7 = 3 AS multi
  FROM cb WHERE c % 23 <> 0
),
feat AS (
  SELECT c // 8 AS doc_id, CAST(row_number() OVER (PARTITION BY c // 8 ORDER BY c) - 1 AS INTEGER) AS pos, c,
    CAST(c // 8 AS VARCHAR) || ':' || CAST(row_number() OVER (PARTITION BY c // 8 ORDER BY c) - 1 AS VARCHAR) AS fid,
    CAST(CASE WHEN c % 11 = 10 THEN c - 1 ELSE c END AS INTEGER) AS object_id,
    'nhs_' || CAST(nk AS VARCHAR) || '.geojson' AS file_name,
    CAST(CAST(c % 500 AS DECIMAL(18,2)) / 100 AS DECIMAL(38,2)) AS miles,
    CAST((c * 97) % 200000 AS INTEGER) AS average_annual_daily_traffic,
    CAST(CASE WHEN c % 13 = 0 THEN 0 ELSE 25 + (c % 9) * 5 END AS INTEGER) AS speed_limit,
    CAST(CASE WHEN c % 17 = 0 THEN NULL ELSE 2010 + c % 12 END AS INTEGER) AS year,
    'I' || CAST(c % 99 + 1 AS VARCHAR) AS sign1,
    CASE WHEN geom_null THEN NULL WHEN multi THEN 'MultiLineString' ELSE 'LineString' END AS geom_type,
    npts, lat0, lon0, dlat, dlon, geom_null, multi
  FROM ln
),
vk AS (SELECT fid, object_id, lat0, lon0, dlat, dlon, c, unnest(range(npts)) AS k
       FROM feat WHERE NOT geom_null),
vx AS (
  SELECT fid, object_id, 0 AS part, k,
         CASE WHEN c % 194 = 50 THEN CASE k WHEN 0 THEN {_d(179.9)} ELSE {_d(-179.9)} END
              WHEN c % 194 = 147 THEN CASE k WHEN 0 THEN {_d(-20.0)} + (c % 10) / {_d(2.0)} ELSE {_d(20.0)} - ((c * 3) % 10) / {_d(2.0)} END
              ELSE lon0 + k * dlon + ((k * c * 3) % 5) / {_d(10000.0)} END AS lon,
         CASE WHEN c % 194 = 50 THEN CASE k WHEN 0 THEN {_d(10.0)} + (c % 40) / {_d(100.0)} ELSE {_d(10.2)} + ((c * 7) % 40) / {_d(100.0)} END
              WHEN c % 194 = 147 THEN CASE k WHEN 0 THEN {_d(55.0)} ELSE {_d(55.0)} + (c % 3) / {_d(5.0)} END
              ELSE lat0 + k * dlat + ((k * c) % 7) / {_d(10000.0)} END AS lat
  FROM vk
  UNION ALL
  SELECT fid, object_id, 1, 0, lon0 + {_d(0.01)}, lat0 - {_d(0.01)} FROM feat WHERE multi AND NOT geom_null
  UNION ALL
  SELECT fid, object_id, 1, 1, lon0 + {_d(0.02)}, lat0 + {_d(0.005)} FROM feat WHERE multi AND NOT geom_null
),
vv AS (
  SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y,
         sin(radians(lat)) AS z FROM vx
),
e0 AS (
  SELECT a.fid, a.object_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz,
         least(a.lat, b.lat) AS lat_lo, greatest(a.lat, b.lat) AS lat_hi,
         least(a.lon, b.lon) AS lon_lo, greatest(a.lon, b.lon) AS lon_hi
  FROM vv a JOIN vv b ON a.fid = b.fid AND a.part = b.part AND b.k = a.k + 1
),
e1 AS (SELECT *, ay * bz - az * b_y AS nx0, az * bx - ax * bz AS ny0, ax * b_y - ay * bx AS nz0 FROM e0),
e2 AS (SELECT *, sqrt(nx0 * nx0 + ny0 * ny0 + nz0 * nz0) AS nn FROM e1),
e3 AS (SELECT *, CASE WHEN nn > 1e-15 THEN nx0 / nn ELSE 0 END AS nx,
                 CASE WHEN nn > 1e-15 THEN ny0 / nn ELSE 0 END AS ny,
                 CASE WHEN nn > 1e-15 THEN nz0 / nn ELSE 0 END AS nz FROM e2),
edges AS (SELECT *, ny * az - nz * ay AS tax, nz * ax - nx * az AS tay, nx * ay - ny * ax AS taz,
                    b_y * nz - bz * ny AS tbx, bz * nx - bx * nz AS tby, bx * ny - b_y * nx AS tbz,
                    (ax + bx) / 2 AS mx, (ay + b_y) / 2 AS my, (az + bz) / 2 AS mz,
                    asin(least(1.0, sqrt((ax - bx) ** 2 + (ay - b_y) ** 2 + (az - bz) ** 2) / 2)) + 1e-6 AS reach FROM e3)
"""

_WEATHER = f"""
wx AS (
  SELECT {_city_name('user_id')} AS city_name, {_city_lat('user_id')} AS latitude, {_city_lon('user_id')} AS longitude,
    ts AS datetime,
    (event_id * 7) % 101 + ((event_id * 13) % 9973) / {_d(10000.0)} AS humidity_relative,
    CAST(event_id % 61 AS DOUBLE) AS minutes_of_precipitation,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 61 AS DOUBLE) ELSE 0.0 END AS minutes_of_rain,
    ((event_id * 7919) % 1000003) / {_d(1000000.0)} AS precipitation_lwe,
    CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN 2 ELSE 0 END AS precipitation_type,
    CASE WHEN event_type = 'purchase' THEN ((event_id * 7919) % 1000003) / {_d(1000000.0)} ELSE 0.0 END AS rain_lwe,
    30 + event_id % 70 + ((event_id * 31) % 1000) / {_d(1000.0)} AS temperature,
    CAST(event_id % 30 + event_id % 11 AS DOUBLE) AS wind_gust,
    event_id % 30 + ((event_id * 3) % 977) / {_d(1000.0)} AS wind_speed
  FROM events
),
cities AS (SELECT DISTINCT city_name, latitude, longitude FROM wx)
"""


def _pv(t):
    return (f"cos(radians({t}.latitude)) * cos(radians({t}.longitude))",
            f"cos(radians({t}.latitude)) * sin(radians({t}.longitude))",
            f"sin(radians({t}.latitude))")


def _dist(p, e):
    """Point-arc distance in meters; p = (x, y, z) SQL, e = edge alias."""
    px, py, pz = p
    dot = lambda a, b, c: f"({a} * {px} + {b} * {py} + {c} * {pz})"
    ca = f"2 * asin(least(1.0, sqrt(({px} - {e}.ax) ** 2 + ({py} - {e}.ay) ** 2 + ({pz} - {e}.az) ** 2) / 2))"
    cb = f"2 * asin(least(1.0, sqrt(({px} - {e}.bx) ** 2 + ({py} - {e}.b_y) ** 2 + ({pz} - {e}.bz) ** 2) / 2))"
    inside = (f"{dot(e + '.tax', e + '.tay', e + '.taz')} >= 0 AND {dot(e + '.tbx', e + '.tby', e + '.tbz')} >= 0 "
              f"AND NOT ({e}.nx = 0 AND {e}.ny = 0 AND {e}.nz = 0)")
    perp = f"asin(least(1.0, abs({dot(e + '.nx', e + '.ny', e + '.nz')})))"
    return f"(CASE WHEN {inside} THEN {perp} ELSE least({ca}, {cb}) END * 6371008.8)"


def _near(points: str, keys: str, meters: float) -> str:
    """All (point keys, fid) within meters, b_y brute force over every edge."""
    return (f"SELECT DISTINCT {', '.join('p.' + k for k in keys.split(', '))}, e.fid FROM {points} p, edges e "
            f"WHERE {_dist(_pv('p'), 'e')} <= {meters}")


FLATTEN_FEATURES = f"""
WITH {_LINES}
SELECT doc_id, pos, object_id, file_name, miles, average_annual_daily_traffic, speed_limit, year, sign1, geom_type
FROM feat
"""

SPLIT_FEATURES = f"""
WITH {_LINES}
SELECT CAST(row_number() OVER (PARTITION BY c % 8 ORDER BY c) - 1 AS INTEGER) AS pos, object_id, file_name, miles, average_annual_daily_traffic,
       speed_limit, year, sign1, geom_type
FROM feat
"""

INGEST_QUARANTINE = """
SELECT CASE WHEN d % 9 = 4 THEN 'malformed' ELSE 'good' END AS kind, count(*) AS documents, CAST(sum(d) AS BIGINT) AS document_sum
FROM (SELECT DISTINCT c_custkey // 8 AS d FROM customer) GROUP BY 1
"""

GEO_DWITHIN = f"""
WITH {_LINES}, {_WEATHER},
near AS ({_near('cities', 'city_name, latitude, longitude', 16093.4)})
SELECT n.city_name, n.latitude, n.longitude, f.fid, f.object_id, f.miles, f.speed_limit
FROM near n JOIN feat f ON n.fid = f.fid
"""

GEO_DWITHIN_20MI = GEO_DWITHIN.replace("16093.4", "32186.9")


# Radii in meters; a city's is chosen by its name's length and its latitude.
RADII = (10.0, 250.0, 16093.4, 32186.9, 250000.0, 1000000.0)

GEO_DWITHIN_RADII = f"""
WITH {_LINES}, {_WEATHER},
circles AS (SELECT *, list_extract([{', '.join(f'{r}::DOUBLE' for r in RADII)}],
                                   (length(city_name) + CAST(floor(latitude * 1000) AS BIGINT)) % 6 + 1) AS radius FROM cities)
{_near('circles', 'city_name, latitude, longitude, radius', 'p.radius')}
"""


def _intersect_pairs_sql():
    tol = 1e-3
    names = {"a": ("ax", "ay", "az"), "b": ("bx", "b_y", "bz")}
    l_pt = lambda v: tuple(f"l.{n}" for n in names[v])
    r_pt = lambda v: tuple(f"r.{n}" for n in names[v])
    n1c = "(l.nx * r.ax + l.ny * r.ay + l.nz * r.az)"
    n1d = "(l.nx * r.bx + l.ny * r.b_y + l.nz * r.bz)"
    n2a = "(r.nx * l.ax + r.ny * l.ay + r.nz * l.az)"
    n2b = "(r.nx * l.bx + r.ny * l.b_y + r.nz * l.bz)"
    cross = f"({n1c} * {n1d} < 0 AND {n2a} * {n2b} < 0 AND {n1c} * {n2b} > 0)"
    touch = " OR ".join([
        f"{_dist(l_pt('a'), 'r')} <= {tol}", f"{_dist(l_pt('b'), 'r')} <= {tol}",
        f"{_dist(r_pt('a'), 'l')} <= {tol}", f"{_dist(r_pt('b'), 'l')} <= {tol}",
    ])
    return f"""
SELECT DISTINCT l.fid AS fid_1, r.fid AS fid_2
FROM edges l JOIN edges r  -- arcs cannot meet if their chords' middles are further apart than their half lengths (and 2 m)
  ON l.mx - l.reach <= r.mx + r.reach AND r.mx - r.reach <= l.mx + l.reach
 AND l.my - l.reach <= r.my + r.reach AND r.my - r.reach <= l.my + l.reach
 AND l.mz - l.reach <= r.mz + r.reach AND r.mz - r.reach <= l.mz + l.reach
WHERE l.fid <> r.fid AND l.object_id <> r.object_id AND ({cross} OR {touch})
"""


GEO_INTERSECTS = f"""
WITH {_LINES}
{_intersect_pairs_sql()}
"""

CITY_INTERSECTIONS = f"""
WITH {_LINES}, {_WEATHER},
near AS ({_near('cities', 'city_name, latitude, longitude', 16093.4)}),
ip AS ({_intersect_pairs_sql()})
SELECT n.city_name, count(*) AS intersection_cnt
FROM ip JOIN near n ON n.fid = ip.fid_1
GROUP BY n.city_name
ORDER BY intersection_cnt DESC, city_name
"""


def _round_div(num: str, den: str, scale: int) -> str:
    """HALF_UP rounding of num/den (both non-negative integers) to ``scale``
    decimals, as an exact DECIMAL."""
    f = 10 ** scale
    q = f"((2 * ({num}) * {f} + ({den})) // (2 * ({den})))"
    return f"CAST(CAST({q} AS DECIMAL(18,0)) / {f} AS DECIMAL({28 + scale},{scale}))" if scale else f"CAST({q} AS INTEGER)"


def _avg(col: str, scale: int) -> str:
    """Mean of a measure with up to 6 decimals: whole millionths, one rounding."""
    return _round_div(f"sum(CAST(round({col} * 1000000) AS HUGEINT))", f"(count({col}) * 1000000)", scale)


def _total(col: str) -> str:
    """Sum of a measure with up to 6 decimals, rounded once to cents."""
    return f"CAST({_round_div(f'sum(CAST(round({col} * 1000000) AS HUGEINT))', '1000000', 2)} AS DECIMAL(38,2))"


RAIN_BY_CITY_HOUR = f"""
WITH {_LINES}, {_WEATHER},
rain AS (SELECT * FROM wx WHERE precipitation_type = 1),
locs AS (SELECT DISTINCT latitude, longitude FROM rain),
near AS ({_near('locs', 'latitude, longitude', 32186.9)}),
j AS (SELECT r.*, n.fid FROM rain r JOIN near n ON r.latitude = n.latitude AND r.longitude = n.longitude),
o AS (SELECT city_name, hour(datetime) AS h, {_total('precipitation_lwe')} AS once
      FROM rain r WHERE EXISTS (SELECT 1 FROM near n WHERE r.latitude = n.latitude AND r.longitude = n.longitude)
      GROUP BY city_name, hour(datetime))
SELECT city_name, CAST(hour(datetime) AS INTEGER) AS hour,
  {_round_div('sum(CAST(minutes_of_rain AS BIGINT))', 'count(minutes_of_rain)', 0)} AS minutes_of_rain,
  {_total('precipitation_lwe')} AS total_precipitation,
  any_value(o.once) AS precipitation_once,
  CAST({_avg('temperature', 2)} AS DECIMAL(38,2)) AS avg_termperature,
  count(fid) AS roadway_segments_impacted
FROM j JOIN o USING (city_name) WHERE o.h = hour(datetime) GROUP BY city_name, hour(datetime)
ORDER BY hour, city_name
"""

_HOURS = (4, 7)


def _summary(hours=_HOURS):
    a, b = hours
    return f"""
ws AS (
  SELECT city_name, max(CAST(datetime AS DATE)) AS latest_date,
    {_avg('humidity_relative', 1)} AS avg_humidity,
    {_total('rain_lwe')} AS total_precipitation,
    sum(minutes_of_precipitation) AS total_precip_minutes,
    {_avg('temperature', 1)} AS avg_temperature,
    {_avg('wind_speed', 1)} AS avg_wind_speed
  FROM wx WHERE hour(datetime) BETWEEN {a} AND {b} GROUP BY city_name
)"""


_SUBSET = f"""near AS ({_near('cities', 'city_name, latitude, longitude', 16093.4)}),
sub AS (SELECT n.city_name, n.latitude, n.longitude, f.* FROM near n JOIN feat f ON n.fid = f.fid)"""

WEATHER_SUMMARY_LEFT_JOIN = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET}, {_summary()}
SELECT h.city_name, h.fid, h.object_id, h.miles, h.speed_limit,
  lpad(format('{{:,}}', h.average_annual_daily_traffic), 11, ' ') AS average_annual_daily_traffic,
  h.average_annual_daily_traffic AS aadt_value,
  w.latest_date, w.avg_humidity, w.total_precipitation, w.total_precip_minutes, w.avg_temperature, w.avg_wind_speed
FROM sub h LEFT JOIN ws w ON h.city_name = w.city_name
"""

_HOURLY = f"""
hourly AS (
  SELECT city_name, CAST(hour(datetime) AS INTEGER) AS hour_of_day,
    {_avg('humidity_relative', 8)} AS humidity_relative,
    {_avg('temperature', 8)} AS temperature,
    {_avg('wind_speed', 8)} AS wind_speed,
    {_avg('wind_gust', 8)} AS wind_gust,
    CAST(coalesce(sum(CAST(rain_lwe AS DECIMAL(28,9))), 0) AS DECIMAL(38,9)) AS rain_lwe,
    coalesce(sum(minutes_of_precipitation), 0.0) AS minutes_of_precipitation
  FROM wx GROUP BY city_name, hour(datetime)
)"""

HOURLY_TRENDS = f"""
WITH {_WEATHER}, {_HOURLY}
SELECT * FROM hourly
"""


# One city of the derivation, with two places.
CITY = "city_48"

HOURLY_ROWS = f"""
WITH {_WEATHER}
SELECT *, CAST(hour(datetime) AS INTEGER) AS hour_of_day FROM wx
WHERE city_name = '{CITY}' AND hour(datetime) BETWEEN {_HOURS[0]} AND {_HOURS[1]}
ORDER BY datetime, city_name
"""

HOURLY_TRENDS_OF_CITY = f"""
WITH {_WEATHER}, {_HOURLY}
SELECT * FROM hourly WHERE city_name = '{CITY}' AND hour_of_day BETWEEN {_HOURS[0]} AND {_HOURS[1]}
"""

# Fixed value: a city that is in no table.
NO_CITY = "nowhere"

EMPTY_REPORTS = " UNION ALL ".join(
    f"SELECT '{c}' AS city_name, NOT EXISTS (FROM ({HOURLY_ROWS.replace(CITY, c)})) AS is_empty" for c in (CITY, NO_CITY)
)

WEATHER_OF_CITY = f"""
WITH {_WEATHER}, {_summary()}
SELECT * FROM ws WHERE city_name = '{CITY}'
"""

FILL_FOR_DISPLAY = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET}, {_summary()}
SELECT h.city_name, h.fid, coalesce(h.miles, 0) AS miles, CAST(coalesce(h.year, 0) AS INTEGER) AS year, 'N/A' AS average_annual_daily_traffic,
       coalesce(CAST(w.latest_date AS VARCHAR), 'N/A') AS latest_date, coalesce(w.avg_temperature, 0) AS avg_temperature
FROM sub h LEFT JOIN ws w ON h.city_name = w.city_name
"""


def _mean_dec(col, scale_in, scale_out):
    # mean of DECIMAL(18, scale_in) values, HALF_UP to scale_out, exact
    num = f"sum(CAST(CAST({col} AS DECIMAL(38,8)) * {10 ** scale_in} AS BIGINT))"
    den = f"count({col}) * {10 ** scale_in}"
    return _round_div(num, den, scale_out)


TREND_SUMMARY = f"""
WITH {_WEATHER}, {_HOURLY}
SELECT city_name,
  {_mean_dec('temperature', 8, 4)} AS avg_temperature,
  {_mean_dec('humidity_relative', 8, 4)} AS avg_humidity,
  CAST({_round_div('sum(CAST(rain_lwe * 1000000 AS HUGEINT))', '1000000', 2)} AS DECIMAL(38,2)) AS total_precipitation,
  {_mean_dec('wind_speed', 8, 4)} AS avg_wind_speed
FROM hourly GROUP BY city_name
"""

SEGMENT_KPIS = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET}
SELECT city_name, count(*) AS total_segments, CAST(sum(miles) AS DECIMAL(38,2)) AS total_miles,
  CASE WHEN count(CASE WHEN speed_limit > 0 THEN 1 END) = 0 THEN NULL ELSE
  {_round_div('sum(CASE WHEN speed_limit > 0 THEN speed_limit END)', 'count(CASE WHEN speed_limit > 0 THEN 1 END)', 8)} END AS avg_speed_limit,
  count(year) AS records_with_year, max(miles) AS longest_segment, min(miles) AS shortest_segment,
  {_round_div('sum(CAST(miles * 100 AS BIGINT))', 'count(miles) * 100', 8)} AS avg_segment
FROM sub GROUP BY city_name
"""

SPEED_STATS = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET},
pos AS (SELECT city_name, speed_limit FROM sub WHERE speed_limit > 0),
cnt AS (SELECT city_name, speed_limit, count(*) AS c FROM pos GROUP BY 1, 2),
md AS (SELECT city_name, speed_limit AS mode_speed FROM cnt
       QUALIFY row_number() OVER (PARTITION BY city_name ORDER BY c DESC, speed_limit) = 1)
SELECT p.city_name, md.mode_speed, max(p.speed_limit) AS max_speed, min(p.speed_limit) AS min_speed
FROM pos p JOIN md ON p.city_name = md.city_name
GROUP BY p.city_name, md.mode_speed
"""

MILES_HISTOGRAM = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET}
SELECT city_name, CAST(CAST((CAST(miles * 100 AS BIGINT) // 5) * 5 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS bin_start,
       count(*) AS n
FROM sub WHERE miles IS NOT NULL GROUP BY 1, 2
"""

SPEED_HISTOGRAM = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET}
SELECT city_name, CAST((speed_limit // 5) * 5 AS BIGINT) AS bin_start, count(*) AS n
FROM sub WHERE speed_limit IS NOT NULL GROUP BY 1, 2
"""

def _auto_histogram(col: str, scale: int) -> str:
    value = lambda c: f"CAST(CAST({c} AS DECIMAL(18,{scale})) / {10 ** scale} AS DECIMAL(18,{scale}))" if scale else c
    return f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET},
v AS (SELECT city_name, CAST({col} * {10 ** scale} AS BIGINT) AS x FROM sub WHERE {col} IS NOT NULL),
q AS (SELECT city_name, count(*)::DOUBLE AS n, quantile_disc(x, 0.75) - quantile_disc(x, 0.25) AS iqr, max(x) - min(x) AS r FROM v GROUP BY city_name),
w AS (SELECT city_name, greatest(1.0, CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) ELSE r / (1 + log2(n)) END)::DOUBLE AS w FROM q),
p AS (SELECT city_name, w, (10.0::DOUBLE) ^ floor(log10(w)) AS p FROM w),
b AS (SELECT city_name, CAST(p * CASE WHEN w / p <= 1 THEN 1 WHEN w / p <= 2 THEN 2 WHEN w / p <= 5 THEN 5 ELSE 10 END AS BIGINT) AS width FROM p)
SELECT city_name, {value('width')} AS bin_width, {value('(x // width) * width')} AS bin_start, count(*) AS n
FROM v JOIN b USING (city_name) GROUP BY ALL
"""


MILES_AUTO_HISTOGRAM = _auto_histogram("miles", 2)
SPEED_AUTO_HISTOGRAM = _auto_histogram("speed_limit", 0)

# path of a feature = its first part; thinned when above 20 points.
_PATHS = """
fp AS (
  SELECT f.fid, f.geom_type, f.npts AS n_points,
         CASE WHEN f.npts > 20 THEN greatest(1, f.npts // 10) ELSE 1 END AS step
  FROM feat f WHERE NOT f.geom_null
),
fp2 AS (SELECT *, (n_points + step - 1) // step AS n_path, ((n_points - 1) // step) * step AS last_k FROM fp)
"""

PATH_THINNING = f"""
WITH {_LINES}, {_PATHS}
SELECT fp2.fid, CAST(fp2.n_points AS INTEGER) AS n_points, CAST(fp2.n_path AS INTEGER) AS n_path,
       a.lon AS first_lon, a.lat AS first_lat, b.lon AS last_lon, b.lat AS last_lat
FROM fp2 JOIN vx a ON a.fid = fp2.fid AND a.part = 0 AND a.k = 0
         JOIN vx b ON b.fid = fp2.fid AND b.part = 0 AND b.k = fp2.last_k
"""

PAYLOAD_ESTIMATE = f"""
WITH {_LINES}, {_WEATHER}, {_SUBSET}, {_PATHS},
agg AS (SELECT s.city_name, CAST(sum(fp2.n_path) AS BIGINT) AS total_coords, count(*) AS valid_paths
        FROM sub s JOIN fp2 ON s.fid = fp2.fid GROUP BY s.city_name)
SELECT city_name, total_coords, valid_paths, total_coords * 32 / 1048576.0 AS estimated_size_mb,
       CASE WHEN total_coords * 32 / 1048576.0 > 25 THEN 'error'
            WHEN total_coords * 32 / 1048576.0 > 15 THEN 'warn' ELSE 'ok' END AS level
FROM agg
"""

GEOJSON_ROUNDTRIP = f"""
WITH {_LINES}
SELECT fid, geom_type, CASE WHEN multi THEN 2 ELSE 1 END AS n_parts,
       CAST(npts + CASE WHEN multi THEN 2 ELSE 0 END AS INTEGER) AS n_vertices, TRUE AS roundtrip_equal
FROM feat WHERE NOT geom_null
"""

# with_identity on whole lineitem rows: amounts as decimals on both sides, and
# every column in the order, so rows that tie are equal.
LINE_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
IDENTITY_ROWS = f"""
SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, {", ".join(LINE_AMOUNTS)},
                          l_returnflag, l_linestatus, l_shipdate) AS line_id, *
FROM (SELECT * REPLACE ({", ".join(f"CAST({c} AS DECIMAL(15,2)) AS {c}" for c in LINE_AMOUNTS)}) FROM lineitem)
"""
