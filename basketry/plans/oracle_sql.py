"""DuckDB SQL building blocks for the oracle queries of the catalog.

The tables of one scale-factor folder are registered as views by the checker; these common
table expressions rebuild the adapters and the cleaning in plain SQL.
"""

from __future__ import annotations

SALES_LINES = """sales_lines AS (
  SELECT o.o_orderkey AS InvoiceNo, p.p_name AS Description, l.l_quantity AS Quantity,
         o.o_orderdate AS InvoiceDate,
         CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END AS UnitPrice,
         o.o_custkey AS CustomerID, n.n_name AS Country, l.l_extendedprice AS TotalPrice,
         l.l_partkey AS _partkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

EVENT_SALES = """event_sales AS (
  SELECT event_id AS InvoiceNo, event_type AS Description, 1.0::DOUBLE AS Quantity, ts AS InvoiceDate,
         value AS UnitPrice, user_id AS CustomerID, event_type AS Country, value AS TotalPrice
  FROM events)"""

DIRTY_LINES = """dirty_base AS (
  SELECT InvoiceNo,
         CASE WHEN _partkey % 19 = 0 THEN NULL ELSE Description END AS Description,
         CASE WHEN InvoiceNo % 13 = 0 THEN -Quantity ELSE Quantity END AS Quantity,
         InvoiceDate,
         CASE WHEN InvoiceNo % 23 = 0 THEN 0.0::DOUBLE ELSE UnitPrice END AS UnitPrice,
         CASE WHEN InvoiceNo % 17 = 0 THEN NULL ELSE CustomerID END AS CustomerID,
         Country
  FROM sales_lines),
dirty_lines AS (
  SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE InvoiceNo % 11 = 0)"""


def derived(src: str, total: bool) -> str:
    """Projection adding TotalPrice (when absent), Month, Hour, Day and day_idx."""
    tp = "Quantity * UnitPrice AS TotalPrice," if total else "TotalPrice,"
    return f"""SELECT InvoiceNo, Description, Quantity, InvoiceDate, UnitPrice, CAST(CustomerID AS BIGINT) AS CustomerID,
         Country, {tp}
         strftime(InvoiceDate, '%Y-%m') AS Month, CAST(hour(InvoiceDate) AS INTEGER) AS Hour,
         strftime(InvoiceDate, '%A') AS Day, CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS day_idx
  FROM {src}"""


def cleaned(name: str, src: str, cols: str, total_present: bool) -> str:
    """CTE ``name`` = cleaning of ``src`` (drop null customer, distinct, valid orders, derive)."""
    return f"""{name}_valid AS (
  SELECT * FROM (SELECT DISTINCT {cols} FROM {src} WHERE CustomerID IS NOT NULL) d
  WHERE Quantity > 0 AND UnitPrice > 0),
{name} AS ({derived(name + '_valid', not total_present)})"""


CANON = "InvoiceNo, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country"


def with_sales(body: str) -> str:
    """``sales`` = cleaned sales_lines."""
    return f"WITH {SALES_LINES},\n{cleaned('sales', 'sales_lines', CANON + ', TotalPrice', True)}\n{body}"


def with_events(body: str) -> str:
    """``sales`` = cleaned event_sales."""
    return f"WITH {EVENT_SALES},\n{cleaned('sales', 'event_sales', CANON + ', TotalPrice', True)}\n{body}"


def with_dirty(body: str) -> str:
    """``dirty_lines`` and ``sales`` = cleaned dirty_lines (TotalPrice derived)."""
    return f"WITH {SALES_LINES},\n{DIRTY_LINES},\n{cleaned('sales', 'dirty_lines', CANON, False)}\n{body}"


RFM = """rfm AS (
  SELECT CustomerID,
         CAST(date_sub('day', max(InvoiceDate), (SELECT max(InvoiceDate) + INTERVAL 1 DAY FROM sales)) AS INTEGER) AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency, sum(TotalPrice) AS Monetary
  FROM sales WHERE CustomerID IS NOT NULL GROUP BY CustomerID),
seg AS (
  SELECT *, CASE WHEN Recency < 30 THEN 'Recent'
                 WHEN Frequency > (SELECT quantile_cont(Frequency, 0.75) FROM rfm) THEN 'Loyal'
                 WHEN Monetary > (SELECT quantile_cont(Monetary, 0.75) FROM rfm) THEN 'High Value'
                 ELSE 'Low Value' END AS Segment
  FROM rfm)"""


def with_sales_rfm(body: str) -> str:
    """``sales`` (cleaned sales_lines), ``rfm`` and ``seg`` (rfm + rule Segment)."""
    return f"WITH {SALES_LINES},\n{cleaned('sales', 'sales_lines', CANON + ', TotalPrice', True)},\n{RFM}\n{body}"


def with_events_rfm(body: str) -> str:
    """Same over cleaned event_sales."""
    return f"WITH {EVENT_SALES},\n{cleaned('sales', 'event_sales', CANON + ', TotalPrice', True)},\n{RFM}\n{body}"


HEALTH = """CAST((CASE WHEN Recency < 30 THEN 40 WHEN Recency < 90 THEN 20 ELSE 5 END)
      + (CASE WHEN Frequency >= 10 THEN 30 WHEN Frequency >= 5 THEN 20 ELSE 5 END)
      + (CASE WHEN Monetary >= 1000 THEN 30 WHEN Monetary >= 300 THEN 20 ELSE 5 END) AS INTEGER)"""


def health_label(score: str) -> str:
    return f"CASE WHEN {score} >= 70 THEN 'Healthy' WHEN {score} >= 40 THEN 'Average' ELSE 'At Risk' END"


def advice_case(col: str, mapping: dict, default: str) -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {q(default)} END"


def _std(c: str) -> str:
    return (f"(SELECT CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM rfm)")


Z = f"""z AS (
  SELECT CustomerID, Segment,
         (Recency - (SELECT avg(Recency) FROM rfm)) / {_std('Recency')} AS zRecency,
         (Frequency - (SELECT avg(Frequency) FROM rfm)) / {_std('Frequency')} AS zFrequency,
         (Monetary - (SELECT avg(Monetary) FROM rfm)) / {_std('Monetary')} AS zMonetary
  FROM seg)"""

_D2 = "power(a.zRecency - b.zRecency, 2) + power(a.zFrequency - b.zFrequency, 2) + power(a.zMonetary - b.zMonetary, 2)"


def silhouette_sql(squared: bool) -> str:
    d = _D2 if squared else f"sqrt({_D2})"
    return f""", {Z},
pairs AS (SELECT a.CustomerID AS id, a.Segment AS own, b.Segment AS cl, sum({d}) AS s, count(*) AS c
          FROM z a JOIN z b ON a.CustomerID <> b.CustomerID GROUP BY a.CustomerID, a.Segment, b.Segment),
per AS (SELECT id, max(CASE WHEN cl = own THEN s / c END) AS a, min(CASE WHEN cl <> own THEN s / c END) AS b,
               max(CASE WHEN cl = own THEN c END) AS cown FROM pairs GROUP BY id)
SELECT round(avg(CASE WHEN cown IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6)
       AS silhouette FROM per"""


DAVIES_BOULDIN = f""", {Z},
cent AS (SELECT Segment AS cl, avg(zRecency) AS c0, avg(zFrequency) AS c1, avg(zMonetary) AS c2 FROM z GROUP BY Segment),
spread AS (SELECT z.Segment AS cl, avg(sqrt(power(zRecency - c0, 2) + power(zFrequency - c1, 2) + power(zMonetary - c2, 2))) AS s
           FROM z JOIN cent ON z.Segment = cent.cl GROUP BY z.Segment),
cs AS (SELECT cent.cl, c0, c1, c2, s FROM cent JOIN spread ON cent.cl = spread.cl),
r AS (SELECT a.cl, max(CASE WHEN sqrt(power(a.c0 - b.c0, 2) + power(a.c1 - b.c1, 2) + power(a.c2 - b.c2, 2)) = 0 THEN 0
                            ELSE (a.s + b.s) / sqrt(power(a.c0 - b.c0, 2) + power(a.c1 - b.c1, 2) + power(a.c2 - b.c2, 2)) END) AS m
      FROM cs a JOIN cs b ON a.cl <> b.cl GROUP BY a.cl)
SELECT round(avg(m), 6) AS davies_bouldin FROM r"""


def dbscan_summary_sql(eps: float = 0.5, min_pts: int = 5) -> str:
    """DBSCAN by brute force in SQL: all pairs, degree, core points, components by a recursive
    CTE, border points to the lowest reachable component. For oracle use on small tables only."""
    return f""", {Z},
pts AS (SELECT CustomerID AS id, zRecency AS x0, zFrequency AS x1, zMonetary AS x2 FROM z),
nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b
       ON power(a.x0 - b.x0, 2) + power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2) <= {eps * eps}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {min_pts}),
cedge AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
cc(id, lab) AS (SELECT id, id FROM core UNION SELECT e.b, cc.lab FROM cc JOIN cedge e ON cc.id = e.a),
comp AS (SELECT id, min(lab) AS lab FROM cc GROUP BY id),
border AS (SELECT nb.a AS id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
labels AS (SELECT p.id, coalesce(comp.lab, border.lab, -1) AS lab, comp.id IS NOT NULL AS is_core
           FROM pts p LEFT JOIN comp ON p.id = comp.id LEFT JOIN border ON p.id = border.id)
SELECT count(DISTINCT CASE WHEN lab <> -1 THEN lab END) AS clusters,
       round(avg(CASE WHEN lab = -1 THEN 1.0 ELSE 0.0 END) * 100, 1) AS noise_pct,
       CAST(sum(CAST(is_core AS BIGINT)) AS BIGINT) AS core_points, count(*) AS points
FROM labels"""


_COLS3 = ("zRecency", "zFrequency", "zMonetary")
LABEL_OF_SEGMENT = "CASE Segment WHEN 'Low Value' THEN 0 WHEN 'High Value' THEN 1 WHEN 'Loyal' THEN 2 ELSE 3 END"


def _d2(a: str, b: str) -> str:
    return " + ".join(f"power({a}.{c} - {b}.{c}, 2)" for c in _COLS3)


def nearest(centres_from: str = "z", name: str = "lab") -> str:
    """CTE ``lab`` (CustomerID, Cluster): the nearest of the rule-segment means of ``centres_from``."""
    means = ", ".join(f"avg({c}) AS {c}" for c in _COLS3)
    return f"""cent_{name} AS (SELECT {LABEL_OF_SEGMENT} AS label, {means} FROM {centres_from} GROUP BY Segment),
{name} AS (SELECT CustomerID, CAST(label AS INTEGER) AS Cluster FROM (
  SELECT z.CustomerID, c.label, row_number() OVER (PARTITION BY z.CustomerID ORDER BY {_d2('z', 'c')}, c.label) AS r
  FROM z, cent_{name} c) n WHERE r = 1)"""


#: CTEs m (means per cluster) and named (CustomerID, Cluster, KMSegment) from ``lab``.
NAMED = """m AS (SELECT Cluster, avg(Recency) AS r, avg(Frequency) AS f, avg(Monetary) AS mo FROM lab JOIN rfm USING (CustomerID) GROUP BY Cluster),
vip AS (SELECT Cluster FROM m ORDER BY mo DESC, Cluster LIMIT 1),
lost AS (SELECT Cluster FROM m WHERE Cluster NOT IN (SELECT * FROM vip) ORDER BY r DESC, Cluster LIMIT 1),
loyal AS (SELECT Cluster FROM m WHERE Cluster NOT IN (SELECT * FROM vip UNION ALL SELECT * FROM lost) ORDER BY f DESC, Cluster LIMIT 1),
named AS (SELECT CustomerID, Cluster, CASE WHEN (SELECT count(*) FROM m) <> 4 THEN 'Cluster ' || Cluster
    WHEN Cluster IN (SELECT * FROM vip) THEN 'VIP' WHEN Cluster IN (SELECT * FROM lost) THEN 'Lost'
    WHEN Cluster IN (SELECT * FROM loyal) THEN 'Loyal' ELSE 'Regular' END AS KMSegment FROM lab)"""


def label_scores(labels: str, out: str) -> str:
    """CTE ``out`` (g, inertia, silhouette, davies_bouldin) for labellings ``labels`` (g, CustomerID, lab) of ``z``;
    the silhouette is the squared-Euclidean one."""
    sq = " + ".join(f"z.{c} * z.{c}" for c in _COLS3)
    means = ", ".join(f"avg(z.{c}) AS {c}" for c in _COLS3)
    dot = " + ".join(f"z.{c} * s.{c}" for c in _COLS3)
    return f"""{out}_p AS (SELECT l.g, l.lab, z.*, {sq} AS sq FROM {labels} l JOIN z USING (CustomerID)),
{out}_s AS (SELECT g, lab, count(*) AS n, {means}, avg(sq) AS q FROM {out}_p z GROUP BY g, lab),
{out}_d AS (SELECT z.g, z.CustomerID, z.lab, s.lab AS other, s.n, z.sq - 2 * ({dot}) + s.q AS d, {_d2('z', 's')} AS d2
  FROM {out}_p z JOIN {out}_s s ON z.g = s.g),
{out}_i AS (SELECT g, CustomerID, max(CASE WHEN lab = other THEN n END) AS n,
  max(CASE WHEN lab = other AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN lab <> other THEN d END) AS b FROM {out}_d GROUP BY g, CustomerID),
{out}_sil AS (SELECT g, CASE WHEN count(b) > 0 THEN avg(CASE WHEN n <= 1 THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) END AS silhouette
  FROM {out}_i GROUP BY g),
{out}_w AS (SELECT g, lab, sum(d2) AS ss, avg(sqrt(d2)) AS s FROM {out}_d WHERE lab = other GROUP BY g, lab),
{out}_r AS (SELECT a.g, a.lab, max(CASE WHEN {_d2('a', 'b')} = 0 THEN 0 ELSE (wa.s + wb.s) / sqrt({_d2('a', 'b')}) END) AS r
  FROM {out}_s a JOIN {out}_s b ON a.g = b.g AND a.lab <> b.lab JOIN {out}_w wa ON wa.g = a.g AND wa.lab = a.lab JOIN {out}_w wb ON wb.g = b.g AND wb.lab = b.lab
  GROUP BY a.g, a.lab),
{out} AS (SELECT g, (SELECT sum(ss) FROM {out}_w w WHERE w.g = t.g) AS inertia, silhouette,
  (SELECT avg(r) FROM {out}_r r WHERE r.g = t.g) AS davies_bouldin FROM {out}_sil t)"""
