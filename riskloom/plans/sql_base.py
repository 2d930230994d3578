"""Shared SQL text for the oracle queries (ANSI SQL as DuckDB runs it, on the driver's
pre-registered views). Literals in double context are typed DOUBLE so that no engine
switches to decimal arithmetic."""

from __future__ import annotations

from riskloom.constants import CYCLES, MODES, RISK_LABELS
from riskloom.functions.numeric import round_to_sql as rnd


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


RECORDS = f"""
crops AS (
  SELECT Nomcultivo, dense_rank() OVER (ORDER BY Nomcultivo) AS Idcultivo
  FROM (SELECT DISTINCT p_type AS Nomcultivo FROM part) t),
lines AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS Anio, n_nationkey AS Idestado, n_name AS Nomestado,
         s_suppkey AS Idmunicipio, s_name AS Nommunicipio,
         CASE WHEN p_type = 'PROMO' THEN 3 WHEN month(l_shipdate) BETWEEN 5 AND 10 THEN 1 ELSE 2 END
           AS Idciclo,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS Idmodalidad,
         c.Idcultivo, p_type AS Nomcultivo, l_quantity,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE CAST(0 AS DOUBLE) END AS lost_qty,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS kept_price,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2))
              * (1 - CAST(l_discount AS DECIMAL(4,2))) END AS kept_net
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey
       JOIN crops c ON c.Nomcultivo = p_type),
rec_agg AS (
  SELECT Anio, Idestado, Nomestado, Idmunicipio, Nommunicipio, Idciclo, Idmodalidad, Idcultivo,
         Nomcultivo, SUM(l_quantity) AS Sembrada, SUM(lost_qty) AS Siniestrada,
         CAST(COALESCE(SUM(kept_price), 0) AS DOUBLE) AS Volumenproduccion,
         CAST(SUM(kept_net) AS DOUBLE) AS Valorproduccion
  FROM lines GROUP BY Anio, Idestado, Nomestado, Idmunicipio, Nommunicipio, Idciclo,
         Idmodalidad, Idcultivo, Nomcultivo),
records AS (
  SELECT ((((CAST(Idmunicipio AS BIGINT) * 10000 + Anio) * 4 + Idciclo) * 3 + Idmodalidad) * 1000
           + Idcultivo) AS record_id,
         Anio, Idestado, Nomestado, Idmunicipio, Nommunicipio, Idciclo,
         {_case('Idciclo', CYCLES)} AS Nomcicloproductivo,
         Idmodalidad, {_case('Idmodalidad', MODES)} AS Nommodalidad, Idcultivo, Nomcultivo,
         Sembrada, Siniestrada, Sembrada - Siniestrada AS Cosechada, Volumenproduccion,
         Volumenproduccion / NULLIF(Sembrada - Siniestrada, CAST(0 AS DOUBLE)) AS Rendimiento,
         Valorproduccion / NULLIF(Volumenproduccion, CAST(0 AS DOUBLE)) AS Precio,
         Valorproduccion
  FROM rec_agg),
risk0 AS (
  SELECT *, COALESCE(LEAST(GREATEST(Siniestrada / NULLIF(Sembrada, CAST(0 AS DOUBLE)),
                                    CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE))
           AS proporcion_siniestro
  FROM records),
risk AS (
  SELECT *, CASE WHEN proporcion_siniestro = 0 THEN 0
                 WHEN proporcion_siniestro <= CAST(0.1 AS DOUBLE) THEN 1
                 WHEN proporcion_siniestro <= CAST(0.4 AS DOUBLE) THEN 2
                 WHEN proporcion_siniestro <= CAST(0.75 AS DOUBLE) THEN 3 ELSE 4 END AS target
  FROM risk0),
risky AS (
  SELECT *, {_case('target', dict(enumerate(RISK_LABELS)))} AS nivel_riesgo FROM risk)"""

_W = [f"1 + (Idmunicipio * 7 + Idcultivo * 13 + Anio * 3 + {5 * k}) % 11"
      f" + CASE WHEN target = {k} THEN 4 ELSE 0 END" for k in range(5)]

SCORED = f"""
scored_w AS (
  SELECT record_id, target, Nomestado, Anio, proporcion_siniestro,
         {', '.join(f'{w} AS w{k}' for k, w in enumerate(_W))}
  FROM risky),
scored AS (
  SELECT record_id AS key, target AS y,
         CASE WHEN w0 = greatest(w0, w1, w2, w3, w4) THEN 0
              WHEN w1 = greatest(w0, w1, w2, w3, w4) THEN 1
              WHEN w2 = greatest(w0, w1, w2, w3, w4) THEN 2
              WHEN w3 = greatest(w0, w1, w2, w3, w4) THEN 3 ELSE 4 END AS yhat,
         [{', '.join(f'CAST(w{k} AS DOUBLE) / (w0 + w1 + w2 + w3 + w4)' for k in range(5))}] AS p,
         {', '.join(f'CAST(w{k} AS DOUBLE) / (w0 + w1 + w2 + w3 + w4) AS p{k}' for k in range(5))},
         Nomestado, Anio, proporcion_siniestro
  FROM scored_w)"""

CLIMATE = """
climate_cells AS (
  SELECT c_nationkey AS Idestado, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS m
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_nationkey, year(o_orderdate), month(o_orderdate)),
climate AS (
  SELECT year, month, Idestado,
         CAST(14.5 AS DOUBLE) + CAST(0.7 AS DOUBLE) * Idestado AS lat,
         m / CAST(50000 AS DOUBLE) AS precip_mm_dia,
         fmod(m / CAST(1000 AS DOUBLE), CAST(40 AS DOUBLE)) - 5 AS temp_media_c,
         fmod(m / CAST(1000 AS DOUBLE), CAST(40 AS DOUBLE)) - 5 + 6 AS temp_max_c,
         fmod(m / CAST(1000 AS DOUBLE), CAST(40 AS DOUBLE)) - 5 - 6 AS temp_min_c,
         fmod(m, CAST(100 AS DOUBLE)) AS humedad_rel_pct,
         fmod(m / CAST(100 AS DOUBLE), CAST(12 AS DOUBLE)) AS viento_ms
  FROM climate_cells)"""

BASE = RECORDS + "," + SCORED + "," + CLIMATE


def with_base(body: str, extra_ctes: str = "") -> str:
    """Prefix the shared CTEs (records, risk, scored, climate) to a query body."""
    ctes = BASE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def final(sql: str, dbl=(), ints=(), digits: int = 6) -> str:
    """Round the listed double columns and cast the listed integral ones to BIGINT, in the
    same way the Spark side normalises its result."""
    repl = [f"{rnd(c, digits)} AS {c}" for c in dbl] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    if not repl:
        return sql
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql}) AS _q"
