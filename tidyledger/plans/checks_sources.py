"""Oracle SQL (DuckDB dialect) for sources and sinks."""

from tidyledger.plans.checks_cleaning import BASE
from tidyledger.plans.checks_names import _WITH


def _amount(cents: str, style: str) -> str:
    plain = f"CAST(CAST({cents} / 100.0 AS DECIMAL(18,2)) AS VARCHAR)"
    grouped = f"format('{{:,.2f}}', CAST({cents} AS DOUBLE) / 100)"
    european = f"translate({grouped}, ',.', '.,')"
    return (f"CASE {style} WHEN 0 THEN {plain} WHEN 1 THEN replace({plain}, '.', ',') WHEN 2 THEN {european} || ' €' "
            f"WHEN 3 THEN {grouped} WHEN 4 THEN {plain} || ' EUR' WHEN 5 THEN '  $' || {plain} || '  ' "
            f"ELSE {european} || '€' END")


_MONTH = """['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre',
  'diciembre'][month(fecha)]"""
_K4 = "lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INT), '0')"
_K3 = "lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0')"

# The raw text of every dirty invoice.
DIRTY = BASE + f"""
, dirty AS (
  SELECT _row_number, k,
    CASE WHEN k % 50 = 49 THEN '' ELSE CASE k % 5 WHEN 0 THEN 'FAC-' || y || '-' || {_K4} WHEN 1 THEN 'fac/' || y || '/' || k
      WHEN 2 THEN 'FAC ' || y || ' ' || {_K3} WHEN 3 THEN y || '/' || k ELSE '  FAC-' || y || '-' || {_K4} || ' ' END END AS num_factura,
    CASE WHEN k % 40 = 39 THEN '31/02/' || y ELSE CASE k % 7 WHEN 0 THEN strftime(fecha, '%Y-%m-%d')
      WHEN 1 THEN strftime(fecha, '%d/%m/%Y') WHEN 2 THEN strftime(fecha, '%d-%m-%Y')
      WHEN 3 THEN day(fecha) || '/' || month(fecha) || '/' || strftime(fecha, '%y')
      WHEN 4 THEN day(fecha) || ' de ' || {_MONTH} || ' de ' || y WHEN 5 THEN y || '-' || month(fecha) || '-' || day(fecha)
      ELSE strftime(fecha, '%d') || ' DE ' || upper({_MONTH}) || ' DE ' || y END END AS fecha,
    CASE WHEN k % 61 = 60 THEN '' ELSE CASE k % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
      WHEN 2 THEN chr(160) || p_name || ' '
      ELSE list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') END END AS proveedor,
    CASE k % 4 WHEN 0 THEN letter || '-' || digits WHEN 1 THEN lower(letter) || digits WHEN 2 THEN digits
      ELSE ' ' || letter || digits END AS nif_cif,
    CASE WHEN k % 53 = 52 THEN 'Otro' WHEN tipo = 'Gasto' THEN ['Gasto', 'GASTO', 'gatso', 'gsato', ' expense '][k % 5 + 1]
      ELSE ['Ingreso', 'INGRESO', 'Ingrso', 'ingeso', ' income '][k % 5 + 1] END AS tipo,
    CASE k % 3 WHEN 0 THEN segment WHEN 1 THEN lower(segment) ELSE ' ' || upper(segment[1]) || lower(segment[2:]) || '  ' END AS categoria,
    {_amount('(total_c - iva_c)', 'k % 7')} AS importe_base, {_amount('iva_c', '(k + 1) % 7')} AS iva,
    CASE WHEN k % 45 = 44 THEN '12-34' WHEN k % 44 = 43 THEN '-' || {_amount('total_c', '2')} ELSE {_amount('total_c', '(k + 2) % 7')} END AS importe_total,
    CASE WHEN k % 59 = 58 THEN 'En Disputa' ELSE CASE estado_factura
      WHEN 'Pagada' THEN ['Pagada', 'pagda', ' PAID '] WHEN 'Pendiente' THEN ['Pendiente', 'pendiete', ' PDTE ']
      WHEN 'Vencida' THEN ['Vencida', 'vencda', ' OVERDUE '] ELSE ['Parcialmente Pagada', 'parcial', ' PARTIAL '] END[k % 3 + 1] END AS estado_factura,
    CASE k % 5 WHEN 1 THEN format('{{:,.2f}}', CAST(total_c AS DOUBLE) / 100) WHEN 2 THEN '0' WHEN 3 THEN 'n/d' ELSE '' END AS importe_pendiente
  FROM base
)
"""
_CLEAN = BASE + """
  SELECT _row_number, num_factura, fecha, proveedor, nif_cif, tipo, categoria, importe_base, iva, importe_total,
    estado_factura, importe_pendiente FROM invoices"""



def _gold_rows() -> str:
    parts = ["SELECT 'record' AS name, num_factura AS field, categoria AS key, 1::BIGINT AS n, importe_total AS amount FROM invoices"]
    parts += [f"SELECT 'statistic', '{f}', NULL, count({f}), max({f}) FROM invoices"
              for f in ("importe_base", "iva", "importe_total", "importe_pendiente")]
    parts += [f"SELECT 'index', '{f}', CAST({f} AS VARCHAR), count(*), NULL FROM invoices GROUP BY {f}"
              for f in ("fecha", "categoria", "proveedor", "tipo", "estado_factura")]
    parts += [f"SELECT 'segment', '{f}', {f}, count(*), round(sum(CAST(importe_total AS DECIMAL(18,2))), 2)::DOUBLE FROM invoices GROUP BY {f}"
              for f in ("categoria", "proveedor", "tipo", "estado_factura")]
    return " UNION ALL ".join(parts)


SQL = {
    "read_bronze": DIRTY + "SELECT * EXCLUDE (k, _row_number), _row_number AS clave FROM dirty",
    "bronze_row_numbers": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) + 1 AS row_number FROM orders",
    "csv_structure": """
      SELECT CAST((o_orderkey + 1) % 5 AS VARCHAR) AS file, true AS is_valid, count(*) AS row_count, 3::BIGINT AS column_count,
        'clave|cliente|clave' AS column_names, 'clave' AS duplicate_names,
        count(*) FILTER (o_orderkey % 100 = 99 OR o_orderkey % 50 IN (47, 48)) AS ragged_rows
      FROM orders GROUP BY 1""",
    "encodings": r"""
      WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x20-\x7e\x{a1}-\x{ff}]', ' ', 'g') AS text FROM documents)
      SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN regexp_replace(text, '[^\x20-\x7e]', ' ', 'g') ELSE text || ' ñ' END AS text,
        CASE doc_id % 3 WHEN 1 THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM t""",
    "infer_schema": DIRTY + """
      , first20 AS (
        SELECT * EXCLUDE (k, _row_number), CAST(_row_number AS VARCHAR) AS cliente, CASE WHEN _row_number % 2 = 0 THEN 'sí' ELSE 'no' END AS activo,
          '2024-01-15T10:00' AS dia, ' ' AS vacio FROM dirty ORDER BY _row_number LIMIT 20
      ), cells AS (
        SELECT name, trim(replace(v, chr(160), ' ')) AS v FROM first20 UNPIVOT (v FOR name IN (COLUMNS(*)))
      ), facts AS (
        SELECT name, count(*) FILTER (v <> '') AS n, bool_and(regexp_full_match(v, '-?[0-9]+')) FILTER (v <> '') AS whole,
          bool_and(regexp_full_match(v, '-?[0-9]+[.,]?[0-9]*|-?[0-9]*[.,][0-9]+|-?[0-9.,]+[[:space:]]*(€|EUR|USD|[$])?')) FILTER (v <> '') AS num,
          bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}')) FILTER (v <> '') AS stamp,
          bool_and(lower(v) IN ('true','false','yes','no','si','sí','1','0','verdadero','falso')) FILTER (v <> '') AS flag
        FROM cells GROUP BY name)
      SELECT name, CASE WHEN n = 0 THEN 'str' WHEN whole THEN 'int' WHEN num THEN 'float' WHEN stamp THEN 'date'
        WHEN flag THEN 'bool' ELSE 'str' END AS type FROM facts""",
    "ingest_manifest": DIRTY + """
      SELECT _row_number AS clave, num_factura, importe_total, 'utf-8' AS encoding, count(*) OVER () AS row_count, 12::BIGINT AS columns,
        0::BIGINT AS ragged_rows FROM dirty""",
    "clean_sink_parquet": _CLEAN,
    "clean_sink_csv": _CLEAN,
    "gold_sink": BASE + _gold_rows(),
    "preview": BASE + "SELECT num_factura, proveedor, tipo FROM invoices ORDER BY _row_number LIMIT 10",
    "review_sink": _WITH + """
      SELECT 'p_name' AS campo, g.canonical AS grupo, row_number() OVER (PARTITION BY leader
        ORDER BY c.value <> g.canonical, c.n DESC, length(c.value) DESC, c.value) AS posicion, c.value AS nombre,
        round(g.similarity / 100.0, 2)::DOUBLE AS similitud, 'pendiente' AS accion
      FROM grouped g JOIN clustered c USING (leader)""",
    "list_runs": """
      SELECT strftime(ts, '%Y%m%d') AS run_id, arg_max('user_' || user_id, ts) AS file_name, arg_max(event_type, ts) AS status,
        arg_max(event_id, ts) AS record_count
      FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 20""",
}
