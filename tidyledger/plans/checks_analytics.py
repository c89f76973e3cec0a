"""Oracle SQL (DuckDB dialect) for analytics, updates and comparisons."""

from tidyledger.plans.checks_sources import DIRTY
from tidyledger.plans.checks_cleaning import BASE, CLEANED

_STATS = """
  SELECT '{f}' AS field, count({f}) AS count, round(sum({f}), 3) AS sum, round(avg({f}), 3) AS mean,
    round(median({f}), 3) AS median, round(min({f}), 3) AS min, round(max({f}), 3) AS max,
    round(coalesce(stddev_samp({f}), 0), 3) AS std FROM {t}"""
_LINE_STATS = " UNION ALL ".join(
    _STATS.format(f=f, t="lineitem") for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
_MONEY = ("importe_base", "iva", "importe_total", "importe_pendiente")
_SUMS = ", ".join(
    f"CAST(sum(CAST({f} AS DECIMAL(18,3))) AS DOUBLE) AS {f}_sum, "
    f"CAST(sum(CAST({f} AS DECIMAL(18,3))) AS DOUBLE) / count({f}) AS {f}_mean" for f in _MONEY)
_SEGMENTS = " UNION ALL ".join(
    f"SELECT '{s}' AS segment_field, {s} AS segment, count(*) AS count, {_SUMS} FROM invoices GROUP BY {s}"
    for s in ("tipo", "estado_factura", "categoria", "proveedor"))
_INDEX = " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS key, count(*) AS count FROM invoices GROUP BY {f}"
    for f in ("fecha", "categoria", "proveedor", "tipo", "estado_factura"))
_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS key, _row_number // 4096 AS chunk, count(*) AS count, "
    f"string_agg(CAST(_row_number AS VARCHAR), ',' ORDER BY _row_number) AS row_indices FROM invoices GROUP BY {f}, 3"
    for f in ("categoria", "tipo", "fecha"))
_TOP = f"""
, idx AS ({_INDEX})
, ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, key) AS rank FROM idx)"""
_BATCHES = BASE + """
, fresh AS (
  SELECT CASE WHEN categoria = 'Machinery' THEN num_factura || '-R' ELSE num_factura END AS num_factura, _row_number
  FROM invoices WHERE estado_factura <> 'Pagada'
), updated AS (
  SELECT num_factura, _row_number, 'Pagada' AS estado_factura, 0.0::DOUBLE AS importe_pendiente, 'lote' AS origen FROM fresh
  UNION ALL
  SELECT num_factura, _row_number, estado_factura, importe_pendiente, NULL FROM invoices
  WHERE num_factura NOT IN (SELECT num_factura FROM fresh)
)"""
# Fields whose raw text, stripped, is not the text of the clean value.
_CHANGED = CLEANED + DIRTY[len(BASE):] + """
, changed AS (
  SELECT j._row_number, j.categoria, concat_ws(',', """ + ", ".join(
    f"CASE WHEN trim(replace(coalesce(d.{f}, ''), chr(160), ' ')) <> coalesce(CAST(j.{f} AS VARCHAR), '') THEN '{f}' END"
    for f in ("num_factura", "fecha", "proveedor", "nif_cif", "tipo", "categoria", "importe_base", "iva", "importe_total",
              "estado_factura", "importe_pendiente")) + """) AS modified_fields
  FROM judged j JOIN dirty d USING (_row_number) WHERE n_errors = 0
)"""

SQL = {
    "field_statistics": _LINE_STATS,
    "field_statistics_bracketed": _LINE_STATS,
    "segmented_statistics": BASE + _SEGMENTS,
    "segmented_long": """
      SELECT segment_field, segment, metric, value FROM (
        SELECT 'l_returnflag' AS segment_field, l_returnflag AS segment, count(*)::DOUBLE AS count,
          round(sum(l_quantity), 3) AS l_quantity_sum, round(avg(l_quantity), 3) AS l_quantity_mean,
          round(sum(l_extendedprice), 3) AS l_extendedprice_sum, round(avg(l_extendedprice), 3) AS l_extendedprice_mean
        FROM lineitem GROUP BY 2
        UNION ALL
        SELECT 'l_linestatus', l_linestatus, count(*)::DOUBLE, round(sum(l_quantity), 3), round(avg(l_quantity), 3),
          round(sum(l_extendedprice), 3), round(avg(l_extendedprice), 3)
        FROM lineitem GROUP BY 2)
      UNPIVOT (value FOR metric IN (count, l_quantity_sum, l_quantity_mean, l_extendedprice_sum, l_extendedprice_mean))""",
    "value_index": BASE + _INDEX,
    "value_index_rows": BASE + _ROWS,
    "unique_values": BASE + f", idx AS ({_INDEX}) SELECT field, count(*) AS unique_values FROM idx GROUP BY field",
    "lookup": BASE + "SELECT _row_number, num_factura, importe_total FROM invoices WHERE categoria = 'Machinery'",
    "bitmap_index": BASE + """
      SELECT 'categoria' AS field, categoria AS key, count(*) AS count FROM invoices GROUP BY categoria
      UNION ALL SELECT 'tipo', tipo, count(*) FROM invoices GROUP BY tipo
      UNION ALL SELECT 'fecha', CAST(CAST(fecha AS DATE) AS VARCHAR), count(*) FROM invoices GROUP BY fecha""",
    "bitmap_lookup": BASE + """
      SELECT _row_number FROM invoices WHERE categoria IN ('Machinery', 'Furniture') AND tipo = 'Ingreso'
        AND estado_factura IN ('Pagada', 'Pendiente')""",
    "heavy_words": """
      SELECT word AS key, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, word) AS INTEGER) AS rank
      FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word
      QUALIFY rank <= 20""",
    "heavy_orders": """
      SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS count,
        CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(l_orderkey AS VARCHAR)) AS INTEGER) AS rank
      FROM lineitem GROUP BY l_orderkey QUALIFY rank <= 10""",
    "top_k": BASE + _TOP + "SELECT field, key, count, rank FROM ranked WHERE rank <= 5",
    "summary": BASE + _TOP + """
      , stats AS (""" + " UNION ALL ".join(_STATS.format(f=f, t="invoices") for f in _MONEY) + """)
      SELECT 'records' AS section, 'all' AS item, 'count' AS metric, count(*)::DOUBLE AS value FROM invoices
      UNION ALL SELECT 'statistics', field, metric, value FROM (SELECT field, mean, sum, min, max FROM stats)
        UNPIVOT (value FOR metric IN (mean, sum, min, max))
      UNION ALL SELECT 'unique_values', field, 'count', count(*)::DOUBLE FROM idx GROUP BY field
      UNION ALL SELECT 'top:' || field, key, CAST(rank AS VARCHAR), count::DOUBLE FROM ranked WHERE rank <= 5""",
    "dashboard_metrics": BASE + _TOP + """
      SELECT 'Total Registros' AS metric, 'all' AS label, count(*)::DOUBLE AS value FROM invoices
      UNION ALL SELECT 'Ingresos vs Gastos', 'Ingresos', round(sum(importe_total), 3) FROM invoices WHERE tipo = 'Ingreso'
      UNION ALL SELECT 'Ingresos vs Gastos', 'Gastos', round(sum(importe_total), 3) FROM invoices WHERE tipo = 'Gasto'
      UNION ALL SELECT 'Importe Total', 'sum', round(sum(importe_total), 3) FROM invoices
      UNION ALL SELECT 'Importe Total', 'mean', round(avg(importe_total), 3) FROM invoices
      UNION ALL SELECT 'Importe Total', 'min', min(importe_total) FROM invoices
      UNION ALL SELECT 'Importe Total', 'max', max(importe_total) FROM invoices
      UNION ALL SELECT 'Distribución por Categoría', key, count FROM ranked WHERE field = 'categoria' AND rank <= 10
      UNION ALL SELECT 'Top 10 Proveedores', CASE WHEN length(key) > 20 THEN key[1:20] || '...' ELSE key END, count
        FROM ranked WHERE field = 'proveedor' AND rank <= 10
      UNION ALL SELECT 'Estado de Facturas', key, count FROM idx WHERE field = 'estado_factura'""",
    "dataset_balance": BASE + """
      SELECT count(*) AS records, count(*) FILTER (tipo = 'Ingreso') AS income_count,
        round(sum(importe_total) FILTER (tipo = 'Ingreso'), 3) AS income_total,
        count(*) FILTER (tipo = 'Gasto') AS expense_count, round(sum(importe_total) FILTER (tipo = 'Gasto'), 3) AS expense_total,
        round(sum(importe_total) FILTER (tipo = 'Ingreso') - sum(importe_total) FILTER (tipo = 'Gasto'), 3) AS net
      FROM invoices""",
    "category_counts": BASE + "SELECT categoria, count(*) AS count FROM invoices GROUP BY categoria",
    "upsert": _BATCHES + "SELECT * FROM updated",
    "update_counts": _BATCHES + """
      SELECT (SELECT count(*) FROM invoices) AS previous_record_count, (SELECT count(*) FROM updated) AS record_count,
        (SELECT count(*) FROM updated) - (SELECT count(*) FROM invoices) AS new_records_added""",
    "keep_last": """
      SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "compare_layers": _CHANGED + "SELECT _row_number, modified_fields <> '' AS modified, modified_fields FROM changed",
    "filter_compare": _CHANGED + "SELECT _row_number FROM changed WHERE categoria = 'Machinery'",
}
