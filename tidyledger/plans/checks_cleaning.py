"""Oracle SQL (DuckDB dialect) for cleaning and validation.

Dirty rows are made from clean values, so the expected result of cleaning is
written from the clean values and the style that was applied, without parsing
any text.
"""

BASE = """
WITH base AS (
  SELECT o_orderkey AS k, o_orderkey + 2 AS _row_number,
    CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(o_orderdate AS DATE) AS fecha,
    coalesce(p_name, 'part ' || o_custkey) AS p_name,
    c_mktsegment AS segment, substr('ABCDEFGH', CAST(o_custkey % 8 + 1 AS INT), 1) AS letter,
    lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(8, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') AS digits,
    CASE WHEN o_orderkey % 2 = 1 THEN 'Gasto' ELSE 'Ingreso' END AS tipo,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS total_c,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) // 5 AS iva_c,
    CASE o_orderstatus WHEN 'F' THEN 'Pagada' WHEN 'O' THEN 'Pendiente'
      ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Vencida' ELSE 'Parcialmente Pagada' END END AS estado_factura
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = o_custkey
), invoices AS (
  SELECT _row_number, 'FAC-' || y || '-' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INT), '0') AS num_factura,
    fecha,
    list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS proveedor,
    letter || digits AS nif_cif, tipo,
    upper(segment[1]) || lower(segment[2:]) AS categoria,
    CAST(total_c - iva_c AS DOUBLE) / 100 AS importe_base, CAST(iva_c AS DOUBLE) / 100 AS iva,
    CAST(total_c AS DOUBLE) / 100 AS importe_total, estado_factura,
    CASE estado_factura WHEN 'Pagada' THEN 0.0::DOUBLE
      WHEN 'Parcialmente Pagada' THEN CAST(total_c AS DOUBLE) / 100 * 0.5::DOUBLE
      ELSE CAST(total_c AS DOUBLE) / 100 END AS importe_pendiente, k
  FROM base
)
"""

# What cleaning the dirty rows must give, and the number of errors each row must have.
CLEANED = BASE + """
, expected AS (
  SELECT i._row_number, i.k,
    CASE WHEN i.k % 50 = 49 THEN '' ELSE num_factura END AS num_factura,
    CASE WHEN i.k % 40 = 39 THEN NULL ELSE i.fecha END AS fecha,
    CASE WHEN i.k % 61 = 60 THEN '' ELSE proveedor END AS proveedor,
    CASE WHEN i.k % 4 = 2 THEN b.digits ELSE nif_cif END AS nif_cif,
    CASE WHEN i.k % 53 = 52 THEN 'Otro' ELSE i.tipo END AS tipo, categoria, importe_base, iva,
    CASE WHEN i.k % 45 = 44 THEN NULL WHEN i.k % 44 = 43 THEN -importe_total ELSE importe_total END AS importe_total,
    CASE WHEN i.k % 59 = 58 THEN 'En Disputa' ELSE i.estado_factura END AS estado_factura
  FROM invoices i JOIN base b ON b.k = i.k
), cleaned AS (
  SELECT *, CASE
      WHEN k % 5 = 1 THEN (SELECT CAST(b.total_c AS DOUBLE) / 100 FROM base b WHERE b.k = expected.k)
      WHEN k % 5 = 2 THEN 0.0::DOUBLE
      WHEN importe_total IS NULL THEN 0.0::DOUBLE
      WHEN estado_factura = 'Pagada' THEN 0.0::DOUBLE
      WHEN estado_factura IN ('Pendiente', 'Vencida') THEN importe_total
      WHEN estado_factura = 'Parcialmente Pagada' THEN importe_total * 0.5::DOUBLE
      ELSE 0.0::DOUBLE END AS importe_pendiente
  FROM expected
), judged AS (
  SELECT *,
    CAST((num_factura = '')::INT + (fecha IS NULL)::INT + (proveedor = '')::INT + (tipo = 'Otro')::INT
      + (importe_total IS NULL OR importe_total < 0)::INT + (importe_pendiente < 0)::INT AS BIGINT) AS n_errors
  FROM cleaned
)
"""

SQL = {
    "clean_text_fields": CLEANED + """
      SELECT _row_number, num_factura, proveedor, nif_cif, tipo, categoria, estado_factura FROM cleaned""",
    "clean_currency": CLEANED + """
      SELECT _row_number, importe_base, iva, importe_total, k % 45 = 44 AS total_unreadable FROM cleaned""",
    "clean_dates": CLEANED + "SELECT _row_number, fecha FROM cleaned",
    "clean_table": CLEANED + """
      SELECT _row_number, num_factura, fecha, proveedor, nif_cif, tipo, categoria, importe_base, iva,
        importe_total, estado_factura, importe_pendiente FROM cleaned""",
    "strip_whitespace": CLEANED + """
      SELECT _row_number, CASE WHEN k % 61 = 60 THEN '' WHEN k % 4 = 1 THEN upper(proveedor)
        WHEN k % 4 = 3 THEN proveedor ELSE lower(proveedor) END AS proveedor,
        CASE k % 3 WHEN 0 THEN upper(categoria) WHEN 1 THEN lower(categoria) ELSE categoria END AS categoria
      FROM cleaned""",
    "enum_words": CLEANED + "SELECT tipo, estado_factura, count(*) AS n FROM cleaned GROUP BY 1, 2",
    "derive_pending": CLEANED + """
      SELECT _row_number, estado_factura, importe_pendiente FROM cleaned""",
    "consistency_warnings": CLEANED + """
      SELECT _row_number, CAST((estado_factura = 'Pagada' AND importe_pendiente > 0)::INT
        + (estado_factura = 'Pendiente' AND importe_pendiente = 0)::INT AS BIGINT) AS n_warnings FROM cleaned""",
    "custom_rule": CLEANED + """
      SELECT categoria, proveedor, count(*) AS n
      FROM (SELECT upper(categoria) AS categoria, replace(proveedor, ' ', '_') AS proveedor FROM cleaned)
      GROUP BY 1, 2""",
    "validate_table": CLEANED + """
      SELECT _row_number, CASE WHEN n_errors = 0 THEN 'valid' ELSE 'invalid' END AS status, n_errors,
        concat_ws(',', CASE WHEN num_factura = '' THEN 'num_factura' END, CASE WHEN fecha IS NULL THEN 'fecha' END,
          CASE WHEN proveedor = '' THEN 'proveedor' END, CASE WHEN tipo = 'Otro' THEN 'tipo' END,
          CASE WHEN importe_total IS NULL OR importe_total < 0 THEN 'importe_total' END,
          CASE WHEN importe_pendiente < 0 THEN 'importe_pendiente' END) AS fields
      FROM judged""",
    "dynamic_spec": CLEANED + """
      SELECT field, message, count(*) AS n FROM (
        SELECT 'num_factura' AS field, 'Text should have at most 13 characters' AS message FROM cleaned
          WHERE length(num_factura) > 13
        UNION ALL SELECT 'importe_total', 'Input should be less than or equal to 250000' FROM cleaned
          WHERE importe_total > 250000
        UNION ALL SELECT 'importe_total', 'Input should be a valid float' FROM cleaned WHERE importe_total IS NULL
        UNION ALL SELECT 'estado_factura', 'Input should be one of: Pagada, Pendiente, Vencida' FROM cleaned
          WHERE estado_factura NOT IN ('Pagada', 'Pendiente', 'Vencida')
        UNION ALL SELECT 'codigo', 'Field required' FROM cleaned)
      GROUP BY 1, 2""",
    "route_records": CLEANED + """
      SELECT CASE WHEN n_errors = 0 THEN 'clean' ELSE 'rejected' END AS route, count(*) AS n,
        CAST(sum(CAST(k AS HUGEINT)) AS BIGINT) AS key_sum FROM judged GROUP BY 1""",
    "error_log": CLEANED + """
      SELECT field, message, count(*) AS n, min(_row_number) AS first_row, max(_row_number) AS last_row FROM (
        SELECT _row_number, 'num_factura' AS field, 'Text should have at least 1 characters' AS message FROM cleaned WHERE num_factura = ''
        UNION ALL SELECT _row_number, 'fecha', 'Input should be a valid date' FROM cleaned WHERE fecha IS NULL
        UNION ALL SELECT _row_number, 'proveedor', 'Text should have at least 1 characters' FROM cleaned WHERE proveedor = ''
        UNION ALL SELECT _row_number, 'tipo', 'Input should be one of: Ingreso, Gasto' FROM cleaned WHERE tipo = 'Otro'
        UNION ALL SELECT _row_number, 'importe_total', 'Input should be a valid float' FROM cleaned WHERE importe_total IS NULL
        UNION ALL SELECT _row_number, 'importe_total', 'Input should be greater than or equal to 0' FROM cleaned WHERE importe_total < 0
        UNION ALL SELECT _row_number, 'importe_pendiente', 'Input should be greater than or equal to 0' FROM cleaned WHERE importe_pendiente < 0)
      GROUP BY 1, 2""",
    "silver_stats": CLEANED + """
      SELECT count(*) AS total_records, count(*) FILTER (n_errors = 0) AS valid_records,
        count(*) FILTER (n_errors > 0) AS invalid_records, 0::BIGINT AS corrected_records, 0::BIGINT AS review_records,
        round(count(*) FILTER (n_errors = 0)::DOUBLE / count(*), 6) AS valid_rate FROM judged""",
    "parse_corrections": CLEANED + """
      SELECT _row_number, k % 6 <> 5 AS success,
        CASE WHEN k % 6 <> 5 THEN strftime(DATE '2024-01-15', '%Y-%m-%d') END AS corrected_fecha,
        CASE WHEN k % 6 <> 5 THEN CASE WHEN k % 6 = 4 THEN 0.5 WHEN k % 2 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE END AS confidence,
        CASE WHEN k % 6 <> 5 THEN 1::BIGINT END AS n_corrections,
        CASE WHEN k % 6 <> 5 THEN CASE WHEN k % 6 = 4 THEN '' ELSE 'looked {odd}' END END AS reasoning
      FROM judged""",
    "apply_corrections": CLEANED + """
      , outcome AS (
        SELECT *, k % 6 <> 5 AS success, CASE WHEN k % 6 = 4 THEN 0.5 WHEN k % 2 = 0 THEN 0.9 ELSE 0.6 END AS confidence,
          n_errors - (fecha IS NULL)::INT = 0 AS passes FROM judged)
      SELECT _row_number,
        CASE WHEN n_errors = 0 THEN 'valid' WHEN NOT (success AND passes) THEN 'invalid'
          WHEN confidence < 0.7 THEN 'manual_review' ELSE 'llm_corrected' END AS status,
        CASE WHEN n_errors > 0 AND success AND passes THEN DATE '2024-01-15' ELSE fecha END AS fecha,
        CASE WHEN n_errors > 0 AND success AND passes THEN 0 ELSE n_errors END::BIGINT AS n_errors
      FROM outcome""",
    "flagship": CLEANED + ", ok AS (SELECT * FROM judged WHERE n_errors = 0) " + " UNION ALL ".join(
        f"SELECT '{s}' AS segment_field, {s} AS segment, count(*) AS count, "
        "CAST(sum(CAST(importe_total AS DECIMAL(18,3))) AS DOUBLE) AS importe_total_sum, "
        "CAST(sum(CAST(importe_pendiente AS DECIMAL(18,3))) AS DOUBLE) AS importe_pendiente_sum FROM ok GROUP BY 2"
        for s in ("tipo", "estado_factura", "categoria", "proveedor")),
}
