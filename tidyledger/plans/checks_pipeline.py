"""Oracle SQL (DuckDB dialect) for the pipeline."""

from tidyledger.plans.checks_cleaning import BASE, CLEANED
from tidyledger.plans.checks_names import clusters

_VALID = CLEANED + ", ok AS (SELECT * FROM judged WHERE n_errors = 0)"

_FIGURES = {"count": "count({f})", "sum": "sum({f})", "mean": "avg({f})", "median": "median({f})", "min": "min({f})",
            "max": "max({f})", "std": "coalesce(stddev_samp({f}), 0)"}
_AMOUNTS = ("importe_total", "importe_pendiente")
_PAID = BASE + """
, updated AS (
  SELECT categoria, 'Pagada' AS estado_factura, importe_total,
    CASE WHEN estado_factura <> 'Pagada' THEN 0.0 ELSE importe_pendiente END::DOUBLE AS importe_pendiente FROM invoices
) """ + " UNION ALL ".join(
    [f"SELECT 'statistics' AS section, '{f}' AS item, '{name}' AS metric, round({figure.format(f=f)}::DOUBLE, 2) AS value FROM updated"
     for f in _AMOUNTS for name, figure in _FIGURES.items()]
    + [f"SELECT 'index', '{f}', {f}, count(*)::DOUBLE FROM updated GROUP BY {f}" for f in ("categoria", "estado_factura")]
    + [f"SELECT 'segments', '{s}=' || coalesce({s}, 'N/A'), '{metric}', round(({figure})::DOUBLE, 2) FROM updated GROUP BY {s}"
       for s in ("categoria", "estado_factura")
       for metric, figure in [("count", "count(*)")] + [(f"{f}_{n}", f"{g}({f})") for f in _AMOUNTS for n, g in (("sum", "sum"), ("mean", "avg"))]])

_MERGED = CLEANED.replace("WITH base", "WITH RECURSIVE base", 1) + """
, named AS (
  SELECT * REPLACE (CASE WHEN proveedor <> '' AND _row_number % 3 = 0 THEN long[1:length(long) - 1]
    WHEN proveedor <> '' THEN long ELSE '' END AS proveedor)
  FROM (SELECT *, proveedor || ' ' || proveedor || ' ' || proveedor AS long FROM judged))""" + "".join(
    clusters(f"SELECT {f} AS value, count(*) AS n FROM named WHERE {f} <> '' GROUP BY 1", p)
    for f, p in (("proveedor", "s_"), ("categoria", "c_"))) + """
, graded AS (SELECT similarity FROM s_grouped UNION ALL SELECT similarity FROM c_grouped)"""

SQL = {
    "pipeline_segments": _VALID + " UNION ALL ".join(
        f"SELECT '{s}' AS segment_field, {s} AS segment, count(*) AS count, round(sum(importe_total), 2) AS total FROM ok GROUP BY 2"
        for s in ("tipo", "estado_factura", "categoria", "proveedor")),
    "pipeline_report": CLEANED + """
      SELECT count(*) AS row_count, count(*) AS total_records, count(*) FILTER (n_errors = 0) AS valid_records,
        count(*) FILTER (n_errors > 0) AS invalid_records, count(*) FILTER (n_errors = 0) AS record_count,
        0::BIGINT AS corrected_records, 0::BIGINT AS review_records, 0::BIGINT AS merged_groups, 0::BIGINT AS review_groups,
        round(count(*) FILTER (n_errors = 0) / count(*), 6) AS valid_rate,
        'num_factura,fecha,proveedor,nif_cif,tipo,categoria,importe_base,iva,importe_total,estado_factura,importe_pendiente' AS column_names,
        'importe_base,importe_pendiente,importe_total,iva' AS statistics_fields,
        'categoria,estado_factura,fecha,proveedor,tipo' AS index_fields FROM judged""",
    "pipeline_merged": _MERGED + """
      SELECT coalesce(s.canonical, proveedor) AS segment, count(*) AS count, round(sum(importe_total), 2) AS total,
        (SELECT count(*) FROM graded WHERE similarity >= 95) AS merged_groups,
        (SELECT count(*) FROM graded WHERE similarity < 95) AS review_groups
      FROM named LEFT JOIN (
        SELECT value, canonical FROM s_clustered JOIN s_grouped g USING (leader) WHERE g.similarity >= 95) s ON s.value = proveedor
      WHERE n_errors = 0 GROUP BY 1""",
    "pipeline_hooks": CLEANED + """
      SELECT CASE WHEN n_errors = 0 THEN 'valid' ELSE 'invalid' END AS status, count(*) AS n,
        count(*) FILTER (abs(importe_base + iva - importe_total) > 0.01) AS warned
      FROM judged WHERE categoria = 'Machinery' GROUP BY 1""",
    "stream_gold": _PAID,
    "stream_upsert": BASE + "SELECT num_factura, _row_number, 'Pagada' AS estado_factura FROM invoices",
}
