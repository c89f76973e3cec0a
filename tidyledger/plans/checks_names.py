"""Oracle SQL (DuckDB dialect) for name similarity and clustering.

The longest common subsequence is computed bit by bit with integer arithmetic
in a list fold; the sequential clustering is a recursive query over the ranks.
"""

from tidyledger.plans.checks_cleaning import BASE

# Bit-parallel LCS of lower-case texts {a} (up to 120 characters) and {b}.
_LCS = """
  length({a}) - bit_count(list_reduce(
    list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1),
      lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << CAST(i - 1 AS INT) ELSE 0::HUGEINT END))::HUGEINT),
    lambda v, m: (((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << CAST(length({a}) AS INT)) - 1)),
    ((1::HUGEINT << CAST(length({a}) AS INT)) - 1)))"""


def ratio(a: str, b: str) -> str:
    lcs = _LCS.format(a=a, b=b)
    return (f"CAST(round_even((1.0::DOUBLE - (length({a}) + length({b}) - 2 * ({lcs}))::DOUBLE "
            f"/ (length({a}) + length({b}))) * 100.0::DOUBLE, 0) AS BIGINT)")


def clusters(source: str, p: str = "") -> str:
    """CTEs for the sequential clustering of ``source`` (value, n), all values ranked and walked in order; ``p`` starts their names."""
    return f"""
, {p}ranked AS MATERIALIZED (
  SELECT value, n, lower(value) AS low, row_number() OVER (ORDER BY n DESC, length(value) DESC, value) AS r
  FROM ({source})
), {p}pairs AS (
  SELECT a.r AS ra, b.r AS rb, {ratio('a.low', 'b.low')} AS sim FROM {p}ranked a JOIN {p}ranked b ON a.r <= b.r
), {p}near AS MATERIALIZED (SELECT rb, map_from_entries(list((ra, sim))) AS sims FROM {p}pairs WHERE sim >= 75 GROUP BY rb
), {p}walk AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS leaders, 0::BIGINT AS leader, 0::BIGINT AS sim
  UNION ALL
  SELECT w.r + 1,
    CASE WHEN len(list_filter(w.leaders, lambda l: map_contains(n.sims, l))) = 0
      THEN list_append(w.leaders, w.r + 1) ELSE w.leaders END,
    coalesce(list_filter(w.leaders, lambda l: map_contains(n.sims, l))[1], w.r + 1),
    coalesce(n.sims[list_filter(w.leaders, lambda l: map_contains(n.sims, l))[1]], 100)
  FROM {p}walk w JOIN {p}near n ON n.rb = w.r + 1
), {p}clustered AS (
  SELECT v.value, v.n, v.low, l.value AS leader, w.sim AS similarity
  FROM {p}walk w JOIN {p}ranked v ON v.r = w.r JOIN {p}ranked l ON l.r = w.leader WHERE w.r > 0
), {p}grouped AS (
  SELECT leader, count(*) AS size, CAST(sum(n) AS BIGINT) AS records, arg_max(value, (n, length(value), low)) AS canonical,
    min(similarity) FILTER (value <> leader) AS similarity
  FROM {p}clustered GROUP BY leader HAVING count(*) > 1
)"""


_NAMES = "SELECT p_name AS value, count(*) AS n FROM part WHERE p_name <> '' GROUP BY 1"
_WITH = "WITH RECURSIVE start AS (SELECT 1)" + clusters(_NAMES)
_LONG = BASE.replace("WITH base", "WITH RECURSIVE base", 1) + """
, long_names AS (
  SELECT CASE WHEN _row_number % 3 = 0 THEN name[1:length(name) - 1] ELSE name END AS proveedor, categoria, importe_total
  FROM (SELECT *, proveedor || ' ' || proveedor || ' ' || proveedor AS name FROM invoices))""" + clusters(
    "SELECT proveedor AS value, count(*) AS n FROM long_names GROUP BY 1", "s_") + clusters(
    "SELECT categoria AS value, count(*) AS n FROM long_names GROUP BY 1", "c_")

SQL = {
    "dense_names": "WITH RECURSIVE start AS (SELECT 1)" + clusters("SELECT s_name AS value, count(*) AS n FROM supplier GROUP BY 1") + """
      SELECT leader, count(*) AS size, min(similarity) AS weakest FROM clustered GROUP BY leader""",
    "dedupe_records": _LONG + """
      SELECT coalesce(s.canonical, x.proveedor) AS proveedor, coalesce(c.canonical, x.categoria) AS categoria,
        count(*) AS n, round(sum(importe_total), 2) AS total
      FROM long_names x
      LEFT JOIN (SELECT value, canonical FROM s_clustered JOIN s_grouped g USING (leader) WHERE g.similarity >= 95) s
        ON s.value = x.proveedor
      LEFT JOIN (SELECT value, canonical FROM c_clustered JOIN c_grouped g USING (leader) WHERE g.similarity >= 95) c
        ON c.value = x.categoria
      GROUP BY 1, 2""",
    "dedupe_stats": _LONG + """
      SELECT field, CASE WHEN similarity >= 95 THEN 'merge' ELSE 'review' END AS grade, count(*) AS groups
      FROM (SELECT 'proveedor' AS field, similarity FROM s_grouped UNION ALL SELECT 'categoria', similarity FROM c_grouped)
      GROUP BY 1, 2""",
    "name_similarity": f"""
      SELECT p_partkey, {ratio('name', 'kind')} AS to_type, {ratio('name', 'other')} AS to_other
      FROM (SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS kind,
        lower(reverse(p_name) || ' ' || p_type) AS other FROM part)""",
    "similar_names": _WITH + "SELECT value, n, leader, similarity FROM clustered",
    "similar_names_small_blocks": _WITH + "SELECT value, n, leader, similarity FROM clustered",
    "name_groups": _WITH + """
      SELECT leader, canonical, size, records, similarity,
        CASE WHEN similarity >= 95 THEN 'merge' ELSE 'review' END AS grade FROM grouped""",
    "review_summary": _WITH + "SELECT count(*) AS total_groups, count(*) AS pending_groups FROM grouped WHERE similarity < 99",
    "review_decisions": _WITH + """
      SELECT CASE WHEN size > 3 THEN canonical ELSE upper(canonical) END AS canonical, round(similarity / 100.0, 2)::DOUBLE AS similarity,
        CASE WHEN size > 3 THEN 'rejected' ELSE 'approved' END AS status FROM grouped WHERE similarity < 99""",
    "review_approve_above": _WITH + """
      SELECT canonical, round(similarity / 100.0, 2)::DOUBLE AS similarity,
        CASE WHEN similarity >= 80 THEN 'approved' ELSE 'pending' END AS status FROM grouped WHERE similarity < 99""",
    "review_replay": _WITH + """
      SELECT coalesce(g.canonical, c.value) AS p_name, CAST(sum(c.n) AS BIGINT) AS n
      FROM clustered c LEFT JOIN grouped g ON g.leader = c.leader AND g.similarity < 99 GROUP BY 1""",
    "review_lineage": """
      WITH RECURSIVE c AS (
        SELECT c_custkey, c_name, c_nationkey, n_regionkey,
          lag(c_name) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS before
        FROM customer JOIN nation ON n_nationkey = c_nationkey),
      nations AS (SELECT c_nationkey, min(c_custkey) AS k, arg_min(c_name, c_custkey) AS of_nation FROM c GROUP BY 1),
      regions AS (SELECT n_regionkey, arg_min(c_name, c_custkey) AS of_region FROM c GROUP BY 1),
      log AS (
        SELECT c_name AS value, before AS canonical, 1 AS round FROM c
        UNION ALL SELECT c_name, of_nation, 2 FROM c JOIN nations USING (c_nationkey) WHERE before IS NULL OR c_custkey % 7 = 0
        UNION ALL SELECT c_name, of_region, 3 FROM c JOIN nations USING (c_nationkey) JOIN regions USING (n_regionkey)
          WHERE c_custkey = k),
      parent AS (SELECT value, canonical FROM log WHERE value <> canonical
        QUALIFY row_number() OVER (PARTITION BY value ORDER BY round DESC, canonical) = 1),
      walk AS (SELECT value, canonical, 1::BIGINT AS steps FROM parent
        UNION ALL SELECT w.value, p.canonical, steps + 1 FROM walk w JOIN parent p ON p.value = w.canonical)
      SELECT value, canonical, steps FROM walk QUALIFY row_number() OVER (PARTITION BY value ORDER BY steps DESC) = 1""",
}
