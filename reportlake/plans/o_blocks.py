"""Oracle SQL: block operators."""

from reportlake.plans.oracle import oracle

oracle("block_defaults", """
SELECT template_id, block_idx, coalesce(type, 'table') AS type,
  coalesce(title, 'Element ' || CAST(block_idx + 1 AS VARCHAR)) AS title,
  coalesce(description, '') AS description, coalesce(width, 'full') AS width,
  CAST(CASE WHEN coalesce(type, 'table') = 'history' THEN coalesce(days, 7)
            WHEN coalesce(type, 'table') = 'trend_summary' THEN 31 END AS INT) AS days,
  zone_id, coalesce(query, '') AS query, coalesce(show_legend, true) AS show_legend, chart_height,
  CASE WHEN coalesce(width, 'full') = 'full' THEN 1.0::DOUBLE ELSE 0.48::DOUBLE END AS width_fraction
FROM fx_blocks_full""")

# Independent formulation: island = count of non-half blocks so far; the
# position inside the island decides left/right; rows counted per block.
oracle("pair_half_blocks", """
WITH b AS (
  SELECT template_id, block_idx, coalesce(width, 'full') = 'half' AS half,
    sum(CASE WHEN coalesce(width, 'full') = 'half' THEN 0 ELSE 1 END)
      OVER (PARTITION BY template_id ORDER BY block_idx) AS island,
    lead(coalesce(width, 'full') = 'half') OVER (PARTITION BY template_id ORDER BY block_idx) AS next_half
  FROM fx_blocks),
p AS (
  SELECT *, CASE WHEN half THEN row_number() OVER (PARTITION BY template_id, island, half ORDER BY block_idx) END AS hpos
  FROM b),
s AS (
  SELECT template_id, block_idx,
    CASE WHEN NOT half THEN 'full' WHEN hpos % 2 = 1 THEN CASE WHEN coalesce(next_half, false) THEN 'left' ELSE 'alone' END
         ELSE 'right' END AS slot
  FROM p)
SELECT template_id, block_idx,
  CAST(sum(CASE WHEN slot = 'right' THEN 0 ELSE 1 END) OVER (PARTITION BY template_id ORDER BY block_idx) - 1 AS INT)
    AS layout_row, slot
FROM s""")

oracle("block_violations", """
SELECT template_id, block_idx, rule FROM (
  SELECT template_id, block_idx, 'days' AS rule, 0 AS o FROM fx_blocks_full
    WHERE type = 'history' AND days IS NOT NULL AND NOT days BETWEEN 1 AND 31
  UNION ALL
  SELECT template_id, block_idx, 'chart_height', 1 FROM fx_blocks_full
    WHERE chart_height IS NOT NULL AND (NOT chart_height BETWEEN 200 AND 800 OR chart_height % 50 <> 0))""")
