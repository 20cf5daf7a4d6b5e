"""DuckDB statements of the general training-data problems, over whole tables."""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_ACC = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) = 18 THEN substr(regexp_replace({0}, '[^0-9]', '', 'g'), 1, 10) || '-' || substr(regexp_replace({0}, '[^0-9]', '', 'g'), 11, 2) || '-' || substr(regexp_replace({0}, '[^0-9]', '', 'g'), 13, 6) END"

P1_FOUND = f"""
WITH RECURSIVE f AS (
  SELECT {_ACC.format('accession')} AS accession, min(cik) AS cik, min(fiscal_label) AS fiscal_label, min(filing_date) AS filing_date,
         max(upper(trim(form_type))) AS form_type, max({_ACC.format('amends')}) AS amends
  FROM filings WHERE accession IS NOT NULL GROUP BY 1),
link AS (SELECT a.accession, a.amends AS parent FROM f a JOIN f b ON a.amends = b.accession AND a.accession <> b.accession),
chain AS (SELECT accession, parent, 1 AS depth FROM link
  UNION ALL SELECT c.accession, l.parent, c.depth + 1 FROM chain c JOIN link l ON c.parent = l.accession WHERE c.depth < 60),
root AS (SELECT accession, arg_max(parent, depth) AS root, max(depth) AS depth FROM chain GROUP BY 1 HAVING max(depth) < 60),
y AS (SELECT f.accession, f.cik, f.filing_date, coalesce(g.fiscal_label, f.fiscal_label) AS year,
             CASE WHEN f.form_type = '10-K/A' OR root.root IS NOT NULL THEN 1 ELSE 0 END AS amendment, coalesce(root.depth, 0) AS depth
      FROM f LEFT JOIN root USING (accession) LEFT JOIN f g ON g.accession = root.root),
o AS (SELECT outcome_id, min((day, cik, year)) AS k FROM (
        SELECT outcome_id, try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})([T ].*)?$', 1), '') AS date) AS day, cik, fiscal_label AS year FROM outcomes)
      WHERE day IS NOT NULL AND cik IS NOT NULL AND year IS NOT NULL AND outcome_id IS NOT NULL GROUP BY 1)
SELECT o.outcome_id, arg_max(y.accession, (y.filing_date, y.amendment, y.depth, y.accession)) AS accession
FROM o JOIN y ON y.cik = o.k[2] AND y.year = o.k[3] AND y.filing_date <= o.k[1] GROUP BY 1
"""

P6_FOUND = f"""
WITH r AS (
  SELECT lower(trim(side)) AS side, coalesce({_ACC.format('accession')}, trim(accession)) AS accession, trim(concept_group) AS concept_group,
         try_cast(our_value_usd::varchar AS decimal(38,10)) AS ours,
         try_cast(nullif(CASE WHEN regexp_replace(trim(companyfacts_value), '[,\\s$]', '', 'g') LIKE '(%)'
           THEN '-' || regexp_replace(regexp_replace(trim(companyfacts_value), '[,\\s$]', '', 'g'), '[()]', '', 'g')
           ELSE regexp_replace(trim(companyfacts_value), '[,\\s$]', '', 'g') END, '') AS decimal(38,10)) AS theirs,
         nullif(lower(regexp_replace(trim(matched_concept), '^[A-Za-z0-9-]+[:_]', '')), '') AS matched_concept
  FROM ixbrl_crosscheck),
a AS (SELECT DISTINCT accession, concept_group, ours AS value, matched_concept FROM r WHERE side = 'ours'),
b AS (SELECT DISTINCT accession, concept_group, theirs AS value, matched_concept FROM r WHERE side = 'companyfacts'),
j AS (SELECT coalesce(a.accession, b.accession) AS accession, coalesce(a.concept_group, b.concept_group) AS concept_group,
        a.accession IS NULL AS no_a, b.accession IS NULL AS no_b, a.value AS va, b.value AS vb, a.matched_concept AS ma, b.matched_concept AS mb
      FROM a FULL JOIN b ON a.accession = b.accession AND a.concept_group = b.concept_group)
SELECT accession, concept_group, 'only_ours' AS difference FROM j WHERE no_b
UNION ALL SELECT accession, concept_group, 'only_companyfacts' FROM j WHERE no_a
UNION ALL SELECT accession, concept_group, 'value' FROM j WHERE NOT no_a AND NOT no_b AND va IS DISTINCT FROM vb
UNION ALL SELECT accession, concept_group, 'matched_concept' FROM j WHERE NOT no_a AND NOT no_b AND ma IS DISTINCT FROM mb
"""

#: Records, cells and precision shared by problems 2, 3 and 5.
_RECORDS = """
r AS (
  SELECT id, trim(accession) AS accession, unit, start_date, end_date, trim(regexp_replace(concept, '^.*:', '')) AS concept, value, value_text,
         CASE WHEN upper(trim(decimals)) = 'INF' THEN 10000 ELSE try_cast(nullif(trim(decimals), '') AS int) END AS rank,
         CASE WHEN trim(context_id) <> '' THEN context_id END AS context_id, CASE WHEN trim(source_doc) <> '' THEN source_doc END AS source_doc,
         CASE WHEN trim(element_id) <> '' THEN element_id END AS element_id
  FROM facts WHERE (value IS NOT NULL OR value_text IS NOT NULL) AND id IS NOT NULL AND accession IS NOT NULL AND concept IS NOT NULL),
h AS (SELECT *, CASE WHEN rank >= 10 THEN 0::decimal(38,10) WHEN rank < -26 THEN repeat('9', 28)::decimal(38,10) ELSE try_cast('5E' || (-(rank + 1))::varchar AS decimal(38,10)) END AS half FROM r)"""

_CELLS = f"""{_RECORDS},
b AS (SELECT *, first_value(value) OVER w AS bv, first_value(value_text) OVER w AS bt, first_value(half) OVER w AS bh, first_value(unit) OVER w AS bu, first_value(start_date) OVER w AS bs, first_value(rank) OVER w AS br
      FROM h WINDOW w AS (PARTITION BY accession, end_date, concept ORDER BY rank DESC NULLS LAST, id)),
cell AS (
  SELECT accession, end_date, concept, any_value(bv) AS value, any_value(br) AS rank, any_value(bt) AS value_text, any_value(bh) AS half FROM b GROUP BY 1, 2, 3
  HAVING bool_and(unit IS NOT DISTINCT FROM bu AND start_date IS NOT DISTINCT FROM bs AND coalesce(
    (value IS NOT DISTINCT FROM bv AND value_text IS NOT DISTINCT FROM bt) OR abs(value - bv) <= half + bh, false)))"""

P3_FOUND = f"WITH {_CELLS} SELECT accession, strftime(end_date, '%Y-%m-%d') AS end_date, concept FROM cell"

P5_FOUND = "WITH RECURSIVE " + P1_FOUND.split("WITH RECURSIVE ")[1].split("o AS (SELECT outcome_id")[0] + _CELLS.strip() + """,
s AS (SELECT y.cik, cell.concept, cell.end_date, cell.accession, cell.value, cell.half,
        row_number() OVER (PARTITION BY y.cik, cell.concept, cell.end_date ORDER BY y.filing_date, y.amendment, y.depth, y.accession) AS n
      FROM cell JOIN y ON y.accession = cell.accession WHERE cell.value IS NOT NULL AND y.cik IS NOT NULL AND y.filing_date IS NOT NULL),
walk AS (
  SELECT cik, concept, end_date, n, accession, value, half, true AS opens FROM s WHERE n = 1
  UNION ALL
  SELECT s.cik, s.concept, s.end_date, s.n, s.accession, CASE WHEN same THEN walk.value ELSE s.value END, CASE WHEN same THEN walk.half ELSE s.half END, NOT same
  FROM walk JOIN s ON s.cik = walk.cik AND s.concept = walk.concept AND s.end_date IS NOT DISTINCT FROM walk.end_date AND s.n = walk.n + 1,
       LATERAL (SELECT s.value = walk.value OR coalesce(abs(s.value - walk.value) <= s.half + walk.half, false) AS same))
SELECT cik, concept, strftime(end_date, '%Y-%m-%d') AS end_date, accession,
       coalesce(lead(accession) OVER (PARTITION BY cik, concept, end_date ORDER BY n), '') AS closed_by
FROM walk WHERE opens
"""

_KIND = """CASE WHEN value IS NOT NULL THEN 'number' WHEN regexp_matches(trim(value_text), '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(trim(value_text) AS date) IS NOT NULL THEN 'date'
  WHEN lower(trim(value_text)) IN ('true', 'false') THEN 'boolean' ELSE 'text' END"""

P3_COLUMNS = f"WITH {_CELLS} SELECT concept, {_KIND} AS kind, count(*) AS cells FROM cell GROUP BY 1, 2"

P3_WIDE = f"""WITH {_CELLS}, k AS (SELECT *, {_KIND} AS kind FROM cell)
SELECT accession, end_date, (max(value) FILTER (WHERE concept = 'Assets' AND kind = 'number'))::varchar::double AS "Assets", (max(value) FILTER (WHERE concept = 'Liabilities' AND kind = 'number'))::varchar::double AS "Liabilities",
  (max(value) FILTER (WHERE concept = 'Revenues' AND kind = 'number'))::varchar::double AS "Revenues", (max(value) FILTER (WHERE concept = 'NetIncomeLoss' AND kind = 'number'))::varchar::double AS "NetIncomeLoss",
  max(value_text) FILTER (WHERE concept = 'EntityRegistrantName' AND kind = 'text') AS "EntityRegistrantName",
  bool_or(lower(trim(value_text)) = 'true') FILTER (WHERE concept = 'AmendmentFlag' AND kind = 'boolean') AS "AmendmentFlag",
  max(try_cast(trim(value_text) AS date)) FILTER (WHERE concept = 'DocumentPeriodEndDate' AND kind = 'date') AS "DocumentPeriodEndDate"
FROM k GROUP BY 1, 2"""

SQL = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_wide": P3_WIDE, "p3_columns": P3_COLUMNS, "p5_found": P5_FOUND, "p6_found": P6_FOUND}
