"""DuckDB statements of the text problems, over whole tables."""

from ..plans.training_sql import _ACC as ACCESSION
from ..plans.training_sql import _RECORDS as RECORDS

P2_FOUND = f"""
WITH RECURSIVE {RECORDS},
g AS (SELECT *, dense_rank() OVER (ORDER BY accession, unit, start_date, end_date, concept) AS grp FROM h),
todo AS (
  SELECT 1 AS step, grp, id, rank, value, value_text, half, first_value(id) OVER w AS best, coalesce(
           (value IS NOT DISTINCT FROM first_value(value) OVER w AND value_text IS NOT DISTINCT FROM first_value(value_text) OVER w)
           OR abs(value - first_value(value) OVER w) <= half + first_value(half) OVER w, false) AS dup
  FROM g WINDOW w AS (PARTITION BY grp ORDER BY rank DESC NULLS LAST, id)
  UNION ALL
  SELECT step + 1, grp, id, rank, value, value_text, half, first_value(id) OVER w, coalesce(
           (value IS NOT DISTINCT FROM first_value(value) OVER w AND value_text IS NOT DISTINCT FROM first_value(value_text) OVER w)
           OR abs(value - first_value(value) OVER w) <= half + first_value(half) OVER w, false)
  FROM todo WHERE NOT dup WINDOW w AS (PARTITION BY grp ORDER BY rank DESC NULLS LAST, id)),
m AS (SELECT best AS kept_id, id, rank FROM todo WHERE dup),
o AS (SELECT m.kept_id, h.*, row_number() OVER (PARTITION BY m.kept_id ORDER BY h.rank DESC NULLS LAST, h.id) AS pos FROM m JOIN h USING (id))
SELECT kept_id, arg_min(context_id, pos) FILTER (WHERE context_id IS NOT NULL) AS context_id, arg_min(source_doc, pos) FILTER (WHERE source_doc IS NOT NULL) AS source_doc,
       arg_min(element_id, pos) FILTER (WHERE element_id IS NOT NULL) AS element_id
FROM o GROUP BY kept_id HAVING count(*) > 1
"""

P2_LATEST = f"""WITH RECURSIVE {RECORDS},
l AS (SELECT {ACCESSION.format('accession')} AS accession, min(cik) AS cik, min(filing_date) AS filing_date FROM filings GROUP BY 1),
d AS (SELECT l.cik, r.concept, r.value_text, l.filing_date FROM r JOIN l USING (accession) WHERE r.value_text IS NOT NULL AND l.cik IS NOT NULL),
k AS (SELECT cik, concept, filing_date, min(value_text) AS newer FROM d WHERE filing_date IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT concept, lag(newer) OVER (PARTITION BY cik, concept ORDER BY filing_date) AS older, newer FROM k),
m AS (SELECT concept, older, newer, count(*) AS support FROM t WHERE older <> newer GROUP BY 1, 2, 3),
p AS (SELECT m.* FROM m LEFT JOIN m b ON b.concept = m.concept AND b.older = m.newer AND b.newer = m.older WHERE b.support IS NULL OR m.support > b.support),
reach AS (SELECT concept, older, newer FROM p UNION SELECT reach.concept, reach.older, p.newer FROM reach JOIN p ON p.concept = reach.concept AND p.older = reach.newer),
before AS (SELECT concept, older, newer FROM reach EXCEPT SELECT concept, newer, older FROM reach),
held AS (SELECT DISTINCT cik, concept, value_text AS v FROM d),
e AS (SELECT a.cik, a.concept, a.v AS older, b.v AS newer FROM held a JOIN before USING (concept) JOIN held b ON b.cik = a.cik AND b.concept = a.concept AND b.v = before.newer WHERE before.older = a.v),
follows AS (SELECT cik, concept, newer AS v, count(*) AS s FROM e GROUP BY 1, 2, 3)
SELECT cik, concept, arg_min(v, (-coalesce(s, 0), v)) AS latest FROM held LEFT JOIN follows USING (cik, concept, v) WHERE (cik, concept, v) NOT IN (SELECT cik, concept, older FROM e) GROUP BY 1, 2"""

SQL = {"p2_found": P2_FOUND, "p2_latest": P2_LATEST}
