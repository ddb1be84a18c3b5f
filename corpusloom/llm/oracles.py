"""DuckDB statements for the pN_ queries that SQL can express over whole tables."""

_PAGES = """
pg AS (SELECT page_id, url, content FROM (
    SELECT page_id, metadata.url AS url, content, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST) AS rn
    FROM scraped_pages WHERE page_id IS NOT NULL) WHERE rn = 1),
site AS (SELECT page_id, nullif(regexp_extract(lower(url), '^\\s*(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), '') AS site, content FROM pg)
"""

P1_FOUND = f"""
WITH {_PAGES},
ln AS (SELECT page_id, site, u.i - 1 AS line_no, regexp_replace(lower(u.x), '[^\\p{{L}}]+', '', 'g') AS k
       FROM (SELECT page_id, site, string_split(content, chr(10)) AS a FROM site WHERE site IS NOT NULL AND content IS NOT NULL),
            unnest(a) WITH ORDINALITY AS u(x, i)),
need AS (SELECT site, greatest(8, ceil(count(*) * 0.1 - 1e-9)) AS need FROM site WHERE site IS NOT NULL GROUP BY site),
ok AS (SELECT site, k FROM ln WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT page_id) >= (SELECT need FROM need WHERE need.site = ln.site))
SELECT page_id, line_no FROM ln JOIN ok USING (site, k)
"""


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"

P5_FOUND = f"""
WITH {_PAGES},
w AS (SELECT page_id, {_WORDS.format("content")} AS w FROM pg WHERE content IS NOT NULL),
g AS (SELECT page_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS g FROM (SELECT page_id, w, unnest(range(0, len(w) - 5)) AS i FROM w)),
later AS (SELECT page_id, i FROM g QUALIFY i > min(i) OVER (PARTITION BY page_id, g)),
inside AS (SELECT page_id, count(DISTINCT i + j) AS n FROM later, range(6) r(j) GROUP BY page_id)
SELECT page_id FROM inside JOIN w USING (page_id) WHERE n >= 0.25 * len(w)
"""

P8_FOUND = f"""
WITH it AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM it WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
dw AS (SELECT doc_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k, g)
"""

P3_FOUND = f"""
WITH {_PAGES},
rec AS (SELECT DISTINCT row_id, text FROM doc_records WHERE row_id IS NOT NULL),
t AS (SELECT 'scraped_pages' AS src, page_id AS id, {_WORDS.format("content")} AS w FROM pg WHERE content IS NOT NULL
      UNION ALL SELECT 'doc_records', row_id, {_WORDS.format("text")} FROM rec WHERE text IS NOT NULL),
s AS (SELECT DISTINCT src, id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT src, id, w, unnest(range(0, len(w) - 2)) AS i FROM t WHERE len(w) >= 50)),
n AS (SELECT src, id, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS o FROM s a JOIN s b ON a.src = b.src AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT o.src, id_a, id_b FROM o JOIN n x ON x.src = o.src AND x.id = id_a JOIN n y ON y.src = o.src AND y.id = id_b WHERE o >= 0.6 * (x.n + y.n - o)
"""


P5_SHARES = f"""
WITH {_PAGES},
w AS (SELECT page_id, coalesce({_WORDS.format("content")}, []) AS w FROM pg),
g AS (SELECT page_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS g FROM (SELECT page_id, w, unnest(range(0, len(w) - 5)) AS i FROM w)),
later AS (SELECT page_id, i FROM g QUALIFY i > min(i) OVER (PARTITION BY page_id, g)),
inside AS (SELECT page_id, count(DISTINCT i + j) AS n FROM later, range(6) r(j) GROUP BY page_id)
SELECT page_id, len(w)::BIGINT AS words, coalesce(n, 0) AS repeated, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0.0 END AS share
FROM w LEFT JOIN inside USING (page_id)
"""

P8_CLEAN = f"SELECT * REPLACE (scraped_at AT TIME ZONE 'UTC' AS scraped_at, loaded_at AT TIME ZONE 'UTC' AS loaded_at) FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM ({P8_FOUND}))"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_shares": P5_SHARES, "p8_found": P8_FOUND, "p8_clean": P8_CLEAN}
