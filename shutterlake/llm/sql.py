"""SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from shutterlake.plans.sql import vector

CURRENT = """
current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY analyzed_at DESC) AS rn FROM file_cache WHERE file_id IS NOT NULL) WHERE rn = 1)
"""


def _digest(c: str) -> str:
    return f"nullif(nullif(lower(regexp_extract({c}, '[0-9a-fA-F]{{64}}')), ''), '{'0' * 64}')"


def _hash(c: str) -> str:
    return f"nullif(CASE WHEN regexp_matches(trim({c}), '^[0-9a-fA-F]{{1,16}}$') THEN ('0x' || trim({c}))::UBIGINT END, 0)"


_GOLDEN = {
    "width": ("CASE WHEN width > 0 THEN width END::VARCHAR", None, "NULL", "INTEGER"),
    "height": ("CASE WHEN height > 0 THEN height END::VARCHAR", None, "NULL", "INTEGER"),
    "has_exif": ("has_exif::VARCHAR", None, "has_exif", "INTEGER"),
    "size": ("CASE WHEN size > 0 THEN size END::VARCHAR", None, "size", "BIGINT"),
    **{c: (f"trim({c})", f"nullif(lower(trim({c})), '')", "NULL", "VARCHAR") for c in ("camera_make", "camera_model", "img_format")},
}
_LONG = " UNION ALL ".join(f"SELECT grp, w, '{n}' AS field, {v} AS value, {k or v} AS norm, ({r})::DOUBLE AS rnk FROM aged" for n, (v, k, r, _) in _GOLDEN.items())
_BACK = ", ".join(f"max(CASE WHEN field = '{n}' THEN value END)::{t} AS {n}" for n, (_, _, _, t) in _GOLDEN.items())

_VECTOR = vector("trim(embedding, chr(0) || chr(9) || chr(10) || chr(13) || ' ')")
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"


def _words(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


def _windows(table: str, ident: str) -> str:
    return f"SELECT DISTINCT {ident}, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {ident}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {ident}, {_words('text')} AS w FROM {table} WHERE {ident} IS NOT NULL AND text IS NOT NULL) WHERE len(w) >= 12)"


SQL: dict[str, str] = {
    "p2_found": f"""
WITH {CURRENT},
asked AS (SELECT DISTINCT file_id FROM knn_queries WHERE file_id IS NOT NULL),
vectors AS (SELECT file_id, v, sqrt({_DOT.format('v', 'v')}) AS size FROM (SELECT file_id, {_VECTOR} AS v FROM current) WHERE len(v) = 64),
alike AS (SELECT x.file_id AS a, y.file_id AS b, round({_DOT.format('x.v', 'y.v')} / (x.size * y.size), 9) AS near FROM asked JOIN vectors x USING (file_id) JOIN vectors y ON y.file_id <> x.file_id WHERE x.size > 0 AND y.size > 0),
hashes AS (SELECT file_id, {_hash('phash')} AS ph, {_hash('dhash')} AS dh FROM current),
apart AS (SELECT x.file_id AS a, y.file_id AS b, -(bit_count(xor(x.ph, y.ph)) + bit_count(xor(x.dh, y.dh)))::INT AS near FROM asked JOIN hashes x USING (file_id) JOIN hashes y ON y.file_id <> x.file_id WHERE x.ph IS NOT NULL AND x.dh IS NOT NULL AND y.ph IS NOT NULL AND y.dh IS NOT NULL),
top AS (SELECT 'embedding' AS measure, a, b FROM alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY near DESC, b) <= 5 UNION ALL SELECT 'hash', a, b FROM apart QUALIFY row_number() OVER (PARTITION BY a ORDER BY near DESC, b) <= 5)
SELECT DISTINCT measure, least(a, b) AS file_a, greatest(a, b) AS file_b FROM top
""",
    "p7_found": f"""
WITH d AS ({_windows('documents', 'doc_id')}), e AS ({_windows('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)
""",
    "p1_found": f"""
WITH {CURRENT},
accepted AS (
  SELECT -1 AS seq, path AS name, {_digest('sha256')} AS sha, {_digest('pixel_digest')} AS pix, {_hash('phash')} AS ph, {_hash('dhash')} AS dh FROM current
  UNION ALL
  SELECT DISTINCT plan_id, source_path, {_digest('sha256')}, {_digest('pixel_digest')}, {_hash('phash')}, {_hash('dhash')} FROM import_plans WHERE plan_id IS NOT NULL),
plans AS (SELECT * FROM accepted WHERE seq >= 0)
SELECT p.seq AS plan_id, a.name AS duplicate_of FROM plans p JOIN accepted a ON a.seq < p.seq
AND (coalesce(a.sha = p.sha, false) OR coalesce(a.pix = p.pix, false) OR coalesce(bit_count(xor(a.ph, p.ph)) <= 4 AND bit_count(xor(a.dh, p.dh)) <= 4, false))
""",
    "p6_found": f"""
WITH RECURSIVE {CURRENT},
files AS (SELECT file_id, regexp_replace(nfc_normalize(path), '/(\\.?/)+', '/', 'g') AS path, {_digest('sha256')} AS sha, {_hash('phash')} AS ph FROM current),
pairs AS (SELECT DISTINCT regexp_replace(nfc_normalize(left_path), '/(\\.?/)+', '/', 'g') AS a, regexp_replace(nfc_normalize(right_path), '/(\\.?/)+', '/', 'g') AS b FROM match_pairs WHERE verdict = 'match'),
edges AS (
  SELECT x.file_id AS u, y.file_id AS v FROM pairs JOIN files x ON x.path = a JOIN files y ON y.path = b
  UNION SELECT min(file_id) OVER (PARTITION BY sha), file_id FROM files WHERE sha IS NOT NULL
  UNION SELECT x.file_id, y.file_id FROM (SELECT ph, min(file_id) AS file_id FROM files WHERE ph IS NOT NULL GROUP BY ph) x JOIN (SELECT ph, min(file_id) AS file_id FROM files WHERE ph IS NOT NULL GROUP BY ph) y ON bit_count(xor(x.ph, y.ph)) <= 2
  UNION SELECT min(file_id) OVER (PARTITION BY ph), file_id FROM files WHERE ph IS NOT NULL),
sym AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach AS (SELECT u AS node, u AS seen FROM sym UNION SELECT r.node, s.v FROM reach r JOIN sym s ON r.seen = s.u)
SELECT node AS file_id, min(seen) AS group_id FROM reach GROUP BY node
""",
    "p3_found": f"""
WITH {CURRENT},
members AS (
  SELECT DISTINCT m.group_id, c.file_id, CASE WHEN width > 0 AND height > 0 THEN width::BIGINT * height ELSE 0 END AS px, coalesce(has_exif, 0) AS exif, coalesce(size, 0) AS size
  FROM group_members m JOIN current c ON c.file_id = m.file_id WHERE m.group_id IS NOT NULL),
best AS (SELECT group_id, max(px) AS px, max(exif) AS exif, max(size) AS size FROM members GROUP BY group_id HAVING count(*) >= 2)
SELECT m.group_id, min(m.file_id) AS file_id FROM members m JOIN best b ON b.group_id = m.group_id AND b.px = m.px AND b.exif = m.exif AND b.size = m.size
GROUP BY m.group_id HAVING count(*) = 1
""",
    "p3_golden": f"""
WITH {CURRENT},
members AS (SELECT DISTINCT m.group_id AS grp, c.file_id, analyzed_at, width, height, has_exif, size, camera_make, camera_model, img_format, decode_error FROM group_members m JOIN current c ON c.file_id = m.file_id WHERE m.group_id IS NOT NULL),
aged AS (SELECT *, round((CASE WHEN decode_error IS NULL THEN 1000000 ELSE 250000 END)::DOUBLE * pow(2.0, -((max(analyzed_at) OVER (PARTITION BY grp) - analyzed_at) / 86400 / 180.0::DOUBLE)))::BIGINT AS w FROM members),
long AS ({_LONG}),
counted AS (SELECT grp, field, norm, max(value) AS value, max(rnk) AS rnk, sum(w) AS votes, count(*) AS n FROM long WHERE norm IS NOT NULL GROUP BY grp, field, norm),
best AS (SELECT *, row_number() OVER (PARTITION BY grp, field ORDER BY rnk DESC NULLS LAST, votes DESC, n DESC, norm DESC) AS k FROM counted),
back AS (SELECT grp, {_BACK} FROM best WHERE k = 1 GROUP BY grp)
SELECT s.grp AS group_id, s.n AS members, b.* EXCLUDE (grp) FROM (SELECT grp, count(*) AS n FROM members GROUP BY grp) s LEFT JOIN back b ON b.grp = s.grp
""",
}
