"""The same queries in SQL, over the same tables."""

from __future__ import annotations

from shutterlake.functions.media import BAD_FOLDERS, CATEGORY_RANKS, COPY_HINTS, IMAGE_EXTENSIONS, LOSSLESS, LOSSY, VIDEO_EXTENSIONS


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _digest(c: str) -> str:
    return f"nullif(nullif(lower(regexp_extract({c}, '[0-9a-fA-F]{{64}}')), ''), '{'0' * 64}')"


def _hash(c: str) -> str:
    return f"nullif(CASE WHEN regexp_matches(trim({c}), '^[0-9a-fA-F]{{1,16}}$') THEN ('0x' || trim({c}))::UBIGINT END, 0)"


def _wide(c: str) -> str:
    words = ", ".join(f"('0x' || substr(lpad(trim({c}), 64, '0'), {1 + 16 * k}, 16))::UBIGINT" for k in range(4))
    return f"CASE WHEN regexp_matches(trim({c}), '^[0-9a-fA-F]{{1,64}}$') AND NOT regexp_matches(trim({c}), '^0+$') THEN [{words}] END"


EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^\\.*[^.].*?(\\.[^.]*)$', 1))"
FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
NAME = "regexp_extract(path, '[^/]*$')"
BINS = "list_transform(string_split(color_sig, ','), lambda x: TRY_CAST(trim(x) AS INTEGER))"
FRAMES = "list_transform(string_split(frame_hashes, ','), lambda x: CASE WHEN regexp_matches(trim(x), '^[0-9a-fA-F]{1,16}$') THEN ('0x' || trim(x))::UBIGINT END)"
CURRENT = "current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY analyzed_at DESC) AS rn FROM file_cache WHERE file_id IS NOT NULL) WHERE rn = 1)"
FILES = f"""
{CURRENT},
files AS (
  SELECT file_id, path, size, mtime, CASE WHEN {EXT} IN ({_list(IMAGE_EXTENSIONS)}) THEN 'image' WHEN {EXT} IN ({_list(VIDEO_EXTENSIONS)}) THEN 'video' ELSE 'other' END AS kind,
    {_digest('sha256')} AS sha, {_digest('pixel_digest')} AS pixels, {_hash('phash')} AS phash, {_hash('dhash')} AS dhash, {_hash('ahash')} AS ahash, {_wide('bhash')} AS bhash,
    CASE WHEN len({BINS}) = 64 AND len(list_filter({BINS}, lambda x: x IS NULL)) = 0 AND list_sum({BINS}) > 0 THEN {BINS} END AS color,
    CASE WHEN width > 0 THEN width END AS width, CASE WHEN height > 0 THEN height END AS height, img_format, orientation, has_exif, camera_make AS make, camera_model AS model,
    date_taken, decode_error AS error, CASE WHEN NOT isnan(video_duration) THEN video_duration END AS duration, video_bitrate AS bitrate, {FRAMES} AS frames
  FROM current)
"""
LAYERS = f"""
{FILES},
pix AS (SELECT pixels, CASE WHEN count(sha) = count(*) AND min(sha) = max(sha) THEN 'file_identical' ELSE 'pixel_identical' END AS category FROM files WHERE pixels IS NOT NULL GROUP BY pixels HAVING count(*) >= 2),
rest AS (SELECT * FROM files WHERE sha IS NOT NULL AND (pixels IS NULL OR pixels NOT IN (SELECT pixels FROM pix))),
members AS (
  SELECT 'p' || f.pixels AS key, category, file_id FROM files f JOIN pix USING (pixels)
  UNION ALL SELECT 's' || sha, 'file_identical', file_id FROM rest WHERE sha IN (SELECT sha FROM rest GROUP BY sha HAVING count(*) >= 2)),
sized AS (SELECT key, category, count(*) AS files, sum(size)::BIGINT AS total_size, min(size) AS unit_size, (sum(size) - max(size))::BIGINT AS reclaimable, min(path) AS first_path FROM members JOIN files USING (file_id) GROUP BY key, category),
groups AS (SELECT row_number() OVER (ORDER BY CASE category WHEN 'file_identical' THEN 5 ELSE 4 END DESC, reclaimable DESC, first_path) AS group_id, * FROM sized)
"""


def _sim(distance: str, bits: int = 64) -> str:
    return "format('{:.1f}', (1.0 - (" + distance + f") / {bits}.0::DOUBLE) * 100.0)::DOUBLE"


def _color(a: str, b: str) -> str:
    shared = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: least(p[1], p[2])))"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN format('{{:.1f}}', 100.0::DOUBLE * {shared} / least(list_sum({a}), list_sum({b})))::DOUBLE END"


_WIDE = " + ".join(f"bit_count(xor(a.bhash[{k}], b.bhash[{k}]))::INT" for k in (1, 2, 3, 4))
SIGNALS = ", ".join(f"{_sim(f'bit_count(xor(a.{h}, b.{h}))')} AS s_{h}" for h in ("phash", "dhash", "ahash")) + f", {_sim(_WIDE, 256)} AS s_bhash, {_color('a.color', 'b.color')} AS s_color"
_W = {"phash": 0.40, "dhash": 0.20, "ahash": 0.10, "bhash": 0.20, "color": 0.10}
_T = sum(_W.values())
_VALUE = " + ".join(f"coalesce(s_{k} * {w / _T!r}::DOUBLE, 0.0)" for k, w in _W.items())
_ACTIVE = " + ".join(f"(CASE WHEN s_{k} IS NOT NULL THEN {w / _T!r}::DOUBLE ELSE 0.0 END)" for k, w in _W.items())
SCORE = f"format('{{:.1f}}', ({_VALUE})::DOUBLE / ({_ACTIVE})::DOUBLE)::DOUBLE"
BANDS = "CASE WHEN {0} >= 98 THEN 'visually_identical' WHEN {0} >= 92 THEN 'very_similar' WHEN {0} >= 84 THEN 'similar' ELSE 'different' END"
RESIZED = "coalesce(score >= 96.0 AND wa > 0 AND ha > 0 AND wb > 0 AND hb > 0 AND abs(wa / ha - wb / hb) <= 0.04 * greatest(wa / ha, wb / hb) AND abs(wa - wb) / greatest(wa, wb) >= 0.10, false)"
PAIRS = f"""
{LAYERS},
pictures AS (SELECT * FROM files WHERE kind = 'image' AND error IS NULL AND file_id NOT IN (SELECT file_id FROM members)),
near AS (SELECT a.file_id AS a, b.file_id AS b, a.width::DOUBLE AS wa, a.height::DOUBLE AS ha, b.width::DOUBLE AS wb, b.height::DOUBLE AS hb, {SIGNALS} FROM pictures a JOIN pictures b ON a.file_id < b.file_id AND bit_count(xor(a.phash, b.phash)) <= 20),
scored AS (SELECT *, {SCORE} AS score FROM near),
pairs AS (SELECT a, b, score, {RESIZED} AS resized, {BANDS.format('score')} AS category FROM scored WHERE coalesce(s_bhash, 100) >= 55 AND score >= 84)
"""


def _reach(edges: str) -> str:
    return f"""
sym AS (SELECT u, v FROM ({edges}) WHERE u <> v UNION SELECT v, u FROM ({edges}) WHERE u <> v),
reach AS (SELECT u AS node, u AS seen FROM sym UNION SELECT r.node, s.v FROM reach r JOIN sym s ON r.seen = s.u),
linked AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
"""


VIDEOS = f"""
{FILES},
videos AS (SELECT file_id, sha, duration, frames FROM files WHERE kind = 'video'),
likely AS (SELECT a.file_id AS a, b.file_id AS b FROM videos a JOIN videos b ON a.file_id < b.file_id AND a.duration > 0 AND b.duration > 0 AND abs(a.duration - b.duration) <= 2),
compared AS (
  SELECT p.a, p.b, list_filter(list_transform(list_zip(x.frames, y.frames), lambda p: CASE WHEN p[1] IS NOT NULL AND p[2] IS NOT NULL THEN {_sim('bit_count(xor(p[1], p[2]))')} END), lambda s: s IS NOT NULL) AS per
  FROM likely p JOIN videos x ON x.file_id = p.a JOIN videos y ON y.file_id = p.b WHERE x.frames IS NOT NULL AND y.frames IS NOT NULL),
vpairs AS (SELECT a, b, format('{{:.1f}}', list_reduce(list_prepend(0.0::DOUBLE, per), lambda s, x: s + x) / len(per))::DOUBLE AS percent FROM compared WHERE len(per) >= 2),
vgood AS (SELECT * FROM vpairs WHERE percent >= 84)
"""
_RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in CATEGORY_RANKS.items()) + " END"


def _any(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _human(c: str) -> str:
    steps = " ".join(f"WHEN {c} / {1024.0**k} < 1024 THEN format('{{:.2f}} {u}', {c} / {1024.0**k}::DOUBLE)" for k, u in enumerate(("KB", "MB", "GB", "TB"), 1))
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 0 THEN '-' WHEN {c} < 1024 THEN {c}::VARCHAR || ' B' {steps} ELSE format('{{:.2f}} PB', {c} / {1024.0**5}::DOUBLE) END"


TRAITS = f"""
traits AS (
  SELECT file_id, CASE WHEN width > 0 AND height > 0 THEN width::BIGINT * height ELSE 0 END AS pixels, coalesce(bitrate, 0) AS bitrate,
    CASE WHEN kind = 'image' AND error IS NULL AND upper(coalesce(img_format, '')) IN ({_list(LOSSLESS)}) THEN 2 WHEN kind = 'image' AND error IS NULL AND upper(coalesce(img_format, '')) IN ({_list(LOSSY)}) THEN 1 ELSE 0 END AS format_rank,
    CASE WHEN kind = 'image' AND error IS NULL THEN coalesce((has_exif <> 0)::INT, 0) + (coalesce(length(make) > 0, false) OR coalesce(length(model) > 0, false))::INT + coalesce((length(date_taken) > 0)::INT, 0) ELSE 0 END AS metadata_points,
    {_any(f'lower({NAME})', COPY_HINTS)} AS copy_named, {_any(f'lower({FOLDER})', BAD_FOLDERS)} AS bad_folder, length(path) - length(replace(path, '/', '')) AS depth, length(path) AS path_length
  FROM files)
"""


def _edge(c: str) -> str:
    return f"({c} = max({c}) OVER g AND min({c}) OVER g < max({c}) OVER g)"


KEEP = f"""
{LAYERS}, {TRAITS},
points AS (
  SELECT key, category, file_id, mtime,
    (CASE WHEN max(t.pixels) OVER g > 0 AND category <> 'file_identical' THEN 30.0::DOUBLE * t.pixels / max(t.pixels) OVER g ELSE 0.0 END)
    + (CASE WHEN {_edge('size')} THEN 12.0::DOUBLE ELSE 0.0 END) + format_rank * 5.0::DOUBLE + (CASE WHEN max(t.bitrate) OVER g > 0 THEN 10.0::DOUBLE * t.bitrate / max(t.bitrate) OVER g ELSE 0.0 END)
    + metadata_points * 4.0::DOUBLE + (CASE WHEN mtime <= min(mtime) OVER g + 2.0 THEN 9.0::DOUBLE ELSE 0.0 END) + (CASE WHEN copy_named THEN -14.0::DOUBLE ELSE 6.0 END) + (CASE WHEN bad_folder THEN -10.0::DOUBLE ELSE 0.0 END)
    + (CASE WHEN depth = min(depth) OVER g THEN 3.0::DOUBLE ELSE 0.0 END) + (CASE WHEN path_length <= min(path_length) OVER g + 4 THEN 2.0::DOUBLE ELSE 0.0 END) AS score,
    copy_named OR bad_folder OR ({_edge('t.pixels')} AND category <> 'file_identical') OR (format_rank = 2 AND min(format_rank) OVER g < 2 AND category <> 'file_identical') OR {_edge('metadata_points')} AS decisive
  FROM members JOIN files USING (file_id) JOIN traits t USING (file_id) WINDOW g AS (PARTITION BY key, category))
"""
PLANS = f"plans AS (SELECT DISTINCT ON (plan_id) *, {_digest('sha256')} AS sha, {_digest('pixel_digest')} AS pixels FROM import_plans WHERE plan_id IS NOT NULL)"
_FORMATS = ("%Y:%m:%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y:%m:%d %H:%M", "%Y-%m-%d %H:%M", "%Y%m%d %H%M%S", "%Y-%m-%d %H")


def _capture(c: str) -> str:
    """By trial of one format after the other, with what may follow the seconds taken off first."""
    core = f"trim(string_split(string_split(replace(trim(replace({c}, chr(0), '')), 'T', ' '), '.')[1], '+')[1])"
    bare = f"regexp_replace({core}, '^(.* [0-9:]+)([Zz]|-[0-9]{{2}}:?[0-9]{{2}})$', '\\1')"
    tried = ", ".join(f"try_strptime({bare}, '{f}')" for f in _FORMATS)
    return f"CASE WHEN {core} NOT LIKE '0000%' THEN coalesce({tried}) END"


DATED = f"""
{FILES},
probes AS (SELECT file_id, creation_time FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY probed_at DESC) AS rn FROM video_info) WHERE rn = 1),
read AS (SELECT f.file_id, f.path, CASE WHEN kind = 'image' THEN {_capture('date_taken')} END AS taken, CASE WHEN kind = 'video' THEN {_capture('creation_time')} END AS made,
  CASE WHEN abs(mtime) < 1e20 THEN make_timestamp(floor(CASE WHEN abs(mtime) < 1e11 THEN mtime WHEN abs(mtime) < 1e14 THEN mtime / 1e3 WHEN abs(mtime) < 1e17 THEN mtime / 1e6 ELSE mtime / 1e9 END)::BIGINT * 1000000) END AS stored FROM files f LEFT JOIN probes p ON p.file_id = f.file_id),
dated AS (SELECT file_id, path, coalesce(taken, made, stored) AS captured, CASE WHEN taken IS NOT NULL THEN 'exif' WHEN made IS NOT NULL THEN 'video_creation' WHEN stored IS NOT NULL THEN 'file_mtime' END AS date_source FROM read)
"""
_ISO = "^([+-])(\\d+)(\\.\\d+)?([+-])(\\d+)(\\.\\d+)?(?:[+-][\\d.]+)?(?:CRS[^/]*)?/?$"


def _degrees(text: str, sign: int, whole: int, rest: int, width: int) -> str:
    part = lambda k: f"regexp_extract({text}, '{_ISO}', {k})"
    digits, fraction = part(whole), f"TRY_CAST('0' || {part(rest)} AS DOUBLE)"
    at = lambda start, n: f"TRY_CAST(substr({digits}, {start}, {n}) AS DOUBLE)"
    d, m, s = at(1, width), at(width + 1, 2), at(width + 3, 2)
    value = f"CASE WHEN length({digits}) = {width} THEN {d} + {fraction} WHEN length({digits}) = {width + 2} AND {m} < 60 THEN {d} + ({m} + {fraction}) / 60 WHEN length({digits}) = {width + 4} AND {m} < 60 AND {s} < 60 THEN {d} + {m} / 60 + ({s} + {fraction}) / 3600 END"
    return f"({value}) * (CASE WHEN {part(sign)} = '-' THEN -1.0 ELSE 1.0 END)"


_LOCATION = "regexp_replace(location, '[\\s\\x00-\\x1f]+', '', 'g')"
PLACES = f"""
spots AS (
  SELECT file_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY read_at DESC) AS rn FROM geo_coords WHERE file_id IS NOT NULL) WHERE rn = 1),
clips AS (SELECT file_id, {_degrees(_LOCATION, 1, 2, 3, 2)} AS lat, {_degrees(_LOCATION, 4, 5, 6, 3)} AS lon FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY probed_at DESC) AS rn FROM video_info WHERE file_id IS NOT NULL) WHERE rn = 1),
good AS (SELECT * FROM spots WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (abs(lat) < 1e-7 AND abs(lon) < 1e-7)),
located AS (SELECT * FROM good UNION ALL SELECT * FROM clips WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (abs(lat) < 1e-7 AND abs(lon) < 1e-7) AND file_id NOT IN (SELECT file_id FROM good)),
rings AS (SELECT region_id, country, bbox_w, bbox_s, bbox_e, bbox_n, poly_no, unnest(rings) AS ring FROM (SELECT *, unnest(polys) AS rings, generate_subscripts(polys, 1) AS poly_no FROM country_borders)),
sides AS (SELECT region_id, country, bbox_w, bbox_s, bbox_e, bbox_n, poly_no, ring[k][1] AS xp, ring[k][2] AS yp, ring[k + 1][1] AS xq, ring[k + 1][2] AS yq FROM (SELECT *, unnest(range(1, len(ring))) AS k FROM rings)),
crossed AS (
  SELECT file_id, region_id, poly_no, t.turn, count(*) AS n FROM located, (VALUES (0), (360), (-360)) t(turn), sides
  WHERE ((yp <= lat) <> (yq <= lat)) AND (CASE WHEN yp < yq THEN xp + (lat - yp) * (xq - xp) / (yq - yp) ELSE xq + (lat - yq) * (xp - xq) / (yp - yq) END) > lon + t.turn GROUP BY ALL),
inside AS (SELECT DISTINCT file_id, region_id FROM crossed WHERE n % 2 = 1)
"""
GEOCODE = f"""
{PLACES},
held AS (SELECT file_id, arg_min(country, ((bbox_e - bbox_w) * (bbox_n - bbox_s), region_id)) AS country FROM inside JOIN country_borders USING (region_id) GROUP BY file_id),
away AS (
  SELECT file_id, region_id, country, pow(lon - (xp + t * (xq - xp)), 2) + pow(lat - (yp + t * (yq - yp)), 2) AS d2 FROM (
    SELECT *, greatest(0.0, least(1.0, ((lon - xp) * (xq - xp) + (lat - yp) * (yq - yp)) / nullif((xq - xp) * (xq - xp) + (yq - yp) * (yq - yp), 0))) AS t
    FROM located JOIN sides ON lon BETWEEN least(xp, xq) - 0.1 AND greatest(xp, xq) + 0.1 AND lat BETWEEN least(yp, yq) - 0.2 AND greatest(yp, yq) + 0.2 WHERE file_id NOT IN (SELECT file_id FROM held))),
geo AS (SELECT * FROM held UNION ALL SELECT file_id, arg_min(country, (d2, region_id)) FROM away WHERE d2 < 0.1 * 0.1 GROUP BY file_id)
"""
DECIDED = f"""
{CURRENT},
decided AS (
  SELECT m.group_id, m.file_id, m.decision, m.reviewed, c.path, c.size FROM (SELECT *, row_number() OVER (PARTITION BY group_id, file_id ORDER BY added_at DESC, decision DESC, reviewed DESC) AS rn FROM group_members WHERE group_id IS NOT NULL AND file_id IS NOT NULL) m
  LEFT JOIN current c ON c.file_id = m.file_id WHERE m.rn = 1)
"""
CACHE = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY analyzed_at DESC) AS rn FROM file_cache WHERE path IS NOT NULL) WHERE rn = 1),
earlier AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY analyzed_at) AS rn FROM file_cache WHERE path IS NOT NULL) WHERE rn = 1),
looked AS (SELECT l.path, l.size, l.mtime, l.sha256 AS fresh, e.sha256 AS cached, coalesce(l.size = e.size AND abs(l.mtime - e.mtime) <= 1e-3, false) AS hit FROM latest l LEFT JOIN earlier e ON e.path = l.path)
"""


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


EXPORT = f"""
{LAYERS},
made AS (SELECT file_id, arg_max(decision, (added_at, decision)) AS decision FROM group_members WHERE file_id IS NOT NULL GROUP BY file_id),
flat AS (SELECT group_id, m.category, CASE m.category WHEN 'file_identical' THEN 'Identical file' ELSE 'Identical pixels' END AS category_label, '' AS similarity_percent, coalesce(decision, 'undecided') AS decision, 'no' AS deleted, {NAME} AS name,
    path, f.size, {_human('f.size')} AS size_label, coalesce(width || 'x' || height, '') AS resolution, coalesce(sha, '') AS sha256, coalesce(pixels, '') AS pixel_digest, CASE WHEN phash IS NULL THEN '' ELSE lower(lpad(to_hex(phash), 16, '0')) END AS phash, true AS exact
  FROM members m JOIN groups g ON g.key = m.key JOIN files f ON f.file_id = m.file_id LEFT JOIN made d ON d.file_id = m.file_id)
"""


def vector(c: str) -> str:
    """A hex text of little-endian half floats as a list of doubles; null if malformed or not finite."""
    half = f"(('0x' || substr({c}, 4 * i + 3, 2) || substr({c}, 4 * i + 1, 2))::INT)"
    value = f"(CASE WHEN {half} >> 15 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE * (CASE WHEN ({half} >> 10) & 31 = 0 THEN ({half} & 1023) * pow(2.0, -24) WHEN ({half} >> 10) & 31 < 31 THEN (1 + ({half} & 1023) / 1024.0::DOUBLE) * pow(2.0, (({half} >> 10) & 31) - 15) END)"
    made = f"list_transform(range(length({c}) // 4), lambda i: {value})"
    return f"CASE WHEN regexp_full_match({c}, '([0-9a-fA-F]{{4}})+') THEN (CASE WHEN NOT list_contains(list_transform({made}, lambda x: x IS NULL), true) THEN {made} END) END"


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))"
    return f"({dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))"


SQL: dict[str, str] = {
    "export_summary": f"WITH {LAYERS} SELECT (SELECT count(*) FROM files) AS files_found, (SELECT count(*) FROM files WHERE kind = 'image') AS images, (SELECT count(*) FROM files WHERE kind = 'video') AS videos, (SELECT count(DISTINCT {FOLDER}) FROM files) AS folders, (SELECT sum(size)::BIGINT FROM files) AS total_bytes, count(*) AS groups, count_if(category = 'file_identical') AS file_identical_groups, count_if(category = 'pixel_identical') AS pixel_identical_groups, sum(files - 1)::BIGINT AS redundant_copies, sum(reclaimable)::BIGINT AS reclaimable_bytes FROM groups",
    "threshold_categories": f"WITH {FILES} SELECT m.*, CASE WHEN score >= 100 THEN 'visually_identical' WHEN score >= 92.5 THEN 'very_similar' WHEN score >= 85 THEN 'similar' ELSE 'different' END AS category, CASE WHEN width > 0 AND height > 0 THEN format('{{:.1f}}', width::DOUBLE * height / 1000000)::DOUBLE END AS megapixels FROM (SELECT DISTINCT left_path, right_path, score FROM match_pairs WHERE score IS NOT NULL AND NOT isnan(score)) m LEFT JOIN files f ON f.path = m.left_path",
    "embedding_votes": f"""WITH {PAIRS},
kept AS (SELECT a, b, score FROM scored WHERE coalesce(s_bhash, 100) >= 55),
vectors AS (SELECT file_id, v FROM (SELECT file_id, {vector('embedding')} AS v FROM current WHERE file_id IN (SELECT a FROM kept UNION SELECT b FROM kept)) WHERE list_sum(list_transform(v, lambda x: x * x)) > 1e-18),
voted AS (SELECT k.*, CASE WHEN len(x.v) = len(y.v) THEN format('{{:.1f}}', 100.0::DOUBLE * least(1.0, greatest(0.0, {_cosine('x.v', 'y.v')})))::DOUBLE END AS vote FROM kept k LEFT JOIN vectors x ON x.file_id = a LEFT JOIN vectors y ON y.file_id = b),
lifted AS (SELECT a, b, CASE WHEN vote >= 90 THEN greatest(score, 84.0) ELSE score END AS score, vote FROM voted WHERE vote IS NULL OR vote >= 55)
SELECT a, b, score, vote, {BANDS.format('score')} AS category FROM lifted WHERE score >= 84""",
    "scan_stats": f"WITH {FILES} SELECT kind, count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT {FOLDER}) AS folders FROM files GROUP BY kind",
    "scan_selection": f"WITH {FILES} SELECT kind, {EXT} AS ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE size >= 65536 AND NOT regexp_matches({FOLDER}, '(^|/)tmp(/|$)') AND kind <> 'other' AND {EXT} <> '.png' GROUP BY ALL",
    "size_candidates": f"WITH {FILES} SELECT file_id, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)",
    "dimension_candidates": f"WITH {FILES}, im AS (SELECT * FROM files WHERE kind = 'image' AND error IS NULL AND width IS NOT NULL AND height IS NOT NULL) SELECT file_id, width, height FROM im WHERE (width, height) IN (SELECT (width, height) FROM im GROUP BY width, height HAVING count(*) > 1)",
    "exact_groups": f"WITH {FILES} SELECT row_number() OVER (ORDER BY (count(*) - 1) * min(size) DESC, min(path)) AS group_id, sha, count(*) AS files, min(size) AS unit_size, (count(*) - 1) * min(size) AS reclaimable FROM files WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) >= 2",
    "layered_groups": f"WITH {LAYERS} SELECT group_id, category, files, total_size, unit_size, reclaimable FROM groups",
    "layered_members": f"WITH {LAYERS} SELECT group_id, file_id FROM members JOIN groups USING (key)",
    "rough_counters": f"WITH {FILES} SELECT count(sha) AS hashed, count(pixels) AS decoded, count(phash) AS described, count(frames) AS sampled, (SELECT count(*) FROM (SELECT sha FROM files WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1)) AS sha_groups, (SELECT count(*) FROM (SELECT pixels FROM files WHERE pixels IS NOT NULL GROUP BY pixels HAVING count(*) > 1)) AS pixels_groups FROM files",
    "dashboard": f"WITH {LAYERS} SELECT category, count(*) AS groups, sum(files)::BIGINT AS files, sum(files - 1)::BIGINT AS redundant, sum(reclaimable)::BIGINT AS reclaimable FROM groups GROUP BY category",
    "group_browser": f"WITH {LAYERS}, b AS (SELECT key, bool_and(kind = 'image') AS pictures, bool_or(contains(lower(path), 'img')) AS hit FROM members JOIN files USING (file_id) GROUP BY key) SELECT row_number() OVER (ORDER BY reclaimable DESC, first_path) AS place, files, reclaimable, first_path, {_human('reclaimable')} || ' (' || files || ')' AS label FROM groups JOIN b USING (key) WHERE pictures AND hit AND files >= 3 AND category = 'file_identical'",
    "hamming_pairs": f"WITH {FILES}, h AS (SELECT phash, min(file_id) AS file_id FROM files WHERE phash IS NOT NULL GROUP BY phash) SELECT a.file_id AS a, b.file_id AS b, bit_count(xor(a.phash, b.phash))::BIGINT AS distance, {_sim('bit_count(xor(a.phash, b.phash))')} AS similarity FROM h a JOIN h b ON a.file_id < b.file_id AND bit_count(xor(a.phash, b.phash)) <= 15",
    "similar_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "similar_clusters": f"""WITH RECURSIVE {PAIRS}, {_reach('SELECT a AS u, b AS v FROM pairs')},
rows AS (SELECT root, f.* FROM linked JOIN files f ON f.file_id = node),
anchors AS (SELECT root, file_id AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY size DESC, coalesce(width::BIGINT * height, 0) DESC, mtime, file_id) AS k FROM rows) WHERE k = 1),
against AS (SELECT x.root, {SIGNALS} FROM anchors x JOIN files a ON a.file_id = x.anchor JOIN rows b ON b.root = x.root AND b.file_id <> x.anchor),
ends AS (SELECT root, max({SCORE}) AS headline, min({SCORE}) AS weakest FROM against GROUP BY root),
sizes AS (SELECT root, count(*) AS files, count(DISTINCT CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN (width, height) END) AS sizes FROM rows GROUP BY root),
up AS (SELECT root, bool_or(resized) AS resized FROM pairs JOIN linked ON node = a GROUP BY root)
SELECT root, anchor, files, nullif(headline, 0) AS headline, weakest, CASE WHEN resized AND sizes > 1 AND weakest >= 98 THEN 'resized_duplicate' WHEN headline = 0 THEN 'visually_identical' ELSE {BANDS.format('headline')} END AS category
FROM anchors JOIN ends USING (root) JOIN sizes USING (root) JOIN up USING (root)""",
    "color_matches": f"WITH {LAYERS}, firsts AS (SELECT key, min(file_id) AS first FROM members GROUP BY key) SELECT m.file_id, first, {_color('a.color', 'b.color')} AS similarity FROM members m JOIN firsts USING (key) JOIN files a ON a.file_id = m.file_id JOIN files b ON b.file_id = first WHERE m.file_id <> first",
    "duration_candidates": f"WITH {VIDEOS} SELECT DISTINCT unnest([a, b]) AS file_id FROM likely",
    "video_pairs": f"WITH {VIDEOS} SELECT * FROM vgood",
    "nearest_videos": f"WITH {VIDEOS}, two AS (SELECT a, b, percent FROM vpairs UNION ALL SELECT b, a, percent FROM vpairs) SELECT a AS file_id, b AS other, percent FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY percent DESC, b) AS k FROM two) WHERE k = 1",
    "video_groups": f"""WITH RECURSIVE {VIDEOS}, {_reach("SELECT min(file_id) OVER (PARTITION BY sha) AS u, file_id AS v FROM videos WHERE sha IS NOT NULL UNION ALL SELECT a, b FROM vgood")},
held AS (SELECT root, count(*) AS files, max(coalesce(duration, 0)) - min(coalesce(duration, 0)) <= 0.75 AS same, count(sha) = count(*) AND min(sha) = max(sha) AS one FROM linked JOIN videos v ON v.file_id = node GROUP BY root),
least AS (SELECT root, min(percent) AS percent FROM vgood JOIN linked ON node = a GROUP BY root)
SELECT root, files, coalesce(percent, 84.0) AS percent, CASE WHEN one THEN 'file_identical' WHEN coalesce(percent, 84) >= 98 AND same THEN 'same_content_likely' WHEN coalesce(percent, 84) >= 92 THEN 'very_similar' WHEN coalesce(percent, 84) >= 84 THEN 'similar' ELSE 'different' END AS category FROM held LEFT JOIN least USING (root)""",
    "keep_scores": f"WITH {KEEP} SELECT file_id, round(score * 1000)::BIGINT AS score_milli, decisive FROM points",
    "keep_recommendation": f"WITH {KEEP}, ranked AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS second FROM points WINDOW o AS (PARTITION BY key, category ORDER BY score DESC, mtime, file_id)) SELECT category, file_id AS keep, CASE WHEN category = 'file_identical' AND NOT decisive THEN least(floor(greatest(35.0, least(96.0, 52.0 + (score - second) * 2.4::DOUBLE)))::INT, 55) ELSE floor(greatest(35.0, least(96.0, 52.0 + (score - second) * 2.4::DOUBLE)))::INT END AS confidence FROM ranked WHERE place = 1 AND second IS NOT NULL",
    "file_traits": f"WITH {FILES}, {TRAITS} SELECT * FROM traits",
    "labels": f"WITH {FILES} SELECT file_id, {_human('size')} AS size_label, CASE WHEN duration IS NOT NULL THEN format('{{:02d}}:{{:02d}}:{{:02d}}', greatest(0, floor(duration))::BIGINT // 3600, greatest(0, floor(duration))::BIGINT // 60 % 60, greatest(0, floor(duration))::BIGINT % 60) END AS duration_label, CASE WHEN orientation IN (5, 6, 7, 8) THEN height ELSE width END AS upright_width, CASE WHEN orientation IN (5, 6, 7, 8) THEN width ELSE height END AS upright_height, len(frames) AS frame_count FROM files",
    "import_status": f"""WITH {FILES}, {PLANS},
a AS (SELECT *, CASE WHEN sha IS NOT NULL THEN first(source_path) OVER (PARTITION BY sha ORDER BY plan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS same FROM plans WHERE error IS NULL),
x AS (SELECT size, sha, min(path) AS exact FROM files WHERE sha IS NOT NULL GROUP BY ALL),
y AS (SELECT width, height, pixels, min(path) AS pixel FROM files WHERE pixels IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL GROUP BY ALL),
b AS (SELECT a.*, exact, same IS NULL AND exact IS NULL AND kind = 'image' AND pixels IS NOT NULL AS fresh FROM a LEFT JOIN x USING (size, sha)),
c AS (SELECT *, CASE WHEN fresh THEN first(source_path) OVER (PARTITION BY fresh, pixels ORDER BY plan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS twin FROM b),
e AS (SELECT c.*, CASE WHEN fresh THEN pixel END AS pix FROM c LEFT JOIN y USING (width, height, pixels))
SELECT plan_id, CASE WHEN same IS NOT NULL THEN 'duplicate_in_batch' WHEN exact IS NOT NULL THEN 'duplicate_exact' WHEN twin IS NOT NULL THEN 'duplicate_in_batch' WHEN pix IS NOT NULL THEN 'duplicate_pixel' ELSE 'new' END AS status, coalesce(same, exact, twin, pix) AS duplicate_of FROM e""",
    "plan_summary": f"WITH {PLANS} SELECT status, count(*) AS plans, sum(size)::BIGINT AS bytes, count_if(enabled) AS enabled FROM plans GROUP BY status",
    "import_names": f"""WITH {CURRENT}, {PLANS},
there AS (SELECT DISTINCT {FOLDER} AS dest_dir, {_fold(NAME)} AS key FROM current),
p AS (SELECT plan_id, dest_dir, dest_name, {_fold('dest_name')} AS key, plan_ts, source_path FROM plans WHERE dest_dir IS NOT NULL AND dest_name IS NOT NULL),
q AS (SELECT *, count(*) OVER w AS n, first(dest_name) OVER (w ORDER BY plan_id) AS base, row_number() OVER (w ORDER BY plan_ts, source_path) AS k, EXISTS (SELECT 1 FROM there t WHERE t.dest_dir = p.dest_dir AND t.key = p.key) AS there FROM p WINDOW w AS (PARTITION BY dest_dir, key)),
slots AS (SELECT dest_dir, key, base, unnest(range(1, n + 100)) AS i, n FROM (SELECT DISTINCT dest_dir, key, base, n FROM q WHERE n > 1 OR there)),
free AS (SELECT dest_dir, key, base, i, row_number() OVER (PARTITION BY dest_dir, key ORDER BY i) AS k FROM slots s WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.dest_dir = s.dest_dir AND t.key = {_fold("regexp_replace(base, '\\.[^.]*$', '') || format('_{:02d}', i) || regexp_extract(base, '\\.[^.]*$')")}))
SELECT plan_id, dest_name, false AS suffixed FROM q WHERE n = 1 AND NOT there
UNION ALL SELECT plan_id, regexp_replace(q.base, '\\.[^.]*$', '') || format('_{{:02d}}', i) || regexp_extract(q.base, '\\.[^.]*$'), true FROM q JOIN free f ON f.dest_dir = q.dest_dir AND f.key = q.key AND f.k = q.k WHERE n > 1 OR there""",
    "capture_dates": f"WITH {DATED} SELECT file_id, captured, date_source FROM dated",
    "geocode": f"WITH {GEOCODE} SELECT file_id, country FROM geo",
    "folder_reuse": f"""WITH w AS (SELECT DISTINCT country AS name, coalesce(nullif(trim(trim(regexp_replace(country, '[<>:"|?*\\\\/]', '', 'g')), '.'), ''), 'Sin ubicación') AS clean FROM import_plans),
e AS (SELECT {_fold('country')} AS key, min(country) AS there FROM country_borders GROUP BY 1) SELECT name, coalesce(there, clean) AS folder FROM w LEFT JOIN e ON e.key = {_fold('clean')}""",
    "iso6709": f"SELECT DISTINCT location, round({_degrees(_LOCATION, 1, 2, 3, 2)}, 7) AS lat, round({_degrees(_LOCATION, 4, 5, 6, 3)}, 7) AS lon FROM video_info",
    "cache_lookup": f"WITH {CACHE} SELECT path, hit, CASE WHEN hit THEN cached END AS sha256 FROM looked",
    "cache_upsert": f"WITH {CACHE} SELECT path, size, mtime, sha256 FROM earlier WHERE path NOT IN (SELECT path FROM looked WHERE NOT hit) UNION ALL SELECT path, size, mtime, fresh FROM looked WHERE NOT hit",
    "cache_prune": f"WITH {CURRENT}, {CACHE} SELECT path, size FROM latest WHERE path IN (SELECT path FROM current WHERE file_id IN (SELECT file_id FROM group_members))",
    "history_recent": f"WITH {PLANS} SELECT plan_id, plan_ts, source_path, status, size FROM plans WHERE status <> 'pending' ORDER BY plan_ts DESC NULLS LAST, plan_id DESC LIMIT 500",
    "history_summary": f"WITH {PLANS} SELECT batch_no, count(*) AS operations, count(error) AS failed, sum(CASE WHEN error IS NULL THEN size ELSE 0 END)::BIGINT AS bytes FROM plans GROUP BY batch_no",
    "decisions": f"WITH {DECIDED} SELECT group_id, count(*) AS members, count_if(decision = 'delete') AS marked, coalesce(bool_and(reviewed), false) AS reviewed, count_if(coalesce(decision, 'undecided') = 'undecided') = 0 AS resolved, count_if(NOT coalesce(decision = 'delete', false)) = 0 AS unsafe FROM decided GROUP BY group_id",
    "deletion_preview": f"WITH {DECIDED}, m AS (SELECT file_id, max(size) AS size, max(path) AS path FROM decided WHERE decision = 'delete' GROUP BY file_id) SELECT (SELECT count(path) FROM m) AS items, (SELECT coalesce(sum(size), 0)::BIGINT FROM m) AS bytes, (SELECT count(*) FROM m WHERE path IS NULL) AS missing, (SELECT count(*) FROM (SELECT group_id FROM decided GROUP BY group_id HAVING count_if(NOT coalesce(decision = 'delete', false)) = 0)) AS emptied",
    "category_review": f"""WITH m AS (SELECT DISTINCT group_id, file_id, category, similarity FROM group_members WHERE category IS NOT NULL), g AS (SELECT category, count(*) AS members, count(DISTINCT group_id) AS groups, max(CASE WHEN NOT isnan(similarity) THEN similarity END) AS best FROM m GROUP BY category)
SELECT category, members, groups, best, CASE WHEN category IN ('file_identical', 'pixel_identical') THEN 100 WHEN best IS NULL THEN 0 ELSE format('{{:.0f}}', greatest(0, least(100, best)))::INT END AS confidence, {_RANK} AS rank FROM g""",
    "export_rows": f"WITH {EXPORT} SELECT * FROM flat",
    "export_json": f"WITH {EXPORT}, j AS (SELECT group_id, any_value(category) AS category, string_agg('{{\"path\":' || to_json(path) || ',\"size\":' || size || '}}', ',' ORDER BY path, size) AS files FROM flat GROUP BY group_id) SELECT group_id, '{{\"group_id\":' || group_id || ',\"category\":\"' || category || '\",\"files\":[' || files || ']}}' AS json FROM j",
    "undo_plan": f"WITH {PLANS} SELECT plan_id, dest_dir || '/' || dest_name AS undo_source, source_path AS undo_dest FROM plans WHERE error IS NULL AND status <> 'pending' AND dest_dir IS NOT NULL AND dest_name IS NOT NULL",
    "phash_compare": f"WITH {FILES}, m AS (SELECT DISTINCT group_id, g.file_id, phash FROM group_members g JOIN files f ON f.file_id = g.file_id WHERE phash IS NOT NULL AND group_id IS NOT NULL), o AS (SELECT *, lead(phash) OVER (PARTITION BY group_id ORDER BY file_id) AS other FROM m) SELECT group_id, file_id, bit_count(xor(phash, other))::BIGINT AS distance, {_sim('bit_count(xor(phash, other))')} AS similarity FROM o WHERE other IS NOT NULL",
    "p5_found": f"""WITH {PLACES},
boxed AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM located)
SELECT 'near' AS relation, a.file_id AS left_id, b.file_id AS right_id FROM boxed a JOIN boxed b ON a.file_id < b.file_id AND abs(a.z - b.z) < 3e-5 AND abs(a.x - b.x) < 3e-5 AND abs(a.y - b.y) < 3e-5
WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 150
UNION ALL SELECT 'in', file_id, region_id FROM inside""",
}
