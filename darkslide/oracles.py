"""SQL for DuckDB that gives the rows of the core's queries by other means."""

from __future__ import annotations

from darkslide.functions.folders import LIBRARY, ROOTS, TRASH, YEAR_PREFIXES, YEAR_SUFFIXES
from darkslide.functions.kinds import DOCUMENTS, EXTENSION_OF, EXTENSIONS
from darkslide.functions.text import EDITED


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _alternatives(values) -> str:
    return "|".join(values).replace("'", "''")


NOW = 1_767_225_600
_FOLDER = "trim(translate(rel_folder, chr(160) || chr(8239) || chr(8199), '   '))"


def _year(folder: str) -> str:
    a = f"regexp_extract({folder}, '^(?:{_alternatives(YEAR_PREFIXES)})([0-9]{{4}})$', 1)"
    b = f"regexp_extract({folder}, '^([0-9]{{4}})(?:{_alternatives(YEAR_SUFFIXES)})$', 1)"
    y = f"try_cast({a} || {b} AS BIGINT)"
    return f"CASE WHEN {y} BETWEEN 1800 AND 2100 THEN {y} END"


def _class(folder: str) -> str:
    return f"CASE WHEN {folder} = '' THEN 'library' WHEN lower({folder}) IN {_in(TRASH)} THEN 'trash' WHEN lower({folder}) IN {_in(LIBRARY)} THEN 'library' WHEN ({_year(folder)}) IS NOT NULL THEN 'library' ELSE 'album' END"


_EXT = "lower(regexp_extract(name, '[.]([^.]*)$', 1))"
_KIND = "CASE " + " ".join(f"WHEN {_EXT} IN {_in(v)} THEN '{k}'" for k, v in EXTENSIONS.items()) + f" WHEN {_EXT} LIKE 'mp~%' THEN 'mp4' ELSE 'unknown' END"
_SHOT = "regexp_matches(lower(name), '^screen ?shot')"
_EPOCH = "CAST(epoch({}) AS BIGINT)"
_WALL = (
    "CASE WHEN regexp_matches(dto, '^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND substr(dto, 18, 2) < '60'"
    " THEN CAST(epoch(try_strptime(substr(dto, 1, 19), '%Y:%m:%d %H:%M:%S')) AS BIGINT) END"
)


def _shape(pattern: str, fmt: str) -> str:
    return f"CAST(epoch(try_strptime(nullif(regexp_extract(name, '{pattern}', 0), ''), '{fmt}')) AS BIGINT)"


_C, _MO = "(?:18|19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])"
_D2 = "[0-9]{2}"
_DD, _HH, _NN = "[0-3][0-9]", "[0-2][0-9]", "[0-5][0-9]"
_FILE_SHAPES = [
    _shape(f"{_C}{_MO}{_DD}-{_HH}{_NN}{_NN}", "%Y%m%d-%H%M%S"),
    _shape(f"{_C}{_MO}{_DD}_{_HH}{_NN}{_NN}", "%Y%m%d_%H%M%S"),
    _shape(f"{_C}-{_MO}-{_DD}-{_HH}-{_NN}-{_NN}", "%Y-%m-%d-%H-%M-%S"),
    _shape(f"{_C}-{_MO}-{_DD}-{_HH}{_NN}{_NN}", "%Y-%m-%d-%H%M%S"),
    _shape(f"{_C}{_MO}{_DD}{_HH}{_NN}{_NN}", "%Y%m%d%H%M%S"),
    _shape(f"{_C}_{_MO}_{_DD}_{_HH}_{_NN}_{_NN}", "%Y_%m_%d_%H_%M_%S"),
    "try_cast(nullif(regexp_extract(name, '(?:^|[^0-9])([0-9]{13})(?:[^0-9]|$)', 1), '') AS BIGINT) // 1000",
]
_DAY_SHAPES = [
    f"CAST(epoch(try_strptime(nullif(regexp_extract(name, '^(?:IMG|VID|AUD|PTT|STK)-({_C}{_MO}{_D2})-WA[0-9]+', 1), '') || '12', '%Y%m%d%H')) AS BIGINT)",
    f"CAST(epoch(try_strptime(nullif(regexp_extract(name, '^({_C}-{_MO}-{_D2})[_ ]', 1), '') || '12', '%Y-%m-%d%H')) AS BIGINT)",
    f"CAST(epoch(try_strptime(nullif(regexp_extract(name, '^({_C}{_MO}{_D2})_[^0-9]', 1), '') || '12', '%Y%m%d%H')) AS BIGINT)",
]
_OK = f"BETWEEN 631152000 AND {NOW + 86400}"

_GROUPS = "(SELECT *, CAST(epoch(instant) AS BIGINT) AS t FROM media_groups)"
_NEAR = f"""
    SELECT q.ord, d.offset_s AS value, abs(d.t - q.t) AS distance,
           row_number() OVER (PARTITION BY q.ord ORDER BY abs(d.t - q.t), d.ord) AS rn
    FROM {_GROUPS} q JOIN (SELECT t, min(ord) AS ord, arg_min(offset_s, ord) AS offset_s FROM {_GROUPS} WHERE offset_known AND tz_step <> 'filename' AND offset_s IS NOT NULL GROUP BY t) d
      ON d.t BETWEEN q.t - 129600 AND q.t + 129600
    WHERE NOT q.offset_known"""

_MEMBERS = "SELECT *, " + _class("rel_folder") + " AS class FROM entries WHERE NOT is_json AND NOT is_system"
_SCORE = "CASE WHEN class = 'library' AND (contains(lower(rel_folder), 'photo') OR starts_with(rel_folder, 'Фото') OR contains(rel_folder, 'Foto')) THEN 0 WHEN class = 'library' THEN 1 WHEN class = 'album' THEN 3 ELSE 4 END"

_PAIRABLE = """
    SELECT g.group_id AS id, g.kind, g.ord, e.rel_folder AS folder, lower(nfc_normalize(regexp_replace(regexp_replace(e.name, '[.][^.]*$', ''), '[.][mM][pPvV]$', ''))) AS stem, c.content_id
    FROM media_groups g LEFT JOIN entries e ON e.entry_id = g.canon_ord + 1
    LEFT JOIN (SELECT group_id, min(content_identifier) AS content_id FROM embedded_tags WHERE content_identifier IS NOT NULL GROUP BY 1) c ON c.group_id = g.group_id"""
_IMG = "kind IN ('jpeg','heic','png','gif','webp','tiff','bmp','raw','cr3')"
_VID = "kind IN ('mp4','mov')"
_LIVE = f"""
    p AS ({_PAIRABLE}),
    a AS (SELECT max(id) FILTER (WHERE {_IMG}) AS image, max(id) FILTER (WHERE {_VID}) AS video FROM p WHERE content_id <> '' GROUP BY content_id HAVING count(*) = 2 AND count(*) FILTER (WHERE {_IMG}) > 0 AND count(*) FILTER (WHERE {_VID}) > 0),
    f AS (SELECT * FROM p WHERE id NOT IN (SELECT image FROM a UNION ALL SELECT video FROM a)),
    b AS (SELECT coalesce(arg_max(id, ord) FILTER (WHERE kind = 'heic'), arg_min(id, ord) FILTER (WHERE {_IMG})) AS image, max(id) FILTER (WHERE {_VID}) AS video FROM f WHERE stem IS NOT NULL GROUP BY folder, stem HAVING count(*) FILTER (WHERE {_VID}) = 1),
    l AS (SELECT image, video, 'content-id' AS how FROM a UNION ALL SELECT image, video, 'stem' FROM b WHERE image IS NOT NULL)"""

_FATE = f"""
    SELECT entry_id, CASE WHEN is_symlink THEN 'symlink-skipped' WHEN is_system THEN 'system-file' WHEN NOT is_json AND {_SHOT} THEN 'excluded-screenshot' WHEN is_json THEN 'skipped-json'
           WHEN {_class("rel_folder")} = 'trash' THEN 'excluded-trash'
           WHEN ({_KIND}) = 'unknown' AND {_EXT} IN {_in(DOCUMENTS)} THEN 'not-importable'
           WHEN {_class("rel_folder")} = 'album' THEN 'album-clone' ELSE 'library' END AS fate
    FROM entries"""

_FIT = "list_extract(list_filter(list_transform(range(0, length({0}) + 1), lambda i: left({0}, CAST(i AS INTEGER))), lambda x: strlen(x) <= {1}), -1)"
_RESERVED = "^(?i)(con|prn|aux|nul|conin\\$|conout\\$|com[1-9¹²³]|lpt[1-9¹²³]) *(\\.|$)"
_CLEAN = "regexp_replace(regexp_replace(nfc_normalize({0}), '[\\x00-\\x1f\\x7f:/\\\\<>\"|?*]', '-', 'g'), '[. ]+$', '')"


def _sanitize(col: str) -> str:
    c = f"(CASE WHEN {_CLEAN.format(col)} = '' THEN 'file' ELSE {_CLEAN.format(col)} END)"
    return f"CASE WHEN regexp_matches({c}, '{_RESERVED}') THEN rtrim(regexp_extract({c}, '^([^.]*)', 1)) || '_' || substr({c}, length(regexp_extract({c}, '^([^.]*)', 1)) + 1) ELSE {c} END"


_NY = "CAST(epoch(timezone('America/New_York', timezone('UTC', o_orderdate))) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT)"
_PIN = "CAST(floor(epoch(timezone('Europe/Berlin', ts))) AS BIGINT)"

_T = "make_timestamp(t * 1000000)"
_LOC = "strftime(make_timestamp((t + coalesce(CASE WHEN offset_known THEN offset_s END, 0)) * 1000000), '%Y:%m:%d %H:%M:%S')"
_UTC = "strftime(make_timestamp(t * 1000000), '%Y:%m:%d %H:%M:%S')"
_OFF = "CASE WHEN offset_known AND offset_s IS NOT NULL THEN printf('%s%02d:%02d', CASE WHEN offset_s < 0 THEN '-' ELSE '+' END, abs(offset_s) // 3600, abs(offset_s) % 3600 // 60) ELSE '' END"


def _args(names: list[str], value: str) -> str:
    return " || ' ' || ".join(f"'-{n}=' || {value}" for n in names)


_ARGS = f"""CASE
    WHEN kind = 'gif' THEN {_args(["XMP-exif:DateTimeOriginal"], f"{_LOC} || {_OFF}")}
    WHEN {_VID} THEN {_args(["Keys:CreationDate"], f"{_LOC} || {_OFF}")} || ' ' || {_args(["QuickTime:CreateDate", "QuickTime:ModifyDate", "QuickTime:TrackCreateDate", "QuickTime:TrackModifyDate", "QuickTime:MediaCreateDate", "QuickTime:MediaModifyDate"], _UTC)}
    ELSE {_args(["EXIF:DateTimeOriginal", "EXIF:CreateDate", "EXIF:ModifyDate"], _LOC)}
      || CASE WHEN {_OFF} <> '' THEN ' ' || {_args(["EXIF:OffsetTimeOriginal", "EXIF:OffsetTimeDigitized", "EXIF:OffsetTime"], _OFF)} ELSE '' END
      || CASE WHEN kind = 'png' THEN ' ' || {_args(["XMP-exif:DateTimeOriginal", "XMP-xmp:CreateDate"], f"{_LOC} || {_OFF}")} ELSE '' END END"""

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) AS rn FROM journal WHERE id IS NOT NULL) WHERE rn = 1)"

_P5 = """
    WITH p AS (SELECT g.group_id, g.lat, g.lon FROM media_groups g WHERE g.lat BETWEEN -90 AND 90 AND g.lon BETWEEN -180 AND 180 AND NOT isnan(g.lat) AND NOT isnan(g.lon)
               AND g.sidecar_id IN (SELECT sidecar_id FROM sidecars WHERE has_geo)),
    circle AS (SELECT group_id, place_id FROM p JOIN places c ON c.shape = 'circle'
        AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))) <= c.radius_m),
    edges AS (SELECT place_id, i, ring[i].lon AS x0, ring[i].lat AS y0, ring[i + 1].lon AS x1, ring[i + 1].lat AS y1 FROM (SELECT place_id, ring, unnest(range(1, len(ring))) AS i FROM places WHERE shape = 'polygon')),
    box AS (SELECT place_id, min(x0) AS a, max(x0) AS b, min(y0) AS c, max(y0) AS d FROM edges GROUP BY 1),
    shifted AS (SELECT group_id, lat, lon + s AS lon FROM p, (VALUES (0), (360), (-360)) v(s)),
    near AS (SELECT group_id, lat, lon, place_id FROM shifted JOIN box ON lon BETWEEN a AND b AND lat BETWEEN c AND d),
    hits AS (SELECT group_id, near.place_id, lon, count(*) FILTER (WHERE (y0 > lat) <> (y1 > lat) AND x0 + (lat - y0) * (x1 - x0) / nullif(y1 - y0, 0) > lon) AS n FROM near JOIN edges ON edges.place_id = near.place_id GROUP BY ALL)
    SELECT group_id, place_id FROM circle UNION SELECT group_id, place_id FROM hits WHERE n % 2 = 1"""

_STEM, _DOT = "regexp_replace({0}, '[.][^.]*$', '')", "regexp_extract({0}, '([.][^.]*)$', 1)"
_BARE, _LIVE_STEM = "regexp_replace({0}, '[(][0-9]+[)]', '')", "lower(regexp_replace(regexp_replace({0}, '[.][^.]*$', ''), '(?i)[.]m[pv]$', ''))"


def _unedited(stem: str, longer: bool) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(lower({stem}), '{e}')" + (f" AND length({stem}) > {len(e)}" if longer else "") + f" THEN left({stem}, length({stem}) - {len(e)})" for e in EDITED) + f" ELSE {stem} END"


def _same_title(n: str) -> str:
    """Whether a name says what a title t, without its number u, says."""
    a = _BARE.format(n)
    return f"({n} = t OR {a} = t OR {a} = u OR {_STEM.format(a)} = t OR {_STEM.format(a)} = u OR {_LIVE_STEM.format(a)} = {_LIVE_STEM.format('u')})"


def _plain_name(n: str) -> str:
    return f"({_unedited(_STEM.format(n), True)}) || {_DOT.format(n)}"


_TITLES = f"""
    WITH a AS (SELECT sidecar_id, title, nfc_normalize(title) AS t, nfc_normalize(regexp_replace(regexp_extract(entry_name, '([^/]*)$', 1), '(?i)[.]json$', '')) AS n FROM sidecars),
    b AS (SELECT *, {_BARE.format("t")} AS u, {_plain_name("n")} AS p FROM a), c AS (SELECT *, {_plain_name("p")} AS pp FROM b)
    SELECT sidecar_id FROM c WHERE title <> '' AND NOT coalesce({_same_title("n")} OR {_same_title("p")} OR {_same_title("pp")}, false)"""


def _cut46(x: str) -> str:
    return f"(CASE WHEN strlen({x}) <= 46 THEN {x} ELSE {_FIT.format(x, 46)} END)"


_LONG, _TAIL = "(base || '.supplemental-metadata')", "(rest || '.supplemental-metadata')"
_OF_BASE = f"[{_LONG} || '.json', base || '.json', {_cut46(_LONG)} || '.json', {_cut46('base')} || '.json', base || '.metadata.json', {_cut46("(base || '.metadata')")} || '.json']"
_OF_NUMBER = (
    f"CASE WHEN number = '' THEN [] ELSE [{_TAIL} || number || '.json', rest || number || '.json', {_cut46(_TAIL)} || '.json', "
    f"CASE WHEN strlen({_TAIL}) <= 46 OR strlen({_cut46(_TAIL)}) = 46 THEN {_cut46(_TAIL)} || number || '.json' END] END"
)
_MATCH = f"""
    WITH e AS (SELECT * FROM entries WHERE NOT is_system AND NOT is_symlink),
    m AS (SELECT entry_id, rel_folder, unnest(CASE WHEN nfc_normalize(name) = name THEN [name] ELSE [name, nfc_normalize(name)] END) AS name, unnest(CASE WHEN nfc_normalize(name) = name THEN [1] ELSE [1, 2] END) AS form FROM e WHERE NOT is_json),
    s AS (SELECT *, {_STEM.format("name")} AS stem, {_DOT.format("name")} AS ext, {_unedited(_STEM.format("name"), False)} AS plain FROM m),
    b AS (SELECT entry_id, rel_folder, form, unnest(CASE WHEN plain = stem THEN [name, stem] ELSE [name, stem, plain || ext, plain] END) AS base, unnest(CASE WHEN plain = stem THEN [1, 2] ELSE [1, 2, 3, 4] END) AS k FROM s),
    n AS (SELECT *, regexp_extract(base, '[(][0-9]+[)]', 0) AS number, {_BARE.format("base")} AS rest FROM b WHERE base <> ''),
    l AS (SELECT entry_id, rel_folder, form, k, list_concat({_OF_BASE}, {_OF_NUMBER}) AS names FROM n),
    c AS (SELECT entry_id, rel_folder, form, k, unnest(names) AS candidate, unnest(range(len(names))) AS i FROM l),
    d AS (SELECT entry_id, rel_folder, candidate, min(form * 10000 + k * 100 + i) AS o FROM c WHERE candidate IS NOT NULL GROUP BY ALL),
    p AS (SELECT entry_id, rel_folder, candidate, row_number() OVER (PARTITION BY entry_id ORDER BY o) - 1 AS position FROM d),
    j AS (SELECT * FROM e WHERE is_json AND lower(name) NOT IN ('metadata.json', 'shared_album_comments.json', 'user-generated-memory-titles.json')),
    x AS (SELECT rel_folder, name, last(entry_id ORDER BY zip_ord, entry_ord, entry_id) AS sidecar_id FROM j GROUP BY ALL),
    y AS (SELECT rel_folder, nfc_normalize(name) AS name, min(entry_id) AS sidecar_id FROM j GROUP BY 1, 2 HAVING count(*) = 1),
    z AS (SELECT rel_folder, lower(nfc_normalize(name)) AS name, min(entry_id) AS sidecar_id FROM j GROUP BY 1, 2 HAVING count(*) = 1),
    h AS (SELECT p.entry_id, x.sidecar_id, 1 AS pass, position FROM p JOIN x ON x.rel_folder = p.rel_folder AND x.name = candidate
          UNION ALL SELECT p.entry_id, y.sidecar_id, 2, position FROM p JOIN y ON y.rel_folder = p.rel_folder AND y.name = nfc_normalize(candidate)
          UNION ALL SELECT p.entry_id, z.sidecar_id, 3, position FROM p JOIN z ON z.rel_folder = p.rel_folder AND z.name = lower(nfc_normalize(candidate)))
    SELECT entry_id, sidecar_id, CAST(pass AS INTEGER) AS pass, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY pass, position, sidecar_id) AS rn FROM h) WHERE rn = 1"""

ORACLES: dict[str, str] = {
    "p5_found": _P5,
    "archive_missing_parts": "SELECT export_id, CAST(part AS INTEGER) AS part FROM (SELECT export_id, unnest(range(1, max(part) + 1)) AS part FROM zips GROUP BY 1) WHERE (export_id, part) NOT IN (SELECT export_id, part FROM zips)",
    "archive_parts": "SELECT zip_path, regexp_extract(zip_path, 'takeout-([0-9]{8}T[0-9]{6}Z)-', 1) AS export_id, CAST(regexp_extract(zip_path, '-([0-9]{3,})[.]zip$', 1) AS BIGINT) AS part FROM zips",
    "line_gaps": "SELECT a.l_orderkey, a.l_linenumber FROM (SELECT l_orderkey, CAST(unnest(range(1, max(l_linenumber) + 1)) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1) a ANTI JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "path_check": "SELECT NOT (starts_with(entry_name, '/') OR contains(entry_name, chr(92)) OR list_contains(string_split(entry_name, '/'), '..')) AS safe, count(*) AS entries FROM entries GROUP BY 1",
    "root_split": f"WITH a AS (SELECT entry_id, string_split(entry_name, '/') AS p FROM entries), b AS (SELECT *, list_min(list_filter(list_transform({str(list(ROOTS)).replace(chr(34) + 'Google Foto' + chr(39) + 's' + chr(34), chr(39) + 'Google Foto' + chr(39) * 2 + 's' + chr(39))}, lambda r: list_position(p, r)), lambda x: x > 0)) AS k FROM a) SELECT entry_id, CASE WHEN k IS NOT NULL AND len(p) > k AND p[-1] <> '' THEN CASE WHEN len(p) - k >= 2 THEN p[k + 1] ELSE '' END END AS folder, CASE WHEN k IS NOT NULL AND len(p) > k AND p[-1] <> '' THEN p[-1] END AS file FROM b",
    "fallback_root": "WITH a AS (SELECT split_part(entry_name, '/', 2) AS root, count(*) FILTER (WHERE is_json) AS n_json, count(*) FILTER (WHERE NOT is_json) AS n_other FROM entries WHERE starts_with(entry_name, 'Takeout/') AND len(string_split(entry_name, '/')) >= 3 GROUP BY 1), b AS (SELECT * FROM a WHERE n_json > 0 AND n_other > 0) SELECT *, (SELECT count(*) FROM b) = 1 AS used FROM b",
    "system_files": "SELECT entry_id, name FROM entries WHERE list_contains(string_split(entry_name, '/'), '__MACOSX') OR starts_with(string_split(entry_name, '/')[-1], '._') OR lower(string_split(entry_name, '/')[-1]) IN ('.ds_store', 'thumbs.db', 'desktop.ini')",
    "album_json": "SELECT entry_id, rel_folder FROM entries WHERE lower(name) IN ('metadata.json', 'shared_album_comments.json', 'user-generated-memory-titles.json')",
    "folder_class": f"SELECT rel_folder, {_class(_FOLDER)} AS class, {_year(_FOLDER)} AS year, count(*) AS entries FROM entries GROUP BY rel_folder",
    "ext_kind": f"SELECT entry_id, {_KIND} AS kind FROM entries",
    "sniff_kind": "SELECT group_id, CASE WHEN kind IN ('jpeg','png','gif','webp','heic','mov','mp4','tiff') THEN kind ELSE 'unknown' END AS sniffed FROM media_groups",
    "screenshots": f"SELECT entry_id FROM entries WHERE NOT is_json AND {_SHOT}",
    "nfc_keys": "SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_hash FROM documents",
    "fold_keys": "SELECT entry_id, lower(nfc_normalize(name)) AS fold FROM entries",
    "byte_cut": f"SELECT entry_id, {_FIT.format('name', 46)} AS cut FROM entries",
    "clean_values": "SELECT doc_id, trim(regexp_replace(text, ' *[\\x00-\\x1f\\x7f][\\x00-\\x1f\\x7f ]*', ' ', 'g'), ' ') AS clean FROM documents",
    "stems": "SELECT entry_id, regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '(?i)[.]m[pv]$', '') AS stem, regexp_replace(name, '[(][0-9]+[)]', '') AS rest, regexp_extract(name, '[(]([0-9]+)[)]', 1) AS number FROM entries",
    "sanitized": f"SELECT entry_id, {_sanitize('name')} AS clean FROM entries WHERE strlen(name) <= 240 UNION ALL SELECT entry_id, NULL FROM entries WHERE strlen(name) > 240",
    "sidecar_fields": "SELECT sidecar_id, title, nullif(try_cast(CASE WHEN regexp_matches(taken, '^[+-]?[0-9]+$') THEN taken END AS BIGINT), 0) AS taken, nullif(try_cast(creation AS BIGINT), 0) AS creation, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN lat END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN lon END AS lon, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) THEN nullif(alt, 0) END AS alt FROM sidecars",
    "sidecar_exact": "WITH s AS (SELECT rel_folder, name, last(entry_id ORDER BY zip_ord, entry_ord, entry_id) AS sidecar_entry FROM entries WHERE is_json GROUP BY ALL) SELECT e.entry_id, s.sidecar_entry FROM entries e JOIN s ON s.rel_folder = e.rel_folder AND s.name = e.name || '.json' WHERE NOT e.is_json AND NOT e.is_system",
    "ambiguous_names": "SELECT rel_folder, lower(nfc_normalize(name)) AS fold, count(*) AS sidecars FROM entries WHERE is_json GROUP BY ALL HAVING count(*) > 1",
    "title_check": _TITLES,
    "sidecar_match": _MATCH,
    "neighbor_offset": f"SELECT ord, CAST(value AS BIGINT) AS value, distance FROM ({_NEAR}) WHERE rn = 1",
    "neighbor_by_user": "WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT event_id, value, distance FROM (SELECT q.event_id, d.event_id AS value, abs(d.t - q.t) AS distance, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(d.t - q.t), d.event_id) AS rn FROM e q JOIN e d ON d.user_id = q.user_id AND d.event_type = 'purchase' AND abs(d.t - q.t) <= 129600 WHERE q.event_type <> 'purchase') WHERE rn = 1",
    "live_pairs": f"WITH {_LIVE} SELECT * FROM l",
    "raw_pairs": f"WITH {_LIVE}, r AS (SELECT * FROM p WHERE id NOT IN (SELECT image FROM l UNION ALL SELECT video FROM l)) SELECT max(id) FILTER (WHERE kind IN ('raw','cr3')) AS raw, max(id) FILTER (WHERE kind IN ('jpeg','heic')) AS still FROM r GROUP BY folder, stem HAVING count(*) FILTER (WHERE kind IN ('raw','cr3')) = 1 AND count(*) FILTER (WHERE kind IN ('jpeg','heic')) = 1",
    "dedup_confirmed": "WITH a AS (SELECT doc_id, n_chars, strlen(text) AS octets, sha256(text) AS h FROM documents WHERE text IS NOT NULL), g AS (SELECT n_chars, octets, h, min(doc_id) AS group_ord, count(*) AS members, row_number() OVER (PARTITION BY n_chars, octets ORDER BY h) AS group_rank FROM a GROUP BY n_chars, octets, h) SELECT doc_id, group_ord, group_rank, members FROM a JOIN g USING (n_chars, octets, h)",
    "dedup_canonical": f"WITH m AS ({_MEMBERS}) SELECT size, crc32, arg_min(entry_id, ({_SCORE}) * 1000000000000 + entry_id) AS canon, count(*) AS n FROM m GROUP BY size, crc32",
    "near_names": "SELECT key, groups FROM (SELECT lower(nfc_normalize(name)) AS key, count(DISTINCT (size, crc32)) AS groups FROM entries WHERE NOT is_json AND NOT is_system GROUP BY 1) WHERE groups > 1",
    "conflicts": "WITH f AS (SELECT o_custkey, arg_min(o_orderdate, o_orderkey) AS d FROM orders GROUP BY 1) SELECT o.o_custkey, min(o.o_orderkey) AS o_orderkey FROM orders o JOIN f USING (o_custkey) WHERE abs(epoch(o.o_orderdate) - epoch(f.d)) > 31536000 GROUP BY 1",
    "distinct_times": "WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (SELECT user_id, 1 AS i, [t] AS kept FROM e WHERE i = 1 UNION ALL SELECT r.user_id, r.i + 1, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - e.t) <= 3600)) > 0 THEN r.kept ELSE list_append(r.kept, e.t) END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, CAST(max(len(kept)) AS BIGINT) AS n FROM r GROUP BY 1",
    "offset_mode": "SELECT kind, CAST(offset_s AS BIGINT) AS offset_s, n FROM (SELECT kind, offset_s, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, min(ord)) AS rn FROM media_groups WHERE offset_known AND offset_s IS NOT NULL GROUP BY 1, 2) WHERE rn = 1",
    "event_mode": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) WHERE rn = 1",
    "filename_dates": "WITH a AS (SELECT entry_id, name, " + ", ".join(f"{x} AS c{i}" for i, x in enumerate(_FILE_SHAPES)) + ", " + ", ".join(f"{x} AS d{i}" for i, x in enumerate(_DAY_SHAPES)) + " FROM entries WHERE NOT is_json AND NOT starts_with(name, '-')), b AS (SELECT entry_id, coalesce(" + ", ".join(f"CASE WHEN c{i} {_OK} THEN c{i} END" for i in range(7)) + ") AS c, coalesce(" + ", ".join(f"CASE WHEN d{i} {_OK} THEN d{i} END" for i in range(3)) + ") AS d FROM a) SELECT entry_id, coalesce(c, d) AS t, CASE WHEN c IS NOT NULL THEN 'filename' ELSE 'filename-date' END AS source FROM b WHERE coalesce(c, d) IS NOT NULL",
    "bounds": f"WITH a AS (SELECT sidecar_id, CASE WHEN regexp_matches(creation, '^[+-]?[0-9]+$') THEN try_cast(creation AS BIGINT) END AS c, try_cast(CASE WHEN regexp_matches(taken, '^[+-]?[0-9]+$') THEN taken END AS BIGINT) AS k FROM sidecars) SELECT sidecar_id, coalesce(c {_OK}, false) AS creation_ok, coalesce(k BETWEEN -5364662400 AND {NOW + 86400} AND k <> 0, false) AS taken_ok FROM a",
    "exif_walls": f"SELECT tag_id, {_WALL} AS wall FROM embedded_tags",
    "implied_offsets": f"WITH a AS (SELECT tag_id, {_WALL} AS wall, try_cast(CASE WHEN regexp_matches(taken, '^[+-]?[0-9]+$') THEN taken END AS BIGINT) AS k FROM embedded_tags JOIN media_groups USING (group_id) JOIN sidecars USING (sidecar_id)), b AS (SELECT tag_id, CAST(round((wall - k) / 60.0) AS BIGINT) * 60 AS offset_s FROM a WHERE k <> 0) SELECT tag_id, offset_s FROM b WHERE abs(offset_s) <= 50400 AND offset_s % 900 = 0",
    "dated_sidecars": f"WITH a AS (SELECT sidecar_id, try_cast(creation AS BIGINT) AS c, try_cast(CASE WHEN regexp_matches(taken, '^[+-]?[0-9]+$') THEN taken END AS BIGINT) AS k FROM sidecars), b AS (SELECT sidecar_id, coalesce(k BETWEEN -5364662400 AND {NOW + 86400} AND k <> 0, false) AS ok, c, k FROM a) SELECT sidecar_id, CASE WHEN ok THEN k ELSE c END AS t, year(make_timestamp((CASE WHEN ok THEN k ELSE c END) * 1000000)) AS year, CASE WHEN ok THEN 'json-taken' ELSE 'json-creation' END AS source FROM b WHERE ok OR c {_OK}",
    "local_years": f"SELECT o_orderkey, {_NY} AS offset_s, year(timezone('America/New_York', timezone('UTC', o_orderdate))) AS year FROM orders",
    "pinned_clocks": f"SELECT event_id, {_PIN} AS instant_s, CAST(floor(epoch(ts)) AS BIGINT) - {_PIN} AS offset_s FROM events",
    "offset_fill": f"WITH n AS (SELECT ord, value FROM ({_NEAR}) WHERE rn = 1), m AS (SELECT offset_s FROM media_groups WHERE offset_known AND offset_s IS NOT NULL AND coalesce(tz_step, '') <> 'filename' AND instant IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(ord) LIMIT 1), a AS (SELECT g.ord, CASE WHEN g.offset_known THEN g.offset_s END AS own, g.tz_step, n.value, g.source IN ('filename', 'filename-date', 'unknown') OR g.instant IS NULL AS fixed FROM media_groups g LEFT JOIN n USING (ord)) SELECT ord, CAST(CASE WHEN own IS NOT NULL OR fixed THEN own ELSE coalesce(value, (SELECT offset_s FROM m), 0) END AS BIGINT) AS offset_s, CASE WHEN own IS NOT NULL OR fixed THEN tz_step WHEN value IS NOT NULL THEN 'neighbor' WHEN (SELECT offset_s FROM m) IS NOT NULL THEN 'common' ELSE 'utc' END AS tz_step FROM a",
    "date_actions": f"SELECT tag_id, CASE WHEN wall IS NULL OR abs(wall - t) > 60 THEN 'write' ELSE 'keep' END AS action FROM (SELECT tag_id, {_WALL} AS wall, t FROM embedded_tags JOIN {_GROUPS} g USING (group_id) WHERE t IS NOT NULL)",
    "file_numbers": "SELECT p_partkey, p_name || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.jpg' AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM part)",
    "album_numbers": f"WITH f AS (SELECT DISTINCT rel_folder AS folder FROM entries WHERE {_class('rel_folder')} = 'album'), s AS (SELECT folder, {_sanitize('folder')} AS base FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY lower(nfc_normalize(base)) ORDER BY folder) AS n FROM s) SELECT folder, base || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS name FROM n",
    "stride_sample": "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(count(*) OVER () // 500, 1) AS step FROM orders) SELECT o_orderkey FROM a WHERE i % step = 0 AND i // step < 500",
    "album_clones": f"WITH m AS ({_MEMBERS}) SELECT size || ':' || crc32 AS file, rel_folder, min(entry_id) AS entry_id FROM m WHERE class = 'album' GROUP BY 1, 2",
    "tag_plan": f"SELECT group_id, {_ARGS} AS args FROM {_GROUPS} WHERE t IS NOT NULL",
    "entry_fates": _FATE,
    "ledger_balance": "SELECT count(*) AS entries, count(*) AS fates, count(DISTINCT entry_id) AS distinct_ids, CAST(0 AS BIGINT) AS unknown, count(*) = count(DISTINCT entry_id) AS balanced FROM entries",
    "report_rollup": "SELECT metric, key, count(*) AS value FROM (SELECT 'formats' AS metric, kind AS key FROM media_groups UNION ALL SELECT 'years', CAST(year AS VARCHAR) FROM media_groups UNION ALL SELECT 'date_sources', source FROM media_groups UNION ALL SELECT 'timezone_steps', tz_step FROM media_groups UNION ALL SELECT 'with_gps', 'yes' FROM media_groups WHERE lat IS NOT NULL AND lon IS NOT NULL) WHERE key IS NOT NULL GROUP BY 1, 2",
    "size_estimate": "SELECT CAST(s + s // 10 AS BIGINT) AS bytes FROM (SELECT CAST(sum(e.size * g.n_members) AS BIGINT) AS s FROM media_groups g JOIN entries e ON e.entry_id = g.canon_ord + 1)",
    "fat_limit": f"SELECT count(*) FILTER (WHERE CASE WHEN kind = 'webm' THEN size * 40 * 3 / 2 ELSE size * 40 END > 4294967295) AS files FROM (SELECT size, {_KIND} AS kind FROM entries)",
    "first_errors": "WITH a AS (SELECT rec_id AS ord, error AS message FROM journal WHERE error IS NOT NULL) SELECT * FROM (SELECT * FROM a ORDER BY ord LIMIT 200) UNION ALL SELECT NULL, 'and ' || n || ' more' FROM (SELECT count(*) - 200 AS n FROM a) WHERE n > 0",
    "journal_latest": f"SELECT id, rec_id, stage, path, year, name FROM {_LATEST}",
    "pending_groups": f"SELECT g.group_id, CASE WHEN j.stage = 'placed' THEN 'albums' ELSE 'all' END AS todo FROM media_groups g LEFT JOIN {_LATEST} j ON j.id = g.group_id WHERE j.stage IS NULL OR j.stage <> 'cloned'",
    "missing_files": f"WITH d AS (SELECT * FROM {_LATEST} WHERE stage IN ('placed', 'cloned')) SELECT DISTINCT path FROM (SELECT path FROM d UNION ALL SELECT unnest(albums) FROM d) WHERE path <> '' AND path NOT IN (SELECT path FROM journal WHERE stage = 'placing' AND path IS NOT NULL)",
    "year_mismatch": "WITH a AS (SELECT tag_id, CAST(year AS VARCHAR) AS folder, kind, CASE WHEN try_cast(substr(dto, 1, 4) AS INTEGER) BETWEEN 1800 AND 2100 THEN try_cast(substr(dto, 1, 4) AS BIGINT) END AS y1, CASE WHEN try_cast(substr(creation_date, 1, 4) AS INTEGER) BETWEEN 1800 AND 2100 THEN try_cast(substr(creation_date, 1, 4) AS BIGINT) END AS y2 FROM embedded_tags JOIN media_groups USING (group_id)) SELECT tag_id, folder, coalesce(y1, y2) AS tag_year FROM a WHERE regexp_matches(folder, '^[0-9]{4}$') AND kind NOT IN ('raw', 'cr3', 'unknown', 'avi', 'bmp', 'mpg', 'wmv') AND (coalesce(y1, y2) IS NULL OR coalesce(y1, y2) <> CAST(folder AS BIGINT))",
}
ORACLES["placeholder_users"] = "SELECT user_id FROM (" + ORACLES["distinct_times"] + ") JOIN (SELECT user_id, count(*) AS c, arg_min(value, event_id) AS v FROM events GROUP BY 1) USING (user_id) WHERE n >= 3 AND c >= 3 AND v <= 50"

_DISTINCT = "(SELECT DISTINCT regexp_extract(zip_path, '([^/]*)$', 1) AS zip, entry_name FROM entries)"
_KEPT = "CASE WHEN kind IN ('raw', 'unknown') OR (" + _KIND + ") = kind THEN regexp_extract(name, '([.][^.]*)$', 1) " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in EXTENSION_OF.items()) + " END"
_CAPTION = "trim(regexp_replace(description, ' *[\\x00-\\x1f\\x7f][\\x00-\\x1f\\x7f ]*', ' ', 'g'), ' ')"
_SPOT = f"""CASE WHEN {_VID} THEN '-Keys:GPSCoordinates=' || printf('%.6f', la) || ', ' || printf('%.6f', lo) || coalesce(', ' || printf('%.3f', al), '')
    ELSE '-GPSLatitude=' || printf('%.6f', abs(la)) || ' -GPSLatitudeRef=' || CASE WHEN la < 0 THEN 'S' ELSE 'N' END || ' -GPSLongitude=' || printf('%.6f', abs(lo)) || ' -GPSLongitudeRef=' || CASE WHEN lo < 0 THEN 'W' ELSE 'E' END
      || coalesce(' -GPSAltitude=' || printf('%.3f', abs(al)) || ' -GPSAltitudeRef=' || CASE WHEN al < 0 THEN '1' ELSE '0' END, '') END"""
ORACLES |= {
    "archive_index": f"SELECT zip, entry_name, CAST(strlen(entry_name) AS BIGINT) AS size, false AS is_symlink FROM {_DISTINCT}",
    "archive_bodies": f"SELECT zip, entry_name, sha256(entry_name) AS sha256, CAST(strlen(entry_name) AS BIGINT) AS octets, CAST(NULL AS VARCHAR) AS error FROM {_DISTINCT} WHERE ends_with(lower(entry_name), '.json')",
    "journal_lines": "SELECT id, sha, stage, path, year, name, error, CAST(coalesce(len(albums), -1) AS BIGINT) AS albums FROM journal WHERE id IS NOT NULL",
    "fallback_entries": f"""WITH a AS (SELECT entry_id, string_split(entry_name, '/') AS p FROM entries WHERE starts_with(entry_name, 'Takeout/')), b AS (SELECT *, CASE WHEN len(p) > 3 THEN trim(translate(p[3], chr(160) || chr(8239) || chr(8199), '   '), ' ' || chr(9) || chr(8195) || chr(12288)) ELSE '' END AS f FROM a WHERE len(p) >= 3 AND p[-1] <> '' AND p[2] IN (SELECT root FROM ({ORACLES["fallback_root"]}) WHERE used))
        SELECT entry_id, CASE WHEN try_cast(y AS INTEGER) BETWEEN 1800 AND 2100 THEN 'Photos from ' || y ELSE f END AS folder, p[-1] AS file FROM (SELECT *, regexp_extract(f, '^(?:\\p{{L}}[\\p{{L}}'' ]*[ _-])?((?:18|19|20)[0-9]{{2}})(?:[ _-][\\p{{L}}'' ]*\\p{{L}})?$', 1) AS y FROM b)""",
    "picked_values": "WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS b, max(event_id) OVER (PARTITION BY user_id) AS canon FROM events) SELECT user_id, coalesce(max(event_id) FILTER (WHERE b AND event_id = canon), min(event_id) FILTER (WHERE b)) AS event_id FROM e GROUP BY 1",
    "fate_union": "WITH a AS (SELECT l_orderkey AS o_orderkey, min(l_returnflag) AS mark FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey, min(o_orderstatus) AS mark FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.mark, a.mark) AS mark FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey",
    "shared_times": f"WITH {_LIVE}, h AS (SELECT image AS id, video AS other FROM l UNION ALL SELECT video, image FROM l), g AS (SELECT group_id, t, source, t IS NULL OR source IN ('filename', 'filename-date') AS weak FROM {_GROUPS}) SELECT g.group_id, CASE WHEN g.weak AND NOT o.weak THEN o.t ELSE g.t END AS t, CASE WHEN g.weak AND NOT o.weak THEN 'live' ELSE g.source END AS source FROM g LEFT JOIN h ON h.id = g.group_id LEFT JOIN g o ON o.group_id = h.other",
    "output_names": f"SELECT group_id, {_KEPT} AS ext FROM media_groups g JOIN entries e ON e.entry_id = g.canon_ord + 1",
    "directories": "SELECT CASE WHEN coalesce(placeholder, false) THEN 'placeholders' WHEN kind = 'webm' THEN 'not-importable' WHEN year IS NULL THEN 'unknown' ELSE lpad(CAST(year AS VARCHAR), 4, '0') END AS dir, count(*) AS files FROM media_groups GROUP BY 1",
    "tag_places": f"SELECT group_id, {_SPOT} || CASE WHEN kind <> 'gif' AND {_CAPTION} <> '' THEN ' -Description=' || {_CAPTION} || ' -ImageDescription=' || {_CAPTION} ELSE '' END AS args FROM (SELECT *, floor(lat * 1000) / 1000 AS la, floor(lon * 1000) / 1000 AS lo, floor(alt * 10) / 10 AS al FROM media_groups WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)",
    "last_purchases": "SELECT event_id, max(event_id) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS last_known FROM events",
}
