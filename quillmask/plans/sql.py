"""DuckDB SQL with the same rows as the queries, for the check of results."""

from __future__ import annotations

from ..functions.text import BOUNDARY, STOP_WORDS, WS
from ..sources.harness import TABLE

_WS = WS.replace(r"\x0B", r"\x{0B}")
_TRIM = rf"\A[{_WS}]+|[{_WS}]+\z"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {_q(_TRIM)}, '', 'g')"


def bare(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'[{_WS}]+')}, '', 'g')"


def masked(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'[^{_WS}]')}, 'X', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def phone(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9+]', '', 'g')"


def is_phone(x: str) -> str:
    return rf"regexp_matches({x}, '\A[+]?[0-9 ()-]{{6,}}\z')"


def is_card(x: str) -> str:
    return f"(length({digits(x)}) BETWEEN 12 AND 19 OR (starts_with({bare(x)}, 'DE') AND length({bare(x)}) >= 8))"


def is_stop(x: str) -> str:
    return f"lower({trim(x)}) IN ({', '.join(_q(w) for w in STOP_WORDS)})"


#: docs (doc_id, text), det (doc_id, text, det_idx, type, value): the derived detections.
BASE = r"""docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), got AS (
  SELECT doc_id, text,
    regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]') AS email, regexp_extract(text, '[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}') AS card,
    regexp_extract(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}') AS phone, regexp_extract(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS ip,
    regexp_extract(text, '[A-Za-z]{10,}') AS name, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') AS pair
  FROM docs
), nested AS (
  SELECT doc_id, text, list_concat(list_filter([
    {'type': 'EMAIL', 'value': email}, {'type': 'CARD', 'value': card}, {'type': 'PHONE', 'value': phone}, {'type': 'IP', 'value': ip}, {'type': 'NAME', 'value': name}, {'type': 'PAIR', 'value': pair},
    {'type': 'PART', 'value': substring(name, 3, 5)}, {'type': 'NAME', 'value': name}, {'type': 'NAME', 'value': CASE WHEN name <> '' THEN name || ' ' ELSE '' END}], lambda d: d.value <> ''),
    [{'type': 'OTHER', 'value': 'Zyxwv ' || doc_id}, {'type': 'STOP', 'value': 'und'}, {'type': 'EMPTY', 'value': ''}, {'type': 'BLANK', 'value': '  '}]) AS dets
  FROM got
), det AS (
  SELECT doc_id, text, CAST(unnest(range(len(dets))) AS INTEGER) AS det_idx, unnest(dets).type AS type, unnest(dets).value AS value FROM nested
)"""


def hits(source: str, value: str = "value", name: str = "hits") -> str:
    """CTEs that end in ``name``: a row of source for each occurrence of its value, with s and e."""
    return f"""{name}_split AS (
  SELECT *, string_split(text, {value}) AS parts FROM {source} WHERE {value} <> '' AND contains(text, {value})
), {name}_each AS (
  SELECT *, unnest(range(1, len(parts))) AS i FROM {name}_split
), {name} AS (
  SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length({value}) AS INTEGER) AS s,
    CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * length({value}) AS INTEGER) AS e FROM {name}_each
)"""


_CHAR = f"[{_WS}{BOUNDARY}]".replace(r"\x22", '"')
_BOUNDARY = f"(CASE WHEN s <= 0 THEN true ELSE regexp_matches(substring(text, s, 1), {_q(_CHAR)}) END AND CASE WHEN e >= length(text) THEN true ELSE regexp_matches(substring(text, e + 1, 1), {_q(_CHAR)}) END)"

#: found: every hit with whether it counts; ev: a row for each detection with its bucket.
EVAL = f"""{BASE}, {hits("det")}, found AS (
  SELECT doc_id, det_idx, value, s, e, contains(value, '@') OR {_BOUNDARY} AS good FROM hits WHERE NOT {is_phone("value")}
  UNION ALL
  SELECT doc_id, det_idx, value, -1, -1, true FROM det WHERE {is_phone("value")} AND {phone("value")} <> '' AND contains({phone("text")}, {phone("value")})
), per AS (
  SELECT doc_id, det_idx, count(*) AS n_all, count(*) FILTER (good) AS n_good, bool_or(s = -1 AND good) AS streamed FROM found GROUP BY ALL
), ev AS (
  SELECT d.doc_id, d.det_idx, d.value, {trim("d.value")} AS key, coalesce(n_all, 0) AS n_all, coalesce(n_good, 0) AS n_good,
    CASE WHEN d.value = '' OR n_all IS NULL THEN 'notFound' WHEN n_good = 0 THEN 'partials' ELSE 'matched' END AS bucket,
    CASE WHEN n_good > 0 THEN CASE WHEN streamed THEN 'partial' ELSE 'exact' END END AS status
  FROM det d LEFT JOIN per USING (doc_id, det_idx)
), held AS (
  SELECT doc_id, value, sum(n_good) AS n FROM ev GROUP BY ALL
), dup AS (
  SELECT k.doc_id, k.key AS value, k.n AS count_in_json, CAST(coalesce(h.n, 0) AS BIGINT) AS count_in_doc, CAST(k.n - coalesce(h.n, 0) AS BIGINT) AS extra
  FROM (SELECT doc_id, key, count(*) AS n FROM ev GROUP BY ALL) k LEFT JOIN held h ON h.doc_id = k.doc_id AND h.value = k.key
  WHERE k.n > coalesce(h.n, 0)
)"""

#: vals: trimmed values that aren't blank, each with its variants; marks: distinct ranges.
_VARIANT = f"""{BASE}, vals AS (
  SELECT doc_id, det_idx, text, {trim("value")} AS v FROM det WHERE {trim("value")} <> ''
), var AS (
  SELECT DISTINCT doc_id, det_idx, text, unnest([v, {bare("v")}, regexp_replace(v, {_q(f'[{_WS}]+')}, ' ', 'g'), regexp_replace(v, {_q(f'[{_WS}]+')}, '  ', 'g')]) AS value FROM vals
), {hits("var", name="vh")}, marks AS (
  SELECT DISTINCT doc_id, det_idx, s, e FROM vh
)"""
_MERGED = f"""{_VARIANT}, spans AS (
  SELECT DISTINCT doc_id, s, e FROM marks
), turned AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM turned
), merged AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY doc_id, g
)"""

#: items (page items), sizes, line rows and their matches.
_ITEMS = """docs0 AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), rawlines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs0
), worded AS (
  SELECT doc_id, line, string_split(body, ' ') AS w, unnest(string_split(body, ' ')) AS str, generate_subscripts(string_split(body, ' '), 1) - 1 AS n FROM rawlines
), items AS (
  SELECT doc_id, CAST(line // 50 AS INTEGER) AS page, CAST(line * 100000 + n AS INTEGER) AS item_idx, str,
    6.0::DOUBLE * (coalesce(list_sum(list_transform(w[1:n], lambda x: length(x))), 0) + n) AS x, CAST(800.0 - 14.0 * (line % 50) + n % 3 AS DOUBLE) AS y, 6.0::DOUBLE * length(str) AS width, 12.0::DOUBLE AS height
  FROM worded
)"""
_LINES = f"""{_ITEMS}, kept AS (
  SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY item_idx)) >= 5 THEN 1 ELSE 0 END AS fresh FROM items WHERE {trim("str")} <> ''
), numbered AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY item_idx) AS INTEGER) AS line_id FROM kept
), lines AS (
  SELECT doc_id, page, line_id, count(*) AS n_items, string_agg(str, ' ' ORDER BY item_idx) AS text FROM numbered GROUP BY ALL
)"""
_DISTINCT = f"""trimmed AS (
  SELECT doc_id, det_idx, type, {trim("value")} AS value FROM det WHERE {trim("value")} <> ''
), dist AS (
  SELECT doc_id, min(det_idx) AS det_idx, arg_min(type, det_idx) AS type, value FROM trimmed GROUP BY doc_id, value
)"""
_MATCH = f"""{BASE}, {_DISTINCT}, {_LINES}, tiers AS (
  SELECT l.doc_id, l.page, l.line_id, d.value, d.det_idx,
    CASE WHEN contains(l.text, d.value) THEN 1 WHEN contains({bare("l.text")}, {bare("d.value")}) THEN 2 WHEN {is_card("d.value")} AND contains({digits("l.text")}, {digits("d.value")}) THEN 3 END AS tier
  FROM lines l JOIN dist d ON l.doc_id = d.doc_id WHERE NOT {is_stop("d.value")}
), matched AS (
  SELECT doc_id, page, value, det_idx, line_id, tier FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page, value ORDER BY line_id) = 1
)"""

#: The letters beyond ASCII in the driver's tables. DuckDB's edit distance counts bytes, so they stand as single ones.
_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_BYTES = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])


def distance(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{_LETTERS}', {_BYTES}), translate({b}, '{_LETTERS}', {_BYTES}))::DOUBLE"


def _ocr(x: str) -> str:
    """Recognised text as it is compared: lower case, without accents, white space single."""
    return rf"trim(regexp_replace(lower(strip_accents({x})), '\s+', ' ', 'g'))"


#: noted: every detection with the notes of a review with suggestions.
_NOTED = f"""{EVAL}, listed AS (
  SELECT ev.*, row_number() OVER (PARTITION BY doc_id, key ORDER BY det_idx) - 1 AS nth FROM ev
), segments AS (
  SELECT e.doc_id, e.det_idx, e.value, p, substring(d.text, p, length(e.value) + 4) AS seg
  FROM ev e JOIN docs d USING (doc_id), unnest(range(CASE WHEN 1.0::DOUBLE - 4.0::DOUBLE / (length(e.value) + 4) >= 0.7::DOUBLE THEN 1 ELSE greatest(1, length(d.text) - length(e.value) - 3) END, length(d.text) - length(e.value) + 2)) AS u(p)
  WHERE e.value <> '' AND e.n_all = 0 AND length(d.text) >= length(e.value)
), near AS (
  SELECT doc_id, det_idx, list(seg ORDER BY p)[1:3] AS segs FROM segments WHERE 1.0::DOUBLE - {distance("value", "seg")} / greatest(length(value), length(seg)) >= 0.7::DOUBLE GROUP BY ALL
), windows AS (
  SELECT f.doc_id, f.det_idx, f.s, f.value, substring(d.text, greatest(0, f.s - 14) + 1, least(length(d.text), f.e + 14) - greatest(0, f.s - 14)) AS around FROM found f JOIN docs d USING (doc_id) WHERE f.s >= 0
), closest AS (
  SELECT doc_id, det_idx, arg_min(around, s) AS around FROM windows WHERE 1.0::DOUBLE - {distance("value", "around")} / greatest(length(value), length(around)) >= 0.75::DOUBLE GROUP BY ALL
), noted AS (
  SELECT l.doc_id, l.det_idx, d.type, l.value, l.bucket, x.count_in_json, x.count_in_doc, list_filter([
    CASE WHEN l.value = '' THEN 'Empty value in JSON.' WHEN l.n_all = 0 THEN 'Not found; nearest text candidates: ' || array_to_string(list_transform(n.segs, lambda s: '"' || s || '"'), ', ') || '.'
      WHEN l.n_good = 0 THEN 'Found only as a substring (token boundary mismatch).' WHEN l.n_good > 1 THEN 'Appears ' || l.n_good || ' times in document.' END,
    CASE WHEN nth >= k.count_in_doc THEN 'Duplicate: JSON lists ' || k.count_in_json || ', but document has ' || k.count_in_doc || '.' END,
    CASE WHEN l.bucket = 'partials' THEN 'Partial match near “…' || c.around || '…”. Consider boundary/spacing/diacritics issues.' END], lambda x: x IS NOT NULL) AS notes
  FROM listed l JOIN det d USING (doc_id, det_idx) LEFT JOIN dup k ON l.doc_id = k.doc_id AND l.key = k.value LEFT JOIN dup x ON l.doc_id = x.doc_id AND l.value = x.value
    LEFT JOIN near n ON l.doc_id = n.doc_id AND l.det_idx = n.det_idx LEFT JOIN closest c ON l.doc_id = c.doc_id AND l.det_idx = c.det_idx
)"""
#: pieces: the runs of the derived word-processor documents, p the paragraph, r the run in it.
_PIECES = f"""{BASE}, escaped AS (
  SELECT doc_id, text, dets, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM nested
), paragraphs AS (
  SELECT doc_id, unnest(string_split(x, chr(10))) AS line, CAST(generate_subscripts(string_split(x, chr(10)), 1) - 1 AS INTEGER) AS p FROM escaped
), cut AS (
  SELECT doc_id, p, regexp_extract_all(line, '(?s).{{1,40}}') AS parts FROM paragraphs
), pieces AS (
  SELECT doc_id, p, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS r, unnest(parts) AS piece FROM cut
)"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


#: pieces: the runs of the derived nested documents; p is null in content controls.
_NESTED = f"""{BASE}, lined AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM docs
), paragraphs AS (
  SELECT *, CASE WHEN line_no % 11 <> 10 THEN CAST(line_no - line_no // 11 AS INTEGER) END AS p FROM lined
), pieces AS (
  SELECT doc_id, line_no, p, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS r, unnest(parts) AS piece FROM (SELECT *, regexp_extract_all(line, '(?s).{{1,7}}') AS parts FROM paragraphs)
)"""
#: hit: the items that hold each matched value, numbered. No line of the derived pages has a run of items with a label; those are held against a plain version in the tests.
_STRICT_CARD = rf"regexp_matches(value, {_q(rf'\A[0-9]{{4}}[{_WS}][0-9]{{4}}[{_WS}][0-9]{{4}}[{_WS}][0-9]{{4}}\z')})"


def _held(numbers: bool) -> str:
    most = f"CASE WHEN {is_card('value')} OR starts_with(value, 'DE') THEN 6 ELSE 5 END" if numbers else "5"
    enough = f"""AND CASE WHEN {is_card("value")} AND {_STRICT_CARD} THEN length({digits("joined")}) / nullif(length({bare("joined")}), 0)::DOUBLE >= 0.5
      WHEN {is_card("value")} AND starts_with(value, 'DE') THEN length({digits("joined")}) >= length({digits("value")}) * 0.3 ELSE true END"""
    return f"""{_MATCH}, bodies AS (
  SELECT doc_id, page, line_id, list({{'str': str, 'x': x, 'y': y, 'width': width, 'height': height}} ORDER BY item_idx) AS items FROM numbered GROUP BY ALL
), tried AS (
  SELECT m.*, b.items, list_filter(b.items, lambda i: contains(i.str, m.value)) AS exact, list_filter(b.items, lambda i: contains({bare("i.str")}, {bare("m.value")})) AS bare
  FROM matched m JOIN bodies b USING (doc_id, page, line_id)
), combos AS (
  SELECT doc_id, page, value, i, k, items[i:i + k - 1] AS part, array_to_string(list_transform(items[i:i + k - 1], lambda x: x.str), ' ') AS joined
  FROM tried, unnest(range(1, len(items) + 1)) AS a(i), unnest(range(1, 7)) AS b(k) WHERE len(exact) = 0 AND len(bare) = 0 AND i + k - 1 <= len(items) AND k <= {most}
), runs AS (
  SELECT doc_id, page, value, arg_min(part, i * 10 + k) AS part FROM combos WHERE contains({bare("joined")}, {bare("value")}) {enough if numbers else ""} GROUP BY ALL
), held AS (
  SELECT t.doc_id, t.page, t.value, t.det_idx, CASE WHEN len(exact) > 0 THEN 'exact' WHEN len(bare) > 0 THEN 'bare' WHEN r.part IS NOT NULL THEN 'run' END AS how,
    CASE WHEN len(exact) > 0 THEN exact WHEN len(bare) > 0 THEN bare ELSE coalesce(r.part, []) END AS found
  FROM tried t LEFT JOIN runs r USING (doc_id, page, value)
), single AS (
  SELECT doc_id, page, value, det_idx, how, unnest(found) AS i, generate_subscripts(found, 1) AS n FROM held
), split AS (
  SELECT *, length(i.str) - length(string_split(i.str, ':')[-1]) AS colon, {trim("string_split(i.str, ':')[-1]")} AS after FROM single
), sized AS (
  SELECT *, CASE WHEN contains(i.str, ':') AND contains(i.str, value) AND length(i.str) > length(value) AND ({bare("after")} = {bare("value")} OR (contains(after, value) AND length(value) >= length(after) * 0.5))
      AND contains(substring(i.str, colon), value) THEN colon - 1 + strpos(substring(i.str, colon), value) ELSE 0 END AS place FROM split
), hit AS (
  SELECT doc_id, page, value, det_idx, n, CASE WHEN place > 0 THEN value ELSE i.str END AS str, CASE WHEN place > 0 THEN i.x + i.width / length(i.str) * (place - 1) ELSE i.x END AS x, i.y AS y,
    CASE WHEN place > 0 THEN i.width / length(i.str) * length(value) ELSE i.width END AS width, i.height AS height FROM sized
)"""


def _grams(own: str, whole: str, n: int) -> str:
    """Whether any n characters in a row of own stand in whole."""
    return f"len(list_filter(range(1, length({own}) - {n - 2}), lambda p: contains({whole}, substring({own}, p, {n})))) > 0"


_RELEVANT = f"""(CASE WHEN starts_with(value, 'CUST-') THEN contains(str, 'CUST') OR contains(str, '-') OR regexp_matches(str, '[0-9]') ELSE true END)
  AND CASE WHEN NOT {is_card("value")} THEN true
    WHEN {_STRICT_CARD} THEN CASE WHEN length({digits("str")}) >= 3 THEN {_grams(digits("str"), digits("value"), 3)} ELSE {digits("str")} <> '' AND contains({digits("value")}, {digits("str")}) END
    WHEN starts_with(value, 'DE') THEN {_grams(f"upper({bare('value')})", f"upper({bare('str')})", 3)} OR (length({bare("str")}) <= 4 AND contains(upper({bare("value")}), upper({bare("str")})))
    ELSE {digits("value")} <> '' AND CASE WHEN length({digits("str")}) = 1 THEN contains({digits("value")}, {digits("str")}) ELSE {_grams(digits("str"), digits("value"), 2)} END END"""

SQL: dict[str, str] = {
    "file_kinds": rf"""
WITH f AS (
  SELECT doc_id, coalesce(text, '') AS text, 'f' || doc_id || '.' || ['docx', 'doc', 'PDF', 'jpg', 'tif', 'TIFF', 'x.png', 'webp'][doc_id % 8 + 1] AS name, CASE WHEN doc_id % 8 = 4 THEN 'image/tiff' ELSE '' END AS mime FROM documents
), k AS (
  SELECT *, CASE WHEN lower(name) LIKE '%.docx' THEN 'docx' WHEN lower(name) LIKE '%.doc' THEN 'doc' WHEN lower(name) LIKE '%.pdf' THEN 'pdf'
    WHEN regexp_matches(lower(name), '\.(jpg|jpeg|png|gif|bmp|tiff|webp)$') OR starts_with(mime, 'image/') THEN 'image' END AS file_type FROM f
)
SELECT doc_id, file_type,
  CASE file_type WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'doc' THEN 'application/msword' WHEN 'pdf' THEN 'application/pdf' ELSE mime END AS media_type,
  coalesce(file_type = 'image', false) AS is_image,
  regexp_replace(name, '\.[^/.]+$', '') || '_MASKED.' || CASE WHEN regexp_matches(lower(name), '\.(jpg|jpeg|png|gif|bmp|tiff|webp)$') THEN 'png' ELSE lower(regexp_extract(name, '[^.]*$')) END AS output_name,
  length({trim("text")}) < 100 AS is_scanned
FROM k""",
    "parse_detections": f"WITH {BASE} SELECT doc_id, det_idx, type, value FROM det",
    "scalar_predicates": rf"""
WITH {BASE}
SELECT doc_id, det_idx, {phone("value")} AS phone_digits, contains(value, '@') AS is_email, {is_phone("value")} AS is_phone,
  regexp_matches(value, {_q(rf"\A[0-9]{{4}}[{_WS}][0-9]{{4}}[{_WS}][0-9]{{4}}[{_WS}][0-9]{{4}}\z")}) AS is_strict_card, {is_card("value")} AS is_card_or_iban,
  round(length({digits("value")}) / nullif(length({bare("value")}), 0)::DOUBLE, 6) AS digit_ratio,
  CAST(len(list_distinct([value, {bare("value")}, regexp_replace(value, {_q(f'[{_WS}]+')}, ' ', 'g'), regexp_replace(value, {_q(f'[{_WS}]+')}, '  ', 'g')])) AS BIGINT) AS n_variants,
  {is_stop("value")} AS is_stop_word, {masked("value")} AS masked, repeat('X', greatest(4, CAST(floor(length(value) * 6.0 / 8) AS BIGINT))) AS overlay,
  replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped
FROM det""",
    "find_all": f"WITH {BASE}, {hits('det')} SELECT doc_id, det_idx, value, s, e FROM hits",
    "find_all_variants": f"WITH {_VARIANT} SELECT doc_id, det_idx, s, e FROM marks",
    "token_boundary": f"WITH {BASE}, {hits('det')} SELECT doc_id, det_idx, s, {_BOUNDARY} AS at_boundary, substring(text, greatest(0, s - 14) + 1, least(length(text), e + 14) - greatest(0, s - 14)) AS around FROM hits",
    "phone_match": f"WITH {BASE} SELECT doc_id, det_idx, value, {phone('value')} <> '' AND contains({phone('text')}, {phone('value')}) AS in_stream FROM det WHERE {is_phone('value')}",
    "eval_status": f"WITH {EVAL} SELECT doc_id, det_idx, bucket, status, CASE WHEN bucket = 'matched' THEN n_good ELSE 0 END AS n_hits FROM ev",
    "eval_occurrences": f"WITH {EVAL} SELECT doc_id, det_idx, s, e, s = -1 AS normalized FROM found WHERE good",
    "eval_duplicates": f"WITH {EVAL} SELECT doc_id, value, count_in_json, count_in_doc, extra FROM dup",
    "eval_notes": f"WITH {_NOTED} SELECT doc_id, det_idx, array_to_string(notes, ' | ') AS notes FROM noted",
    "merge_ranges": f"WITH {_MERGED} SELECT doc_id, s, e FROM merged",
    "mask_text": f"""
WITH {_MERGED}, pieces AS (
  SELECT m.doc_id, m.s, {masked("substring(d.text, m.s + 1, m.e - m.s)")} AS piece FROM merged m JOIN docs d USING (doc_id)
  UNION ALL
  SELECT m.doc_id, m.e, substring(d.text, m.e + 1, coalesce(lead(m.s) OVER (PARTITION BY m.doc_id ORDER BY m.s), length(d.text)) - m.e) FROM merged m JOIN docs d USING (doc_id)
  UNION ALL
  SELECT d.doc_id, -1, substring(d.text, 1, f.s) FROM docs d JOIN (SELECT doc_id, min(s) AS s FROM merged GROUP BY doc_id) f USING (doc_id)
), joined AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY s) AS t FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_ranges, coalesce(t, d.text) AS masked_text FROM docs d LEFT JOIN joined USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM merged GROUP BY doc_id) USING (doc_id)""",
    "mask_sequential": f"""
WITH {BASE}, lists AS (
  SELECT doc_id, text, list_filter(list_transform(dets, lambda d: {trim("d.value")}), lambda v: v <> '') AS v FROM nested
)
SELECT doc_id, list_reduce(list_concat([text], v), lambda a, x: replace(a, x, {masked("x")})) AS masked_text FROM lists""",
    "distinct_values": f"WITH {BASE}, {_DISTINCT} SELECT doc_id, det_idx, type, value, {is_stop('value')} AS is_stop_word FROM dist",
    "pdf_text": f"""
WITH {_ITEMS}, p AS (
  SELECT doc_id, page, string_agg(str, '' ORDER BY item_idx) AS t FROM items GROUP BY ALL
), w AS (
  SELECT doc_id, {trim("string_agg(t || chr(10) || chr(10), '' ORDER BY page)")} AS text, CAST(count(*) AS INTEGER) AS n_pages FROM p GROUP BY doc_id
)
SELECT doc_id, text, n_pages, length(text) < 100 AS is_scanned FROM w""",
    "pdf_lines": f"WITH {_LINES} SELECT doc_id, page, line_id, n_items, text FROM lines",
    "pdf_line_match": f"WITH {_MATCH} SELECT doc_id, page, value, det_idx, line_id, tier FROM matched",
    "pdf_page_counts": f"WITH {_MATCH} SELECT doc_id, page, count(*) AS n_values FROM matched GROUP BY doc_id, page",
    "pdf_position_rects": f"""
WITH {BASE}, {_ITEMS}
SELECT i.doc_id, i.page, d.det_idx, d.value, i.x - 2 AS x, 842.0::DOUBLE - (842.0::DOUBLE - i.y) - i.height - 2 AS y, (CASE WHEN i.width = 0 THEN 100 ELSE i.width END) + 4 AS width, i.height + 4 AS height
FROM items i JOIN (SELECT doc_id, det_idx, {trim("value")} AS value FROM det WHERE {trim("value")} <> '') d ON i.doc_id = d.doc_id AND contains(i.str, d.value) WHERE i.str <> ''""",
    "scanned_rects": f"""
WITH {BASE}, {_ITEMS}, p AS (SELECT DISTINCT doc_id, page FROM items)
SELECT p.doc_id, p.page, d.det_idx, d.value, 50.0::DOUBLE AS x, CAST(842.0 - 100 - 30 * d.det_idx AS DOUBLE) AS y, 300.0::DOUBLE AS width, 20.0::DOUBLE AS height FROM p JOIN det d USING (doc_id)""",
    "image_fallback_rects": f"WITH {BASE} SELECT doc_id, det_idx, value, 45.0::DOUBLE AS x, CAST(35 + 30 * det_idx AS DOUBLE) AS y, 310.0::DOUBLE AS width, 25.0::DOUBLE AS height FROM det",
    "near_miss": f"WITH {_NOTED} SELECT doc_id, det_idx, bucket, array_to_string(notes, ' | ') AS notes FROM noted",
    "reviewed_runs": f"""
WITH {EVAL}, ranges AS (
  SELECT f.doc_id, f.s, f.e, row_number() OVER w AS n, lag(f.e, 1, 0) OVER w AS before FROM found f JOIN ev USING (doc_id, det_idx) WHERE good AND s >= 0 AND bucket = 'matched' WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.s, f.det_idx, f.e)
), ends AS (
  SELECT doc_id, arg_max(e, n) AS e FROM ranges GROUP BY doc_id
), runs AS (
  SELECT doc_id, 0 AS a, 0 AS b, 'heading' AS part, 'd' || doc_id || ' — REVIEWED' AS text, NULL AS color, false AS italics, false AS underline, false AS bold, NULL AS half_pts FROM docs
  UNION ALL SELECT doc_id, 1, 2 * n, 'body', substring(text, before + 1, s - before), NULL, false, false, false, 22 FROM ranges JOIN docs USING (doc_id) WHERE s > before
  UNION ALL SELECT doc_id, 1, 2 * n + 1, 'body', substring(text, s + 1, e - s), 'FF0000', true, true, false, 22 FROM ranges JOIN docs USING (doc_id)
  UNION ALL SELECT d.doc_id, 2, 0, 'body', substring(text, coalesce(e, 0) + 1), NULL, false, false, false, 22 FROM docs d LEFT JOIN ends USING (doc_id) WHERE length(text) > coalesce(e, 0)
  UNION ALL SELECT DISTINCT doc_id, 3, 0, 'appendix_heading', 'Not found in document (detected but no exact match):', NULL, false, false, false, NULL FROM ev WHERE bucket = 'notFound'
  UNION ALL SELECT doc_id, 4, 2 * det_idx, 'appendix', type || ': ', NULL, false, false, true, 22 FROM ev JOIN det USING (doc_id, det_idx) WHERE bucket = 'notFound'
  UNION ALL SELECT doc_id, 4, 2 * det_idx + 1, 'appendix', value, '7B3F00', true, false, false, 22 FROM ev WHERE bucket = 'notFound'
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INTEGER) AS seq, part, text, color, italics, underline, bold, CAST(NULL AS VARCHAR) AS font, CAST(half_pts AS INTEGER) AS half_pts FROM runs""",
    "reviewed_json": f"""
WITH {_NOTED}, said AS (
  SELECT *, array_to_string(list_concat(list_filter([CASE bucket WHEN 'notFound' THEN 'Not found in document.' WHEN 'partials' THEN 'Partial/boundary mismatch.' END,
    CASE WHEN count_in_json IS NOT NULL THEN 'Duplicate: JSON ' || count_in_json || ' vs Doc ' || count_in_doc || '.' END], lambda x: x IS NOT NULL), notes), ' ') AS said FROM noted
), runs AS (
  SELECT doc_id, det_idx, 0 AS b, CASE WHEN det_idx = 0 THEN '{{"pii":[' ELSE '"}},' END || '{{"type":"' || type || '","value":"' AS text, NULL AS color, false AS italics FROM said
  UNION ALL SELECT doc_id, det_idx, 1, value, CASE WHEN said = '' THEN '0066CC' ELSE '000000' END, false FROM said
  UNION ALL SELECT doc_id, det_idx, 2, '  — ' || said, 'FF0000', true FROM said WHERE said <> ''
  UNION ALL SELECT DISTINCT doc_id, 1000, 0, '"}}]}}', NULL, false FROM said
)
SELECT doc_id, 0 AS line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY det_idx, b) - 1 AS INTEGER) AS seq, text, color, italics, false AS underline, false AS bold, 'Courier New' AS font, CAST(NULL AS INTEGER) AS half_pts FROM runs""",
    "docx_runs": f"""
WITH {_NESTED}
SELECT doc_id, p, r, CAST(r % 5 = 4 AS INTEGER) AS n_ws, {_escaped("piece")} AS text, CAST(sum(length({_escaped("piece")})) OVER w - length({_escaped("piece")}) + row_number() OVER w - 1 + sum(CAST(r % 5 = 4 AS INTEGER)) OVER w AS INTEGER) AS start,
  CAST(sum(length({_escaped("piece")})) OVER w + row_number() OVER w - 1 + sum(CAST(r % 5 = 4 AS INTEGER)) OVER w AS INTEGER) AS "end"
FROM pieces WHERE p IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY p, r)""",
    "docx_styled": f"""
WITH {_NESTED}, own AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM paragraphs WHERE p IS NOT NULL GROUP BY doc_id
), wanted AS (
  SELECT DISTINCT o.doc_id, o.text, d.value FROM own o JOIN det d USING (doc_id) WHERE d.value <> ''
), {hits("wanted", name="wh")}, spans AS (
  SELECT DISTINCT doc_id, s, e FROM wh
), above AS (
  SELECT doc_id, p, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM paragraphs WHERE p IS NOT NULL
), placed AS (
  SELECT x.*, base + 7 * r AS a, base + 7 * r + length(piece) AS b FROM pieces x JOIN above USING (doc_id, p)
), over AS (
  SELECT x.doc_id, x.p, x.r, x.a, x.b, h.s, h.e FROM placed x JOIN spans h ON x.doc_id = h.doc_id AND h.s < x.b AND h.e > x.a
), judged AS (
  SELECT doc_id, s, e, bool_and(r % 3 = 1) AS red FROM over GROUP BY ALL
), bounds AS (
  SELECT DISTINCT doc_id, p, r, unnest([a, b, greatest(a, s), least(b, e)]) AS place FROM over
), stretches AS (
  SELECT *, lead(place) OVER (PARTITION BY doc_id, p, r ORDER BY place) AS upto, row_number() OVER (PARTITION BY doc_id, p, r ORDER BY place) AS k FROM bounds
), ruled AS (
  SELECT t.doc_id, t.p, t.r, t.k, t.place, t.upto, arg_max(j.red, (j.s::BIGINT * 10000000 + j.e)) AS red
  FROM stretches t LEFT JOIN judged j ON j.doc_id = t.doc_id AND j.s <= t.place AND j.e >= t.upto WHERE t.upto IS NOT NULL GROUP BY ALL
), redone AS (
  SELECT doc_id, p, r, string_agg('<w:r>' || CASE
      WHEN red IS NULL THEN CASE WHEN r % 3 = 1 THEN '<w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr>' ELSE '' END
      ELSE '<w:rPr>' || CASE WHEN r % 3 = 1 THEN '<w:b/>' ELSE '' END || CASE WHEN red THEN '<w:i/><w:u w:val="single"/><w:color w:val="FF0000"/>' ELSE '<w:u w:val="single"/><w:color w:val="7B3F00"/>' END || '</w:rPr>' END
    || CASE WHEN k = 1 AND r % 5 = 4 THEN '<w:tab/>' ELSE '' END || '<w:t xml:space="preserve">' || {_escaped("substring(piece, CAST(place - a AS BIGINT) + 1, CAST(upto - place AS BIGINT))")} || '</w:t></w:r>', '' ORDER BY k) AS xml
  FROM ruled JOIN placed USING (doc_id, p, r) GROUP BY ALL
), lines AS (
  SELECT c.doc_id, c.line_no, '<w:p>' || coalesce(string_agg(coalesce(d.xml, '<w:r>' || CASE WHEN c.r % 3 = 1 THEN '<w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr>' ELSE '' END || CASE WHEN c.r % 5 = 4 THEN '<w:tab/>' ELSE '' END
    || '<w:t xml:space="preserve">' || {_escaped("c.piece")} || '</w:t></w:r>'), '' ORDER BY c.r), '') || '</w:p>' AS xml
  FROM (SELECT q.doc_id, q.line_no, q.p, x.r, x.piece FROM paragraphs q LEFT JOIN pieces x USING (doc_id, line_no)) c LEFT JOIN redone d ON d.doc_id = c.doc_id AND d.p = c.p AND d.r = c.r GROUP BY c.doc_id, c.line_no
)
SELECT doc_id, '<w:document><w:body>' || string_agg(CASE WHEN line_no % 4 = 3 THEN '{TABLE}' ELSE '' END || CASE WHEN line_no % 11 = 10 THEN '<w:sdt><w:sdtContent>' || xml || '</w:sdtContent></w:sdt>' ELSE xml END, '' ORDER BY line_no) || '</w:body></w:document>' AS xml
FROM lines GROUP BY doc_id""",
    "docx_mask": f"""
WITH {_PIECES}, nodes AS (
  SELECT *, NOT regexp_matches(piece, '[\\r\\x{{2028}}\\x{{2029}}]') AS node FROM pieces
), placed AS (
  SELECT *, coalesce(sum(length(piece)) FILTER (node) OVER (PARTITION BY doc_id ORDER BY p, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM nodes
), joined AS (
  SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY p, r) FILTER (node), '') AS whole FROM placed GROUP BY doc_id
), lists AS (
  SELECT j.doc_id, whole, list_filter(list_transform(dets, lambda d: {trim("d.value")}), lambda v: v <> '') AS v FROM joined j JOIN nested USING (doc_id)
), masks AS (
  SELECT doc_id, list_reduce(list_concat([whole], v), lambda a, x: replace(a, x, {masked("x")})) AS mask FROM lists
), runs AS (
  SELECT doc_id, p, string_agg('<w:r>' || CASE WHEN r % 5 = 4 THEN '<w:rPr><w:color w:val="FF0000"/></w:rPr>' ELSE '' END || '<w:t>' || CASE WHEN node THEN substring(mask, CAST(place AS BIGINT) + 1, length(piece)) ELSE piece END || '</w:t></w:r>', '' ORDER BY r) AS body
  FROM placed JOIN masks USING (doc_id) GROUP BY ALL
)
SELECT doc_id, 'word/document.xml' AS part, '<w:document><w:body>' || string_agg('<w:p>' || coalesce(body, '') || '</w:p>', '' ORDER BY p) || '</w:body></w:document>' AS xml FROM paragraphs LEFT JOIN runs USING (doc_id, p) GROUP BY doc_id""",
    "pdf_item_match": f"WITH {_held(True)} SELECT doc_id, page, value, how, array_to_string(list_transform(found, lambda i: i.str), '|') AS found FROM held",
    "pdf_rects": f"""
WITH {_held(True)}, drawn AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, page, value) AS size FROM hit WHERE {_RELEVANT}
), joint AS (
  SELECT doc_id, page, value, det_idx, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM drawn
  WHERE size > 1 AND ({is_card("value")} OR starts_with(value, 'CUST-') OR starts_with(value, 'INV-')) GROUP BY ALL
  UNION ALL
  SELECT doc_id, page, value, det_idx, x, y, width, height FROM drawn WHERE NOT (size > 1 AND ({is_card("value")} OR starts_with(value, 'CUST-') OR starts_with(value, 'INV-')))
)
SELECT h.doc_id, h.page, h.value, h.det_idx, x - 2 AS x, y - 2 AS y, width + 4 AS width, height + 4 AS height, CASE WHEN x IS NULL THEN 'matched_not_drawn' ELSE 'drawn' END AS status FROM held h LEFT JOIN joint j USING (doc_id, page, value)""",
    "pdf_overlays": f"""
WITH {_held(False)}
SELECT doc_id, page, value, repeat('X', greatest(4, CAST(floor(width / 8) AS BIGINT))) AS text, x, 842.0::DOUBLE - y - height AS y, height AS size FROM hit""",
    "docx_annotate": f"""
WITH {_PIECES}, runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, r) AS n FROM pieces
), first AS (
  SELECT DISTINCT d.doc_id, min(n) AS n FROM det d JOIN runs r ON d.doc_id = r.doc_id AND contains(r.piece, d.value) WHERE d.value <> '' AND contains(d.text, d.value) GROUP BY d.doc_id, d.det_idx
), styled AS (
  SELECT r.doc_id, p, string_agg('<w:r>' || CASE
      WHEN f.n IS NULL THEN CASE WHEN r % 5 = 4 THEN '<w:rPr><w:color w:val="FF0000"/></w:rPr>' ELSE '' END
      WHEN r % 5 = 4 THEN '<w:rPr><w:u w:val="single"/><w:i/><w:color w:val="FF0000"/></w:rPr>' ELSE '<w:rPr><w:color w:val="8B4513"/><w:u w:val="single"/></w:rPr>' END || '<w:t>' || piece || '</w:t></w:r>', '' ORDER BY r) AS body
  FROM runs r LEFT JOIN first f USING (doc_id, n) GROUP BY ALL
)
SELECT doc_id, '<w:document><w:body>' || string_agg('<w:p>' || coalesce(body, '') || '</w:p>', '' ORDER BY p) || '</w:body></w:document>' AS xml FROM paragraphs LEFT JOIN styled USING (doc_id, p) GROUP BY doc_id""",
    "ocr_boxes": f"""
WITH RECURSIVE {BASE}, rows_ AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs
), split_ AS (
  SELECT doc_id, line, unnest(string_split(body, ' ')) AS w, generate_subscripts(string_split(body, ' '), 1) - 1 AS n FROM rows_
), words AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, n) - 1 AS INTEGER) AS i FROM split_
), plain AS (
  SELECT *, {_ocr("CASE WHEN i % 13 = 12 AND length(w) > 4 THEN substring(w, 1, 1) || 'q' || substring(w, 3) ELSE w END")} AS t FROM words
), nested_words AS (
  SELECT doc_id, list(t ORDER BY i) AS ts FROM plain GROUP BY doc_id
), targets AS (
  SELECT doc_id, det_idx, value, target, list_filter(string_split(target, ' '), lambda t: t <> '') AS tokens, replace(target, ' ', '') AS compact FROM (SELECT *, {_ocr("value")} AS target FROM det) WHERE target <> ''
), tried AS (
  SELECT doc_id, det_idx, value, tokens, compact, len(tokens) AS size, i, ts[i + 1:i + len(tokens)] AS win, {bare("array_to_string(ts[i + 1:i + len(tokens)], '')")} AS joined
  FROM targets JOIN nested_words USING (doc_id), unnest(range(len(ts))) AS u(i)
), found AS (
  SELECT doc_id, det_idx, value, size, i FROM tried WHERE joined = compact
    OR (len(win) = size AND len(list_filter(range(1, size + 1), lambda k: CASE WHEN regexp_matches(win[k], '[0-9]') OR regexp_matches(tokens[k], '[0-9]') OR length(tokens[k]) <= 3 THEN win[k] <> tokens[k] ELSE {distance("win[k]", "tokens[k]")} > 1 END)) = 0)
    OR ({digits("joined")} = {digits("compact")} AND abs(length(joined) - length(compact)) <= 2 AND {distance("joined", "compact")} <= 2 AND {distance("joined", "compact")} / greatest(1, length(compact)) <= 0.12)
), taken AS (
  SELECT doc_id, det_idx, value, size, min(i) AS i FROM found GROUP BY ALL
  UNION ALL
  SELECT t.doc_id, t.det_idx, t.value, t.size, min(f.i) FROM taken t JOIN found f ON f.doc_id = t.doc_id AND f.det_idx = t.det_idx AND f.i >= t.i + t.size GROUP BY ALL
)
SELECT t.doc_id, t.det_idx, t.value, CAST(t.i AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS n_words, CAST(min(n * 50) - 2 AS INTEGER) AS x, CAST(min(line * 14 + n % 2 + 10) - 2 AS INTEGER) AS y,
  CAST(max(n * 50 + length(w) * 6) - min(n * 50) + 4 AS INTEGER) AS width, CAST(max(line * 14 + n % 2 + 22) - min(line * 14 + n % 2 + 10) + 4 AS INTEGER) AS height
FROM taken t JOIN words w ON w.doc_id = t.doc_id AND w.i >= t.i AND w.i < t.i + t.size GROUP BY t.doc_id, t.det_idx, t.value, t.i""",
    "page_texts": f"WITH {_ITEMS} SELECT doc_id, page, string_agg(str, ' ' ORDER BY item_idx) AS text FROM items GROUP BY ALL",
    "font_sizes": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(20 + doc_id % 9 AS INTEGER) END AS half_pts FROM documents",
    "red_marks": f"WITH {_PIECES}, most AS (SELECT doc_id, max(r) >= 4 AS red FROM pieces GROUP BY doc_id) SELECT doc_id, coalesce(red, false) AS has_red, coalesce(red, false) AS first_is_red FROM docs LEFT JOIN most USING (doc_id)",
    "file_texts": f"""
WITH {_ITEMS}, p AS (
  SELECT doc_id, page, string_agg(str, '' ORDER BY item_idx) AS t FROM items GROUP BY ALL
), whole AS (
  SELECT doc_id, {trim("string_agg(t || chr(10) || chr(10), '' ORDER BY page)")} AS text FROM p GROUP BY doc_id
)
SELECT d.doc_id, ['docx', 'doc', 'pdf', 'image'][d.doc_id % 4 + 1] AS file_type,
  CASE d.doc_id % 4 WHEN 0 THEN replace(d.text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) WHEN 1 THEN d.text || chr(10) || chr(10) WHEN 2 THEN w.text ELSE '' END AS text,
  CASE d.doc_id % 4 WHEN 2 THEN length(w.text) < 100 WHEN 3 THEN true ELSE false END AS is_scanned
FROM docs0 d JOIN whole w USING (doc_id)""",
    "mask_files": f"""
WITH {_MERGED}, lists AS (
  SELECT doc_id, text, list_filter(list_transform(dets, lambda d: {trim("d.value")}), lambda v: v <> '') AS v FROM nested
), escaped AS (
  SELECT doc_id, string_split(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)) AS lines, v FROM lists
), sequential AS (
  SELECT doc_id, lines, list_reduce(list_concat([array_to_string(lines, '')], v), lambda a, x: replace(a, x, {masked("x")})) AS mask FROM escaped
), dealt AS (
  SELECT doc_id, array_to_string(list_transform(lines, lambda line, i: substring(mask, coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x))), 0)::BIGINT + 1, length(line)) || chr(10) || chr(10)), '') AS text FROM sequential
), ranges AS (
  SELECT m.doc_id, m.s, {masked("substring(d.text, m.s + 1, m.e - m.s)")} AS piece FROM merged m JOIN docs d USING (doc_id)
  UNION ALL
  SELECT m.doc_id, m.e, substring(d.text, m.e + 1, coalesce(lead(m.s) OVER (PARTITION BY m.doc_id ORDER BY m.s), length(d.text)) - m.e) FROM merged m JOIN docs d USING (doc_id)
  UNION ALL
  SELECT d.doc_id, -1, substring(d.text, 1, f.s) FROM docs d JOIN (SELECT doc_id, min(s) AS s FROM merged GROUP BY doc_id) f USING (doc_id)
), ranged AS (
  SELECT d.doc_id, coalesce(t, d.text) || repeat(chr(10), 4) AS text FROM docs d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS t FROM ranges GROUP BY doc_id) USING (doc_id)
)
SELECT d.doc_id, ['docx', 'doc', 'pdf', 'image'][d.doc_id % 4 + 1] AS file_type, 'f' || d.doc_id || '_MASKED.' || ['docx', 'doc', 'pdf', 'png'][d.doc_id % 4 + 1] AS output_name,
  CASE d.doc_id % 4 WHEN 0 THEN replace(replace(replace(x.text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') WHEN 1 THEN r.text END AS text
FROM docs d JOIN dealt x USING (doc_id) JOIN ranged r USING (doc_id)""",
}
SQL["image_masks"] = f"""
WITH boxes AS ({SQL["ocr_boxes"]}), blind AS (
  SELECT doc_id FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(10)) = ''
)
SELECT doc_id, det_idx, value, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height FROM boxes
UNION ALL SELECT doc_id, det_idx, value, x, y, width, height FROM ({SQL["image_fallback_rects"]}) JOIN blind USING (doc_id)"""
_WIDE = "replace(translate({}, '0123456789', '０１２３４５６７８９'), 'fi', 'ﬁ')"
SQL["eval_masked"] = f"""
WITH {EVAL}, kept AS (
  SELECT DISTINCT f.doc_id, f.s, f.e, d.text FROM found f JOIN ev USING (doc_id, det_idx) JOIN docs d ON d.doc_id = f.doc_id WHERE good AND f.s >= 0 AND bucket = 'matched'
), wide AS (
  SELECT doc_id, s - CASE WHEN s > 0 AND substring(text, s, 2) = 'fi' THEN 1 ELSE 0 END AS s, e + CASE WHEN substring(text, e, 2) = 'fi' THEN 1 ELSE 0 END AS e FROM kept
), turned AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM wide
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM turned
), merged AS (
  SELECT doc_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY doc_id, g
), parts AS (
  SELECT m.doc_id, m.s, {masked(_WIDE.format("substring(d.text, m.s + 1, m.e - m.s)"))} AS piece FROM merged m JOIN docs d USING (doc_id)
  UNION ALL SELECT m.doc_id, m.e, {_WIDE.format("substring(d.text, m.e + 1, coalesce(lead(m.s) OVER (PARTITION BY m.doc_id ORDER BY m.s), length(d.text)) - m.e)")} FROM merged m JOIN docs d USING (doc_id)
  UNION ALL SELECT d.doc_id, -1, {_WIDE.format("substring(d.text, 1, f.s)")} FROM docs d JOIN (SELECT doc_id, min(s) AS s FROM merged GROUP BY doc_id) f USING (doc_id)
), joined AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY s) AS t FROM parts GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t, {_WIDE.format("d.text")}) AS masked_text FROM docs d LEFT JOIN joined USING (doc_id)"""
SQL["eval_streamed"] = SQL["eval_duplicates"]
SQL["quarantined"] = f"""
WITH {BASE}
SELECT doc_id, det_idx, type, value, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS error FROM det WHERE doc_id % 50 <> 7
UNION ALL SELECT doc_id, -1, NULL, NULL, '{{"pii":[{{"', 'not JSON' FROM docs WHERE doc_id % 50 = 7"""
SQL["reviewed_files"] = f"""
WITH runs AS ({SQL["reviewed_runs"]}), parts AS (
  SELECT doc_id, min(seq) AS n, string_agg(text, '' ORDER BY seq) AS body FROM runs GROUP BY doc_id, part
)
SELECT doc_id, string_agg(body || chr(10) || chr(10), '' ORDER BY n) AS text FROM parts GROUP BY doc_id"""
SQL["reviewed_json_files"] = f"""
WITH runs AS ({SQL["reviewed_json"]})
SELECT doc_id, 'd' || doc_id || '.json — REVIEWED' || repeat(chr(10), 4) || string_agg(text, '' ORDER BY seq) || chr(10) || chr(10) AS text FROM runs GROUP BY doc_id"""
