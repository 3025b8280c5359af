"""DuckDB twins of the queries, in pieces that several of them share."""

from __future__ import annotations

from ..functions import detect
from ..functions.scalars import BASE58

SEP = "chr(31)"
#: The engine's patterns; DuckDB's are Unicode-aware without the flag.
E, P, S, C = (p.removeprefix("(?U)") for p in (detect.EMAIL, detect.PHONE, detect.SSN, detect.CARD))
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"""(len({DIGITS}) BETWEEN 13 AND 19 AND regexp_matches({DIGITS}, '[1-9]') AND list_sum(list_transform(range(len({DIGITS})),
  lambda k: CASE WHEN k % 2 = 1 THEN (CASE WHEN 2 * CAST({DIGITS}[len({DIGITS}) - k] AS INT) > 9 THEN 2 * CAST({DIGITS}[len({DIGITS}) - k] AS INT) - 9
  ELSE 2 * CAST({DIGITS}[len({DIGITS}) - k] AS INT) END) ELSE CAST({DIGITS}[len({DIGITS}) - k] AS INT) END)) % 10 = 0)"""
AREA = f"CAST(substr({DIGITS}, 1, 3) AS INT)"
SSN = f"(len({DIGITS}) = 9 AND {AREA} NOT IN (0, 666) AND {AREA} < 900 AND substr({DIGITS}, 4, 2) <> '00' AND substr({DIGITS}, 6, 4) <> '0000')"
TIGHT = r"regexp_replace({v}, '[ \t\r\n]', '', 'g')"


def canonical(kind: str = "kind", value: str = "value") -> str:
    tight = TIGHT.format(v=value)
    cut = f"(len({tight}) - position('@' IN reverse({tight})))"
    return f"""CASE WHEN {kind} = 'email' AND contains({tight}, '@') THEN left({tight}, {cut} + 1) || lower(substr({tight}, {cut} + 2))
      WHEN {kind} = 'email' THEN {tight} WHEN {kind} = 'domain' THEN lower(rtrim({tight}, '.')) ELSE {value} END"""


def fingerprint(kind: str = "kind", value: str = "value") -> str:
    return f"sha256('maskwright-consent-v1' || chr(0) || {kind} || chr(0) || {canonical(kind, value)})"


def spans(source: str) -> str:
    """CTEs src(id, text) .. kept(id, kind, start, end, value): all disjoint spans."""
    one = lambda rank, kind, pattern: f"SELECT id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM src"
    return rf"""RECURSIVE src AS ({source}),
    m AS ({one(0, "email", E)} UNION ALL {one(2, "phone", P)} UNION ALL {one(3, "ssn", S)} UNION ALL {one(4, "cc", C)}),
    raw AS (SELECT id, rank, kind, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS INT) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
    dom AS (SELECT DISTINCT r.id, s.text, lower(rtrim(split_part({TIGHT.format(v="r.value")}, '@', -1), '.')) AS d FROM raw r JOIN src s ON s.id = r.id WHERE r.kind = 'email'),
    dm AS (SELECT id, regexp_extract_all(text, p, 0) AS o, regexp_extract_all(text, p, 1) AS m, string_split_regex(text, p) AS g FROM (
      SELECT id, text, '(?i)(?:^|[^A-Za-z0-9@._-])(' || replace(d, '.', '[ \t\r\n]*\.[ \t\r\n]*') || ')(?:$|[^A-Za-z0-9._-])' AS p FROM dom
      WHERE regexp_matches(d, '^(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,63}}$'))),
    draw AS (SELECT id, 1 AS rank, 'domain' AS kind, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(o[1:i - 1], lambda x: strlen(x))), 0)
      + strlen(left(o[i], position(m[i] IN o[i]) - 1)) AS INT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM dm)),
    valid AS (SELECT * FROM raw WHERE kind IN ('email', 'phone') OR kind = 'ssn' AND {SSN} OR kind = 'cc' AND {LUHN} UNION ALL SELECT * FROM draw),
    ordered AS (SELECT *, CAST(start + strlen(value) AS INT) AS "end", row_number() OVER (PARTITION BY id ORDER BY start, rank) AS n FROM valid),
    walk AS (SELECT *, true AS keep, "end" AS upto FROM ordered WHERE n = 1
      UNION ALL SELECT o.*, o.start >= w.upto, CASE WHEN o.start >= w.upto THEN o."end" ELSE w.upto END FROM walk w JOIN ordered o ON o.id = w.id AND o.n = w.n + 1),
    kept AS (SELECT id, kind, start, "end", value FROM walk WHERE keep)"""


#: Replaces the spans in table reps(id, start, end, new) of src by byte offsets.
def spliced(reps: str) -> str:
    return f"""reps AS ({reps}),
    lists AS (SELECT id, list(start ORDER BY start) AS a, list("end" ORDER BY start) AS b, list(new ORDER BY start) AS t FROM reps GROUP BY id),
    done AS (SELECT s.id, CASE WHEN l.id IS NULL THEN s.text ELSE
      list_aggregate(list_transform(range(1, len(l.a) + 1), lambda i: decode(encode(s.text)[CASE WHEN i = 1 THEN 1 ELSE l.b[i - 1] + 1 END:l.a[i]]) || l.t[i]), 'string_agg', '')
      || decode(encode(s.text)[l.b[len(l.b)] + 1:octet_length(encode(s.text))]) END AS output FROM src s LEFT JOIN lists l ON l.id = s.id)"""


ALPHABET = BASE58


def reference_id(salt: str, kind: str, value: str) -> str:
    h = f"sha256('{salt}' || {SEP} || {kind} || {SEP} || {value})"
    n = f"CAST('0x' || substr({h}, CAST(2 * i + 1 AS INT), 2) AS INT)"
    return f"list_aggregate(list_transform(range(22), lambda i: substr('{ALPHABET}', CASE WHEN i = 0 THEN {n} % 30 + 2 ELSE {n} % 58 + 1 END, 1)), 'string_agg', '')"
