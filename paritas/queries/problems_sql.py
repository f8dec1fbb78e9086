"""SQL twins of the queries of problems 1 to 5."""

from __future__ import annotations


def _trimmed(c: str) -> str:
    return rf"nullif(trim({c}, ' ' || chr(9) || chr(13) || chr(10)), '')"


def _key(c: str) -> str:
    return f"upper({_trimmed(c)})"


def _amount(c: str) -> str:
    digits = f"regexp_replace({_trimmed(c)}, '[(),[:space:]]', '', 'g')"
    sign = f"CASE WHEN {_trimmed(c)} LIKE '(%)' THEN -1 ELSE 1 END"
    return f"({sign} * try_cast({digits} AS decimal(30,6)))"


_STATUS = """CASE WHEN {k} IN ('Y', 'YES', '1', 'ACTIVE', 'A') THEN 'ACTIVE'
 WHEN {k} IN ('N', 'NO', '0', 'CLOSED', 'X') THEN 'CLOSED' ELSE 'UNKNOWN' END"""
_MONEY = ("opening_balance", "credits", "debits", "adjustments", "closing_balance")


def _p1() -> str:
    def side(table: str, key: str, ref: str, bal: str) -> str:
        money = ", ".join(f"max(try_cast({c} AS decimal(30,6))) AS {c}" for c in _MONEY)
        status = _STATUS.format(k=_key("status"))
        return f"""SELECT {_key(key)} AS k, max({_key(ref)}) AS customer_id, max({_amount(bal)}) AS balance,
            max({_key("currency")}) AS currency, max({status}) AS status, {money}
            FROM {table} WHERE {_key(key)} IS NOT NULL GROUP BY 1"""

    plain = " UNION ALL ".join(
        f"SELECT k, '{c}' FROM b WHERE l IS NOT NULL AND r IS NOT NULL AND l.{c} IS DISTINCT FROM r.{c}"
        for c in ("customer_id", "currency", "status")
    )
    money = " UNION ALL ".join(
        f"""SELECT k, '{c}' FROM b WHERE l IS NOT NULL AND r IS NOT NULL AND
            CASE WHEN l.{c} IS NULL OR r.{c} IS NULL THEN l.{c} IS DISTINCT FROM r.{c} ELSE abs(l.{c} - r.{c}) >= 0.005 END"""
        for c in ("balance", *_MONEY)
    )
    return f"""WITH l AS ({side("legacy_accounts", "acct_no", "customer_ref", "acct_bal")}),
        r AS ({side("accounts", "account_id", "customer_id", "balance")}),
        b AS (SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NOT NULL THEN l END AS l, CASE WHEN r.k IS NOT NULL THEN r END AS r
            FROM l FULL JOIN r ON l.k = r.k)
        SELECT k AS account_key, 'missing_in_accounts' AS finding FROM b WHERE r IS NULL
        UNION ALL SELECT k, 'missing_in_legacy' FROM b WHERE l IS NULL UNION ALL {plain} UNION ALL {money}"""


_P3 = r"""WITH e AS (SELECT event_id, min(sequence) AS s, min(table_name) AS table_name, min(primary_key) AS primary_key,
    min(upper(trim(operation, ' ' || chr(9) || chr(13) || chr(10)))) AS op, min(after_image) AS img FROM cdc_events GROUP BY 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY table_name, primary_key ORDER BY s DESC, event_id DESC) AS rn FROM e
    WHERE op = 'DELETE' OR (op IN ('INSERT', 'UPDATE') AND img IS NOT NULL))
SELECT table_name, primary_key, event_id FROM o WHERE rn = 1 AND op <> 'DELETE'"""


def _p4() -> str:
    def part(table: str, child: str, ckey: str, ref: str, day: str, parent: str, pkey: str) -> str:
        return f"""SELECT DISTINCT '{table}' AS table_name, child_key, strftime(day, '%Y-%m') AS period,
          CASE WHEN NOT EXISTS (SELECT 1 FROM {parent} p WHERE {_key("p." + pkey)} = c.k) THEN 'missing'
            WHEN EXISTS (SELECT 1 FROM {parent} p WHERE {_key("p." + pkey)} = c.k AND CAST(p.deleted_at AS date) < c.day) THEN 'deleted'
            ELSE 'late' END AS reason
          FROM (SELECT {_key(ckey)} AS child_key, {_key(ref)} AS k, {day} AS day FROM {child}) c
          WHERE k IS NOT NULL AND day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {_key("p." + pkey)} = c.k
            AND CAST(p.loaded_at AS date) <= c.day AND coalesce(CAST(p.deleted_at AS date), DATE '9999-12-31') >= c.day)"""

    a = part("legacy_transactions", "legacy_transactions", "txn_id", "acct_ref", "try_cast(ingest_date AS date)", "legacy_accounts", "acct_no")
    b = part("legacy_accounts", "legacy_accounts", "acct_no", "customer_ref", "CAST(loaded_at AS date)", "legacy_customers", "customer_no")
    return f"{a} UNION ALL {b}"


_FORMS = {
    "legacy_transactions": {
        "txn_id": "T[0-9]{11}", "acct_ref": "A[0-9]{10}", "amount": r"-?[0-9]+\.[0-9]{2}", "currency": "[A-Z]{3}",
        "txn_type": "CREDIT|DEBIT|REVERSAL|CHARGEBACK", "event_date": "day", "ingest_date": "day",
    },
    "legacy_customers": {
        "customer_no": "C[0-9]{8}", "full_name": None, "dob": "day", "sex": "[MFU]", "status": None, "phone": "phone",
        "country_code": "[A-Z]{2}", "updated_at": None,
    },
}
_SHARES = ("currency", "txn_type", "sex", "status", "country_code")


def _form(form: str | None) -> str:
    if form is None:
        return "true"
    if form == "day":
        return "(regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(value AS date) IS NOT NULL)"
    if form == "phone":
        return r"(regexp_full_match(value, '\+[0-9]+(-[0-9]+)*') AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)"
    return f"regexp_full_match(value, '{form}')"


def _p2_base() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, load_id, '{c}' AS column_name, CAST({c} AS varchar) AS value, {_form(f).replace('value', c)} AS ok FROM {t}"
        for t, forms in _FORMS.items()
        for c, f in forms.items()
    )
    return f"""counted AS (SELECT table_name, load_id, column_name, value, bool_and(ok) AS ok, count(*) AS n FROM ({long}) GROUP BY 1, 2, 3, 4),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, load_id, column_name ORDER BY value IS NULL, n DESC, value) AS r FROM counted),
    base AS (SELECT table_name, load_id, column_name, CAST(sum(n) AS bigint) AS row_count, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS bigint) AS null_count,
      count(value) AS distinct_count, CAST(coalesce(sum(n) FILTER (value IS NOT NULL AND NOT ok), 0) AS bigint) AS malformed, min(value) AS min_value, max(value) AS max_value,
      max(abs(try_cast(value AS decimal(38,2)))) FILTER (column_name = 'amount' AND ok) AS most_abs,
      list(struct_pack(value := value, n := n) ORDER BY r) FILTER (r <= 5 AND value IS NOT NULL) AS top_values
      FROM ranked GROUP BY 1, 2, 3)"""


_P2_PROFILES = f"""WITH {_p2_base()} SELECT table_name, load_id, column_name, row_count, null_count, distinct_count, malformed,
  min_value, max_value, CAST(to_json(coalesce(top_values, [])) AS varchar) AS top_values FROM base"""

_P2 = f"""WITH {_p2_base()},
  k AS (SELECT p.table_name, p.load_id, p.column_name, p.null_count AS rn, p.distinct_count AS rd, p.top_values AS rt,
     b.null_count, b.distinct_count, b.top_values, b.malformed, b.row_count FROM column_profiles p LEFT JOIN base b USING (table_name, load_id, column_name)),
  pairs AS (SELECT a.table_name, a.load_id, a.column_name, a.row_count AS n1, b.row_count AS n0, a.null_count AS z1, b.null_count AS z0,
     a.most_abs AS m1, b.most_abs AS m0 FROM base a JOIN base b ON a.table_name = b.table_name AND a.column_name = b.column_name AND a.load_id = b.load_id + 1
     JOIN (SELECT DISTINCT table_name, load_id, column_name FROM column_profiles) p ON p.table_name = a.table_name AND p.load_id = a.load_id AND p.column_name = a.column_name
     WHERE a.row_count >= 200 AND b.row_count >= 200),
  cells AS (SELECT table_name, load_id, column_name, value, sum(n1) AS n1, sum(n0) AS n0 FROM (
     SELECT table_name, load_id, column_name, value, n AS n1, 0 AS n0 FROM counted UNION ALL SELECT table_name, load_id + 1, column_name, value, 0, n FROM counted)
     WHERE value IS NOT NULL AND column_name IN {_SHARES} GROUP BY 1, 2, 3, 4)
  SELECT table_name, load_id, column_name, 'null_count' AS finding FROM k WHERE rn IS DISTINCT FROM coalesce(null_count, 0)
  UNION ALL SELECT table_name, load_id, column_name, 'distinct_count' FROM k WHERE rd IS DISTINCT FROM coalesce(distinct_count, 0)
  UNION ALL SELECT table_name, load_id, column_name, 'top_values' FROM k WHERE CAST(to_json(rt) AS varchar) IS DISTINCT FROM CAST(to_json(coalesce(top_values, [])) AS varchar)
  UNION ALL SELECT table_name, load_id, column_name, 'pattern' FROM k WHERE malformed * 100 > 5 * (row_count - null_count)
  UNION ALL SELECT table_name, load_id, column_name, 'null_shift' FROM pairs WHERE abs(z1 * n0 - z0 * n1) * 100 > 6 * n1 * n0
  UNION ALL SELECT table_name, load_id, column_name, 'range_shift' FROM pairs WHERE m1 > 4 * m0 OR m0 > 4 * m1
  UNION ALL SELECT table_name, load_id, column_name, 'value_shift' FROM (
     SELECT c.table_name, c.load_id, c.column_name, sum(abs(c.n1 * (p.n0 - p.z0) - c.n0 * (p.n1 - p.z1))) AS a, any_value((p.n0 - p.z0) * (p.n1 - p.z1)) AS t
     FROM cells c JOIN pairs p USING (table_name, load_id, column_name) WHERE p.n1 > p.z1 AND p.n0 > p.z0 GROUP BY 1, 2, 3) WHERE a * 100 > 30 * t"""

#: Members of a flat JSON object: name and literal.
_MEMBER = r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}\s]+)'
_KEYS = {
    "legacy_customers": "customer_no", "legacy_accounts": "acct_no", "legacy_transactions": "txn_id",
    "legacy_beneficiaries": "beneficiary_id", "legacy_risk_events": "risk_id",
}
_KEY_OF = "CASE table_name " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in _KEYS.items()) + " END"

_P5_BASE = f"""WITH RECURSIVE lines AS (SELECT row_number() OVER () AS rid, * FROM raw_records),
  members AS (SELECT rid, source_id, file_no, table_name, unnest(regexp_extract_all(payload, '{_MEMBER}', 1)) AS name, unnest(regexp_extract_all(payload, '{_MEMBER}', 2)) AS lit FROM lines),
  cells AS (SELECT *, name = {_KEY_OF} AS is_key, CASE WHEN lit LIKE '"%' THEN json_extract_string('[' || lit || ']', '$[0]') WHEN lit <> 'null' THEN lit END AS text,
    CASE WHEN lit = 'null' THEN NULL WHEN lit LIKE '"%' THEN 's' WHEN lit IN ('true', 'false') THEN 'b' WHEN regexp_matches(lit, '[.eE]') THEN 'd' ELSE 'i' END AS kind FROM members),
  keyed AS (SELECT rid, text AS k FROM cells WHERE is_key),
  files AS (SELECT source_id, file_no, row_number() OVER (PARTITION BY source_id ORDER BY file_no) AS ord, lead(file_no) OVER (PARTITION BY source_id ORDER BY file_no) AS next_file
    FROM (SELECT DISTINCT source_id, file_no FROM raw_records)),
  typed AS (SELECT source_id, file_no, min(table_name) AS table_name, name, CASE WHEN count(kind) = 0 THEN NULL WHEN bool_and(kind = 'b') THEN 'boolean' WHEN bool_and(kind = 'i') THEN 'integer'
    WHEN bool_and(kind IN ('i', 'd')) THEN 'number' ELSE 'string' END AS type FROM cells WHERE NOT is_key GROUP BY source_id, file_no, name),
  marked AS (SELECT t.*, ord, next_file, coalesce(lag(ord) OVER l <> ord - 1, true) AS starts, coalesce(lead(ord) OVER l <> ord + 1, true) AS ends
    FROM typed t JOIN files USING (source_id, file_no) WINDOW l AS (PARTITION BY source_id, name ORDER BY ord)),
  catalogue AS (SELECT *, max(CASE WHEN starts THEN ord END) OVER (PARTITION BY source_id, name ORDER BY ord) AS start FROM marked),
  leavers AS (SELECT source_id, ord + 1 AS ord, next_file AS file_no, file_no AS old_file, name AS old_name, start FROM catalogue WHERE ends AND next_file IS NOT NULL),
  comers AS (SELECT source_id, ord, file_no, name AS new_name FROM catalogue WHERE starts AND ord > 1),
  vals AS (SELECT source_id, file_no, k, name, min(text) AS text FROM cells JOIN keyed USING (rid) WHERE NOT is_key AND text IS NOT NULL AND k IS NOT NULL GROUP BY ALL),
  pairs AS (SELECT l.source_id, l.ord, l.old_name, c.new_name, count(*) AS n, count(*) FILTER (a.text = b.text) AS same FROM leavers l JOIN comers c USING (source_id, ord)
    JOIN vals a ON a.source_id = l.source_id AND a.file_no = l.old_file AND a.name = l.old_name JOIN vals b ON b.source_id = c.source_id AND b.file_no = c.file_no AND b.name = c.new_name AND b.k = a.k GROUP BY ALL),
  good AS (SELECT *, row_number() OVER (PARTITION BY source_id, ord, old_name ORDER BY same / n DESC, n DESC, new_name) AS ro,
    row_number() OVER (PARTITION BY source_id, ord, new_name ORDER BY same / n DESC, n DESC, old_name) AS rn FROM pairs WHERE n >= 5 AND same >= 0.8 * n),
  renames AS (SELECT source_id, ord, old_name, new_name FROM good WHERE ro = 1 AND rn = 1),
  links AS (SELECT source_id, new_name AS name, ord AS start, old_name AS before_name, l.start AS before_start FROM renames JOIN leavers l USING (source_id, ord, old_name)),
  heads AS (SELECT source_id, name, start, name AS head, start AS head_start FROM (SELECT DISTINCT source_id, name, start FROM catalogue) ANTI JOIN links USING (source_id, name, start)
    UNION ALL SELECT l.source_id, l.name, l.start, h.head, h.head_start FROM links l JOIN heads h ON h.source_id = l.source_id AND h.name = l.before_name AND h.start = l.before_start),
  kept AS (SELECT c.*, head, head_start, r.old_name FROM catalogue c JOIN heads USING (source_id, name, start) LEFT JOIN renames r ON r.source_id = c.source_id AND r.ord = c.ord AND r.new_name = c.name)"""

_P5 = f"""{_P5_BASE}
  SELECT source_id, CAST(file_no AS integer) AS file_no, CASE WHEN new_name IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind, old_name, coalesce(new_name, '') AS new_name
    FROM leavers LEFT JOIN renames USING (source_id, ord, old_name)
  UNION ALL SELECT source_id, file_no, 'added', '', new_name FROM comers ANTI JOIN renames USING (source_id, ord, new_name)
  UNION ALL SELECT source_id, file_no, 'type_changed', coalesce(old_name, name), name FROM (SELECT *, lag(type) OVER (PARTITION BY source_id, head, head_start ORDER BY ord) AS before FROM kept WHERE type IS NOT NULL)
    WHERE type <> before"""

_P5_UNIFIED = f"""{_P5_BASE},
  types AS (SELECT table_name, head, CASE WHEN count(*) FILTER (type = 'string') > 0 OR (count(*) FILTER (type = 'boolean') > 0 AND count(*) FILTER (type IN ('integer', 'number')) > 0) THEN 'string'
    WHEN count(*) FILTER (type = 'number') > 0 THEN 'number' WHEN count(*) FILTER (type = 'integer') > 0 THEN 'integer' WHEN count(*) FILTER (type = 'boolean') > 0 THEN 'boolean' ELSE 'string' END AS ct FROM kept GROUP BY 1, 2),
  shaped AS (SELECT c.table_name, c.source_id, c.file_no, k AS record_key, a.head, min(CASE ct WHEN 'integer' THEN CAST(try_cast(text AS decimal(38,0)) AS varchar) WHEN 'number' THEN CAST(try_cast(text AS double) AS varchar)
    WHEN 'boolean' THEN CAST(try_cast(text AS boolean) AS varchar) ELSE text END) AS value
    FROM cells c LEFT JOIN keyed USING (rid) JOIN kept a ON a.source_id = c.source_id AND a.file_no = c.file_no AND a.name = c.name JOIN types t ON t.table_name = a.table_name AND t.head = a.head
    WHERE NOT c.is_key GROUP BY ALL)
  SELECT table_name, source_id, CAST(file_no AS integer) AS file_no, record_key, '{{' || string_agg(CAST(to_json(head) AS varchar) || ':' || coalesce(CAST(to_json(value) AS varchar), 'null'), ',' ORDER BY head) || '}}' AS columns
  FROM shaped GROUP BY 1, 2, 3, 4"""

SQL = {
    "p1_found": _p1(),
    "p2_found": _P2,
    "p2_profiles": _P2_PROFILES,
    "p3_found": _P3,
    "p4_found": _p4(),
    "p5_found": _P5,
    "p5_unified": _P5_UNIFIED,
    "p4_counts": f"SELECT table_name, period, reason, count(*) AS n FROM ({_p4()}) GROUP BY 1, 2, 3",
}
