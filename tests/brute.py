"""Plain Python twins of operators, for tests."""

import json
from collections import defaultdict

KEYS = {
    "legacy_customers": "customer_no", "legacy_accounts": "acct_no", "legacy_transactions": "txn_id",
    "legacy_beneficiaries": "beneficiary_id", "legacy_risk_events": "risk_id",
}


class Num(str):
    pass


class Dec(Num):
    pass


def type_of(values):
    kinds = {"b" if isinstance(v, bool) else "d" if isinstance(v, Dec) else "i" if isinstance(v, Num) else "s" for v in values}
    return {"b": "boolean", "i": "integer"}.get("".join(kinds), "number" if kinds <= {"i", "d"} else "string")


def text(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def drift(rows):
    """rows of (source_id, table_name, file_no, payload) -> set of changes, file after file."""
    files = defaultdict(list)
    for source, table, no, payload in rows:
        try:
            x = json.loads(payload, parse_int=Num, parse_float=Dec)
        except (ValueError, TypeError):
            x = {}
        x = dict(x) if isinstance(x, dict) else {}
        key = x.pop(KEYS.get(table), None)
        files[source, no].append((None if key is None else text(key), x))
    out = set()
    for source in {s for s, _ in files}:
        known, before = {}, None
        for no in sorted(n for s, n in files if s == source):
            records = files[source, no]
            fields = {f for _, x in records for f in x}
            kinds = {f: type_of(vs) for f in fields if (vs := [x[f] for _, x in records if x.get(f) is not None])}
            by_key = {f: {} for f in fields}
            for key, x in sorted(records, key=lambda r: str(r)):
                for f, v in x.items():
                    if key is not None and v is not None:
                        by_key[f][key] = min(text(v), by_key[f].get(key, text(v)))
            if before is None:
                known = {f: kinds.get(f) for f in fields}
                before = (fields, by_key)
                continue
            left, came = before[0] - fields, fields - before[0]
            pairs = []
            for a in left:
                for b in came:
                    common = before[1][a].keys() & by_key[b].keys()
                    same = sum(before[1][a][k] == by_key[b][k] for k in common)
                    if len(common) >= 5 and same >= 0.8 * len(common):
                        pairs.append((-same / len(common), -len(common), a, b))
            renamed = {}
            for _, _, a, b in sorted(pairs):
                if a not in renamed.values() and b not in renamed:
                    renamed[b] = a
            for b, a in renamed.items():
                out.add((source, no, "renamed", a, b))
            for a in left - set(renamed.values()):
                out.add((source, no, "removed", a, ""))
            for b in came - set(renamed):
                out.add((source, no, "added", "", b))
            now = {}
            for f in fields:
                old = renamed.get(f, f)
                last = known.get(old) if (f in renamed or f in before[0]) else None
                if kinds.get(f) and last and last != kinds[f]:
                    out.add((source, no, "type_changed", old, f))
                now[f] = kinds.get(f) or last
            known, before = now, (fields, by_key)
    return out
