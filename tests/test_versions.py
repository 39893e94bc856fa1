"""Differences of stored versions against a walk over the parsed values."""

import json
import random

from sitebrief.operators.versions import section_changes, version_pairs


def dump(v):
    return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def brute(old, new):
    """(section, kind, field, previous, current, change) of two stored dictionaries."""
    out = set()
    for section in {*old, *new}:
        a, b = old.get(section), new.get(section)
        if a is None and isinstance(b, (dict, list)):
            a = type(b)()
        if b is None and isinstance(a, (dict, list)):
            b = type(a)()
        if isinstance(a, dict) and isinstance(b, dict):
            for key in {*a, *b}:
                x, y = a.get(key), b.get(key)
                if x != y:
                    kind = "added" if x is None else "removed" if y is None else "modified"
                    out.add((section, "object", key, None if x is None else dump(x), None if y is None else dump(y), kind))
        elif isinstance(a, list) and isinstance(b, list):
            x, y = {dump(v) for v in a}, {dump(v) for v in b}
            out |= {(section, "array", v, None, v, "added") for v in y - x} | {(section, "array", v, v, None, "removed") for v in x - y}
        elif a != b:
            kind = "added" if a in (None, []) else "removed" if b in (None, []) else "modified"
            out.add((section, "value", section, None if a is None else dump(a), None if b is None else dump(b), kind))
    return out


def test_random_sections(spark):
    rnd, rows, want = random.Random(3), [], set()

    def value(depth=0):
        kind = rnd.randrange(7 if depth < 2 else 4)
        if kind == 4:
            return [value(2) for _ in range(rnd.randrange(4))]
        if kind > 4:
            return {k: value(depth + 1) for k in rnd.sample(["b", "a", "é", "c d"], rnd.randrange(4))}
        return [None, rnd.randrange(3), rnd.choice(["x", "", "it's \"q\""]), rnd.random() < 0.5][kind]

    for c in range(60):
        docs = [{s: value() for s in rnd.sample(["team", "products", "market", "x"], rnd.randrange(5))} for _ in range(3)]
        rows += [(f"c{c}", v, json.dumps(d), "s") for v, d in enumerate(docs)]
        want |= {(f"c{c}", *r) for r in brute(docs[1], docs[2])}
    rows += [("one", 1, "{}", "s"), ("bad", 1, "{oops", ""), ("bad", 2, '{"a":1}', "t" * 200), ("none", 1, None, None), ("none", 2, "[1]", "")]
    want |= {("bad", "a", "value", "a", None, "1", "added"), ("none", "executiveSummary", "summary", "executiveSummary", None, None, "removed"),
             ("bad", "executiveSummary", "summary", "executiveSummary", None, "t" * 100, "added")}
    df = spark.createDataFrame(rows, "company_id string, version long, full_analysis string, executive_summary string")
    got = section_changes(version_pairs(df), df).select(
        "company_id", "section", "kind", "field", "previous_value", "current_value", "change_type").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
