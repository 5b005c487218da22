"""A payment-by-payment walk over small tables, written from the matching rules."""

import re


def plain(ref):
    return re.sub(r"[\s\-_]+", "", ref or "").upper()


def closeness(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, rows[j] = rows[j], diagonal + 1 if x == y else max(rows[j], rows[j - 1])
    total = len(a) + len(b)
    return (1.0 - (total - 2 * rows[-1]) / total) * 100.0 / 100.0 if total else 1.0


def walk(payments, ledger, tol, window, threshold, stale, today):
    """payments: (id, ref, amount, currency, day); ledger alike. Returns {id: (status, method, link, confidence, reason)}."""
    taken, out = set(), {}
    refs = {t[0]: plain(t[1]) for t in ledger}
    by_ref, by_currency = {}, {}
    for t in sorted(ledger):
        by_ref.setdefault(refs[t[0]], []).append(t)
        by_currency.setdefault(t[3], []).append(t)

    def agrees(p, t):
        return t[3] == p[3] and p[2] is not None and t[2] is not None and abs(p[2] - t[2]) <= tol

    def fits(p, t):
        return agrees(p, t) and abs((p[4] - t[4]).days) <= window

    for p in sorted(payments):
        ref = plain(p[1])
        same = by_ref.get(ref, [])
        fitting = [t for t in same if fits(p, t)]
        free = [t for t in fitting if t[0] not in taken]
        if free:
            taken.add(free[0][0])
            out[p[0]] = ("matched", "exact", free[0][0], 1.0, None)
        elif fitting:
            out[p[0]] = ("exception", None, fitting[0][0], 1.0, "duplicate")
        elif same and not any(agrees(p, t) for t in same):
            link = next((t for t in same if t[0] not in taken), same[0])
            out[p[0]] = ("exception", None, link[0], 0.0, "amount_mismatch")
        else:
            rated = [
                (closeness(ref, refs[t[0]]), t[0])
                for t in by_currency.get(p[3], [])
                if ref and t[0] not in taken and fits(p, t)
            ]
            rated = [r for r in rated if r[0] >= threshold]
            if rated:
                score, tid = max(rated)
                taken.add(tid)
                out[p[0]] = ("matched", "fuzzy", tid, round(score, 4), None)
            elif (today - p[4]).days > stale:
                out[p[0]] = ("exception", None, None, 0.0, "stale")
            else:
                out[p[0]] = ("unmatched_payment", None, None, 0.0, None)
    return out, [t[0] for t in sorted(ledger) if t[0] not in taken]
