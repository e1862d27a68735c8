"""Plain-Python renderings of the operator semantics, for small fixtures only."""

import datetime as dt
import math
from collections import defaultdict

US = dt.timedelta(microseconds=1)
EPOCH = dt.datetime(1970, 1, 1)


def D(s):
    return dt.datetime.fromisoformat(s) if isinstance(s, str) else s


def by_tag(rows):
    g = defaultdict(list)
    for t, d, v in rows:
        g[t].append((D(d), v))
    for t in g:
        g[t].sort()
    return g


def value_at(rows, at):
    at = D(at)
    out = {}
    for t, s in by_tag(rows).items():
        before = [x for x in s if x[0] <= at]
        if before:
            out[t] = before[-1]
    return out


def interp(rows, at):
    at = D(at)
    out = {}
    for t, s in by_tag(rows).items():
        b = [x for x in s if x[0] <= at]
        a = [x for x in s if x[0] >= at]
        if not b or not a:
            continue
        (bt, bv), (at_, av) = b[-1], a[0]
        if at_ == bt:
            out[t] = bv
        else:
            out[t] = bv + (at - bt) / (at_ - bt) * (av - bv)
    return out


def instants(rows, start, end, n):
    start, end = D(start), D(end)
    T = int((end - start).total_seconds())
    res = []
    tags = by_tag(rows)
    last = start + dt.timedelta(seconds=((n - 1) * T) // n)
    for t, s in tags.items():
        if not any(x[0] <= last for x in s):
            continue
        for i in range(n):
            inst = start + dt.timedelta(seconds=(i * T) // n)
            b = [x for x in s if x[0] <= inst]
            res.append((t, inst, b[-1][1] if b else None))
    return res


def cyclic(rows, start, end, step_ms):
    start, end = D(start), D(end)
    res = []
    k = 0
    insts = []
    while start + dt.timedelta(milliseconds=k * step_ms) < end:
        insts.append(start + dt.timedelta(milliseconds=k * step_ms))
        k += 1
    for t, s in by_tag(rows).items():
        for inst in insts:
            b = [x for x in s if x[0] <= inst]
            if b:
                res.append((t, inst, b[-1][1]))
    return res


def _floor_slot(d, step):
    us = (d - EPOCH) // US
    return us // (step * 1_000_000)


def resample(rows, start, end, step=1, seeded=True):
    start, end = D(start), D(end)
    res = []
    for t, s in by_tag(rows).items():
        u = [x for x in s if start <= x[0] <= end]
        if seeded:
            for bnd in (start, end):
                b = [x for x in s if x[0] <= bnd]
                if b:
                    u.append((bnd, b[-1][1]))
        slots = defaultdict(list)
        for d, v in u:
            slots[_floor_slot(d, step)].append(v)
        if not slots:
            continue
        keys = sorted(slots)
        cur = None
        for k in range(keys[0], keys[-1] + 1):
            if k in slots:
                cur = sum(slots[k]) / len(slots[k])
            res.append((t, EPOCH + dt.timedelta(seconds=k * step), cur))
    return res


def agg(vals, group):
    vals = [v for v in vals if v is not None]
    if group == "count":
        return len(vals)
    if not vals:
        return None
    return {"avg": sum(vals) / len(vals), "sum": sum(vals), "min": min(vals), "max": max(vals)}[group]


def filled_agg(rows, start, end, group, seeded=False):
    out = defaultdict(list)
    for t, d, v in resample(rows, start, end, 1, seeded):
        out[t].append(v)
    return {t: agg(v, group) for t, v in out.items()}


def edges(start, end, n):
    start, end = D(start), D(end)
    T = int((end - start).total_seconds())
    return [start + dt.timedelta(seconds=(i * T) // n) for i in range(n + 1)]


def buckets_raw(rows, start, end, n, group, bounds="[)"):
    e = edges(start, end, n)
    res = {}
    tags = by_tag(rows)
    inrange = {t for t, s in tags.items() if any(_inside(d, e[0], e[-1], bounds) for d, _ in s)}
    for t in inrange:
        for i in range(1, n + 1):
            vals = [v for d, v in tags[t] if _inside(d, e[i - 1], e[i], bounds)]
            res[(t, e[i])] = agg(vals, group)
    return res


def _inside(d, a, b, bounds):
    lo = d >= a if bounds[0] == "[" else d > a
    hi = d <= b if bounds[1] == "]" else d < b
    return lo and hi


def buckets_filled(rows, start, end, n, group):
    e = edges(start, end, n)
    res = {}
    tags = by_tag(rows)
    inrange = {t for t, s in tags.items() if any(e[0] <= d <= e[-1] for d, _ in s)}
    for t in inrange:
        for i in range(1, n + 1):
            sub = [(t, d, v) for d, v in tags[t] if e[i - 1] <= d <= e[i]]
            vals = [v for _, _, v in resample(sub, e[i - 1], e[i], 1, seeded=False)]
            res[(t, e[i])] = agg(vals, group) if vals else (0 if group == "count" else None)
    return res


def buckets_avgm(rows, start, end, n):
    e = edges(start, end, n)
    series = defaultdict(list)
    for t, d, v in resample(rows, start, end, 1, seeded=True):
        series[t].append((d, v))
    res = {}
    for t, s in series.items():
        for i in range(1, n + 1):
            vals = [v for d, v in s if e[i - 1] < d < e[i]]
            res[(t, e[i])] = sum(vals) / len(vals) if vals else None
    return res


def transitions(rows, start, end, target):
    start, end = D(start), D(end)
    out = []
    for t, s in by_tag(rows).items():
        prev = None
        first = True
        for d, v in s:
            if not (start <= d <= end):
                continue
            if v == target and (first or v != prev):
                out.append((t, d))
            prev, first = v, False
    return sorted(out)


def isclose(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
