"""Plain versions of the text operators, for small tables."""

import calendar
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def classes(docs, threshold=0.8):
    """{doc_id: (class_id, n_links, n_copies)}"""
    sets = {i: shingles(t) for i, t in docs}
    members = defaultdict(list)
    for i, s in sets.items():
        if s:
            members[s].append(i)
    distinct = list(members)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = Counter()
    holders = defaultdict(set)
    for k, s in enumerate(distinct):
        for x in s:
            holders[x].add(k)
    for k, s in enumerate(distinct):
        for m in sorted({m for x in s for m in holders[x] if m > k}):
            other = distinct[m]
            both = len(s & other)
            if both / (len(s) + len(other) - both) >= threshold:
                links[s] += 1
                links[other] += 1
                a, b = find(s), find(other)
                if a is not b:
                    root[b] = a
    least = {}
    for s in distinct:
        least[find(s)] = min(least.get(find(s), 1 << 62), min(members[s]))
    return {i: (least[find(s)], links[s], len(members[s]) - 1) if s else (i, 0, 0) for i, s in sets.items()}


def base_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def cut(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha of the rest)}"""
    seen = Counter()
    raw = {i: (t or "").encode() for i, t in docs}
    for b in raw.values():
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out


def cut_words(docs, words):
    """{doc_id: text without repeated passages of so many words}, from first letter to last; white space around a passage stays."""
    spans = {i: [m.span() for m in WORD.finditer(t or "")] for i, t in docs}
    tokens = {i: [(t or "")[a:b] for a, b in spans[i]] for i, t in docs}
    seen = Counter(tuple(w[k : k + words]) for w in tokens.values() for k in range(len(w) - words + 1))
    out = {}
    for i, t in docs:
        gone = bytearray(len(t or ""))
        for k in range(len(tokens[i]) - words + 1):
            if seen[tuple(tokens[i][k : k + words])] > 1:
                a, b = spans[i][k][0], spans[i][k + words - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out[i] = "".join(c for c, g in zip(t or "", gone) if not g)
    return out


def cut_both(docs, length, words):
    """{doc_id: text without the bytes of repeated strings of so many bytes, or of repeated passages of so many words}, judged on the input."""
    raw = {i: (t or "").encode() for i, t in docs}
    spans = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for i, b in raw.items()}
    told = {i: [raw[i][a:z] for a, z in s] for i, s in spans.items()}
    strings, passages = Counter(), Counter()
    for i, b in raw.items():
        strings.update(b[k : k + length] for k in range(len(b) - length + 1))
        passages.update(tuple(told[i][k : k + words]) for k in range(len(told[i]) - words + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if strings[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        for k in range(len(told[i]) - words + 1):
            if passages[tuple(told[i][k : k + words])] > 1:
                a, z = spans[i][k][0], spans[i][k + words - 1][1]
                gone[a:z] = b"\1" * (z - a)
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def pieces(encode, text, capacity=2048):
    import numpy as np

    ids = [*encode(text or ""), 0]
    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by repeated resharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(v for s, v in out.items())
    return out


def click_moment(click_id, ts):
    k = zlib.crc32(str(click_id).encode()) % 128 if click_id is not None else 64
    if ts is None:
        return None
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday())
    return ts


def leaves(moments, limit):
    """{(level, key): leaf name} by walking siblings in time order; a leaf above the limit has the name of its hour."""
    counts = [Counter(m.timetuple()[: k + 1] for m in moments) for k in range(4)]
    out = {}

    def walk(level, nodes, prefix):
        run, size = [], 0
        runs = []
        for node in nodes:
            n = counts[level][node]
            if n > limit:
                if level == 3:
                    runs.append(([node], n))
                else:
                    year, month = node[0], node[1] if level else 0
                    children = {0: [(*node, m) for m in range(1, 13)], 1: [(*node, d) for d in range(1, calendar.monthrange(year, month)[1] + 1)] if level == 1 else [], 2: [(*node, h) for h in range(24)]}[level]
                    walk(level + 1, children, prefix + [f"{node[-1]:02d}" if level else f"{node[-1]:04d}"])
                run, size = [], 0
                continue
            if run and size + n <= limit:
                run.append(node)
                size += n
                runs[-1] = (run, size)
            else:
                run, size = [node], n
                runs.append((run, size))
        for members, n in runs:
            if n:
                form = "{:02d}" if level else "{:04d}"
                name = "/".join([*prefix, form.format(members[0][-1]) + "-" + form.format(members[-1][-1])])
                out.update({m: name for m in members})

    if moments:
        walk(0, [(y,) for y in range(min(m.year for m in moments), max(m.year for m in moments) + 1)], [])
    return out


def layout(rows, limit):
    """{(leaf, part): rows} of rows (moment, arrived_at, click_id, ...)."""
    told = leaves([r[0] for r in rows if r[0] is not None], limit)
    groups = defaultdict(list)
    for r in rows:
        leaf = "null" if r[0] is None else next(told[r[0].timetuple()[:k]] for k in range(1, 5) if r[0].timetuple()[:k] in told)
        groups[leaf].append(r)
    out = {}
    for leaf, own in groups.items():
        own.sort(key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in (r[0] or datetime(1, 1, 1), r[1], r[2])) + (repr(r),))
        out |= {(leaf, k // limit + 1): own[k : k + limit] for k in range(0, len(own), limit)}
    return out


def relayout(clicks, limit, early):
    """{(leaf, part): (n_rows, n_new, rewritten, sha256 of the ids)} for clicks (click_id, ts, arrived_at, ...)."""
    rows = [(click_moment(c[0], c[1]), c[2], c[0], *c) for c in clicks]
    before = layout([r for r in rows if r[1] is not None and r[1] < early], limit)
    out = {}
    for at, own in layout(rows, limit).items():
        new = sum(r[1] is None or r[1] >= early for r in own)
        same = at in before and Counter(map(repr, before[at])) == Counter(map(repr, own))
        ids = ",".join("" if r[2] is None else str(r[2]) for r in own)
        out[at] = (len(own), new, not same, hashlib.sha256(ids.encode()).hexdigest())
    return out


def fused(model, rows, strength=20.0, least=0.5):
    """(lang, posterior, kept) by id of rows (id, text, declared, address, host levels from coarse to fine), by hand."""
    names, size = model.languages, len(model.languages)
    value = lambda v: "none" if not v else v.lower() if v.lower() in names else "other"
    logs = {r[0]: model(r[1]) for r in rows}
    by_text = {i: int(np.argmax(x)) if n else None for i, (n, x) in logs.items()}
    counts = lambda own: np.bincount([by_text[i] for i in own if by_text[i] is not None], minlength=size)
    share = lambda own, above: (counts(own) + strength * above) / (counts(own).sum() + strength)
    top = (counts(by_text) + 1.0) / (counts(by_text).sum() + float(size))

    def table(column):
        out = []
        for k, name in enumerate(names):
            c = {v: sum(value(r[column]) == v and by_text[r[0]] == k for r in rows) + (5.0 if v == name else 1.0) for v in [*names, "other", "none"]}
            out.append({v: np.log(x / sum(c.values())) for v, x in c.items()})
        return out

    mark, suffix, out = table(2), table(3), {}
    for i, _, declared, address, levels in rows:
        prior = top
        for k in range(1, len(levels) + 1):
            prior = share([q[0] for q in rows if q[4][:k] == levels[:k]], prior)
        score = np.array([np.log(prior[k]) + mark[k][value(declared)] + suffix[k][value(address)] + logs[i][1][k] for k in range(size)])
        posterior = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        k = int(score.argmax())
        out[i] = (names[k], posterior[k], bool(logs[i][0] > 0 and names[k] != "und" and posterior[k] >= least))
    return out
