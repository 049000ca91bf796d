"""A plain, sequential model of duplicate marking, written apart from the engine."""

from collections import defaultdict


def pairs_of(ends):
    waiting, out = {}, []
    for e in sorted((e for e in ends if e["has_mate"]), key=lambda e: e["idx"]):
        a = waiting.pop(e["qname"], None)
        if a is None:
            waiting[e["qname"]] = e
            continue
        b = e
        letters = lambda p, q: {(0, 0): 2, (0, 1): 3, (1, 1): 4, (1, 0): 5}[int(p["rev"]), int(q["rev"])]
        seen = letters(b, a) if b["first_of_pair"] else letters(a, b)
        if (b["tid"], b["coord"]) >= (a["tid"], a["coord"]):
            one, two = a, b
            orient = letters(a, b)
            if (a["tid"], a["coord"]) == (b["tid"], b["coord"]) and orient == 5:
                orient = 3
        else:
            one, two = b, a
            orient = letters(b, a)
        out.append({"key": (one["tid"], one["coord"], orient, two["tid"], two["coord"]), "i": one["idx"], "j": two["idx"], "seen": seen, "score": a["score"] + b["score"], "at": (a["tile"], a["x"], a["y"])})
    return out


def near(a, b, d):
    return a["at"][0] != -1 and a["at"][0] == b["at"][0] and abs(a["at"][1] - b["at"][1]) <= d and abs(a["at"][2] - b["at"][2]) <= d


def optical(members, best, d):
    flagged = []
    for seen in {m["seen"] for m in members}:
        row = sorted((m for m in members if m["seen"] == seen), key=lambda m: (m["i"], m["j"]))
        if len(row) < 2:
            continue
        if len(row) < 4:
            mark = [m is not best and near(m, best, d) for m in row]
            for i in range(len(row)):
                for j in range(i + 1, len(row)):
                    if row[i] is best or row[j] is best or (mark[i] and mark[j]) or not near(row[i], row[j], d):
                        continue
                    if mark[j]:
                        mark[i] = True
                    else:
                        mark[j] = True
            flagged += [m for m, f in zip(row, mark, strict=True) if f]
            continue
        left = list(range(len(row)))
        while left:
            part, stack = [], [left.pop(0)]
            while stack:
                i = stack.pop()
                part.append(i)
                for j in [j for j in left if near(row[i], row[j], d)]:
                    left.remove(j)
                    stack.append(j)
            keep = next((i for i in part if row[i] is best), None)
            if keep is None:
                keep = min(part, key=lambda i: (row[i]["at"][1], row[i]["at"][2], row[i]["i"]))
            flagged += [row[i] for i in part if i != keep]
    return flagged


def mark(ends, d=100):
    """({idx: (set_rep, set_size)}, optical idx) of the duplicates among ends."""
    dups, spots = {}, set()
    groups = defaultdict(list)
    for p in pairs_of(ends):
        groups[p["key"]].append(p)
    for members in groups.values():
        if len(members) < 2:
            continue
        best = min(members, key=lambda m: (-m["score"], m["i"], m["j"]))
        for m in members:
            if m is not best:
                dups[m["i"]] = dups[m["j"]] = (best["i"], len(members))
        for m in optical(members, best, d):
            spots |= {m["i"], m["j"]}
    places = defaultdict(list)
    for e in ends:
        places[e["tid"], e["coord"], e["rev"]].append(e)
    for here in places.values():
        single = [e for e in here if e["mate_tid"] == -1]
        if len(here) < 2 or not single:
            continue
        keep = None if len(single) < len(here) else min(here, key=lambda e: (-e["score"], e["idx"]))
        for e in single:
            if e is not keep:
                dups[e["idx"]] = (None, None)
    return dups, spots
