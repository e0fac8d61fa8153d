"""Plain versions of the operators, over lists in memory."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def groups(docs, n, percent):
    """{doc_id: smallest id reachable} for unique ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if similar(sets[a], sets[b], percent):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def removed_lines(docs, percent=80, min_tokens=1):
    rows = []
    for i, text in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate((text or "").split("\n")):
            tokens = set(WORD.findall(lower(line)))
            if len(tokens) >= min_tokens:
                rows.append((i, k, tokens))
    out = defaultdict(list)
    for at, (i, k, tokens) in enumerate(rows):
        if any(similar(tokens, other, percent) for _, _, other in rows[:at]):
            out[i].append(k)
    return dict(out), Counter(i for i, _, _ in rows)


def sentences(text):
    """(first, last, normalised words) of each sentence of each line."""
    out, current = [], []
    for m in WORD.finditer(text or ""):
        if current and ("\n" in text[current[-1].end() : m.start()] or text[current[-1].end() - 1] in ".!?"):
            out.append(current)
            current = []
        current.append(m)
    if current:
        out.append(current)
    return [(s[0].start(), s[-1].end(), tuple(lower(m[0]) for m in s)) for s in out]


def repeated_spans(docs, min_words=8):
    """{doc_id: [(first, last)]} for unique ids."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        spans, run = [], []
        for first, last, unit in [*sentences(text), (0, 0, None)]:
            if unit is not None and unit in seen:
                run.append((first, last, unit))
                continue
            if run and sum(len(u) for *_, u in run) >= min_words:
                spans.append((run[0][0], run[-1][1]))
            run = []
            if unit is not None:
                seen.add(unit)
        out[i] = spans
    return out


def containment(docs, items, n=5, percent=80):
    out = {}
    for i, text in docs:
        held = shingles(text, n)
        for k, item in items:
            own = shingles(item, n)
            if own and 100 * len(own & held) >= percent * len(own):
                out[i, k] = len(own & held)
    return out


class KneserNey:
    """Byte n-grams by direct recursion over counts."""

    def __init__(self, texts, order, floor):
        self.order, self.floor = order, floor
        top = Counter(g for t in texts for g in self.grams(t))
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, table in self.counts.items():
            n = Counter(table.values())
            if all(n[i] for i in range(1, 5)):
                y = n[1] / (n[1] + 2 * n[2])
                raw = [i + 1 - (i + 2) * y * n[i + 2] / n[i + 1] for i in range(3)]
                self.discounts[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
            else:
                self.discounts[k] = [0.5, 1.0, 1.5]
            by = defaultdict(list)
            for g, c in table.items():
                by[g[:-1]].append(c)
            self.contexts[k] = {ctx: (sum(c), sum(self.discount(k, x) for x in c)) for ctx, c in by.items()}

    def grams(self, text):
        data = b"\n" * (self.order - 1) + text.encode()
        return [data[i : i + self.order] for i in range(len(data) - self.order + 1)]

    def discount(self, k, c):
        return self.discounts[k][min(c, 3) - 1]

    def p(self, gram):
        k = len(gram)
        if k == 1:
            c = self.counts[1].get(gram, 0)
            if not c:
                return self.floor
            total, spare = self.contexts[1][b""]
            return (c - self.discount(1, c)) / total + spare / total / 256
        below = self.p(gram[1:])
        if gram[:-1] not in self.contexts[k]:
            return below
        total, spare = self.contexts[k][gram[:-1]]
        c = self.counts[k].get(gram, 0)
        return (c - self.discount(k, c) if c else 0) / total + spare / total * below

    def perplexity(self, text):
        logs = [math.log(self.p(g)) for g in self.grams(text)]
        return math.exp(-sum(logs) / len(logs)) if logs else None
