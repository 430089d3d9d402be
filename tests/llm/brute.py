"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def order(doc_id):
    return -math.inf if doc_id is None else doc_id


def removed_bytes(rows, width=100):
    """Per row: n_bytes, n_removed, n_spans, sha256 of what is left."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            key, at = data[i:i + width], (order(doc), i)
            if key not in first or first[key] > at:
                first[key] = at
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            if first[data[i:i + width]] < (order(doc), i):
                gone[i:i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def shingles(text, size=5):
    w = words(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def components(sets, percent=80):
    """The number of the first member of each set's component."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in where[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            where[x].append(i)
    return [find(i) for i in range(len(sets))]


def rule_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines"""
    w = words(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(lines))


def keeps(text):
    n_words, chars, symbols, dup, repeat, lines = rule_measures(text)
    return not (n_words < 50 or 100 * repeat > 50 * n_words or 10 * symbols > n_words
                or (dup >= 2 and 2 * dup >= lines) or chars < 2 * n_words or chars > 20 * n_words)


PII = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
       "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def pii(text):
    """Base spans (start, rank of kind, end)."""
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


class Ppm:
    """PPM, escape method D with symbol exclusion, over the lower-cased token stream."""

    def __init__(self, texts, order=5):
        self.order = order
        self.seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
        for text in texts:
            stream = b"\n" * order + self.stream(text)
            for k in range(order, len(stream)):
                for j in range(order + 1):
                    self.seen[j][stream[k - j:k]][stream[k]] += 1

    def stream(self, text):
        return b" ".join((text or "").encode().lower().split()) + b"\n"

    def score(self, text):
        stream = b"\n" * self.order + self.stream(text)
        return sum(self.symbol(stream[k - self.order:k], stream[k]) for k in range(self.order, len(stream)))

    def symbol(self, context, byte):
        cost, out = 0.0, set()
        for j in range(self.order, -1, -1):
            here = self.seen[j].get(context[self.order - j:], {})
            left = {s: n for s, n in here.items() if s not in out}
            if byte in left:
                return cost + math.log10((2 * left[byte] - 1) / (2 * sum(left.values())))
            if left:
                cost += math.log10(len(left) / (2 * sum(left.values())))
            out = set(here)
        return cost - math.log10(max(1, 256 - len(out)))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows."""
    found = [(lang or "", source or "", collections.Counter(TERM.findall(lower(text)))) for text, lang, source in rows]
    held, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, terms in found:
        held[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    utf8 = lambda r: (-r[1], r[0].encode())
    for lang in held.keys() | {g[0] for g in counts}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(of):
            total = sum(of[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (of[t] + 2) // total for t in kept}

        groups = {s: shares(c) for (g, s), c in counts.items() if g == lang}
        whole = shares(sum((c for (g, _), c in counts.items() if g == lang), collections.Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source, p in groups.items():
            pairs = sorted(((o, sum(f(p[t], q[t]) for t in kept)) for o, q in groups.items() if o != source), key=utf8)
            terms = sorted(((t, f(p[t], whole[t])) for t in kept
                            if counts[lang, source][t] > 0 and p[t] > whole[t]), key=utf8)[:top]
            out += [(lang, source, part, item, value, i) for part, xs in (("pair", pairs), ("term", terms))
                    for i, (item, value) in enumerate(xs, 1)]
    return out


def cheapest_repair(turns):
    """(cost, letters, lines) by Dijkstra over (cost, letters); turns are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, roles, lines = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, lines
        state = (at, roles[-1:], len(roles) == 0)
        if state in done:
            continue
        done.add(state)
        nexts = [("I", 5, w, (w, "")) for w in ("user", "assistant")]
        if at < len(turns):
            role, text, fault = turns[at]
            nexts.append(("D", 2, None, None))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                nexts += [("K", more, role, (role, text))] + [("R", 1 + more, w, (w, text)) for w in ("user", "assistant")]
        for letter, price, role, line in nexts:
            now = roles + (role[:1] or " " if role is not None else "")
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + price, letters + letter, at + (letter != "I"), now, lines + ((line,) if line else ())))


def damage(rows):
    """(conv_id, turn, role, text) rows after the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(rows):
    """Result rows of the conversation repair, sorted."""
    left = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        now = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns, seen = [], set()
        for _, _, role, text in now:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not said else "duplicate" if (role, text) in seen
                     else "truncated" if said[-1] not in ".!?" else None)
            turns.append((role, text, fault))
            seen.add((role, text))
        numbers = {r[1] for r in now} - {None}
        initials = [(r[:1] or " ") for r, _, _ in turns]
        cost, letters, lines = cheapest_repair(turns)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                    *[sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))
