"""Plain versions of the operators, on lists in memory."""

import collections
import math
import re


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else [])


def jaccard_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    return [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
            and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
         "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def kneser_ney(train, docs, discounts):
    """{id: (tokens, known, N, base score, score)} and p(word, word before)."""
    def tokens(t):
        return (t or "").encode().lower().split() + [b"</s>"]

    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip([b"<s>", *w[:-1]], w))
    n, v, kinds = sum(uni.values()), len(uni), len(bi)
    before = collections.Counter(b for _, b in bi)

    def often(c):
        return [sum(x == r for x in c.values()) for r in (1, 2, 3, 4)]

    high, low = discounts(*often(bi)), discounts(*often(before))
    spare = sum(low[min(x, 3) - 1] for x in before.values()) / kinds
    context = collections.defaultdict(lambda: [0, 0.0])
    for (a, _), c in bi.items():
        context[a][0] += c
        context[a][1] += high[min(c, 3) - 1]

    def left(c, d):
        return max(c - d[min(c, 3) - 1], 0) if c else 0

    def p(word, prior):
        lower = left(before[word], low) / kinds + spare / (v + 1)
        if prior not in context:
            return lower
        c, free = context[prior]
        return left(bi[(prior, word)], high) / c + free / c * lower

    out = {}
    for i, t in docs:
        w = tokens(t)
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n,
                  sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w),
                  sum(math.log10(p(b, a)) for a, b in zip([b"<s>", *w[:-1]], w)))
    return out, p, list(uni)


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))
