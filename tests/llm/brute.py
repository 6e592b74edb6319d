"""Plain re-computations that the tests compare with."""

import re
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in KINDS.items()
        for m in re.finditer(pattern, text or "")
        if confirmed(kind, m[0])
    ]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def measures(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, again, len(inside)


def jump(key, shards):
    key, bucket, following = key & (2**64 - 1), -1, 0
    while following < shards:
        bucket = following
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        following = int((bucket + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return bucket


def simhash(text, n=3):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """The least index that each index can reach through near pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if near(a, values[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]
