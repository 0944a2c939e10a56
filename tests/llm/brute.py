"""The contracts in plain Python, one row at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Texts that are hard for one contract or another.
HARD = [
    None,
    "",
    " \n\t ",
    "one",
    "one two three",
    "One TWO three four",
    "one two three four",
    "a b c a b c a b c",
    "line\nline\n\n \nline\nother",
    "mail a.b@c.de, x@y, a@b@c.de..f u@v.w.x. p@-.- q@w-.e",
    "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 001.02.3.4 .9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 5500000000000004x",
    "+1 (555) 010-9999 +12 34 +1234567890123456789 ++44 20 7946 0958.",
    "é €uro 名前@例.com a@é.com naïve@host.org 😀 +49 30 123456",
    "x" * 5000 + " " + "# $ % & | < > * " * 30,
    "\r\n\x0b\x0c a\u00a0b c\u2003d",
    "+1 2" * 400,
    "1 " * 3000,
    "a.b-" * 2000 + "@x.y",
]


def words(text):
    return WORD.findall(text or "")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, verdict) for verdict, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def shingles(text, n):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < n:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def classes(docs, n=4, percent=85):
    """(doc_id, set size, smallest reachable id) of (doc_id, text)."""
    sets = {i: shingles(text, n) for i, text in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), both in common.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def base_quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    n, repeated = len(w), len(covered)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, repeated, n < 50 or 100 * repeated > 50 * n


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    told = ",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)
    return (*(len(v) for v in found.values()), hashlib.sha256(told.encode()).hexdigest())
