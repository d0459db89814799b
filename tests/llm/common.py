"""Small tables with everything that may be odd about one, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import public_tokenizers

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
random.seed(17)
_words = ["".join(random.choices("abcdefghij", k=random.randint(1, 7))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = r.choice(_words)
    return " ".join(words)


PASSAGE = prose(60, 5)
TEXTS: list[str | None] = [
    None,
    "",
    " \t\n ",
    "one",
    "One  two",
    prose(80, 1),
    prose(80, 1),
    prose(80, 1).upper(),
    prose(80, 1) + " \n",
    edited(prose(120, 2), 60, 3),
    prose(120, 2),
    edited(prose(120, 2), 70, 9),
    PASSAGE + " " + prose(50, 6),
    prose(40, 7) + "\n" + PASSAGE,
    "ab " * 400,
    "x" * 1200,
    "日本語 テキスト é́ 😀 don't   stop\r\n　 x y <|endoftext|> z",
    "mail a.b@c.de, 10.0.0.255 or 10.0.0.256; +1 (269) 555-3296; 4111 1111 1111 1111 and 4111111111111112",
    prose(6000, 8),
    "\x00\x1f\x7f null bytes",
]


def documents(spark, texts=None, extra=True):
    """doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves."""
    texts = TEXTS if texts is None else texts
    rows = [(10 + 3 * i, t, "en", "s", len(t or ""), "x", 1.5, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, key string")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def near_components(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, least reachable doc_id), from all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def exact_groups(rows) -> dict[int, tuple[int, int]]:
    """doc_id to (keeper, group size)."""
    groups = defaultdict(list)
    for k, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    return {k: (min(g)[1], len(g)) for g in groups.values() for _, k in g}


def repeats(rows, length=200) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id to (bytes, removed, spans, what is left)."""
    raw = {k: (t or "").encode() for k, t in rows}
    seen = Counter(d[p : p + length] for d in raw.values() for p in range(len(d) - length + 1))
    out = {}
    for k, d in raw.items():
        hit = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                hit[p : p + length] = b"\1" * length
        left = bytes(b for b, h in zip(d, hit) if not h)
        out[k] = (len(d), sum(hit), len(re.findall(rb"\x01+", bytes(hit))), left)
    return out


_RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    def luhn(d):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, rule in _RULES.items() for m in re.finditer(rule, text or "") if good(k, m.group())]


def discovered_spans(texts: list[str | None], rounds: int = 3, confidence: float = 0.8, support: int = 5) -> list[set[tuple[str, int, int]]]:
    """What contextual extraction adds to the base spans of each text: the graph of instances and patterns in plain dictionaries."""
    kinds, seen = list(_RULES), []
    nines = lambda x: re.sub("[0-9]", "9", x.lower())
    shape = lambda x: re.sub(r"[^\W\d_]+", "a", nines(x))
    for row, t in enumerate(texts):
        t, base = t or "", base_spans(t)
        tokens = [(m.start(), m.end()) for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", t)]
        groups = [[(a, b)] for a, b in tokens]
        run: list = []
        for x in [*tokens, (10**9, 10**9)]:
            if run and (x[0] >= 10**9 or re.fullmatch(r"[ \t]+", t[run[-1][1] : x[0]]) is None):
                if len(run) > 1:
                    groups.append([(run[0][0], run[-1][1])])
                run = []
            run.append(x)
        singles, runs = sorted(g[0] for g in groups if g[0] in tokens), sorted(g[0] for g in groups if g[0] not in tokens)
        for spans in (singles, runs):
            for i, (a, b) in enumerate(spans):
                gap = t[spans[i - 1][1] if i else 0 : a]
                rest = t[b : spans[i + 1][0]] if i + 1 < len(spans) else t[b:] + " $"
                left = re.search(r"(\S*)\s*$", gap)[1]
                before = "^" if left == "" and i == 0 else left
                after = re.match(r"\s*(\S*)", rest)[1]
                kind = next((kinds.index(k) for k in kinds for k2, x, y in base if k2 == k and x < b and y > a), None)
                patterns = ["s " + nines(left) + " " + shape(t[a:b])]
                if before and after and (before != "^" or after != "$"):
                    patterns.append("c " + nines(f"{before} {after}"))
                seen += [(row, a, b, kind, t[a:b].lower(), p) for p in patterns]
    edges: dict = {}
    for _, _, _, kind, instance, p in seen:
        old = edges.get((p, instance))
        edges[p, instance] = kind if old is None else old if kind is None else max(old, kind)
    score = {e: float(k is not None) for e, k in edges.items()}
    for turn in range(rounds):
        by: dict = defaultdict(list)
        for (p, i), k in edges.items():
            by[p].append((score[p, i], k))
        mean = {p: sum(s for s, _ in x) / (len(x) + 1) for p, x in by.items()}
        if turn == rounds - 1:
            break
        sorts: dict = defaultdict(lambda: defaultdict(list))
        for p, i in edges:
            sorts[i][p[:2]].append(mean[p])
        seeds = {i for (_, i), k in edges.items() if k is not None}
        score = {(p, i): 1.0 if i in seeds else max(sum(x) / len(x) for x in sorts[i].values()) for p, i in edges}
    trusted = {}
    for p, x in by.items():
        found = Counter(k for _, k in x if k is not None)
        if mean[p] >= confidence and sum(found.values()) >= support:
            trusted[p] = (sum(found.values()), min(k for k in found if found[k] == max(found.values())))
    out: list[dict] = [{} for _ in texts]
    for row, a, b, kind, _, p in seen:
        if kind is None and p in trusted:
            out[row][a, b] = max(out[row].get((a, b), (0, 0)), trusted[p])
    return [{(kinds[of], a, b) for (a, b), (_, of) in x.items()} for x in out]


def fingerprint(text: str) -> tuple[str, int, list[int]]:
    """Wide lanes in hexadecimal, number of pairs and near lanes, paragraph by paragraph."""
    import hashlib

    import xxhash

    def chained(*parts: str) -> int:
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed

    wide, near, pairs = [0] * 16, [0] * 128, 0
    for p in text.split("\n") if text else []:
        digest = hashlib.sha512(p.encode()).digest()
        wide = [(w + int.from_bytes(digest[4 * j : 4 * j + 4], "big")) % 2**31 for j, w in enumerate(wide)]
        if len(p) >= 24:
            tokens = [*re.findall(r"[^ \t\n\x0b\f\r]{1,16}", p), "\n"]
            found = [chained(a, b) for a, b in zip(tokens, tokens[1:])]
        else:
            found = [chained(("  " + p)[i : i + 3]) for i in range(len(p))] if p else []
        for x in found:
            near[(x & 31) * 4 + (x >> 5 & 3)] += 1 - 2 * (x >> 7 & 1)
        pairs += len(found)
    return "".join(f"{w:08x}" for w in wide), pairs, near


def likeness(a, b) -> float:
    if a == b:
        return 1.0
    size = sum(x * x for x in a[2]) + sum(x * x for x in b[2])
    return max(0.0, min(1.0, 1 - sum((x - y) ** 2 for x, y in zip(a[2], b[2])) / size)) if size else 0.0
